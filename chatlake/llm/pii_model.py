"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward, training step, decoding."""

from __future__ import annotations

import io
import unicodedata
from functools import lru_cache

import numpy as np

KINDS = ("name", "email", "phone", "id_number", "address")
#: O, then B- and I- of each kind.
TAGS = ("O", *(p + k for k in KINDS for p in ("B-", "I-")))
#: Tags that may not follow each other: an inside tag continues its own kind only.
FORBIDDEN = np.array([[TAGS[b][:2] == "I-" and TAGS[a][2:] != TAGS[b][2:] for b in range(len(TAGS))] for a in range(len(TAGS))])
STARTS_INSIDE = np.array([t[:2] == "I-" for t in TAGS])


@lru_cache(100_000)
def folded(ch: str) -> str:
    """What a character counts as: width, space, dash and accent variants are one; characters without ink are one."""
    category = unicodedata.category(ch)
    if category in ("Cf", "Cc") and ch != "\n":
        return "<zero>"
    if category == "Zs" or ch == "\t":
        return " "
    if category == "Pd":
        return "-"
    if category[0] == "M":
        return "<mark>"
    plain = unicodedata.normalize("NFKC", ch)
    return plain if len(plain) == 1 else ch


def _class_of(ch: str) -> str:
    """Stand-in of a character that training did not meet often."""
    if len(ch) > 1:
        return ch
    category = unicodedata.category(ch)
    if 0x4E00 <= ord(ch) <= 0x9FFF:
        return "<han>"
    if 0x3040 <= ord(ch) <= 0x309F:
        return "<hiragana>"
    if 0x30A0 <= ord(ch) <= 0x30FF:
        return "<katakana>"
    return {"Lu": "<upper>", "Ll": "<lower>", "Lo": "<letter>", "Nd": "<digit>"}.get(category, "<letter>" if category[0] == "L" else "<other>")


CLASSES = ("<pad>", "<han>", "<hiragana>", "<katakana>", "<upper>", "<lower>", "<letter>", "<digit>", "<other>", "<zero>", "<mark>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Tagger:
    """Weights and alphabet. Parameters: E embedding; Wx, Wh, b of each direction; V, c output; T, S transitions and start."""

    def __init__(self, alphabet: list[str], hidden: int = 32, embed: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.alphabet = [*CLASSES, *alphabet]
        self.ids = {c: i for i, c in enumerate(self.alphabet)}
        self.hidden = hidden

        def init(*shape):
            return (rng.standard_normal(shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)

        k = len(TAGS)
        self.p = {"E": init(len(self.alphabet), embed) * 2, "V": init(2 * hidden, k), "c": np.zeros(k, np.float32), "T": np.zeros((k, k), np.float32), "S": np.zeros(k, np.float32)}
        for d in "fb":
            self.p["Wx" + d] = init(embed, 4 * hidden)
            self.p["Wh" + d] = init(hidden, 4 * hidden)
            self.p["b" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self._codes: dict[str, int] = {}
        self._table = np.full(0x110000, -1, np.int32)  # the same by code point

    def code(self, ch: str) -> int:
        got = self._codes.get(ch)
        if got is None:
            f = folded(ch)
            got = self.ids.get(f)
            if got is None:
                got = self.ids[_class_of(f)]
            if len(self._codes) < 50_000:
                self._codes[ch] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self._table[points]
        if (ids < 0).any():
            for p in set(points[ids < 0].tolist()):
                self._table[p] = self.code(chr(p))
            ids = self._table[points]
        return ids

    # -- forward

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """States of one direction and what the gradient needs, over time-major ids x (T, B); gates order: input, forget, output, candidate."""
        h_ = self.hidden
        table = self.p["E"] @ self.p["Wx" + d] + self.p["b" + d]
        wh = self.p["Wh" + d]
        t, b = x.shape
        h = np.zeros((b, h_), np.float32)
        c = np.zeros((b, h_), np.float32)
        out = np.empty((t, b, h_), np.float32)
        tape = []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[i]] + h @ wh
            g = _sigmoid(z[:, : 3 * h_])
            a = np.tanh(z[:, 3 * h_ :])
            c2 = g[:, h_ : 2 * h_] * c + g[:, :h_] * a
            tc = np.tanh(c2)
            h2 = g[:, 2 * h_ :] * tc
            m = mask[i][:, None]
            tape.append((i, h, c, g, a, tc, m))
            c = np.where(m, c2, c) if not m.all() else c2
            h = np.where(m, h2, h) if not m.all() else h2
            out[i] = h
        return out, tape

    def _states(self, x: np.ndarray, active: np.ndarray, d: str) -> np.ndarray:
        """States of one direction without a tape; columns of ``x`` in order of falling length, ``active`` of them at each time."""
        h_ = self.hidden
        # A sigmoid is a tanh of half the argument, so one tanh does for all gates.
        half = np.concatenate([np.full(3 * h_, 0.5), np.ones(h_)]).astype(np.float32)
        table = (self.p["E"] @ self.p["Wx" + d] + self.p["b" + d]) * half
        wh = self.p["Wh" + d] * half
        t, b = x.shape
        h, c = np.zeros((b, h_), np.float32), np.zeros((b, h_), np.float32)
        out = np.zeros((t, b, h_), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            n = active[i]
            z = table[x[i, :n]]
            z += h[:n] @ wh
            np.tanh(z, out=z)
            g = z[:, : 3 * h_]
            g *= 0.5
            g += 0.5
            cell = c[:n]
            cell *= g[:, h_ : 2 * h_]
            cell += g[:, :h_] * z[:, 3 * h_ :]
            np.multiply(np.tanh(cell), g[:, 2 * h_ :], out=h[:n])
            out[i, :n] = h[:n]
        return out

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """Best tag sequence of each text by Viterbi; texts of like length are best passed together.

        A text whose scores leave no tag a chance against "outside", whatever the transitions around it, has none, and is
        not searched: for such texts the search gives the same.
        """
        if not texts:
            return []
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        t = max(int(sizes[0]), 1)
        x = np.zeros((t, len(texts)), np.int32)
        for k, j in enumerate(order.tolist()):
            x[: lengths[j], k] = self.encode(texts[j])
        active = np.searchsorted(-sizes, -np.arange(t), side="left")
        h = self.hidden
        e = self._states(x, active, "f") @ self.p["V"][:h]
        e += self._states(x, active, "b") @ self.p["V"][h:]
        e += self.p["c"]
        mask = np.arange(t)[:, None] < sizes[None, :]
        trans = np.where(FORBIDDEN, -1e4, self.p["T"]).astype(np.float32)
        start = (self.p["S"] + np.where(STARTS_INSIDE, -1.0, 0.0)).astype(np.float32)  # a window may begin inside a span
        # What a tag can gain over "outside": by the best way to it, and by the best way out.
        gain = np.maximum(trans.max(0) - trans[0, 0], start - start[0]) + max(0.0, float((trans[:, 0] - trans[0, 0]).max()))
        chance = ((e[:, :, 1:] + gain[1:]).max(2) >= e[:, :, 0]) & mask
        searched = np.flatnonzero(chance.any(0))
        out = [np.zeros(n, np.int8) for n in lengths]
        if len(searched):
            tags = self._viterbi(e[:, searched], mask[:, searched], trans, start)
            for k, c in enumerate(searched.tolist()):
                j = int(order[c])
                out[j] = tags[: lengths[j], k]
        return out

    @staticmethod
    def _viterbi(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
        size, n, k = e.shape
        best = start + e[0]
        back = np.empty((size, n, k), np.int8)
        rows = np.arange(n)
        after = np.ascontiguousarray(trans.T)
        for i in range(1, size):
            s = best[:, None, :] + after
            at = s.argmax(2)
            back[i] = at
            new = np.take_along_axis(s, at[:, :, None], 2)[:, :, 0] + e[i]
            m = mask[i]
            best = new if m.all() else np.where(m[:, None], new, best)
        tags = np.zeros((size, n), np.int8)
        last = best.argmax(1)
        for i in range(size - 1, -1, -1):
            inside = mask[i]
            tags[i] = np.where(inside, last, 0)
            if i:
                last = np.where(inside, back[i, rows, last], last)
        return tags

    # -- training

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood per character and its gradients, for time-major ids and tags."""
        p, h_ = self.p, self.hidden
        f, tape_f = self._run(x, mask, "f")
        b, tape_b = self._run(x, mask, "b")
        e = f @ p["V"][:h_] + b @ p["V"][h_:] + p["c"]
        t, n, k = e.shape
        rows = np.arange(n)
        trans = np.where(FORBIDDEN, -1e4, p["T"])
        # Forward and backward sums in the log domain.
        alpha = np.empty_like(e)
        alpha[0] = p["S"] + e[0]
        for i in range(1, t):
            s = alpha[i - 1][:, :, None] + trans
            top = s.max(1)
            new = top + np.log(np.exp(s - top[:, None, :]).sum(1)) + e[i]
            alpha[i] = np.where(mask[i][:, None], new, alpha[i - 1])
        top = alpha[-1].max(1)
        logz = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        grad_e = np.zeros_like(e)
        grad_t = np.zeros((k, k), np.float64)
        beta = np.zeros((n, k), np.float32)
        for i in range(t - 1, -1, -1):
            m = mask[i][:, None]
            prob = np.exp(alpha[i] + beta - logz[:, None])
            grad_e[i] = np.where(m, prob, 0)
            if i:
                after = beta + e[i]
                pair = np.exp(alpha[i - 1][:, :, None] + trans + (after - logz[:, None])[:, None, :])
                grad_t += (pair * m[:, :, None]).sum(0)
                s = trans[None] + after[:, None, :]
                top = s.max(2)
                new = top + np.log(np.exp(s - top[:, :, None]).sum(2))
                beta = np.where(m, new, beta)
        gold = p["S"][y[0]] + e[0][rows, y[0]]
        for i in range(1, t):
            gold = gold + mask[i] * (trans[y[i - 1], y[i]] + e[i][rows, y[i]])
            np.subtract.at(grad_t, (y[i - 1][mask[i]], y[i][mask[i]]), 1)
        total = mask.sum()
        loss = float((logz - gold).sum() / total)
        grad_s = grad_e[0].sum(0)
        np.subtract.at(grad_s, y[0], 1)
        for i in range(t):
            grad_e[i][rows[mask[i]], y[i][mask[i]]] -= 1
        grad_e /= total
        g = {"T": (grad_t / total * ~FORBIDDEN).astype(np.float32), "S": (grad_s / total).astype(np.float32), "c": grad_e.sum((0, 1)), "V": np.concatenate([np.einsum("tnh,tnk->hk", f, grad_e), np.einsum("tnh,tnk->hk", b, grad_e)]), "E": np.zeros_like(p["E"])}
        for d, tape, part in (("f", tape_f, p["V"][:h_]), ("b", tape_b, p["V"][h_:])):
            dh = np.zeros((n, h_), np.float32)
            dc = np.zeros((n, h_), np.float32)
            dtable = np.zeros((len(self.alphabet), 4 * h_), np.float32)
            gwh = np.zeros_like(p["Wh" + d])
            whole = grad_e @ part.T
            for i, h0, c0, gates, a, tc, m in reversed(tape):
                dh_all = dh + whole[i]
                gi, gf, go = gates[:, :h_], gates[:, h_ : 2 * h_], gates[:, 2 * h_ :]
                dc_all = dc + dh_all * go * (1 - tc * tc)
                dz = np.concatenate([dc_all * a * gi * (1 - gi), dc_all * c0 * gf * (1 - gf), dh_all * tc * go * (1 - go), dc_all * gi * (1 - a * a)], 1) * m
                np.add.at(dtable, x[i], dz)
                gwh += h0.T @ dz
                dh = np.where(m, dz @ p["Wh" + d].T, dh_all)
                dc = np.where(m, dc_all * gf, dc)
            g["Wh" + d] = gwh
            g["b" + d] = dtable.sum(0)
            g["Wx" + d] = p["E"].T @ dtable
            g["E"] += dtable @ p["Wx" + d].T
        return loss, g

    # -- storage

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, alphabet=np.array(self.alphabet[len(CLASSES) :]), hidden=self.hidden, **{"p_" + k: v.astype(np.float16) for k, v in self.p.items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tagger:
        z = np.load(io.BytesIO(data))
        t = cls(list(z["alphabet"]), int(z["hidden"]), z["p_E"].shape[1])
        t.p = {k[2:]: z[k].astype(np.float32) for k in z.files if k.startswith("p_")}
        return t


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def apply(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-8))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.n), self.v[k] / (1 - 0.999**self.n)
            self.params[k] -= rate * m / (np.sqrt(v) + 1e-8)
