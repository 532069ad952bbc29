"""Problem 6: personal information in free text, as typed placeholders.

Method: a character-level bidirectional LSTM with CRF transitions (``pii_model``), trained in
numpy from labelled spans (``pii_training``). Every text is cut whole into overlapping windows; each
window is decoded, and where windows overlap the tag from the window in which the character lies
deeper is kept, so spans are reconciled over the whole text. Each span is then checked for the
least its kind must hold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.pii_model import KINDS, TAGS, Tagger

MODEL = Path(__file__).with_name("pii_model.npz")
#: Characters of a window and of its overlap with the next.
WINDOW, OVERLAP = 256, 48
#: Windows decoded together.
BATCH = 256

#: Groups of digits in which telephone numbers are written and no numbers of papers, and the other way about, whatever the words around.
_PHONE_GROUPS = re.compile(r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}|0[1-9](?P<sign>[ .-])\d\d(?:(?P=sign)\d\d){3}|9[1-9](?P<gap>[ .-])\d{3}(?:(?P=gap)\d\d){2}")
_PAPER_GROUPS = re.compile(r"\d{3}-\d{2}-\d{4}")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def _inside(ch: str) -> bool:
    """Whether a character is part of a word that has spaces around it."""
    return ch.isalnum() and ord(ch) < 0x3000


def _word_start(text: str, at: int, most: int = 24) -> int:
    """``at`` moved back to the beginning of the word it stands in, if that is not far."""
    for k in range(at, max(0, at - most), -1):
        if not _inside(text[k - 1]):
            return k
    return at


def by_groups(span: str, kind: str) -> str:
    """Kind of a number by the groups it is written in, where these belong to one kind only."""
    if kind not in ("phone", "id_number"):
        return kind
    plain = "".join("-" if unicodedata.category(c) == "Pd" else c for c in unicodedata.normalize("NFKC", span))
    return "phone" if _PHONE_GROUPS.fullmatch(plain) else "id_number" if _PAPER_GROUPS.fullmatch(plain) else kind


class Finder:
    """Finds spans with one trained tagger."""

    def __init__(self, model: bytes):
        self.tagger = Tagger.load(model)

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Overlapping windows over the whole text."""
        out, a, b = [], 0, len(text)
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a = _word_start(text, a + WINDOW - OVERLAP)
        return [*out, (a, b)] if text and not text.isspace() else []

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the spans of each text, in order."""
        cuts = {t: self.windows(t) for t in texts}
        # Equal windows are decoded once.
        order = sorted({t[a:b] for t, ws in cuts.items() for a, b in ws}, key=len)
        decoded: dict[str, np.ndarray] = {}
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            decoded.update(zip(some, self.tagger.decode(some)))
        found = {t: self.reconcile(t, [(a, b, decoded[t[a:b]]) for a, b in ws]) for t, ws in cuts.items()}
        return [found[t] for t in texts]

    def reconcile(self, text: str, windows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, str]]:
        windows.sort(key=lambda w: w[:2])
        tags = np.zeros(len(text), np.int8)
        depth = np.full(len(text), -1, np.int32)
        for a, b, got in windows:
            n = b - a
            # Edges of the text are no edges: nothing is cut off there.
            left = np.arange(n) + (10_000 if a == 0 else 0)
            right = np.arange(n, 0, -1) + (10_000 if b == len(text) else 0)
            own = np.minimum(left, right)
            better = own > depth[a:b]
            tags[a:b][better] = got[better]
            depth[a:b][better] = own[better]
        out: list[tuple[int, int, str]] = []
        marked = np.flatnonzero(tags)
        start, kind = -1, ""
        last = -2
        for i in marked.tolist():
            tag = TAGS[tags[i]]
            if start >= 0 and i == last + 1 and tag[2:] == kind and tag[0] == "I":
                last = i
                continue
            if start >= 0:
                out.append((start, last + 1, kind))
            start, kind, last = i, tag[2:], i
        if start >= 0:
            out.append((start, last + 1, kind))
        out = [(a, b, by_groups(text[a:b], kind)) for a, b, kind in out]
        out = [s for s in out if plausible(text[s[0] : s[1]], s[2]) and (s[2] != "name" or self.whole_name(text, *s[:2]))]
        if any(kind in ("phone", "id_number") for _, _, kind in out):
            taken = [m.span() for m in _OTHER_NUMBER.finditer(text)]
            out = [s for s in out if s[2] not in ("phone", "id_number") or not any(a <= s[0] and s[1] <= b for a, b in taken)]
        return out

    @staticmethod
    def whole_name(text: str, a: int, b: int) -> bool:
        """Whether a name cuts no word."""
        return not ((a > 0 and _inside(text[a - 1]) and _inside(text[a])) or (b < len(text) and _inside(text[b - 1]) and _inside(text[b])))


#: Numbers of hosts and of bank accounts, no part of which is a telephone number or a number of papers.
_OTHER_NUMBER = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)|\b[A-Z]{2}\d\d(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?\b")
_AT = re.compile(r"[@＠]|\(at\)|\[at\]| at ", re.I)


def plausible(span: str, kind: str) -> bool:
    """The least that a span of a kind holds."""
    digits = sum(c.isdigit() for c in span)
    if kind == "name":
        # A lone word in small letters is none.
        return digits == 0 and sum(c.isalpha() for c in span) >= 2 and not (span.islower() and len(span.split()) < 2)
    if kind == "email":
        return bool(_AT.search(span)) and len(span) >= 6
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return digits >= 5
    return digits >= 1 and len(span) >= 5


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with a placeholder in place of each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


@lru_cache(2)
def _finder(model: bytes) -> Finder:
    """One finder per worker and model."""
    return Finder(model)


def _parts(mapping: DataFrame) -> DataFrame:
    return mapping.where("parts IS NOT NULL").select("node_id", F.posexplode("parts").alias("part_no", "part")).where("part IS NOT NULL")


def tagged_parts(mapping: DataFrame, model: str | Path = MODEL) -> DataFrame:
    """(node_id, part_no, text, kinds) of the parts that hold personal information: the masked text and the distinct kinds.

    Null parts and elements give no rows; part_no counts null elements; empty texts hold nothing; very long texts are read
    whole, in windows; repeated rows stay repeated.
    """
    sent = mapping.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows: list[tuple[int, str, list[str]]] = []
            for at in range(0, len(texts), 2000):
                some = texts[at : at + 2000]
                for k, (t, spans) in enumerate(zip(some, finder.spans(some))):
                    if spans:
                        rows.append((at + k, masked(t, spans), sorted({s[2] for s in spans})))
            pick = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["node_id", "part_no", "text", "kinds"])

    return _parts(mapping).mapInArrow(run, "node_id string, part_no int, text string, kinds array<string>")


def pii_found(mapping: DataFrame) -> DataFrame:
    """(node_id, part_no, kind), distinct: the kinds of personal information in each part."""
    return tagged_parts(mapping).select("node_id", "part_no", F.explode("kinds").alias("kind")).distinct()


def masked_parts(mapping: DataFrame, model: str | Path = MODEL) -> DataFrame:
    """(node_id, part_no, text) of every part, personal information replaced by placeholders such as ``[NAME]``."""
    sent = mapping.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = [masked(t, spans) for at in range(0, len(texts), 2000) for t, spans in zip(texts[at : at + 2000], finder.spans(texts[at : at + 2000]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["node_id", "part_no", "text"])

    return _parts(mapping).mapInArrow(run, "node_id string, part_no int, text string")
