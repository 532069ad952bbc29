"""Training of the prose model: ``python -m chatlake.llm.spam_training [LOCALE_FOLDER ...] [--pods FOLDER ...]``.

The prose is that of public software: the translated messages of GNU gettext catalogues (``*.mo``)
in many languages, and the manuals of Perl (``*.pod``). No table of documents takes part. At most
``SAMPLE`` characters of a language are read, evenly from all its messages; every fifth block of
messages is held out, and the bounds are quantiles of the held-out stretches.
"""

from __future__ import annotations

import gettext
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from chatlake.llm.spam import CLASSES, MODEL, Prose

#: Languages of the prose, English apart: those whose function words are listed, and those of East Asia.
LANGUAGES = ("de", "fr", "es", "it", "pt", "pt_BR", "nl", "sv", "pl", "ru", "ja", "zh_CN", "zh_TW", "ko")
#: Characters of a language at most.
SAMPLE = 600_000
#: Sentences of a block; blocks are separate texts.
BLOCK = 12
#: Shares of the held-out stretches below and above the bounds.
BELOW, ABOVE = 0.001, 0.005

_PLACEHOLDER = re.compile(r"%[-+0-9.l]*[a-zA-Z]|\{\w*\}|\\[a-z]|<\w+>")
_SENTENCE = re.compile(r"[.!?。！？]$")


def messages(folders: list[str], language: str) -> list[str]:
    """Sentences of the catalogues of a language: those of several words, without placeholders and options."""
    out: dict[str, None] = {}
    for folder in folders:
        for path in sorted(Path(folder).glob(f"{language}/LC_MESSAGES/*.mo")):
            try:
                with path.open("rb") as f:
                    texts = gettext.GNUTranslations(f)._catalog
            except (OSError, UnicodeDecodeError, ValueError):
                continue
            for source, text in texts.items():
                if source and isinstance(text, str) and len(text) >= (15 if language in ("ja", "zh_CN", "zh_TW", "ko") else 40):
                    flat = " ".join(text.split())
                    if _SENTENCE.search(flat) and not _PLACEHOLDER.search(flat) and "--" not in flat and "@" not in flat:
                        out[flat] = None
    return list(out)


def pod_paragraphs(folders: list[str]) -> list[str]:
    """Paragraphs of Perl manuals, formatting codes taken off."""
    out = []
    for folder in folders:
        for path in sorted(Path(folder).rglob("*.pod")):
            for p in re.split(r"\n\s*\n", path.read_text("utf-8", "replace")):
                if p[:1].isalpha() and "@" not in p and len(p) > 120 and _SENTENCE.search(p.strip()):
                    for _ in range(3):
                        p = re.sub(r"[A-Z]<+\s*([^<>]*?)\s*>+", r"\1", p)
                    out.append(" ".join(p.split()))
    return out


def blocks(folders: list[str], pods: list[str]) -> dict[str, list[str]]:
    """Texts of about ``BLOCK`` sentences by language, at most ``SAMPLE`` characters of each."""
    found = {language: messages(folders, language) for language in LANGUAGES}
    found["en"] = pod_paragraphs(pods)
    out = {}
    for language, sentences in found.items():
        step = 2 if language == "en" else BLOCK
        joiner = "" if language in ("ja", "zh_CN", "zh_TW") else " "
        texts = [joiner.join(sentences[i : i + step]) for i in range(0, len(sentences), step)]
        keep = min(1.0, SAMPLE / max(1, sum(map(len, texts))))
        out[language] = [t for k, t in enumerate(texts) if int((k + 1) * keep) > int(k * keep)]
    return out


def count(model: Prose, texts: list[str]) -> Counter:
    """Trigrams of classes."""
    cls, _, doc, _ = model.sequences(texts)
    a, b, c = model.trigrams(cls, np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))))
    codes, n = np.unique((a * CLASSES + b) * CLASSES + c, return_counts=True)
    return Counter(dict(zip(codes.tolist(), n.tolist())))


def train(folders: list[str], pods: list[str]) -> Prose:
    empty = Prose(np.zeros((0, 3), np.int64), np.zeros(0), np.array([[-1.0, 1e9]] * 2))
    tri: Counter = Counter()
    held: dict[str, list[str]] = {}
    for language, texts in blocks(folders, pods).items():
        held[language] = texts[::5]
        own = count(empty, [t for k, t in enumerate(texts) if k % 5])
        # Each language weighs the same, English twice.
        total = sum(own.values())
        if total:
            weight = (400_000 if language == "en" else 200_000) / total
            tri.update({k: n * weight for k, n in own.items()})
    codes = np.array(sorted(tri), np.int64)
    counts = np.array([tri[int(k)] for k in codes])
    keys = np.stack([codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES], 1)
    keep = np.rint(counts) > 0
    model = Prose(keys[keep], np.rint(counts[keep]), np.array([[-1.0, 1e9]] * 2))
    means, scripts = [], []
    for language, texts in held.items():
        m, _, _, east, _ = model.stretches(texts)
        if len(m):
            means.append(m)
            scripts.append(east)
            print(language, len(texts), "held-out texts, log2 perplexity", np.round(np.quantile(m, [0, 0.005, 0.02, 0.5, 0.98, 0.99, 1]), 2).tolist())
    every, east = np.concatenate(means), np.concatenate(scripts)
    model.bounds = np.array([np.quantile(every[east == k], [BELOW, 1 - ABOVE]) for k in (0, 1)])
    print(len(codes), "trigrams; log2 perplexity within", model.bounds.tolist())
    return model


if __name__ == "__main__":
    args = sys.argv[1:]
    at = args.index("--pods") if "--pods" in args else len(args)
    MODEL.write_bytes(train(args[:at] or ["/usr/share/locale"], args[at + 1 :] or ["/usr/share/perl", "/usr/lib"]).dump())
