"""Problem 8: the whole corpus as ids of a public byte-level BPE vocabulary.

Method: a sentencepiece BPE model is serialised straight from the rank file. Every byte
sequence of the vocabulary becomes a piece of stand-in characters (one per byte), scored
by its negative rank, under an identity normaliser; text is cut by the vocabulary's own
pattern, each distinct pre-token is encoded once per worker, and decoding maps pieces back
to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the default vocabulary, by its name among the public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens a worker remembers before it starts afresh (memory bound, no effect on results).
REMEMBERED = 400_000


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the default vocabulary where the public tokenizers are installed."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> list[bytes]:
    """The byte sequences of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(code)) for code, rank in (line.split() for line in f if line.strip())]
    pieces = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, code in pairs:
        pieces[rank] = code
    if b"" in pieces:
        raise ValueError("ranks must be gapless")
    return pieces


@lru_cache(1)
def stand_ins() -> tuple[str, ...]:
    """One character for each byte, in a block without white space or controls (U+4E00 on)."""
    return tuple(chr(0x4E00 + b) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: a varint, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model of ``pieces``; the id of a piece is its rank, and one unused id beyond them is <unk>."""
    to = stand_ins()
    out = bytearray()
    for rank, code in enumerate(pieces):
        text = "".join(to[b] for b in code).encode()
        out += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # Trainer: model_type BPE, vocabulary size, ids of <unk> and of the absent markers (-1 as a 64-bit varint).
    minus = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, minus) + _field(42, minus) + _field(43, minus))
    # Normaliser: identity, no dummy prefix, white space neither removed nor escaped.
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes text by one vocabulary; made once per worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, list[int]] = {}
        to = stand_ins()
        self.mapped = {b: to[b] for b in range(256)}
        # A pre-token that is a piece by itself needs no merging.
        self.whole = {code: [rank] for rank, code in enumerate(pieces)} if (pieces := self.pieces) else {}

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens not met before."""
        hard = []
        for t in tokens:
            code = t.encode("utf-8", "surrogatepass")
            ids = self.whole.get(code)
            if ids is None:
                hard.append((t, code.decode("latin-1").translate(self.mapped)))
            else:
                self.known[t] = ids
        if hard:
            for (t, _), ids in zip(hard, self.model.encode([m for _, m in hard], out_type=int)):
                self.known[t] = ids

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` without special tokens; an empty text has none."""
        tokens = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known.__getitem__
        try:
            return list(chain.from_iterable(map(known, tokens)))
        except KeyError:
            self.learn({t for t in tokens if t not in self.known})
            return list(chain.from_iterable(map(known, tokens)))

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: the inverse mapping of pieces to bytes."""
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) for every row of ``documents``, in one pass without a shuffle.

    Null and empty texts get an empty list; repeated rows stay repeated; other columns are not read.
    ``path`` names a rank file that every executor can read; None is the default vocabulary.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(vocabulary_path(path))
        for batch in batches:
            ids: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            first = 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                if t:
                    ids += c.encode(t)
                ends[i + 1] = len(ids)
                if len(ids) > 4_000_000:  # a batch of very long texts goes out in pieces
                    yield _batch(batch.column(0).slice(first, i + 1 - first), ends[first : i + 2] - ends[first], ids)
                    ids, first = [], i + 1
                    ends[first] = 0
            if first < batch.num_rows or not batch.num_rows:
                yield _batch(batch.column(0).slice(first), ends[first:] - ends[first], ids)

    def _batch(keys, ends, ids):
        import numpy as np

        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.asarray(ids, dtype=np.int32)))
        return pa.RecordBatch.from_arrays([keys, lists], names=[id_col, "ids"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
