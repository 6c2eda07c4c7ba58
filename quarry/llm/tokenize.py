"""Encoding of a corpus with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every prefix of a piece exactly one token can come last; a token fits if the one before it, the last of
the remaining prefix, would not have merged across their border. One table entry per byte therefore
determines the encoding, an append only extends the table, and an edit only rewrites it from the edit on.
Pieces and whole lines recur all over a corpus of revisions, so their encodings are kept in bounded caches.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import spread

# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on ASCII text; kinds that cannot start at one place are tried in another order.
ASCII_PIECES = r""" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: What the caches of a worker may hold; a full cache starts anew.
CACHED_BYTES = 96_000_000
CACHED_PIECES = 400_000
CACHED_FITS = 1_000_000


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and the border rule between two of its tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.fits: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines ``base64-token rank``."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by repeated merging of the lowest-ranked neighbours (ranks under ``below``): the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms ``token``; None for a single byte."""
        known = self._halves.get(token, 0)
        if known == 0:
            data = self.bytes_of[token]
            known = None
            if len(data) > 1:
                parts = self.merged(data, below=token)
                known = (parts[0], parts[1]) if len(parts) == 2 else None
            self._halves[token] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no merge across their border would come before their own.

        The tokens at the border are undone from the last merge backwards; at each step the pair that was
        adjacent must not have a merge that ranks before the step (of equal ranks the left place merges first).
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        ranks, bytes_of = self.ranks, self.bytes_of
        a, b, known = left, right, (bytes_of[left] + bytes_of[right]) not in ranks
        while known:
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or (of_a is not None and a > b):
                before, a = a, of_a[1]
                known = ranks.get(bytes_of[a] + bytes_of[b], before) >= before
            else:
                before, b = b, of_b[0]
                known = ranks.get(bytes_of[a] + bytes_of[b], before + 1) > before
        if len(self.fits) > CACHED_FITS:
            self.fits.clear()
        self.fits[left, right] = known
        return known


class PrefixTable:
    """The bytes of one piece and, per prefix, its last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Extend the piece; entries of earlier prefixes stay."""
        start, self.data = len(self.data), self.data + more
        ranks, fit, halves = self.vocabulary.ranks, self.vocabulary.fit, self.vocabulary.halves
        last, data = self.last, self.data
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - self.vocabulary.longest), end):
                token = ranks.get(data[begin:end])
                # It must be the encoding of its own bytes, and fit behind the last token of what precedes it.
                if token is not None and (end - begin == 1 or halves(token)) and (not begin or fit(last[begin - 1], token)):
                    last.append(token)
                    break
        return self

    def edit(self, begin: int, end: int, new: bytes) -> PrefixTable:
        """Replace bytes ``begin:end``; prefixes before ``begin`` keep their entries."""
        tail = self.data[end:]
        self.data, self.last = self.data[:begin], self.last[:begin]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes whole texts; safe cuts before line breaks let unchanged lines be looked up as a whole.

    Encodings are kept as little-endian int32 bytes, so that joining them is a copy.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(PIECES).findall
        self.split_ascii = re.compile(ASCII_PIECES, re.ASCII).findall
        self.pieces: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.cached = 0

    def piece(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        # The encoding is unique, so a piece that is a token by itself needs no table.
        if whole is not None and (len(data) == 1 or self.vocabulary.halves(whole)):
            ids = [whole]
        else:
            ids = PrefixTable(self.vocabulary, data).ids()
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces.clear()
        if len(text) <= 64:
            self.pieces[text] = packed
        return packed

    def line(self, text: str) -> bytes:
        pieces = self.split_ascii(text) if text.isascii() else self.split(text)
        try:
            return b"".join(map(self.pieces.__getitem__, pieces))
        except KeyError:
            known = self.pieces.get
            return b"".join([known(piece) or self.piece(piece) for piece in pieces])

    @staticmethod
    def cuts(text: str) -> Iterator[str]:
        """Parts that encode independently: a cut lies between a visible ASCII sign or a letter and a line break.

        Every piece that holds a visible sign ends before white space, and no rule looks back.
        """
        if "\n" not in text:
            yield text
            return
        lines = text.split("\n")
        part = lines[0]
        for line in lines[1:]:
            end = part[-1:]
            if "!" <= end <= "~" or end.isalpha():
                yield part
                part = "\n" + line
            else:
                part += "\n" + line
        yield part

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts, known = [], self.lines.get
        for part in self.cuts(text):
            ids = known(part)
            if ids is None:
                ids = self.line(part)
                self.cached += len(ids) + 2 * len(part) + 200
                if self.cached > CACHED_BYTES:
                    self.lines.clear()
                    self.cached = 0
                self.lines[part] = ids
            parts.append(ids)
        return b"".join(parts)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.load(path))
    return _ENCODERS[path]


def encode_documents(df: DataFrame, *, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens; an empty list for empty and null texts.

    ``vocabulary`` is the path of the rank file on every executor. One row per input row (repeated and null
    keys included), texts whole whatever their length; strings that spell special tokens are ordinary text.
    Other columns are not read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            # Sent in parts, so that long texts do not pile up.
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [coder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    rows = exact(df, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(split, "key long, ids array<int>").withColumnRenamed("key", key)
