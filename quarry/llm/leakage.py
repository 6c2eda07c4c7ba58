"""Evaluation texts leaking into a corpus, by latent semantic retrieval and checks on the words themselves.

Texts become word sequences free of markup. A passage is BLOCK consecutive words; its TF-IDF vector (a feature
is a bucket of word hashes, idf over all corpus passages) is projected on the leading singular directions of
the evaluation passages, found by a distributed randomised SVD. Corpus passages do not overlap, evaluation
passages start at every word. An index finds candidates: hash tables of the sides of random planes on which
the vectors lie, joined on their entries, and the cosine verifies them. Vectors are sums of whole numbers, so
passages with equal words have equal entries: a run of 2 * BLOCK shared words always holds such a pair of
passages, and no such run is missed.

Candidates are decided on the words: leaks by a common run of min_run words, paraphrases by the longest common
subsequence and the item's answer.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import spread, written

BLOCK = 6
RANK, OVERSAMPLE, POWER = 64, 8, 2
#: Least latent cosine of a candidate for a common run, and for a paraphrase. A corpus passage that has less than the square
#: of it (of its squared weight) on words of items cannot have it.
COSINE, PARAPHRASE_COSINE = 0.98, 0.8
#: Hash tables of the index, and planes of each.
TABLES, BITS = 16, 18
#: Greatest number in a vector's summand.
SCALE = 1 << 13
#: An index of at most so many entries (counted before, about 60 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ENTRIES = 1_000_000
#: Items of so many words in all (counted before) are sent to every task to be compared; more are joined to the documents pair by pair.
BROADCAST_WORDS = 2_000_000
#: What stands for words beyond the ends of an item and of a text.
NO_ITEM, NO_TEXT = -(1 << 31), (1 << 31) - 1
#: Features of one piece of a product.
PIECE = 4096
#: Share of an item's words in order that makes a paraphrase if the answer is there too, and if it is not.
COMMON, SURE = 0.6, 0.8
#: Document frequencies are counted per bucket of word hashes (a shared bucket only lowers an idf).
DF_BUCKETS = 1 << 16
CACHED_WORDS = 500_000

_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<ref\b[^>]*?/>|<ref\b[^>]*>.*?(?:</ref\s*>|\Z)|<(?:references)\b[^>]*/?>", re.S | re.I)
#: The same behind the last end of a note: what is not closed there ends with its line.
_SKIPPED_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<ref\b[^>]*?/>|<ref\b[^>]*>[^\n]*|<(?:references)\b[^>]*/?>", re.S | re.I)
_NOTE_END = re.compile(r"</ref\s*>", re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]*/?>", re.I)
_TABLE = re.compile(r"^[ \t:]*(?:\{\||\|\}|\|-)[^\n]*$", re.M)
_CELL = re.compile(r"(^[ \t]*[|!]|\|\||!!)[ \t]*(?:[\w-]+[ \t]*=[ \t]*(?:\"[^\"\n]*\"|[^\s|\"]+)[ \t]*)+\|(?!\|)", re.M)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_URL = re.compile(r"\[(?:https?|ftp)?:?//[^\s\]]+[ \t]*([^\]]*)\]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")


def _without_notes(text: str) -> str:
    last = max([m.end() for m in _NOTE_END.finditer(text)], default=0)
    kept, at = [], 0
    while m := (_SKIPPED if at < last else _SKIPPED_OPEN).search(text, at):
        if at < last <= m.start():
            m = _SKIPPED_OPEN.match(text, m.start())
        kept.append(text[at : m.start()])
        at = m.end()
    return "".join(kept) + text[at:]


def words(text: str) -> list[str]:
    """The words of a text, without regard to case, punctuation, blanks, invisible signs and markup."""
    if "<" in text:
        text = _TAG.sub("", _without_notes(text.replace("<br", " <br").replace("<BR", " <BR")))
    if "|" in text:
        if "{|" in text or "\n|" in text or text.startswith("|") or "|}" in text:
            text = _CELL.sub(r"\1 ", _TABLE.sub("", text))
    if "[" in text:
        text = _LINK.sub(r"\1", _LINK.sub(r"\1", text))
        if "//" in text:
            text = _URL.sub(r"\1", text)
    if "''" in text:
        text = re.sub("''+", "", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


def word_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc, ids)``: the words of every text as 32-bit hashes, in order; texts without words give no row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                docs, flat, sizes = [], [], []
                for doc, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = words(whole) if whole else []
                    if not found:
                        continue
                    for w in {w for w in found if w not in known}:
                        known[w] = xxhash.xxh32_intdigest(w) - (1 << 31)
                    docs.append(doc)
                    flat += [known[w] for w in found]
                    sizes.append(len(found))
                    if len(known) > CACHED_WORDS:
                        known.clear()
                offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), ids], ["doc", "ids"])

    rows = exact(df, key, text).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    return spread(rows).mapInArrow(split, "doc long, ids array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array without nulls, and its offsets from 0."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def corpus_blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every non-overlapping passage, and the row it lies in."""
    counts = np.diff(offsets) // BLOCK
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][row] + within * BLOCK, row


def document_frequencies(ids: DataFrame) -> tuple[np.ndarray, int]:
    """In how many corpus passages each word bucket occurs, and the number of passages."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            flat, offsets = _flat(batch.column(0))
            starts, _ = corpus_blocks(offsets)
            if len(starts):
                block = np.sort(flat[starts[:, None] + np.arange(BLOCK)] & (DF_BUCKETS - 1), axis=1)
                first = np.ones(block.shape, bool)
                first[:, 1:] = block[:, 1:] != block[:, :-1]
                total += np.bincount(block[first], minlength=DF_BUCKETS)
                passages += len(starts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], passages))], ["bucket", "n"]
        )

    counts = np.zeros(DF_BUCKETS, np.int64)
    passages = 0
    # At most DF_BUCKETS + 1 rows.
    for bucket, n in ids.select("ids").mapInArrow(split, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            passages = n
        else:
            counts[bucket] = n
    return counts, passages


def _around(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, margin: int, none: int) -> np.ndarray:
    """The words of passages with ``margin`` words on both sides, ``none`` beyond the text."""
    place = starts[:, None] + np.arange(-margin, BLOCK + margin)
    inside = (place >= offsets[:-1][row][:, None]) & (place < offsets[1:][row][:, None])
    return np.where(inside, flat[np.clip(place, 0, max(0, len(flat) - 1))], none).astype(np.int32)


def item_passages(ids: DataFrame, margin: int) -> DataFrame:
    """``(item, block, around)``: the passages of the items, from every word on, and those with the words on both sides."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column(1))
            counts = np.maximum(np.diff(offsets) - BLOCK + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            starts = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            blocks, around = (_around(flat, offsets, starts, row, m, NO_ITEM) for m in (0, margin))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _listed(blocks), _listed(around)], ["item", "block", "around"])

    return ids.select("doc", "ids").mapInArrow(split, "item long, block array<int>, around array<int>").distinct()


def _listed(rows: np.ndarray) -> pa.ListArray:
    """A two-dimensional array as a list array."""
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel()))


def randomised_svd(passages: DataFrame, weight: np.ndarray, place: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular directions of the TF-IDF rows in ``passages(block array<int>)``, a row per feature and an empty one.

    A feature is a bucket of word hashes, ``place`` its row. Every partition multiplies its rows with the
    current directions and sends the product in pieces of PIECE features, which are summed by a second stage;
    the driver sees the sum alone: at most DF_BUCKETS x (rank + OVERSAMPLE) numbers, whatever the tables hold.
    """
    size = int(place.max())
    width = min(size, rank + OVERSAMPLE)
    directions = np.linalg.qr(np.random.default_rng(0).standard_normal((size, width)))[0]
    for _ in range(POWER + 1):

        def multiply(batches: Iterator[pa.RecordBatch], directions: np.ndarray = np.vstack([directions, np.zeros((1, width))])) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(directions)
            for batch in batches:
                buckets = _flat(batch.column(0))[0].reshape(-1, BLOCK) & (DF_BUCKETS - 1)
                block = place[buckets]
                product = sum(weight[buckets[:, k], None] * directions[block[:, k]] for k in range(BLOCK))
                for k in range(BLOCK):
                    np.add.at(total, block[:, k], weight[buckets[:, k], None] * product)
            pieces = [total[at : at + PIECE] for at in range(0, size, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "product"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, product in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(product, np.float64)
                    sums[piece] = sums[piece] + part if piece in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([p.tobytes() for p in sums.values()], pa.binary())], ["piece", "product"])

        kind = "piece int, product binary"
        rows = passages.select("block").mapInArrow(multiply, kind).repartition(-(-size // PIECE), "piece").mapInArrow(add, kind).collect()
        product = np.concatenate([np.frombuffer(r.product, np.float64) for r in sorted(rows)]).reshape(-1, width)[:size]
        directions = np.linalg.svd(product, full_matrices=False)[0]
    return np.vstack([directions[:, : min(rank, width)], np.zeros((1, min(rank, width)))])


@dataclass(frozen=True)
class Space:
    """The latent space: what every word bucket weighs and adds, in whole numbers, so that sums are exact in any order."""

    squares: np.ndarray
    place: np.ndarray
    basis: np.ndarray

    def latent(self, blocks: np.ndarray) -> np.ndarray:
        """Vectors (whole numbers) of passages given as rows of word hashes."""
        block = self.place[blocks & (DF_BUCKETS - 1)]
        return sum(self.basis[block[:, k]] for k in range(BLOCK))

    def codes(self, latent: np.ndarray, tables: int) -> np.ndarray:
        """The entries of vectors in ``tables`` hash tables: the sides of BITS random planes each on which they lie."""
        planes = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (self.basis.shape[1], TABLES * BITS))[:, : tables * BITS]
        # Sums of whole numbers below 2 ** 24: equal passages have equal codes, however they are batched.
        sides = (latent @ planes >= 0).reshape(len(latent), tables, BITS)
        return sides @ (1 << np.arange(BITS, dtype=np.int64))


def fit_space(corpus: DataFrame, passages: DataFrame) -> Space:
    """The space of the items' passages, weighted by how rare words are in all corpus passages."""
    counts, number = document_frequencies(corpus)
    # At most DF_BUCKETS rows.
    used = passages.select(F.explode("block").alias("word")).select(F.col("word").bitwiseAND(F.lit(DF_BUCKETS - 1)).alias("bucket")).distinct().collect()
    place = np.full(DF_BUCKETS, len(used), np.int32)
    place[np.array([r.bucket for r in used], np.int64)] = np.arange(len(used), dtype=np.int32)
    idf = np.log((1 + number) / (1 + counts)) + 1
    basis = randomised_svd(passages, idf, place, RANK)
    weight = np.append(idf[[r.bucket for r in used]], 0.0)
    scaled = np.rint(weight[:, None] * basis * (SCALE / max(1e-12, np.abs(weight[:, None] * basis).max())))
    return Space((idf**2).astype(np.float32), place, scaled.astype(np.float32))


def candidates(corpus: DataFrame, passages: DataFrame, space: Space, cosine: float, tables: int, min_run: int) -> DataFrame:
    """``(doc, item)``: pairs with a passage each whose latent vectors have at least this cosine, sought in ``tables`` tables.

    Both sides meet in the entries of the tables only. Passages with equal words have equal entries, so those
    are never missed; of others at a cosine of 0.9 one table finds 0.06 (and a pair has many passages). With a
    ``min_run`` only pairs are left whose words agree that far around the passages.
    """
    known, margin = len(space.basis) - 1, max(0, min_run - 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = _flat(batch.column(1))[0].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(space.codes(space.latent(blocks), tables))], ["item", "block", "other", "codes"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column(1))
            starts, row = corpus_blocks(offsets)
            if not len(starts):
                continue
            buckets = flat & (DF_BUCKETS - 1)
            mass = space.squares[buckets]
            held = np.where(space.place[buckets] < known, mass, 0)
            span = starts[:, None] + np.arange(BLOCK)
            kept = held[span].sum(axis=1) >= cosine**2 * mass[span].sum(axis=1)
            around = _around(flat, offsets, starts[kept], row[kept], margin, NO_TEXT)
            # Equal passages of one document need one search.
            found = np.unique(np.column_stack([row[kept], around]), axis=0)
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                docs = batch.column(0).take(pa.array(part[:, 0]))
                words = part[:, 1:].astype(np.int32)
                codes = space.codes(space.latent(words[:, margin : margin + BLOCK]), tables)
                yield pa.RecordBatch.from_arrays([docs, _listed(words), _listed(codes)], ["doc", "around", "codes"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_flat(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (1, 2))
            middle = slice(margin, margin + BLOCK)
            x, y = (space.latent(w[:, middle]).astype(np.float64) for w in (a, b))
            alike = (x * y).sum(axis=1) >= (cosine - 1e-9) * np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            if min_run:
                same = a == b
                back = np.cumprod(same[:, :margin][:, ::-1], axis=1).sum(axis=1)
                on = np.cumprod(same[:, margin + BLOCK :], axis=1).sum(axis=1)
                alike &= same[:, middle].all(axis=1) & (back + BLOCK + on >= min_run)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike)) for c in (batch.column(0), batch.column(3))], ["doc", "item"])

    entries = written(passages.mapInArrow(encode, "item long, block array<int>, other array<int>, codes array<long>"), "index")
    small = entries.count() * tables <= BROADCAST_ENTRIES
    index = entries.select("item", "other", F.posexplode("codes").alias("table", "code"))
    sought = corpus.select("doc", "ids").mapInArrow(split, "doc long, around array<int>, codes array<long>")
    sought = sought.select("doc", "around", F.posexplode("codes").alias("table", "code"))
    met = sought.join(F.broadcast(index) if small else index, ["table", "code"]).select("doc", "around", "other", "item")
    return met.mapInArrow(near, "doc long, item long").distinct()


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of consecutive words common to both."""
    best, held = 0, np.zeros(len(b) + 1, np.int32)
    for value in a:
        new = np.zeros(len(b) + 1, np.int32)
        new[1:] = np.where(b == value, held[:-1] + 1, 0)
        held = new
        best = max(best, int(held.max()))
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    held = np.zeros(len(b) + 1, np.int32)
    for value in a:
        new = held.copy()
        new[1:] = np.maximum(new[1:], np.where(b == value, held[:-1] + 1, 0))
        held = np.maximum.accumulate(new)
    return int(held[-1])


def word_index(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of a text, sorted, the number of each place's word among them, and how often each occurs."""
    return np.unique(text, return_inverse=True, return_counts=True)


def words_held(item: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the item's words the text has."""
    values = index[0]
    place = np.searchsorted(values, item)
    place[place == len(values)] = 0
    return values[place] == item


def likeliest_part(item: np.ndarray, text: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The part of a text, half as long again as the item, that holds most of the item's words, each counted by its rarity in the text."""
    width = len(item) + len(item) // 2
    if len(text) <= width:
        return text
    values, place, often = index or word_index(text)
    shared = np.searchsorted(values, np.unique(item[words_held(item, (values, place, often))]))
    worth = np.zeros(len(values))
    worth[shared] = 1.0 / often[shared]
    worth = worth[place]
    sums = np.concatenate([[0.0], np.cumsum(worth)])
    start = int(np.argmax(sums[width:] - sums[:-width]))
    return text[start : start + width]


_FOUND = "doc long, item long, run int, common int, item_words int, answer boolean"


def _decide(pairs: DataFrame, corpus: DataFrame, items: DataFrame, min_run: int) -> DataFrame:
    """The figures of candidate pairs, from the words themselves."""

    def figures(doc: int, text: np.ndarray, index: tuple, item: int, asked: np.ndarray, reply: np.ndarray | None) -> tuple | None:
        if min_run and not _shares_run(asked, text, min_run):
            return None
        # No more words can be common in order than the text, and then its part, has of the item's.
        if not min_run and words_held(asked, index).sum() < COMMON * len(asked):
            return None
        part = likeliest_part(asked, text, index)
        if not min_run and np.isin(asked, part).sum() < COMMON * len(asked):
            return None
        common = common_subsequence(asked, part)
        if not min_run and common < COMMON * len(asked):
            return None
        answered = None if reply is None or not len(reply) else bool(np.isin(reply, text if min_run else part).all())
        return doc, item, longest_run(asked, text), common, len(asked), answered

    def frame(rows: list[tuple | None]) -> pa.RecordBatch:
        columns = list(zip(*[r for r in rows if r], strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "item", "run", "common", "item_words", "answer"])

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (flat, ends), (other, other_ends) = _flat(batch.column(1)), _flat(batch.column(3))
            replies = batch.column(4).to_pylist()
            numbers = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield frame([
                figures(doc, text := flat[ends[r] : ends[r + 1]], word_index(text), item, other[other_ends[r] : other_ends[r + 1]], None if replies[r] is None else np.array(replies[r], np.int32))
                for r, (doc, item) in enumerate(numbers)
            ])

    asked = items.select(F.col("doc").alias("item"), F.col("ids").alias("item_ids"), "answer_ids")
    words = items.select(F.sum(F.size("ids") + F.coalesce(F.size("answer_ids"), F.lit(0)))).first()[0] or 0
    if words <= BROADCAST_WORDS:
        # So many words at most; a document meets the list of its items, and is moved once.
        texts: dict[int, list[tuple]] = {}
        for r in asked.collect():
            texts.setdefault(r.item, []).append((np.array(r.item_ids, np.int32), None if r.answer_ids is None else np.array(r.answer_ids, np.int32)))

        def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, ends = _flat(batch.column(1))
                numbers = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
                rows: list[tuple | None] = []
                for r, (doc, sought) in enumerate(numbers):
                    text = flat[ends[r] : ends[r + 1]]
                    index = word_index(text)
                    rows += [figures(doc, text, index, item, *of) for item in sought for of in texts[item]]
                yield frame(rows)

        lists = pairs.groupBy("doc").agg(F.collect_set("item").alias("sought"))
        found = corpus.join(lists, "doc").select("doc", "ids", "sought").mapInArrow(by_document, _FOUND)
    else:
        found = pairs.join(asked, "item").join(corpus, "doc").select("doc", "ids", "item", "item_ids", "answer_ids").mapInArrow(by_pair, _FOUND)
    return found.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("run", "common", "item_words", "answer")])


def _shares_run(a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Whether both have a run of so many words in common."""
    if min(len(a), len(b)) < length:
        return False
    runs = {a[at : at + length].tobytes() for at in range(len(a) - length + 1)}
    starts = np.flatnonzero(np.isin(b[: len(b) - length + 1], a))
    return any(b[at : at + length].tobytes() in runs for at in starts)


def _search(documents: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, answer: str | None, least: int, cosine: float, tables: int, min_run: int) -> DataFrame:
    corpus = written(word_ids(documents, key, text), "words")
    asked = word_ids(items, item, item_text).where(F.size("ids") >= least)
    if answer:
        replies = word_ids(items, item, answer).select(F.col("doc").alias("reply"), F.col("ids").alias("answer_ids"))
        asked = asked.join(replies, F.col("doc") == F.col("reply"), "left").drop("reply")
    else:
        asked = asked.withColumn("answer_ids", F.lit(None).cast("array<int>"))
    asked = written(asked, "items")
    passages = written(item_passages(asked, max(0, min_run - 1)), "passages")
    if passages.isEmpty():
        return documents.sparkSession.createDataFrame([], _FOUND)
    pairs = candidates(corpus, passages, fit_space(corpus, passages), cosine, tables, min_run)
    return _decide(pairs, corpus, asked, min_run)


def _named(found: DataFrame, key: str, item: str) -> DataFrame:
    return found.select(F.col("doc").alias(key), F.col("item").alias(item), "run", "common", "item_words", "answer")


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str, text: str, item: str, item_text: str, answer: str | None = None, min_run: int = 2 * BLOCK) -> DataFrame:
    """``(key, item, run, common, item_words, answer)`` per document and item that share ``min_run`` words in a row.

    ``run`` is the longest common run, ``common`` the longest common subsequence within the likeliest part of
    the document, ``item_words`` the words of the item, ``answer`` whether all words of the item's answer occur
    in the document (null without one). ``min_run`` must be at least 2 * BLOCK - 1: such a run always holds a
    whole corpus passage, whose vector equals that of an item passage. Null, empty and blank texts and items
    with fewer than ``min_run`` words share nothing; rows of null key are left out. Documents of equal key are
    searched one by one and reported once, with their largest figures; so are items. Empty tables give no
    rows; other columns are not read.
    """
    if min_run < 2 * BLOCK - 1:
        raise ValueError(f"runs under {2 * BLOCK - 1} words need a smaller BLOCK")
    found = _search(documents, items, key, text, item, item_text, answer, min_run, COSINE, 1, min_run)
    return _named(found, key, item)


def find_paraphrases(documents: DataFrame, items: DataFrame, *, key: str, text: str, item: str, item_text: str, answer: str | None = None) -> DataFrame:
    """The same columns per document and item whose text the document repeats, reworded or not.

    Candidates are passages of a latent cosine of PARAPHRASE_COSINE or more. A pair is one if the likeliest part of the document
    has COMMON of the item's words in order and the words of its answer, or, where the answer is unknown or
    not given away, SURE of them. ``answer`` looks at that part only. The search is approximate; nulls, repeated
    keys, empty tables and other columns as in `find_leaks`, items under 2 * BLOCK words are left out.
    """
    found = _search(documents, items, key, text, item, item_text, answer, 2 * BLOCK, PARAPHRASE_COSINE, TABLES, 0)
    share = F.col("common") / F.col("item_words")
    return _named(found.where((share >= SURE) | (F.col("answer") & (share >= COMMON))), key, item)
