"""Template residue, filler and error-page text, found by trusted rules and likeness.

Texts are cut into passages, and every distinct one is kept once, in up to three forms, each with a 64-bit
SimHash over its five-word shingles: the passage itself; the block of passages between empty lines it lies
in, with names and numbers masked; and its frame, in which whatever fills a field is masked. Passages and
blocks that a rule recognises for certain are the seeds.

Candidates for near-duplicates come from partitioned SimHash tables (any two hashes that differ in at most
three bits share a table entry) and from a prefix join: of two sets with a Jaccard similarity of at least
SIMILARITY, the few smallest shingle hashes share one, so no such pair is missed whatever its Hamming
distance. The shingles' Jaccard similarity verifies both. Likeness then decides three times:

* Labels of notices spread over passages and blocks, from the newly labelled ones on, until the connected
  components of all seeds are exhausted: so variants of a known notice are reached.
* An ambiguous mark or word ("undefined", "None", "<NAME>") is residue if its frame is that of other passages
  which have a value, a name or a certain placeholder there: near-duplicates show that it stands for a value.
* Filler text in random order has no near-duplicates. Its label spreads over the graph of passages and words:
  from passages that hold public filler words to the words that occur mostly in such passages, and back,
  until nothing changes.

A document is residue if it holds a labelled passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import residue_rules as rules
from quarry.schema import exact
from quarry.session import durable, spread, written

WORDS = 5
SIMILARITY = 0.8
HAMMING = 3
#: The hash is cut into so many blocks; each choice of KEPT of them is a table. Three bits spoil at most three blocks.
BLOCKS, KEPT = 5, 2
#: A frontier of at most so many passages (counted before) is broadcast, ten entries of 28 bytes each; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Nor is one of more words: a passage has about a fifth of its words as prefix entries of 20 bytes.
BROADCAST_WORDS = 2_000_000
CACHED_CHARS = 30_000_000
_MARKS = ".,;:!?()[]{}<>\"“”„«»‘’'/|–—…=*#-_"
#: A word is filler if it lies in so many passages or more, this share of them labelled; a passage, if this share of its words is (two at least).
WORD_PASSAGES, WORD_SHARE, PASSAGE_SHARE = 3, 0.5, 0.6
#: Share of public filler words, two of them different, that makes a passage a start of filler.
SEED_SHARE = 0.25
#: A vocabulary out of at most so many words, repeated ones included (counted before), is broadcast; a larger one is joined by shuffle.
BROADCAST_VOCABULARY = 1_000_000
#: What a kept form is: open to labels (with public filler words, or without), showing terms (never labelled by likeness), or a frame
#: with a value or with an ambiguous mark. Of equal forms the greatest holds.
LATIN, OPEN, SHOWS, FILLED, SUSPECT = range(-1, 4)

_EXTRACTED = "doc long, keys array<long>, key long, folded string, kind string, role int"


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of two kinds: ``(doc, keys)`` per document, and ``(key, folded, kind, role)`` per passage, masked block or frame new to a task."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        seen: set[int] = set()
        held = 0
        for batch in batches:
            docs, lists, new = [], [], []
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys: set[int] = set()
                for block in rules.blocks(rules.clean(whole)) if whole else ():
                    found = known.get(block)
                    if found is None:
                        found = []
                        passages = rules.block_passages(block)
                        folded = rules.fold_all(passages)
                        kinds = rules.trusted_all(passages, folded)
                        shown = [rules.explains(p) for p in passages]
                        latin = rules.holding_filler(folded)
                        units = [(f, k, SHOWS if s else LATIN if w else OPEN) for f, k, s, w in zip(folded, kinds, shown, latin, strict=True)]
                        parts = [(part, kind) for p, kind in zip(passages, kinds, strict=True) for part in rules.parts(p)]
                        texts = rules.frames([p for p, _ in parts])
                        frames = [
                            (text, None, SUSPECT if not kind and rules.suspected(part) else FILLED)
                            for (part, kind), text in zip(parts, texts, strict=True) if rules.telling(text)
                        ]
                        kind = rules.block_kind(passages, kinds)
                        if (kind or not any(kinds) and not any(shown)) and (text := rules.masked(texts)):
                            units.append((text, kind, LATIN if rules.holding_filler([text])[0] else OPEN))
                        for folded, kind, role in units + frames:
                            if not folded and not kind:
                                continue
                            number = xxhash.xxh3_64_intdigest(f"{folded}\0{kind or ''}\0{role if role in (FILLED, SUSPECT) else ''}") - (1 << 63)
                            if role != FILLED:
                                found.append(number)
                            if number not in seen:
                                seen.add(number)
                                new.append((number, folded, kind, role))
                        held += len(block) + 200
                        if held > CACHED_CHARS:
                            known.clear()
                            seen.clear()
                            held = 0
                        known[block] = found
                    keys.update(found)
                if keys:
                    docs.append(doc)
                    lists.append(list(keys))
            n, m = len(docs), len(new)
            none = lambda count, kind: pa.nulls(count, kind)
            numbers, folded, kinds, roles = zip(*new, strict=True) if new else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(docs, pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(lists, pa.list_(pa.int64())), none(m, pa.list_(pa.int64()))]),
                    pa.concat_arrays([none(n, pa.int64()), pa.array(numbers, pa.int64())]),
                    pa.concat_arrays([none(n, pa.string()), pa.array(folded, pa.string())]),
                    pa.concat_arrays([none(n, pa.string()), pa.array(kinds, pa.string())]),
                    pa.concat_arrays([none(n, pa.int32()), pa.array(roles, pa.int32())]),
                ],
                ["doc", "keys", "key", "folded", "kind", "role"],
            )

    rows = exact(df, key, text).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
    return spread(rows).mapInArrow(split, _EXTRACTED)


def hashed_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of WORDS words of all texts (a shorter text is one shingle), and each text's number of them."""
    hashes: dict[str, int] = {}

    def number(word: str) -> int:
        value = hashes.get(word)
        if value is None:
            value = hashes[word] = xxhash.xxh3_64_intdigest(word)
        return value

    words = [t.split(" ") for t in texts]
    sizes = np.array([max(WORDS, len(w)) for w in words], np.int64)
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - sizes
    for start, row in zip(starts.tolist(), words, strict=True):
        flat[start : start + len(row)] = [number(w) for w in row]
    shingle = np.zeros(len(flat), np.uint64)
    for k in range(WORDS):
        shingle[: len(flat) - k] += np.roll(flat, -k)[: len(flat) - k] * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % (1 << 64) | 1)
    valid = np.arange(len(flat)) <= np.repeat(ends - WORDS, sizes)
    shingle = shingle[valid]
    shingle ^= shingle >> np.uint64(33)
    shingle *= np.uint64(0xFF51AFD7ED558CCD)
    shingle ^= shingle >> np.uint64(33)
    return shingle, sizes - WORDS + 1


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHashes over the shingles."""
    return _simhashes(*hashed_shingles(texts))


def _simhashes(shingle: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at = np.cumsum(counts) - counts
    out = np.zeros(len(counts), np.uint64)
    if len(counts):
        for bit in range(64):
            ones = np.add.reduceat(((shingle >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
            out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def prefixes(shingle: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Each text's number n of distinct shingles, and its n - ceil(SIMILARITY * n) + 1 smallest shingle hashes (their low 32 bits).

    Sets with a Jaccard similarity of at least SIMILARITY share ceil(SIMILARITY * n) elements or more of
    either one, which do not all fit behind both prefixes: the smallest shared element is in both.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    sizes = np.bincount(owner, minlength=len(counts))
    lengths = sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(np.int64) + 1
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = shingle[rank < np.repeat(lengths, sizes)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return sizes.astype(np.int32), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept.astype(np.uint32).view(np.int32)))


def with_simhash(passages: DataFrame) -> DataFrame:
    """``passages(key, folded, kind, role)`` with their ``sim``, and ``shingles`` and ``prefix`` as in `prefixes`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = hashed_shingles(batch.column(1).to_pylist())
            sizes, prefix = prefixes(*hashed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_simhashes(*hashed)), pa.array(sizes), prefix], [*batch.schema.names, "sim", "shingles", "prefix"])

    return passages.mapInArrow(split, "key long, folded string, kind string, role int, sim long, shingles int, prefix array<int>")


def with_prefix(frontier: DataFrame) -> DataFrame:
    """``(seed, seed_shingles, token)``: the prefixes of ``frontier(key, folded)``, one row per hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefix = prefixes(*hashed_shingles(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), prefix], ["seed", "seed_shingles", "prefix"])

    rows = frontier.select("key", "folded").mapInArrow(split, "seed long, seed_shingles int, prefix array<int>")
    return rows.select("seed", "seed_shingles", F.explode("prefix").alias("token"))


def table_entries(sim: Column) -> Column:
    """The entries of a hash in all tables as whole numbers, the table's number in the upper half."""
    width = -(-64 // BLOCKS)
    block = [F.shiftrightunsigned(sim, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    return F.array(
        *[F.shiftleft(block[a], width).bitwiseOR(block[b]).bitwiseOR(F.lit(n << 32)) for n, (a, b) in enumerate(combinations(range(BLOCKS), KEPT))]
    )


def _shingles(text: Column) -> Column:
    words = F.split(text, " ")
    many = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(WORDS))))
    return F.array_distinct(F.when(F.size(words) > WORDS, many).otherwise(F.array(text)))


def near_pairs(frontier: DataFrame, others: DataFrame, small: bool) -> DataFrame:
    """``(key, seed)``: the rows of ``others`` (as `with_simhash` gives them) near some row of ``frontier(key, folded, sim)``.

    Only hashes and keys meet in the tables and prefixes; the texts of the few pairs left are fetched to verify them.
    """
    entries = frontier.select(F.col("key").alias("seed"), F.col("sim").alias("seed_sim"), F.explode(table_entries(F.col("sim"))).alias("entry"))
    rows = others.select("key", "sim", F.explode(table_entries(F.col("sim"))).alias("entry"))
    near = rows.join(F.broadcast(entries) if small else entries, "entry")
    near = near.where(F.bit_count(F.col("sim").bitwiseXOR(F.col("seed_sim"))) <= HAMMING).select("key", "seed")
    tokens = with_prefix(frontier)
    sharing = others.select("key", "shingles", F.explode("prefix").alias("token")).join(F.broadcast(tokens) if small else tokens, "token")
    sized = (F.col("shingles") >= SIMILARITY * F.col("seed_shingles") - 1e-9) & (F.col("seed_shingles") >= SIMILARITY * F.col("shingles") - 1e-9)
    near = near.union(sharing.where(sized).select("key", "seed")).distinct()
    texts = near.join(others.select("key", "folded"), "key").join(frontier.select(F.col("key").alias("seed"), F.col("folded").alias("seed_text")), "seed")
    a, b = _shingles(F.col("folded")), _shingles(F.col("seed_text"))
    both = F.size(F.array_intersect(a, b))
    return texts.where(both >= SIMILARITY * (F.size(a) + F.size(b) - both) - 1e-9).select("key", "seed")


def neighbours(frontier: DataFrame, passages: DataFrame, small: bool) -> DataFrame:
    """``(key, kind)`` of the unlabelled open ``passages`` near some passage of ``frontier(key, folded, kind, sim)``."""
    pairs = near_pairs(frontier, passages.where(F.col("kind").isNull() & (F.col("role") <= OPEN)), small)
    return pairs.join(frontier.select(F.col("key").alias("seed"), "kind"), "seed").groupBy("key").agg(F.min("kind").alias("kind"))


def _size(frontier: DataFrame) -> tuple[int, bool]:
    """How many rows there are, and whether they may be broadcast."""
    count, words = frontier.select(F.count("*"), F.sum(F.size(F.split("folded", " ")))).first()
    return count, count <= BROADCAST_ROWS and (words or 0) <= BROADCAST_WORDS


def spread_notices(passages: DataFrame) -> DataFrame:
    """``(key, kind)``: the passages labelled by rules, and those that near-duplicates lead to from the notices among them."""
    labelled = passages.where(F.col("kind").isNotNull()).select("key", "kind")
    # A passage like one with an unfilled field may have that field filled: these labels do not spread.
    frontier = passages.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*rules.UNFILLED)).select("key", "folded", "kind", "sim")
    rest = passages
    while True:
        count, small = _size(frontier)
        if not count:
            return labelled
        found = neighbours(frontier, rest, small)
        frontier = durable(found.join(rest.select("key", "folded", "sim"), "key").select("key", "folded", "kind", "sim"))
        labelled = labelled.unionByName(frontier.select("key", "kind"))
        # One anti-join whatever the round: the lineage of `rest` does not grow.
        rest = passages.join(labelled.select("key"), "key", "left_anti")


def resolve_suspects(passages: DataFrame) -> DataFrame:
    """``(key, kind)``: the frames with an ambiguous mark that are near-duplicates of a frame with a value."""
    suspects = passages.where(F.col("role") == SUSPECT).select("key", "folded", "sim")
    count, small = _size(suspects)
    pairs = near_pairs(suspects, passages.where(F.col("role") == FILLED if count else F.lit(False)), small)
    return pairs.select(F.col("seed").alias("key")).distinct().withColumn("kind", F.lit("value"))


def spread_filler(passages: DataFrame) -> DataFrame:
    """``(key, kind)``: the open passages made of filler words, which are learned from those that hold the public ones."""
    spaced = F.translate(F.lower("folded"), _MARKS, " " * len(_MARKS))
    words = F.array_distinct(F.filter(F.split(spaced, " "), lambda w: F.length(w) >= 3)).alias("words")
    open_ones = passages.where(F.col("kind").isNull() & (F.col("role") <= OPEN))
    held = F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in sorted(rules.FILLER_WORDS)])))
    labelled = durable(open_ones.where(F.col("role") == LATIN).select("key", words).where((held >= 2) & (held >= SEED_SHARE * F.size("words"))))
    if labelled.isEmpty():
        return labelled.select("key").withColumn("kind", F.lit("filler"))
    open_ones = written(open_ones.select("key", words), "words")
    flat = open_ones.select("key", F.size("words").alias("n"), F.explode("words").alias("word"))
    first, known = labelled, 0
    while True:
        size, listed = labelled.select(F.count("*"), F.sum(F.size("words"))).first()
        if size == known:
            break
        known, few = size, listed <= BROADCAST_VOCABULARY
        inside = labelled.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("inside")).where(F.col("inside") >= WORD_PASSAGES)
        counts = flat.join(F.broadcast(inside) if few else inside, "word").groupBy("word", "inside").agg(F.count("*").alias("n"))
        vocabulary = counts.where(F.col("inside") >= WORD_SHARE * F.col("n")).select("word")
        hits = flat.join(F.broadcast(vocabulary) if few else vocabulary, "word").groupBy("key", "n").agg(F.count("*").alias("hits"))
        hit = hits.where((F.col("hits") >= 2) & (F.col("hits") >= PASSAGE_SHARE * F.col("n"))).select("key")
        labelled = durable(open_ones.join(first.select("key").unionByName(hit).distinct(), "key", "left_semi"))
    return labelled.select("key").withColumn("kind", F.lit("filler"))


def find_residue(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """``(key, kinds, by_rule)``: the documents that hold residue anywhere, the kinds found, and whether rules alone find it.

    Null, empty and blank texts hold none; neither do texts that only explain, quote or show such terms as
    code. Rows of equal key count as one document; a null key is left out. Texts are read whole. An empty
    table gives no rows. Other columns are not read.
    """
    extracted = written(extract(df, key, text), "residue")
    distinct = extracted.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("folded").alias("folded"), F.min("kind").alias("kind"), F.max("role").alias("role"))
    passages = written(with_simhash(distinct), "passages")
    ruled = passages.where(F.col("kind").isNotNull()).select(F.col("key"), F.lit(True).alias("by_rule")).distinct()
    labelled = spread_notices(passages).unionByName(resolve_suspects(passages)).unionByName(spread_filler(passages))
    labelled = labelled.join(ruled, "key", "left").select("key", "kind", F.coalesce("by_rule", F.lit(False)).alias("by_rule"))
    held = extracted.where(F.col("doc").isNotNull()).select("doc", F.explode("keys").alias("key"))
    hit = held.join(labelled, "key")
    return hit.groupBy("doc").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.max("by_rule").alias("by_rule")).withColumnRenamed("doc", key)
