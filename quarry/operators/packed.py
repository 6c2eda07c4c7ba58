"""Several values packed in one text field.

Arrow string buffers are scanned as byte arrays: quote parity, delimiter and word masks give the value
boundaries of a whole batch at once, from which the child offsets of a list array are derived and
flattened with the parents' ordinals. Texts whose quotes the masks cannot settle (an unpaired quote, a
quote in the middle of a name, letters outside ASCII) are read by an exact character-wise lexer instead.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact

BLANK, BREAK, SOFT, QUOTE, SEPARATOR, NAME = range(6)


def _classes() -> np.ndarray:
    kinds = np.full(256, SEPARATOR, np.uint8)
    for byte in range(256):
        if chr(byte).isalnum() and byte < 128:
            kinds[byte] = NAME
    for chars, kind in ((" \t", BLANK), ("\n\r\v\f\x1c\x1d\x1e", BREAK), ("-.+", SOFT), ("'\"", QUOTE), ("\0", BLANK)):
        kinds[np.frombuffer(chars.encode(), np.uint8)] = kind
    return kinds


CLASSES = _classes()


def _is_name(char: str) -> bool:
    return char.isalnum() or (ord(char) > 127 and unicodedata.category(char)[0] == "M")


def lex(text: str) -> list[str]:
    """The values of one text, character by character: the exact rule the vectorised scan agrees with.

    Values are separated by punctuation, line breaks or the words and/or; ``- . ' +`` inside or directly
    behind a name belong to it, as do blanks. A quote opening at the start of a value ends at its partner;
    within it nothing separates, a doubled quote stands for one, and an apostrophe between letters is no
    partner. A quote without partner is punctuation.
    What follows a closing quote directly is a value of its own. Empty values are dropped.
    """
    values: list[str] = []
    start = -1  # of the open value
    end = -1  # behind its last name character
    word = -1  # start of the current unbroken run
    n = len(text)

    def close() -> None:
        nonlocal start
        if start >= 0:
            values.append(text[start:end])
        start = -1

    def close_word(at: int) -> None:
        """Drop the run that ends at ``at`` if it is a separating word."""
        nonlocal start, end, word
        if word >= 0 and text[word:at].lower() in ("and", "or"):
            if start < word:
                end = len(text[start:word].rstrip()) + start
                close()
            start = -1
        word = -1

    i = 0
    while i < n:
        char = text[i]
        if _is_name(char) or (char in "-.+'" and word >= 0):
            if word < 0:
                word = i
            if start < 0:
                start = i
            i += 1
            end = i
            continue
        close_word(i)
        if char in "\"'" and start < 0:
            j = i + 1
            while j < n:
                if text[j] == char:
                    if text[j + 1 : j + 2] == char:
                        j += 1
                    elif char == '"' or not (_is_name(text[j - 1]) and _is_name(text[j + 1 : j + 2] or " ")):
                        break
                j += 1
            if j < n:
                values.append(text[i + 1 : j].replace(char * 2, char).strip())
                i = j + 1
                continue
        if not (char.isspace() and char not in "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029") and char != "\0":
            close()
        i += 1
    close_word(n)
    close()
    return [v for v in values if v]


def _last_true(mask: np.ndarray) -> np.ndarray:
    """Index of the last true entry before each position, -1 for none."""
    at = np.where(mask, np.arange(len(mask)), -1)
    out = np.empty(len(mask), np.int64)
    out[0] = -1
    np.maximum.accumulate(at[:-1], out=out[1:])
    return out


def split_array(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """A list array with the values of each text (null texts give empty lists), and which rows the exact lexer read."""
    texts = texts.cast(pa.string())
    n_rows = len(texts)
    if n_rows == 0:
        return pa.array([], pa.list_(pa.string())), np.zeros(0, bool)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n_rows + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # One break byte behind every row keeps rows apart without any per-row test.
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n_rows), lengths + 1)
    place = np.arange(len(data)) + np.repeat(np.arange(n_rows), lengths)
    raw = np.full(len(row), 10, np.uint8)
    raw[place] = data
    n = len(raw)
    kind = CLASSES[raw]
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(lengths + 1, out=first[1:])

    odd_row = np.zeros(n_rows, bool)
    odd_row[row[raw > 127]] = True

    # Double quotes: parity inside the row.
    is_double = raw == 34
    count = np.cumsum(is_double)
    before_row = np.concatenate([[0], count])[first[:-1]]
    parity = (count - before_row[row]) & 1
    in_double = (parity == 1) | is_double
    odd_row |= parity[first[1:] - 1] == 1
    # Single quotes outside those: one that opens follows no name, one that closes precedes none.
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kind[1:], BREAK
    ahead = np.empty(n, np.uint8)
    ahead[1:], ahead[0] = kind[:-1], BREAK
    single = (raw == 39) & ~in_double
    opens = single & (ahead != NAME) & (ahead != SOFT)
    closes = single & ~opens & (after != NAME) & (after != SOFT)
    edge = opens | closes
    step = np.cumsum(opens.astype(np.int64) - closes)
    depth = step - np.concatenate([[0], step])[first[:-1]][row]
    odd_row[row[edge & ((depth < 0) | (depth > 1))]] = True
    # Doubled or empty single quotes, and single quotes beside soft marks.
    odd_row[row[(raw == 39) & ((after == QUOTE) | (after == SOFT) | (ahead == SOFT))]] = True
    odd_row |= depth[first[1:] - 1] != 0
    in_single = ((depth == 1) | closes) & ~in_double
    odd_row[row[(depth == 1) & is_double]] = True
    quoted = in_double | in_single
    quoted[first[1:] - 1] = False

    # Unquoted name characters; soft marks belong to the run they directly follow.
    plain = ~quoted
    soft = plain & ((kind == SOFT) | single)
    anchor = _last_true(~soft)
    named = plain & (kind == NAME)
    named |= soft & (anchor >= 0) & named[np.maximum(anchor, 0)] & (row[np.maximum(anchor, 0)] == row)
    starts = named.copy()
    starts[1:] &= ~named[:-1]
    ends = named.copy()
    ends[:-1] &= ~named[1:]
    run_from, run_to = np.flatnonzero(starts), np.flatnonzero(ends)
    size = run_to - run_from + 1
    low = raw | 32
    letter = lambda k: low[np.minimum(run_from + k, n - 1)]
    joins = ((size == 2) & (letter(0) == ord("o")) & (letter(1) == ord("r"))) | (
        (size == 3) & (letter(0) == ord("a")) & (letter(1) == ord("n")) & (letter(2) == ord("d"))
    )
    for k in range(3):
        at = run_from[joins & (size > k)] + k
        named[at] = False
    content = named | quoted
    separates = ~content & (kind != BLANK)
    for k in range(3):
        separates[run_from[joins & (size > k)] + k] = True

    # A value starts at content that has a separator, or no content, between it and the content before.
    passed = np.cumsum(separates)
    previous = _last_true(content)
    held = np.maximum(previous, 0)
    begins = content & ((previous < 0) | (passed != passed[held]))
    open_double = is_double & (parity == 1)
    doubled = np.zeros(n, bool)
    doubled[1:] = open_double[1:] & is_double[:-1] & (parity[:-1] == 0) & (row[1:] == row[:-1])
    # ``""`` that opens a value is an empty quote, unless parity says the quote before closed a longer one.
    opener = (open_double & ~doubled) | opens
    odd_row[row[opener & ~begins]] = True
    closer = (is_double & (parity == 0)) | closes
    closer[:-1] &= ~doubled[1:]
    odd_row[row[content & ~begins & (previous >= 0) & closer[held] & (row[held] == row)]] = True

    value_from = np.flatnonzero(begins)
    last = np.flatnonzero(content)
    if len(value_from):
        stop = np.append(value_from[1:], n)
        value_to = last[np.searchsorted(last, stop) - 1] + 1
    else:
        value_to = value_from
    is_quote = quoted[value_from] if len(value_from) else np.zeros(0, bool)
    inner_from, inner_to = value_from + is_quote, value_to - is_quote
    keep_row = ~odd_row
    # Trim blanks inside quotes by the nearest other byte.
    ink = (kind != BLANK) & (kind != BREAK)
    inked = np.concatenate([[0], np.cumsum(ink)])
    filled = inked[np.maximum(inner_to, inner_from)] > inked[inner_from]
    ok = keep_row[row[value_from]] & filled if len(value_from) else np.zeros(0, bool)
    inner_from, inner_to, owner = inner_from[ok], inner_to[ok], row[value_from][ok]
    ink_at = np.flatnonzero(ink)
    if len(inner_from):
        inner_from = ink_at[np.searchsorted(ink_at, inner_from)]
        inner_to = ink_at[np.searchsorted(ink_at, inner_to) - 1] + 1
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, inner_from, 1)
    np.add.at(mark, inner_to, -1)
    kept = np.cumsum(mark[:-1]) > 0
    kept &= ~doubled
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    sizes = kept_before[inner_to] - kept_before[inner_from]
    child_offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    body = np.ascontiguousarray(raw[kept])
    values = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(child_offsets.tobytes()), pa.py_buffer(body.tobytes()))
    per_row = np.bincount(owner, minlength=n_rows)

    exact = np.flatnonzero(odd_row)
    if len(exact):
        lists = [lex(t) for t in texts.take(pa.array(exact)).to_pylist()]
        extra = pa.array([v for vs in lists for v in vs], pa.string())
        extra_owner = np.repeat(exact, [len(vs) for vs in lists])
        order = np.argsort(np.concatenate([owner, extra_owner]), kind="stable")
        values = pa.concat_arrays([values, extra]).take(pa.array(order))
        per_row = per_row + np.bincount(extra_owner, minlength=n_rows)
    list_offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets), values), odd_row


def split_packed(df: DataFrame, *, key: str, field: str, at_least: int = 1) -> DataFrame:
    """``(key, pos, item)``: one row per value of ``field``, ``pos`` counting from 1 in reading order.

    ``key`` must be an integer. Rows of equal key count once (with the smallest non-null text where they
    disagree). Keys with fewer than ``at_least`` values give no rows; so do null, empty and blank texts.
    A null key is one key of its own. The same value may come out twice. Texts of any length are read
    whole. Other columns are not read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, _ = split_array(batch.column(1))
            sizes = np.diff(np.asarray(lists.offsets))
            parent = np.repeat(np.arange(len(sizes)), sizes)  # the values' parent ordinals
            pos = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            wanted = sizes[parent] >= at_least
            items = lists.values.slice(int(np.asarray(lists.offsets)[0]), len(parent)).filter(pa.array(wanted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(parent[wanted])), pa.array(pos[wanted].astype(np.int32)), items], ["key", "pos", "item"]
            )

    rows = exact(df, key, field).select(F.col(key).cast("long").alias("key"), F.col(field).alias("text")).groupBy("key").agg(F.min("text").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    return rows.mapInArrow(split, "key long, pos int, item string").select(F.col("key").alias(key), "pos", "item")
