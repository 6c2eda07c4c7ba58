import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import distinct, topn

DIMS, IDS = ["kind", "optional"], ["a", "b"]


def frame(spark, data):
    return spark.createDataFrame(data, "at timestamp_ntz, kind int, optional boolean, a long, b string, hash string, m0 int")


def brute(data, key):
    out = {}
    for at, kind, optional, a, b, *_ in data:
        for tk in (False, True):
            for to in (False, True):
                cell = (key(at), tk, None if tk else kind, to, None if to else optional)
                sets = out.setdefault(cell, (set(), set()))
                if a is not None:
                    sets[0].add(a)
                if b is not None:
                    sets[1].add(b)
    return {k: (len(x), len(y)) for k, (x, y) in out.items() if x or y}


def counted(state, groups):
    return {(r.period, r.all_kind, r.kind, r.all_optional, r.optional): (r["as"], r.bs) for r in distinct.counts(state, ids=IDS, groups=groups).collect()}


def test_counts_merge_and_coarsen(spark):
    random.seed(4)
    pick = random.choice
    data = [(pick([None, dt.datetime(2025, 1, 30), dt.datetime(2025, 1, 31, 5), dt.datetime(2025, 2, 1)]), pick([0, 1, 2, None]), pick([True, False, None]), pick([None, *range(12)]), pick([None, "", "x", "y" * 50_000, "z"]), "h", 1) for _ in range(400)]
    df = frame(spark, data * 2)
    groups = distinct.number_groups(df, DIMS)
    make = lambda rows: distinct.partials(frame(spark, rows), at="at", ids=IDS, groups=groups)
    day = lambda t: t and t.date()
    assert counted(make(data * 2), groups) == brute(data, day)
    assert counted(distinct.merge(make(data[:150]), make(data[150:])), groups) == brute(data, day)
    months = distinct.merge(make(data), period=F.trunc("period", "month"))
    assert counted(months, groups) == brute(data, lambda t: t and t.date().replace(day=1))


def test_many_cells_and_empty_table(spark):
    data = [(dt.datetime(2025, 1, 1), k, k % 2 == 0, i, None, "h", 1) for k in range(90) for i in range(k % 4)]
    df = frame(spark, data)
    groups = distinct.number_groups(df, DIMS)
    state = distinct.partials(df, at="at", ids=IDS, groups=groups)
    assert state.select("word").distinct().count() >= 2
    assert counted(state, groups) == brute(data, lambda t: t.date())
    empty = frame(spark, [])
    none = distinct.number_groups(empty, DIMS)
    assert none.labels.count() == 0 and counted(distinct.partials(empty, at="at", ids=IDS, groups=none), none) == {}


def test_thousands_of_cells_are_planned_at_once(spark, monkeypatch):
    data = [(dt.datetime(2025, 1, 1), k, [True, False, None][k % 3], i, str(k % 7), "h", 1) for k in range(2000) for i in (k % 5, k % 11)]
    df = frame(spark, data)
    for limit in (distinct.BROADCAST_GROUPS, 10):
        monkeypatch.setattr(distinct, "BROADCAST_GROUPS", limit)
        groups = distinct.number_groups(df, DIMS)
        assert groups.small == (limit > 10)
        state = distinct.partials(df, at="at", ids=IDS, groups=groups)
        assert counted(state, groups) == brute(data, lambda t: t.date())


def test_error_bound_is_not_rounded_away(spark):
    data = [(dt.datetime(2025, 1, 1), 0, True, i, f"b{i % 5}", "h", 1) for i in range(40)]
    df = frame(spark, data)
    groups = distinct.number_groups(df, DIMS)
    state = distinct.partials(df, at="at", ids=IDS, groups=groups)
    bounds = {r.error_bound for r in distinct.counts(state, ids=IDS, groups=groups).collect()}
    assert bounds == {40 * 40 / 2**65}


def top(spark, data, n=3):
    df = spark.createDataFrame(data, "id long, n long, lic string, name string, value string, rank int")
    found = topn.top_items(df, groups=["lic", "name"], item="id", score="n", n=n).collect()
    return sorted((r.group_field, r.group_value, r["rank"], r.id, r.n) for r in found)


def brute_top(data, n=3):
    groups = {}
    for i, score, lic, name, *_ in data:
        if i is None or score is None:
            continue
        for field, value in (("lic", lic), ("name", name)):
            if value is not None:
                best = groups.setdefault((field, value), {})
                best[i] = max(best.get(i, score), score)
    out = []
    for (field, value), items in groups.items():
        for rank, (i, score) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.append((field, value, rank, i, score))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [7, 200_000])
def test_top_items(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(topn, "SLICE_ROWS", slice_rows)
    random.seed(slice_rows)
    pick = random.choice
    data = [(pick([None, *range(60)]), pick([None, 0, 0, 1, 5, 5, -3, 2**60]), pick([None, "", "MIT", "MIT", "MIT", "x" * 30_000]), pick(["a", "b", None]), "v", 1) for _ in range(500)]
    assert top(spark, data * 2) == brute_top(data)
    assert top(spark, data, n=1) == brute_top(data, 1)
    assert top(spark, []) == []


def test_best_of_slice_bound():
    codes, items, scores = np.array([0, 0, 0, 0, 1]), np.array([4, 3, 3, 9, 1]), np.array([5, 5, 5, 7, 1])
    rows, low = topn.best_of_slice(codes, items, scores, 2)
    assert [(codes[r], items[r], scores[r]) for r in rows] == [(0, 9, 7), (0, 3, 5), (1, 1, 1)]
    assert items[low[0]] == 3 and scores[low[0]] == 5 and low[2] == -1
