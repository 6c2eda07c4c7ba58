import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import closure, heavy_keys, packed, references, rolling, snapshots

T = lambda day, hour=0: dt.datetime(2025, 1, day, hour)
KW = {"record": "rid", "at": "at", "ref_id": "fk", "ref_name": "fname", "parent": ("id", "name", "since"), "removal": ("id", "name", "gone")}
REFS, PARENTS, REMOVALS = "rid long, at timestamp_ntz, fk long, fname string, key string, salt string", "id long, name string, since timestamp_ntz, known string", "id long, name string, gone timestamp_ntz, extra int"


def orphans(spark, refs, parents, removals=()):
    found = references.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(list(removals), REMOVALS), **KW)
    return {r.rid: r.reason for r in found.collect()}


def ref(rid, at=T(10), fk=None, name=None):
    return (rid, at, fk, name, "k", "s")


def test_orphans_reasons_and_keys(spark):
    parents = [(1, "Alpha_one", T(5), "x"), (1, None, T(3), "x"), (2, "beta", T(20), "x"), (3, "gamma", None, "x"), (4, None, T(1), "x")]
    refs = [
        ref(1, fk=1, name="nothing"), ref(2, name=" ALPHA-ONE ^1.0"), ref(3, fk=2), ref(4, fk=9, name="beta"), ref(5, name="who"), ref(6),
        ref(7, name="  \t "), ref(8, fk=3), ref(9, at=T(2), name="alpha_One"), ref(10, fk=4), ref(11, at=T(12), fk=4), ref(12, name="delta"), ref(13, at=None, fk=77), ref(14, at=None, fk=2),
    ]
    removals = [(4, "d4", T(11), 0), (5, "Delta", T(1), 0), (None, None, T(1), 0)]
    assert orphans(spark, refs, parents, removals) == {3: "later", 4: "missing", 5: "missing", 9: "later", 11: "removed", 12: "missing", 13: "missing"}


def test_orphans_repeated_records_count_by_their_earliest_row(spark):
    parents = [(1, "a", T(5), "x")]
    refs = [ref(1, T(9), 1), ref(1, T(2), 1), ref(2, T(9), 7), ref(2, T(8), 1), ref(3, T(9), 7), ref(3, T(9), 7)]
    assert orphans(spark, refs, parents) == {1: "later", 3: "missing"}


def test_orphans_empty_tables(spark):
    assert orphans(spark, [], []) == {}
    assert orphans(spark, [ref(1, fk=1), ref(2)], []) == {1: "missing"}
    assert orphans(spark, [], [(1, "a", T(1), "x")]) == {}


def test_orphans_hot_key_and_long_name(spark):
    refs = [ref(i, name="hot") for i in range(3000)] + [ref(10_000, name="x" * 200_000), ref(10_001, fk=1)]
    found = orphans(spark, refs, [(1, "a", T(1), "x")])
    assert len(found) == 3001 and 10_001 not in found


def test_report(spark, rows):
    found = references.orphan_references(spark.createDataFrame([ref(1, fk=5), ref(2, fk=5), ref(3, name="q")], REFS), spark.createDataFrame([], PARENTS), spark.createDataFrame([], REMOVALS), **KW)
    assert rows(references.orphan_report(found, "refs", "at")) == [("refs", "2025-01", "missing", 3, 2)]


CASES = {
    "MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "MIT/Apache-2.0": ["MIT", "Apache-2.0"],
    '"Quay ""Blue"" Notice" and/or MIT': ['Quay "Blue" Notice', "MIT"],
    '["BSD","Kelp, Reed and Rush"]': ["BSD", "Kelp, Reed and Rush"],
    "'Oriel Licence, version 2' | ISC": ["Oriel Licence, version 2", "ISC"],
    "Miller's-Wheel-1.0 AND AND-gate-1.0": ["Miller's-Wheel-1.0", "AND-gate-1.0"],
    "LGPL-2.1+ + Zlib": ["LGPL-2.1+", "Zlib"],
    "GPL-3.0 WITH X-exception, MIT": ["GPL-3.0 WITH X-exception", "MIT"],
    "MIT OR\tMIT": ["MIT", "MIT"],
    "(MIT AND (A; B))": ["MIT", "A", "B"],
    "Lantern Public License 3": ["Lantern Public License 3"],
    ",;MIT\n\n/": ["MIT"],
    "tollgate-or-later": ["tollgate-or-later"],
    '"a, b': ["a", "b"],
    "é-lic/ñ": ["é-lic", "ñ"],
    "": [], "   ": [], "and/or": [], '""': [], None: [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_packed_values(text):
    assert split_one([text])[0] == CASES[text]
    if text is not None:
        assert packed.lex(text) == CASES[text]


def split_one(texts):
    lists, odd = packed.split_array(pa.array(texts, pa.string()))
    return lists.to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["MIT", "a", "or", "AND", " ", "\t", "\n", "-", ".", "'", '"', "+", "/", ",", "(", '""', "''", "2.0", "ö", "Miller's"]), max_size=9).map("".join), max_size=20))
def test_scan_agrees_with_lexer(texts):
    assert split_one(texts) == [packed.lex(t) for t in texts]


def test_scan_of_a_slice_and_of_long_texts():
    texts = ["x/y", "long " * 50_000 + "/ MIT", None, "a or b"]
    whole = pa.array(["skipped", *texts])
    assert packed.split_array(whole.slice(1))[0].to_pylist() == [["x", "y"], [("long " * 50_000).strip(), "MIT"], [], ["a", "b"]]


def test_packed_table(spark, rows):
    data = [(1, "MIT/ISC", "z"), (1, "MIT/ISC", "y"), (2, None, "z"), (3, "", "z"), (4, "MIT", "z"), (None, "a/b", "z"), (5, " \n", "z")]
    df = spark.createDataFrame(data, "id long, lic string, pos string")
    assert rows(packed.split_packed(df, key="id", field="lic", at_least=2)) == [(1, 1, "MIT"), (1, 2, "ISC"), (None, 1, "a"), (None, 2, "b")]
    assert packed.split_packed(df.limit(0), key="id", field="lic").collect() == []


def test_snapshots(spark, rows):
    data = [("d1", 1, 5, True), ("d1", 1, 5, True), ("d1", 2, None, None), ("d1", 3, 1, True), ("d1", None, 1, True), ("d2", 1, 5, True), ("d2", 2, None, True), ("d2", 4, 1, None), (None, 9, 9, None), ("d3", 3, 1, True), ("d3", 1, None, True), ("d3", 2, None, True), ("d3", 4, 1, None)]
    df = spark.createDataFrame(data, "snap string, id long, n long, flag boolean")
    for buckets in (1, 2, 7):
        found = snapshots.diff_snapshots(df, snapshot="snap", key="id", compare=["n", "flag"], buckets=buckets)
        assert rows(found) == [("d2", 2, "changed"), ("d2", 3, "removed"), ("d2", 4, "added"), ("d3", 1, "changed"), ("d3", 3, "added")]
    values = snapshots.with_values(found, df, snapshot="snap", key="id", fields=["n", "flag"])
    assert ("d2", 3, "removed", None, None) in rows(values) and ("d3", 3, "added", 1, True) in rows(values)
    assert snapshots.diff_snapshots(df.where("snap = 'd1'"), snapshot="snap", key="id", compare=["n"]).collect() == []
    assert snapshots.diff_snapshots(df.limit(0), snapshot="snap", key="id", compare=["n"]).collect() == []


def test_fifteen_hundred_snapshots(spark, monkeypatch):
    random.seed(8)
    held, data, want = {}, [], set()
    for at in range(1500):
        before = dict(held)
        for _ in range(3):
            key = random.randrange(12)
            if random.random() < 0.3:
                held.pop(key, None)
            else:
                held[key] = random.choice([None, 1, 2])
        held[99] = 0
        data += [(at, k, v, "x", 1) for k, v in held.items()] * (2 if at % 7 == 0 else 1)
        if at:
            want |= {(at, k, "added") for k in held.keys() - before.keys()} | {(at, k, "removed") for k in before.keys() - held.keys()}
            want |= {(at, k, "changed") for k in held.keys() & before.keys() if held[k] != before[k]}
    df = spark.createDataFrame(data, "snap int, id long, n long, hash string, at int")
    for limit in (snapshots.BROADCAST_SERIES, 10):
        monkeypatch.setattr(snapshots, "BROADCAST_SERIES", limit)
        found = snapshots.diff_snapshots(df, snapshot="snap", key="id", compare=["n"])
        assert {tuple(r) for r in found.collect()} == want


def test_snapshot_missing_from_a_bucket(spark, rows):
    df = spark.createDataFrame([("a", i, 1) for i in range(50)] + [("c", i, 1) for i in range(50)] + [("b", 7, 1)], "s string, k long, v int")
    found = rows(snapshots.diff_snapshots(df, snapshot="s", key="k", compare=["v"], buckets=5))
    assert len(found) == 98 and ("b", 0, "removed") in found and ("c", 0, "added") in found


def test_compare_sorted_random():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = {int(k): int(v) for k, v in zip(rng.integers(0, 40, 25), rng.integers(0, 3, 25), strict=True)}
        b = {int(k): int(v) for k, v in zip(rng.integers(0, 40, 25), rng.integers(0, 3, 25), strict=True)}
        arrays = [snapshots.unique_sorted(np.zeros(len(d), np.int32), np.array(list(d), np.int64), np.array(list(d.values()), np.int64))[1:] for d in (a, b)]
        keys, codes = snapshots.compare_sorted(*arrays)
        want = {k: "added" for k in b.keys() - a} | {k: "removed" for k in a.keys() - b} | {k: "changed" for k in a.keys() & b if a[k] != b[k]}
        assert {int(k): snapshots.CHANGES[c] for k, c in zip(keys, codes, strict=True)} == want


def test_key_totals(spark, rows, monkeypatch):
    data = [("a", 1, "x")] * 500 + [("b", None, "x"), ("", 2, "x"), (None, 3, "x"), ("c" * 10_000, -4, "x")]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, v long, rows string")
    want = [("", 1, 2), ("a", 500, 500), ("b", 1, 0), ("c" * 10_000, 1, -4), (None, 1, 3)]
    assert rows(heavy_keys.key_totals(df, "k", "v")) == sorted(want, key=repr)
    assert rows(heavy_keys.heavy_keys(df, "k", 0.02)) == [("a", 500, 0)]
    assert heavy_keys.key_totals(df.limit(0), "k").collect() == [] and heavy_keys.heavy_keys(df.limit(0), "k", 0.1).collect() == []


def test_dense_sums_unite_and_flush(spark, rows, monkeypatch):
    held = heavy_keys.DenseSums()
    held.add(pa.array([str(i) for i in range(5000)] + ["7"]), pa.array([1] * 5001))
    batch = held.take()
    assert batch.num_rows == 5000 and sum(batch.column(1).to_pylist()) == 5001 and held.parts == []
    monkeypatch.setattr(heavy_keys, "GATHER_KEYS", 7)
    for number in range(30):
        held.add(pa.array(["a", None, str(number % 11), "a"]), pa.array([1, None, 2, 3]) if number % 2 else None)
    assert len(held.parts) < 5 and not held.full
    monkeypatch.setattr(heavy_keys, "FLUSH_BYTES", 1)
    assert held.full
    totals = dict(zip(*[c.to_pylist() for c in held.take().columns[:2]], strict=True))
    assert totals["a"] == 60 and totals[None] == 30 and totals["3"] == 3 and len(totals) == 13
    df = spark.range(4000).selectExpr("concat('k', id % 1500) AS k", "id AS v")
    assert rows(heavy_keys.key_totals(df, "k", "v")) == sorted([(f"k{i}", len(range(i, 4000, 1500)), sum(range(i, 4000, 1500))) for i in range(1500)], key=repr)


def test_rolling(spark):
    day = lambda d: dt.date(2025, 1, 1) + dt.timedelta(days=d)
    random.seed(2)
    data = [(v, day(random.randint(0, 50)), random.choice([None, 0, 0, 5, 9]), T(1 + random.randint(0, 5)), f"c{v % 3}" if v % 7 else None, "e") for v in range(60) for _ in range(3)]
    df = spark.createDataFrame(data, "vid long, d date, n long, at timestamp_ntz, name string, entity string")
    latest = rolling.latest_rows(df, ["vid", "d"], "at", "n", "name")
    got = {(r.entity, r.day): (r.total, r.total_7, r.total_30, round(r.average_7, 9)) for r in rolling.rolling_totals(rolling.daily_totals(latest, entity="name", day="d", value="n")).collect()}
    best = {}
    for v, d, n, at, name, _ in data:
        if (v, d) not in best or (at, -1 if n is None else n) > best[v, d][0]:
            best[v, d] = ((at, -1 if n is None else n), n or 0, name)
    daily = {}
    for (_, d), (_, n, name) in best.items():
        if name:
            daily.setdefault(name, {}).setdefault(d, 0)
            daily[name][d] += n
    want = {}
    for name, days in daily.items():
        d = min(days)
        while d <= max(days):
            total = lambda w, d=d, days=days: sum(days.get(d - dt.timedelta(days=k), 0) for k in range(w))
            want[name, d] = (total(1), total(7), total(30), round(total(7) / 7, 9))
            d += dt.timedelta(days=1)
    assert got == want
    assert rolling.rolling_totals(rolling.daily_totals(df.limit(0), entity="name", day="d", value="n")).collect() == []


def test_columns_that_clash_by_case_or_name(spark, rows):
    df = spark.createDataFrame([(1, "MIT/ISC", "no", "no")], "id long, lic string, LIC string, Id string")
    assert rows(packed.split_packed(df, key="id", field="lic")) == [(1, 1, "MIT"), (1, 2, "ISC")]
    twins = spark.createDataFrame([("a", 1, "x")], ["k", "v", "k2"]).toDF("k", "v", "k")
    assert rows(heavy_keys.key_totals(twins, "k", "v")) == [("a", 1, 1)]


def test_closure_with_cycle(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("a", "b")], "source string, target string")
    starts = spark.createDataFrame([("a",), (None,)], "node string")
    assert rows(closure.reachable(edges, starts)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(closure.reachable(edges, starts, max_depth=1)) == [("a", 0), ("b", 1)]
    assert closure.reachable(edges, starts.limit(0)).collect() == []
