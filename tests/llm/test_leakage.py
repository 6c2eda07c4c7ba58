import random

import numpy as np
import pytest

from quarry.llm import leakage as L

ITEM = "A brass clerk at Marton weighs 319 sacks of flax, and loses 683 on the western road. Then Ula divides salt."
W = ITEM.split()


def test_words_ignore_markup():
    plain = L.words(ITEM)
    forms = [
        ITEM.upper(), ITEM.replace(" ", "\n"), ITEM.replace(" ", "&nbsp;"), ITEM.replace(" ", " "), ITEM.replace("brass", "br­ass").replace("sacks", "sa⁠cks"),
        ITEM.replace("clerk", "[[clerk]]").replace("flax", "[[Fibre (page)|flax]]"), ITEM.replace("loses", "'''loses'''").replace("road", "''road''"),
        ITEM.replace("clerk", "clerk<ref>Some one, p. 7.</ref>").replace("sacks", "sacks<!-- check -->"), ITEM.replace("sacks", "<b>sacks</b><br />"), ITEM.replace("salt", 'salt<ref name="a" />'),
        "# " + ITEM.replace(" of ", "\n* of ").replace(" on ", "\n: on "), ITEM.replace("on the", "„on“ the…"), ITEM.replace("sacks", "[https://x.org/a sacks]"),
        '{| class="wikitable"\n|-\n| ' + ITEM.replace(" weighs", " || weighs").replace(" and", "\n|-\n| align=right | and") + "\n|}",
    ]
    for form in forms:
        assert L.words(form) == plain, form
    assert L.words("") == [] and L.words(" \n&nbsp; '' ") == []


def test_unclosed_note_ends_with_its_line():
    plain = L.words(ITEM)
    first = "Before <ref>A. Author, p. 7.</ref>it.\n"
    for note in ("<ref>Some one, p. 7.", "<ref name=\"a\">{{cite book", "<REF>x <!-- y\n -->", "<ref>a <ref>b"):
        assert L.words(first + "Flour" + note + "\n" + ITEM) == ["before", "it", "flour"] + plain, note
    assert L.words("<ref>one\ntwo</ref>" + ITEM + "<!-- open\n" + ITEM) == plain
    assert L.words("a<ref>one\n" * 20_000) == ["a"] * 20_000
    assert L.words("<!-- </ref> --><ref>one\n" + ITEM + "<ref>two</ref>") == []


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item long, ids string")
    i = spark.createDataFrame(items, "item_id long, text string, answer string")
    return sorted((r.doc_id, r.item_id, r.run, r.answer) for r in L.find_leaks(d, i, key="doc_id", text="text", item="item_id", item_text="text", answer="answer", **kw).collect())


def doc(number, text):
    return (number, text, 1, "x")


def test_runs_of_twelve_and_eleven(spark):
    filler = "the weir of Elton is known for ledgers and bells "
    eleven, twelve = " ".join(W[2:13]), " ".join(W[2:14])
    docs = [doc(1, filler + twelve + " and more"), doc(2, filler + eleven + " something else"), doc(3, None), doc(4, ""), doc(5, " \n "), doc(None, ITEM), doc(6, ITEM), doc(6, ITEM), doc(7, " ".join(W[2:9] + ["therefore"] + W[10:16])), doc(8, (filler * 20_000) + twelve.upper())]
    items = [(10, ITEM, "salt"), (11, "too short", None), (12, None, "A"), (None, ITEM, "A"), (13, "", "A")]
    assert found(spark, docs, items) == [(1, 10, 12, False), (6, 10, len(L.words(ITEM)), True), (8, 10, 12, False)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM, None)]) == [] and found(spark, [doc(1, ITEM)], []) == []
    with pytest.raises(ValueError):
        found(spark, [doc(1, ITEM)], [(1, ITEM, None)], min_run=8)


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_offset_and_many_items_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(L, "BROADCAST_ENTRIES", 0)
        monkeypatch.setattr(L, "BROADCAST_WORDS", 0)
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(10, 40))), None) for i in range(40)]
    docs = []
    for d in range(250):
        source = random.choice(items)[1].split()
        start = random.randint(0, max(0, len(source) - 8))
        piece = source[start : start + random.randint(8, 16)]
        docs.append(doc(d, " ".join(random.choices(vocabulary + ["zz"], k=random.randint(0, 30)) + piece + random.choices(vocabulary, k=random.randint(0, 9)))))
    want = []
    for d, text, *_ in docs:
        sequence = text.split()
        grams = {tuple(sequence[p : p + 12]) for p in range(len(sequence) - 11)}
        want += [(d, i) for i, t, _ in items if any(tuple(t.split()[p : p + 12]) in grams for p in range(len(t.split()) - 11))]
    assert len(want) > 20
    assert [x[:2] for x in found(spark, docs, items)] == sorted(want)


def test_sequence_measures():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 2, 3, 8, 4, 5, 5])
    assert L.longest_run(a, b) == 2 and L.common_subsequence(a, b) == 4
    assert L.longest_run(a, a) == 5 and L.common_subsequence(a, np.array([7])) == 0


def test_singular_directions_match_numpy(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "PIECE", 7)
    rng = np.random.default_rng(1)
    block = (rng.zipf(1.7, (400, L.BLOCK)) % 30).astype(np.int32)
    weight, place = np.zeros(L.DF_BUCKETS), np.full(L.DF_BUCKETS, 30, np.int32)
    weight[:30], place[:30] = rng.uniform(1, 3, 30), np.arange(30)
    basis = L.randomised_svd(spark.createDataFrame(pa.table({"block": L._listed(block)})).repartition(3), weight, place, 5)
    assert basis.shape == (31, 5) and not basis[30].any()
    matrix = np.zeros((400, 30))
    for k in range(L.BLOCK):
        np.add.at(matrix, (np.arange(400), block[:, k]), weight[block[:, k]])
    right = np.linalg.svd(matrix)[2][:5]
    assert np.linalg.norm(matrix @ basis[:30]) == pytest.approx(np.linalg.norm(matrix @ right.T), rel=1e-3)


def test_equal_words_have_equal_codes_in_any_batch():
    rng = np.random.default_rng(5)
    place = np.arange(L.DF_BUCKETS, dtype=np.int32) % 500
    space = L.Space(np.ones(L.DF_BUCKETS, np.float32), place, np.rint(rng.uniform(-L.SCALE, L.SCALE, (501, 64))).astype(np.float32))
    blocks = rng.integers(0, 10**6, (3000, L.BLOCK)).astype(np.int32)
    whole = space.codes(space.latent(blocks), L.TABLES)
    order = rng.permuted(blocks, axis=1)
    for at in range(0, 3000, 37):
        assert (space.codes(space.latent(order[at : at + 37]), L.TABLES) == whole[at : at + 37]).all()


def reworded(rng, words, every, vocabulary):
    """Every so many words another one, and here and there one word more or less."""
    out = []
    for n, w in enumerate(words):
        if n % every == every - 1:
            out.append(rng.choice(vocabulary))
            if rng.random() < 0.3:
                out.append(rng.choice(vocabulary))
        elif rng.random() > 0.02:
            out.append(w)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_planted_paraphrases_are_found(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(L, "BROADCAST_ENTRIES", 0)
        monkeypatch.setattr(L, "BROADCAST_WORDS", 0)
    rng = random.Random(17)
    vocabulary = [f"w{int(1500 * rng.random() ** 3)}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(50, 90))) + f" answer{i}", f"answer{i}") for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        around = [rng.choices(vocabulary, k=rng.randint(0, 300)) for _ in range(2)]
        middle = []
        if d % 3 == 0:
            i, text, _ = rng.choice(items)
            middle = reworded(rng, text.split(), rng.choice([4, 5, 7, 10]), vocabulary) + ([f"answer{i}"] if d % 2 else [])
            planted.add((d, i))
        docs.append(doc(d, " ".join(around[0] + middle + around[1])))
    d = spark.createDataFrame(docs, "doc_id long, text string, item long, ids string")
    i = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id): r for r in L.find_paraphrases(d, i, key="doc_id", text="text", item="item_id", item_text="text", answer="answer").collect()}
    sequences = {n: t.split() for n, t, *_ in docs}
    asked = {n: t.split() for n, t, _ in items}
    number = {w: n for n, w in enumerate({w for s in [*sequences.values(), *asked.values()] for w in s})}
    coded = lambda s: np.array([number[w] for w in s], np.int32)
    true = set()
    for a in sequences:
        for b in asked:
            part = L.likeliest_part(coded(asked[b]), coded(sequences[a]))
            share = L.common_subsequence(coded(asked[b]), part) / len(asked[b]) if len(part) else 0
            if share >= L.SURE or (share >= L.COMMON and number[f"answer{b}"] in part):
                true.add((a, b))
    assert len(true & planted) >= 0.5 * len(planted) and true <= planted | true
    assert set(got) <= true and len(got) >= 0.9 * len(true), (len(got), len(true), len(planted))
    assert any(r.run < 12 for r in got.values())
