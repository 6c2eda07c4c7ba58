import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import tokenize
from quarry.llm.queries import TOKENIZERS

RANKS, HF = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"), os.path.join(TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(HF)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return tokenize.encoder(RANKS)


SAMPLES = ["", " ", "\n", "Hello world", "it's we'll I'd 'S", "a\n\n b \n", "x \n y", "<|endoftext|>", "日本語 текст ñandú", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "1234567890 12,345.67", "tab\tand\r\nline", "👩‍🌾 é   x", "a\x1cb\x85c", "don''t…\n…x\n\n\n- y"]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(coder, public, text):
    assert coder.ids(text) == public(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeot \n'\t.19")), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    tokenizer = test_any_text.__dict__.setdefault("t", Tokenizer.from_file(HF))
    tokenizer.encode_special_tokens = True
    assert tokenize.encoder(RANKS).ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_border_rule_equals_merging(coder):
    vocabulary = coder.vocabulary
    random.seed(6)
    ids = list(vocabulary.bytes_of)
    for _ in range(3000):
        left, right = random.choice(ids[:3000] if random.random() < 0.7 else ids), random.choice(ids[:3000])
        if vocabulary.merged(vocabulary.bytes_of[left]) != [left] or vocabulary.merged(vocabulary.bytes_of[right]) != [right]:
            continue
        assert vocabulary.fit(left, right) == (vocabulary.merged(vocabulary.bytes_of[left] + vocabulary.bytes_of[right]) == [left, right])


def test_table_appends_and_edits(coder):
    random.seed(9)
    for _ in range(150):
        data = bytes(random.choices(b"abcdehinorst", k=random.randint(0, 14)))
        table = tokenize.PrefixTable(coder.vocabulary, data)
        assert table.ids() == coder.vocabulary.merged(data)
        more = bytes(random.choices(b"abcdehinorst", k=3))
        assert table.append(more).ids() == coder.vocabulary.merged(data + more)
        begin = random.randint(0, len(data))
        end = random.randint(begin, len(data) + 3)
        edited = (data + more)[:begin] + b"the" + (data + more)[end:]
        assert table.edit(begin, end, b"the").ids() == coder.vocabulary.merged(edited)


def test_full_caches_start_anew(public, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHED_BYTES", 500)
    monkeypatch.setattr(tokenize, "CACHED_PIECES", 5)
    small = tokenize.Encoder(tokenize.Vocabulary.load(RANKS))
    for text in SAMPLES * 2:
        assert small.ids(text) == public(text)


def test_documents(spark, public):
    long = "Rainfall averages 5 mm.\n" * 20_000
    data = [(1, "Hello\nworld", [7]), (2, "", [7]), (3, None, [7]), (None, "x", [7]), (5, long, [7]), (1, "Hello\nworld", [7])]
    df = spark.createDataFrame(data, "doc long, body string, ids array<int>")
    found = tokenize.encode_documents(df, key="doc", text="body", vocabulary=RANKS)
    assert found.dtypes == [("doc", "bigint"), ("ids", "array<int>")]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted([(d, public(t) if t else []) for d, t, _ in data], key=repr)
    assert tokenize.encode_documents(df.limit(0), key="doc", text="body", vocabulary=RANKS).collect() == []
