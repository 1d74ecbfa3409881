import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genomespark.llm import tokens as K

RANKS = K.read_ranks(f"{K.VOCABULARIES}/byte_bpe_50k.tiktoken")
ENCODER = K.Encoder(RANKS)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def plain_merge(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
        if best is None:
            return [RANKS[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_against_plain_merging(word):
    assert K.merge(word, RANKS) == plain_merge(word)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encode_against_the_library(text):
    assert ENCODER.encode(text) == library([text])[0]


def test_long_and_mixed_texts():
    r = random.Random(1)
    texts = ["a" * 100_000, "日本語" * 30_000, " \n\t " * 20_000, "<|endoftext|>x", "ที่ " * 5000, "".join(chr(r.randrange(1, 0xD7FF)) for _ in range(20_000)), "😀👩‍👩‍👧" * 2000, "1234567890" * 5000]
    assert [ENCODER.encode(t) for t in texts] == library(texts)


def test_round_trip_and_rows(spark):
    texts = [None, "", "Hello world", "  two  spaces", "naïve Straße 漢字", "Hello world"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in K.encode_corpus(df, "doc_id", "text").collect()}
    back = {v: k for k, v in RANKS.items()}
    assert got[0] == got[1] == [] and len(got) == 6
    assert all(b"".join(back[i] for i in got[k]).decode() == t for k, t in enumerate(texts) if t)
    assert K.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken"])
def test_other_vocabulary(name):
    e = K.Encoder(K.read_ranks(f"{K.VOCABULARIES}/{name}"))
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=e.ranks, special_tokens={})
    text = "Größe und Übung, les élèves 日本語 русский" * 20
    assert e.encode(text) == other.encode_ordinary(text)
