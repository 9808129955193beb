"""Token counts against the library of the vocabulary, and the parts of the machines by themselves."""

from __future__ import annotations

import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from exposia.llm import queries
from exposia.llm.token_machine import CHUNK, Counter, composed, count_tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", None, "don't you're I'VE we'll 'sun ''s !'s 'r 're 'rx 'l 'll 'l'l x'v", "'" * 7 + "s" + "'t", "r'e 'r e'", "'S 'T 'RE", "\n\r\t 'd'm",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext", "e<|endoftext|>́ <|endoftext|≯",
    "İstanbul ΣΑΣ ς ǅ ﬁ ẞ ŉ ĳ", "é Å क़ ≯ '́s", "½ ² Ⅷ १२३ 42a7", "😀😀 👩‍👩‍👧 …—", "a b c\u0085d​e\x1cf\x00g",
    "a" * 400, "the" * 100, "漢字かな交じり文 ไทย 한국어", "x</w>y </w> w</w>", "x" * (CHUNK - 1) + "'s", "x" * (CHUNK - 2) + " 're",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library(docs.values())))
    found = queries.op13_token_counts(spark, SF).collect()
    assert len(found) == len(docs)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 2048) for r in found)


def test_odd_texts(counter, library):
    assert counter.counts(ODD).tolist() == library(ODD)
    assert counter.counts([]).tolist() == [] and counter.counts([None, ""]).tolist() == [0, 0]


def test_random_texts(counter, library):
    rng = random.Random(1)
    near = "aeiost'rvldmAENT  \n!?.0129éÉñßİı’<|>xyz"
    pieces = [t.replace("</w>", "") for t in Tokenizer.from_file(PATH).get_vocab()]
    far = [range(0x20, 0x300), range(0x300, 0x370), range(0x370, 0xD800), range(0xE000, 0x20000)]
    texts = ["".join(rng.choices(near, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice(rng.choice(far))) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(3000)]
    assert counter.counts(texts).tolist() == library(texts)


def test_very_long_texts_and_a_forgetful_machine(library):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=150_000)), "Éa, 'twas 12 the end's " * 150_000]
    small = Counter(PATH)
    small.machine.most_states = 500
    assert small.counts(texts).tolist() == library(texts)


def test_splitter_equals_a_plain_walk(counter):
    split = counter.splitter
    rng = np.random.default_rng(3)
    for n in (0, 1, CHUNK, 3 * CHUNK + 5, 5000):
        symbols = np.append(rng.integers(0, len(split.classes), n), 0)
        state, starts = 0, set()
        for i, s in enumerate(symbols):
            cuts = int(split.cuts[state, s])
            starts |= {i - back for back in range(8) if cuts >> back & 1}
            state = split.next[state, s]
        assert split.starts(symbols).tolist() == sorted(starts)


def test_composed_maps():
    maps = np.random.default_rng(4).integers(0, 5, (37, 5))
    now = np.arange(5)
    for one, all_so_far in zip(maps, composed(maps)):
        now = one[now]
        assert now.tolist() == all_so_far.tolist()


def test_rows_stand_alone(spark, odd, none, library):
    found = count_tokens(odd, PATH, limit=3).collect()
    texts = [r.text for r in odd.collect()]
    assert sorted((r.row.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(
        (t or "", len((t or "").encode()), n, n > 3) for t, n in zip(texts, library(texts))
    )
    assert found[0].row.asDict().keys() == set(odd.columns)
    unnamed = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(unnamed, PATH).collect()) == [0, 2, 2]
    assert count_tokens(none, PATH).collect() == []


def test_unknown_vocabulary_is_an_error():
    with pytest.raises(ValueError, match="known kind"):
        Counter(public_tokenizers.path("byte_bpe_50k.json"))
