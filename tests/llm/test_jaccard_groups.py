"""The Jaccard join where many texts are near and few are linked, and its SQL."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from compare import connect, difference
from exposia.llm import jaccard_join, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_texts(n, apart=True):
    """Texts of 40 words, each with one word of its own in the middle: any two share 31 of 41 shingles,
    or, not ``apart``, with the own word near the end, 34 of 38."""
    words = [f"w{i}" for i in range(40)]
    place = 20 if apart else 38
    return [" ".join([*words[:place], f"own{i}", *words[place + 1 :]]) for i in range(n)]


def table(texts, keys):
    packed = [jaccard_join.zlib.compress(t.encode()) for t in texts]
    ids = np.arange(len(texts)) * 7 + 3
    sets = jaccard_join.shingle_sets(pa.array(texts, pa.large_string()))
    columns = {
        "key": np.zeros(len(texts), np.int64), "low": np.zeros(len(texts), np.int32), "high": np.full(len(texts), max(keys), np.int32),
        "side": np.array(keys, np.int32), "set_id": ids, "label": ids, "n": np.diff(sets[1]),
    }
    return pa.table({k: pa.array(v) for k, v in columns.items()} | {"z": pa.array(packed, pa.binary()), "bits": pa.array(jaccard_join._cells(*sets), pa.binary())})


@pytest.mark.parametrize("n", [400, 800])
def test_near_texts_that_do_not_link_return_nothing(spark, n):
    texts = near_texts(n)
    group = table(texts, [0] * n)
    candidates = jaccard_join._with_candidates(group)
    assert len(candidates) <= n and candidates["other"].null_count == len(candidates)
    assert len(jaccard_join._linked_in_group(group)) == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard_join.jaccard_join(docs).collect())


@pytest.mark.parametrize("sides", [[0] * 60, [i % 2 for i in range(60)]])
def test_links_of_a_task_join_it_and_no_more(sides):
    found = jaccard_join._linked_in_group(table(near_texts(60, apart=False), sides))
    assert len(found) == 59
    assert len({*found["a"].to_pylist(), *found["b"].to_pylist()}) == 60


def test_few_candidates_are_pairs():
    texts = near_texts(2, apart=False) + [f"{i} " * 30 + "a b c d e f" for i in range(5)]
    found = jaccard_join._with_candidates(table(texts, [0] * 7))
    assert [(r["set_id"], r["other"]) for r in found.to_pylist()] == [(3, 10)]


def test_candidates_hold_every_link_whatever_the_sizes():
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 20, 31, 33, 70, 140, 600]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(0, 2))]
            texts.append(" ".join(words) or "x")
    sets = [shingles(t.split()) if len(t.split()) >= 5 else {tuple(t.split())} for t in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for sides in ([0] * len(texts), [i % 2 for i in range(len(texts))]):
        group = table(texts, sides)
        args = [group[c].to_numpy() for c in ("n", "label", "side")]
        pairs = {tuple(sorted(p)) for i, j in jaccard_join._candidates(args[0], group["bits"].to_pylist(), *args[1:]) for p in zip(i.tolist(), j.tolist())}
        assert {p for p in linked if max(sides) == 0 or sides[p[0]] != sides[p[1]]} <= pairs


def test_query_equals_its_sql(spark):
    assert difference(queries.op1_jaccard_join(spark, SF), connect(SF), queries.ORACLES["op1_jaccard_join"]) == ""
