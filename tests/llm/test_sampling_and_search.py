"""Importance resampling and lexical search against brute force and their SQL, odd rows included."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from exposia.llm import importance, lexical, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})
ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def features(text):
    w = terms(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resampled(docs, target, percent, least):
    """doc_id, n_features, weight, score, rank of each row, in the order given."""
    counts = []
    for texts in ([t for _, t in docs], target):
        counts.append(Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)))
    s, t = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (s + 10000) / ((counts[0][b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        found = [gain[zlib.crc32(f.encode()) % 10000] for f in features(text)]
        weight = math.floor(sum(found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r, (_, text) in zip(rows, docs) if len(terms(text)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return [tuple(r) for r in rows]


def ranked(docs, items, top=20):
    """item_id, rank, doc_id, score rows."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // total
            worth = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c]
            if sum(worth) > 0:
                scores.append((-sum(worth), i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op7_warc", "op11_importance_sample", "op12_lexical_search"])
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


def test_sampling_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(1, "quick brown fox dolor sit amet"), (2, None), (2, "")], ITEMS)
    extra = spark.createDataFrame([(None, "the end of the row", "en", "a", 1, "x", 1)] * 2 + [(None, None, None, None, None, None, None)], odd.schema)
    docs = odd.unionByName(extra)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = resampled(plain, [r.text for r in target.collect()], 50, 2)
    found = importance.importance_sample(docs, target, percent=50, least_words=2)
    assert got(found.select("row.doc_id", "n_features", "weight", "score", "rank")) == sorted(want, key=repr)
    # whole rows come back, clashing names and all
    assert found.schema["row"].dataType.fieldNames() == docs.columns
    assert sorted(r.row.text or "" for r in found.collect()) == sorted(t or "" for _, t in plain)
    assert importance.importance_sample(none, target).collect() == []
    alone = importance.importance_sample(docs, none, percent=50, least_words=2)
    assert got(alone.select("row.doc_id", "n_features", "weight", "score", "rank")) == sorted(resampled(plain, [], 50, 2), key=repr)


def test_sampling_ties_and_long_texts(spark):
    long = "Émile 42 said so, " * 200_000  # 3.8 MB: more than a chunk
    docs = [(5, long), (5, long)] + [(i, "a b c") for i in (3, 1, 1, None, None)] + [(9, "x" * 300_000 + " y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(0, "said so")], ITEMS)
    found = importance.importance_sample(df, target, percent=60, least_words=2, keep=["doc_id"])
    assert got(found.select("row.doc_id", "n_features", "weight", "score", "rank")) == sorted(resampled(docs, ["said so"], 60, 2), key=repr)


@pytest.mark.parametrize("k", [1, 2, 4999, 7777, 20_000])
def test_quickselect_finds_the_key_in_small_steps(spark, k):
    keys = spark.range(20_000).selectExpr("id div 5000 as a", "id * 7919 % 20011 as b")
    assert importance.kth_key(keys, ["a", "b"], k, 20_000, pivots=4, at_once=1) == tuple(keys.orderBy("a", "b").collect()[k - 1])


def test_joined_crc():
    a, b = [b"", b"ab", "ñ".encode() * 90], [b" c", b"", b"xyz" * 40]
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.uint32)
    both = importance.joined_crc(crc(a), crc(b), np.array([len(v) for v in b]))
    assert both.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_search_odd_rows_in_small_pieces(spark, odd, none):
    extra = spark.createDataFrame([(None, "two brown words", "en", "a", 1, "x", 1)] * 2 + [(0, "ÉCOLE école é1", "fr", "a", 1, "x", 1)], odd.schema)
    docs = odd.unionByName(extra)
    items = [(1, "two words two"), (1, "brown FOX, lorem"), (2, None), (3, "?!"), (4, "nothing known"), (5, "École É1 consectetur"), (None, "campagne 123")]
    frame = spark.createDataFrame(items, ITEMS).withColumn("text_", F.lit(1))
    want = sorted(ranked([(r.doc_id, r.text) for r in docs.collect()], items, 3), key=repr)
    for options in ({}, {"piece_bytes": 1}, {"block_terms": 1}):
        assert got(lexical.search(docs, frame, top=3, **options)) == want
    assert lexical.search(none, frame).collect() == []
    assert lexical.search(docs, spark.createDataFrame([], ITEMS)).collect() == []


def test_search_ties_keep_the_smaller_ids(spark):
    docs = [(i, "same words here" if i % 3 else "same") for i in range(500, 0, -1)]
    items = [(0, "same words"), (1, "here same same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(lexical.search(df, spark.createDataFrame(items, ITEMS), piece_bytes=900)) == sorted(ranked(docs, items), key=repr)


def test_walk_skips_without_losing_documents():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = 400
        lists, total = [], np.zeros(n, np.int64)
        for size in rng.integers(1, n, 6):
            docs = np.sort(rng.choice(n, size, replace=False))
            worth = rng.integers(1, 30, size)
            total[docs] += worth
            lists.append((docs, worth, int(worth.max())))
        best = lexical.Best(7)
        names = np.column_stack([np.zeros(n, np.int64), np.arange(n)])
        lexical.walk(lists, n, best, names, window=16)
        want = np.lexsort((np.arange(n), -total))[:7]
        assert best.rows[:, 2].tolist() == want.tolist() and best.rows[:, 0].tolist() == total[want].tolist()
