"""The pipeline: columns of every stage, and its decisions."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import __spark_entry__
from test_llm_operators import brute_components, jaccard, shingles, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == names
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert docs.filter("n_ids != size(ids)").count() == 0


def test_run_equals_brute_force_stage_by_stage(spark, tmp_path):
    """Each stage on all that the one before kept, in plain Python, and the whole run's rows."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held, kept = {}, None
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, frame, SF).write.parquet(path)
        frame = spark.read.parquet(path)
        held[name] = frame.collect()

    kept = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id: r.text for r in held["language_id"]} == kept and len(held["language_id"]) == len(kept)

    component = brute_components({i: shingles(t) for i, t in kept.items()}, jaccard)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    assert {r.doc_id: r.text for r in held["jaccard_join"]} == kept and len(held["jaccard_join"]) == len(kept)

    seen, left = set(), {}
    for i in sorted(kept):
        raw = kept[i].encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(raw[at : at + 100])
        left[i] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    assert {r.doc_id: (r.text, r.n_chars) for r in held["suffix_dedup"]} == {i: (t, len(t)) for i, t in left.items()}
    assert len(held["suffix_dedup"]) == len(left)

    taken = Counter(r.doc_id for r in held["mix_sources"])
    assert all(r.text == left[r.doc_id] for r in held["mix_sources"]) and max(taken.values()) <= 2
    size = {i: len(words(t)) for i, t in left.items()}
    total, got, most = Counter(), Counter(), Counter()
    for i, n in size.items():
        total[docs[i].source] += n
        got[docs[i].source] += n * taken[i]
        most[docs[i].source] = max(most[docs[i].source], n)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, free, rest = {}, set(total), 1.5 * sum(total.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else share
        rest -= sum(2 * total[s] for s in over)
        free = free - set(over) if over else set()
    assert all(abs(got[s] - target[s]) <= most[s] for s in total)

    assert Counter((r.doc_id, r.text) for r in held["sentencepiece"]) == Counter((i, left[i].replace("\u2581", " ")) for i in taken.elements())
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "text", "ids").collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in rows) == Counter((r.doc_id, r.text, tuple(r.ids)) for r in held["sentencepiece"])


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for table in (odd, none):
        docs = table.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        kept = docs.select("doc_id").distinct().count()
        assert kept >= 2 if table is odd else kept == 0


def test_one_of_near_copies_without_doc_id_stays(spark):
    base = [f"w{k}" for k in range(100)]
    near = [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in (10, 30, 50)]
    far = " ".join(f"f{k}" for k in range(100))
    data = [(None, t) for t in (*near, near[0], far)] + [(4, near[0] + " end"), (4, far + " end"), (7, far), (None, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, frame, SF)
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(4, near[0] + " end"), (4, far + " end"), (None, "")}
    unnamed = corpus_pipeline.without_near_copies(spark, frame.filter("doc_id is null"), SF).collect()
    assert len(unnamed) == 3 and sum(r["text"] in near for r in unnamed) == 1


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
