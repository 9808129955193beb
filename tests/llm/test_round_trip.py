"""Ids and texts by one worker a task."""

from __future__ import annotations

import corpus_pipeline
from exposia.llm import queries, transducer

PIECES = f"{queries.TOKENIZERS}/{transducer.VOCABULARY}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_of_the_last_stage_has_one_worker(spark, odd, tmp_path):
    docs = odd.drop("row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (corpus_pipeline.encoded(spark, docs, str(tmp_path)), queries.op4_sentencepiece(spark, str(tmp_path))):
        assert plan(found).count("MapInArrow") == 1


def test_round_trip_is_decode_of_encode(odd, none):
    want = transducer.decode(transducer.encode(odd, PIECES), PIECES)
    got = transducer.round_trip(odd, PIECES)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 12
    assert transducer.round_trip(none, PIECES).count() == 0
