"""Feature collections cut at any byte, against Python's own JSON reader."""

from __future__ import annotations

import json
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from exposia.sources import objects
from exposia.sources.geojson import read_geojson
from exposia.sources.objects import DOCUMENT, FEATURE, read_objects

PROPERTIES = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
TRICKY = ['}', '{"features":[{', '"', '\\', '\\"', ']}', ', {', '\\\\"}', 'é {😀}', '"features": [', "", " } ", "\x1e", "\n}\n", "{[F"]


def feature(rng, i):
    shape = {"type": "Polygon", "coordinates": [[[rng.random(), j] for j in range(rng.randint(4, 9))]]} if rng.random() < 0.9 else None
    extra = {"features": [{"a": 1}, [2]], "x": {"features": []}} if rng.random() < 0.2 else {}
    return {"type": "Feature", "properties": {"name": rng.choice(TRICKY) + rng.choice(TRICKY), "n": i, **extra}, "geometry": shape}


def document(rng, features):
    shell = [("type", "FeatureCollection"), ("features", features), ("crs", {"properties": {"name": rng.choice(TRICKY)}}), ("bbox", [1, [2]]), ("links", [{"type": "Feature"}, {"x": "}"}])]
    rng.shuffle(shell)
    return dict(m for m in shell if m[0] in ("type", "features") or rng.random() < 0.5)


def text(rng, value):
    return json.dumps(value, indent=rng.choice([None, None, 1, 4, "\t"]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\n", " : ")]))


def read_in_blocks(data: bytes, size: int, batch: int = 3):
    """kind, text of every object, from blocks as Spark's text source deals them, without Spark."""
    body = data.removeprefix(b"\xef\xbb\xbf")
    parts = body.split(b"}")
    if not parts[-1]:
        parts.pop()  # a file that ends with its bracket has no further record
    at, blocks = len(data) - len(body), {}
    for part in parts:
        blocks.setdefault(0 if at <= size else (at - 1) // size * size, []).append(part)
        at += len(part) + 1

    def batches(start, more):
        held = blocks[start]
        for k in range(0, len(held), batch):
            columns = {"part": held[k : k + batch], "file": ["f.json"] * len(held[k : k + batch])}
            columns |= {n: [v] * len(columns["part"]) for n, v in ({"start": start} | more).items()}
            yield pa.RecordBatch.from_pydict(columns)

    summaries = [b.to_pylist()[0] for s in blocks for b in objects._summaries(batches(s, {"size": len(data)}))]
    if not summaries:
        return []
    entries = objects.chained(pd.DataFrame(summaries)).to_dict("records")
    rows = [r for e in entries for b in objects._cut(batches(e["start"], {k: v for k, v in e.items() if k not in ("file", "start")})) for r in b.to_pylist()]
    groups = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        if r["kind"].endswith(objects._PART):
            groups.setdefault((r["begun"], r["kind"].removesuffix(objects._PART)), []).append(r["data"])
    whole = [(r["kind"], r["data"].decode()) for r in rows if not r["kind"].endswith(objects._PART)]
    return whole + [(kind, b"".join(v).decode()) for (_, kind), v in groups.items()]


def files(rng, n):
    """Texts of files and the features they hold."""
    for k in range(n):
        docs, want = [], []
        for _ in range(rng.choice([1, 1, 3])):
            features = [feature(rng, rng.randrange(10**6)) for _ in range(rng.choice([0, 1, 12]))]
            if rng.random() < 0.7:
                docs.append(document(rng, features))
            else:
                docs += features[:3]
            want += features if docs and docs[-1].get("type") == "FeatureCollection" else features[:3]
        start = "\ufeff" if k % 5 == 0 else rng.choice(["", "\n", " \x1e"])
        yield start + rng.choice(["\n", "", " \r\n\x1e"]).join(text(rng, d) for d in docs) + rng.choice(["", "\n", "  \n\n"]), want


def features_of(found):
    whole = [(kind, json.loads(data)) for kind, data in found]
    assert all(v["type"] == "Feature" or v["features"] == [] for kind, v in whole if kind == DOCUMENT)
    return sorted(repr(v) for kind, v in whole if kind == FEATURE or v["type"] == "Feature")


@pytest.mark.parametrize("block", [1, 7, 13, 61, 400, 5000])
def test_any_cut_gives_every_feature(block):
    rng = random.Random(block)
    for content, want in files(rng, 40):
        assert features_of(read_in_blocks(content.encode(), block, rng.choice([1, 3, 100]))) == sorted(map(repr, want)), content


@pytest.fixture
def small_blocks(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", str(n))

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("block", [1000, 1 << 27])
def test_files_give_every_feature(spark, tmp_path, small_blocks, block):
    want = []
    for k, (content, features) in enumerate(files(random.Random(block), 6)):
        (tmp_path / f"{k}.json").write_text(content, encoding="utf-8", newline="")
        want += features
    small_blocks(block)
    assert features_of([(r.kind, r.data) for r in read_objects(spark, str(tmp_path)).collect()]) == sorted(map(repr, want))
    layer = read_geojson(spark, str(tmp_path), PROPERTIES)
    assert sorted((r["name"], r["n"], r["geometry"] is None) for r in layer.collect()) == sorted(
        (f["properties"]["name"], f["properties"]["n"], f["geometry"] is None) for f in want
    )
    names = read_geojson(spark, str(tmp_path), PROPERTIES, geometry=False)
    assert names.columns == ["name", "n"] and names.count() == len(want)


def test_one_document_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(rng, i) for i in range(3000)]}))
    small_blocks(40_000)
    found = read_geojson(spark, str(path), PROPERTIES)
    assert found.count() == 3000 and found.agg(F.sum("n")).first()[0] == 3000 * 2999 // 2
    lines = spark.read.option("lineSep", "}").text(str(path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 5


GOOD = '{"type":"Feature","properties":{"name":"x"},"geometry":null}'


BROKEN = [
    "[" + GOOD + "]",
    GOOD + "," + GOOD,
    GOOD + "x",
    "x" + GOOD,
    GOOD + "}",
    GOOD + "\n}\n",
    GOOD[:-1],
    GOOD[:-1] + "\n",
    GOOD[:20],
    '{"type":"FeatureCollection","features":[' + GOOD,
    '{"type":"FeatureCollection","features":[' + GOOD + "]",
    '{"type":"FeatureCollection","features":[' + GOOD + ",," + GOOD + "]}",
    '{"type":"FeatureCollection","features":[' + GOOD + ",5]}",
    '{"type":"FeatureCollection","features":[5,' + GOOD + "]}",
    '{"type":"FeatureCollection","features":[' + GOOD + ",[]]}",
]
WRONG = [  # whole objects, but not of this kind: found when they are parsed
    '{"type":"FeatureCollection"}',
    '{"features":[' + GOOD + "]}",
    '{"type":"FeatureCollection","features":null}',
    '{"type":"Topology","objects":{}}',
    '{"type":"FeatureCollection","features":[{"type":"Point"}]}',
    '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"text"}}]}',
]


@pytest.mark.parametrize("block", [1, 9, 1000])
@pytest.mark.parametrize("broken", BROKEN)
def test_broken_files_are_errors_at_any_cut(broken, block):
    with pytest.raises(objects.BrokenDocument):
        read_in_blocks(broken.encode(), block)


@pytest.mark.parametrize("wrong", [*WRONG, BROKEN[0], BROKEN[6]])
def test_wrong_documents_are_errors(spark, tmp_path, wrong):
    (tmp_path / "a.json").write_text(GOOD + "\n" + GOOD)
    (tmp_path / "b.json").write_text(wrong)
    with pytest.raises(Exception):
        read_geojson(spark, str(tmp_path), PROPERTIES).collect()


def test_no_document_no_row(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text(" \n\n")
    (tmp_path / "c.json").write_text('{"features": [], "type": "FeatureCollection"}')
    assert read_geojson(spark, str(tmp_path), PROPERTIES).collect() == []


def test_chained_blocks_in_any_order():
    parts = [b'{"type":"FeatureCollection","features":[{"a":"}', b'"},{"b":[{}', b"]},{}", b"]}"]
    rows = []
    for i, part in enumerate(parts):
        effects = [objects.Effect(False), objects.Effect(True)]
        for e in effects:
            e.then(part)
        rows.append(("f.json", i, sum(map(len, parts)), len(part), False, [e.in_string for e in effects], [e.closes for e in effects], [e.opens for e in effects]))
    frame = pd.DataFrame(rows[::-1], columns=["file", "start", "size", "bytes", "blank", "strings", "closes", "opens"])
    got = [tuple(r) for r in objects.chained(frame)[["in_string", "opened", "document_from", "feature_from"]].itertuples(index=False)]
    assert got == [(False, "", 0, 0), (True, "{F{", 0, 0), (False, "{F{[", 0, 1), (False, "{F", 0, 2)]
