"""Readers and writers."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

from exposia import schemas
from exposia.functions import geometry as geo
from exposia.sources.delimited import accepted, quarantined, read_csv, read_csv_by_name, write_csv
from exposia.sources.geojson import feature_lines, read_geojson
from exposia.sources.staging import materialize, scratch_path, stages

CRLF = "\r\n"


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content.encode())
    return str(path)


def test_quoted_breaks_doubled_quotes_and_line_ends(spark, tmp_path):
    content = CRLF.join(
        [
            "Acronym,Year_opened,Year_opened_notes,Reentry_hub,Planned_closure,California_model_facility,cdcr_air_cooling_pilot",
            'ASP,1987,"said ""yes"", twice",Yes,,,',
            'CCI,1954,"one\ntwo",,,,Yes',
            "NA,,,,,,",
        ]
    )
    got = read_csv(spark, write(tmp_path, "m.csv", content), schemas.FACILITY_METADATA, multi_line=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [
            ("ASP", 1987, 'said "yes", twice', "Yes", None, None, None),
            ("CCI", 1954, "one\ntwo", None, None, None, "Yes"),
            (None, None, None, None, None, None, None),
        ],
        key=repr,
    )


@pytest.mark.parametrize("multi_line", [True, False])
def test_panel_counts_stay_text(spark, tmp_path, multi_line):
    content = CRLF.join(
        ["Year,Month,Location,Gender,Population", '2025,Jan,ASP,Male,"3,784"', "2025,Jan,ASP,Female,(Blank)", "2025,Jan,CMF,Female,*"]
    )
    got = read_csv(spark, write(tmp_path, "p.csv", content), schemas.panel("Gender"), multi_line=multi_line)
    assert sorted(r.Population for r in got.collect()) == ["(Blank)", "*", "3,784"]
    assert {r.Year for r in got.collect()} == {2025}


def test_columns_by_name_with_quarantine(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("f", T.BooleanType())])
    lines = ["v,extra,f,a,n", '1.5,x,true,"q ""z""",7', "NaN,,,NA,", "1,2,3,4", "1,x,true,b,7,8", "oops,x,maybe,c,1e3", '2, y ,False," s ",-1']
    path = write(tmp_path, "n.csv", CRLF.join(lines))
    rows = read_csv_by_name(spark, path, schema)
    assert sorted(map(tuple, accepted(rows).collect()), key=repr) == sorted([('q "z"', 7, 1.5, True), (None, None, None, None), (" s ", -1, 2.0, False)], key=repr)
    bad = {r.record: r.problem for r in quarantined(rows).collect()}
    assert bad == {
        "1,2,3,4": "wrong number of cells",
        "1,x,true,b,7,8": "wrong number of cells",
        "oops,x,maybe,c,1e3": "not bigint in n: 1e3; not double in v: oops; not boolean in f: maybe",
    }
    assert all(r.file.endswith("n.csv") for r in quarantined(rows).collect())
    assert accepted(rows).count() == 3 and accepted(rows).select("a").count() == 3 and quarantined(rows).count() == 3
    for header in ("v,f,a", "v,n,n,f,a"):
        with pytest.raises(ValueError, match="'n'"):
            read_csv_by_name(spark, write(tmp_path, "h.csv", f"{header}\n"), schema)
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder, "1.csv", "a,n,v,f\nx,1,2,true\n")
    write(folder, "2.csv", "n,a,v,f\n1,x,2,true\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_by_name(spark, str(folder), schema).collect()


def test_header_that_disagrees_with_the_schema_fails(spark, tmp_path):
    path = write(tmp_path, "h.csv", "Facility_Code,Facility_Name,Average_2025_Population\nASP,Avenal,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, path, schemas.POPULATION_AVERAGES).collect()


def test_ids_forced_to_text_keep_their_zeros(spark, tmp_path):
    header = ",".join(schemas.HEAT_DAYS.names)
    path = write(tmp_path, "d.csv", f"{header}\n06001400100,1,2,3,4,5,6\n06001400200,1,2,,nan,5,6\n")
    got = sorted(map(tuple, read_csv(spark, path, schemas.HEAT_DAYS).collect()))
    assert got == [("06001400100", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("06001400200", 1.0, 2.0, None, None, 5.0, 6.0)]


def test_written_csv_reads_back(spark, tmp_path):
    rows = [("a,b", 'q"q', 1.5, True), ("line\r\nbreak", None, None, False), (" pad ", "x", -0.25, None)]
    df = spark.createDataFrame(rows, "k string, t string, v double, f boolean")
    path = str(tmp_path / "out")
    write_csv(df, path)
    assert sorted(map(tuple, read_csv(spark, path, df.schema, multi_line=True).collect()), key=repr) == sorted(rows, key=repr)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "True" in text and "true" not in text
    with pytest.raises(ValueError, match="nested"):
        write_csv(spark.createDataFrame([([1],)], "a array<int>"), path)


SQUARE = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
FEATURES = [
    {"type": "Feature", "properties": {"GEOID": "1", "n": 2.5}, "geometry": {"type": "Polygon", "coordinates": SQUARE}},
    {"type": "Feature", "properties": {"GEOID": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}},
    {"type": "Feature", "properties": {"GEOID": "3", "n": None}, "geometry": None},
]
PROPERTIES = T.StructType([T.StructField("GEOID", T.StringType()), T.StructField("n", T.DoubleType())])


def documents():
    one = json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1)
    exported = '{\n"type": "FeatureCollection",\n"features": [\n' + ",\n".join(map(json.dumps, FEATURES)) + "\n]\n}\n"
    return {
        "collection": ("collection", one),
        "exported": ("lines", exported),
        "other key order": ("lines", "\n".join(json.dumps({"id": 7, **dict(reversed(f.items()))}) for f in FEATURES)),
        "bare lines": ("lines", "\n".join(map(json.dumps, FEATURES))),
        "sequence": ("lines", "".join(f"\x1e{json.dumps(f)}\n" for f in FEATURES)),
    }


@pytest.mark.parametrize("kind", list(documents()))
def test_geojson_layouts(spark, tmp_path, kind):
    layout, content = documents()[kind]
    layer = read_geojson(spark, write(tmp_path, "l.geojson", content), PROPERTIES, layout=layout)
    got = {r.GEOID: (r.n, r.geometry) for r in layer.collect()}
    assert got == {"1": (2.5, [SQUARE]), "2": (None, [SQUARE, SQUARE]), "3": (None, None)}


def test_geojson_attributes_alone_do_not_read_shapes(spark, tmp_path):
    layout, content = documents()["exported"]
    layer = read_geojson(spark, write(tmp_path, "l.geojson", content), PROPERTIES, layout=layout, geometry=False)
    assert layer.columns == ["GEOID", "n"] and layer.count() == 3
    assert "coordinates" not in layer._jdf.queryExecution().toString()


def test_geojson_of_points_fails_loudly(spark, tmp_path):
    point = {"type": "Feature", "properties": {"GEOID": "1"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}
    layer = read_geojson(spark, write(tmp_path, "p.geojson", json.dumps(point)), PROPERTIES, layout="lines")
    with pytest.raises(Exception, match="not a polygon layer"):
        layer.collect()


@pytest.mark.parametrize("indent", [None, 1])
def test_geojson_that_is_not_one_feature_per_line_fails(spark, tmp_path, indent):
    content = json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=indent)
    layer = read_geojson(spark, write(tmp_path, "c.geojson", content), PROPERTIES, layout="lines")
    with pytest.raises(Exception, match="collection layout"):
        layer.collect()


def test_features_written_as_lines_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", [SQUARE]), ("b", None)], "GEOID string, geometry array<array<array<array<double>>>>")
    path = str(tmp_path / "lines")
    feature_lines(df).write.text(path)
    back = read_geojson(spark, path, schemas.TRACT_PROPERTIES, layout="lines")
    assert {r.GEOID: r.geometry for r in back.collect()} == {"a": [SQUARE], "b": None}


def test_stages_go_to_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
    staged = materialize(spark.range(5).withColumnRenamed("id", "v"))
    assert staged.inputFiles() and root in staged.inputFiles()[0] and staged.count() == 5


def test_nothing_remains_of_scoped_stages(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    kept = materialize(spark.range(3))
    before = {p for p in root.rglob("*") if p.is_dir()}
    with stages(spark):
        inner = materialize(spark.range(5))
        with stages(spark):
            assert materialize(inner.filter("id > 1")).count() == 3
        assert inner.count() == 5
    with pytest.raises(ZeroDivisionError), stages(spark):
        materialize(spark.range(5))
        raise ZeroDivisionError
    assert {p for p in root.rglob("*") if p.is_dir()} == before and kept.count() == 3


def test_own_temp_folder_goes_with_the_process(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from exposia.sources.staging import materialize\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(materialize(s.range(4)).count(), s.sparkContext.getCheckpointDir())\n"
    )
    home = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TMPDIR": str(tmp_path), "PYTHONPATH": home}, capture_output=True, text=True, timeout=300)
    assert run.stdout.startswith("4 "), run.stderr[-2000:]
    assert not list(tmp_path.glob("exposia-*"))


def test_wkt_goes_to_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", [SQUARE])], "id string, geometry array<array<array<array<double>>>>")
    path = str(tmp_path / "wkt")
    write_csv(df.withColumn("geometry", geo.to_wkt("geometry")), path)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("geometry", T.StringType())])
    assert read_csv(spark, path, schema).first().geometry == "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)))"


def _feature(name, kind="Feature"):
    return json.dumps({"type": kind, "properties": {"NAME": name}, "geometry": None})


NAMED = T.StructType([T.StructField("NAME", T.StringType())])


@pytest.mark.parametrize(
    "content",
    [
        f"{_feature('a')},{_feature('b')}\n{_feature('c')}",
        '{"bbox": [1,2],\n"features": [\n' + f"{_feature('a')},\n{_feature('b')},\n{_feature('c')}" + '\n],\n"type": "FeatureCollection"}',
    ],
)
def test_no_feature_of_a_line_is_lost(spark, tmp_path, content):
    layer = read_geojson(spark, write(tmp_path, "l.geojson", content), NAMED, layout="lines", geometry=False)
    assert sorted(r.NAME for r in layer.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize(
    "content",
    [
        '{"features": [' + _feature("a") + '], "type": "FeatureCollection"}',
        '{"bbox": [0, 1], "type": "FeatureCollection", "features": [' + _feature("a") + "]}",
        json.dumps({"properties": {"NAME": "a"}, "geometry": None, "type": "Feature"}, indent=1),
        _feature("a", "Thing"),
    ],
)
def test_other_layouts_fail(spark, tmp_path, content):
    with pytest.raises(Exception):
        read_geojson(spark, write(tmp_path, "l.geojson", content), NAMED, layout="lines").collect()


@pytest.mark.parametrize("cell", ['"3,891"', "1,2"])
def test_cells_that_do_not_fit_fail(spark, tmp_path, cell):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    path = write(tmp_path, "c.csv", f"k,v\na,1\nb,{cell}\n")
    with pytest.raises(Exception):
        read_csv(spark, path, schema).collect()
