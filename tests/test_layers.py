"""Layers along a curve: what a box reads, and what a region join reads."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from exposia.operators import spatial
from exposia.sources.layers import BOX, curve, extent_of, read_layer, within_extent, write_layer
from test_functions import SHAPE, box


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    shapes = [(f"{x:02}{y:02}", [[box(float(x), float(y), x + 1.0, y + 1.0)]], "pad " * 40) for x in range(40) for y in range(40)]
    shapes += [("none", None, ""), ("empty", [], "")]
    path = str(tmp_path_factory.mktemp("layer") / "cells")
    frame = spark.createDataFrame(shapes, f"GEOID string, geometry {SHAPE}, note string").repartition(5)
    write_layer(frame, path, row_group=4096)
    return path


def test_curve_takes_the_bits_in_turn(spark):
    points = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (65535, 65535), (70000, -5)], "x int, y int")
    got = [r[0] for r in points.select(curve(F.col("x").cast("double"), F.col("y").cast("double"), (0.0, 0.0, 65535.0, 65535.0))).collect()]
    assert got == [0, 1, 2, 3, 4, (1 << 32) - 1, 0x55555555]


def test_a_box_skips_most_row_groups(layer):
    groups = [g for f in glob.glob(f"{layer}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]

    def meets(group):
        stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema in BOX}
        return all(s.has_min_max for s in stats.values()) and (
            stats["xmin"].min <= 6.5 and stats["xmax"].max >= 5.5 and stats["ymin"].min <= 6.5 and stats["ymax"].max >= 5.5
        )

    read = [g for g in groups if meets(g)]
    assert len(groups) > 15 and len(read) <= len(groups) / 4


def test_box_columns_and_missing_shapes(spark, layer):
    rows = {r.GEOID: r for r in read_layer(spark, layer).collect()}
    assert len(rows) == 1602 and (rows["0305"].xmin, rows["0305"].ymax) == (3.0, 6.0)
    assert rows["none"].xmin is None and rows["empty"].xmin is None
    assert sorted(r.GEOID for r in read_layer(spark, layer, (2.5, 3.5, 3.5, 3.75)).collect()) == ["0203", "0303"]
    assert within_extent(read_layer(spark, layer), None).count() == 0
    with pytest.raises(ValueError, match="box columns"):
        write_layer(read_layer(spark, layer), "/nowhere")


@pytest.mark.parametrize("disjoint", [True, False])
def test_region_join_pushes_the_box_of_the_points(spark, layer, disjoint):
    points = spark.createDataFrame([("a", 3.5, 5.5), ("b", 4.5, 5.25), ("c", 99.0, None), ("d", None, None), ("e", 5.0, 6.0)], "facilityid string, longitude double, latitude double")
    assert extent_of(points.filter("longitude < 9"), "longitude", "latitude") == (3.5, 5.25, 5.0, 6.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        near = points.filter("longitude < 9 or longitude is null")
        placed = spatial.assign_region(near, read_layer(spark, layer), disjoint=disjoint, cell=1.0, small=True)
        plan = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {r.facilityid: r.tract_geoid for r in placed.collect()} == {"a": "0305", "b": "0405", "d": None, "e": None}
    assert "LessThanOrEqual(xmin,5.0)" in plan and "GreaterThanOrEqual(ymax,5.25)" in plan
    none = spatial.assign_region(points.filter("longitude is null"), read_layer(spark, layer), disjoint=disjoint, cell=1.0)
    assert [r.tract_geoid for r in none.collect()] == [None]
