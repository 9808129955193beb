"""Operators: joins under skew, panels, scaling, regions."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposia.functions import numeric
from exposia.operators import cleaning, joins, measures, reshape, scaling, spatial
from exposia.plans import tables
from test_functions import SHAPE, SQUARE_WITH_HOLE, TWO_PARTS, box


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Means worked by hand from four months of published counts.
PANEL = [
    ("CIW", "Female", ["1,271", "1,231", "1,218", "1,207"]),
    ("CIW", "Male", ["10"] * 4),
    ("CMF", "Female", ["*"] * 4),
    ("CMF", "Male", ["1,868", "1,889", "1,907", "1,964"]),
    ("MCSP", "Female", ["*", "(Blank)", "(Blank)", "(Blank)"]),
    ("KVSP", "Female", ["(Blank)"] * 4),
    (None, "Female", ["1"] * 4),
    ("CMF", None, ["1"] * 4),
]
POPULATION = {"CIW": 1187.0, "CMF": 2045.0, "MCSP": 3761.0, "KVSP": 3092.0}


@pytest.fixture(scope="module")
def gender_panel(spark):
    long = [(2025, str(m), loc, g, v) for loc, g, counts in PANEL for m, v in enumerate(counts)]
    return spark.createDataFrame(long, "Year int, Month string, Location string, Gender string, Population string")


def test_published_counts_to_shares(spark, gender_panel):
    wide = reshape.category_means_wide([reshape.Family(gender_panel, "Gender", "gender", ["Female", "Male"])])
    assert wide.columns == ["Location", "gender_female", "gender_male"]
    codes = [(c, p) for c, p in POPULATION.items()] + [("ASP", 10.0), ("CIW", None), (None, 5.0)]
    facilities = spark.createDataFrame(codes, "cdcr_code string, people double")
    shares = measures.category_shares(facilities, wide, "gender", "people")
    got = {(r.cdcr_code, r.people): (r.gender_female_pct, r.gender_male_pct) for r in shares.collect()}
    assert got[("CIW", 1187.0)] == (1.0, pytest.approx(0.0084246, abs=1e-7))
    assert got[("CMF", 2045.0)] == (pytest.approx(0.0024450, abs=1e-7), pytest.approx(0.9325183, abs=1e-7))
    assert got[("MCSP", 3761.0)] == (0.0, 0.0)
    assert got[("KVSP", 3092.0)] == (0.0, 0.0)
    assert got[("ASP", 10.0)] == (None, None)
    assert got[("CIW", None)] == (0.0, 0.0)
    assert got[(None, 5.0)] == (None, None)
    assert len(got) == len(codes)


def test_families_align_and_repeated_names_are_refused(spark, gender_panel):
    race = spark.createDataFrame([("CMF", "White", "3"), ("X", "A/B", "4")], "Location string, Race string, Population string")
    wide = reshape.category_means_wide(
        [reshape.Family(gender_panel, "Gender", "gender", ["Male"]), reshape.Family(race, "Race", "race", ["White", "A/B"])]
    )
    got = {r.Location: (r.gender_male, r.race_white, r.race_a_b) for r in wide.collect()}
    assert got["CMF"] == (1907.0, 3.0, 0.0) and got["X"] == (0.0, 0.0, 4.0) and got["KVSP"] == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="same column name"):
        reshape.category_means_wide([reshape.Family(race, "Race", "race", ["A B", "A/B"])])
    maps = reshape.category_means_wide([reshape.Family(race, "Race", "race"), reshape.Family(gender_panel, "Gender", "gender", ["Male"])])
    assert {r.Location: (r.race, r.gender_male) for r in maps.collect()}["X"] == ({"a_b": 4.0}, 0.0)
    clash = race.union(race.select(F.lit("X"), F.lit("A B"), F.lit("1")))
    with pytest.raises(Exception, match="(?i)duplicate"):
        reshape.family_maps([reshape.Family(clash, "Race", "race")]).collect()


def test_twenty_thousand_categories(spark):
    panel = spark.range(60_000).selectExpr("concat('L', id % 2) as Location", "concat('c ', id % 20000) as c", "string(id div 20000) as Population")
    found = reshape.family_maps([reshape.Family(panel, "c", "f")])
    sizes = found.select("Location", F.size("f").alias("n"), F.try_element_at("f", F.lit("c_1234")).alias("one"))
    assert rows(sizes, "Location", "n", "one") == [("L0", 10_000, 1.0), ("L1", 10_000, None)]
    shares = measures.map_shares(found.withColumn("people", F.lit(2.0)), "f", "people", "f_pct", clipped=True, smallest=0.6)
    assert rows(shares.select("Location", F.try_element_at("f_pct", F.lit("c_1234")).alias("one")), "Location", "one") == [("L0", 0.0), ("L1", None)]
    means = reshape.family_means([reshape.Family(panel, "c", "f")])
    counted = measures.demographic_counts(means, {"f": None})
    assert rows(counted.select(F.size("f").alias("n")), "n") == [(10_000,), (10_000,)]


def test_long_and_wide_measures_agree(spark):
    rng = random.Random(5)
    ages = [*measures.OVER_50, "18-49 Years"]
    races = ["White", "Black", "Asian/Other"]
    panels = {
        "age": [(f"L{rng.randrange(6)}", rng.choice(ages), str(rng.randrange(900))) for _ in range(400)],
        "race": [(f"L{rng.randrange(7)}", rng.choice(races), str(rng.randrange(900))) for _ in range(200)],
        "gender": [(f"L{rng.randrange(5)}", rng.choice(["Male", "Female"]), "7") for _ in range(50)],
    }
    families = [
        reshape.Family(spark.createDataFrame(r, "Location string, c string, Population string"), "c", p, sorted({c for _, c, _ in r}))
        for p, r in panels.items()
    ]
    wide = reshape.category_means_wide(families)
    means = reshape.family_means(families)
    compact = measures.demographic_counts(means, {"gender": ["Female", "Male"]})
    sums = measures.tier_counts(wide)
    from exposia.functions.numeric import row_sum

    rest = row_sum(cleaning.with_prefix(wide, "race", but=["race_white"])).alias("race_peopleofcolor")
    expected = wide.select("Location", *[c.alias(n) for n, c in sums.items()], "gender_female", "gender_male", "race_white", rest)
    left = {r[0]: r[1:] for r in rows(expected, *expected.columns)}
    right = {r[0]: r[1:] for r in rows(compact, *expected.columns)}
    assert left.keys() == right.keys()
    for k in left:
        assert right[k] == pytest.approx(left[k])
        assert left[k][0] >= left[k][1] >= left[k][2] >= left[k][3]


def test_missing_denominator_column_gives_zero_shares(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert rows(measures.add_shares(df, {"s": "a"}, "nothing"), "s") == [(0.0,)]


def skewed(spark):
    """A third of the rows under one key, a third without a key, some that match nothing."""
    data = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}", float(i)) for i in range(3000)]
    left = spark.createDataFrame(data, "id int, code string, v double")
    found = [("hot", "a"), ("hot", "b")] + [(f"k{i}", str(i)) for i in range(40)] + [(None, "never")]
    return left, spark.createDataFrame(found, "key string, fact string")


@pytest.mark.parametrize("options", [{}, {"small": False}, {"small": True}, {"salted": True}])
def test_every_join_strategy_gives_the_same_rows(spark, options, monkeypatch):
    monkeypatch.setattr(joins.salted_left_join, "__kwdefaults__", {"condition": None, "max_hot": 20, "min_rows": 50})
    left, right = skewed(spark)
    plain = left.join(right, left.code == right.key, "left").select("id", "code", "v", "fact")
    got = joins.left_lookup(left, right, [("code", "key")], **options)
    assert got.columns == ["id", "code", "v", "fact"]
    assert rows(got, *got.columns) == rows(plain, *plain.columns)


def test_hot_keys_are_found_and_split(spark):
    left, _ = skewed(spark)
    hot = {r.code: r._pieces for r in joins.hot_keys(left, ["code"], max_hot=20, min_rows=50).collect()}
    assert hot == {"hot": 10}


def test_salting_spreads_a_hot_key_over_tasks(spark):
    left, right = skewed(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        renamed = right.withColumnRenamed("key", "_k")
        joined = joins.salted_left_join(left, renamed, [("code", "_k")], max_hot=20, min_rows=50)
        shares = joined.filter("code = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        none = joined.filter("code is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) > 1 and len(none) > 1


def test_lookup_refuses_columns_on_both_sides(spark):
    left, right = skewed(spark)
    with pytest.raises(ValueError, match="both sides"):
        joins.left_lookup(left, right.withColumn("v", F.lit(1)), [("code", "key")])


@pytest.fixture
def lookups(spark):
    left = [(i, f"c{i % 7}" if i % 4 else None, f"note {i}") for i in range(4000)]
    one = [("c1", 1.0), ("c2", 2.0), ("c2", 2.5), ("c9", 9.0), (None, 0.0)]
    two = [(" c2 ", "x"), ("c2", "y"), ("c3", None), ("c1 ", "z"), (None, "n")]
    return (
        spark.createDataFrame(left, "id int, code string, note string"),
        spark.createDataFrame(one, "key string, a double"),
        spark.createDataFrame(two, "name string, b string"),
    )


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_aligned_lookups_give_what_a_chain_of_joins_gives(spark, lookups, threshold):
    left, one, two = lookups
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        aligned = joins.aligned_lookups({"one": (one, "key"), "two": (two, F.trim("name"))})
        found = joins.join_aligned(left, "code", aligned, {"one": ["a"], "two": ["b"]})
        chain = left.join(one, left["code"] == one["key"], "left").join(two, left["code"] == F.trim(two["name"]), "left")
        columns = ["id", "code", "note", "a", "b"]
        assert found.columns == columns and rows(found, *columns) == rows(chain, *columns)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join ") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    empty = joins.aligned_lookups({"one": (one.limit(0), "key"), "two": (two.limit(0), "name")})
    assert joins.join_aligned(left, "code", empty, {"one": ["a"], "two": ["b"]}).filter("a is null and b is null").count() == left.count()
    with pytest.raises(ValueError, match="both sides"):
        joins.join_aligned(left, "code", aligned, {"one": ["a"], "two": ["a"]})


def test_rows_without_a_code_are_spread(spark, lookups):
    left, one, _ = lookups
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = joins.join_aligned(left, "code", joins.aligned_lookups({"one": (one, "key")}), {"one": ["a"]})
        parts = found.filter("code is null").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == 1000 and max(r["count"] for r in parts) < 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_override_by_map_and_by_join(spark):
    df = spark.createDataFrame([("1", "A"), ("2", "B"), (None, "C")], "k string, t string")
    small = cleaning.override(df, "k", "t", {"1": "X"})
    assert rows(small, "k", "t") == [("1", "X"), ("2", "B"), (None, "C")]
    large = cleaning.override(df, "k", "t", {str(i): "Y" for i in range(1, 400, 2)})
    assert rows(large, "k", "t") == [("1", "Y"), ("2", "B"), (None, "C")]
    assert rows(cleaning.override(df, "k", "t", {}), "t") == [("A",), ("B",), ("C",)]


def test_name_attributes(spark):
    data = [("10000826", "AVENAL STATE PRISON (XYZ)"), ("1", "Oak Camp (KVSP) (East)"), ("2", None)]
    df = spark.createDataFrame(data, "facilityid string, name string")
    got = cleaning.extract_name_attributes(df, tables.CODE_OVERRIDES)
    assert rows(got, "facilityid", "cdcr_code", "cdcr_firecamp", "name") == [
        ("1", "KVSP", True, "Oak Camp"),
        ("10000826", "ASP", False, "AVENAL STATE PRISON"),
        ("2", None, False, None),
    ]
    campus = spark.createDataFrame([("1", "NORTH CAMPUS"), ("2", "Oak Camp 5")], "facilityid string, name string")
    loose = cleaning.extract_name_attributes(campus, {})
    strict = cleaning.extract_name_attributes(campus, {}, flag_pattern=r"(?i)\bcamp\b")
    assert rows(loose, "cdcr_firecamp") == [(True,), (True,)]
    assert rows(strict, "facilityid", "cdcr_firecamp") == [("1", False), ("2", True)]


def test_schema_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="not found"):
        cleaning.drop_columns(df, ["a", "zip"])
    with pytest.raises(ValueError, match="collide"):
        cleaning.lower_columns(df.toDF("X", "x"))
    assert cleaning.with_capacity(df.toDF("population", "b")).columns == ["population", "b"]


def test_scaling_of_constant_empty_and_gappy_columns(spark):
    data = [(7.0, None, 1.0, 2), (None, None, 5.0, 4), (7.0, None, None, 3)]
    df = spark.createDataFrame(data, "k double, n double, v double, i int")
    got = scaling.min_max_scale(df, ["k", "n", "v", "i"])
    assert rows(got, "k_norm", "n_norm", "v_norm", "i_norm") == [
        (0.0, None, 0.0, 0.0),
        (0.0, None, 100.0, 100.0),
        (0.0, None, None, 50.0),
    ]
    again = scaling.min_max_scale(got.select("v_norm"), ["v_norm"])
    assert rows(again, "v_norm", "v_norm_norm") == [(0.0, 0.0), (100.0, 100.0), (None, None)]


def test_scaling_needs_no_join_and_no_ordering(spark):
    df = scaling.min_max_scale(spark.range(100).selectExpr("id * 1.0d as v"), ["v"])
    plan = df._jdf.queryExecution().toString()
    assert "Subquery" in plan and "Join" not in plan and "Window" not in plan


def test_describe_matches_the_exact_definition(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    r = reshape.describe(df, "v").first()
    assert (r["count"], r.p25, r.p50, r.p75, r.min, r.max) == (3, 1.5, 2.0, 3.0, 1.0, 4.0)
    assert r["std"] == pytest.approx(1.52753, abs=1e-5)
    empty = reshape.describe(df.filter("v is null"), "v").first()
    assert empty["count"] == 0 and empty.p50 is None


def test_quantiles_with_hot_values_over_many_ranges(spark):
    import numpy as np

    rng = random.Random(3)
    data = [5.0] * 4000 + [rng.random() * 10 for _ in range(5000)] + [1e300]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(v,) for v in data], "v double")
        probabilities = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
        got = list(reshape.exact_quantiles(df, "v", probabilities).first())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == pytest.approx(list(np.quantile(data, probabilities)))


def test_images_keep_the_order_of_doubles(spark):
    rng = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]
    values += [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1.0, e), s * math.inf) for e in range(-1073, 1023, 5) for s in (1, -1)]
    values += [v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(5000)) if not math.isnan(v)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None, math.nan])], "i int, v double")
    got = {r.i: r.image for r in df.select("i", numeric.ordered_image("v").alias("image")).collect()}

    def image(v):
        size = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        return -size if v < 0 else size

    assert [got[i] for i in range(len(values))] == [image(v) for v in values]
    assert got[len(values)] is None and got[len(values) + 1] is None
    assert [numeric.from_ordered_image(got[i]) for i in range(len(values))] == values


@pytest.mark.parametrize("small", [1, 50, 10_000])
@pytest.mark.parametrize("partitions", ["1", "200"])
def test_radix_selection_finds_every_rank(spark, small, partitions):
    rng = random.Random(7)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), 3.0, -2.5, rng.random() * 1e-300]) for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = reshape.selected(df.select(numeric.ordered_image("v").alias("image")), range(0, 900, 61), 900, small)
        summary = reshape.describe(df, "v").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(values)
    assert {r: numeric.from_ordered_image(v) for r, v in found.items()} == {r: ordered[r] for r in range(0, 900, 61)}
    assert [summary[q] for q in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)


def test_describe_reads_its_frame_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(float(i),) for i in range(300)], "v double")
    counted = df.mapInPandas(lambda frames: (seen.add(len(f)) or f for f in frames), "v double")
    assert reshape.describe(counted, "v").first().asDict() == pytest.approx(reshape.describe(df, "v").first().asDict())
    assert seen.value == 300


def test_value_counts_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in reshape.value_counts(df, "v").collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_observed_count_rides_along(spark):
    df, seen = cleaning.observed(spark.range(12), "seen")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 12


REGIONS = [
    ("hole", SQUARE_WITH_HOLE),
    ("parts", TWO_PARTS),
    ("wide", [[box(-30.0, 20.0, 55.0, 23.0)]]),
    ("slim", [[[[20.0, -9.0], [21.0, 30.0], [22.0, -9.0], [20.0, -9.0]]]]),
    ("empty", []),
    ("none", None),
]


def brute_force(points):
    def within(shape, px, py):
        odd = False
        for polygon in shape or []:
            for ring in polygon:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    if (y1 > py) != (y2 > py) and px < x1 + (x2 - x1) * (py - y1) / (y2 - y1):
                        odd = not odd
        return odd

    return [(i, name) for i, x, y in points if x is not None for name, s in REGIONS if within(s, x, y)]


@pytest.mark.parametrize("cell", [0.7, 5.0, 300.0])
@pytest.mark.parametrize("small", [True, False, None])
def test_regions_match_brute_force(spark, cell, small):
    rng = random.Random(11)
    points = [(i, rng.uniform(-35, 60), rng.uniform(-12, 32)) for i in range(800)]
    points += [(900 + i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(300)] + [(5000, None, None)]
    regions = spark.createDataFrame(REGIONS, f"rid string, geometry {SHAPE}")
    left = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = spatial.join_regions(left, regions, region_id="rid", cell=cell, small=small)
    found = [(r.id, r.rid) for r in got.select("id", "rid").collect()]
    assert sorted(f for f in found if f[1]) == sorted(brute_force(points))
    assert {i for i, _ in found} == {p[0] for p in points}

    assigned = spatial.assign_region(left, regions, key="id", region_id="rid", cell=cell, small=small)
    best = {}
    for i, name in brute_force(points):
        best[i] = min(name, best.get(i, name))
    assert {r.id: r.tract_geoid for r in assigned.collect()} == {p[0]: best.get(p[0]) for p in points}


def test_regions_without_adaptive_execution(spark, monkeypatch):
    monkeypatch.setattr(joins.salted_left_join, "__kwdefaults__", {"condition": None, "max_hot": 20, "min_rows": 10})
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(300)] + [(500, None, 1.0), (501, 90.0, 90.0)]
    regions = spark.createDataFrame(REGIONS, f"rid string, geometry {SHAPE}")
    left = spark.createDataFrame(points, "id int, longitude double, latitude double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = spatial.join_regions(left, regions, region_id="rid", cell=5.0, small=False)
        found = [(r.id, r.rid) for r in got.select("id", "rid").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(f for f in found if f[1]) == sorted(brute_force(points))
    assert {i for i, _ in found} == {p[0] for p in points}


@pytest.fixture(scope="module")
def country(spark):
    """A jagged outline of 3,000 edges that covers about 40,000 cells, with a lake in it."""
    rng = random.Random(12)
    turn = [2 * math.pi * k / 3000 for k in range(3000)]
    outline = [[r * math.cos(t), r * math.sin(t)] for t in turn for r in [100 + rng.random()]]
    lake = [[30 + 20 * math.cos(t), 20 * math.sin(t)] for t in turn[::50]]
    shape = [[[*outline, outline[0]], [*lake, lake[0]]]]
    return spark.createDataFrame([("land", shape), ("farm", [[box(-5.0, -5.0, 5.0, 5.0)]])], f"rid string, geometry {SHAPE}"), shape


def test_inner_cells_carry_no_edges(spark, country):
    regions, shape = country
    outlines = spatial.region_outlines(regions.filter("rid = 'land'"), "rid")
    cells = spatial.region_cells(outlines, "rid", 1.0, spread=True)
    inner, border = (cells.filter(t).agg(F.count(F.lit(1)), F.sum(F.size("_edges"))).first() for t in ("_inner", "not _inner"))
    assert inner[0] > 25_000 and inner[1] is None
    assert 700 < border[0] < 4000 and border[1] < 300_000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = spatial.region_cells(outlines, "rid", 1.0, spread=True).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < inner[0] / 3


def test_a_large_outline_and_a_crowded_cell(spark, country):
    regions, shape = country
    rng = random.Random(13)
    points = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(2000)]
    points += [(5000 + i, 30 + 20.5 * math.cos(i), 20.5 * math.sin(i)) for i in range(500)]
    points += [(9000 + i, 2 + rng.random(), 3 + rng.random()) for i in range(1300)]  # a third in one cell
    left = spark.createDataFrame(points, "id int, longitude double, latitude double")

    def within(px, py, rings):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > py) != (y2 > py) and px < x1 + (x2 - x1) * (py - y1) / (y2 - y1):
                    odd = not odd
        return odd

    want = {(i, "land") for i, x, y in points if within(x, y, shape[0])} | {(i, "farm") for i, x, y in points if abs(x) < 5 and abs(y) < 5}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    defaults = joins.salted_left_join.__kwdefaults__
    joins.salted_left_join.__kwdefaults__ = {"condition": None, "max_hot": 100, "min_rows": 50}
    try:
        joined = spatial.join_regions(left, regions, region_id="rid", cell=1.0)
        assert {(r.id, r.rid) for r in joined.collect() if r.rid} == want
        crowded = joined.filter("id >= 9000").groupBy(F.spark_partition_id()).count().collect()
        assert len(crowded) == 8 and max(r["count"] for r in crowded) < 2600 / 2
    finally:
        joins.salted_left_join.__kwdefaults__ = defaults
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.id, r.rid) for r in spatial.join_regions(left, regions, region_id="rid", cell=25.0).collect() if r.rid} == want


def test_regions_in_another_coordinate_system(spark):
    regions = spark.createDataFrame([("r", [[box(-13_200_000.0, 4_000_000.0, -13_100_000.0, 4_100_000.0)]])], f"rid string, geometry {SHAPE}")
    points = spark.createDataFrame([(1, -118.25, 34.05), (2, 0.0, 0.0)], "id int, longitude double, latitude double")
    got = spatial.join_regions(points, regions, region_id="rid", regions_crs="EPSG:3857", cell=0.1)
    assert rows(got, "id", "rid") == [(1, "r"), (2, None)]


def test_cell_size_follows_the_units(spark):
    assert spatial.default_cell("EPSG:4326") == 0.05 and spatial.default_cell("EPSG:3857") == 5000.0
    with pytest.raises(ValueError, match="cell size"):
        spatial.default_cell(None)


def test_centroid_of_a_convex_shape_lies_inside(spark):
    df = spark.createDataFrame([("a", [[box(-118.0, 34.0, -117.0, 35.0)]])], f"rid string, geometry {SHAPE}")
    placed = spatial.with_centroid(df)
    assert rows(spatial.join_regions(placed.drop("geometry", "rid"), df, region_id="rid"), "rid") == [("a",)]


def test_salting_deals_rows_that_differ_only_in_nested_columns(spark):
    left = spark.range(4000).selectExpr(
        "'hot' as left_k", "array(id) as list", "struct(id as i) as pair", "cast(string(id) as binary) as raw"
    )
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_left_join(left, right, [("left_k", "k")], max_hot=10, min_rows=100)
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("v").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(t.n for t in tasks) == 4000
    assert max(t.n for t in tasks) < 4000
