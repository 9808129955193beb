"""The tables end to end from files, and the shape of the physical plans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F, types as T

from catalog.queries import QUERIES
from exposia import Inputs, build, publish, published, schemas
from exposia.operators import measures
from exposia.plans import tables
from exposia.sources.delimited import read_csv
from exposia.sources.geojson import read_geojson
from exposia.sources.layers import write_layer
from test_functions import box

SF = "/root/testdata/sf0.001"


def feature(properties, shape):
    kind = "Polygon" if len(shape) == 1 else "MultiPolygon"
    coordinates = shape[0] if len(shape) == 1 else shape
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def facility(key, name, kind, x, y, population=-999, capacity=-999, state="CA", status="OPEN"):
    values = {f.name: "-" for f in schemas.BOUNDARY_PROPERTIES.fields}
    values |= {
        "FACILITYID": key, "NAME": name, "ADDRESS": "1 PRISON RD", "CITY": "O'NEALS", "STATE": state, "STATUS": status,
        "TYPE": kind, "POPULATION": population, "CAPACITY": capacity,
    }
    return feature(values, [[box(x, y, x + 0.01, y + 0.01)]])


FACILITIES = [
    facility("10000826", "AVENAL STATE PRISON", "STATE", -119.5, 36.5, 3000, 2000),
    facility("10000845", "OAK CONSERVATION CAMP #5 (FSP)", "COUNTY", -118.5, 36.5),
    facility("10000900", "CALIFORNIA MEN'S COLONY (CMC) (EAST)", "STATE", -118.5, 35.5, 10, 0),
    facility("10000901", "COUNTY JAIL", "COUNTY", -100.0, 36.5, 30, 60),
    facility("10000902", "CLOSED JAIL", "COUNTY", -118.5, 36.5, status="CLOSED"),
    facility("10000903", "NEVADA JAIL", "COUNTY", -118.5, 36.5, state="NV"),
]
TRACTS = [
    feature({"GEOID": "06001000100"}, [[box(-120.0, 36.0, -119.0, 37.0)]]),
    feature({"GEOID": "06001000200"}, [[box(-119.0, 36.0, -118.0, 37.0)], [box(-119.0, 35.0, -118.0, 35.9)]]),
    feature({"GEOID": "06001000300"}, [[box(-110.0, 36.0, -109.0, 37.0)]]),
]
SCREENING = [
    {"tract": 6001000100, "PollutionP": 10.0, "ozoneP": 20.0, "pmP": 40.0, "dieselP": None},
    {"tract": 6001000200, "PollutionP": 90.0, "ozoneP": 80.0, "pmP": 80.0, "dieselP": 80.0},
    {"tract": 6001009900, "PollutionP": 1.0, "ozoneP": 1.0, "pmP": 1.0, "dieselP": 1.0},
]
FILES = {
    "averages": "Facility_Name,Facility_Code,Average_2025_Population\r\nAvenal,ASP,1000\r\nFolsom,FOL,400\r\n",
    "metadata": ",".join(schemas.FACILITY_METADATA.names) + '\r\nASP,1987,"a, b",Yes,,,\r\nFSP,1880,,,Yes,Yes,\r\n',
    "age": 'Year,Month,Location,Age Group,Population\r\n2025,Jan,ASP,50-54 Years,100\r\n2025,Feb,ASP,50-54 Years,300\r\n'
    "2025,Jan,ASP,65-69 Years,50\r\n2025,Jan,ASP,18-24 Years,900\r\n",
    "gender": 'Year,Month,Location,Gender,Population\r\n2025,Jan,ASP,Male,"1,200"\r\n2025,Jan,ASP,Female,(Blank)\r\n'
    "2025,Jan,FOL,Male,200\r\n2025,Jan,FOL,Female,*\r\n",
    "race": "Year,Month,Location,Race,Population\r\n2025,Jan,ASP,White,250\r\n2025,Jan,ASP,Black,300\r\n2025,Jan,ASP,Other,**\r\n",
    "heat_days": ",".join(schemas.HEAT_DAYS.names)
    + "\r\n06001000100,1,2,10,30,5,6\r\n06001000200,1,2,50,60,5,6\r\n06001000300,1,2,30,45,5,6\r\n",
}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    paths = {}
    for name, content in FILES.items():
        paths[name] = str(folder / f"{name}.csv")
        (folder / f"{name}.csv").write_bytes(content.encode())
    layers = {"boundaries": FACILITIES, "tracts": TRACTS, "screening": [feature(p, [[box(0, 0, 1, 1)]]) for p in SCREENING]}
    for name, features in layers.items():
        paths[name] = str(folder / f"{name}.geojson")
        (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return paths


@pytest.fixture(scope="module")
def built(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("built") / "out")
    return build(spark, Inputs(**inputs), out), out


def by_key(df, key="facilityid"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_facilities_from_files(built):
    got = by_key(built[0]["facilities"])
    assert set(got) == {"10000826", "10000845", "10000900", "10000901"}
    avenal = got["10000826"]
    assert (avenal["name"], avenal["city"], avenal["tract_geoid"]) == ("Avenal State Prison", "O'Neals", "06001000100")
    assert avenal["longitude"] == pytest.approx(-119.495) and avenal["latitude"] == pytest.approx(36.505, abs=1e-4)
    assert avenal["capacity_percent"] == 1.5
    assert (got["10000845"]["type"], got["10000845"]["population"]) == ("STATE", None)
    assert (got["10000900"]["capacity_percent"], got["10000900"]["tract_geoid"]) == (None, "06001000200")
    assert got["10000901"]["tract_geoid"] is None
    assert not {"fid", "zip4", "naics_code"} & set(avenal) and "telephone" in avenal


def test_state_facilities_from_files(built):
    table = built[0]["state_facilities"]
    got = by_key(table)
    assert set(got) == {"10000826", "10000845", "10000900"}
    asp, fol, cmc = got["10000826"], got["10000845"], got["10000900"]
    assert (asp["cdcr_code"], asp["average_2025_population"], asp["capacity_percent_2025"]) == ("ASP", 1000.0, 0.5)
    assert [asp[f"age_over_{t}_pct"] for t in measures.AGE_TIERS] == [0.25, 0.05, 0.05, 0.05]
    assert (asp["gender_male_pct"], asp["gender_female_pct"]) == (1.0, 0.0)
    assert (asp["race_white_pct"], asp["race_peopleofcolor_pct"]) == (0.25, 0.325)
    assert (asp["year_opened"], asp["year_opened_notes"], asp["reentry_hub"]) == (1987, "a, b", "Yes")
    # One code under two names: shown as found, joined as one.
    assert (fol["cdcr_code"], fol["cdcr_firecamp"], fol["name"]) == ("FSP", True, "Oak Conservation Camp #5")
    assert (fol["average_2025_population"], fol["gender_male_pct"], fol["gender_female_pct"]) == (400.0, 0.5, 0.0125)
    assert (fol["age_over_50_pct"], fol["year_opened"], fol["california_model_facility"]) == (0.0, 1880, "Yes")
    assert (cmc["cdcr_code"], cmc["name"], cmc["average_2025_population"]) == ("CMC", "California Men'S Colony", None)
    assert (cmc["age_over_50_pct"], cmc["gender_male_pct"], cmc["year_opened"]) == (0.0, 0.0, None)
    assert table.columns[-18:] == [
        "cdcr_code", "cdcr_firecamp", "average_2025_population", "capacity_percent_2025",
        *[f"age_over_{t}_pct" for t in (50, 55, 60, 65)], "gender_female_pct", "gender_male_pct",
        "race_white_pct", "race_peopleofcolor_pct", "year_opened", "year_opened_notes", "reentry_hub",
        "planned_closure", "california_model_facility", "cdcr_air_cooling_pilot",
    ]
    assert by_key(tables.population_difference(table))["10000826"]["pop_diff"] == 2000.0


def test_hazard_and_exposure_from_files(built):
    got = by_key(built[0]["heat_air_hazard"], "geoid")
    assert set(got) == {"06001000100", "06001000200", "06001000300"}
    first, second, third = (got[f"06001000{i}00"] for i in (1, 2, 3))
    assert (first["AQI_norm"], second["AQI_norm"], third["AQI_norm"]) == (0.0, 100.0, None)
    assert (first["heat_hazard_idx_norm"], second["heat_hazard_idx_norm"], third["heat_hazard_idx_norm"]) == (0.0, 100.0, 50.0)
    assert (third["delta_90"], third["PollutionP"]) == (15.0, None)
    exposed = by_key(built[0]["facility_exposure"])
    assert len(exposed) == 4
    assert exposed["10000900"]["heat_hazard_idx_norm"] == 100.0 and exposed["10000901"]["heat_hazard_idx_norm"] is None


def test_written_tables_read_back(spark, built):
    table, out = built[0]["facilities"], built[1]
    text = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "geometry" else f.dataType) for f in table.schema.fields
    ])
    back = by_key(read_csv(spark, published(spark, out).paths["facilities"], text))
    assert back["10000826"]["geometry"].startswith("MULTIPOLYGON (((-119.5 36.5,")
    assert back["10000826"]["longitude"] == by_key(table)["10000826"]["longitude"]


def test_layers_as_parquet_give_the_same_tables(spark, built, tmp_path, inputs):
    properties = {"boundaries": schemas.BOUNDARY_PROPERTIES, "tracts": schemas.TRACT_PROPERTIES, "screening": schemas.SCREENING_PROPERTIES}
    paths = dict(inputs)
    for name, kind in properties.items():
        paths[name] = str(tmp_path / name)
        write_layer(read_geojson(spark, inputs[name], kind), paths[name])
    again = build(spark, Inputs(**paths), str(tmp_path / "out"), layout="parquet")
    assert again.counts == built[0].counts
    for name in ("facilities", "facility_exposure", "heat_air_hazard"):
        left, right = (sorted(map(repr, t[name].collect())) for t in (again, built[0]))
        assert left == right


def test_counts_come_with_the_build(spark, built):
    tables_, out = built
    assert tables_.counts == {name: table.count() for name, table in tables_.items()}
    last = published(spark, out)
    assert (last.run, last.paths, last.counts) == (tables_.run, tables_.paths, tables_.counts)


def test_a_broken_run_publishes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    good, bad = spark.range(5), spark.range(9).select(F.assert_true(F.col("id") < 4).alias("x"), "id")
    with pytest.raises(Exception):
        publish(spark, {"first": good, "second": bad}, out)
    with pytest.raises(Exception):
        published(spark, out)
    one = publish(spark, {"first": good, "second": good}, out)
    with pytest.raises(Exception):
        publish(spark, {"first": spark.range(7), "second": bad}, out)
    assert published(spark, out).run == one.run and published(spark, out).counts == {"first": 5, "second": 5}
    two = publish(spark, {"first": spark.range(7)}, out)
    assert published(spark, out).run == two.run
    assert read_csv(spark, published(spark, out).paths["first"], spark.range(0).schema).count() == 7


def test_sentinels_of_hazard_layers_are_optional(spark):
    heat = spark.createDataFrame([("1", *[float(i)] * 6) for i in (1, 2)] + [("1", *[3.0] * 6)], schemas.HEAT_DAYS)
    screen = spark.createDataFrame([("1", -999.0, -999.0, 4.0, 6.0)], schemas.SCREENING_PROPERTIES)
    heat = heat.withColumn("GEOID", F.lit("00000000001"))
    plain = tables.heat_air_hazard(heat, screen).first()
    cleaned = tables.heat_air_hazard(heat, screen, sentinels=[-999], all_columns=True).first()
    assert plain.PollutionP == -999.0 and cleaned.PollutionP is None and cleaned.AQI == 5.0
    assert "delta_100" in cleaned.asDict() and "days_over_80_historic_norm" in cleaned.asDict()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_stay_on_native_operators(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval", "MapInPandas"):
        assert operator not in plan


def scan_of(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return plan, next(line for line in plan.splitlines() if "FileScan" in line)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        _, scan = scan_of(spark, "q01_filter_project")
        assert "EqualTo(o_orderstatus,F)" in scan and "EqualTo(o_orderpriority,1-URGENT)" in scan
        plan, scan = scan_of(spark, "q13_mean_pivot")
        assert "l_extendedprice" not in scan and "l_shipdate" not in scan
        # One shuffle for the means; the second moves only the averages.
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", ["q10_clipped_floored_share", "q15_cumulative_tiers", "q16_one_vs_rest", "q34_state_facility_table"])
def test_lookups_meet_facilities_in_one_join(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin ") == 1 and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
