"""The queries: each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catalog import standins as st
from exposia import schemas
from exposia.functions import geometry as geo, numeric, text
from exposia.operators import cleaning, joins, measures, reshape, scaling, spatial
from exposia.plans import tables
from exposia.sources.delimited import accepted, quarantined, read_csv, read_csv_by_name, write_csv
from exposia.sources.geojson import feature_collections, feature_lines, read_geojson
from exposia.sources.layers import read_layer, write_layer
from exposia.sources.staging import materialize, scratch_path

POPULATION = "average_2025_population"


def filter_project(spark: SparkSession, sf: str) -> DataFrame:
    orders = cleaning.keep_equal(
        st.table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT"
    )
    priced = cleaning.drop_columns(orders, ["o_orderdate", "o_orderstatus", "o_orderpriority"])
    return priced.withColumn("doubled", F.col("o_totalprice") * 2)


def state_filter_after_override(spark: SparkSession, sf: str) -> DataFrame:
    named = cleaning.lower_columns(st.boundaries(spark, sf).select("FACILITYID", "TYPE"))
    return tables.state_facilities_base(
        cleaning.override(named, "facilityid", "type", tables.REVIEWED_TYPES)
    )


def title_case(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "documents").select("doc_id", text.title_case("text").alias("titled"))


def paren_code(spark: SparkSession, sf: str) -> DataFrame:
    names = cleaning.lower_columns(st.boundaries(spark, sf).select("FACILITYID", "NAME"))
    return cleaning.extract_name_attributes(names, tables.CODE_OVERRIDES)


def missing_names(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.extract_name_attributes(st.unnamed(spark, sf), tables.CODE_OVERRIDES)


def paren_text(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "pages").select(
        "page_id",
        text.parenthesised_code("html").alias("code"),
        text.without_parentheses("html").alias("rest"),
        text.contains_ignoring_case("html", "script").alias("has_script"),
    )


def zero_pad_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey") * 7919
    return st.table(spark, sf, "customer").select(
        "c_custkey",
        text.zero_pad(text.key_text(key), 7).alias("padded"),
        text.zero_pad(text.key_text(key.cast("double"), "double"), 11).alias("padded_number"),
        text.zero_pad("c_name", 11).alias("kept_whole"),
    )


def trimmed_text(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), "role", F.lit(" "), "text", F.lit("\r\n "))
    return st.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.trim_ws(padded).alias("trimmed")
    )


def sentinel_to_null(spark: SparkSession, sf: str) -> DataFrame:
    named = cleaning.lower_columns(
        st.boundaries(spark, sf).select("FACILITYID", "POPULATION", "CAPACITY")
    )
    return cleaning.with_capacity(named)


def column_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Steps on frames that lack a column: no ratio, a share of 0, other columns cleaned all the same."""
    named = cleaning.lower_columns(st.boundaries(spark, sf).select("FACILITYID", "POPULATION"))
    cleaned = cleaning.with_capacity(named).withColumn("people", F.col("population"))
    return measures.add_shares(cleaned, {"share": "people"}, POPULATION)


def suppressed_counts(spark: SparkSession, sf: str) -> DataFrame:
    printed = st.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{st.COUNT_TEXT} as printed"
    )
    return printed.select(
        "l_orderkey", "l_linenumber", numeric.parse_suppressed("printed").alias("population")
    )


def plain_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numeric.ratio("l_tax", "l_discount").alias("tax_per_discount"),
        numeric.ratio(F.nullif("l_discount", F.lit(0.05)), "l_quantity").alias("discount_per_unit"),
    )


def override_map(spark: SparkSession, sf: str) -> DataFrame:
    named = st.table(spark, sf, "orders").select(
        F.col("o_orderkey"), (F.col("o_custkey") + 10_000_000).cast("string").alias("key"), "o_orderpriority"
    )
    return cleaning.override(named, "key", "o_orderpriority", tables.REVIEWED_TYPES)


def schema_operators(spark: SparkSession, sf: str) -> DataFrame:
    wide = st.table(spark, sf, "part").withColumns(
        {"Race_White": F.col("p_size"), "Race_Other": F.col("p_partkey"), "Age_Old": F.lit(1)}
    )
    lowered = cleaning.lower_columns(wide)
    others = cleaning.with_prefix(lowered, "race", but=["race_white"])
    wanted = cleaning.existing(lowered, ["p_partkey", "not_there", "age_old"])
    return lowered.select(*wanted, *others).withColumns(
        {"code": F.lit(None).cast("string"), "flag": F.lit(False)}
    )


def _coded(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    """Facilities with code, cleaned capacity and average population, and with counts if there are any."""
    named = cleaning.lower_columns(
        st.boundaries(spark, sf).select("FACILITYID", "NAME", "POPULATION", "CAPACITY")
    )
    coded = cleaning.extract_name_attributes(cleaning.with_capacity(named), {})
    if counts is None:
        return tables.with_population(coded, st.averages(spark, sf), "cdcr_code")
    known = coded.select("facilityid", "cdcr_code")
    return tables.with_lookups(known, "cdcr_code", averages=st.averages(spark, sf), counts=counts)


def _families(spark: SparkSession, sf: str, *prefixes: str) -> list[reshape.Family]:
    known = {
        "age": (st.age_panel, "Age Group", st.AGE_BANDS),
        "cob": (st.birth_country_panel, "Country of Birth", st.COUNTRIES),
        "gender": (st.gender_panel, "Gender", st.GENDERS),
        "race": (st.race_panel, "Race", st.RACES),
    }
    chosen = [(p, *known[p]) for p in prefixes]
    return [reshape.Family(panel(spark, sf), name, p, values) for p, panel, name, values in chosen]


def clipped_floored_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = reshape.category_means_wide(_families(spark, sf, "gender"))
    facilities = _coded(spark, sf, counts)
    return measures.family_shares(facilities, "gender", POPULATION, clipped=True, smallest=measures.SMALL_SHARE)


def small_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = st.small_counts(spark, sf)
    return measures.add_shares(counts, {"share": "people"}, "population", clipped=True, smallest=measures.SMALL_SHARE)


def lookup_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return _coded(spark, sf).select(
        "facilityid", "cdcr_code", "capacity", POPULATION, "capacity_percent_2025"
    )


def metadata_enrich(spark: SparkSession, sf: str) -> DataFrame:
    named = cleaning.lower_columns(st.boundaries(spark, sf).select("FACILITYID", "NAME"))
    coded = cleaning.extract_name_attributes(named, {}).select("facilityid", "cdcr_code")
    return tables.with_metadata(coded, st.metadata(spark, sf), "cdcr_code", st.ALIASES)


def mean_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.category_means_wide(_families(spark, sf, "race"))


def category_means(spark: SparkSession, sf: str) -> DataFrame:
    panel = reshape.clean_counts(st.age_panel(spark, sf))
    means = reshape.category_means(panel, ["Location", "Age Group"], "Population", "mean_count")
    return means.withColumnRenamed("Age Group", "age_group")


def align_families(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.category_means_wide(_families(spark, sf, "age", "cob", "gender", "race"))


def cumulative_tiers(spark: SparkSession, sf: str) -> DataFrame:
    counts = reshape.category_means_wide(_families(spark, sf, "age"))
    return measures.tier_shares(_coded(spark, sf, measures.tier_sums(counts)), POPULATION)


def one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    counts = reshape.category_means_wide(_families(spark, sf, "race"))
    return measures.family_shares(_coded(spark, sf, measures.split_sums(counts)), "race", POPULATION)


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {
        f"delta_{t}": (f"days_over_{t}_midcentury", f"days_over_{t}_historic") for t in tables.THRESHOLDS
    }
    return measures.differences(st.heat_days(spark, sf), pairs).select("GEOID", *pairs)


def population_difference(spark: SparkSession, sf: str) -> DataFrame:
    differing = tables.population_difference(_coded(spark, sf))
    return differing.select("facilityid", "pop_diff")


def min_max(spark: SparkSession, sf: str) -> DataFrame:
    items = st.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    return scaling.min_max_scale(items, ["l_extendedprice", "l_quantity"])


def min_max_constant_and_null(spark: SparkSession, sf: str) -> DataFrame:
    built = st.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 != 0, F.lit(7.0)).alias("constant"),
        F.lit(None).cast("double").alias("absent"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("gaps"),
    )
    return scaling.min_max_scale(built, ["constant", "absent", "gaps"])


def row_mean(spark: SparkSession, sf: str) -> DataFrame:
    air = ["ozoneP", "pmP", "dieselP"]
    return st.screening(spark, sf).select(
        "tract", numeric.row_mean(air).alias("mean_air"), numeric.row_sum(air).alias("sum_air")
    )


def composite_index(spark: SparkSession, sf: str) -> DataFrame:
    joined = joins.left_lookup(
        st.heat_days(spark, sf).select("GEOID", "days_over_90_historic"),
        st.screening(spark, sf).withColumn("tract", text.zero_pad(text.key_text("tract"), 11)),
        [("GEOID", "tract")],
    )
    index = scaling.heat_air_index(joined, stage=materialize)
    return index.select(
        "GEOID", "AQI", "AQI_norm", "days_over_90_historic_norm", "heat_hazard_idx", "heat_hazard_idx_norm"
    )


def mercator(spark: SparkSession, sf: str) -> DataFrame:
    points = st.customers(spark, sf)
    x, y = geo.project_xy("longitude", "latitude", geo.WGS84, geo.WEB_MERCATOR)
    metric = points.select("facilityid", x.alias("x"), y.alias("y"))
    lon, lat = geo.project_xy("x", "y", geo.WEB_MERCATOR, geo.WGS84)
    return metric.select(
        "facilityid",
        F.round("x", 3).alias("x"),
        F.round("y", 3).alias("y"),
        F.round(lon, 8).alias("longitude"),
        F.round(lat, 8).alias("latitude"),
    )


def centroid(spark: SparkSession, sf: str) -> DataFrame:
    planar = spatial.with_centroid(st.tracts(spark, sf), crs=None, x="x", y="y")
    globe = spatial.with_centroid(planar, crs=geo.WGS84)
    return globe.select(
        "GEOID",
        F.round("x", 8).alias("x"),
        F.round("y", 8).alias("y"),
        F.round("longitude", 7).alias("longitude"),
    )


def hole_centroid(spark: SparkSession, sf: str) -> DataFrame:
    placed = spatial.with_centroid(st.squares_with_a_hole(spark, sf), crs=None, x="x", y="y")
    return placed.select("GEOID", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


def footprint_centre(spark: SparkSession, sf: str) -> DataFrame:
    named = cleaning.lower_columns(st.boundaries(spark, sf).select("FACILITYID", "geometry"))
    return spatial.with_centroid(named).select(
        "facilityid", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude")
    )


def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    joined = spatial.join_regions(
        st.customers(spark, sf), st.tracts(spark, sf).drop("p_partkey"), region_id="GEOID", cell=st.CELL
    )
    return joined.select("facilityid", "GEOID")


def points_on_borders(spark: SparkSession, sf: str) -> DataFrame:
    """Corners and edge points of tracts and of their holes, and points within."""
    joined = spatial.join_regions(
        st.border_points(spark, sf), st.tracts(spark, sf).drop("p_partkey"), region_id="GEOID", cell=st.CELL
    )
    return joined.select("facilityid", "place", "GEOID")


def parquet_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Regions from a layer written along a curve, read only where the points are."""
    path = scratch_path(spark, "layer")
    write_layer(st.tracts(spark, sf).drop("p_partkey"), path)
    placed = spatial.assign_region(st.customers(spark, sf), read_layer(spark, path), cell=st.CELL, result="GEOID", region_id="GEOID")
    return placed.select("facilityid", "GEOID")


def lookup_back(spark: SparkSession, sf: str) -> DataFrame:
    placed = spatial.assign_region(
        st.customers(spark, sf), st.overlapping_tracts(spark, sf), cell=st.CELL
    )
    return placed.select("facilityid", "tract_geoid")


def wkt(spark: SparkSession, sf: str) -> DataFrame:
    return st.tracts(spark, sf).select(
        "GEOID",
        geo.to_wkt(
            F.transform("geometry", lambda polygon: F.transform(polygon, lambda ring: F.transform(
                ring, lambda p: F.transform(p, lambda v: F.round(v, 6))
            )))
        ).alias("wkt"),
    )


def attach_hazards(spark: SparkSession, sf: str) -> DataFrame:
    located = st.customers(spark, sf).withColumn(
        "tract_geoid", F.expr(st.tract_id("(bigint(facilityid) - 10000000) * 3"))
    )
    hazard = st.heat_days(spark, sf).withColumnRenamed("GEOID", "geoid")
    return tables.exposure(located.select("facilityid", "tract_geoid"), hazard)


def describe(spark: SparkSession, sf: str) -> DataFrame:
    summary = reshape.describe(st.table(spark, sf, "lineitem"), "l_extendedprice")
    rounded = [c for c in summary.columns if c != "count"]
    return summary.withColumns({c: F.round(c, 4) for c in rounded})


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = st.table(spark, sf, "events").select(
        F.nullif("event_type", F.lit("error")).alias("event_type")
    )
    return reshape.value_counts(events, "event_type")


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [
        cleaning.row_count(st.table(spark, sf, name)).select(F.lit(name).alias("table_name"), "rows")
        for name in st.TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    source = st.table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit('said "'), "source", F.lit('",\r\nand left')).alias("note"),
        "text",
        (F.col("n_chars") / 7).alias("measure"),
        (F.col("doc_id") % 2 == 0).alias("even"),
    )
    path = scratch_path(spark, "csv")
    write_csv(source, path)
    return read_csv(spark, path, source.schema, multi_line=True)


def panel_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    write_csv(st.gender_panel(spark, sf), path)
    schema = st.gender_panel(spark, sf).schema
    panel = read_csv(spark, path, schema, multi_line=False)
    return panel.groupBy("Location", "Gender").agg(
        F.count("Population").alias("shown"), F.sum(numeric.parse_suppressed("Population")).alias("people")
    )


TRACT_PROPERTIES = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("GEOID", T.StringType()),
        T.StructField("lacking", T.StringType()),
    ]
)


def _outlined(layer: DataFrame) -> DataFrame:
    outlined = layer.withColumn("edges", geo.edges("geometry"))
    return outlined.withColumn("box", geo.bounds("edges")).select(
        "p_partkey",
        "GEOID",
        "lacking",
        F.size("geometry").cast("long").alias("parts"),
        F.size(F.flatten("geometry")).cast("long").alias("rings"),
        F.size("edges").cast("long").alias("points"),
        "box.xmin",
        "box.ymin",
        "box.xmax",
        "box.ymax",
    )


def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows, and as text with their problem those with a cell too many, too few, or of the wrong kind."""
    lines = st.table(spark, sf, "lineitem").selectExpr(f"{st.LINE} as `{st.LINE_HEADER}`")
    path = scratch_path(spark, "lines")
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType())])
    rows = materialize(read_csv_by_name(spark, path, schema), "lines")
    bad = quarantined(rows).groupBy("record", "problem").agg(F.count(F.lit(1)).alias("rows"))
    good = accepted(rows).withColumn("rows", F.lit(1).cast("long"))
    return good.unionByName(bad, allowMissingColumns=True)


def hazard_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The hazard table written and read back; its key keeps its leading zero."""
    table, path = heat_air_hazard_table(spark, sf), scratch_path(spark, "hazard")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


def geojson_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "geojson")
    feature_lines(st.tracts(spark, sf)).write.text(path)
    return _outlined(read_geojson(spark, path, TRACT_PROPERTIES, layout="lines"))


def _collections(spark: SparkSession, layer: DataFrame, key: str) -> list[str]:
    """A layer as collections of 500 features: some on one line each, one after the other, some
    indented, and some features alone."""
    third, group = F.col(key) % 3, F.expr(f"{key} div 500")
    texts = [
        feature_collections(layer.filter(third == 0), group),
        feature_collections(layer.filter(third == 1), group, indented=True),
        feature_lines(layer.filter(third == 2)),
    ]
    paths = [scratch_path(spark, "collections") for _ in texts]
    for path, text_lines in zip(paths, texts):
        text_lines.write.text(path)
    return paths


def geojson_collection(spark: SparkSession, sf: str) -> DataFrame:
    paths = _collections(spark, st.tracts(spark, sf), "p_partkey")
    return _outlined(read_geojson(spark, paths, TRACT_PROPERTIES))


def geojson_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """The screening layer with its shapes left unread."""
    layer = st.screening(spark, sf)
    shape = f"array(array({st.rectangle('0D', '0D', 'double(tract)', '1D')}))"
    layer = layer.withColumn("geometry", F.expr(shape))
    return read_geojson(spark, _collections(spark, layer, "tract"), schemas.SCREENING_PROPERTIES, geometry=False)


def facility_table(spark: SparkSession, sf: str) -> DataFrame:
    table = tables.facilities(
        st.boundaries(spark, sf),
        st.tracts(spark, sf).drop("p_partkey"),
        cell=st.CELL,
        disjoint_tracts=True,
    )
    return table.select(
        "facilityid",
        "name",
        "address",
        "city",
        "type",
        "population",
        "capacity",
        "capacity_percent",
        "tract_geoid",
        F.round("longitude", 8).alias("longitude"),
        F.round("latitude", 8).alias("latitude"),
    )


def _state_facilities(spark: SparkSession, sf: str, **options) -> DataFrame:
    cleaned = cleaning.with_capacity(tables.clean_facilities(st.boundaries(spark, sf)))
    typed = cleaning.override(cleaned, "facilityid", "type", tables.REVIEWED_TYPES)
    base = tables.state_facilities_base(typed).drop("geometry", "telephone", "state", "status", "type")
    table = tables.state_facilities(
        base,
        st.averages(spark, sf),
        st.metadata(spark, sf),
        age=st.age_panel(spark, sf),
        gender=st.gender_panel(spark, sf),
        race=st.race_panel(spark, sf),
        aliases=st.ALIASES,
        **options,
    )
    # Tier sums depend on the order of addition in the last digits.
    return table.withColumns({c: F.round(c, 9) for c, kind in table.dtypes if c.endswith("_pct") and kind == "double"})


def state_facility_table(spark: SparkSession, sf: str) -> DataFrame:
    return _state_facilities(spark, sf, genders=st.GENDERS)


def birth_country_shares(spark: SparkSession, sf: str) -> DataFrame:
    """With the fourth family, whose shares are bounded here, while those of gender are not."""
    table = _state_facilities(
        spark, sf, birth_country=st.birth_country_panel(spark, sf), birth_countries=st.COUNTRIES, bounded=("cob",)
    )
    return table.select("facilityid", "cdcr_code", POPULATION, *[c for c in table.columns if c.startswith(("gender_", "cob_"))])


def share_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Families without declared categories, one row for each that a facility's location has."""
    table = _state_facilities(spark, sf, birth_country=st.birth_country_panel(spark, sf), genders=None, bounded=("cob", "gender"))

    def shares_of(family: str) -> DataFrame:
        found = table.select("facilityid", F.explode(f"{family}_pct").alias("category", "share"))
        return found.withColumn("category", F.concat(F.lit(f"{family}_"), "category"))

    shares = shares_of("cob").union(shares_of("gender"))
    return shares.select("facilityid", "category", F.round("share", 9).alias("share"))


def heat_air_hazard_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.heat_air_hazard(st.heat_days(spark, sf), st.screening(spark, sf))


def exposure_table(spark: SparkSession, sf: str) -> DataFrame:
    """The joined product: facilities with the heat and air hazard of their tract."""
    placed = facility_table(spark, sf).drop("address", "city")
    return tables.exposure(placed, heat_air_hazard_table(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_filter_project": filter_project,
    "q02_state_filter_after_override": state_filter_after_override,
    "q03_title_case": title_case,
    "q04_paren_code": paren_code,
    "q04_paren_text": paren_text,
    "q04_missing_names": missing_names,
    "q05_zero_pad_key": zero_pad_key,
    "q05_trimmed_text": trimmed_text,
    "q06_sentinel_to_null": sentinel_to_null,
    "q06_column_guards": column_guards,
    "q07_suppressed_counts": suppressed_counts,
    "q08_plain_ratio": plain_ratio,
    "q09_override_map": override_map,
    "q09_schema_operators": schema_operators,
    "q10_clipped_floored_share": clipped_floored_share,
    "q10_small_shares": small_shares,
    "q11_lookup_enrich": lookup_enrich,
    "q12_metadata_enrich": metadata_enrich,
    "q13_mean_pivot": mean_pivot,
    "q13_category_means": category_means,
    "q14_align_families": align_families,
    "q15_cumulative_tiers": cumulative_tiers,
    "q16_one_vs_rest": one_vs_rest,
    "q17_deltas": deltas,
    "q17_population_difference": population_difference,
    "q18_min_max": min_max,
    "q19_min_max_constant_and_null": min_max_constant_and_null,
    "q20_row_mean": row_mean,
    "q21_composite_index": composite_index,
    "q22_mercator": mercator,
    "q23_centroid": centroid,
    "q23_hole_centroid": hole_centroid,
    "q23_footprint_centre": footprint_centre,
    "q24_point_in_polygon": point_in_polygon,
    "q24_parquet_layer": parquet_layer,
    "q24_points_on_borders": points_on_borders,
    "q25_lookup_back": lookup_back,
    "q26_wkt": wkt,
    "q27_attach_hazards": attach_hazards,
    "q28_describe": describe,
    "q29_value_counts": value_counts,
    "q30_row_counts": row_counts,
    "q31_csv_roundtrip": csv_roundtrip,
    "q31_panel_csv_scan": panel_csv_scan,
    "q31_hazard_csv": hazard_csv,
    "q31_csv_quarantine": csv_quarantine,
    "q32_geojson_scan": geojson_scan,
    "q32_geojson_collection": geojson_collection,
    "q32_geojson_attributes": geojson_attributes,
    "q33_facility_table": facility_table,
    "q34_state_facility_table": state_facility_table,
    "q34_birth_country_shares": birth_country_shares,
    "q34_share_maps": share_maps,
    "q35_heat_air_hazard_table": heat_air_hazard_table,
    "q36_exposure_table": exposure_table,
}
