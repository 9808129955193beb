"""Inputs of the library derived from the generated tables.

Customers play facilities, parts play census tracts, suppliers play locations, and the rows of
``lineitem`` and ``orders`` play the monthly panels. All of them grow with the tables.

Tract ``k`` has the lower left corner ``(x0, y0)`` of :func:`corner` and a side of ``SIDE`` degrees;
no two tracts share ground. Every third tract is a triangle, a square with a hole, or two strips of
opposite orientation. Customer ``k`` lies in the square of tract ``k``, or far west of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIDE = "1e-4"
CELL = 5e-4
HALF_FOOTPRINT = "2e-6"

AGE_BANDS = (
    "45-49 Years", "50-54 Years", "55-59 Years", "60-64 Years", "65-69 Years", "70-74 Years",
    "75-79 Years", "80-84 Years", "85-89 Years", "90-94 Years",
)
GENDERS = ("Female", "Male")
RACES = ("Black", "Hispanic/Latino", "White")
COUNTRIES = ("El Salvador", "Guinea-Bissau", "Mexico", "US/Canada")

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def corner(k: str) -> tuple[str, str]:
    return (
        f"(-120D + ({k} % 1000000) * {SIDE})",
        f"(-21D + ({k} % 7) * 5 + ({k} div 1000000) * {SIDE})",
    )


def location(k: str) -> tuple[str, str]:
    """Coordinates of facility ``k``, never on a tract border."""
    x0, y0 = corner(k)
    x = f"({x0} + (({k} * 37) % 97 + 0.3D) / 97 * {SIDE} - if({k} % 11 = 0, 50, 0))"
    return x, f"({y0} + (({k} * 53) % 89 + 0.3D) / 89 * {SIDE})"


def rectangle(x1: str, y1: str, x2: str, y2: str, clockwise: bool = False) -> str:
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    ordered = reversed(corners) if clockwise else corners
    return f"array({', '.join(f'array({x}, {y})' for x, y in ordered)})"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility key and point of every customer."""
    x, y = location("c_custkey")
    return table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey + 10000000) as facilityid", f"{x} as longitude", f"{y} as latitude"
    )


def border_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer the point of :func:`customers`, and for the tract of the same number points
    on its outline and, for a square with a hole, on the border of the hole."""
    x, y = location("c_custkey")
    x0, y0 = corner("c_custkey")
    s, hole = SIDE, "c_custkey % 3 = 1"
    places = {
        "point": (x, y),
        "corner": (x0, y0),
        "bottom": (f"{x0} + {s} * 0.3D", y0),
        "left": (x0, f"{y0} + {s} * 0.7D"),
        "top_left": (x0, f"{y0} + {s}"),
        "bottom_right": (f"{x0} + {s}", y0),
        "hole_corner": (f"if({hole}, {x0} + {s} * 0.25D, {x0})", f"if({hole}, {y0} + {s} * 0.75D, {y0})"),
        "hole_edge": (f"if({hole}, {x0} + {s} * 0.4D, {x0})", f"if({hole}, {y0} + {s} * 0.25D, {y0})"),
    }
    rows = ", ".join(f"struct('{name}' as place, {px} as longitude, {py} as latitude)" for name, (px, py) in places.items())
    return table(spark, sf_dir, "customer").selectExpr("string(c_custkey + 10000000) as facilityid", f"inline(array({rows}))")


def small_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts next to populations: a few people, none, too many, fewer than none, or unknown."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then 9000D
           when c_custkey % 5 = 0 then -3D else double(c_custkey % 4) end as people""",
        """case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then 0D
           else double(1000 + (c_custkey * 100) % 3000) end as population""",
    )


def unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility names, every third missing, one of them that of a facility whose code is reviewed."""
    return boundaries(spark, sf_dir).selectExpr(
        "if(FACILITYID = '10000001', '10000826', FACILITYID) as facilityid",
        "if(int(FACILITYID) % 3 = 0 or FACILITYID = '10000001', null, NAME) as name",
    ).filter("facilityid <> '10000826' or name is null")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility boundaries with the attributes of the national layer."""
    x, y = location("c_custkey")
    h = HALF_FOOTPRINT
    unused = ("FID", "OBJECTID", "ZIP4", "NAICS_CODE", "NAICS_DESC", "SOURCE", "SOURCEDATE", "VAL_METHOD", "VAL_DATE")
    return (
        table(spark, sf_dir, "customer")
        .selectExpr("*", f"{x} as x", f"{y} as y")
        .selectExpr(
            *[f"string(c_custkey) as {name}" for name in unused],
            "string(c_custkey + 10000000) as FACILITYID",
            """concat(c_mktsegment, " MEN'S STATE PRISON", if(c_custkey % 4 = 0, ' CAMPUS', ''),
               if(c_custkey % 5 <> 0, concat(' ( s', c_custkey div 15, ' )'), ''),
               if(c_custkey % 3 = 0, ' (WEST)', '')) as NAME""",
            """concat(c_nationkey, "TH o'brien-road") as ADDRESS""",
            "concat('city of ', lower(c_mktsegment)) as CITY",
            "if(c_nationkey % 4 = 0, 'NV', 'CA') as STATE",
            "c_name as TELEPHONE",
            "case c_custkey % 4 when 0 then 'LOCAL' when 1 then 'COUNTY' else 'STATE' end as TYPE",
            "if(c_custkey % 10 = 9, 'CLOSED', 'OPEN') as STATUS",
            "if(c_custkey % 9 = 0, -999D, 100D + c_custkey % 900) as POPULATION",
            """case when c_custkey % 13 = 0 then -999D when c_custkey % 17 = 0 then 0D
               else 200D + (c_custkey * 7) % 1000 end as CAPACITY""",
            f"array(array({rectangle(f'x - {h}', f'y - {h}', f'x + {h}', f'y + {h}')})) as geometry",
        )
    )


def tract_id(k: str) -> str:
    return f"lpad(string({k} + 6000000000), 11, '0')"


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census tracts: triangle, square with a hole, or two strips."""
    x0, y0 = corner("p_partkey")
    s = SIDE
    east, north = f"x0 + {s}", f"y0 + {s}"
    triangle = f"array(array(array(array(x0, y0), array({east}, y0), array(x0, {north}), array(x0, y0))))"
    hole = rectangle(f"x0 + {s} * 0.25D", f"y0 + {s} * 0.25D", f"x0 + {s} * 0.75D", f"y0 + {s} * 0.75D")
    holed = f"array(array({rectangle('x0', 'y0', east, north)}, {hole}))"
    west_strip = rectangle("x0", "y0", f"x0 + {s} * 0.4D", north)
    east_strip = rectangle(f"x0 + {s} * 0.6D", "y0", east, north, clockwise=True)
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey", f"{x0} as x0", f"{y0} as y0")
        .selectExpr(
            "p_partkey",
            f"{tract_id('p_partkey')} as GEOID",
            f"""case p_partkey % 3 when 0 then {triangle} when 1 then {holed}
                else array(array({west_strip}), array({east_strip})) end as geometry""",
        )
    )


def squares_with_a_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares whose hole lies near a corner; outline and hole turn either way."""
    x0, y0 = corner("p_partkey")
    s = SIDE
    at = lambda v, part: f"{v} + {s} * {part}D"
    corners = ("x0", "y0", at("x0", 1), at("y0", 1)), (at("x0", 0.1), at("y0", 0.2), at("x0", 0.3), at("y0", 0.6))
    turned = [f"if(p_partkey % {n} = 0, {rectangle(*c)}, {rectangle(*c, clockwise=True)})" for n, c in zip((2, 3), corners)]
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey", f"{x0} as x0", f"{y0} as y0")
        .selectExpr(f"{tract_id('p_partkey')} as GEOID", f"array(array({', '.join(turned)})) as geometry")
    )


def overlapping_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles 7.5 sides wide: the left half of a tract is also covered by its west neighbour."""
    x0, y0 = corner("p_partkey")
    shape = rectangle(x0, y0, f"{x0} + {SIDE} * 7.5D", f"{y0} + {SIDE}")
    return table(spark, sf_dir, "part").selectExpr(
        f"{tract_id('p_partkey')} as GEOID", f"array(array({shape})) as geometry"
    )


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average population per code; codes carry stray spaces."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_name as Facility_Name",
        "concat(' S', s_suppkey, '\t') as Facility_Code",
        """case when s_suppkey % 19 = 0 then 0D
           when s_suppkey % 23 <> 0 then 1000D + (s_suppkey * 37) % 4000 end as Average_2025_Population""",
    )


ALIASES = {"T5": "S5", "T7": "S7"}


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed facts per code; two codes go by another name."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat(if(s_suppkey in (5, 7), 'T', 'S'), s_suppkey, ' ') as Acronym",
        "int(s_suppkey % 170 + 1850) as Year_opened",
        """if(s_suppkey % 4 = 0, concat('Opened as "', s_name, '", later renamed'), null) as Year_opened_notes""",
        "if(s_suppkey % 3 = 0, 'Yes', null) as Reentry_hub",
        "if(s_suppkey % 31 = 0, 'Yes', null) as Planned_closure",
        "if(s_suppkey % 5 = 0, 'Yes', null) as California_model_facility",
        "if(s_suppkey % 8 = 0, 'Yes', null) as cdcr_air_cooling_pilot",
    )


# Published count of a line item: suppressed, blank, missing, or a number with commas.
_NUMBER = "((l_orderkey * 31 + l_linenumber * 7) % 5000)"
COUNT_TEXT = f"""
case when l_orderkey % 11 = 0 then '(Blank)' when l_orderkey % 13 = 0 then '*'
  when l_orderkey % 17 = 0 then '**' when l_orderkey % 19 = 0 then null
  when {_NUMBER} >= 1000 then concat(' ', {_NUMBER} div 1000, ',', lpad(string({_NUMBER} % 1000), 3, '0'))
  else concat({_NUMBER}, ' ') end"""


# A line item as a line of text: some have a cell too many, some too few, some a word for a number.
LINE_HEADER = "l_quantity,note,l_linenumber,l_orderkey"
LINE = """
case when l_orderkey % 37 = 0 then concat(string(l_quantity), ',x,', l_linenumber, ',', l_orderkey, ',more')
  when l_orderkey % 41 = 0 then concat(string(l_quantity), ',x,', l_linenumber)
  when l_orderkey % 43 = 0 then concat('dozen,"a, b",', l_linenumber, ',', l_orderkey)
  else concat(if(l_orderkey % 47 = 0, 'n/a', string(l_quantity)), ',"a, b",', l_linenumber, ',', l_orderkey) end"""


def _one_of(values: tuple[str, ...], index: str) -> str:
    return f"array({', '.join(repr(v) for v in values)})[{index}]"


def _item_panel(spark: SparkSession, sf_dir: str, name: str, category: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "year(l_shipdate) as Year",
        "month(l_shipdate) as Month",
        "concat('S', l_suppkey) as Location",
        f"{category} as `{name}`",
        f"{COUNT_TEXT} as Population",
    )


def age_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_panel(spark, sf_dir, "Age Group", _one_of(AGE_BANDS, "int(floor((l_quantity - 1) / 5))"))


def gender_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_panel(spark, sf_dir, "Gender", "if(l_linestatus = 'F', 'Female', 'Male')")


def race_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    race = "case l_returnflag when 'A' then 'White' when 'N' then 'Black' else 'Hispanic/Latino' end"
    return _item_panel(spark, sf_dir, "Race", race)


def birth_country_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders give the fourth panel; it names more locations than the other three."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('S', o_custkey div 10) as Location",
        f"{_one_of(COUNTRIES, 'int(o_orderkey % 4)')} as `Country of Birth`",
        "string(o_custkey % 500) as Population",
    )


def heat_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat days per tract, summed from line items shipped before and after 1998."""
    sums = [
        f"sum(l_quantity) filter (where l_quantity > {least} and year(l_shipdate) {test} 1998)"
        f" as days_over_{threshold}_{when}"
        for threshold, least in ((80, 0), (90, 20), (100, 40))
        for when, test in (("historic", "<="), ("midcentury", ">"))
    ]
    items = table(spark, sf_dir, "lineitem")
    return spark.sql(
        f"select {tract_id('l_partkey')} as GEOID, {', '.join(sums)} from {{items}} group by l_partkey",
        items=items,
    )


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per tract with gaps; every tenth tract goes by another, unmatched number."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey + if(p_partkey % 10 = 9, 7000000000, 6000000000) as tract",
        "p_size * 2D as PollutionP",
        "if(p_partkey % 7 <> 0, double((p_partkey * 13) % 101), null) as ozoneP",
        "if(p_partkey % 5 <> 0, double((p_partkey * 29) % 101), null) as pmP",
        "if(p_partkey % 3 <> 0 and p_partkey % 35 <> 0, double((p_partkey * 31) % 101), null) as dieselP",
    )
