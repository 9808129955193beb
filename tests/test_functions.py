"""Column functions on hand-made rows, one per edge."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from exposia.functions import geometry as geo, numeric, text

SHAPE = "array<array<array<array<double>>>>"


def values(spark, rows, schema, *columns):
    """Results as one tuple per row, in input order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    out = frame.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)])
    return [tuple(r)[1:] for r in sorted(out.collect())]


def one(spark, rows, schema, column):
    return [v for (v,) in values(spark, [(r,) for r in rows], schema, column)]


TITLES = ["MEN'S", "(CMC)", "a-b c", "3RD st.", "ÉCOLE", "straße ßx", "ǆabc", "日本abc", "o.k. x_y", "", None, " \tx"]


def test_title_case_restarts_after_any_non_letter(spark):
    expected = [t if t is None else t.title() for t in TITLES]
    assert one(spark, TITLES, "t string", text.title_case("t")) == expected


def test_trim_removes_every_kind_of_space(spark):
    rows = ["\t a b \r\n", " x　", "\x1cx\x85", "   ", None, "x\ny"]
    assert one(spark, rows, "t string", text.trim_ws("t")) == [r if r is None else r.strip() for r in rows]


def test_code_and_name_from_parentheses(spark):
    rows = [
        ("KERN VALLEY STATE PRISON (KVSP)", "KVSP", "KERN VALLEY STATE PRISON"),
        ("A ( kvsp\t) (WEST) B", "KVSP", "A B"),
        ("A ()", None, "A ()"),
        (" A ", None, " A "),
        ("A ( ) B", None, "A B"),
        (None, None, None),
        ("A  (x\ny)", "X\nY", "A"),
    ]
    got = values(
        spark, [(r[0],) for r in rows], "t string", text.parenthesised_code("t"), text.without_parentheses("t")
    )
    assert got == [r[1:] for r in rows]


def test_substring_flag_ignores_case_and_missing(spark):
    rows = ["Oak camp", "CAMPUS", "x", None]
    got = one(spark, rows, "t string", text.contains_ignoring_case("t", "CAMP"))
    assert got == [True, True, False, False]


def test_zero_pad_never_cuts_and_respects_signs(spark):
    rows = ["6001400100", "06001400100", "600140010012", "-12", "+7", "", None]
    assert one(spark, rows, "t string", text.zero_pad("t", 11)) == [r if r is None else r.zfill(11) for r in rows]


def test_numeric_ids_keep_their_digits(spark):
    rows = [6001400100.0, 12.5, None, 1e300]
    got = one(spark, rows, "k double", text.key_text("k", "double"))
    assert got == ["6001400100", "12.5", None, "1.0E300"]


def test_slug_of_value_and_column_agree(spark):
    rows = ["50-54 Years", "95 and Older", "Hispanic/Latino"]
    assert one(spark, rows, "t string", text.slug_column("t")) == [text.slug(r) for r in rows]
    assert text.slug("50-54 Years") == "50_54_years"


def test_suppressed_counts(spark):
    rows = [
        ("3,784", 3784.0), (" 10\t", 10.0), (" 7", 7.0), ("**", 25.0), (" * ", 5.0), ("(Blank)", 0.0),
        ("", 0.0), (None, 0.0), ("nan", 0.0), ("NaN", 0.0), ("12d", 0.0), ("0x1F", 0.0), ("x", 0.0), ("inf", 0.0),
        ("1,234,567.5", 1234567.5), ("-3", -3.0), ("1e3", 1000.0), ("***", 0.0), (".5", 0.5),
    ]
    got = one(spark, [r for r, _ in rows], "t string", numeric.parse_suppressed("t"))
    assert got == [v for _, v in rows]


def test_ratios_and_shares(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, None), (3.0, 2.0), (0.0005, 1.0), (-1.0, 2.0)]
    share = numeric.share("a", "b")
    got = values(
        spark,
        rows,
        "a double, b double",
        numeric.ratio("a", "b"),
        share,
        numeric.floor_small(numeric.clip(share), 0.001),
    )
    assert got == [
        (0.5, 0.5, 0.5),
        (None, 0.0, 0.0),
        (None, 0.0, 0.0),
        (None, None, None),
        (None, 0.0, 0.0),
        (1.5, 1.5, 1.0),
        (0.0005, 0.0005, 0.0),
        (-0.5, -0.5, 0.0),
    ]


def test_row_mean_and_sum_skip_missing(spark):
    rows = [(1.0, 5.0, None), (3.0, 5.0, None), (None, None, None), (1.0, 2.0, 6.0)]
    got = values(
        spark,
        rows,
        "a double, b double, c double",
        numeric.row_mean(["a", "b", "c"]),
        numeric.row_sum(["a", "b", "c"]),
        numeric.row_sum([]),
    )
    assert got == [(3.0, 6.0, 0.0), (4.0, 8.0, 0.0), (None, 0.0, 0.0), (3.0, 9.0, 0.0)]


def test_sentinel_and_nan_become_missing(spark):
    rows = [-999.0, 1.0, float("nan"), None]
    cleaned = numeric.sentinel_to_null(numeric.nan_to_null("v"))
    assert one(spark, rows, "v double", cleaned) == [None, 1.0, None, None]


def box(x1, y1, x2, y2, turn=False):
    ring = [[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]
    return ring[::-1] if turn else ring


SQUARE_WITH_HOLE = [[box(0.0, 0.0, 4.0, 4.0), box(0.0, 0.0, 2.0, 2.0)]]
SAME_TURN_AS_HOLE = [[box(0.0, 0.0, 4.0, 4.0, True), box(0.0, 0.0, 2.0, 2.0, True)]]
TWO_PARTS = [[box(0.0, 0.0, 2.0, 2.0)], [box(10.0, 0.0, 12.0, 2.0, True)]]
UNCLOSED = [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]]
FLAT = [[[[0.0, 0.0], [4.0, 0.0], [0.0, 0.0]]]]
POINT = [[[[3.0, 5.0], [3.0, 5.0]]]]


def test_centroid_of_every_kind_of_shape(spark):
    shapes = [SQUARE_WITH_HOLE, SAME_TURN_AS_HOLE, TWO_PARTS, UNCLOSED, FLAT, POINT, None, [], [[[]]]]
    got = one(spark, shapes, f"g {SHAPE}", geo.centroid("g"))
    places = [None if p is None or p.x is None else (round(p.x, 9), round(p.y, 9)) for p in got]
    assert places == [
        (2.333333333, 2.333333333), (2.333333333, 2.333333333), (6.0, 1.0), (1.0, 1.0), (2.0, 0.0), (3.0, 5.0),
        None, None, None,
    ]


def test_centroid_keeps_precision_far_from_the_origin(spark):
    x, y = 13_000_000.0, 4_500_000.0
    (got,) = one(spark, [[[box(x, y, x + 0.5, y + 0.25)]]], f"g {SHAPE}", geo.centroid("g"))
    assert got.x == pytest.approx(x + 0.25, abs=1e-8) and got.y == pytest.approx(y + 0.125, abs=1e-8)


def test_projection_round_trip_and_known_point(spark):
    edge, half_world = 85.05112877980659, 20037508.342789244
    rows = [(-118.25, 34.05), (0.0, 0.0), (180.0, edge), (179.9, -60.0)]
    x, y = geo.mercator_x("a"), geo.mercator_y("b")
    got = values(spark, rows, "a double, b double", x, y, geo.longitude_of(x), geo.latitude_of(y))
    for (lon, lat), (_, _, back_lon, back_lat) in zip(rows, got):
        assert back_lon == pytest.approx(lon, abs=1e-9) and back_lat == pytest.approx(lat, abs=1e-9)
    assert got[2][:2] == pytest.approx((half_world, half_world), abs=1e-6)


def test_unknown_coordinate_system_is_refused():
    with pytest.raises(ValueError, match="EPSG:3310"):
        geo.project_xy(F.lit(0), F.lit(0), "EPSG:3310", geo.WGS84)


def test_inside_with_holes_parts_and_borders(spark):
    rows = [
        (SQUARE_WITH_HOLE, 3.0, 3.0, True),
        (SQUARE_WITH_HOLE, 1.0, 1.0, False),
        (SQUARE_WITH_HOLE, 5.0, 1.0, False),
        (TWO_PARTS, 11.0, 1.0, True),
        (TWO_PARTS, 5.0, 1.0, False),
        (UNCLOSED, 1.0, 1.0, True),
        (FLAT, 1.0, 0.0, False),
    ]
    got = values(
        spark, [r[:3] for r in rows], f"g {SHAPE}, x double, y double", geo.inside(geo.edges("g"), "x", "y")
    )
    assert [v for (v,) in got] == [r[3] for r in rows]


def test_border_point_lies_in_neither_neighbour(spark):
    west, east = [[box(0.0, 0.0, 1.0, 1.0)]], [[box(1.0, 0.0, 2.0, 1.0)]]
    schema = f"a {SHAPE}, b {SHAPE}, x double, y double"
    both = geo.inside(geo.edges("a"), "x", "y"), geo.inside(geo.edges("b"), "x", "y")
    assert values(spark, [(west, east, 1.0, 0.5)], schema, *both) == [(False, False)]
    assert values(spark, [(west, east, math.nextafter(1.0, 0), 0.5)], schema, *both) == [(True, False)]
    assert values(spark, [(west, east, None, 0.5)], schema, *both) == [(None, None)]


def test_side_is_exact_where_rounding_is_not(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        ax, ay, dx, dy = (rng.uniform(-180, 180) for _ in range(4))
        t = rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, rng.random()])
        bx, by = ax + dx, ay + dy
        x, y = ax + t * (bx - ax), ay + t * (by - ay)  # on the line but for rounding
        for _ in range(rng.randint(0, 2)):
            x, y = math.nextafter(x, rng.choice([-math.inf, math.inf])), y
        rows.append((ax, ay, bx, by, x, y))
    rows += [(0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (0.0, 0.0, 3.0, 9.0, 1.0, 3.0), (12.0, 12.0, 24.0, 24.0, 0.5, 0.5)]
    edge = F.struct("x1", "y1", "x2", "y2")
    got = values(spark, rows, "x1 double, y1 double, x2 double, y2 double, x double, y double", geo.side(edge, F.col("x"), F.col("y")))

    def want(*v):
        ax, ay, bx, by, x, y = map(Fraction, v)
        turn = (ax - x) * (by - y) - (ay - y) * (bx - x)
        return float((turn > 0) - (turn < 0))

    assert [v for (v,) in got] == [want(*r) for r in rows]
    assert sum(want(*r) == 0 for r in rows) > 20


def test_points_on_any_border_are_outside_by_exact_arithmetic(spark):
    rng = random.Random(9)
    rows, expected = [], []
    for _ in range(150):
        corners = [[rng.randint(-9, 9) / 8, rng.randint(-9, 9) / 8] for _ in range(rng.randint(3, 7))]
        x, y = rng.choice([rng.choice(corners), [rng.randint(-9, 9) / 8, rng.randint(-9, 9) / 8]])
        rows.append(([[[*corners, corners[0]]]], x, y))
        px, py, odd, border = Fraction(x), Fraction(y), False, False
        for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            turn = (ax - px) * (by - py) - (ay - py) * (bx - px)
            border |= turn == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by)
            odd ^= (ay > py) != (by > py) and (turn > 0) == (by > ay)
        expected.append(odd and not border)
    got = values(spark, rows, f"g {SHAPE}, x double, y double", geo.inside(geo.edges("g"), "x", "y"))
    assert [v for (v,) in got] == expected
    assert 5 < sum(expected) < 130


def test_well_known_text(spark):
    got = one(spark, [TWO_PARTS, [], None], f"g {SHAPE}", geo.to_wkt("g"))
    assert got[0].startswith("MULTIPOLYGON (((0.0 0.0, 2.0 0.0") and got[0].endswith("10.0 0.0)))")
    assert got[1:] == ["MULTIPOLYGON EMPTY", None]
