"""Planar geometry on nested arrays: multipolygon -> polygons -> rings -> [x, y].

The first ring of a polygon is its outline, the others are holes. Ring orientation is not relied
on, and a ring may be left unclosed. All functions are native higher-order expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from exposia.functions.columns import as_column

WGS84 = "EPSG:4326"
NAD83 = "EPSG:4269"
WEB_MERCATOR = "EPSG:3857"
_DEGREES = (WGS84, NAD83)

_RADIUS = 6378137.0


def mercator_x(longitude: Column | str) -> Column:
    return F.radians(as_column(longitude)) * _RADIUS


def mercator_y(latitude: Column | str) -> Column:
    half = F.radians(as_column(latitude)) / 2
    return F.log(F.tan(F.lit(math.pi / 4) + half)) * _RADIUS


def longitude_of(x: Column | str) -> Column:
    return F.degrees(as_column(x) / _RADIUS)


def latitude_of(y: Column | str) -> Column:
    return F.degrees(2 * F.atan(F.exp(as_column(y) / _RADIUS)) - math.pi / 2)


def same_crs(left: str | None, right: str | None) -> bool:
    """Whether coordinates need no change; the two degree systems differ by about a metre at most."""
    return left == right or (left in _DEGREES and right in _DEGREES)


def check_crs(crs: str | None) -> None:
    if crs is not None and crs not in (*_DEGREES, WEB_MERCATOR):
        raise ValueError(f"unsupported coordinate system {crs!r}")


def project_xy(
    x: Column | str, y: Column | str, source: str | None, target: str | None
) -> tuple[Column, Column]:
    """Move a coordinate pair between degrees and Web Mercator metres."""
    check_crs(source)
    check_crs(target)
    x, y = as_column(x), as_column(y)
    if source is None or target is None or same_crs(source, target):
        return x, y
    if target == WEB_MERCATOR:
        return mercator_x(x), mercator_y(y)
    return longitude_of(x), latitude_of(y)


def project(geometry: Column | str, source: str | None, target: str | None) -> Column:
    """Re-project every vertex of a geometry."""
    check_crs(source)
    check_crs(target)
    geometry = as_column(geometry)
    if source is None or target is None or same_crs(source, target):
        return geometry
    return F.transform(
        geometry,
        lambda polygon: F.transform(
            polygon,
            lambda ring: F.transform(
                ring, lambda p: F.array(*project_xy(p[0], p[1], source, target))
            ),
        ),
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Apply ``body`` to a value computed once, however often the body uses it."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def ring_edges(ring: Column, origin: Column | None = None) -> Column:
    """Edges of a ring as structs ``x1, y1, x2, y2``, including the closing one.

    With ``origin`` (a struct ``x, y``) they are relative to it.
    """
    following = F.concat(
        F.slice(ring, 2, F.size(ring)), F.array(F.try_element_at(ring, F.lit(1)))
    )

    def edge(a: Column, b: Column) -> Column:
        ends = {"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]}
        if origin is not None:
            ends = {name: value - origin[name[0]] for name, value in ends.items()}
        return F.struct(*[value.alias(name) for name, value in ends.items()])

    # An empty ring still has one "following" entry; slicing leaves it without edges.
    return F.slice(F.zip_with(ring, following, edge), 1, F.size(ring))


def edges(geometry: Column | str) -> Column:
    """Edges of all rings of all parts in one array."""
    return F.flatten(F.transform(F.flatten(as_column(geometry)), lambda ring: ring_edges(ring)))


def bounds(edge_list: Column | str) -> Column:
    """Bounding box of an edge list as struct ``xmin, ymin, xmax, ymax``; each vertex starts an edge."""
    edge_list = as_column(edge_list)
    return F.struct(
        F.array_min(edge_list["x1"]).alias("xmin"),
        F.array_min(edge_list["y1"]).alias("ymin"),
        F.array_max(edge_list["x1"]).alias("xmax"),
        F.array_max(edge_list["y1"]).alias("ymax"),
    )


# Of the sum of the two products of an orientation: below this share, rounding may change the sign.
_DOUBTFUL = 3.3306690738754716e-16
_SPLITTER = float((1 << 27) + 1)


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """A sum and exactly what its rounding lost."""
    total = a + b
    shifted = total - a
    return total, (a - (total - shifted)) + (b - shifted)


def _two_product(a: Column, b: Column) -> Column:
    """A product and exactly what its rounding lost, as an array; the factors are split in halves."""

    def halves(v: Column) -> Column:
        large = v * _SPLITTER
        high = large - (large - v)
        return F.struct(high.alias("high"), (v - high).alias("low"))

    def lost(p: Column, x: Column, y: Column) -> Column:
        rest = p - x["high"] * y["high"] - x["low"] * y["high"] - x["high"] * y["low"]
        return x["low"] * y["low"] - rest

    return bound(halves(a), lambda x: bound(halves(b), lambda y: bound(a * b, lambda p: F.array(lost(p, x, y), p))))


def exact_sign(terms: Column) -> Column:
    """Sign of the sum of an array of doubles, without rounding.

    The sum is kept as an array of doubles that do not overlap, the largest last; each term runs
    through it and leaves what rounding lost in its place.
    """
    none = F.array().cast("array<double>")

    def grow(kept: Column, term: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            total, lost = _two_sum(state["sum"], part)
            return F.struct(total.alias("sum"), F.concat(state["lost"], F.array(lost)).alias("lost"))

        start = F.struct(term.alias("sum"), none.alias("lost"))
        return F.aggregate(kept, start, step, lambda s: F.concat(s["lost"], F.array(s["sum"])))

    total = F.aggregate(terms, none, grow)
    return F.aggregate(total, F.lit(0.0), lambda sign, part: F.when(part != 0, F.signum(part)).otherwise(sign))


def side(e: Column, x: Column, y: Column) -> Column:
    """1.0 where a point lies left of an edge, -1.0 right of it, 0.0 exactly on its line.

    The plain formula decides unless its result is so small that rounding may have made it; then
    the six products of the determinant are added without rounding.
    """
    left = (e["x1"] - x) * (e["y2"] - y)
    right = (e["y1"] - y) * (e["x2"] - x)

    def products() -> Column:
        pairs = [("x1", "y2"), ("x2", y), (x, "y1")], [("y1", "x2"), ("y2", x), (y, "x1")]
        value = lambda v: e[v] if isinstance(v, str) else v
        plus = [_two_product(value(a), value(b)) for a, b in pairs[0]]
        minus = [_two_product(-value(a), value(b)) for a, b in pairs[1]]
        return F.concat(*plus, *minus)

    sure = F.abs(left - right) > (F.abs(left) + F.abs(right)) * _DOUBTFUL
    return F.when(sure, F.signum(left - right)).otherwise(exact_sign(products()))


_EVEN, _ODD, _BORDER = 0, 1, 2


def inside(edge_list: Column | str, x: Column | str, y: Column | str) -> Column:
    """Whether a point lies strictly within: even-odd ray cast to the right over an edge list.

    Holes and further parts need no special case. A point on an edge or a vertex, of a hole too, is
    not within, by exact arithmetic. A missing coordinate gives no answer.
    """
    x, y = as_column(x), as_column(y)

    def step(state: Column, e: Column) -> Column:
        level = (F.least(e["y1"], e["y2"]) <= y) & (y <= F.greatest(e["y1"], e["y2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        crosses = (e["y1"] > y) != (e["y2"] > y)
        upward = e["y2"] > e["y1"]

        def beside(turn: Column) -> Column:
            return F.when(turn == 0, _BORDER).when(crosses & ((turn > 0) == upward), 1 - state).otherwise(state)

        return (
            F.when((state == _BORDER) | ~level, state)
            .when(x < F.least(e["x1"], e["x2"]), F.when(crosses, 1 - state).otherwise(state))
            .otherwise(bound(side(e, x, y), beside))
        )

    def products(e: Column) -> tuple[Column, Column]:
        return (e["x1"] - x) * (e["y2"] - y), (e["y1"] - y) * (e["x2"] - x)

    def doubtful(e: Column) -> Column:
        left, right = products(e)
        level = (F.least(e["y1"], e["y2"]) <= y) & (y <= F.greatest(e["y1"], e["y2"]))
        return level & (F.abs(left - right) <= (F.abs(left) + F.abs(right)) * _DOUBTFUL)

    def crossed(e: Column) -> Column:
        left, right = products(e)
        return ((e["y1"] > y) != (e["y2"] > y)) & ((left > right) == (e["y2"] > e["y1"]))

    edge_list = as_column(edge_list)
    plain = F.aggregate(edge_list, F.lit(False), lambda odd, e: odd != crossed(e))
    exact = F.aggregate(edge_list, F.lit(_EVEN), step) == _ODD
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, F.when(F.exists(edge_list, doubtful), exact).otherwise(plain))


_MOMENTS = ("size", "x", "y")


def _zero_moments() -> Column:
    return F.struct(*[F.lit(0.0).alias(name) for name in _MOMENTS])


def _plus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[name] + b[name]).alias(name) for name in _MOMENTS])


def _add_area(total: Column, e: Column) -> Column:
    """Twice the signed area between edge and anchor, and the same weighted by position."""
    cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
    return F.struct(
        (total["size"] + cross).alias("size"),
        (total["x"] + (e["x1"] + e["x2"]) * cross).alias("x"),
        (total["y"] + (e["y1"] + e["y2"]) * cross).alias("y"),
    )


def _add_length(total: Column, e: Column) -> Column:
    """Edge length, and the same weighted by position."""
    length = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
    return F.struct(
        (total["size"] + length).alias("size"),
        (total["x"] + (e["x1"] + e["x2"]) * length).alias("x"),
        (total["y"] + (e["y1"] + e["y2"]) * length).alias("y"),
    )


def _area_moments(geometry: Column, anchor: Column) -> Column:
    """Area sums of all rings; outlines count positive and holes negative whatever their turn."""

    def oriented(total: Column, hole: Column) -> Column:
        sign = F.signum(total["size"]) * F.when(hole, -1.0).otherwise(1.0)
        return F.struct(*[(total[name] * sign).alias(name) for name in _MOMENTS])

    def ring_sums(ring: Column, i: Column) -> Column:
        edge_list = ring_edges(ring, anchor)
        return F.aggregate(edge_list, _zero_moments(), _add_area, lambda t: oriented(t, i > 0))

    rings = F.transform(geometry, lambda polygon: F.transform(polygon, ring_sums))
    return F.aggregate(F.flatten(rings), _zero_moments(), _plus)


def _length_moments(geometry: Column, anchor: Column) -> Column:
    rings = F.transform(F.flatten(geometry), lambda ring: ring_edges(ring, anchor))
    return F.aggregate(F.flatten(rings), _zero_moments(), _add_length)


def centroid(geometry: Column | str) -> Column:
    """Planar centroid as struct ``x, y``: by area, else by boundary length, else the first vertex.

    Coordinates are shifted to the first vertex before summing, which keeps the precision of
    small shapes far from the origin.
    """

    def divided(total: Column, factor: float, anchor: Column) -> Column:
        point = F.struct(
            *[(anchor[c] + F.try_divide(total[c], factor * total["size"])).alias(c) for c in "xy"]
        )
        return F.when(total["size"] != 0, point)

    def place(shape: Column, anchor: Column) -> Column:
        by_area = bound(_area_moments(shape, anchor), lambda t: divided(t, 3.0, anchor))
        by_length = bound(_length_moments(shape, anchor), lambda t: divided(t, 2.0, anchor))
        return F.coalesce(by_area, by_length, anchor)

    def anchored(shape: Column) -> Column:
        first = F.try_element_at(F.flatten(F.flatten(shape)), F.lit(1))
        anchor = bound(first, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return bound(anchor, lambda a: place(shape, a))

    return bound(as_column(geometry), anchored)


def to_wkt(geometry: Column | str) -> Column:
    """Well-known text of a multipolygon, for sinks that cannot hold arrays."""

    def listed(items: Column, form) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(items, form), ", "), F.lit(")"))

    def point(p: Column) -> Column:
        return F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))

    text = listed(
        as_column(geometry), lambda polygon: listed(polygon, lambda ring: listed(ring, point))
    )
    empty = F.size(as_column(geometry)) == 0
    return F.concat(F.lit("MULTIPOLYGON "), F.when(empty, "EMPTY").otherwise(text))
