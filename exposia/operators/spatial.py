"""Centroids and assignment of points to regions through a grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from exposia.functions import geometry as geo
from exposia.operators.joins import broadcast_limit, left_lookup, lookup_back
from exposia.sources.layers import BOX, extent_of, within_extent
from exposia.sources.staging import materialize

# Room around a cell within which edges are kept, in cells; covers rounding of the cell number.
_SLACK = 0.01
_EDGE_BYTES = 48
_AT_BORDER, _INNER, _OUTER = 0, 1, 2
# Regions within so many cells keep their outline whole in each: to cut it costs more than it saves.
WHOLE_CELLS = 4
# Cells of one region above which its rows of cells are dealt to all tasks.
SPREAD_CELLS = 10_000


def with_centroid(
    df: DataFrame,
    geometry: str = "geometry",
    *,
    crs: str | None = geo.WGS84,
    x: str = "longitude",
    y: str = "latitude",
) -> DataFrame:
    """Add the centroid, computed in Web Mercator and returned in ``crs``.

    Without a coordinate system it is computed in the coordinates as they are.
    """
    metric = geo.project(geometry, crs, geo.WEB_MERCATOR if crs else None)
    placed = df.withColumn("_centroid", geo.centroid(metric))
    lon, lat = geo.project_xy(
        "_centroid.x", "_centroid.y", geo.WEB_MERCATOR if crs else None, crs
    )
    return placed.withColumns({x: lon, y: lat}).drop("_centroid")


def region_outlines(regions: DataFrame, region_id: str, geometry: str = "geometry") -> DataFrame:
    """Regions as an edge list with its bounding box."""
    outlined = regions.select(F.col(region_id), geo.edges(geometry).alias("_edges"))
    return outlined.withColumn("_box", geo.bounds("_edges"))


def _span(low: str, high: str, cell: float) -> Column:
    """Number of cells between two sides of the bounding box."""
    return F.floor(F.col(f"_box.{high}") / cell) - F.floor(F.col(f"_box.{low}") / cell) + 1


def region_cells(outlines: DataFrame, region_id: str, cell: float, *, spread: bool = False) -> DataFrame:
    """One row per region and grid cell that it touches: inner cells without edges, border cells with
    the edges a ray from that cell can meet and with the region's bounding box.

    Regions are cut into rows of cells first, then into cells. A row keeps the edges that reach it. A
    cell that no edge comes near lies within or outside as a whole: it is kept as an inner cell
    (``_inner``) or goes. Only border cells carry edges, those not left of them, so the inside of a
    large outline costs a few bytes a cell. Any number of cells per region is possible; with
    ``spread`` the rows of cells are dealt to all tasks, whichever region they are of. A region whose
    bounding box meets at most ``WHOLE_CELLS`` cells is not cut: each of them has all its edges.

    The outer form of ``explode`` keeps the optimizer from testing the generated arrays in a filter
    of their own, which would compute the edges again.
    """
    size = F.lit(float(cell))
    whole = F.coalesce(_span("xmin", "xmax", cell) * _span("ymin", "ymax", cell) <= WHOLE_CELLS, F.lit(False))
    rows = outlines.select(
        region_id,
        "_edges",
        "_box",
        whole.alias("_whole"),
        F.explode_outer(
            F.sequence(F.floor(F.col("_box.ymin") / size), F.floor(F.col("_box.ymax") / size))
        ).alias("_cell_y"),
    )
    low, high = (F.col("_cell_y") - _SLACK) * size, (F.col("_cell_y") + 1 + _SLACK) * size
    reaching = F.filter(
        "_edges",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= low)
        & (F.least(e["y1"], e["y2"]) <= high),
    )
    rows = rows.withColumn("_edges", F.when(F.col("_whole"), F.col("_edges")).otherwise(reaching))
    rows = rows.repartition(region_id, "_cell_y") if spread else rows
    starts, ends = F.col("_edges.x1"), F.col("_edges.x2")
    leftmost = F.when(F.col("_whole"), F.col("_box.xmin")).otherwise(F.least(F.array_min(starts), F.array_min(ends)))
    rightmost = F.when(F.col("_whole"), F.col("_box.xmax")).otherwise(F.greatest(F.array_max(starts), F.array_max(ends)))
    cells = rows.withColumn(
        "_cell_x",
        F.explode_outer(F.sequence(F.floor(leftmost / size), F.floor(rightmost / size))),
    ).filter(F.col("_cell_x").isNotNull())
    left, right = (F.col("_cell_x") - _SLACK) * size, (F.col("_cell_x") + 1 + _SLACK) * size
    border = F.exists(
        "_edges", lambda e: (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left)
    )
    centre = geo.inside("_edges", (F.col("_cell_x") + 0.5) * size, (F.col("_cell_y") + 0.5) * size)
    place = F.when(F.col("_whole") | border, F.lit(_AT_BORDER)).when(centre, F.lit(_INNER)).otherwise(F.lit(_OUTER))
    reached = F.filter("_edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left)
    reached = F.when(F.col("_whole"), F.col("_edges")).otherwise(reached)
    cells = cells.withColumn("_place", place).filter(F.col("_place") != _OUTER)
    inner = F.col("_place") == _INNER
    return cells.select(
        region_id,
        "_cell_x",
        "_cell_y",
        inner.alias("_inner"),
        F.when(~inner, reached).alias("_edges"),
        F.when(~inner, F.col("_box")).alias("_box"),
    )


def _within_box(x: str, y: str) -> Column:
    """Whether a point lies strictly within the bounding box, as all points within the region do."""
    x, y = F.col(x), F.col(y)
    return (F.col("_box.xmin") < x) & (x < F.col("_box.xmax")) & (F.col("_box.ymin") < y) & (y < F.col("_box.ymax"))


def default_cell(crs: str | None) -> float:
    """About five kilometres, in the units of the coordinate system."""
    if crs is None:
        raise ValueError("give a cell size for coordinates of unknown units")
    return 5_000.0 if crs == geo.WEB_MERCATOR else 0.05


def _measured(outlines: DataFrame, cell: float) -> tuple[bool, bool]:
    """Whether the cells surely fit the broadcast threshold, from an upper bound of their size, and
    whether a single region has very many."""

    cells = _span("xmin", "xmax", cell).cast("double") * _span("ymin", "ymax", cell)
    most, largest = outlines.agg(F.sum(cells * (F.size("_edges") + 2) * _EDGE_BYTES), F.max(cells)).first()
    return most is None or most <= broadcast_limit(outlines), largest is not None and largest > SPREAD_CELLS


def join_regions(
    points: DataFrame,
    regions: DataFrame,
    *,
    region_id: str,
    geometry: str = "geometry",
    x: str = "longitude",
    y: str = "latitude",
    points_crs: str | None = geo.WGS84,
    regions_crs: str | None = geo.WGS84,
    cell: float | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Left join of points to the regions they lie within, adding ``region_id``.

    Both sides meet on grid cells of ``cell`` units of the points' coordinates, an equi-join; the
    exact test runs inside it, for points within the region's bounding box. Cells about as large as the smaller regions serve best.
    A point is in one cell, so each region matches it at most once; overlapping regions each give
    a row. Whether the cells are broadcast is decided by an upper bound of their size, measured
    over the regions, unless ``small`` says so; their outlines are written once for that.
    """
    if not geo.same_crs(points_crs, regions_crs):
        regions = regions.withColumn(geometry, geo.project(geometry, regions_crs, points_crs))
    cell = default_cell(points_crs) if cell is None else cell
    outlines = region_outlines(regions, region_id, geometry)
    spread = False
    if small is None:
        outlines = materialize(outlines, "outlines")
        small, spread = _measured(outlines, cell)
    cells = region_cells(outlines, region_id, cell, spread=spread)
    located = points.withColumns(
        {"_point_cell_x": F.floor(F.col(x) / cell), "_point_cell_y": F.floor(F.col(y) / cell)}
    )
    joined = left_lookup(
        located,
        cells,
        [("_point_cell_x", "_cell_x"), ("_point_cell_y", "_cell_y")],
        condition=F.col("_inner") | (_within_box(x, y) & geo.inside("_edges", x, y)),
        small=small,
    )
    return joined.drop("_point_cell_x", "_point_cell_y", "_inner", "_edges", "_box")


def assign_region(
    df: DataFrame,
    regions: DataFrame,
    *,
    key: str = "facilityid",
    region_id: str = "GEOID",
    result: str = "tract_geoid",
    disjoint: bool = False,
    x: str = "longitude",
    y: str = "latitude",
    stage: Callable[[DataFrame], DataFrame] | None = materialize,
    **options,
) -> DataFrame:
    """Add the id of the region each row's point lies within; every row is kept once.

    Only key and coordinates travel to the regions and the found id is written back by key. Where
    regions overlap the smallest id wins. ``stage`` writes the rows before, so that what they come
    from is evaluated once. ``disjoint`` states that regions do not overlap, as census tracts: then
    the join itself gives one row each and nothing needs to be written back. Regions with box columns
    (see :mod:`exposia.sources.layers`) are read only where the points are.
    """
    boxed = set(BOX) <= set(regions.columns)
    if stage and (boxed or not disjoint):
        df = stage(df)
    if boxed:
        if geo.same_crs(options.get("points_crs", geo.WGS84), options.get("regions_crs", geo.WGS84)):
            regions = within_extent(regions, extent_of(df, x, y))
        regions = regions.drop(*BOX)
    if disjoint:
        joined = join_regions(df, regions, region_id=region_id, x=x, y=y, **options)
        return joined.withColumnRenamed(region_id, result)
    found = join_regions(df.select(key, x, y), regions, region_id=region_id, x=x, y=y, **options)
    return lookup_back(df, found.dropna(subset=[region_id]), key, region_id, result)
