"""Polygon layers as parquet, ordered so that a box skips what lies elsewhere.

Each row carries the bounding box of its shape, and rows lie along a space-filling curve through the
box centres. A row group then covers a compact area, and a filter on the box columns skips it by
its statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposia.functions import geometry as geo

BOX = ("xmin", "ymin", "xmax", "ymax")
Extent = tuple[float, float, float, float]
# The areas of use of the known coordinate systems.
EXTENTS: dict[str, Extent] = {
    geo.WGS84: (-180.0, -90.0, 180.0, 90.0),
    geo.NAD83: (-180.0, -90.0, 180.0, 90.0),
    geo.WEB_MERCATOR: (-20037508.342789244, -20037508.342789244, 20037508.342789244, 20037508.342789244),
}
_BITS = 16
_ROW_GROUP = 8 << 20


def _spread(number: Column) -> Column:
    """The 16 bits of a number on every second place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return number


def curve(x: Column, y: Column, extent: Extent) -> Column:
    """Place of a point on a curve that keeps near points near: the bits of both coordinates in turn."""
    last = (1 << _BITS) - 1

    def cell(value: Column, low: float, high: float) -> Column:
        scaled = F.floor((value - low) / (high - low) * last)
        return F.greatest(F.lit(0), F.least(F.lit(last), scaled)).cast("long")

    return _spread(cell(x, extent[0], extent[2])) + 2 * _spread(cell(y, extent[1], extent[3]))


def write_layer(
    df: DataFrame, path: str, *, geometry: str = "geometry", crs: str = geo.WGS84, extent: Extent | None = None, row_group: int = _ROW_GROUP
) -> None:
    """Write a layer with its box columns along the curve, in row groups of about ``row_group`` bytes.

    A missing or empty shape has no box; such rows lie together and no box finds them.
    """
    clash = sorted(set(BOX) & set(df.columns))
    if clash:
        raise ValueError(f"columns with the names of box columns: {clash}")
    extent = extent or EXTENTS[crs]
    boxed = df.withColumn("_box", geo.bounds(geo.edges(geometry)))
    boxed = boxed.select(*df.columns, *[F.col(f"_box.{c}").alias(c) for c in BOX])
    place = curve((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, extent)
    ordered = boxed.withColumn("_place", place).repartitionByRange("_place", *BOX).sortWithinPartitions("_place", *BOX)
    ordered.drop("_place").write.option("parquet.block.size", row_group).parquet(path)


def within_extent(layer: DataFrame, extent: Extent | None) -> DataFrame:
    """Rows of a layer whose box meets an extent; without one, no row does."""
    if extent is None:
        return layer.limit(0)
    x0, y0, x1, y1 = map(F.lit, extent)
    return layer.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def read_layer(spark: SparkSession, path: str, extent: Extent | None = None) -> DataFrame:
    """A written layer with its box columns, or the part of it whose boxes meet an extent."""
    layer = spark.read.parquet(path)
    return layer if extent is None else within_extent(layer, extent)


def extent_of(points: DataFrame, x: str, y: str) -> Extent | None:
    """Extent of points, None if there are none."""
    low_high = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if low_high[0] is None or low_high[1] is None else tuple(low_high)
