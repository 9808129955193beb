"""GeoJSON feature layers with polygon geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from exposia.functions.geometry import bound
from exposia.functions.numeric import nan_to_null
from exposia.schemas import GEOMETRY
from exposia.sources.objects import FEATURE, read_objects

_COLLECTION = "collection"
_LINES = "lines"


def _parsed_geometry(kind: Column, coordinates: Column) -> Column:
    strict = {"mode": "FAILFAST"}
    polygon = F.from_json(coordinates, GEOMETRY.elementType, strict)
    parts = F.from_json(coordinates, GEOMETRY, strict)
    return (
        F.when(kind == "Polygon", F.array(polygon))
        .when(kind == "MultiPolygon", parts)
        .when(
            kind.isNotNull(),
            F.raise_error(F.concat(F.lit("not a polygon layer: "), kind)).cast(GEOMETRY),
        )
    )


def _feature_type(properties: T.StructType, geometry: bool) -> T.StructType:
    fields = [T.StructField("type", T.StringType()), T.StructField("properties", properties)]
    if geometry:
        # Coordinates nest to a different depth per geometry type, so they are read as text first.
        shape = T.StructType(
            [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
        )
        fields.append(T.StructField("geometry", shape))
    return T.StructType(fields)


def _holds_features(line: Column) -> Column:
    """Whether a line is whole features; one that holds only a part of one is an error.

    Other lines open and close the collection around the features.
    """
    whole = line.startswith("{") & line.endswith("}")
    part = ~whole & ~line.startswith('"crs"') & line.rlike(r'"(properties|geometry)"\s*:|:\s*"Feature"')
    message = F.lit("features are not on lines of their own; read them with the collection layout")
    return F.when(part, F.raise_error(message).cast("boolean")).otherwise(whole)


def _is_feature(kind: Column) -> Column:
    """True for a feature, an error for anything else, as a whole collection on one line."""
    message = F.concat(
        F.lit("not a feature, read whole collections with the collection layout: "),
        F.coalesce(kind, F.lit("no type")),
    )
    return F.when(kind == "Feature", F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def _is_lone_feature(document: Column) -> Column:
    """Whether a top-level document is a feature; False for the shell of a collection, else an error."""
    shell = F.from_json(document, "type string, features string", {"mode": "FAILFAST"})
    message = F.concat(F.lit("neither a collection with features nor a feature: "), F.substring(document, 1, 80))
    return (
        F.when((shell["type"] == "FeatureCollection") & shell["features"].isNotNull(), F.lit(False))
        .when(shell["type"] == "Feature", F.lit(True))
        .otherwise(F.raise_error(message).cast("boolean"))
    )


def read_geojson(
    spark: SparkSession,
    path: str | list[str],
    properties: T.StructType,
    *,
    layout: str = _COLLECTION,
    geometry: bool = True,
) -> DataFrame:
    """Read features as their properties plus ``geometry``; a property a feature lacks is NULL.

    ``layout="collection"`` reads FeatureCollection documents and lone Features, one or several to a
    file, on one line or on many. One document is split over tasks, for which its files are read
    twice; anything else in a file is an error. ``layout="lines"`` reads once and without Python
    workers: features on lines of their own, one or several to a line, either bare (line-delimited
    and sequence GeoJSON) or inside a FeatureCollection as common exporters write it. A file laid out
    otherwise fails, and so does anything but a feature. NaN is missing. With ``geometry=False`` the
    shapes are never parsed.
    """
    feature = _feature_type(properties, geometry)
    if layout == _COLLECTION:
        objects = read_objects(spark, path)
        objects = objects.filter((F.col("kind") == FEATURE) | bound(F.col("data"), _is_lone_feature))
        features = objects.select(F.from_json("data", feature, {"mode": "FAILFAST"}).alias("feature"))
    elif layout == _LINES:
        line = F.trim("value", F.lit(" \t\r\x1e,"))
        lines = spark.read.text(path).filter(bound(line, _holds_features))
        objects = F.concat(F.lit("["), line, F.lit("]"))
        features = lines.select(
            F.explode(F.from_json(objects, T.ArrayType(feature), {"mode": "FAILFAST"})).alias("feature")
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")
    features = features.filter(_is_feature(F.col("feature.type")))
    columns = []
    for f in properties.fields:
        value = F.col(f"feature.properties.`{f.name}`")
        number = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        columns.append((nan_to_null(value).cast(f.dataType) if number else value).alias(f.name))
    if geometry:
        shape = F.col("feature.geometry")
        columns.append(_parsed_geometry(shape["type"], shape["coordinates"]).alias("geometry"))
    return features.select(*columns)


def _feature(df: DataFrame, name: str) -> Column:
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col(name).alias("coordinates"))
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[c for c in df.columns if c != name]).alias("properties"),
        F.when(F.col(name).isNotNull(), shape).alias("geometry"),
    )


def feature_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One line-delimited GeoJSON feature per row, as a ``value`` column ready for ``write.text``."""
    return df.select(F.to_json(_feature(df, geometry)).alias("value"))


def feature_collections(df: DataFrame, group: Column, geometry: str = "geometry", *, indented: bool = False) -> DataFrame:
    """One GeoJSON FeatureCollection per group, as a ``value`` column ready for ``write.text``.

    A document is made in one task: groups must be of bounded size.
    """
    features = df.groupBy(group.alias("_group")).agg(F.collect_list(_feature(df, geometry)).alias("features"))
    document = F.struct(F.lit("FeatureCollection").alias("type"), "features")
    return features.select(F.to_json(document, {"pretty": str(indented).lower()}).alias("value"))
