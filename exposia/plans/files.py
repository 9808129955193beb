"""The four tables from input files to CSV folders, published together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from exposia import schemas
from exposia.functions.geometry import to_wkt
from exposia.operators.cleaning import observed
from exposia.plans import tables
from exposia.sources.delimited import read_csv, write_csv
from exposia.sources.geojson import read_geojson
from exposia.sources.layers import BOX, read_layer
from exposia.sources.staging import materialize


@dataclass(frozen=True)
class Inputs:
    """Paths of the input files or folders."""

    boundaries: str
    tracts: str
    averages: str
    age: str
    gender: str
    race: str
    metadata: str
    heat_days: str
    screening: str
    birth_country: str | None = None


class Published(dict):
    """The tables of a run by name, with the folder (``paths``) and the rows (``counts``) of each."""

    def __init__(self, run: str, tables: Mapping[str, DataFrame] | None = None):
        super().__init__(tables or {})
        self.run = run
        self.paths: dict[str, str] = {}
        self.counts: dict[str, int] = {}


_MANIFEST = "run string, published timestamp, tables array<struct<name:string, path:string, rows:bigint>>"


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], output: str) -> Published:
    """Write tables as CSV into folders of a new run, then a manifest that names them all.

    Rows are counted by the writing jobs themselves. Only the manifest, one file written last, makes a
    run known to :func:`published`: a run that breaks leaves the one before in place.
    """
    run = Published(uuid.uuid4().hex, tables)
    for name, table in tables.items():
        flat = table.withColumn("geometry", to_wkt("geometry")) if "geometry" in table.columns else table
        flat = flat.withColumns({f.name: F.to_json(f.name) for f in flat.schema if isinstance(f.dataType, T.MapType)})
        counted, seen = observed(flat, f"{name}-{run.run}")
        run.paths[name] = f"{output.rstrip('/')}/runs/{run.run}/{name}"
        write_csv(counted, run.paths[name])
        run.counts[name] = seen.get["rows"]
    rows = [(name, run.paths[name], run.counts[name]) for name in tables]
    manifest = spark.createDataFrame([(run.run, None, rows)], _MANIFEST).withColumn("published", F.current_timestamp())
    manifest.coalesce(1).write.json(f"{output.rstrip('/')}/manifests/{run.run}")
    return run


def published(spark: SparkSession, output: str) -> Published:
    """The paths and counts of the run published last; an error if there is none."""
    manifests = spark.read.schema(_MANIFEST).json(f"{output.rstrip('/')}/manifests/*")
    last = manifests.orderBy(F.desc("published"), "run").first()
    if last is None:
        raise FileNotFoundError(f"nothing is published under {output}")
    run = Published(last["run"])
    run.paths = {t["name"]: t["path"] for t in last["tables"]}
    run.counts = {t["name"]: t["rows"] for t in last["tables"]}
    return run


def build(
    spark: SparkSession,
    inputs: Inputs,
    output: str,
    *,
    layout: str | Mapping[str, str] = "collection",
    boundary_properties: T.StructType = schemas.BOUNDARY_PROPERTIES,
    facility_options: Mapping[str, object] | None = None,
    state_options: Mapping[str, object] | None = None,
) -> Published:
    """Build all tables, write each as CSV under ``output`` and publish them together.

    ``layout`` is that of the three layers, or one by name (``boundaries``, ``tracts``, ``screening``): a
    GeoJSON layout, or ``parquet`` for a layer written by :func:`exposia.sources.layers.write_layer`. The facility, state and hazard tables are stored once as
    parquet and feed the others; geometry becomes text only in the CSV. Returns the tables by name, with
    the folder and the number of rows of each.
    """

    def layer(name: str, properties: T.StructType, geometry: bool = True) -> DataFrame:
        path = getattr(inputs, name)
        kind = layout if isinstance(layout, str) else layout.get(name, "collection")
        if kind == "parquet":
            boxes = BOX if name == "tracts" else ()  # what the region join prunes by
            return read_layer(spark, path).select(*properties.names, *(["geometry"] if geometry else []), *boxes)
        return read_geojson(spark, path, properties, layout=kind, geometry=geometry)

    def panel(path: str, category: str) -> DataFrame:
        return read_csv(spark, path, schemas.panel(category))

    facilities = materialize(
        tables.facilities(
            layer("boundaries", boundary_properties),
            layer("tracts", schemas.TRACT_PROPERTIES),
            **(facility_options or {}),
        ),
        "facilities",
    )
    base = tables.state_facilities_base(facilities)
    state = tables.state_facilities(
        base,
        read_csv(spark, inputs.averages, schemas.POPULATION_AVERAGES),
        read_csv(spark, inputs.metadata, schemas.FACILITY_METADATA, multi_line=True),
        age=panel(inputs.age, "Age Group"),
        gender=panel(inputs.gender, "Gender"),
        race=panel(inputs.race, "Race"),
        birth_country=panel(inputs.birth_country, "Country of Birth") if inputs.birth_country else None,
        **(state_options or {}),
    )
    hazard = tables.heat_air_hazard(
        read_csv(spark, inputs.heat_days, schemas.HEAT_DAYS),
        layer("screening", schemas.SCREENING_PROPERTIES, geometry=False),
    )
    # Both feed several tables below.
    state, hazard = materialize(state, "state"), materialize(hazard, "hazard")
    built = {
        "facilities": facilities,
        "state_facilities_base": base,
        "state_facilities": state,
        "heat_air_hazard": hazard,
        "facility_exposure": tables.exposure(facilities, hazard),
        "state_facility_exposure": tables.exposure(state, hazard),
    }
    return publish(spark, built, output)
