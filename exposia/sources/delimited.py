"""CSV with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from exposia.functions.numeric import nan_to_null

# Cell texts that dataframe CSV readers take as missing by default.
MISSING_TEXT = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    multi_line: bool = False,
    missing: Sequence[str] = MISSING_TEXT,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read CSV files with a header under ``schema``; the header must name its columns in order.

    A cell that does not fit its type, or a row with more or fewer cells, is an error; ``mode="PERMISSIVE"``
    makes such cells NULL. Files split by block. ``multi_line`` lets quoted fields hold line breaks
    but makes each file one (streamed) task.
    """
    # Numbers are read as text, so that texts for missing are told from cells that do not fit.
    numeric = (T.NumericType,)
    plain = T.StructType(
        [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, numeric) else f for f in schema.fields]
    )
    frame = (
        spark.read.schema(plain)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", mode)
        .csv(path)
    )
    cleaned = {}
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType) and missing:
            cell = F.col(field.name)
            cleaned[field.name] = F.when(~cell.isin(*missing), cell)
        elif isinstance(field.dataType, numeric):
            cell = F.trim(field.name)
            cell = F.when(~cell.isin(*missing), cell) if missing else cell
            number = cell.try_cast(field.dataType)
            if mode == "FAILFAST":
                message = F.concat(F.lit(f"not a number in {field.name}: "), cell)
                number = F.when(cell.isNotNull() & number.isNull(), F.raise_error(message)).otherwise(number)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                number = nan_to_null(number).cast(field.dataType)
            cleaned[field.name] = number.cast(field.dataType)
    return frame.withColumns(cleaned)


_FILE, _RECORD, _PROBLEM = "_file", "_record", "_problem"


def read_csv_by_name(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    multi_line: bool = False,
    missing: Sequence[str] = MISSING_TEXT,
) -> DataFrame:
    """Read CSV files whose header holds the columns of ``schema`` in any order, with any others.

    Rows that do not fit come too: ``_problem`` tells what is wrong (too many or too few cells, or a
    cell that is not of its type), ``_record`` the row as text and ``_file`` where it stands; all three
    are NULL in good rows. See :func:`accepted` and :func:`quarantined`. A column that the header lacks
    or repeats is an error, and so is a file with another header than the first.
    """

    def reader(header: bool):
        options = spark.read.option("header", header).option("multiLine", multi_line)
        return options.option("quote", '"').option("escape", '"').option("enforceSchema", False)

    names = reader(True).option("inferSchema", False).csv(path).columns  # reads one header
    absent = [f.name for f in schema.fields if f.name not in names]
    if absent:
        raise ValueError(f"columns not in the header once: {absent}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    # cells are only counted in rows that are read whole
    rows = reader(True).schema(text).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).csv(path)

    columns, problems = [], [F.when(F.col(_RECORD).isNotNull(), F.lit("wrong number of cells"))]
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        cell = F.when(~cell.isin(*missing), cell) if missing else cell
        if isinstance(f.dataType, T.StringType):
            columns.append(cell.alias(f.name))
            continue
        trimmed = F.trim(cell)
        value = trimmed.try_cast(f.dataType)
        unfit = trimmed.isNotNull() & (trimmed != "") & value.isNull()
        message = F.concat(F.lit(f"not {f.dataType.simpleString()} in {f.name}: "), cell)
        problems.append(F.when(F.col(_RECORD).isNull() & unfit, message))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = nan_to_null(value).cast(f.dataType)
        columns.append(value.alias(f.name))
    problem = F.nullif(F.concat_ws("; ", *problems), F.lit(""))
    record = F.coalesce(F.col(_RECORD), F.to_csv(F.struct(*[f"`{n}`" for n in names])))
    read = rows.select(
        *columns, problem.alias(_PROBLEM), record.alias(_RECORD), F.col("_metadata.file_path").alias(_FILE)
    )
    told = F.col(_PROBLEM).isNotNull()
    return read.withColumns({c: F.when(told, F.col(c)) for c in (_RECORD, _FILE)})


def accepted(rows: DataFrame) -> DataFrame:
    """The good rows of :func:`read_csv_by_name`."""
    return rows.filter(F.col(_PROBLEM).isNull()).drop(_PROBLEM, _RECORD, _FILE)


def quarantined(rows: DataFrame) -> DataFrame:
    """The other rows as ``file, record, problem``."""
    bad = rows.filter(F.col(_PROBLEM).isNotNull())
    return bad.select(F.col(_FILE).alias("file"), F.col(_RECORD).alias("record"), F.col(_PROBLEM).alias("problem"))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write CSV part files with a header; flags become ``True``/``False`` and missing is empty."""
    complex_types = (T.ArrayType, T.MapType, T.StructType)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, complex_types)]
    if nested:
        raise ValueError(f"CSV cannot hold nested columns {nested}; convert them first")
    flags = {
        f.name: F.when(F.col(f.name), "True").when(~F.col(f.name), "False")
        for f in df.schema.fields
        if isinstance(f.dataType, T.BooleanType)
    }
    (
        df.withColumns(flags)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
