"""Left joins to lookup tables of any size under any key distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from exposia.functions.columns import as_column

# A key is hot when it holds more than 1/HOT_KEYS of all rows, so there are fewer than HOT_KEYS
# hot keys whatever the data: the list of them has a proven size bound and can be broadcast.
HOT_KEYS = 10_000
# Keys with fewer rows than this are never split.
MIN_PIECE_ROWS = 1_000_000

_PIECES, _PIECE = "_pieces", "_piece"


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, without running a job."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def splits_skew(df: DataFrame) -> bool:
    """Whether adaptive execution will split skewed partitions of a shuffle join."""
    conf = df.sparkSession.conf
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(conf.get(name).lower() == "true" for name in names)


def fits_broadcast(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= broadcast_limit(df)


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes a type: all but maps, at any depth."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def hot_keys(
    df: DataFrame, keys: Sequence[str], max_hot: int = HOT_KEYS, min_rows: int = MIN_PIECE_ROWS
) -> DataFrame:
    """Keys that hold too many rows for one task, with the number of pieces to split each into.

    Counts are pre-aggregated before their shuffle, so a hot key costs one row per map task.
    """
    known = df.select(*keys).dropna(subset=list(keys))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    counts = counts.withColumn("_target", F.greatest(F.lit(min_rows), F.ceil(total / max_hot)))
    return counts.filter(F.col("_rows") > F.col("_target")).select(
        *keys, F.ceil(F.col("_rows") / F.col("_target")).cast("int").alias(_PIECES)
    )


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    *,
    condition: Column | None = None,
    max_hot: int = HOT_KEYS,
    min_rows: int = MIN_PIECE_ROWS,
) -> DataFrame:
    """Left equi-join by shuffle in which no task gets more than a bounded share of a hot key.

    The left rows of a hot key are dealt to pieces by a hash of the row, and the right rows of that
    key are repeated once per piece. Other keys are not repeated. Left rows without a key match
    nothing and are spread evenly. The result is the same as that of a plain left join.
    """
    left_keys = [k for k, _ in on]
    right_keys = [k for _, k in on]
    hot = F.broadcast(hot_keys(left, left_keys, max_hot, min_rows))

    hashable = [f.name for f in left.schema.fields if _hashable(f.dataType)]
    row_hash = F.xxhash64(*hashable)
    no_key = F.lit(False)
    for k in left_keys:
        no_key = no_key | F.col(k).isNull()
    dealt = left.join(hot, left_keys, "left").select(
        *left.columns,
        F.when(no_key, F.pmod(row_hash, F.lit(max_hot)))
        .when(F.col(_PIECES).isNotNull(), F.pmod(row_hash, F.col(_PIECES)))
        .otherwise(F.lit(0))
        .alias(_PIECE),
    )

    renamed = hot.select(*[F.col(a).alias(b) for a, b in on], _PIECES)
    last = F.coalesce(F.col(_PIECES), F.lit(1)) - 1
    repeated = right.join(F.broadcast(renamed), right_keys, "left").select(
        *right.columns,
        F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("_right_piece"),
    )
    matches = F.col(_PIECE) == F.col("_right_piece")
    for a, b in on:
        matches = matches & (F.col(a) == F.col(b))
    if condition is not None:
        matches = matches & condition
    # The sort-merge form also lets adaptive execution split what is still uneven.
    joined = dealt.join(repeated.hint("merge"), matches, "left")
    return joined.drop(_PIECE, "_right_piece")


def left_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, Column | str]],
    *,
    condition: Column | None = None,
    small: bool | None = None,
    salted: bool | None = None,
) -> DataFrame:
    """Keep every left row and add the right columns other than the keys.

    ``on`` pairs a left column with a right column or expression. Left rows repeat when the right
    key does, and a missing key matches nothing.

    A right side within the session's broadcast threshold is joined plainly: Catalyst broadcasts it
    and the left side does not shuffle. Anything larger is a shuffle join. Its hot keys, and the
    rows without a key, are split by adaptive execution, which sees the real sizes; where that is
    switched off, or with ``salted``, by counting and salting. ``small`` states the outcome when the
    caller has measured the right side; Catalyst's own estimate is then not to be trusted.
    """
    key_names = [f"_lookup_key_{i}" for i in range(len(on))]
    plain = {k for _, k in on if isinstance(k, str)}
    kept = [c for c in right.columns if c not in plain]
    clash = sorted(set(kept) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides of the join: {clash}")
    keys = [as_column(k).alias(n) for n, (_, k) in zip(key_names, on)]
    right = right.select(*keys, *kept)
    pairs = [(a, n) for n, (a, _) in zip(key_names, on)]

    measured = small is not None
    small = small if measured else fits_broadcast(right)
    if salted is None:
        salted = not small and not splits_skew(left)
    if salted:
        joined = salted_left_join(left, right, pairs, condition=condition)
    else:
        matches = condition if condition is not None else F.lit(True)
        for a, b in pairs:
            matches = (F.col(a) == F.col(b)) & matches
        if measured:
            right = F.broadcast(right) if small else right.hint("merge")
        joined = left.join(right, matches, "left")
    return joined.drop(*key_names)


def lookup_back(df: DataFrame, found: DataFrame, key: str, value: str, result: str) -> DataFrame:
    """Write a looked-up value back by key; the smallest value wins where a key has several."""
    best = found.groupBy(key).agg(F.min(value).alias(result))
    return left_lookup(df, best, [(key, key)])


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    lookup_key: Column | str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Left join to a lookup pruned to ``columns``; both keys of the lookup side are dropped."""
    if columns is not None:
        keep = [lookup_key] if isinstance(lookup_key, str) else [lookup_key.alias("_enrich_key")]
        lookup = lookup.select(*keep, *columns)
        lookup_key = lookup_key if isinstance(lookup_key, str) else "_enrich_key"
    return left_lookup(df, lookup, [(key, lookup_key)])


def aligned_lookups(lookups: Mapping[str, tuple[DataFrame, Column | str]]) -> DataFrame:
    """Several lookups as one: a row per ``_key`` with an array of each lookup's rows under its name.

    The lookups are stacked, each in a column of its own, and gathered by key in one aggregate, without
    a join. A key's rows are held in one row, as the rows of one code are repeated for every row that
    has it in any case. Rows without a key match nothing and go; a key that a lookup lacks has an
    empty array.
    """
    rows = {name: T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema]) for name, (frame, _) in lookups.items()}

    def stacked(name: str, frame: DataFrame, key: Column | str) -> DataFrame:
        columns = [(F.struct("*") if other == name else F.lit(None).cast(kind)).alias(other) for other, kind in rows.items()]
        return frame.select(as_column(key).alias("_key"), *columns).filter(F.col("_key").isNotNull())

    every = reduce(DataFrame.unionByName, [stacked(name, *found) for name, found in lookups.items()])
    return every.groupBy("_key").agg(*[F.collect_list(name).alias(name) for name in rows])


def join_aligned(df: DataFrame, key: str, aligned: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Left join to aligned lookups, adding the named columns of each; one join for all of them.

    A row repeats for each combination of its key's rows, as it would in a chain of joins. Rows
    without a key are dealt by a hash of the row, so that they do not meet in one task.
    """
    wanted = [c for names in columns.values() for c in names]
    repeated = sorted({c for c in wanted if wanted.count(c) > 1 or c in df.columns})
    if repeated:
        raise ValueError(f"columns on both sides of the join: {repeated}")
    hashable = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    kind = aligned.schema["_key"].dataType
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).cast(kind)
    keyed = df.withColumn("_found_by", F.coalesce(F.col(key).cast(kind), spread))
    joined = left_lookup(keyed, aligned, [("_found_by", "_key")], condition=F.col(key).isNotNull())
    kept = [F.col(f"`{c}`") for c in df.columns]
    for at, (name, names) in enumerate(columns.items()):
        rest = [n for n in list(columns)[at + 1 :]]
        joined = joined.select(*kept, *rest, F.explode_outer(name).alias(f"_{name}"))
        kept = [*kept, *[F.col(f"_{name}.`{c}`").alias(c) for c in names]]
        joined = joined.select(*kept, *rest)
        kept = [F.col(f"`{c}`") for c in joined.columns if c not in rest]
    return joined
