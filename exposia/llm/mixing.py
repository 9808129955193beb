"""Mixing sources to target weights with Pareto order sampling, in DataFrame functions only.

Every source gets a target in words. A document is wanted ``target / source size`` times (times its
importance, if one is given): the whole part is allocated for certain, and the rest is its inclusion
probability p. Documents are ranked by the Pareto order ``(u / (1 - u)) / (p / (1 - p))`` with u from
a hash of the document, and taken in this order until the words left to the source are used up.

The running sum never runs over a whole source in one task: ranks fall into ``BINS`` ranges,
the ranges are summed first, and only documents of the one range in which a source's words run out
are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposia.sources.staging import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 4096
PARTS = 256  # of a group of equal rows


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: shares by weight in order of source, null last, capped
    at ``most`` times the size, the excess dealt again by weight until no source is above its cap.

    With r = cap / weight, sources are full in order of r; the level L that the others share solves
    ``sum of full caps + L * sum of other weights = total``. The windows run over sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int"))
    sources = sizes.withColumn("_w", each).withColumn("_cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = sources.withColumn("_level", left / weight)
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = level.withColumn("_common", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(whole))
    target = F.least("_cap", F.coalesce(F.col("_common")["_level"] * F.col("_w"), F.col("_cap")))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    *,
    importance: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, source, mark, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` the words that makes, ``mark`` a hash of the text. A null text
    or one without words has size 0 and 0 copies. A null source is a source of its own, after the others.
    A document is taken at most ``most`` times, a whole number. Reruns agree: chance comes from a
    hash of doc_id and text, and rows equal in both share a rank and are told apart by no order that
    could change the sum. An empty table gives no rows. Other columns are ignored.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    weight = F.coalesce(F.col(importance).cast("double"), F.lit(0.0)) if importance else F.lit(1.0)
    mark = F.xxhash64("text").alias("mark")
    base = docs.select("doc_id", "source", mark, word_count(F.col("text")).alias("size"), key.alias("_key"), weight.alias("_imp"))
    base = materialize(base, "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_imp")).alias("_mass"))
    mass = by_source.select(F.col("source").alias("_source"), "_mass")
    goals = targets(by_source.select("source", "source_size"), weights, share, most)
    goals = goals.join(mass, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goals = materialize(goals.withColumnRenamed("source", "_source"), "targets")

    rows = base.join(goals, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    wanted = F.least(F.lit(float(most)), F.coalesce(F.col("target") * F.col("_imp") / F.nullif("_mass", F.lit(0)), F.lit(0.0)))
    rows = rows.withColumn("_whole", F.floor(wanted)).withColumn("_p", wanted - F.floor(wanted))
    u = (F.shiftrightunsigned("_key", 11) + 0.5) / F.lit(float(1 << 53))
    odds = F.col("_p") / (1 - F.col("_p"))
    # x / (1 + x) of the order variable: the same order, between 0 and 1
    rank = F.when((F.col("size") > 0) & (F.col("_p") > 0), u / (u + (1 - u) * odds))
    rows = rows.withColumn("_rank", rank).withColumn("_bin", F.floor(F.col("_rank") * BINS))

    sums = rows.groupBy("source", "_bin").agg(
        F.sum("size").alias("_size"),
        F.sum(F.col("size") * F.col("_whole")).alias("_certain"),
        F.first("target").alias("target"),
    )
    source = Window.partitionBy("source")
    up = source.orderBy(F.col("_bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_left", F.col("target") - F.sum("_certain").over(source))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_size").over(up), F.lit(0)))
    edges = sums.filter("_bin is not null").select(
        F.col("source").alias("_source"), F.col("_bin").alias("_at"), "_left", "_before", (F.col("_before") + F.col("_size")).alias("_after")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_at"))
    rows = rows.join(materialize(edges, "bins"), same, "left").drop("_source", "_at")
    full = F.col("_after") <= F.col("_left")
    split = ~full & (F.col("_before") < F.col("_left"))
    running = Window.partitionBy("source", "_bin").orderBy("_rank", "_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter(split).withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    # a document goes in if that brings the source nearer to its words
    cut = cut.withColumn("_more", (F.col("_so_far") + F.col("size") / 2 <= F.col("_left")).cast("int")).drop("_so_far")
    rest = rows.filter(~F.coalesce(split, F.lit(False))).withColumn("_more", F.coalesce(full, F.lit(False)).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("_more")).otherwise(0).cast("long")
    both = rest.unionByName(cut).withColumn("copies", copies)
    return both.select(
        "doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it. Rows equal in doc_id, source and
    text share the sum of their copies evenly, the first ``sum mod rows`` of them with one more."""
    names = {"doc_id": "_id", "source": "_source", "mark": "_mark"}
    keys = [F.col(a).alias(b) for a, b in names.items()]
    copies = mixed.groupBy(*keys).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")).filter("_sum > 0")
    copies = copies.select(*names.values(), F.floor(F.col("_sum") / F.col("_rows")).cast("int").alias("_copies"), (F.col("_sum") % F.col("_rows")).alias("_more"))
    copies = materialize(copies, "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = docs.join(copies, same & (F.xxhash64("text") == F.col("_mark")))
    if not copies.filter("_more > 0").isEmpty():
        uneven = rows.filter("_more > 0").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
        rows = rows.filter("_more = 0").unionByName(_with_one_more(materialize(uneven, "uneven")))
    repeated = rows.filter("_copies > 0").withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_one_more(rows: DataFrame) -> DataFrame:
    """One more copy for ``_more`` rows of each group, numbered part by part so that no task holds a group."""
    keys = ["_id", "_source", "_mark"]
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before")
    sizes = sizes.select(*[F.col(k).alias(f"{k}_") for k in (*keys, "_part")], before)
    same = F.lit(True)
    for k in (*keys, "_part"):
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_mark")) + F.col("_before")
    more = rows.join(sizes, same).withColumn("_copies", F.col("_copies") + (nth <= F.col("_more")).cast("int"))
    return more.drop("_part", "_before", *[f"{k}_" for k in (*keys, "_part")])
