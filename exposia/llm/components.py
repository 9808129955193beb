"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposia.sources.staging import materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of an edge ``a, b``; a component is named by its smallest id.

    Each round every node joins its smallest neighbour, chains are shortened, and edges are renamed
    and made distinct, so the list shrinks quickly. Nothing is collected and each round is written,
    so lost executors cost only their tasks. Edges with a null end are ignored; no edges, no rows.
    """
    edges = edges.select("a", "b").dropna()
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to"))
    both = materialize(both.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.select("id").distinct().select("id", F.col("id").alias("component"))
    both, rounds = both.filter("id != to"), []
    while not both.isEmpty():
        parent = both.groupBy("id").agg(F.least("id", F.min("to")).alias("parent"))
        above = parent.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        parent = parent.join(above, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"))
        parent = materialize(parent, "parents")
        rounds.append(parent)
        for name in ("id", "to"):
            renamed = parent.select(F.col("id").alias(name), F.col("parent").alias("_new"))
            both = both.join(renamed, name, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")
        both = materialize(both.filter("id != to").select("id", "to").distinct(), "edges")
    for parent in rounds:
        step = parent.select(F.col("id").alias("component"), "parent")
        labels = labels.join(step, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
    return materialize(labels, "components") if rounds else labels
