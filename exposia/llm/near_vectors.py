"""Near-duplicate vectors by collision counting over sorted projections.

Vectors are dealt to cells by the signs of random projections, in several tables whose number is
computed for the wanted recall. In a cell every vector is projected on 32 random lines; each line
is sorted and every vector takes the window of those near it. Pairs that meet in enough windows, a
count calibrated so that linked pairs reach it almost surely, are checked exactly. A pair
counts only in the first table where its cells agree, so links are counted once without
bringing pairs together.

Equal vectors are one class before all this. Large cells are dealt to blocks and each pair of blocks is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposia.llm.components import components
from exposia.llm.groups import apply_to_groups
from exposia.sources.staging import materialize

COSINE = 0.9
RECALL = 0.99
LINES = 32
REACH = 0.998  # chance that a pair at the threshold reaches the collision count
CELL = 200
BLOCK = 1024
_WINDOW = 0.75
_SEED = 20_240_501


def tables_for(n: int) -> tuple[int, int]:
    """Signs per key and number of tables for n classes: a pair at the threshold shares a key with
    chance RECALL or more."""
    signs = max(2, math.ceil(math.log2(max(n, 1) / CELL))) if n > CELL else 2
    same = (1 - math.acos(COSINE) / math.pi) ** min(signs, 62)
    return min(signs, 62), math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def least_collisions() -> int:
    """The largest count that a pair at the threshold reaches with chance REACH."""
    spread = math.sqrt(2 - 2 * COSINE)
    p = math.erf(_WINDOW / spread / math.sqrt(2))
    chance = 0.0
    for c in range(LINES, -1, -1):
        chance += math.comb(LINES, c) * p**c * (1 - p) ** (LINES - c)
        if chance >= REACH:
            return c
    return 0


def _lines(dim: int, count: int, stream: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim, stream]).standard_normal((dim, count))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each vector in double precision; null where it can link with nothing."""
    for batch in batches:
        raw = []
        for value in batch.column("embedding").to_pylist():
            if not value or None in value:
                raw.append(None)
                continue
            x = np.asarray(value, np.float64) + 0.0  # -0 becomes 0
            good = np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
            raw.append(x.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(signs: int, tables: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raw])
            keys = np.zeros((len(raw), tables), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                side = _units([raw[i] for i in at]) @ _lines(size // 8, signs * tables, 1) > 0
                powers = 1 << np.arange(signs, dtype=np.int64)
                keys[at] = (side.reshape(len(at), tables, signs) * powers).sum(axis=2)
            offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
            columns = [batch.column("rep"), batch.column("n"), batch.column("raw"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "raw", "keys"])

    return rows


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many lines have the pair within one window, for all pairs of two blocks of projections."""
    count = np.zeros((len(left), len(right)), np.uint8)
    rows = np.arange(len(left))
    for a, b in zip(left.T, right.T):
        order = np.argsort(b, kind="stable")
        first = np.searchsorted(b[order], a - _WINDOW, "left")
        last = np.searchsorted(b[order], a + _WINDOW, "right")
        edges = np.zeros((len(left), len(right) + 1), np.int8)
        edges[rows, first] += 1
        edges[rows, last] -= 1
        count[:, order] += np.cumsum(edges, axis=1, dtype=np.int8)[:, :-1].view(np.uint8)
    return count


def _links_of_cell(group: pa.Table) -> pa.RecordBatch | None:
    """Per class of a cell (or pair of blocks): linked vectors and a class of its component."""
    raw = group["raw"].to_pylist()
    table = group["table"][0].as_py()
    rep, n, side = (group[c].to_numpy() for c in ("rep", "n", "side"))
    keys = np.stack(group["keys"].to_numpy())
    parts = [p for s in (0, 1) if len(p := np.flatnonzero(side == s))]
    found, linked, root = least_collisions(), np.zeros(len(rep), np.int64), np.arange(len(rep))
    unit = _units(raw)
    line = unit @ _lines(unit.shape[1], LINES, 2)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = parts[0], parts[-1]
    for start in range(0, len(a), BLOCK):
        for begin in range(0, len(b), BLOCK):
            x, y = a[start : start + BLOCK], b[begin : begin + BLOCK]
            i, j = np.nonzero(collisions(line[x], line[y]) >= found)
            i, j = x[i], y[j]
            if len(parts) == 1:
                i, j = i[i < j], j[i < j]
            earlier = (keys[i, :table] == keys[j, :table]).any(axis=1)
            i, j = i[~earlier], j[~earlier]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= COSINE
            i, j = i[near], j[near]
            np.add.at(linked, i, n[j])
            np.add.at(linked, j, n[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    some = np.flatnonzero(linked)
    if not len(some):
        return None
    tops = np.array([top(i) for i in some])
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(linked[some]), pa.array(rep[tops])], names=["rep", "linked", "root"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing.
    Vectors of different lengths do not link. Equal vectors link with cosine 1. Rows that repeat a
    vec_id are vectors of their own under one name. A null vec_id links and counts like any other, keeps no name
    of its own and takes that of its component's smallest id, null if there is none; ``kept`` is
    then false. Other columns are ignored.
    """
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    raw = materialize(raw.mapInArrow(_clean, "vec_id long, raw binary"), "vectors")
    classes = raw.filter("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("rep", F.xxhash64("raw")), "classes")
    signs, tables = tables_for(classes.count())
    keyed = classes.select("rep", "n", "raw").mapInArrow(_keys(signs, tables), "rep long, n long, raw binary, keys array<long>")
    rows = keyed.select("rep", "n", "raw", "keys", F.posexplode("keys").alias("table", "cell"), F.octet_length("raw").alias("size"))
    cell = ["size", "table", "cell"]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    counts = materialize(counts.withColumn("_n", F.ceil(F.col("_rows") / BLOCK).cast("int")).drop("_rows"), "cells")
    rows = rows.join(counts, cell).withColumn("_p", F.pmod(F.xxhash64("rep", "table"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumns({"low": F.least("_p", "_q"), "high": F.greatest("_p", "_q"), "side": (F.col("_p") > F.col("_q")).cast("int")})
    rows = rows.drop("_n", "_p", "_q").withColumn("table", F.col("table").cast("long"))
    found = apply_to_groups(rows, [*cell, "low", "high"], _links_of_cell, "rep long, linked long, root long")
    found = materialize(found, "links")
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    label = classes.select("rep", "raw", "n", "least").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    label = label.join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    name = label.groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(name, "component").select(
        "raw", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    whole = raw.join(label, "raw", "left")
    component = F.coalesce("component_id", F.when(F.col("raw").isNull(), F.col("vec_id")))
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
