"""Groups of sorted rows inside a task, without a call into Spark for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Each run of rows with equal (non-null, integer) keys as one table, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k)), np.int64) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1), len(batch)]
        if held and not np.array_equal(last, values[:, 0]):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = values[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def apply_to_groups(df: DataFrame, keys: Sequence[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One call of ``work`` per group of equal keys; groups must be bounded by the caller."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            found = work(group)
            if found is not None and len(found):
                yield found

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)
