"""The surface for queries of one's own: a kernel over batches with shared read-only data, and user aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import AttributeScope

#: Bytes of shared data that may be broadcast, by its Arrow size.
MOST_SHARED = 512 << 20


def run_kernel(df: DataFrame, kernel: Callable[[pa.RecordBatch, Any], Iterator[pa.RecordBatch]], schema: str, shared: pa.Table | None = None) -> DataFrame:
    """A table-valued function: kernel(batch, shared) yields any number of output batches.

    Output streams on through Spark, so it may be of any size; a lost task is run again.
    """
    if shared is not None and shared.nbytes > MOST_SHARED:
        raise ValueError(f"shared data of {shared.nbytes} bytes; join it instead")
    held = df.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            yield from kernel(batch, held.value)

    return df.mapInArrow(run, schema)


#: Keys whose partial results a task holds before it hands them on.
MOST_KEYS = 100_000

State = float | Sequence[float]


def aggregate(df: DataFrame, scope: AttributeScope, init: Callable[[], State], update: Callable[[State, pa.RecordBatch], State], merge: Callable[[State, State], State], key: str | None = None) -> DataFrame:
    """A user aggregate: zero, add a batch, merge partial results. A state is a number or a sequence of numbers.

    Scope NONE: no rows. GLOBAL: one row value. PARTITION: partition, value for each
    partition. KEY: key (of its own type), value. A task sorts each batch by key, so
    every row is seen once, and holds at most MOST_KEYS states; partial results of a key
    are merged after one shuffle. value is a double, or an array of them.
    """
    many = not isinstance(init(), int | float)
    out = F.col("state") if many else F.col("state")[0]
    if scope is AttributeScope.NONE:
        return df.sparkSession.createDataFrame([], f"value {'array<double>' if many else 'double'}")
    kind = df.schema[key].dataType.simpleString() if key else "int"
    schema = f"part long, key {kind}, state array<double>"

    def listed(state: State) -> list[float]:
        return [float(x) for x in state] if many else [float(state)]

    def back(values: list[float]) -> State:
        return values if many else values[0]

    def partial(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        states: dict[Any, State] = {}
        arrow_kind = pa.int32()

        def handed_on():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(states), pa.int64()), pa.array(list(states), arrow_kind), pa.array(map(listed, states.values()), pa.list_(pa.float64()))], ["part", "key", "state"])
            states.clear()

        for batch in batches:
            if key is None:
                states[None] = update(states.get(None, init()), batch)
                continue
            column = batch.column(key)
            arrow_kind = column.type
            codes = column.dictionary_encode()
            place = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            place, batch = place[order], batch.take(pa.array(order))
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
            for at, end in zip(first, [*first[1:], len(place)], strict=True):
                name = None if place[at] < 0 else codes.dictionary[int(place[at])].as_py()
                states[name] = update(states.get(name, init()), batch.slice(at, end - at))
            if len(states) > MOST_KEYS:
                yield from handed_on()
        if states:
            yield from handed_on()

    def merged(table: pa.Table) -> pa.Table:
        state = init()
        for x in table.column("state").to_pylist():
            state = merge(state, back(x))
        return pa.table({"part": table.column("part").slice(0, 1), "key": table.column("key").slice(0, 1), "state": pa.array([listed(state)], pa.list_(pa.float64()))})

    rows = df.mapInArrow(partial, schema)
    if scope is AttributeScope.PARTITION:
        return rows.select(F.col("part").alias("partition"), out.alias("value"))
    if scope is AttributeScope.KEY:
        return rows.groupBy("key").applyInArrow(merged, schema).select("key", out.alias("value"))
    # One row of partial results for each task.
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(merged, schema).select(out.alias("value"))
