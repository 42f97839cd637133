"""Aggregates written in Python, with a state that is merged over several levels.

Tasks reduce what they read to one state for each key; only states are shuffled, first to a
number of shards of each key, then to the key. So no task sees more than its share of rows, or
of states, and a key with most of the rows is no special case.
"""

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.schema import free_names

# Shards of a key at each level of merging; the last one brings a key together.
LEVELS = (1024, 32, 1)
# Keys whose states a task holds at once. Beyond that it gives them out and starts again.
HELD_KEYS = 10_000


class UserAggregate(Protocol):
    """What a user writes. States have to be picklable and of bounded size."""

    def init(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, rows: pa.RecordBatch) -> Any:
        """The state with some more rows."""

    def merge(self, state: Any, other: Any) -> Any:
        """The state of the rows of both."""

    def finish(self, state: Any) -> dict:
        """The result columns by name."""


def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    if not keys:
        yield (), batch
        return
    rows: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
        rows.setdefault(key, []).append(row)
    for key, places in rows.items():
        yield key, batch.take(pa.array(places))


def aggregate(
    df: DataFrame,
    user: UserAggregate,
    result: T.StructType | str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """One row with the ``result`` columns for each combination of ``keys``, or for all rows.

    ``user`` gets batches of ``columns`` only. Without keys an empty table gives the result of
    the initial state, with keys no row. Rows with a null key are a group. ``result`` may not
    have the name of a key.
    """
    if levels[-1] != 1:
        raise ValueError("the last level has to have one shard")
    keys, held = list(keys), HELD_KEYS
    if isinstance(result, str):
        result = T.StructType.fromDDL(result)
    if set(result.names) & set(keys):
        raise ValueError(f"result columns have names of keys: {sorted(set(result.names) & set(keys))}")
    state, shard = free_names(keys, "state", "shard")
    key_fields = [df.schema[k] for k in keys]
    shape = T.StructType(
        [*key_fields, T.StructField(state, T.BinaryType()), T.StructField(shard, T.IntegerType())]
    )
    # Keys may be among the columns the user gets.
    rows = df.select(*dict.fromkeys([*keys, *columns]))

    def given_out(states, task):
        values = [*zip(*states)] if keys else []
        arrays = [pa.array(list(v), type=t) for v, t in zip(values, key_types)]
        arrays += [pa.array([pickle.dumps(s) for s in states.values()], pa.binary())]
        arrays += [pa.array([task] * len(states), pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, state, shard])

    key_types = _arrow_types(key_fields)

    def reduce(batches):
        states, task = {} if keys else {(): user.init()}, TaskContext.get().partitionId()
        for batch in batches:
            for key, part in _groups(batch, keys):
                if key not in states and len(states) >= held:
                    yield given_out(states, task)
                    states = {}
                states[key] = user.update(states.get(key, user.init()), part.select(list(columns)))
        if states:
            yield given_out(states, task)

    def merged(batches):
        # Sorted by key, so a state is complete when the next key comes.
        now, sum_, task, done = None, None, TaskContext.get().partitionId(), {}
        for batch in batches:
            names = [*keys, shard]
            groups = zip(*(batch.column(k).to_pylist() for k in names), batch.column(state).to_pylist())
            for *key, data in groups:
                if key != now:
                    if now is not None:
                        done[(len(done), *now)] = sum_
                    if len(done) >= held:
                        yield collected(done)
                        done = {}
                    now, sum_ = key, user.init()
                sum_ = user.merge(sum_, pickle.loads(data))
        if now is not None:
            done[(len(done), *now)] = sum_
        if done:
            yield collected(done)

    def collected(done):
        values = list(zip(*done))[1:]
        arrays = [pa.array(list(v), type=t) for v, t in zip(values, key_types)]
        arrays += [pa.array([pickle.dumps(s) for s in done.values()], pa.binary())]
        arrays += [pa.array(list(values[-1]), pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, state, shard])

    def finished(batches):
        for batch in batches:
            rows = [user.finish(pickle.loads(s)) for s in batch.column(state).to_pylist()]
            arrays = [batch.column(k) for k in keys]
            arrays += [
                pa.array([r[f.name] for r in rows], type=t)
                for f, t in zip(result.fields, _arrow_types(result.fields))
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *result.names])

    states = rows.mapInArrow(reduce, shape)
    if not keys:
        # A table without partitions has no task that gives the initial state.
        empty = df.sparkSession.createDataFrame([(bytearray(pickle.dumps(user.init())), 0)], shape)
        states = states.unionByName(empty)
    for shards in levels:
        dealt = states.withColumn(shard, F.pmod(F.col(shard), F.lit(shards)).cast("int"))
        dealt = dealt.repartition(*keys, shard).sortWithinPartitions(*keys, shard)
        states = dealt.mapInArrow(merged, shape)
    return states.mapInArrow(finished, T.StructType([*key_fields, *result.fields]))


def _arrow_types(fields: Sequence[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in fields]
