"""Folds over ordered rows, cut into chunks that are folded beside each other.

Some results need every row's predecessor: what a log of saves and undos leaves, on which page
a row lands. The state between two rows is small, though, and often does not reach far back.
Rows are cut into chunks of bounded size by key and order, however many a key has, and each
chunk is folded from the first state. What a chunk should have started from is what the one
before it leaves; chunks that started from something else are folded again, until all agree,
which is the fold from the first row. Two rounds are usual; where everything hangs on the
first row, it takes as many as a key has chunks. Keys within one chunk are folded once.

No key's rows are ever held at once, and a key with a third of all rows is spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged

#: Rows of a chunk, about, and rows handed on at once.
CHUNK_ROWS, BATCH_ROWS = 500_000, 10_000


class Fold(NamedTuple):
    """A fold: the state's type (in SQL and in Arrow), the state before the first row, and step(state, *values) -> (state, output).

    Between chunks a state is a dict, which load and save turn into what the step works with.
    """

    state: str
    arrow: pa.StructType
    start: Any
    step: Callable
    load: Callable = dict
    save: Callable = dict


class Agreed(NamedTuple):
    """rows with their chunk (part), and per chunk (key, part) what it began with, what it left and the sum of its outputs."""

    rows: DataFrame
    chunks: DataFrame
    key: str
    order: list[str]
    values: list[str]
    fold: Fold


def _same(key: str, other: str = "__key") -> Column:
    return F.col(key).eqNullSafe(F.col(other)) & (F.col("part") == F.col("__part"))


def _run(events: DataFrame, starts: DataFrame | None, how: Agreed, result: str, handed: Callable, each: bool) -> DataFrame:
    """The chunks folded from the given starts (key, part, began), else from the first state. each: a row of output per row, else one per chunk."""
    key, order, values, fold = how.key, how.order, how.values, how.fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, schema, total = None, [], None, 0
        began = state = fold.start
        for batch in batches:
            schema = batch.schema
            for own, part, begins, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (own, part) != now:
                    if now is not None and not each:
                        made.append((*now, fold.save(began), fold.save(state), total))
                    now, total = (own, part), 0
                    began = state = fold.start if begins is None else fold.load(begins)
                if begins is None:
                    state, out = fold.step(state, *row[len(order) :])
                    if each:
                        made.append((own, *row[: len(order)], out))
                    else:
                        total += out
                if len(made) >= BATCH_ROWS:
                    yield handed(made, schema)
                    made = []
        if now is not None and not each:
            made.append((*now, fold.save(began), fold.save(state), total))
        if made:
            yield handed(made, schema)

    rows = events.select(key, "part", F.lit(None).cast(fold.state).alias("began"), *order, *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    if starts is not None:  # the start of a chunk is its first row
        rows = rows.unionByName(starts.select(key, "part", "began"), allowMissingColumns=True)
    dealt = rows.repartition("part").sortWithinPartitions("part", key, F.col("began").isNull(), *order)
    return dealt.mapInArrow(run, result)


def _summaries(events: DataFrame, starts: DataFrame | None, how: Agreed) -> DataFrame:
    kind, arrow, names = how.rows.schema[how.key].dataType.simpleString(), how.fold.arrow, [how.key, "part", "began", "left", "total"]

    def handed(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field(0).type, pa.int32(), arrow, arrow, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    found = _run(events, starts, how, f"`{how.key}` {kind}, part int, began {how.fold.state}, left {how.fold.state}, total long", handed, False)
    return staged(found, "chunk-states")


def agreed(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], fold: Fold, rows_each: int = CHUNK_ROWS) -> Agreed:
    """The fold of each key's rows in their order (unique within a key), of which it sees the values; outputs are numbers."""
    spark, order, values = rows.sparkSession, list(order), list(values)
    slim = staged(rows.select(key, *dict.fromkeys([*order, *values])), "chunk-rows")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.count() // rows_each + 1)
    laid = staged(slim.repartitionByRange(n, key, *order).withColumn("part", F.spark_partition_id()), "chunks")
    how = Agreed(laid, laid, key, order, values, fold)
    found = _summaries(laid, None, how)
    before = Window.partitionBy(key).orderBy("part")
    while True:
        ahead = found.withColumn("due", F.lag("left").over(before))
        wrong = staged(ahead.where(F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col("began"))).select(key, "part", F.col("due").alias("began")), "chunk-starts")
        if wrong.isEmpty():
            return how._replace(chunks=found)
        theirs = wrong.select(F.col(key).alias("__key"), F.col("part").alias("__part"))
        again = _summaries(laid.join(theirs, _same(key), "left_semi"), wrong, how)
        found = staged(found.join(theirs, _same(key), "left_anti").unionByName(again), "chunk-states")


def outputs(done: Agreed, out: str, arrow: pa.DataType, step: Callable) -> DataFrame:
    """key, order and out of every row: what this step, which must leave the states of the agreed one, puts out."""
    how = done._replace(fold=done.fold._replace(step=step))
    names = [done.key, *done.order]
    kinds = ", ".join(f"`{c}` {done.rows.schema[c].dataType.simpleString()}" for c in names)

    def handed(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field(0).type, *(schema.field(3 + i).type for i in range(len(names) - 1)), arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], [*names, "out"])

    return _run(done.rows, done.chunks.select(done.key, "part", "began"), how, f"{kinds}, out {out}", handed, True)
