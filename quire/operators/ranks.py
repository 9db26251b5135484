"""Running sums over ordered rows of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], rows_each: int = RANGE_ROWS) -> DataFrame:
    """rows with, by name, the sum of a value over the rows before in the group; ties in the order are broken anyhow.

    Rows are dealt out in ranges by group and order and summed within each; a range then adds
    what the group's ranges before it sum up to. A window never holds more of a group than a
    range has.
    """
    spark, keys = rows.sparkSession, [*group, *order, "__row"]
    named = rows.withColumns({f"__{name}": value.cast("long") for name, value in sums.items()} | {"__row": F.monotonically_increasing_id()})
    slim = staged(named, "running")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.count() // rows_each + 1)
    laid = staged(slim.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "running-ranges")
    own = Window.partitionBy("__part", *group).orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("__part", *[F.col(c).alias(f"__g_{c}") for c in group]).agg(*[F.sum(f"__{name}").alias(f"__of_{name}") for name in sums])
    before = Window.partitionBy(*[f"__g_{c}" for c in group]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("__part").alias("__at"), *[f"__g_{c}" for c in group], *[F.coalesce(F.sum(f"__of_{name}").over(before), F.lit(0)).alias(f"__to_{name}") for name in sums])
    met = F.col("__part") == F.col("__at")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    summed = laid.withColumns({name: F.coalesce(F.sum(f"__{name}").over(own), F.lit(0)) for name in sums}).join(offsets, met)
    return summed.select(*rows.columns, *[(F.col(name) + F.col(f"__to_{name}")).alias(name) for name in sums])
