"""Connected components of a table of links, with joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.util import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (u, v): label is the least node of its component.

    Alternating large and small stars: each round hangs every node's larger neighbours, then
    the smaller ones, on the least it knows. A round is two groupings and two joins on slim
    rows and is written to the shared folder; the driver sees only a count and a checksum.
    Nodes may be of any type that can be ordered. A node with a third of all links is split
    by the adaptive join. No links give no rows.
    """
    up = F.col("u") > F.col("v")
    ordered = links.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("v"))
    edges = stage(ordered.where("u <> v").distinct(), "links")
    before, now = None, _mark(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "small")
        before, now = now, _mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

