"""Merkle manifest of a table: a tree of digests per group, a tree over the groups, and a proof per row.

A row's leaf is the digest of its fields, each `-` if null, else its length in bytes, a colon
and its value. In each group the leaves ascend by id; every FANOUT consecutive nodes have
the digest of their digests as parent until one node is left; the groups' nodes, ordered by
group, rise the same way to the root.

Checkpoint and recompute: only every STRIDE-th level is stored. A proof regenerates the
levels between from the FANOUT ** STRIDE stored descendants of an aligned subtree, hands on
the siblings of each and forgets the rest, from the top stratum down. So what a task holds
of a tree is bounded, whatever the size of a group, and of a table's texts only digests are
shuffled. Places of leaves come from one range shuffle of slim rows and one count per range
and group; nothing but the depth and the root reaches the driver.

Defined results: null ids come first and null groups too; rows with one id are ordered by
their leaf, equal rows anyhow (they have equal digests, each its own place); a null id is
never tampered with; an empty text has length 0, unlike a null one; very long texts are
digested whole in their own row; an empty table gives no rows and has no root. Columns other
than the named ones are neither read nor digested.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.util import let, stage

FANOUT, STRIDE = 8, 3
SPAN = FANOUT**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that one range of the ordering holds, about.
RANGE_ROWS = 1_000_000
#: Levels that a tree of up to 2 ** 63 leaves can have.
MOST_LEVELS = 21
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(framed, fields))


def levels(n: Column) -> Column:
    """How often n nodes must be taken together until one is left."""
    above = F.lit(0)
    for k in range(MOST_LEVELS):
        above = above + (n > FANOUT**k).cast("int")
    return above


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with idx (from 0, in this order, nulls first) and n (rows) within the group; null is a group too.

    One range shuffle by group, order and a number of the row, so that neither a large group
    nor many equal rows meet in one task; then each range's rows are counted on from those before.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    keys = [*group, *order, "__row"]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__row")
    laid = stage(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("__at", 33)
    named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    found = laid.groupBy(*named, part.alias("__part")).agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__rows"))
    names = [f"__g{i}" for i in range(len(group))]
    over = Window.partitionBy(*names) if group else Window.partitionBy(F.lit(0))
    earlier = over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = found.select(*names, "__part", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__from")).alias("__shift"), F.sum("__rows").over(over).alias("n"))
    met = F.shiftright("__at", 33) == F.col("__part")
    for c, name in zip(group, names):
        met = met & F.col(c).eqNullSafe(F.col(name))
    return laid.join(bounds, met).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift", *names)


def risen(nodes: Column) -> Column:
    """The parents of these nodes (array of digests, in order, from the first of a run)."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def raised(further: Column, nodes: Column) -> Column:
    return F.when(further, risen(nodes)).otherwise(nodes)


def subtrees(stratum: DataFrame, s: int, more: Sequence[str] = ()) -> DataFrame:
    """(tree, up, depth, nodes, others): the stored nodes of each aligned subtree in order, at most SPAN."""
    held = F.struct("idx", "node", *more)
    return stratum.groupBy("tree", "n", F.floor(F.col("idx") / SPAN).alias("up")).agg(F.array_sort(F.collect_list(held)).alias("held")).select(
        "tree", "n", "up", (levels(F.col("n")) - s * STRIDE).alias("depth"), "held", F.transform("held", lambda x: x["node"]).alias("nodes"))


class Forest(NamedTuple):
    """The stored levels of trees: strata[s] holds level s * STRIDE as (tree, n, idx, node), n being the tree's leaves; tops (tree, n, node)."""

    strata: list[DataFrame]
    tops: DataFrame


def grown(leaves: DataFrame) -> Forest:
    """The forest over placed leaves (tree, n, idx, node, ...)."""
    strata, deepest = [leaves], leaves.agg(F.max(levels(F.col("n")))).first()[0] or 0
    tops = leaves.where("n = 1").select("tree", "n", "node")
    for s in range(-(-deepest // STRIDE)):
        below = strata[-1] if s == 0 else strata[-1].where(levels(F.col("n")) > s * STRIDE)
        top = F.col("nodes")
        for k in range(STRIDE):
            top = let(top, partial(raised, F.col("depth") > k))
        above = subtrees(below.where("n > 1"), s).select("tree", "n", F.col("up").alias("idx"), F.get(top, F.lit(0)).alias("node"))
        strata.append(stage(above, "merkle-level"))
        tops = tops.unionByName(strata[-1].where((levels(F.col("n")) > s * STRIDE) & (levels(F.col("n")) <= (s + 1) * STRIDE)).select("tree", "n", "node"))
    return Forest(strata, tops)


def beside(nodes: Column, at: Column) -> Column:
    """The siblings of the node at this place, joined, before and after it."""
    first = F.floor(at / FANOUT).cast("int") * FANOUT
    before = F.slice(nodes, first + 1, at - first)
    after = F.slice(nodes, at + 2, first + FANOUT - 1 - at)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def paths(forest: Forest, tops: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(tree, idx, node, path, *more) of every leaf; tops (tree, path) says what follows above a tree's top.

    A path is the digests beside a node in its run, before and after, level by level upwards.
    """
    known = None
    for s in range(len(forest.strata) - 1, -1, -1):
        here = forest.strata[s]
        # Above a subtree: the path of its top, which is a node of the next stratum or the top of its tree.
        ends = here.where((levels(F.col("n")) <= (s + 1) * STRIDE) & (F.col("idx") == 0)).select("tree", F.col("idx").alias("up")).join(tops, "tree")
        above = ends if known is None else ends.unionByName(known.select("tree", F.col("idx").alias("up"), "path"))
        kept = [] if s else list(more)
        joined = subtrees(here.where(levels(F.col("n")) >= s * STRIDE) if s == 0 else here.where(levels(F.col("n")) > s * STRIDE), s, kept).join(above.withColumnRenamed("path", "rest"), ["tree", "up"])

        def spread(a: Column, b: Column, c: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                rows = [beside(a, i), beside(b, F.floor(i / FANOUT).cast("int")), beside(c, F.floor(i / FANOUT**2).cast("int"))]
                own = F.slice(F.array(*rows), F.lit(1), F.greatest(F.least(F.col("depth"), F.lit(STRIDE)), F.lit(0)))
                return F.struct(x["idx"].alias("idx"), x["node"].alias("node"), F.concat(own, F.col("rest")).alias("path"), *[x[m].alias(m) for m in kept])

            return F.transform("held", one)

        spread_out = let(F.col("nodes"), lambda a: let(risen(a), lambda b: let(risen(b), lambda c: spread(a, b, c))))
        known = joined.select("tree", F.inline(spread_out))
        if s:
            known = stage(known.select("tree", "idx", "path"), "merkle-paths")
    return known


def folded(node: Column, path: Column) -> Column:
    """The root that a node leads to along its path."""
    return F.aggregate(path, node, lambda below, x: F.sha2(F.concat(x["before"], below, x["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, joined in order."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def manifest(rows: DataFrame, group: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """Of rows with group, order, node (leaf) and the columns to keep: those with subroot, root and path (array of before and after)."""
    slim = stage(rows.select(group, order, "node", *keep), "merkle-leaves")
    leaves = placed(slim, [group], [order, "node"])
    groups = stage(leaves.where("idx = 0").select(group, F.col("n").alias("leaves")), "merkle-groups")
    ranked = placed(groups, [], [group]).select(F.col(group).alias("__group"), F.col("idx").alias("tree"), F.col("n").alias("trees"))
    ranked = stage(ranked, "merkle-trees")
    more = [order, *keep]
    numbered = leaves.join(ranked, F.col(group).eqNullSafe(F.col("__group"))).select("tree", "n", "idx", "node", *more)
    forest = grown(stage(numbered, "merkle-numbered"))
    upper = forest.tops.join(ranked, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("idx"), "node")
    above = grown(stage(upper, "merkle-subroots"))
    root = above.tops.select("node").first()
    none = above.tops.select("tree", F.array().cast(f"array<{STEP}>").alias("path"))
    over = stage(paths(above, none).select(F.col("idx").alias("tree"), F.col("node").alias("subroot"), "path"), "merkle-tops")
    found = paths(forest, over.select("tree", "path"), more).join(over.select("tree", "subroot"), "tree")
    return found.withColumn("root", F.lit(root["node"] if root else None).cast("string"))


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    text, upper, lower = F.col("text"), string.ascii_uppercase, string.ascii_lowercase
    fields = {name: F.col(name) for name in FIELDS}
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))
    altered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & text.rlike("[A-Z]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("__lang"), leaf(list(fields.values())).alias("node"),
                       F.when(altered, leaf(list((fields | {"text": lowered}).values()))).alias("forged"))
    found = manifest(rows, "__lang", "doc_id", ["forged"])
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                       folded(F.coalesce("forged", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The unsigned crc32 of a string of ASCII characters, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda u, v: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    written = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in written) + ")"


def _rise_sql(name: str, leaves: str) -> str:
    run = "PARTITION BY tree, lvl, idx // 8 ORDER BY idx ROWS BETWEEN"
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, idx, n, node FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8, n),
{name}_beside AS (
  SELECT tree, lvl, idx, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS low,
         coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS high FROM {name} WHERE n > 1)"""


def _fold_sql(name: str, start: str, by: str) -> str:
    return f"""{name} AS ({start}
  UNION ALL SELECT f.place, f.tree, f.lvl + 1, f.idx // 8, sha256(low || cur || high), proof || low || high FROM {name} f JOIN {by}_beside b ON b.tree = f.tree AND b.lvl = f.lvl AND b.idx = f.idx)"""


ORACLE = f"""
WITH RECURSIVE lowered AS (SELECT *, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
digests AS (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf, CASE WHEN {CRC_SQL.format('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql('low')} END AS forged FROM lowered),
rows_ AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n, leaf AS node, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS place FROM digests),
{_rise_sql('low', 'rows_')},
subroots AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, node, node AS subroot FROM low WHERE n = 1),
{_rise_sql('top', 'subroots')},
{_fold_sql('up', "SELECT place, tree, 0 AS lvl, idx, coalesce(forged, leaf) AS cur, '' AS proof FROM rows_", 'low')},
over AS (SELECT place, 0 AS tree, 0 AS lvl, any_value(tree) AS idx, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM up GROUP BY place),
{_fold_sql('ended', 'SELECT * FROM over', 'top')},
done AS (SELECT place, arg_max(cur, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM ended GROUP BY place)
SELECT r.doc_id, r.leaf, s.subroot, t.node AS root, d.proof_sha256, d.folded_root, d.folded_root = t.node AS verified
FROM rows_ r JOIN done d USING (place) JOIN subroots s ON s.idx = r.tree JOIN top t ON t.n = 1
"""
