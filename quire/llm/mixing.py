"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source needs target / source_size copies of each document on average. The whole part of
that is allocated for certain; the fraction is the mean inclusion probability p of one more
copy. Longer documents are likelier: a document has p + d (g - G), with g = size / (size +
HALF) in thousandths, G the mean of g over the words of the source and d half the smaller of
p and 1 - p, so that probabilities stay inside (p - d, p + d) and the expected words are the
words lacked. Of these a sample of fixed size is taken in Pareto order: by the odds of u, a
stable hash of the row, over the odds of inclusion, smallest first, until the words that the
source lacks are reached. The cut is found in two steps, words per (source, slice of ranks)
and then rank order inside the one slice where the cut falls, so no source is ever sorted in
one task; it is then one row per source, and applying it is a map.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows alike in all of doc_id and text share their u and are taken or left together;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.util import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a document halfway between the least and the greatest inclusion probability.
HALF = 100
#: Slices of ranks for finding the cut; the slice where a cut falls holds about 1/SLICES of its source.
SLICES = 16384
#: Plans with more sources than this join them instead of broadcasting (each row is under 200 bytes plus its name).
MAX_BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """docs with __size (words) and __u (0 to 1, a stable hash of doc_id and text)."""
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), F.md5("text")))
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "__u": (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52),
    })


def targets(per_source: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, mean_lift) -> also target: weights repeat over sources in code-point order, targets stop at most x source_size.

    Sharing the excess again by weight until no target is above its stop fills sources in
    the order of stop / weight up to one common level; one row per source is all it reads.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    stopped = per_source.withColumn("w", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    levels = stopped.select(
        "source", "source_size", "mean_lift", "w", "stop",
        ((F.sum("source_size").over(everything) * F.lit(float(total_share)) - (F.sum("stop").over(by_ratio) - F.col("stop")))
         / (F.sum("w").over(everything) - (F.sum("w").over(by_ratio) - F.col("w")))).alias("level"),
        F.row_number().over(by_ratio).alias("k"))
    open_ = F.when(F.col("level") < F.col("stop") / F.col("w"), F.struct("k", "level"))
    return levels.withColumn("first", F.min(open_).over(everything)).select(
        "source", "source_size", "mean_lift",
        F.round(F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("stop"))
                .otherwise(F.col("first.level") * F.col("w")), 6).alias("target"))


def rank(u, p):
    """The Pareto rank: odds of u over odds of p."""
    return (u / (1 - u)) / (p / (1 - p))


def lift(size):
    """How much likelier a document of this size is, in thousandths."""
    return F.floor(size * 1000.0 / (size + HALF)).cast("long")


def inclusion(size, p, mean_lift):
    """The inclusion probability of one more copy of a document."""
    return p + F.least(p, 1 - p) / 2 * (lift(size) / 1000.0 - mean_lift)


def cuts(slim: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """One row per source: whole copies for all, p, and the largest rank that gets one more (null: none)."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(copies).cast("long")).withColumn("p", copies - F.col("whole")).withColumn(
        "lacks", F.col("target") - F.col("whole") * F.col("source_size"))
    named = plan.select(F.col("source").alias("of"), "p", "mean_lift")
    odds = slim.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("of"))).where("p > 0").select(
        "source", "size", rank(F.col("u"), inclusion(F.col("size"), F.col("p"), F.col("mean_lift"))).alias("rank"))
    sliced = odds.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES))
    per_slice = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("slice")
    run_up = per_slice.withColumn("before", F.sum("words").over(run) - F.col("words"))
    at = run_up.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).where(
        (F.col("p") > 0) & (F.col("before") < F.col("lacks"))).groupBy(F.col("p.source").alias("source"), "p", "lacks").agg(
        F.max(F.struct("slice", "before")).alias("at"))
    inside = sliced.alias("s").join(at.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")) & (F.col("s.slice") == F.col("a.at.slice")))
    tied = inside.groupBy(F.col("a.source").alias("source"), "p", "lacks", F.col("at.before").alias("before"), "rank").agg(F.sum("size").alias("words"))
    reached = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")) - F.col("words")
    near = tied.withColumn("reached", reached).groupBy("source", "p").agg(
        F.max(F.when(F.col("reached") + F.col("words") / 2 <= F.col("lacks"), F.col("rank"))).alias("last"),
        F.min("rank").alias("least"))
    # Where no row of the slice is taken, the cut lies just below its least rank.
    cut = near.select("source", F.coalesce("last", F.col("least") * (1 - 2e-16)).alias("cut"))
    return plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with __size, __source_size, __target and __copies (how often the mix takes the row)."""
    sized = sizes(docs)
    slim = stage(sized.select("source", F.col("__size").alias("size"), F.col("__u").alias("u")), "mix-sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * lift(F.col("size"))).alias("lifted"))
    per_source = stage(per_source.withColumn("mean_lift", F.when(F.col("source_size") > 0, F.col("lifted") / 1000.0 / F.col("source_size")).otherwise(0.0)), "mix-sources")
    small = per_source.count() <= MAX_BROADCAST_SOURCES
    plan = stage(targets(per_source, weights, total_share, most), "mix-plan")
    found = stage(cuts(slim, plan, small), "mix-cuts")
    named = found.select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "whole", "p", "mean_lift", "cut")])
    out = sized.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("__source")))
    extra = (F.col("__p") > 0) & (rank(F.col("__u"), inclusion(F.col("__size"), F.col("__p"), F.col("__mean_lift"))) <= F.col("__cut"))
    return out.withColumn("__copies", F.col("__whole") + F.coalesce(extra, F.lit(False)).cast("long")).drop(
        "__source", "__whole", "__p", "__mean_lift", "__cut", "__u")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, with the columns of the documents only."""
    return mixed.withColumn("__copy", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies").cast("int"))))).drop(
        "__copy", "__copies", "__size", "__source_size", "__target")


def op9_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), md5(text))), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE WHEN sum(size) > 0 THEN sum(size * CAST(floor(size * 1000.0::DOUBLE / (size + 100)) AS BIGINT))::DOUBLE / 1000.0::DOUBLE / sum(size)::DOUBLE ELSE 0 END AS mean_lift
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w,
         source_size * 2.0::DOUBLE AS stop FROM per),
ordered AS (SELECT *, row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(stop) OVER (ORDER BY k) - stop))
            / (sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w)) AS level FROM ordered),
first AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM levels WHERE level < stop / w),
plan AS (
  SELECT l.source, l.source_size, l.mean_lift,
         round(CASE WHEN f.k IS NULL OR l.k < f.k THEN l.stop ELSE f.level * l.w END, 6) AS target
  FROM levels l LEFT JOIN first f ON true),
parts AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM plan),
chances AS (
  SELECT s.doc_id, s.size, s.u, p.source, p.source_size, p.target, p.whole, p.copies - p.whole AS p,
         p.target - p.whole * p.source_size AS lacks,
         (p.copies - p.whole) + least(p.copies - p.whole, 1 - (p.copies - p.whole)) / 2
           * (CAST(floor(s.size * 1000.0::DOUBLE / (s.size + 100)) AS BIGINT) / 1000.0::DOUBLE - p.mean_lift) AS chance
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
odds AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM chances),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, rank) AS words FROM odds)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND upto - words / 2.0 <= lacks THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
