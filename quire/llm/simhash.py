"""SimHash document fingerprints, in DataFrame functions only.

Terms are pairs of neighbouring words, weighted by how often they occur. Each 64-bit term
hash votes on 64 signed bits; two of the bit counters share one long (they lie 32 bits
apart), so the votes of a text are 32 sums. The texts are co-partitioned by a 128-bit row
key before terms are exploded, so votes are summed in the task that made them and no term
is ever shuffled.

Near fingerprints come from permuted block tables: the 64 bits are cut into blocks, each
table puts some of the blocks in front as its key, and any two fingerprints within the
radius agree on all blocks of at least one table.

Defined results: a null text is empty; a text without words has the fingerprint of the
empty pair; null doc_ids come after all others; rows alike in doc_id and text stand at one
place in the order and get the same result; a single document is its own next; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.util import hash128, stage

BITS = 64
LANES = 0x100000001  # bits 0 and 32


def terms(text: Column) -> Column:
    """The pairs of neighbouring words, with an empty word before the first and after the last."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    none = F.array(F.lit(""))
    return F.arrays_zip(F.concat(none, words).alias("a"), F.concat(words, none).alias("b"))


def votes(term_hash: Column) -> list[Column]:
    """32 sums; sum i counts the set bits i in its low half and i + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(term_hash, i).bitwiseAND(F.lit(LANES))).alias(f"v{i}") for i in range(BITS // 2)]


def fingerprint(weight: Column) -> Column:
    """The 64 signs as a long: a bit is set if its votes are more than half of the weight."""
    bits = []
    for i in range(BITS // 2):
        v = F.col(f"v{i}")
        for at, count in ((i, v.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(v, 32))):
            one = 1 << at
            bits.append(F.when(count * 2 > weight, F.lit(one - (1 << 64) if at == 63 else one)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp of each group of keys (one text per group, or the same text repeated)."""
    exploded = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    hashed = exploded.select(*keys, F.xxhash64("t.a", "t.b").alias("h"))
    voted = hashed.groupBy(*keys).agg(*votes(F.col("h")), F.count(F.lit(1)).alias("weight"))
    return voted.select(*keys, fingerprint(F.col("weight")).alias("fp"))


def near_pairs(fps: DataFrame, radius: int = 3, blocks: int = 6, fp: str = "fp") -> DataFrame:
    """All pairs a < b of distinct fingerprints that differ in at most radius bits, once each.

    blocks - radius blocks form the key of each of the C(blocks, radius) tables, 32 bits for
    the defaults. Copies count once: pass any table with a column of fingerprints.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    distinct = fps.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    entries = distinct.select("fp", F.inline(tables))
    a, b = entries.withColumnRenamed("fp", "a"), entries.withColumnRenamed("fp", "b")
    within = a.join(b, ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return within.select("a", "b").distinct()


def next_rows(keyed: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n1, n2, quarter, n): each row key, the key of the row after it, and a quarter of its code points.

    Order is by doc_id, nulls last, then by key; the row after the last is the first. The
    order is cut into ranges, each range finds its own neighbours, and only the first row of
    each range is passed on to the range before.
    """
    spark = keyed.sparkSession
    slim = keyed.groupBy("doc_id", "k1", "k2").agg(F.first(F.floor(F.char_length("text") / 4)).alias("quarter"), F.count(F.lit(1)).alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = [F.col("doc_id").asc_nulls_last(), F.col("k1"), F.col("k2")]
    ranged = stage(slim.repartitionByRange(parts, *place).withColumn("part", F.spark_partition_id()), "simhash-order")
    after = F.lead(F.struct("k1", "k2")).over(Window.partitionBy("part").orderBy(*place))
    firsts = ranged.groupBy("part").agg(F.min_by(F.struct("k1", "k2"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    in_order = Window.orderBy("part")
    passed = firsts.select("part", F.coalesce(F.lead("first").over(in_order), F.first("first").over(in_order)).alias("over"))
    linked = ranged.withColumn("after", after).join(passed, "part").withColumn("after", F.coalesce("after", "over"))
    return linked.select("doc_id", "k1", "k2", F.col("after.k1").alias("n1"), F.col("after.k2").alias("n2"), "quarter", "n")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fp, edited_fp and next_fp."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k1, k2 = hash128("doc_id", "text")
    links = stage(next_rows(whole.withColumns({"k1": k1, "k2": k2})), "simhash-links")
    keyed = whole.select("text", k1.alias("k1"), k2.alias("k2"))  # alike in both joins below, so it is shuffled once
    if links.where("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["k1", "k2"])
    heads = keyed.join(links.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "quarter"), ["k1", "k2"])
    heads = heads.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.col("quarter").cast("int")).alias("head"), "quarter")
    n_chars = F.char_length("text")
    joined = keyed.join(heads, ["k1", "k2"]).select(
        "k1", "k2", n_chars.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), (n_chars - F.col("quarter")).cast("int")), "head").alias("edited"))
    both = joined.select("k1", "k2", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                         F.explode(F.array(F.struct(F.lit(False).alias("side"), F.col("text").alias("t")), F.struct(F.lit(True).alias("side"), F.col("edited").alias("t")))).alias("x"))
    keys = ["k1", "k2", "n_chars", "edited_sha256", "side"]
    fps = fingerprints(both.select(*keys[:-1], "x.side", "x.t"), keys, "t")
    made = stage(fps.groupBy("k1", "k2", "n_chars", "edited_sha256").agg(
        F.max(F.when(~F.col("side"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("side"), F.col("fp"))).alias("edited_fp")), "simhash-made")
    nexts = made.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fp").alias("next_fp"))
    out = made.join(links, ["k1", "k2"]).join(nexts, ["n1", "n2"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    return edited_fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
