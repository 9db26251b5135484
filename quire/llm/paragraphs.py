"""Substring dedup of paragraphs by MinHash banding, exact Jaccard and components.

Paragraphs are lines, cut further where the hash of two neighbouring words is the least of
REACH places to either side in the line. Such cuts depend on the words around them only, so a
passage that was pasted into the middle of other text falls into the same paragraphs there,
about 2 * REACH + 1 words each. No cut leaves fewer than K words before the next line end.

Each paragraph of K words or more has one MinHash of its word shingles per band; one row per
band is tuned for recall (0.96 at Jaccard 0.8, 1 for equal paragraphs, with two bands).
Paragraphs that share a band are candidates and those whose shingle sets have a Jaccard of
SIMILAR or more are linked; equal ones are one node from the start. First every paragraph of
a band value is compared with one centre. Those of band values that still hold several
classes meet by their rarest shingles (see `rare`), as sets of Jaccard SIMILAR have SIMILAR of
the larger in common; so the ends of a passage that many documents share, each with other
words beside it, do not meet in pairs. No pair that shares a band and is alike is left out.
Classes are connected components, and all but the first occurrence (least doc_id, then
position) of a class may go.

A shared run is a stretch of neighbouring paragraphs that occur elsewhere too. Runs under
MIN_WORDS words, such as a single common line, stay; of longer ones the words that are not
a first occurrence go.

Defined results: null and empty texts, and null doc_ids, share nothing; lines of fewer than K
words are no paragraphs; rows alike in doc_id and text get the same result; a paragraph
repeated inside one document only is not shared; texts of any length are taken whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.omh import MOST, ODD, mixed, united, word_hashes
from quire.llm.rare import pairs_of, prefixes
from quire.llm.util import stage

K, REACH, BANDS, SIMILAR, MIN_WORDS = 5, 5, 2, 0.8, 20
#: Words that are cut at once; a longer text makes one step of its own.
STEP = 1 << 16
PLACE = ["doc_id", "t", "seg"]
FOUND = "doc_id long, t long, seg int, start int, n int, f long, keys array<long>"


def shingles(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shingle at each word, MOST where it would pass the end of its paragraph."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(K - 1, "u8")])
    made = mixed(sum((padded[i : i + n] * ODD[2 + i] for i in range(K)), np.zeros(n, "u8")))
    made[np.arange(n) + K > ends] = MOST
    return made


def cut(words: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Where paragraphs start: at lines and at local minima of the hash of two words. since, until: words of the line before and after each word."""
    n = len(words)
    pairs = np.where(until > 0, mixed(words * ODD[0] + np.append(words[1:], np.uint64(0)) * ODD[1]), MOST)
    least = np.full(n, MOST)
    for i in range(1, min(REACH, n - 1) + 1):
        least[i:] = np.minimum(least[i:], np.where(since[i:] >= i, pairs[:-i], MOST))
        least[:-i] = np.minimum(least[:-i], np.where(until[:-i] >= i, pairs[i:], MOST))
    return np.flatnonzero((since == 0) | (pairs < least) & (since >= K) & (until >= K - 1))


def paragraphs(lines: list[np.ndarray], of: list[int]) -> tuple[np.ndarray, ...]:
    """Of the lines (word hashes) of some texts, of[i] being the text of line i: text, number in the text, first word, words, whole hash and band keys of each paragraph of K words or more."""
    sizes = np.array([len(x) for x in lines])
    words, text = np.concatenate(lines), np.repeat(np.array(of), sizes)
    line = np.cumsum(sizes) - sizes
    since = np.arange(len(words)) - np.repeat(line, sizes)
    starts = cut(words, since, np.repeat(sizes, sizes) - 1 - since)
    sizes = np.diff(np.append(starts, len(words)))
    ends, own = np.repeat(starts + sizes, sizes), np.repeat(starts, sizes)
    whole = np.add.reduceat(mixed(words ^ mixed((np.arange(len(words)) - own + 1).astype("u8") * ODD[-2])), starts)
    grams = shingles(words, ends)
    keys = [mixed(np.minimum.reduceat(np.where(grams == MOST, MOST, mixed(grams * ODD[8 + b])), starts) + ODD[20 + b]) for b in range(BANDS)]
    of_start = text[starts]
    _, first = np.unique(text, return_index=True)
    _, first_start, many = np.unique(of_start, return_index=True, return_counts=True)
    seg = np.arange(len(starts)) - np.repeat(first_start, many)
    long = sizes >= K
    return tuple(x[long] for x in (of_start, seg, starts - np.repeat(first, many), sizes, whole, *keys))


def segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph: its document (doc_id and a hash of the text), place, size, hash and band keys."""

    def steps(values: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        lines, of, held = [], [], 0
        for row, value in enumerate(values):
            for line in (value.as_py() or "").split("\n"):
                hashed = word_hashes(line)
                if len(hashed):
                    lines.append(hashed)
                    of.append(row)
                    held += len(hashed)
            if held >= STEP:
                yield paragraphs(lines, of)
                lines, of, held = [], [], 0
        if held:
            yield paragraphs(lines, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, seg, start, size, whole, *keys in steps(batch[2]):
                take = pa.array(row)
                small = (pa.array(x.astype("i4")) for x in (seg, start, size))
                each = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(keys).view("i8").ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch[0].take(take), batch[1].take(take), *small, pa.array(whole.view("i8")), each], [*PLACE, "start", "n", "f", "keys"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), F.col(text))
    return rows.mapInArrow(run, FOUND)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(f, grams, keys) of the wanted paragraphs (doc_id, t, start, n, f, keys), one for each f."""
    asked = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "f", "keys")).alias("asked"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).join(asked, ["doc_id", "t"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, asked in zip(batch["text"], batch["asked"]):
                words = word_hashes(text)
                for x in asked:
                    part = words[x["start"] : x["start"] + x["n"]]
                    grams = shingles(part, np.full(len(part), len(part)))
                    found.append((x["f"], np.unique(grams[grams != MOST]).view("i8"), x["keys"]))
            yield pd.DataFrame(found, columns=["f", "grams", "keys"])

    return rows.select("text", "asked").mapInPandas(run, "f long, grams array<long>, keys array<long>").dropDuplicates(["f"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of paragraphs whose shingle sets have a Jaccard of SIMILAR or more."""
    left, right = (sets.select(F.col("f").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    common = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").where(common >= SIMILAR * (F.size("ga") + F.size("gb") - common) - 1e-9).select("a", "b")


def classes(near: DataFrame, segs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(id, label) of the hashes in near (key, f: band values of several hashes), alike ones connected."""
    centres = near.groupBy("key").agg(F.min("f").alias("c"))
    pairs = stage(near.join(centres, "key").where("f <> c").select(F.col("c").alias("a"), F.col("f").alias("b")).distinct(), "paragraph-pairs")
    hot = near.select("f").distinct()
    place = F.min(F.struct("doc_id", "t", "start", "n", "keys")).alias("x")
    sets = stage(shingle_sets(docs, segs.join(hot, "f").groupBy("f").agg(place).select("f", "x.*"), text), "paragraph-grams")
    labels = sets.select(F.col("f").alias("id"), F.col("f").alias("label"))
    labels = stage(united(labels, stage(alike(pairs, sets), "paragraph-links")), "paragraph-labels")
    named = near.join(labels.select(F.col("id").alias("f"), "label"), "f")
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = named.join(several, "key").select("f", "label").distinct()
    bags = stage(rest.join(sets, "f").select(F.col("f").alias("id"), "label", F.col("grams").alias("items"), "keys"), "paragraph-bags")
    rare = stage(prefixes(bags, SIMILAR), "paragraph-rare")
    met = pairs_of(rare, SIMILAR, lambda a, b: F.arrays_overlap(f"keys{a}", f"keys{b}"))
    more = stage(met.distinct().join(pairs, ["a", "b"], "left_anti"), "paragraph-pairs")
    return stage(united(labels, stage(alike(more, sets), "paragraph-links")), "paragraph-labels")


def shared_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph that occurs in another document too: its place, start and n, and the place of the first of its class."""
    segs = stage(segments(docs, text), "paragraphs")
    entries = segs.select("f", F.explode("keys").alias("key"))
    repeated = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    met = stage(entries.join(repeated, "key").groupBy("key", "f").agg(F.count(F.lit(1)).alias("m")), "paragraph-met")
    several = met.groupBy("key").agg(F.count(F.lit(1)).alias("hashes")).where("hashes > 1").select("key")
    near = stage(met.join(several, "key").select("key", "f"), "paragraph-near")
    labels = classes(near, segs, docs, text).withColumnRenamed("id", "f")
    known = met.select("f").distinct().join(labels, "f", "left").select("f", F.coalesce("label", "f").alias("label"))
    spots = stage(segs.join(known, "f").select(*PLACE, "start", "n", "label"), "paragraph-spots")
    texts = F.struct("doc_id", "t")
    first = spots.groupBy("label").agg(F.min(F.struct(*PLACE)).alias("first"), F.min(texts).alias("a"), F.max(texts).alias("z")).where("a <> z").drop("a", "z")
    return spots.join(first, "label").select(*PLACE, "start", "n", "first")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Per document with a shared run: doc_id, t, n_shared, n_removed (words), removed (spans of words) and first_docs."""
    shared = shared_paragraphs(docs, text)
    own = Window.partitionBy("doc_id", "t").orderBy("start")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("n")).over(own) < F.col("start"), F.lit(True)).cast("int")
    runs = shared.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(own))
    again = F.struct("doc_id", "t", "seg") != F.col("first")
    per_run = runs.groupBy("doc_id", "t", "run").agg(
        F.sum("n").alias("shared"), F.sum(F.when(again, F.col("n")).otherwise(0)).alias("removed"),
        F.collect_list(F.when(again, F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.collect_set(F.when(again, F.col("first.doc_id"))).alias("firsts")).where(F.col("shared") >= min_words)
    return per_run.groupBy("doc_id", "t").agg(
        F.sum("shared").alias("n_shared"), F.sum("removed").alias("n_removed"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs"))


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """docs with __kept: the text without the words that go; what stood between words that stay is kept."""
    gone = removals(docs, min_words, text).where("n_removed > 0").select(F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_t"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, (F.col("doc_id") == F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_t")), "left").drop("__gone_id", "__gone_t")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(t, s) for t, s in zip(texts, spans)])

    return joined.withColumn("__kept", kept(F.col(text), F.col("__removed"))).drop("__removed")


def without(text: str, spans) -> str:
    """The text without the words in the spans, each with the white space after it."""
    places = [m.span() for m in re.finditer(r"\S+\s*", text)]
    gone = np.zeros(len(places), bool)
    for s in spans:
        gone[s["start"] : s["end"]] = True
    head = text[: places[0][0]] if places else text
    return head + "".join([text[a:b] for (a, b), g in zip(places, gone) if not g])


def op6_paragraph_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shared, n_removed, removed and first_docs of every document."""
    found = removals(docs).select(F.col("doc_id").alias("id"), F.col("t").alias("u"), "n_shared", "n_removed", "removed", "first_docs")
    every = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"))
    joined = every.join(found, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("u")), "left")
    none = "array<struct<start:int,end:int>>"
    return joined.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_removed")),
                         F.coalesce("removed", F.array().cast(none)).alias("removed"), F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"))
