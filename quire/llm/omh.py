"""Near-duplicate documents by Order MinHash, checked by banded alignment.

A text is its lower-cased words. Its k-mers of K words are labelled with their occurrence
number; each of SKETCHES hash functions picks the PICK least labelled k-mers and keeps them
in text order, as one 64-bit number. Documents that share a number are candidates; what
decides is the edit similarity of the words, 1 - distance / longer length, at SIMILAR or
more, from an alignment within the band that this allows.

Equal texts are one node from the start. Every two texts that share a number are aligned,
unless links found before connect them already or they are unlike for certain. The first
rounds align every member of a bucket with a few centres of it (CENTRES), which settles
groups of copies at a few alignments per member. The members of buckets that still hold
several classes then meet by their rarest words (see `rare`): texts alike to SIMILAR have
SIMILAR of the longer one's words in common, so they share a rare word, and unlike texts that
only have a passage or common words in common do not. Nothing is capped and no pair that
shares a number and is alike is left out. Classes are the connected components of the links.

Defined results: texts without words (null, empty) are alike to nothing and are their own
class; texts of fewer than K words have one k-mer of all their words; a null doc_id has a
null class and takes no part; rows that share a doc_id are one document; an empty table
gives an empty table. Other columns pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.rare import pairs_of, prefixes
from quire.llm.util import Memo, per_worker, stage

#: Of pairs with a fifth of the words replaced at random places, 0.97 share a number, with less all or nearly all.
K, PICK, SKETCHES, SIMILAR = 3, 2, 32, 0.8
#: How many texts of a bucket meet all others of other classes, round by round, before the rest meets by rare words.
CENTRES = (1, 4)
#: Words whose hashes a worker remembers, and k-mers hashed at once.
MEMO_ITEMS, STEP = 100_000, 1 << 16
#: Words from which an alignment goes along diagonals, whose memory does not grow with the square.
LONG = 1 << 14
LANES = [f"lane{i}" for i in range(SKETCHES // 4)]
ODD = np.random.default_rng(11).integers(1, 1 << 63, 2 * SKETCHES + 16, dtype="u8") * np.uint64(2) + np.uint64(1)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)

def word_hashes(text: str | None) -> np.ndarray:
    memo = per_worker("words", lambda: Memo(xxhash.xxh64_intdigest, MEMO_ITEMS))
    words = (text or "").lower().split()
    return np.fromiter(map(memo.__getitem__, words), "u8", len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """The hashes of the k-mers in text order; fewer than k words are one k-mer."""
    k = min(k, len(words))
    n = len(words) - k + 1
    return mixed(sum((words[i : i + n] * ODD[2 * SKETCHES + i] for i in range(k)), np.zeros(n, "u8")))


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each k-mer mixed with the number of its earlier occurrences."""
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    fresh = np.concatenate([[True], run[1:] != run[:-1]])
    if fresh.all():
        return grams
    at = np.arange(len(run))
    earlier = np.empty(len(run), "u8")
    earlier[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(earlier > 0, mixed(grams + earlier * ODD[-1]), grams)


def sketch(words: np.ndarray) -> np.ndarray:
    """SKETCHES numbers of a text with at least one word."""
    grams = shingles(words)
    marks = labelled(grams)
    pick = min(PICK, len(marks))
    rows = np.arange(SKETCHES)
    values, places = np.empty((SKETCHES, 0), "u8"), np.empty((SKETCHES, 0), "i8")
    for at in range(0, len(marks), STEP):
        hashed = mixed(marks[None, at : at + STEP] * ODD[:SKETCHES, None] + ODD[SKETCHES : 2 * SKETCHES, None])
        for _ in range(min(pick, hashed.shape[1])):
            i = hashed.argmin(1)
            values, places = np.column_stack([values, hashed[rows, i]]), np.column_stack([places, i + at])
            hashed[rows, i] = MOST
    if values.shape[1] > pick:
        least = np.argsort(values, axis=1, kind="stable")[:, :pick]
        places = np.take_along_axis(places, least, 1)
    kept = grams[np.sort(places, axis=1)]
    out = mixed(ODD[:SKETCHES].copy())
    for j in range(pick):
        out = mixed(out * np.uint64(31) + kept[:, j])
    return out


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, h1, h2 (of the words), n (words) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch[1]:
                words = word_hashes(value.as_py())
                whole = xxhash.xxh3_128_digest(words.tobytes())
                rows.append((*np.frombuffer(whole, "<i8").tolist(), len(words), sketch(words).view("i8") if len(words) else []))
            h1, h2, n, found = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, h1 long, h2 long, n long, sketch array<long>")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two bags have in common."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    bags = [np.bincount(x, minlength=len(values)) for x in (at[: len(a)], at[len(a) :])]
    return int(np.minimum(*bags).sum())


def in_band(a: list[int], b: list[int], k: int) -> int | None:
    """The edit distance of two sequences whose lengths differ by k at most, if it is at most k, else None.

    The cells within k of the main diagonal are one integer of 2k + 1 bits per column, whose
    lowest bit is the row k above; the differences down a column are held as two such
    integers. Cells outside the band count as one more than their neighbours inside. Along
    the diagonal that ends in the last cell, values never fall, which ends hopeless columns.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << 2 * k + 1) - 1
    down = whole >> k + 1 << k + 1  # rows after the first lie one above the other; rows before it are alike
    up, last, distance = 0, len(a) - len(b) + k, max(len(a) - len(b), 0)
    for j, x in enumerate(b):
        at = places.get(x, 0)
        equal = (at >> j - k if j >= k else at << k - j) & whole
        plus, minus = down >> 1 | 1 << 2 * k, up >> 1
        diagonal = ((equal & plus) + plus ^ plus | equal | minus) & whole
        right, left = (minus | whole & ~(diagonal | plus)) << 1 | 1, (diagonal & plus) << 1
        down, up = (left | ~(diagonal | right)) & whole, diagonal & right & whole
        if not diagonal >> last & 1:
            distance += 1
            if distance > k:
                return None
    return distance


def along_diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """As distance_within, for very long sequences: all diagonals of the band at once, one edit after the other; runs of equal words are jumped over by prefix hashes."""
    n, m = len(a), len(b)
    longest = max(n, m) + 1
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, ODD[0])]))
    pre_a, pre_b = (np.concatenate([[np.uint64(0)], np.cumsum(mixed(x) * powers[: len(x)])]) for x in (a, b))
    steps = [1 << s for s in range(max(1, min(n, m).bit_length()) - 1, -1, -1)]
    end_a, end_b = np.append(a, MOST), np.append(b, np.uint64(0))

    def slide(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        go = np.flatnonzero((i < n) & (j < m) & (end_a[i] == end_b[j]))
        if len(go):
            x, y = i[go], j[go]
            for step in steps:
                u, v = np.minimum(x + step, n), np.minimum(y + step, m)
                same = (x + step <= n) & (y + step <= m) & ((pre_a[u] - pre_a[x]) * powers[y] == (pre_b[v] - pre_b[y]) * powers[x])
                x, y = x + step * same, y + step * same
            i = i.copy()
            i[go] = x
        return i

    far = slide(np.zeros(1, "i8"), np.zeros(1, "i8"))  # on diagonals -e..e, j = i + diagonal
    e = 0
    while True:
        if abs(m - n) <= e and far[m - n + e] >= n:
            return e
        e += 1
        if e > limit:
            return None
        low = np.full(2 * e + 1, -(1 << 40), "i8")
        wide = low.copy()
        wide[1:-1] = far + 1  # one word replaced
        wide[:-2] = np.maximum(wide[:-2], far + 1)  # one word of a left out
        wide[2:] = np.maximum(wide[2:], far)  # one word of b put in
        diagonal = np.arange(-e, e + 1)
        i = np.minimum(np.minimum(wide, n), m - diagonal)
        fits = (i >= 0) & (i + diagonal >= 0)
        far = np.where(fits, slide(np.where(fits, i, 0), np.where(fits, i + diagonal, 0)), low)


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two sequences if it is at most limit, else None.

    Equal ends are cut off first. The band starts a little wider than what the words that only
    one side has ask for, and grows fourfold until the distance fits or the limit is reached.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    tail = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return max(n, m)
    least = max(n, m) - shared(a, b)
    if least > limit:
        return None
    if max(n, m) > LONG:
        return along_diagonals(a, b, limit)
    one, other, k = a.tolist(), b.tolist(), max(16, abs(n - m), least + least // 4)
    while True:
        k = min(k, max(limit, 1))
        found = in_band(one, other, k)
        if found is not None or k >= limit:
            return found if found is None or found <= limit else None
        k *= 4


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and distance_within(a, b, int(longer * (1 - least) + 1e-9)) is not None


def words_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(id, words): the word hashes, as bytes, of the documents in wanted (column id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [word_hashes(t.as_py()).astype("<u4").tobytes() for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(packed, pa.binary())], ["id", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, "id long, words binary")


def aligned(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(*(np.frombuffer(x.as_py(), "<u4").astype("u8") for x in both)) for both in zip(batch[2], batch[3])]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left, right = (words.select(F.col("id").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) once the ends of the links (a, b) have one label."""
    left, right = (labels.select(F.col("id").alias(c), F.col("label").alias(x)) for c, x in ("au", "bv"))
    merged = components(links.join(left, "a").join(right, "b").select("u", "v")).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return labels.join(merged, "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def unsettled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries (key, id, n) of the keys whose members have several labels, with the label."""
    named = entries.join(labels, "id")
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return named.join(several, "key")


def lanes() -> list[Column]:
    """The low 15 bits of the numbers of a sketch, four to a column in 16 bits each."""
    low = [F.shiftleft(F.element_at("sketch", i + 1).bitwiseAND(0x7FFF), i % 4 * 16) for i in range(SKETCHES)]
    return [low[i].bitwiseOR(low[i + 1]).bitwiseOR(low[i + 2]).bitwiseOR(low[i + 3]).alias(name) for i, name in zip(range(0, SKETCHES, 4), LANES)]


def same_lane(a: str, b: str) -> Column:
    """Whether two sketches agree in the low 15 bits of a number, as all do that share one: some lane of the difference is zero and so borrows when one is taken from each."""
    found = F.lit(False)
    for name in LANES:
        differ = F.col(name + a).bitwiseXOR(F.col(name + b))
        found = found | ((differ - F.lit(0x0001000100010001)).bitwiseAND(F.lit(-0x7FFF7FFF7FFF8000)) != 0)
    return found


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the least doc_id of its class."""
    every = stage(sketches(docs, text), "omh-sketches")
    nodes = every.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes, "omh-nodes")
    entries = nodes.select("id", "n", F.explode("sketch").alias("key"))
    repeated = entries.groupBy("key").count().where("count > 1").select("key")
    open_ = stage(entries.join(repeated, "key"), "omh-open")
    labels = open_.select("id").distinct().withColumn("label", F.col("id"))
    words = stage(words_of(docs, labels.select("id"), text), "omh-words")
    tried = None
    for many in CENTRES:
        several = open_.withColumn("label", F.col("id")) if tried is None else stage(unsettled(open_, labels), "omh-several")
        first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        centres = several.withColumn("r", first).where(F.col("r") <= many).select("key", F.col("id").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl"))
        fit = F.least("n", "cn") >= SIMILAR * F.greatest("n", "cn") - 1e-9
        met = several.join(centres, "key").where(fit & (F.col("label") != F.col("cl")))
        pairs = met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "omh-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = stage(united(labels, stage(aligned(pairs, words), "omh-links")), "omh-labels")
    rest = unsettled(open_, labels).select("id", "label").distinct().join(words, "id").join(nodes.select("id", *lanes()), "id")
    bags = stage(rest.select("id", "label", F.col("words").alias("items"), *LANES), "omh-bags")
    rare = stage(prefixes(bags, SIMILAR, "<u4", after=True), "omh-rare")
    pairs = pairs_of(rare, SIMILAR, same_lane).distinct().join(tried, ["a", "b"], "left_anti")
    links = stage(aligned(stage(pairs, "omh-pairs"), words), "omh-links")
    labels = stage(united(labels, links), "omh-labels")
    named = nodes.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("label"))
    of = every.select("doc_id", "h1", "h2", "n").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return of.select("doc_id", F.when(F.col("doc_id").isNotNull(), own).alias("class_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those of which a near duplicate with a smaller doc_id stays."""
    gone = classes(docs, text).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op8_near_duplicates(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
