"""Candidate pairs of bags that can share a given part of the larger, by their rarest items.

Two bags that have at least `least` of the larger's items in common must share one of the
items that come first when both are ordered alike, as soon as those weigh more than
(1 - least) of each bag. With the rarest items first, what many bags hold (a passage, a
common word) comes last, so bags that share only that never meet. The order is only a matter
of speed: counts come from all bags given, and the FREQUENT most frequent items are sent to
the tasks (a bounded table); all others count as equally rare and are ordered by value.

At every shared item the weight of what both still have after it bounds their overlap; at
the first item that they share this bound holds, so a pair that passes nowhere is out for
certain. Where asked for, each row also tells which of the commonest occurrences (an item for
the first, second, ... time in a bag) its bag has from there on: at the first shared item,
those that one side lacks and all that stands before it are lost to the overlap. Nothing is
capped and no pair that can share so much is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items whose counts are sent to every task: 12 bytes each.
FREQUENT = 20_000
#: Items that are ordered at once.
STEP = 1 << 19
#: The items that most prefixes hold have a bit each, so that a pair sharing several of them comes once.
USUAL, BITS = 62, ["bits0", "bits1", "bits2", "bits3"]
#: The commonest occurrences, up to the MOST-th of an item in a bag, have a bit each as well.
MOST, AFTER = 8, [f"after{i}" for i in range(6)]
COLUMNS = ["item", "id", "label", "n", "before", "weight", *BITS]
PREFIXES = ", ".join(f"{c} long" for c in COLUMNS)


def counted(bags: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In steps of about STEP items: the first bag, sizes of bags, then bag (from the first), item and weight of each different item, by bag and item."""
    held, first, size = [], 0, 0
    for row, bag in enumerate(bags):
        held.append((bag.values.to_numpy() if pa.types.is_list(bag.type) else np.frombuffer(bag.as_py(), kind)).astype("i8"))
        size += len(held[-1])
        if size >= STEP or row == len(bags) - 1:
            sizes = np.array([len(x) for x in held])
            items, of = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            order = np.lexsort((items, of))
            items, of = items[order], of[order]
            at = np.flatnonzero(np.append(True, (items[1:] != items[:-1]) | (of[1:] != of[:-1]))[: len(items)])
            yield first, sizes, of[at], items[at], np.diff(np.append(at, len(items)))
            held, first, size = [], row + 1, 0


def frequent(bags: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent items of all bags, ascending, and in how many bags they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, items, _ in counted(batch[0], kind):
                found, times = np.unique(items, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype("i8"))], ["item", "m"])

    every = bags.select("items").mapInArrow(run, "item long, m long").groupBy("item").agg(F.sum("m").alias("m")).where("m > 1")
    top = every.orderBy(F.desc("m"), "item").limit(FREQUENT).toPandas().sort_values("item")
    return top["item"].to_numpy("i8"), top["m"].to_numpy("i8")


def occurrences(bags: DataFrame, kind: str, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items, ascending, of the commonest occurrences of the top items, and by item and weight (up to MOST) the bits of those it makes up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, items, weight in counted(batch[0], kind):
                met = np.isin(items, top)
                found, times = np.unique(np.searchsorted(top, items[met]) * (MOST + 1) + np.minimum(weight[met], MOST), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype("i8"))], ["place", "m"])

    made = np.zeros((len(top), MOST + 1), "i8")
    for r in bags.select("items").mapInArrow(run, "place long, m long").groupBy("place").agg(F.sum("m").alias("m")).collect():  # of top items only
        made.flat[r["place"]] = r["m"]
    at_least = made[:, ::-1].cumsum(1)[:, ::-1]  # bags with so many of the item or more
    rows, times = np.unravel_index(np.argsort(-at_least[:, 1:], axis=None, kind="stable")[: USUAL * len(AFTER)], (len(top), MOST))
    bits = np.zeros((len(top), MOST + 1, len(AFTER)), "i8")
    for i, (row, k) in enumerate(zip(rows, times)):
        bits[row, k + 1 :, i // USUAL] |= 1 << i % USUAL
    return top, bits


def prefixes(bags: DataFrame, least: float, kind: str = "<i8", after: bool = False) -> DataFrame:
    """The rarest items of each bag (id, label, items as an array of long or packed numbers of this kind), with the weight of those before them and the bits of the usual ones among these, if asked also of the commonest occurrences from there on; other columns of bags go along."""
    known = frequent(bags, kind)
    once = _prefixes(bags.select("id", "label", "items"), least, kind, known, np.empty(0, "i8"))
    usual = once.groupBy("item").count().where("count > 1").orderBy(F.desc("count"), "item").limit(USUAL * len(BITS)).toPandas()["item"]
    common = None
    if after:
        top = np.argsort(-known[1], kind="stable")[: USUAL * len(AFTER)]
        common = occurrences(bags, kind, np.sort(known[0][top]))
    return _prefixes(bags, least, kind, known, np.sort(usual.to_numpy("i8")), common)


def _prefixes(bags: DataFrame, least: float, kind: str, frequent: tuple[np.ndarray, np.ndarray], usual: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    known, counts = frequent
    more = [c for c in bags.columns if c not in ("id", "label", "items")]
    slim = bags.select("items", "id", "label", *more)

    def rarest(sizes: np.ndarray, of: np.ndarray, items: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.minimum(np.searchsorted(known, items), max(len(known) - 1, 0))
        often = np.where(known[at] == items, counts[at], 1) if len(known) else np.ones(len(items), "i8")
        order = np.lexsort((items, often, of))
        items, weight = items[order], weight[order]
        begins = np.searchsorted(of, np.arange(len(sizes)))
        bit = np.searchsorted(usual, items)
        own = np.zeros((len(items), len(BITS)), "i8")
        found = np.flatnonzero(np.isin(items, usual))
        own[found, bit[found] // USUAL] = np.left_shift(1, bit[found] % USUAL)
        # Sums of what stands earlier in the bag; of the bits each comes once, so their sum holds them all.
        sums = np.cumsum(np.column_stack([weight, own]), axis=0) - np.column_stack([weight, own])
        sums -= sums[begins[of]]
        kept = sums[:, 0] <= np.floor(sizes[of] * (1 - least) + 1e-9)
        return tuple(x[kept] for x in (of, items, sizes[of], sums[:, 0], weight, *sums[:, 1:].T, *onward(of, items, weight)))

    def onward(of: np.ndarray, items: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
        """For each item of the ordered bags, the bits of the occurrences from it to the end of its bag."""
        if common is None:
            return
        met = np.flatnonzero(np.isin(items, common[0]))
        row, times, last = np.searchsorted(common[0], items[met]), np.minimum(weight[met], MOST), np.searchsorted(of, of, "right") - 1
        for j in range(len(AFTER)):
            own = np.zeros(len(items), "i8")
            own[met] = common[1][row, times, j]
            sums = np.cumsum(own)  # each bit comes once in a bag, so the difference of two sums holds them all
            yield sums[last] - sums + own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, of, items, weight in counted(batch[0], kind):
                if not len(items):
                    continue
                of, items, *others = rarest(sizes, of, items, weight)
                take = pa.array(of + first)
                numbers = [pa.array(x.astype("i8")) for x in (items, *others)]
                yield pa.RecordBatch.from_arrays([numbers[0], *(batch[i].take(take) for i in (1, 2)), *numbers[1:], *(batch[3 + i].take(take) for i in range(len(more)))], [*COLUMNS, *bits, *more])

    bits = AFTER if common is not None else []
    schema = ", ".join([PREFIXES, *(f"{c} long" for c in bits), *(f"{c} {bags.schema[c].dataType.simpleString()}" for c in more)])
    return slim.mapInArrow(run, schema)


def pairs_of(rare: DataFrame, least: float, met: Callable[[str, str], Column]) -> DataFrame:
    """(a, b), a < b, of the bags of different labels that can share `least` of the larger and for which `met` holds: a row for each rare item they have in common, but only for the first of usual ones.

    `met` gets the suffixes of the two sides' columns and must be false only for bags that are no candidates.
    """
    left, right = (rare.select("item", *(F.col(c).alias(f"{c}_{s}") for c in rare.columns if c != "item")) for s in "ab")
    larger = F.greatest("n_a", "n_b")
    need = larger - F.floor(larger * (1 - least) + 1e-9)
    rest = F.least(F.col("n_a") - F.col("before_a") - F.col("weight_a"), F.col("n_b") - F.col("before_b") - F.col("weight_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.least("n_a", "n_b") >= need) & (F.least("weight_a", "weight_b") + rest >= need)
    again = reduce(or_, [F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b")) != 0 for c in BITS])
    if AFTER[0] in rare.columns:
        for x, y in ("ab", "ba"):
            lacking = reduce(add, [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in AFTER])
            fits = fits & (F.col(f"before_{x}") + lacking <= F.col(f"n_{x}") - need)
    both = (left["item"] == right["item"]) & (F.col("id_a") < F.col("id_b")) & fits & ~again & met("_a", "_b")
    return left.join(right, both).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
