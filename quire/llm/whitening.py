"""PCA whitening of embeddings from exact integer statistics.

Components become integers, whose bit planes are packed across rows: a word holds one bit of
one dimension of 64 rows. The number of rows in which two bits are both set is the popcount
of the AND of their words, and a cross-product is the sum of such counts, each weighted by
the two bits' place values. Tasks count over their rows, weigh at the end and hand on one
d x d matrix of exact sums; these are added up as decimals, so the covariance is centred in
integers (n times the cross-products less the product of the sums) and rounded only once,
before the eigenvectors. Rows are shifted by each dimension's least value first, which takes
no plane more than the spread needs and drops out in the centring.

Rows never meet: statistics are a few passes of maps, and what the driver holds is d x d.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped,
as are those with an entry of 2 ** 50 or more, whose integer would not fit, and those of another
length than the most frequent one (the longest of equally frequent ones). Repeated rows count
each; a null id stays. With fewer dimensions than asked for there are as many components. A
component without variance (up to rounding: equal rows, a single row) has null whitened
values and takes no part in the identity error, which is null if none is left. An empty
table gives no rows. `deviation` is null where it does not fit into a long;
`deviation_exact` holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.util import stage

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
LEAST_ABOVE = float(1 << 50)
#: Rows whose planes are packed and counted at once.
ROWS = 1 << 13
#: Exact sums are handed on in two parts, so that decimals hold them whatever the entries.
HALF = 10**30
#: Variance below this part of the largest counts as none.
NONE = 1e-12


def integers(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """keep and x (array of long) of the rows whose vectors count."""
    c = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LEAST_ABOVE))  # false for NaN, which is above all
    sound = rows.where(F.coalesce(fit & (F.size(vector) > 0), F.lit(False)))
    return sound.select(*keep, F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype("i8")


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """A row of words for each bit of each dimension: bit r of the words is that of row r. y: rows x d, not negative."""
    short = -len(y) % 64
    if short:
        y = np.concatenate([y, np.zeros((short, y.shape[1]), y.dtype)])
    packed = [np.packbits((y[:, [i]] >> np.arange(b) & 1).astype(bool), axis=0).T for i, b in enumerate(bits)]
    return np.ascontiguousarray(np.concatenate(packed)).view("u8")


def count_pairs(words: np.ndarray, into: np.ndarray) -> None:
    """Add to into[p, q], p <= q, in how many rows the planes p and q are both set."""
    for p in range(len(words)):
        into[p, p:] += np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype="i8")


def weighed(counts: np.ndarray, bits: list[int], rows: int) -> np.ndarray:
    """The exact d x d sums of products (upper half), as Python integers."""
    ends = np.concatenate([[0], np.cumsum(bits)])
    kind = "i8" if 2 * max(bits) + rows.bit_length() < 62 else object
    both = np.triu(counts) + np.triu(counts, 1).T
    places = [np.array([1 << a for a in range(b)], dtype=kind) for b in bits]
    halves = np.stack([places[j] @ both[ends[j] : ends[j + 1]].astype(kind) for j in range(len(bits))])  # d x planes
    return np.stack([halves[:, ends[i] : ends[i + 1]] @ places[i] for i in range(len(bits))])


def scatter(vectors: DataFrame, low: list[int], high: list[int]) -> DataFrame:
    """(i, j, high, low): sums over all rows of (x_i - low_i) * (x_j - low_j), i <= j, as high * HALF + low; j = -1: of x_i - low_i alone."""
    d, bits = len(low), [max((b - a).bit_length(), 1) for a, b in zip(low, high)]
    least = np.array(low, "i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((sum(bits), sum(bits)), "i8"), 0
        for batch in batches:
            y = matrix(batch[0], d) - least
            seen += len(y)
            for at in range(0, len(y), ROWS):
                count_pairs(planes(y[at : at + ROWS], bits), counts)
        if seen:
            products, ends = weighed(counts, bits, seen), np.concatenate([[0], np.cumsum(bits)])
            sums = [sum(int(counts[p, p]) << p - int(ends[i]) for p in range(ends[i], ends[i + 1])) for i in range(d)]
            i, j = np.triu_indices(d)
            values = [*map(int, products[i, j]), *sums]
            halves = [pa.array(map(Decimal, half), pa.decimal128(38, 0)) for half in zip(*(divmod(v, HALF) for v in values))]
            yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), *range(d)], pa.int32()), pa.array([*j.tolist(), *[-1] * d], pa.int32()), *halves], ["i", "j", "high", "low"])

    return vectors.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


class Whitening:
    """What a fit finds: n, the sums S, eigenvalues and vectors of the covariance (columns, falling), and its trace."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int):
        d = len(sums)
        exact = np.empty((d, d), dtype=float)
        for (i, j), total in products.items():
            exact[i, j] = exact[j, i] = float(Fraction(n * total - sums[i] * sums[j], n * n))
        values, vectors = np.linalg.eigh(exact)
        order = np.argsort(-values, kind="stable")[:components]
        self.n, self.values, self.vectors, self.trace = n, np.maximum(values[order], 0.0), vectors[:, order], float(np.trace(exact))
        self.none = self.values <= NONE * max(float(values.max(initial=0.0)), 0.0)


def fitted(vectors: DataFrame, components: int) -> tuple[Whitening, list[int]] | None:
    """The fit over all rows (x) and the sums S of x."""
    d = vectors.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return None
    low, high, n = vectors.agg(F.array(*[F.min(F.get("x", F.lit(i))) for i in range(d)]), F.array(*[F.max(F.get("x", F.lit(i))) for i in range(d)]), F.count(F.lit(1))).first()
    found = {(r["i"], r["j"]): int(r["high"]) * HALF + int(r["low"]) for r in scatter(vectors, low, high).collect()}  # d * (d + 3) / 2 rows
    sums = [found[i, -1] for i in range(d)]
    return Whitening(n, sums, {k: v for k, v in found.items() if k[1] >= 0}, components), [s + n * a for s, a in zip(sums, low)]


def projected(vectors: DataFrame, fit: Whitening, sums: list[int], keep: list[str]) -> DataFrame:
    """keep, deviation_exact and whitened (array of double, null for components without variance) of each row."""
    n, d = fit.n, len(sums)
    whole, part = np.array([s // n for s in sums], "i8"), [s % n for s in sums]
    scale = np.divide(1.0, np.sqrt(fit.values), out=np.zeros_like(fit.values), where=~fit.none)
    turn, fraction, squares = fit.vectors * scale, np.array([p / n for p in part]), sum(p * p for p in part)
    names = [*keep, "deviation_exact", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch[len(keep)], d) - whole  # n * x - S = n * q - part
            wide = len(q) and (int(np.abs(q).max()) ** 2 * d >= 1 << 62 or int(np.abs(q).max()) * max(part) * d >= 1 << 62)
            own = q.astype(object) if wide else q
            square, mixed = (own * own).sum(axis=1), own @ np.array(part, dtype=object if wide else "i8")
            off = [str(n * n * int(a) - 2 * n * int(b) + squares) for a, b in zip(square, mixed)]
            turned = (q.astype(float) - fraction) @ turn
            values = pa.array(turned.ravel(), mask=np.tile(fit.none, len(q)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(fit.values), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(off, pa.string()), lists], names)

    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select(*keep, "x").mapInArrow(run, f"{kinds}, deviation_exact string, whitened array<double>")


def identity_error(rows: DataFrame, used: list[int]) -> float | None:
    """The largest absolute entry of the covariance of whitened, centred before multiplying, less the identity."""
    if not used:
        return None
    value = {i: F.get("whitened", F.lit(i)) for i in used}
    means = rows.agg(*[F.avg(value[i]).alias(str(i)) for i in used]).first()
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = rows.agg(*[F.avg((value[i] - means[str(i)]) * (value[j] - means[str(j)])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """key, n, deviation_exact, whitened, explained (arrays by component) and identity_error of every row whose vector counts."""
    kind = rows.schema[key].dataType.simpleString()
    shaped = f"`{key}` {kind}, n long, deviation_exact string, whitened array<double>, explained array<double>, identity_error double"
    sound = integers(rows, vector, [key])
    lengths = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], shaped)
    vectors = stage(sound.where(F.size("x") == lengths["d"]), "whitening-integers")
    fit, sums = fitted(vectors, components)
    done = stage(projected(vectors, fit, sums, [key]), "whitening-rows")
    error = identity_error(done, np.flatnonzero(~fit.none).tolist())
    explained = [float(v / fit.trace) if fit.trace > 0 else 0.0 for v in fit.values]
    return done.select(key, F.lit(fit.n).cast("long").alias("n"), "deviation_exact", "whitened", F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(rows: DataFrame) -> DataFrame:
    made = whiten(rows)
    each = made.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", fits_long("deviation_exact").alias("deviation"), F.col("value").alias("whitened"),
                       F.get("explained", F.col("at")).alias("explained"), "identity_error", "deviation_exact")


def fits_long(name: str) -> Column:
    return F.col(name).try_cast("long")
