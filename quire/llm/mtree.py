"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances by one more coordinate: with M the greatest norm and x
extended by sqrt(M^2 - |x|^2), |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest is the one of
greatest inner product and the triangle inequality holds between all extended vectors.

Rows are dealt to the nearest of a bounded sample of pivots; a cell of over TREE_ROWS rows
is split by a hash of vec_id, so equal vectors on a third of all rows make many trees of
bounded size, not one large one. Each tree is a file of pages: a root page of routing
objects with covering radius and distance to the root, and leaf pages of rows with distance
to their routing object. A search first asks the tree of the query's own cell for a bound,
then only those trees, pages and rows that the stored distances cannot rule out. Nothing is
left out for speed: a bound is used only with slack for rounding, and scores are integers.

Defined results: vectors that are null or hold a null or non-finite component, and null
vec_ids, take no part; shorter vectors count as padded with zeros; rows that share the
query's vec_id are its own; equal scores go to the smaller vec_id, and equal (score, vec_id)
of repeated rows both stand; an empty table gives an empty table. Components are exact up
to 2^20.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.tokenbin import opened
from quire.llm.util import new_path, stage

#: Pivots are a sample of up to MAX_PIVOTS rows in the order of a hash (the fitted part; every row is indexed).
MAX_PIVOTS = 1024
#: Rows that a tree aims at, entries of a page, and trees at most (their roots, under 1 kB each for 64 components, are broadcast).
TREE_ROWS, PAGE, MAX_TREES = 4096, 64, 65_536
ROOT = "tree int, path string, centre array<double>, extra double, radius double, n long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, of rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Tree:
    """One tree in memory, as its file holds it."""

    fields = ("ids", "vectors", "starts", "routes", "radii", "to_root", "to_route")

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, greatest: float) -> tuple[Tree, np.ndarray, float, float]:
        """The tree, its centre with the extra coordinate, and its radius. Routing objects are spread evenly over the ids."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        whole = np.column_stack([vectors, np.sqrt(np.maximum(0, greatest - (vectors**2).sum(1)))])
        centre = whole.mean(0)
        chosen = np.unique(np.linspace(0, len(ids) - 1, -(-len(ids) // PAGE)).astype(int))
        gaps = (whole**2).sum(1)[:, None] + (whole[chosen] ** 2).sum(1)[None] - 2 * whole @ whole[chosen].T
        near = gaps.argmin(1)
        pages, routes = [], []
        for i in range(len(chosen)):
            members = np.flatnonzero(near == i)
            for at in range(0, len(members), 2 * PAGE):
                pages.append(members[at : at + 2 * PAGE])
                routes.append(chosen[i])
        tree = cls()
        flat = np.concatenate(pages)
        tree.ids, tree.vectors = ids[flat], vectors[flat]
        tree.starts = np.cumsum([0, *map(len, pages)])
        tree.routes = vectors[routes]
        tree.to_root = np.linalg.norm(whole[routes] - centre, axis=1)
        tree.to_route = np.concatenate([np.linalg.norm(whole[p] - whole[r], axis=1) for p, r in zip(pages, routes)])
        tree.radii = np.array([tree.to_route[a:b].max() for a, b in zip(tree.starts, tree.starts[1:])])
        return tree, centre[:-1], float(centre[-1]), float(np.linalg.norm(whole - centre, axis=1).max())

    def save(self, path: str) -> None:
        held = io.BytesIO()
        np.savez(held, **{f: getattr(self, f) for f in self.fields})
        system, name = opened(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name, compression=None) as out:
            out.write(held.getvalue())

    @classmethod
    def load(cls, path: str) -> Tree:
        system, name = opened(path)
        with system.open_input_file(name) as file:
            held = np.load(io.BytesIO(file.read()))
        tree = cls()
        for f in cls.fields:
            setattr(tree, f, held[f])
        return tree

    def search(self, own: int, q: np.ndarray, to_root: float, greatest: float, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id) that reach the floor."""
        base = float(q @ q) + greatest
        slack = 1e-6 * np.sqrt(base) + 1e-9
        most = lambda far: (base - np.maximum(0, far - slack) ** 2) / 2 + 0.5
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst in front
        open_ = np.flatnonzero(most(np.abs(to_root - self.to_root) - self.radii) >= floor)
        if not len(open_):
            return []
        to_route = np.sqrt(np.maximum(0, base - 2 * (self.routes[open_] @ q)))
        queue = list(zip((to_route - self.radii[open_]).tolist(), open_.tolist(), to_route.tolist()))
        heapq.heapify(queue)
        while queue:
            far, page, route = heapq.heappop(queue)
            if most(far) < floor:
                break
            a, b = self.starts[page], self.starts[page + 1]
            kept = np.flatnonzero(most(np.abs(route - self.to_route[a:b])) >= floor) + a
            scores = self.vectors[kept] @ q
            for i in np.flatnonzero(scores >= floor):
                item = int(scores[i]), -int(self.ids[kept[i]])
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in best]


def build(vectors: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, float, int]:
    """(rows with their tree, roots, greatest squared norm, width) over all rows of (vec_id, v)."""
    spark = vectors.sparkSession
    folder = folder or new_path(spark, "mtree")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, greatest, width = vectors.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    greatest, width = greatest or 0.0, width or 0
    many = max(1, min(MAX_PIVOTS, n // TREE_ROWS))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).collect() if n else []  # at most MAX_PIVOTS rows
    pivots = matrix(pd.Series([r["v"] for r in rows], dtype=object), width)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], width)
            gaps = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
            yield batch.assign(cell=gaps.argmin(1).astype("int32"))

    celled = stage(vectors.mapInPandas(deal, "vec_id long, v array<double>, cell int"), "mtree-cells")
    counts = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # at most MAX_PIVOTS rows
    rows_each = max(TREE_ROWS, -(-n // (MAX_TREES - MAX_PIVOTS)))
    first, splits, at = {}, {}, 0
    for cell in sorted(counts):
        first[cell], splits[cell] = at, -(-counts[cell] // rows_each)
        at += splits[cell]
    bounds = spark.createDataFrame([(c, first[c], splits[c]) for c in first], "cell int, first int, splits int")  # at most MAX_PIVOTS rows
    treed = celled.join(F.broadcast(bounds), "cell").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("splits"))).cast("int").alias("tree"))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree, centre, extra, radius = Tree.build(group["vec_id"].to_numpy(), matrix(group["v"], width), greatest)
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        tree.save(path)
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "path": [path], "centre": [centre], "extra": [extra], "radius": [radius], "n": [len(group)]})

    roots = stage(treed.groupBy("tree").applyInPandas(grow, ROOT), "mtree-roots")
    return treed, roots, greatest, width


def search(queries: DataFrame, treed: DataFrame, roots: DataFrame, greatest: float, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best over all trees. queries: rows of treed."""
    spark = queries.sparkSession
    held = sorted(roots.select("tree", "path", "centre", "extra", "radius").collect())  # at most MAX_TREES rows
    trees = np.array([r["tree"] for r in held], "int64")
    centres = np.array([r["centre"] for r in held]).reshape(len(held), width)
    shared = spark.sparkContext.broadcast((trees, [r["path"] for r in held], centres, (centres**2).sum(1) + np.array([r["extra"] for r in held]) ** 2, np.array([r["radius"] for r in held])))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def to_roots(q: np.ndarray) -> np.ndarray:
        """Distances between queries, whose extra coordinate is 0, and roots."""
        _, _, centres, squares, _ = shared.value
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + squares[None] - 2 * q @ centres.T))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = dict(zip(shared.value[0].tolist(), shared.value[1]))
        at, tree = None, None
        for batch in batches:
            found = []
            for number, query, v, far, floor in zip(batch["tree"], batch["query_id"], batch["v"], batch["far"], batch["floor"]):
                if number != at:
                    at, tree = number, Tree.load(paths[number])
                q = np.zeros(width)
                q[: len(v)] = v
                found += [(query, i, s) for s, i in tree.search(query, q, far, greatest, k, floor)]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def asked(pairs: DataFrame) -> DataFrame:
        """Pairs of trees and queries, dealt by tree and in pieces where a tree has many."""
        dealt = pairs.repartitionByRange(parts, "tree", "query_id").sortWithinPartitions("tree", "query_id")
        return dealt.mapInPandas(visit, "query_id long, vec_id long, score long")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = matrix(batch["v"], width)
            where = np.searchsorted(shared.value[0], batch["tree"].to_numpy())
            yield batch.assign(far=to_roots(q)[np.arange(len(q)), where], floor=-np.inf)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, _, _, _, radii = shared.value
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.iloc[i : i + 256]
                q = matrix(batch["v"], width)
                far, base = to_roots(q), (q**2).sum(1) + greatest
                nearest = np.maximum(0, far - radii[None] - 1e-6 * np.sqrt(base)[:, None] - 1e-9)
                reach = (base[:, None] - nearest**2) / 2 + 0.5 >= batch["floor"].to_numpy()[:, None]
                reach &= trees[None] != batch["tree"].to_numpy()[:, None]
                rows, cols = np.nonzero(reach)
                yield pd.DataFrame({"tree": trees[cols], "query_id": batch["query_id"].to_numpy()[rows], "v": batch["v"].to_numpy()[rows], "far": far[rows, cols], "floor": batch["floor"].to_numpy()[rows]})

    pair = "tree int, query_id long, v array<double>, far double, floor double"
    started = queries.select("tree", F.col("vec_id").alias("query_id"), "v")
    near = stage(asked(started.mapInPandas(own, pair)), "mtree-near")
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")
    bounded = started.distinct().join(floors, "query_id", "left").select("tree", "query_id", "v", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("floor"))
    return near.unionByName(asked(bounded.mapInPandas(others, pair)))


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`."""
    treed, roots, greatest, width = build(quantised(embeddings))
    found = search(treed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), treed, roots, greatest, width, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
