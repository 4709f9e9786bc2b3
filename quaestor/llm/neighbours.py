"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Every vector gets one more component that makes all equally long,
queries a zero, so the nearest by angle is the one with the largest product. Trees are fitted on a
bounded sample: a node's hyperplane lies between two means that grow from two random vectors, its
threshold at the median. Every vector is then filed in one leaf of each tree. A query takes the
leaves of all trees in one order, by the squared distances to the planes it crosses, until they
hold SHARE of the sample, LEAST rows at least; the leaves' candidates are ranked exactly. That is
the order of a priority queue shared by the trees, found for a batch of queries by sums per level.

Of equal vectors only the K + 1 smallest ids can be among anyone's K nearest, as ties go to the
smaller id, so the rest is left out at no loss, and equal vectors don't fill a leaf. Leaves meet
their queries in cells of about CELL_ROWS vectors and QUERY_ROWS queries, where a leaf is compared
with the queries that visit it only. A candidate goes on only if it is not below the K + 1 nearest
sampled ones in the query's leaves: those are found anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quaestor.llm.common import map_arrow, ship_package, written

K = 20
TREES = 12
SAMPLE_ROWS = 20_000
LEAF_ROWS = 32
CELL_ROWS = 4_096
QUERY_ROWS = 10_000
ROUTE_ROWS = 500  # queries of a routing task
BATCH_ROWS = 64  # queries routed at once
PAIRS = 1 << 18  # compared at once
SHARE = 0.5
LEAST = 2_000


@dataclass
class Tree:
    """Inner nodes have a plane and two children; leaves have their number as ~child."""

    planes: np.ndarray
    limits: np.ndarray
    children: np.ndarray
    cells: np.ndarray  # of each leaf
    leaf_of: np.ndarray  # of each row of the sample

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row, a level at a time."""
        at = np.zeros(len(rows), "i8")
        if not len(self.children):
            return at
        open_ = np.arange(len(rows))
        while len(open_):
            node = at[open_]
            right = np.einsum("ij,ij->i", rows[open_], self.planes[node]) > self.limits[node]
            at[open_] = self.children[node, right.astype("i8")]
            open_ = open_[at[open_] >= 0]
        return ~at

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """(leaf, query): squared distances to the planes crossed on the way, summed up."""
        n = len(self.children)
        far = np.zeros((n + len(self.cells), len(queries)))
        nodes = np.arange(min(n, 1))
        while len(nodes):
            margins = (self.planes[nodes] @ queries.T - self.limits[nodes, None]).astype("f8")
            below = self.children[nodes]
            left, right = np.where(below < 0, n + ~below, below).T
            far[left] = far[nodes] + np.maximum(margins, 0) ** 2
            far[right] = far[nodes] + np.minimum(margins, 0) ** 2
            nodes = below[below >= 0]
        return far[n:]


@dataclass
class Forest:
    trees: list[Tree]
    sample: np.ndarray
    longest: float  # largest squared length of all vectors

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest - (rows.astype("f8") ** 2).sum(1), 0)
        return np.column_stack([rows, np.sqrt(rest)]).astype("f4")

    def visits(self, queries: np.ndarray, share: float, least: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Per tree (leaf, query), whether it is visited, and (row, query) whether the sample's row
        is in such a leaf; `least` is in such rows.

        By rising distance a row is reached with the nearest of its leaves, and the last leaf needed
        is that of the last row wanted.
        """
        far = [t.distances(queries) for t in self.trees]
        reached = far[0][self.trees[0].leaf_of]
        for tree, own in zip(self.trees[1:], far[1:], strict=True):
            np.minimum(reached, own[tree.leaf_of], out=reached)
        wanted = max(1, int(np.ceil(min(len(self.sample), max(share * len(self.sample), least)))))
        last = np.partition(np.ascontiguousarray(reached.T), wanted - 1, axis=1)[:, wanted - 1]
        return [own <= last for own in far], reached <= last


def grow(rows: np.ndarray, leaf: float, cell: float, draw: np.random.Generator) -> Tree:
    """A tree of the sample with leaves of at most `leaf` rows, and cells of at most `cell`."""
    planes, limits, children, cells = [], [], [], []
    leaf_of = np.empty(len(rows), "i4")
    n_cells = 0

    def split(own: np.ndarray, own_cell: int) -> int:
        nonlocal n_cells
        if own_cell < 0 and len(own) <= max(cell, leaf):
            own_cell, n_cells = n_cells, n_cells + 1
        if len(own) > leaf:
            a, b = rows[draw.choice(own, 2, replace=False)]
            some = rows[draw.choice(own, min(len(own), 200), replace=False)]
            for _ in range(6):
                side = some @ (a - b) > (a @ a - b @ b) / 2
                if side.all() or not side.any():
                    break
                a, b = some[side].mean(0), some[~side].mean(0)
            plane = a - b
            length = np.linalg.norm(plane)
            if length > 0:
                plane = plane / length
                where = rows[own] @ plane
                limit = np.median(where)
                right = where > limit
                if right.any() and not right.all():
                    node = len(planes)
                    planes.append(plane)
                    limits.append(limit)
                    children.append([0, 0])
                    children[node] = [split(own[~right], own_cell), split(own[right], own_cell)]
                    return node
        if own_cell < 0:
            own_cell, n_cells = n_cells, n_cells + 1
        cells.append(own_cell)
        leaf_of[own] = len(cells) - 1
        return ~(len(cells) - 1)

    split(np.arange(len(rows)), -1)
    width = rows.shape[1]
    return Tree(
        np.array(planes, "f4").reshape(-1, width), np.array(limits, "f4"),
        np.array(children, "i8").reshape(-1, 2), np.array(cells, "i8"), leaf_of,
    )


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part, each id and vector once. Null ids and vectors, zero vectors
    and those with null or non-finite components don't; neither do other lengths than the most
    frequent, of equals the smallest."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = own.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return good.filter(F.size("v") == (sizes["size"] if sizes else 0))


def distinct_vectors(good: DataFrame, k: int) -> DataFrame:
    """c, v, ids: each vector once, with its k + 1 smallest ids; c is the smallest."""
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    own = good.select("vec_id", "v", *hashes)
    least = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ranked = own.withColumn("rank", F.dense_rank().over(least)).filter(F.col("rank") <= k + 1)
    return (
        ranked.groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
        .select(F.xxhash64("h1", "h2").alias("c"), "v", "ids")
    )


def fit(classes: DataFrame, trees: int = TREES, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest of a bounded sample, the vectors of smallest hash."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toPandas()["v"]
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("longest")).first()
    if not total["n"]:
        return Forest([], np.empty((0, 0), "f4"), 0.0)
    sample = np.stack(rows.to_list()).astype("f4")
    forest = Forest([], sample, float(total["longest"]))
    lifted, ratio = forest.lifted(sample), len(sample) / total["n"]
    for i in range(trees):
        leaf = max(LEAF_ROWS * ratio, 4)
        forest.trees.append(grow(lifted, leaf, CELL_ROWS * ratio, np.random.default_rng(i)))
    return forest


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f4").reshape(-1, width)


def search(
    vectors: DataFrame, is_query: Column, k: int = K, share: float = SHARE, forest: Forest | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, all if there are fewer.

    Ties go to the smaller id. Repeated rows count once; an id with several vectors is searched by
    each, and its best score counts. Rows that take no part find nothing and aren't found.
    """
    good = valid_vectors(vectors)
    classes = written(distinct_vectors(good, k))
    queries = written(
        good.filter(is_query).groupBy("vec_id", "v").count()
        .select(F.col("vec_id").alias("q"), "v", F.xxhash64("vec_id", "v").alias("key"))
    )
    spark = vectors.sparkSession
    forest = forest or fit(classes)
    if not forest.trees:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    context = spark.sparkContext
    shared = context.broadcast(forest)
    width = forest.sample.shape[1]
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    least = LEAST * len(forest.sample) / max(classes.count(), 1)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = stacked(batch.column("v"), width)
            lifted = own.lifted(rows)
            for i, tree in enumerate(own.trees):
                leaf = tree.leaves(lifted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), i, "i4")), pa.array(tree.cells[leaf].astype("i4")),
                     pa.array(leaf.astype("i4")), batch.column("c"), batch.column("v")],
                    names=["tree", "cell", "leaf", "c", "v"],
                )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        doubled = own.sample.astype("f8")
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                rows = stacked(part.column("v"), width)
                visited, seen = own.visits(np.column_stack([rows, np.zeros(len(rows), "f4")]), share, least)
                bound = np.full(len(rows), -np.inf)
                if len(doubled) > k:
                    points = rows.astype("f8")
                    products = np.where(seen.T, points @ doubled.T, -np.inf)
                    # less a little, for sums in another order
                    slack = 1e-9 * np.linalg.norm(points, axis=1) * np.sqrt(own.longest)
                    bound = np.partition(products, -k - 1, axis=1)[:, -k - 1] - slack
                for i, (tree, open_) in enumerate(zip(own.trees, visited, strict=True)):
                    query, leaf = np.nonzero(open_.T)
                    cell = tree.cells[leaf]
                    first = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(cell, prepend=-1))
                    query, ends = query[first], np.append(first, len(leaf))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), i, "i4")), pa.array(cell[first].astype("i4")),
                         pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(leaf.astype("i4"))),
                         part.column("q").take(pa.array(query)), part.column("v").take(pa.array(query)),
                         pa.array(bound[query])],
                        names=["tree", "cell", "leaves", "q", "v", "bound"],
                    )

    def rank_cell(rows: pa.Table, visits: pa.Table) -> pa.Table:
        """Candidates of each visiting query: those of its leaves that reach its bound."""
        out = {"q": [], "c": [], "score": []}
        if rows.num_rows and visits.num_rows:
            order = np.argsort(rows["leaf"].to_numpy(), kind="stable")
            leaves, firsts = np.unique(rows["leaf"].to_numpy()[order], return_index=True)
            names = rows["c"].to_numpy()[order]
            vectors = stacked(rows["v"].combine_chunks(), width)[order].astype("f8")
            bounds, keys = visits["bound"].to_numpy(), visits["q"].to_numpy()
            points = stacked(visits["v"].combine_chunks(), width).astype("f8")
            wanted = visits["leaves"].combine_chunks()
            visited = wanted.flatten().to_numpy()
            visitor = np.repeat(np.arange(len(keys)), wanted.value_lengths().to_numpy())
            visitor = visitor[np.argsort(visited, kind="stable")]
            starts, ends = (np.searchsorted(np.sort(visited), leaves, side) for side in ("left", "right"))
            for first, last, start, end in zip(firsts, [*firsts[1:], len(names)], starts, ends, strict=True):
                step = max(1, PAIRS // int(last - first))
                for at in range(start, end, step):
                    own = visitor[at : min(at + step, end)]
                    products = points[own] @ vectors[first:last].T
                    a, b = np.nonzero(products >= bounds[own, None])
                    a, b = own[a], first + b
                    out["q"].append(keys[a])
                    out["c"].append(names[b])
                    # summed pair by pair: a product of matrices may differ in the last bit by its shape
                    out["score"].append(np.einsum("ij,ij->i", points[a], vectors[b]))
        kinds = ("i8", "i8", "f8")
        return pa.table({n: np.concatenate([*v, np.empty(0, t)]).astype(t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    ship_package(context)
    filed = map_arrow(classes.select("c", "v"), file, "tree int, cell int, leaf int, c long, v array<float>")
    filed = filed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    routed = map_arrow(
        queries.select("q", "v").repartition(max(1, -(-n_queries // ROUTE_ROWS)), "q"), route,
        "tree int, cell int, leaves array<int>, q long, v array<float>, bound double",
    ).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    key = ["tree", "cell", "block"]
    near = filed.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(rank_cell, "q long, c long, score double")
    best = near.groupBy("q", "c").agg(F.max("score").alias("score"))
    ids = classes.select("c", "ids")
    named = (
        best.join(ids, "c").select("q", F.explode("ids").alias("vec_id"), "score").filter("q <> vec_id")
        .groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
