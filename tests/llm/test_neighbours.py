"""The forest against brute force."""

import heapq
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from quaestor.llm import neighbours
from quaestor.llm.queries import op7_neighbours

FOLDER = str(TESTDATA / "sf0.1")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:k]
    return [int(ids[i]) for i in order], scores[order]


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype("f8")
    found = {q: g.sort_values("rank") for q, g in op7_neighbours(spark, FOLDER).toPandas().groupby("query_id")}
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[queries])
    hits = []
    for q in queries:
        expected, _ = brute(ids, vectors, q, 20)
        own = found[ids[q]]
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own["score"]) <= 0).all()
        assert np.allclose(own["score"], vectors[np.searchsorted(ids, own["vec_id"])] @ vectors[q])
        hits.append(len(set(expected) & set(own["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9


def test_equal_vectors_ties_and_lengths(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(40, 5)).round(2)
    rows = [(i, base[0].tolist() if i % 3 == 0 else base[i % 40].tolist(), 0) for i in range(300)]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=7).collect()
    ids, vectors = np.arange(300), np.array([np.float32(r[1]) for r in rows], "f8")
    for q in range(0, 300, 50):
        own = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert own == brute(ids, vectors, q, 7)[0]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0), (0, [1.0, 0.0], 9), (20, [0.0, 2.0], 0), (3, [0.5, 0.5], 0), (4, None, 0), (40, [0.0, 0.0], 0),
        (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (None, [1.0, 1.0], 0), (9, [1.0, 1.0, 1.0], 0), (11, [], 0),
    ]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (0, 1, 3, 0.5), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0),
    ]


@pytest.mark.parametrize("rows", [[], [(0, None, 0)], [(0, [1.0], 0)]])
def test_nothing_to_find(spark, rows):
    assert neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_several_blocks_of_queries_find_the_same(spark, monkeypatch):
    rows = spark.read.parquet(str(TESTDATA / "sf0.001" / "embeddings.parquet"))
    one = {tuple(r) for r in neighbours.search(rows, F.col("vec_id") % 2 == 0).collect()}
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    assert {tuple(r) for r in neighbours.search(rows, F.col("vec_id") % 2 == 0).collect()} == one


def forest(rows, leaf, trees=3):
    grown = neighbours.Forest([], rows, float((rows.astype("f8") ** 2).sum(1).max()))
    lifted = grown.lifted(rows)
    grown.trees = [neighbours.grow(lifted, leaf, 4 * leaf, np.random.default_rng(i)) for i in range(trees)]
    return grown


def shared_queue(grown, query, wanted):
    """(tree, leaf) pairs by rising distance, until they hold `wanted` rows of the sample."""
    queue = [(0.0, i, 0 if len(t.children) else ~0) for i, t in enumerate(grown.trees)]
    seen, found, last = set(), set(), 0.0
    while queue and (len(seen) < wanted or queue[0][0] == last):
        last, i, node = heapq.heappop(queue)
        tree, far = grown.trees[i], last
        while node >= 0:
            m = float(tree.planes[node] @ query - tree.limits[node])
            near, other = (1, 0) if m > 0 else (0, 1)
            heapq.heappush(queue, (far + m * m, i, int(tree.children[node, other])))
            node = int(tree.children[node, near])
        found.add((i, ~node))
        seen |= set(np.flatnonzero(tree.leaf_of == ~node).tolist())
    return found, seen


@pytest.mark.parametrize(("leaf", "share", "least"), [(4, 0.5, 0), (4, 0.01, 0), (16, 0.0, 37.5), (4, 2.0, 0), (900, 0.5, 0)])
def test_leaves_are_those_of_a_shared_queue(leaf, share, least):
    draw = np.random.default_rng(4)
    grown = forest(draw.normal(size=(600, 8)).astype("f4"), leaf)
    queries = np.column_stack([draw.normal(size=(20, 8)), np.zeros(20)]).astype("f4")
    visited, seen = grown.visits(queries, share, least)
    for q, query in enumerate(queries):
        leaves, rows = shared_queue(grown, query, min(600, max(share * 600, least)))
        assert {(i, leaf) for i, own in enumerate(visited) for leaf in np.flatnonzero(own[:, q])} == leaves
        assert set(np.flatnonzero(seen[:, q])) == rows


def test_steps_of_routing_do_not_grow_with_leaves_or_queries():
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(4_000, 16)).astype("f4")
    queries = np.column_stack([draw.normal(size=(64, 16)), np.zeros(64)]).astype("f4")

    def steps(leaf, n):
        grown, count = forest(rows, leaf), 0

        def step(frame, event, arg):
            nonlocal count
            count += event in ("call", "c_call")

        sys.setprofile(step)
        try:
            grown.visits(queries[:n], 0.5, 0)
        finally:
            sys.setprofile(None)
        return count

    assert steps(64, 64) == steps(64, 8)
    assert steps(4, 64) < 3 * steps(64, 64)  # 16 times the leaves, 4 more levels


def test_queries_are_routed_in_several_tasks(spark, monkeypatch):
    rows = spark.read.parquet(str(TESTDATA / "sf0.001" / "embeddings.parquet"))
    one = {tuple(r) for r in neighbours.search(rows, F.col("vec_id") % 2 == 0).collect()}
    monkeypatch.setattr(neighbours, "ROUTE_ROWS", 50, raising=False)
    monkeypatch.setattr(neighbours, "BATCH_ROWS", 9, raising=False)
    monkeypatch.setattr(neighbours, "PAIRS", 100, raising=False)
    found = neighbours.search(rows, F.col("vec_id") % 2 == 0)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == one


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e5, 1e12])
def test_nearest_of_vectors_of_any_length(spark, scale):
    draw = np.random.default_rng(6)
    vectors = (draw.normal(size=(400, 64)) * scale).astype("f4")
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    found = {}
    for r in sorted(neighbours.search(rows, F.col("vec_id") % 2 == 0).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.arange(400)
    assert found == {q: brute(ids, vectors.astype("f8"), q, 20)[0] for q in range(0, 400, 2)}
