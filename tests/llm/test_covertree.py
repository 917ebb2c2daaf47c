from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import covertree


def brute(rows: list[tuple[int, list[float]]], k: int) -> dict[int, list[tuple[int, float]]]:
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.rint(x @ x.T * 1e6).astype(int)
    return {int(i): [(int(ids[j]), keys[n, j] / 1e6) for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-keys[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


def got(df) -> dict:
    out: dict = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbor_id, r.score))
        assert r.rank == len(out[r.id])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("cell,leaf,block,pivots", [(2048, 64, 1 << 25, 4096), (40, 8, 6000, 4096), (10, 3, 1 << 25, 3)])
def test_against_brute_force(spark, monkeypatch, cell, leaf, block, pivots):
    """Also with trees of few points, several blocks of queries, and cells that are cut into parts."""
    for name, value in (("CELL", cell), ("LEAF", leaf), ("BLOCK_BYTES", block), ("PIVOTS", pivots)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 6))
    rows = [(int(i) * 3, (centers[i % 12] + 0.05 * rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(10_000 + i, rows[i][1]) for i in range(40)] + [(20_000 + i, rows[0][1]) for i in range(25)]  # copies: ties by the lowest id
    want = brute(rows, 7)
    mine = got(covertree.top_k(table(spark, rows), 7, id_col="id", vector_col="v"))
    assert mine.keys() == want.keys()
    for i in want:
        assert [s for _, s in mine[i]] == pytest.approx([s for _, s in want[i]], abs=2e-6)
    same = sum(mine[i] == want[i] for i in want)
    assert same >= 0.99 * len(want)  # the last digit may round either way
    some = got(covertree.top_k(table(spark, rows), 7, queries=F.col("id") % 6 == 0, id_col="id", vector_col="v"))
    assert some == {i: n for i, n in mine.items() if i % 6 == 0}


def test_bad_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (10, [float("inf"), 1.0])]
    out = got(covertree.top_k(table(spark, rows), 3, id_col="id", vector_col="v"))
    assert {i: [j for j, _ in n] for i, n in out.items()} == {1: [2, 9], 2: [1, 9], 9: [2, 1]}
    assert covertree.top_k(table(spark, []), 3, id_col="id", vector_col="v").count() == 0
    assert covertree.top_k(table(spark, rows[:1]), 3, id_col="id", vector_col="v").count() == 0
    assert covertree.top_k(table(spark, rows), 3, queries=F.col("id") > 99, id_col="id", vector_col="v").count() == 0
    clash = table(spark, rows).withColumnRenamed("id", "Rank").selectExpr("*", "1 AS cell", "2 AS key", "3 AS neighbor_id")
    assert covertree.top_k(clash, 3, id_col="Rank", vector_col="v").columns == ["Rank", "neighbor_id", "score", "rank_"]


def test_pruning_compares_fewer_pairs():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 4)), 100, axis=0) + 0.01 * rng.normal(size=(3000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, root = covertree.build(x)
    best = covertree.Best(3000, 5)
    ids = np.arange(3000)
    assert covertree.search(x[order], ids[order], root, x[order], ids[order], root, best) < 3000 * 3000 / 4
    again = covertree.Tree.load(*covertree.Tree.dump(root), 4)
    walk = lambda n: [(n.start, n.end, n.radius, tuple(n.center)), *(w for c in n.children for w in walk(c))]
    assert walk(again) == walk(root)


def test_pruning_with_bounds_leaves_out_whole_trees():
    """Trees of other clusters are pruned at their roots once a query's own has been searched."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8))
    best, compared = None, 0
    trees = []
    for c in centers:
        x = c + 0.01 * rng.normal(size=(200, 8))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        order, root = covertree.build(x)
        trees.append((x[order], root))
    q, qroot = trees[0]
    best = covertree.Best(200, 5)
    for i, (x, root) in enumerate(trees):
        n = covertree.search(q, np.arange(200), qroot, x, 1000 * i + np.arange(200), root, best)
        assert (n > 0) == (i == 0)
