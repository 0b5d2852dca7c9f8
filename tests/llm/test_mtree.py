"""The best rows against all products."""

import numpy as np
import pytest

from tesserae.llm import mtree


@pytest.mark.parametrize("tree_rows", [4096, 100])
def test_against_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(mtree, "TREE_ROWS", tree_rows)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 8)), 2)
    x[300:400] = x[300]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (None, [1.0] * 8), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    q = np.floor(1024 * x).astype(np.int64)
    want = set()
    for i in range(0, 900, 100):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(900) if j != i)[:10]
        want |= {(i, r + 1, j, -v) for r, (v, j) in enumerate(best)}
    assert {tuple(r) for r in mtree.top_k(spark, df).collect()} == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(spark, df).collect()] == [(0, 1, 7, 1024 * 2048)]
    assert mtree.top_k(spark, df.limit(0)).count() == 0 and mtree.top_k(spark, df.where("vec_id = 7")).count() == 0


def test_bounds_save_products():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * np.concatenate([rng.normal(c, 0.05, (500, 4)) for c in rng.normal(0, 3, (8, 4))])).astype(np.int64)
    big = float((x.astype(float) ** 2).sum(1).max())
    s = mtree.Search(np.array([0]), x[:1], np.array([-np.inf]), big, 10)
    s.tree(mtree.build(np.arange(len(x)), x, big))
    ids = s.best()[1]
    score = x @ x[0]
    assert ids.tolist() == sorted(range(1, len(x)), key=lambda j: (-score[j], j))[:10] and s.computed < len(x) / 2


def test_blocks_of_queries(spark, monkeypatch):
    """Several blocks give what one gives; huge components take no part."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 4)))] + [(500, [1e300] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = {tuple(r) for r in mtree.top_k(spark, df, every=10).collect()}
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 15)
    assert {tuple(r) for r in mtree.top_k(spark, df, every=10).collect()} == one and len(one) == 400
