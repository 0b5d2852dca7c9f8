"""Products of whole blocks against those of scalars."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import panels
from tesserae.operators import products as pr
from tesserae.sources import generate


def rows(df):
    return {tuple(r[:4]): complex(*r[4:]) if len(r) > 5 else r[4] for r in df.collect()}


def close(a, b):
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.fixture(scope="module", params=[False, True], ids=["real", "complex"])
def matrix(spark, request):
    _, e = generate.random_blocks(spark, 60, 1, 5, 0.15, 3, request.param)
    order = ["bi", "bj", "r", "c", "v", "w"][: 5 + request.param]
    return e.select(order).cache()


@pytest.mark.parametrize("chunk", [panels.CHUNK, 20])
@pytest.mark.parametrize("eps", [0.0, 9.0])
def test_products(spark, monkeypatch, matrix, chunk, eps):
    monkeypatch.setattr(panels, "CHUNK", chunk)
    b = panels.to_blocks(matrix)
    close(rows(panels.to_entries(b).select(matrix.columns)), rows(matrix))
    for upper in (False, True):
        got = panels.to_entries(panels.multiply(b, b, eps, upper, 16)).select(matrix.columns)
        close(rows(got), rows(pr.spgemm(matrix, matrix, eps, upper=upper).select(matrix.columns)))


def test_vectors(spark, matrix):
    b, cx = panels.to_blocks(matrix), "w" in matrix.columns
    x = matrix.select(F.col("bi").alias("b"), "r").distinct().withColumn("v", generate.normal("b", "r"))
    x = x.withColumn("w", generate.normal("b", "r", seed=9)) if cx else x
    many = x.withColumn("col", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("v", F.col("v") * (F.col("col") + 1))
    for y in (x, many):
        for adjoint in (False, True):
            got, want = panels.apply(b, y, adjoint), pr.spmv(matrix, y, adjoint)
            key = lambda d: {tuple(r[c] for c in ("b", "r", "col") if c in d.columns): np.array([r[c] for c in ("v", "w") if c in d.columns]) for r in d.collect()}
            p, q = key(got), key(want)
            assert set(p) == set(q) and all(np.allclose(p[k], q[k]) for k in p)
    with pytest.raises(TypeError):
        panels.apply(b, x.drop("w") if cx else x.withColumn("w", F.lit(0.0)))
    assert panels.apply(b.limit(0), x).count() == 0 and panels.multiply(b.limit(0), b).count() == 0
