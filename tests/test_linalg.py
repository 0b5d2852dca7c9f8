"""Operators against NumPy, one test for each point where a naive reading goes wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import spectral
from tesserae.operators import atomic, elementwise as ew, products as pr
from tesserae.plans import iterate
from tesserae.sources import formats, generate

SIZES = [1, 3, 2]
OFF = np.concatenate([[0], np.cumsum(SIZES)])


def matrix(spark, dense, stored, cx=False):
    rows = []
    for bi, bj in stored:
        for r in range(SIZES[bi]):
            for c in range(SIZES[bj]):
                x = dense[OFF[bi] + r, OFF[bj] + c]
                rows.append((bi, bj, r, c, float(x.real), *([float(x.imag)] if cx else [])))
    return spark.createDataFrame(rows, "bi long, bj long, r int, c int, v double" + (", w double" if cx else ""))


def dense(df):
    n = OFF[-1]
    out = np.zeros((n, n), complex)
    for x in df.collect():
        out[OFF[x["bi"]] + x["r"], OFF[x["bj"]] + x["c"]] += x["v"] + (1j * x["w"] if "w" in df.columns else 0)
    return out


def masked(rng, stored, cx=False):
    n = OFF[-1]
    full = rng.normal(size=(n, n)) + (1j * rng.normal(size=(n, n)) if cx else 0)
    keep = np.zeros((n, n), bool)
    for i, j in stored:
        keep[OFF[i] : OFF[i + 1], OFF[j] : OFF[j + 1]] = True
    return np.where(keep, full, 0)


P = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)]
Q = [(0, 2), (1, 0), (1, 1), (2, 1), (2, 2)]


@pytest.mark.parametrize("cx", [False, True])
def test_products(spark, cx):
    rng = np.random.default_rng(1)
    a, b = masked(rng, P, cx), masked(rng, Q, cx)
    A, B = matrix(spark, a, P, cx), matrix(spark, b, Q, cx)
    assert np.allclose(dense(pr.spgemm(A, B)), a @ b)
    assert np.allclose(dense(pr.spgemm(A, B, trans_a=True)), a.conj().T @ b)  # conjugate, not plain
    assert np.allclose(dense(pr.spgemm(A, B, trans_b=True)), a @ b.conj().T)
    assert np.allclose(dense(ew.transpose(A)), a.conj().T)
    assert np.allclose(dense(pr.axpby(2.0, A, -0.5, B)), 2 * a - 0.5 * b)
    assert np.allclose(dense(ew.conjugate(A)), a.conj())
    assert np.allclose(dense(ew.imag(A)), a.imag) and ew.imag(A).count() == A.count()  # stored zeros stay


def test_hermitian_products(spark):
    rng = np.random.default_rng(2)
    every = [(i, j) for i in range(3) for j in range(3)]
    h = masked(rng, every, True)
    h = h + h.conj().T
    H = matrix(spark, h, every, True)
    got = dense(pr.spgemm_hermitian(H, H))
    assert np.allclose(got, h @ h) and np.allclose(got, got.conj().T)
    z = masked(rng, P, True)
    Z = matrix(spark, z, P, True)
    upper = lambda m: np.where(np.add.outer(-np.repeat(range(3), SIZES), np.repeat(range(3), SIZES)) >= 0, m, 0)
    assert np.allclose(dense(pr.rarh_upper(Z, H)), upper(z @ h @ z.conj().T))
    assert np.allclose(dense(pr.rhar_upper(Z, H)), upper(z.conj().T @ h @ z))


def test_kinds_must_match(spark):
    a = matrix(spark, masked(np.random.default_rng(0), P), P)
    with pytest.raises(TypeError):
        pr.spgemm(a, a.withColumn("w", F.lit(0.0)))


def test_threshold_keeps_coherent_sums(spark):
    """Many small terms may add up to a block over the threshold: it is kept whole."""
    n = 6
    one = lambda v: spark.createDataFrame([(i, j, 0, 0, v) for i in range(n) for j in range(n)], "bi long, bj long, r int, c int, v double")
    a, b = one(1.0), one(0.08)
    got = pr.rarh_upper(a, b, 1.0)
    assert got.count() == n * (n + 1) // 2 and abs(got.first()["v"] - 2.88) < 1e-12


def test_filter_at_the_threshold(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, 3.0), (0, 0, 0, 1, 4.0), (0, 1, 0, 0, 4.999)], "bi long, bj long, r int, c int, v double")
    assert ew.filter_blocks(a, 5.0).count() == 2 and ew.filter_blocks(a, 0.0).count() == 3 and ew.filter_blocks(a, 5.1).count() == 0


def test_diagonal_only_where_stored(spark):
    a = matrix(spark, masked(np.random.default_rng(3), [(0, 1), (1, 1)]), [(0, 1), (1, 1)])
    d = spark.createDataFrame([(0, 0, 7.0), (1, 0, 1.0), (1, 2, 2.0)], "b long, r int, v double")
    assert dense(ew.shift(a, 2.0))[0, 0] == 0
    got = dense(ew.add_diagonal(a, d)) - dense(a)
    assert np.allclose(np.diag(got), [0, 1, 0, 2, 0, 0]) and np.allclose(got, np.diag(np.diag(got)))


def test_axpby_patterns(spark):
    a, b = (matrix(spark, masked(np.random.default_rng(4), s), s) for s in (P, Q))
    places = lambda df: {(r["bi"], r["bj"]) for r in df.collect()}
    assert places(pr.axpby(0, a, 2.0, b)) == set(Q) and places(pr.axpby(2.0, a, 0, b)) == set(P)
    assert places(pr.axpby(1.0, a, -1.0, b)) == set(P) | set(Q)


def test_assembly_is_a_replay(spark):
    rng = np.random.default_rng(5)
    log = [(s, int(rng.integers(2)), int(rng.integers(2)), 0, 0, float(rng.integers(1, 9)), ["ADD", "INSERT"][int(rng.integers(2))]) for s in range(60)]
    want = {}
    for _, i, j, _, _, v, mode in log:
        want[i, j] = v if mode == "INSERT" else want.get((i, j), 0) + v
    got = ew.assemble(spark.createDataFrame(log, "seq long, bi long, bj long, r int, c int, v double, mode string"))
    assert {(r["bi"], r["bj"]): r["v"] for r in got.collect()} == want


def test_extract_and_insert(spark):
    a = matrix(spark, masked(np.random.default_rng(6), P), P)
    ids = spark.createDataFrame([(2, 0), (0, 1)], "old long, new long")
    sub = ew.extract(a, ids)
    assert {(r["bi"], r["bj"]) for r in sub.collect()} == {(1, 1), (0, 1)}  # in the order given
    back = ew.insert(a, ew.scale(sub, 2.0), ids)
    x, y = dense(a), dense(back)
    assert np.allclose(y[0, 0], 2 * x[0, 0]) and np.allclose(y[0, 1:4], x[0, 1:4]) and back.count() == a.count()


def test_dot_conjugates_the_left(spark):
    x = spark.createDataFrame([(0, 0, 1.0, 2.0)], "b long, r int, v double, w double")
    y = spark.createDataFrame([(0, 0, 3.0, -1.0)], "b long, r int, v double, w double")
    r = pr.dot(x, y).first()
    assert complex(r["v"], r["w"]) == (1 - 2j) * (3 - 1j)


@pytest.mark.parametrize("cell", [None, [[2.0, 0, 0], [0.3, 1.8, 0], [0, 0.2, 2.2]]])
def test_neighbours(spark, cell):
    rng = np.random.default_rng(7)
    p = rng.uniform(-0.5, 2.5, (12, 3))
    atoms = spark.createDataFrame([(i, 0, *map(float, x)) for i, x in enumerate(p)], "gid long, type int, x double, y double, zc double")
    got = {tuple(r)[:5] for r in atomic.neighbours(atoms, 1.3, cell).collect()}
    reach, c = (range(-4, 5), np.array(cell)) if cell else (range(1), np.zeros((3, 3)))
    want = {(i, j, a, b, d) for i in range(12) for j in range(12) for a in reach for b in reach for d in reach if (i, j, a, b, d) != (i, i, 0, 0, 0) and ((p[j] + np.array([a, b, d]) @ c - p[i]) ** 2).sum() < 1.69}
    assert got == want
    if cell is None:
        with pytest.raises(ValueError):
            atomic.neighbours(atoms, 1.0, [[1.0, 0, 0], [2.0, 0, 0], [0, 0, 1.0]])


def test_structures(spark, tmp_path):
    (tmp_path / "a.xyz").write_text('2\nLattice="2 0 0 0 2 0 0 0 2"\nH 0 0 0\nO 1.5 0 0\nbad\n')
    atoms, cell, periodic = formats.read_structure(spark, str(tmp_path / "a.xyz"))
    assert [tuple(r) for r in atoms.orderBy("gid").collect()] == [(0, 1, 0.0, 0.0, 0.0), (1, 8, 1.5, 0.0, 0.0)] and periodic and cell[1][1] == 2
    (tmp_path / "POSCAR").write_text("t\n2.0\n1 0 0\n0 1 0\n0 0 1\nH O\n1 1\nDirect\n0 0 0\n.5 .5 .5\n")
    atoms, cell, _ = formats.read_structure(spark, str(tmp_path / "POSCAR"))
    assert [tuple(r)[1:] for r in atoms.orderBy("gid").collect()] == [(1, 0.0, 0.0, 0.0), (8, 1.0, 1.0, 1.0)]
    with pytest.raises(ValueError):
        formats.read_structure(spark, str(_written(tmp_path / "a.cif")))
    with pytest.raises(ValueError):
        formats.from_csr(spark, np.array([0, 2]), np.array([0]), np.array([1.0]))
    assert formats.volume([[2, 0, 0], [0, 3, 0], [0, 0, 4]]) == pytest.approx(24)


def _written(p):
    p.write_text("x")
    return p


def test_iterations(spark):
    a = generate.poisson(spark, 4, 3)
    m = np.zeros((12, 12))
    for r in a.collect():
        m[r["bi"], r["bj"]] += r["v"]
    b = np.arange(12.0)
    x, _ = iterate.conjugate_gradients(a, spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(b)], "b long, r int, v double"), 15, 1e-9)
    got = np.array([r["v"] for r in x.orderBy("b").collect()])
    assert np.allclose(m @ got, b, atol=1e-6)


def test_spectral():
    g = spectral.jackson(8)
    assert g[0] == pytest.approx(1) and (np.diff(g) < 0).all()
    x = np.linspace(-1.5, 1.5, 7)
    c = spectral.chebyshev_coefficients(np.cos, 200, 0.0, 2.0)
    assert np.allclose(np.polynomial.chebyshev.chebval(x / 2, c), np.cos(x), atol=1e-3)
    poles, residues = spectral.ozaki(60)
    e = np.array([-1.0, 0.5, 2.0])
    assert np.allclose(0.5 - 2 * (residues * e[:, None] / (e[:, None] ** 2 + poles**2)).sum(1), 1 / (1 + np.exp(e)), atol=1e-6)
    assert spectral.bessel(3, 1.0)[0] == pytest.approx(0.7651976866)


def test_missing_diagonal_is_an_error(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 0, 0, 0.1), (1, 0, 0, 0, 0.1)], "bi long, bj long, r int, c int, v double")
    with pytest.raises(Exception, match="missing"):
        iterate.graph_function(a, "exp").collect()
