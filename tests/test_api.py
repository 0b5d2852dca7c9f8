"""The objects against NumPy, on the fixtures of a small block system and random ones."""

import numpy as np
import pytest

from tesserae.api import AssemblyMode, AtomGraph, BlockGraph, BlockMatrix, ImageSet, MultiVector, Vector
from tesserae.functions import spectral
from tesserae.operators import elementwise as ew
from tesserae.operators import partition
from tesserae.sources import crystals, formats, generate


def filled(spark, sizes, adjacency, seed=0, complex_=False):
    """A matrix with random blocks and the same as an array."""
    rng = np.random.default_rng(seed)
    m = BlockMatrix.create_serial(spark, sizes, adjacency, complex if complex_ else float)
    off = np.concatenate([[0], np.cumsum(sizes)])
    dense = np.zeros((off[-1], off[-1]), complex if complex_ else float)
    for i, js in enumerate(adjacency):
        for j in js:
            x = rng.normal(size=(sizes[i], sizes[j])) + (1j * rng.normal(size=(sizes[i], sizes[j])) if complex_ else 0)
            m.add_block(i, j, x)
            dense[off[i] : off[i + 1], off[j] : off[j + 1]] = x
    m.assemble()
    m.checkpoint()
    return m, dense


SIZES = [1, 3, 2, 4, 1, 2]
ADJ = [sorted({i, (i + 1) % 6, (i + 3) % 6, (i - 1) % 6}) for i in range(6)]


@pytest.fixture(scope="module", params=[False, True], ids=["real", "complex"])
def system(spark, request):
    return filled(spark, SIZES, ADJ, 3, request.param)


def test_two_blocks(spark):
    m = BlockMatrix.create_serial(spark, [2, 2], [[0, 1], [0, 1]])
    for i in (0, 1):
        m.add_block(i, i, np.eye(2))
        m.add_block(i, 1 - i, np.full((2, 2), 0.5))
    m.assemble()
    v = m.create_vector()
    v.set_constant(1.0)
    assert np.allclose(m.mult(v).to_numpy(), 2) and np.allclose((m * 2.0).mult(v).to_numpy(), 4) and np.allclose((m + m).mult(v).to_numpy(), 4)
    s = m.duplicate()
    s.shift(1.0)
    assert np.allclose(s.mult(v).to_numpy(), 3)
    d = m.create_vector()
    d.set_constant(0.5)
    s = m.duplicate()
    s.add_diagonal(d)
    assert np.allclose(s.mult(v).to_numpy(), 2.5)
    w = m.create_multivector(2)
    w.set_constant(1.0)
    assert np.allclose(m.mult(w).to_numpy(), 2) and np.allclose(w.bdot(w), 4) and np.allclose(m._matmat(np.ones((4, 2))), 2) and np.allclose(m._rmatvec(np.ones(4)), 2)
    v.scale(2.0)
    u = v + 1.0
    v += u
    assert np.allclose(v, 5) and v.dot(v) == 100 and v @ v == 100
    assert (m.nnz, m.local_block_nnz, m.shape, len(m), m.ndim, m.matrix_kind, m.get_block_density()) == (16, 4, (4, 4), 4, 2, "bsr", 1.0)


def test_matrix_against_numpy(system):
    m, a = system
    cx = np.iscomplexobj(a)
    x = np.arange(13.0) + (1j if cx else 0)
    assert np.allclose(m.to_dense(), a) and np.allclose((m @ x).to_numpy(), a @ x) and np.allclose(m.mult_adjoint(x).to_numpy(), a.conj().T @ x)
    assert np.allclose(m.T.to_dense(), a.conj().T) and np.allclose(m.conj().to_dense(), a.conj()) and np.allclose(m.real.to_dense(), a.real) and np.allclose(m.imag.to_dense(), a.imag)
    assert np.allclose((m @ m).to_dense(), a @ a) and np.allclose(m.spmm(m, trans_a=True).to_dense(), a.conj().T @ a) and np.allclose(m.spmm_self(trans=True).to_dense(), a.conj().T @ a)
    assert np.allclose((m - m.T).to_dense(), a - a.conj().T) and np.allclose((m / 2.0).to_dense(), a / 2) and np.allclose((-m).to_dense(), -a)
    h = m + m.T
    upper = lambda y: np.triu(np.kron(np.ones((1, 1)), y))
    ha = a + a.conj().T
    off = np.concatenate([[0], np.cumsum(SIZES)])
    mask = np.zeros(a.shape, bool)
    for i in range(6):
        mask[off[i] : off[i + 1], off[i] :] = True
    assert np.allclose(h.rarh_upper(h).to_dense(), np.where(mask, ha @ ha @ ha.conj().T, 0)) and np.allclose(m.rhar_upper(h).to_dense(), np.where(mask, a.conj().T @ ha @ a, 0))
    assert np.allclose(h.square_polynomial_upper(2.0, -1.0, 3.0).to_dense(), np.where(mask, 2 * ha @ ha - ha + 3 * np.eye(13), 0)) and np.allclose(h.spmm_hermitian(h).to_dense(), ha @ ha)
    assert upper(np.eye(2)).shape == (2, 2)
    ids = [4, 1, 3]
    rows = np.concatenate([np.arange(off[i], off[i + 1]) for i in ids])
    sub = m.extract_submatrix(ids)
    assert np.allclose(sub.to_dense(), a[np.ix_(rows, rows)])
    back = m.duplicate()
    back.insert_submatrix(sub * 2.0, ids)
    want = a.copy()
    want[np.ix_(rows, rows)] *= 2
    assert np.allclose(back.to_dense(), want)
    data, ind, ptr = m.to_scipy()
    got = np.zeros_like(a)
    for i in range(13):
        got[i, ind[ptr[i] : ptr[i + 1]]] = data[ptr[i] : ptr[i + 1]]
    assert np.allclose(got, a) and (np.diff(ptr) >= 0).all()
    assert abs(m.frobenius_norm() - np.linalg.norm(a)) < 1e-9 and abs(m.maxabs() - np.abs(a).max()) < 1e-12
    b = m.get_block(1, 4)
    assert np.allclose(b, a[1:4, 10:11]) and m.get_block(0, 4) is None and m.shape_class_count > 3 and m.matrix_kind == "variable"
    zero = m.duplicate()
    zero.from_dense(np.where(np.eye(13, dtype=bool), a, 0))
    assert zero.nnz == m.nnz and np.allclose(zero.to_dense(), np.diag(np.diag(a)))
    assert m.row_ptr.tolist() == [0, *np.cumsum([len(x) for x in ADJ])] and m.col_ind.tolist() == [j for x in ADJ for j in x] and len(m.get_values()) == m.nnz


def test_in_place_and_errors(spark, system):
    m, a = system
    x = m.duplicate()
    x.transpose_()
    x.conj_()
    assert np.allclose(x.to_dense(), a.T)
    x.copy_from(x)
    with pytest.raises(ValueError, match="structures"):
        x.copy_from(m.extract_submatrix([0, 1]))
    with pytest.raises(NotImplementedError):
        m[0, 0]
    with pytest.raises(ValueError, match="shape"):
        m.duplicate().add_block(0, 1, np.ones((2, 2)))
    with pytest.raises(TypeError):
        m.spmm("x")
    with pytest.raises(ValueError, match="another"):
        m.spmm_inplace(m)
    y = m.duplicate()
    y.add_block(1, 1, np.ones((3, 3)), AssemblyMode.INSERT)
    y.add_block(1, 1, np.ones((3, 3)))
    with pytest.raises(RuntimeError, match="assembled"):
        y.filter_blocks(1.0)
    y.add_block(0, 2, np.ones((1, 2)))  # not in the pattern
    y.assemble()
    assert np.allclose(y.get_block(1, 1), 2) and y.get_block(0, 2) is None
    z = m.duplicate()
    z.spmm_inplace(y)
    z += y
    z -= y
    z *= 2.0
    assert np.allclose(z.to_dense(), 2 * a @ y.to_dense())
    f = m.duplicate()
    f.fill(3.0)
    f.fill_random(5)
    v = f.get_values()
    assert v.real.min() >= 0 and v.real.max() < 1 and len(set(v.real.tolist())) > 50
    with pytest.raises(ValueError):
        m.create_vector().from_numpy(np.ones(3))
    with pytest.raises(ValueError):
        BlockGraph.construct_distributed_flat(spark, [0, 1], [1, 1], [0, 2, 1], [0])
    grown = m.redistribute(BlockGraph(m.graph.dims, m.graph.pattern.union(spark.createDataFrame([(0, 4)], "bi long, bj long"))))
    assert np.allclose(grown.to_dense(), a) and np.allclose(grown.get_block(0, 4), 0)
    assert np.allclose(m.redistribute_cross(m.graph, [m, m], "Sum").to_dense(), 3 * a)


def test_vectors(spark, system):
    m, a = system
    rng = np.random.default_rng(1)
    cx = np.iscomplexobj(a)
    make = lambda *s: rng.normal(size=s) + (1j * rng.normal(size=s) if cx else 0)
    p, q = make(13), make(13)
    x, y = m.create_vector(), m.create_vector()
    x.from_numpy(p)
    y.from_numpy(q)
    assert np.isclose(x.dot(y), np.vdot(p, q)) and np.allclose((x * y).to_numpy(), p * q) and np.allclose((2.0 * x - y / 4).to_numpy(), 2 * p - q / 4) and np.allclose((x - 1.0).to_numpy(), p - 1)
    z = x.copy()
    z.axpby(0.5, y, -2.0)
    z.conjugate()
    assert np.allclose(z, (0.5 * q - 2 * p).conj()) and x.T is x and x.shape == (13,) and (x.local_size, x.ghost_size, x.full_size, x.size) == (13, 0, 13, 13)
    x.sync_ghosts(), x.reduce_ghosts(), x.reset_comm_stats()
    u = make(13, 3)
    w = m.create_multivector(3)
    w.from_numpy(u)
    assert np.allclose((m @ w).to_numpy(), a @ u) and np.allclose(w.bdot(w), (abs(u) ** 2).sum(0)) and np.allclose((w * x).to_numpy(), u * p[:, None]) and np.allclose((1.0 - w).to_numpy(), 1 - u)
    assert np.allclose(w.get_col(1), u[:, 1])
    w.set_col(2, x)
    assert np.allclose(w.to_numpy()[:, 2], p) and (w.local_rows, w.ghost_rows, w.num_vectors, w.shape, w.size) == (13, 0, 3, (13, 3), 39)
    other = m.create_multivector(3)
    w.swap(other)
    assert np.allclose(w, 0) and np.allclose(other.to_numpy()[:, 0], u[:, 0])
    assert np.allclose(m._rmatmat(u), a.conj().T @ u)
    r = m.create_multivector(2)
    r.set_random(7)
    b, rows = np.repeat(np.arange(6), SIZES), np.concatenate([np.arange(n) for n in SIZES])
    want = np.stack([spectral.draw("phase" if cx else "rademacher", 7, b, rows, np.full(13, c), cx) for c in (0, 1)], 1) / np.sqrt(13)
    assert np.allclose(r.to_numpy(), want) and np.allclose(r.bdot(r), 1)
    g = m.create_vector()
    g.set_random(7, kind="gaussian")
    assert np.isclose(abs(g.dot(g)), 1)


def test_hashes_are_what_they_are():
    """The published first outputs of the generator for state 0, and moments of draws."""
    assert spectral.splitmix64(np.array([0], np.uint64))[0] == 0xE220A8397B1DCDAF
    b = np.arange(20000)
    for kind in ("rademacher", "gaussian", "phase"):
        x = spectral.draw(kind, 3, b, b * 0, b * 0, True)
        assert abs(x.mean()) < 0.03 and abs((abs(x) ** 2).mean() - 1) < 0.03
    with pytest.raises(ValueError):
        spectral.draw("phase", 3, b, b, b, False)


class Sparse:
    def __init__(self, shape, indptr, indices, data, blocksize=None):
        self.shape, self.indptr, self.indices, self.data = shape, np.array(indptr), np.array(indices), np.asarray(data)
        self.format = "bsr" if blocksize else "csr"
        if blocksize:
            self.blocksize = blocksize


def test_exchange(spark, tmp_path):
    blocks = np.arange(8.0).reshape(2, 2, 2)
    m = BlockMatrix.from_scipy(spark, Sparse((4, 4), [0, 1, 2], [0, 1], blocks, (2, 2)))
    want = np.zeros((4, 4))
    want[:2, :2], want[2:, 2:] = blocks
    data, ind, ptr = m.to_scipy()
    assert m.matrix_kind == "bsr" and np.allclose(m.to_dense(), want) and np.allclose(data, blocks) and ind.tolist() == [0, 1] and ptr.tolist() == [0, 1, 2]
    c = BlockMatrix.from_scipy(spark, Sparse((3, 3), [0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0]))
    assert c.matrix_kind == "csr" and c.nnz == 3 and np.allclose(c.to_dense(), [[1, 0, 2], [0, 0, 0], [0, 3, 0]])
    with pytest.raises(ValueError):
        BlockMatrix.from_scipy(spark, Sparse((3, 4), [0, 0, 0, 0], [], []))
    c.save_matrix_market(str(tmp_path / "m"))
    lines = "\n".join(p.read_text().strip() for p in sorted((tmp_path / "m").glob("part-*")) if p.stat().st_size).split("\n")
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == "3 3 3" and lines[2] == "1 1 1.0000000000000000e+00" and len(lines) == 5


def test_graphs(spark):
    g = BlockGraph.construct_distributed(spark, [2, 5, 9], [1, 2, 3], [[2, 9], [5], [5, 9]])
    assert g.owned_global_indices.tolist() == [2, 5, 9] and g.block_sizes.tolist() == [1, 2, 3] and g.adj_ptr.tolist() == [0, 2, 3, 5] and g.adj_ind.tolist() == [0, 2, 1, 1, 2]
    assert (g.owned_scalar_rows, g.local_scalar_cols, g.global_scalar_rows, g.global_scalar_cols, g.rank, g.size) == (6, 6, 6, 6, 0, 1) and not len(g.ghost_global_indices)
    assert g.get_local_index(9) == 2 and g.get_local_index(4) == -1 and g.get_global_index(1) == 5
    one = BlockGraph.construct_distributed(spark, [2, 5, 9], [1, 2, 3], [[2], [5], [9]])
    assert g.contains(one) and not one.contains(g) and not g.same(one) and g.same(one.union(g)) and one.union(g).pattern.count() == 5


def test_random_and_geometric(spark):
    m = BlockMatrix.create_random(spark, 40, 1, 4, 0.2)
    assert m.graph.n_blocks == 40 and all((i - 1) % 40 in row and i in row for i, row in m.graph._rows.items()) and m.get_values().max() < 1
    dims, entries = generate.geometric_matrix(spark, (5, 4, 4), 12)
    g = BlockMatrix.of(entries, dims)
    assert g.matrix_kind == "variable" and 8 <= g.local_block_nnz / 80 <= 20 and set(g.graph.block_sizes.tolist()) <= {9, 13, 15, 20}
    assert g.graph.pattern.subtract(g.graph.pattern.selectExpr("bj bi", "bi bj")).isEmpty()


def test_two_atoms_and_images(spark):
    cell = np.eye(3) * 10
    a = AtomGraph.from_points(spark, [[0, 0, 0], [1.5, 0, 0]], [1, 8], cell, [False] * 3, {1: 2.0, "O": 2.0}, {1: 1, 8: 4})
    assert a.atom_types.tolist() == [0, 1] and a.z.tolist() == [1, 8] and a.edge_index.tolist() == [[0, 1], [1, 0]] and (a.edge_shift == 0).all() and np.allclose(a.edge_vectors, [[1.5, 0, 0], [-1.5, 0, 0]])
    assert a.norb() == 5 and a.get_atom_norb(1) == 4 and a.n_atom == 2 and a.pbc == [False] * 3 and np.allclose(a.pos, a.positions) and a.graph.block_sizes.tolist() == [1, 4] and a.volume() == pytest.approx(1000)
    assert a.indices.tolist() == a.atom_indices.tolist() == [0, 1]
    with pytest.raises(ValueError):
        AtomGraph.from_points(spark, [[0, 0, 0]], [1, 2], cell, False, 1.0)
    with pytest.raises(ValueError, match="missing"):
        AtomGraph.from_points(spark, [[0, 0, 0]], [6], cell, False, {1: 2.0})
    h = AtomGraph.from_points(spark, [[0, 0, 0], [1.5, 0, 0]], [1, 1], cell, False, 2.0)
    im = ImageSet(h)
    im.add_block(0, 1, np.array([[2.0]]), mode="insert")
    im.assemble()
    k = im.sample_k([0, 0, 0])
    assert k.shape == (2, 2) and np.allclose(k.to_dense(), [[0, 2], [0, 0]]) and np.allclose(im.sample_k([0, 0, 0], symm=True).to_dense(), [[0, 1], [1, 0]])
    for bad in (lambda: im.add_block(0, 1, np.eye(1), mode="x"), lambda: im.sample_k([0, 0]), lambda: im.sample_k([0, 0, 0], "x"), lambda: ImageSet(h, np.float32)):
        with pytest.raises(ValueError):
            bad()
    im.add_block(0, 1, np.eye(1), [1, 0, 0])
    with pytest.raises(ValueError, match="shift"):
        im.assemble()


def test_chain_with_images(spark):
    """A periodic chain of two atoms: both phase conventions against their sums, sums of sets, three bodies."""
    pos, cell = np.array([[0.2, 0, 0], [2.9, 0, 0]]), np.diag([4.0, 20, 20])
    a = AtomGraph.from_points(spark, pos, [6, 7], cell, [True, False, False], 1.6, {"C": 1, 7: 2})
    got = {(*e, s) for e, s in zip(map(tuple, a.edge_index.tolist()), a.edge_shift[:, 0].tolist(), strict=True)}
    assert {((*e[:2],), e[2]) for e in got} == {((0, 1), 0), ((1, 0), 0), ((0, 1), -1), ((1, 0), 1)} and np.allclose(sorted(abs(a.edge_vectors[:, 0])), [1.3, 1.3, 2.7, 2.7])
    im = ImageSet(a, complex)
    rng = np.random.default_rng(2)
    blocks = {}
    for i, j, s in [(0, 0, 0), (1, 1, 0), (0, 1, 0), (0, 1, -1), (1, 0, 1), (1, 0, 0)]:
        x = rng.normal(size=(1 + i, 1 + j)) + 1j * rng.normal(size=(1 + i, 1 + j))
        blocks[i, j, s] = x
        im.add_block(i, j, x, [s, 0, 0])
    im.assemble()
    for convention in ("R", "R+tau"):
        want, k, off = np.zeros((3, 3), complex), 0.3, [0, 1, 3]
        for (i, j, s), x in blocks.items():
            t = s + ((pos[j, 0] - pos[i, 0]) / 4 if convention == "R+tau" else 0)
            want[off[i] : off[i + 1], off[j] : off[j + 1]] += x * np.exp(-2j * np.pi * k * t)
        assert np.allclose(im.sample_k([k, 0, 0], convention).to_dense(), want)
    assert np.allclose(im.get_block(1, 0, [1, 0, 0]), blocks[1, 0, 1]) and im.get_block(0, 0, [1, 0, 0]) is None
    two = ImageSet(a, complex)
    im.redistribute_into(two)
    two.axpy_into(im, 2.0)
    assert np.allclose(two.get_block(0, 1, [-1, 0, 0]), 3 * blocks[0, 1, -1])
    im.redistribute_into(two, "Sum", [im])
    assert np.allclose(two.get_block(0, 1), 2 * blocks[0, 1, 0])
    t = a.get_atomicdata3b([1.6, 1.6], [1.6, 1.6])
    shifts = {tuple(e) + (s,) for e, s in zip(t.edge_index.tolist(), t.edge_shift[:, 0].tolist(), strict=True)}
    assert (0, 0, 1) in shifts and (1, 1, -1) in shifts and (0, 0, 0) not in shifts
    with pytest.raises(ValueError):
        im.axpy_into(ImageSet(t), 1.0)
    assert a.get_graph3b([1.0, 1.0], [1.0, 1.0]).same(a.graph)
    again = AtomGraph.from_graph_arrays(spark, pos, [6, 7], cell, [True, False, False], a.edge_index, a.edge_shift, [1, 2])
    assert np.allclose(again.edge_vectors, a.edge_vectors) and again.norb() == 3


def test_neighbours_with_a_cell_against_all_images(spark):
    """Random atoms, some outside their skewed cell, every mixture of periodic axes, a cutoff beyond the cell."""
    import itertools

    rng = np.random.default_rng(9)
    cell = np.array([[2.0, 0, 0], [0.5, 1.8, 0], [0.1, 0.2, 2.2]])
    pos = rng.uniform(-2, 3, (9, 3))
    for pbc in itertools.product([False, True], repeat=3):
        a = AtomGraph.from_points(spark, pos, [1] * 9, cell, pbc, 1.05)
        got = {(*e, *s) for e, s in zip(map(tuple, a.edge_index.tolist()), map(tuple, a.edge_shift.tolist()), strict=True)} if a._edges.num_rows else set()
        spans = [range(-6, 7) if p else (0,) for p in pbc]
        want = {(i, j, *r) for i in range(9) for j in range(9) for r in itertools.product(*spans) if (i != j or any(r)) and np.linalg.norm(pos[j] + np.array(r) @ cell - pos[i]) < 2.1}
        assert got == want, pbc


def test_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, p), float(1 + i % 3)) for i, p in enumerate(rng.normal(size=(400, 3)) * [5, 2, 1])]
    df = spark.createDataFrame(rows, "gid long, x double, y double, zc double, w double")
    planes = partition.inertial_bisection(df, 6, "w")
    weight = {r["part"]: r["s"] for r in partition.classify(df, planes).groupBy("part").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()}
    assert sorted(weight) == list(range(6)) and max(weight.values()) < 1.1 * sum(weight.values()) / 6
    near = partition.reach(df, planes, 0.5)
    inside = partition.classify(df, planes).select("gid", "part")
    assert inside.subtract(near.select("gid", "part")).isEmpty() and near.count() > 400
    parts = partition.by_morton(df, 4)
    assert parts.count() == 400 and partition.classify(df, partition.inertial_bisection(df, 1)).select("part").distinct().count() == 1


def test_crystals(spark, tmp_path):
    atoms = crystals.nanocrystal(spark, 22)
    got = {r["z"]: r["count"] for r in atoms.groupBy("z").count().collect()}
    assert (got[49], got[15], got[1]) == crystals.nanocrystal_counts(22) and (got[49], got[15]) == (5083, 4444)
    assert sorted(r["gid"] for r in atoms.collect()) == list(range(sum(got.values())))
    with pytest.raises(ValueError):
        crystals.nanocrystal(spark, 3)
    small = crystals.nanocrystal(spark, 2)
    for name, text in (("a.xyz", crystals.xyz_text(small, np.eye(3) * 30)), ("b.vasp", crystals.poscar_text(small, np.eye(3) * 30))):
        (tmp_path / name).write_text(text)
        back, cell, periodic = formats.read_structure(spark, str(tmp_path / name))
        assert periodic and cell[0][0] == 30 and sorted((r["z"], round(r["x"], 6)) for r in back.collect()) == sorted((r["z"], round(r["x"], 6)) for r in small.collect())
        assert AtomGraph.from_file(spark, str(tmp_path / name), 1.4).n_atom == small.count()
    sheet, cell = crystals.trilayer(spark, 20, 2, profile="contact", strain=0.02, edges=(30.0, 60.0), sigma=4.0)
    x = np.array(sorted(r["x"] for r in sheet.where("z = 42").collect()))
    assert cell[0][0] > 20 * 3.16 * 3**0.5 and (np.diff(x) >= 0).all() and x.max() < cell[0][0]
    for bad in ({"profile": "x"}, {"strain": -1.0}, {"profile": "flat", "biaxial": True}, {"profile": "contact"}):
        with pytest.raises(ValueError):
            crystals.trilayer(spark, 2, 2, **bad)


def test_two_centre_blocks(spark):
    """s-p and p-p blocks against the textbook's direction cosines; d blocks turn with the bond."""
    rng = np.random.default_rng(6)
    d = rng.normal(size=3)
    n = d / np.linalg.norm(d)
    ch = {(0, 0, 0): 1.0, (0, 1, 0): 2.0, (1, 0, 0): 2.0, (1, 1, 0): 3.0, (1, 1, 1): -0.5}
    b = crystals.pair_block(d, [0, 1], [0, 1], ch)
    yzx = n[[1, 2, 0]]
    assert np.isclose(b[0, 0], 1) and np.allclose(b[0, 1:], 2 * yzx) and np.allclose(b[1:, 0], -2 * yzx) and np.allclose(b[1:, 1:], 3.5 * np.outer(yzx, yzx) - 0.5 * np.eye(3))
    e = crystals.pair_block(d, [2], [2], {(2, 2, m): v for m, v in ((0, 1.0), (1, 1.0), (2, 1.0))})
    assert np.allclose(e, np.eye(5))
    pd = crystals.pair_block(d, [1], [2], {(1, 2, 0): 1.0, (1, 2, 1): 0.3})
    assert np.allclose(np.linalg.svd(pd)[1], [1, 0.3, 0.3])
    with pytest.raises(ValueError):
        crystals.pair_block(d, [1], [1], {(1, 1, 2): 1.0})
    rows = [(0, 1, 0, 0, 0, *d.tolist(), 49, 15), (1, 0, 0, 0, 0, *(-d).tolist(), 15, 49)]
    df = spark.createDataFrame(rows, "src long, dst long, rx int, ry int, rz int, dx double, dy double, dz double, zi int, zj int")
    got = crystals.two_centre(df, {49: [0, 1], 15: [0, 1]}, {(49, 15): ch}).toPandas()
    x = np.zeros((2, 4, 4))
    x[got["bi"], got["r"], got["c"]] = got["v"]
    assert np.allclose(x[0], b) and np.allclose(x[1], b.T)


def test_thresholded_product_is_pruned_in_the_join(spark):
    """No semi-join by (bi, bk, bj) follows the join of scalars, and the result is that of the rule."""
    from tesserae.operators import products as pr

    m, a = filled(spark, [2] * 12, [sorted({i, (i * 5 + 1) % 12, (i * 7 + 2) % 12}) for i in range(12)], 8)
    norm = np.linalg.norm(a.reshape(12, 2, 12, 2), axis=(1, 3))
    eps, n = 3.0, (norm > 0).sum(1)
    want = np.zeros_like(a)
    for i in range(12):
        for k in range(12):
            for j in range(12):
                if norm[i, k] > 0 and norm[k, j] > 0 and norm[i, k] * norm[k, j] >= eps / max(1, n[i]):
                    want[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += a[2 * i : 2 * i + 2, 2 * k : 2 * k + 2] @ a[2 * k : 2 * k + 2, 2 * j : 2 * j + 2]
    keep = np.repeat(np.repeat(np.linalg.norm(want.reshape(12, 2, 12, 2), axis=(1, 3)) >= eps, 2, 0), 2, 1)
    out = m.spmm(m, eps)
    assert np.allclose(out.to_dense(), np.where(keep, want, 0))
    sym = {(r["bi"], r["bj"]) for r in m.symbolic(m, eps).collect()}
    assert {(i, j) for i, j in zip(*np.nonzero(np.where(keep, want, 0).reshape(12, 2, 12, 2).any((1, 3))), strict=True)} <= sym
    plan = pr.spgemm(m.df, m.df, eps)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, ((bi#" not in plan.replace("bk", "") or "bk" not in plan.split("LeftSemi")[1].split("\n")[0]


def test_triple_product_keeps_coherent_sums(spark):
    """All pairs are small, their sum is not: budgets must not drop it."""
    ones = BlockMatrix.create_serial(spark, [1] * 6, [list(range(6))] * 6)
    ones.fill(1.0)
    b = ones * 0.08
    got = ones.rarh_upper(b, 1.0).to_dense()
    assert np.allclose(got, np.triu(np.full((6, 6), 2.88)))


def test_complex_operands_of_real_methods(spark):
    from tesserae.plans import iterate

    a, b = spark.createDataFrame([(0, 0, 0, 0, 1.0, 0.5)], "bi long, bj long, r int, c int, v double, w double"), spark.createDataFrame([(0, 0, 1.0, 0.0)], "b long, r int, v double, w double")
    for f in (lambda: iterate.conjugate_gradients(a, b), lambda: iterate.kpm_moments(a, b, 4), lambda: iterate.propagate(a.drop("w"), b, 1.0, 4, 1.0)):
        with pytest.raises(TypeError):
            f()
    with pytest.raises(KeyError):
        iterate.graph_function(a, "log")
    assert ew.extract_batched(a, spark.createDataFrame([(1, 0, 5)], "batch int, old long, new long")).first()["bi"] == 5 and issubclass(MultiVector, Vector)
