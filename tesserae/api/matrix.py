"""Block-sparse matrices as objects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum
from numbers import Number

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.api.graph import BlockGraph
from tesserae.api.vector import MultiVector, Vector
from tesserae.operators import elementwise as ew
from tesserae.operators import products as pr
from tesserae.schema import PLACE, is_complex
from tesserae.sources import formats, generate


class AssemblyMode(Enum):
    """Whether a block replaces what is there or is added to it."""

    INSERT = "INSERT"
    ADD = "ADD"


def block_rows(spark: SparkSession, blocks: Sequence[tuple], keys: Sequence[str] = ("bi", "bj"), complex_: bool = False) -> DataFrame:
    """A log of blocks (*keys, array, mode) in order: seq, keys, r, c, v[, w], mode."""
    cols: dict[str, list[np.ndarray]] = {n: [] for n in ("seq", *keys, "r", "c", "v", *(["w"] if complex_ else []))}
    modes: list[str] = []
    for seq, (*at, block, mode) in enumerate(blocks):
        x = np.atleast_2d(np.asarray(block))
        r, c = np.divmod(np.arange(x.size), x.shape[1])
        values = {"seq": np.full(x.size, seq), "r": r.astype(np.int32), "c": c.astype(np.int32), "v": x.real.ravel().astype(float), "w": x.imag.ravel().astype(float)}
        values |= {k: np.full(x.size, v) for k, v in zip(keys, at, strict=True)}
        for name, col in cols.items():
            col.append(values[name])
        modes += [mode.value] * x.size
    kind = {"v": np.float64, "w": np.float64, "r": np.int32, "c": np.int32}
    made = {n: np.concatenate(x).astype(kind.get(n, np.int64)) if x else np.empty(0, kind.get(n, np.int64)) for n, x in cols.items()}
    return spark.createDataFrame(pa.table(made | {"mode": pa.array(modes, pa.string())}))


class BlockMatrix:
    """A square block matrix on a graph: ``df`` (bi, bj, r, c, v[, w]), one row for each stored scalar."""

    ndim = 2

    def __init__(self, graph: BlockGraph, df: DataFrame | None = None, dtype: type = np.float64):
        self.graph, self.spark = graph, graph.spark
        self._cx = np.dtype(dtype).kind == "c" if df is None else is_complex(df)
        if df is None:
            df = graph.places().withColumn("v", F.lit(0.0))
            df = df.withColumn("w", F.lit(0.0)) if self._cx else df
        self.df = df
        self._pending: list[tuple] = []
        self._logs: list[DataFrame] = []

    # -- constructors ---------------------------------------------------------------
    @classmethod
    def create_serial(cls, spark: SparkSession, sizes: Sequence[int], adjacency: Sequence[Sequence[int]], dtype: type = np.float64) -> BlockMatrix:
        """Zeros on the blocks of an adjacency list."""
        return cls(BlockGraph.construct_serial(spark, sizes, adjacency), dtype=dtype)

    @classmethod
    def create_distributed(cls, spark: SparkSession, ids: Sequence[int], sizes: Sequence[int], adjacency: Sequence[Sequence[int]], dtype: type = np.float64) -> BlockMatrix:
        """As ``create_serial`` for blocks of any ascending ids."""
        return cls(BlockGraph.construct_distributed(spark, ids, sizes, adjacency), dtype=dtype)

    @classmethod
    def create_distributed_flat(cls, spark: SparkSession, ids: Sequence[int], sizes: Sequence[int], ptr: Sequence[int], ind: Sequence[int], dtype: type = np.float64) -> BlockMatrix:
        """As ``create_distributed`` from CSR arrays."""
        return cls(BlockGraph.construct_distributed_flat(spark, ids, sizes, ptr, ind), dtype=dtype)

    @classmethod
    def of(cls, entries: DataFrame, sizes: DataFrame | None = None) -> BlockMatrix:
        """Of stored entries, with the sizes that they show unless given."""
        return cls(BlockGraph.of(entries, sizes), entries)

    @classmethod
    def create_random(cls, spark: SparkSession, blocks: int = 100, size_min: int = 1, size_max: int = 4, density: float = 0.01, dtype: type = np.float64, seed: int = 42) -> BlockMatrix:
        """Self, ring neighbours and about blocks * density - 2 more a row; sizes and values from hashes of their places."""
        dims, entries = generate.random_blocks(spark, blocks, size_min, size_max, density, seed, np.dtype(dtype).kind == "c")
        return cls(BlockGraph(dims, entries.select("bi", "bj")), entries)

    @classmethod
    def from_scipy(cls, spark: SparkSession, m) -> BlockMatrix:
        """Of a SciPy-like square sparse matrix: BSR keeps its square blocks, any other becomes 1 x 1 blocks."""
        if m.shape[0] != m.shape[1]:
            raise ValueError("the matrix isn't square")
        size = getattr(m, "blocksize", (1, 1)) if getattr(m, "format", "") == "bsr" else (1, 1)
        if size[0] != size[1] or m.shape[0] % size[0]:
            raise ValueError("blocks must be square and divide the matrix")
        if getattr(m, "format", "csr") not in ("bsr", "csr"):
            m = m.tocsr()
        return cls.from_csr(spark, m.indptr, m.indices, np.asarray(m.data).reshape(-1, size[0], size[0]))

    @classmethod
    def from_csr(cls, spark: SparkSession, ptr: np.ndarray, ind: np.ndarray, data: np.ndarray) -> BlockMatrix:
        """Of CSR arrays of scalars, or of square blocks (n, s, s)."""
        x = np.asarray(data)
        x = x.reshape(-1, 1, 1) if x.ndim == 1 else x
        n, s = len(ptr) - 1, x.shape[1] if x.ndim == 3 and x.size else 1
        graph = BlockGraph.construct_distributed_flat(spark, range(n), [s] * n, ptr, ind)
        return cls(graph, formats.from_csr(spark, ptr, ind, x))

    # -- extents and structure ----------------------------------------------------------
    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.complex128 if self._cx else np.float64)

    @property
    def shape(self) -> tuple[int, int]:
        return (self.graph.global_scalar_rows,) * 2

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def nnz(self) -> int:
        return self.df.count()

    local_nnz = global_nnz = property(lambda self: self.nnz)

    @property
    def local_block_nnz(self) -> int:
        return self.df.select("bi", "bj").distinct().count()

    def get_block_density(self) -> float:
        """Stored blocks over all blocks; sizes don't count."""
        return self.local_block_nnz / max(1, self.graph.n_blocks) ** 2

    @property
    def matrix_kind(self) -> str:
        """csr if all blocks have size 1, bsr if all have the same, else variable."""
        lo, hi = self.graph.dims.agg(F.min("n"), F.max("n")).first()
        return "csr" if (hi or 1) <= 1 else "bsr" if lo == hi else "variable"

    @property
    def shape_class_count(self) -> int:
        """Distinct shapes of blocks; 0 unless sizes vary."""
        return ew.shapes(self.df).count() if self.matrix_kind == "variable" else 0

    @property
    def row_ptr(self) -> np.ndarray:
        return BlockGraph(self.graph.dims, self.df.select("bi", "bj")).adj_ptr

    @property
    def col_ind(self) -> np.ndarray:
        return BlockGraph(self.graph.dims, self.df.select("bi", "bj")).adj_ind

    def get_values(self) -> np.ndarray:
        """Stored scalars by block row, block column and place."""
        t = self.df.orderBy(*PLACE).select(*(["v", "w"] if self._cx else ["v"])).toArrow()
        v = t.column("v").to_numpy()
        return v + 1j * t.column("w").to_numpy() if self._cx else v

    def __getitem__(self, key):
        raise NotImplementedError("no indexing; use get_block, extract_submatrix or the DataFrame")

    # Settings of a storage that this engine doesn't have.
    page_size, vendor_backend_name, vendor_launch_count, has_contiguous_layout = 0, "spark", 0, True

    def set_page_size(self, n: int) -> None:
        """Nothing to set."""

    def pack_contiguous(self) -> None:
        """Nothing to pack."""

    def reset_vendor_launch_count(self) -> None:
        """Nothing is counted."""

    # -- assembly -------------------------------------------------------------------------
    def add_block(self, i: int, j: int, block: np.ndarray, mode: AssemblyMode = AssemblyMode.ADD) -> None:
        """Note a block for ``assemble``; ValueError if its shape is wrong."""
        x = np.atleast_2d(np.asarray(block))
        at = self.graph.get_local_index(i), self.graph.get_local_index(j)
        if min(at) < 0 or x.shape != tuple(int(self.graph.block_sizes[k]) for k in at):
            raise ValueError(f"block ({i}, {j}) can't have shape {x.shape}")
        if np.iscomplexobj(x) and not self._cx:
            raise TypeError("a complex block for a real matrix")
        self._pending.append((i, j, x, mode))

    def add_blocks(self, log: DataFrame) -> None:
        """Note a whole log (seq, bi, bj, r, c, v[, w], mode) for ``assemble``, after what was noted before."""
        self._flush()
        self._logs.append(log)

    def _flush(self) -> None:
        if self._pending:
            self._logs.append(block_rows(self.spark, self._pending, complex_=self._cx))
            self._pending = []

    def assemble(self) -> None:
        """Replay what was noted on what is stored; blocks that aren't in the pattern are left out."""
        self._flush()
        for log in self._logs:
            stored = self.df.select(F.lit(-1).cast("long").alias("seq"), *PLACE, *[c for c in ("v", "w") if c in self.df.columns], F.lit("ADD").alias("mode"))
            log = log.select(F.col("seq").cast("long").alias("seq"), *stored.columns[1:])
            self.df = ew.assemble(stored.unionByName(log), self.df.select("bi", "bj").distinct())
        self._logs = []

    def _ready(self) -> None:
        if self._pending or self._logs:
            raise RuntimeError("blocks are noted that aren't assembled")

    def get_block(self, i: int, j: int) -> np.ndarray | None:
        """A stored block, None if there is none."""
        t = ew.get_block(self.df, i, j).toArrow()
        if not t.num_rows:
            return None
        r, c, v = (t.column(x).to_numpy() for x in ("r", "c", "v"))
        out = np.zeros((r.max() + 1, c.max() + 1), self.dtype)
        out[r, c] = v + 1j * t.column("w").to_numpy() if self._cx else v
        return out

    def fill(self, x: complex) -> None:
        self.df = self.df.select(*PLACE, F.lit(float(x.real)).alias("v"), *([F.lit(float(x.imag)).alias("w")] if self._cx else []))

    def fill_random(self, seed: int = 0) -> None:
        """Uniform in [0, 1) from a hash of each place."""
        self.df = self.df.select(*PLACE, *(generate.uniform(*PLACE, seed=seed + k).alias(c) for k, c in enumerate(("v", "w")[: 1 + self._cx])))

    def from_dense(self, x: np.ndarray) -> None:
        """Take the stored blocks' values from a dense array."""
        x = np.asarray(x)
        if x.shape != self.shape:
            raise ValueError(f"shape {x.shape} isn't {self.shape}")
        i, j = np.divmod(np.arange(x.size), x.shape[1])
        cols = {"i": i, "j": j, "v": x.real.ravel().astype(float)} | ({"w": x.imag.ravel().astype(float)} if self._cx else {})
        dense = self.spark.createDataFrame(pa.table(cols))
        row = self.graph.dims.select(F.col("b").alias("bi"), F.col("off").alias("_i"))
        col = self.graph.dims.select(F.col("b").alias("bj"), F.col("off").alias("_j"))
        at = self.df.select(*PLACE).join(row, "bi").join(col, "bj").withColumns({"i": F.col("_i") + F.col("r"), "j": F.col("_j") + F.col("c")})
        self.df = at.join(dense, ["i", "j"]).select(*PLACE, *(["v", "w"] if self._cx else ["v"]))

    # -- export -------------------------------------------------------------------------------
    def entries(self) -> DataFrame:
        """i, j, v[, w] by scalar coordinates."""
        return ew.expand(self.df, self.graph.dims)

    def to_dense(self, limit: int = 4096) -> np.ndarray:
        return formats.to_dense(self.entries(), len(self), limit)

    def to_scipy(self, format: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, indices, indptr) with ascending columns, as SciPy's constructors take them: blocks for csr and bsr matrices, scalars otherwise or for "csr"."""
        kind = format or ("csr" if self.matrix_kind == "variable" else self.matrix_kind)
        if kind == "bsr":
            s = int(self.graph.block_sizes[0]) if self.graph.n_blocks else 1
            return self.get_values().reshape(-1, s, s), self.col_ind, self.row_ptr
        t = self.entries().orderBy("i", "j").toArrow()
        v = t.column("v").to_numpy()
        i = t.column("i").to_numpy()
        return v + 1j * t.column("w").to_numpy() if self._cx else v, t.column("j").to_numpy(), np.searchsorted(i, np.arange(len(self) + 1))

    def save_matrix_market(self, path: str) -> None:
        """Text files in the folder ``path``; see ``sources.formats.write_matrix_market``."""
        formats.write_matrix_market(self.entries(), len(self), path)

    # -- vectors -------------------------------------------------------------------------------
    def create_vector(self) -> Vector:
        return Vector(self.graph, dtype=self.dtype)

    def create_multivector(self, k: int) -> MultiVector:
        return MultiVector(self.graph, dtype=self.dtype, k=k)

    def _as_vector(self, x):
        if isinstance(x, Vector):
            return x
        x = np.asarray(x)
        out = self.create_vector() if x.ndim == 1 else self.create_multivector(x.shape[1])
        out.from_numpy(x)
        return out

    def mult(self, x, adjoint: bool = False):
        """A x (or A^H x) of a vector, multivector or array; rows without entries are 0."""
        x = self._as_vector(x)
        y = pr.spmv(self.df, x.df, adjoint)
        zero = x._with(x._filled(0.0, self.dtype if self._cx else x.dtype))
        return x._with(pr.vector_axpby(1.0, y, 1.0, zero.df))

    def mult_adjoint(self, x):
        """A^H x."""
        return self.mult(x, adjoint=True)

    mult_dense, mult_dense_adjoint = mult, mult_adjoint

    def _matvec(self, x: np.ndarray) -> np.ndarray:
        return self.mult(np.asarray(x).reshape(-1)).to_numpy()

    def _rmatvec(self, x: np.ndarray) -> np.ndarray:
        return self.mult_adjoint(np.asarray(x).reshape(-1)).to_numpy()

    def _matmat(self, x: np.ndarray) -> np.ndarray:
        return self.mult(x).to_numpy()

    def _rmatmat(self, x: np.ndarray) -> np.ndarray:
        return self.mult_adjoint(x).to_numpy()

    # -- copies and element-wise -------------------------------------------------------------------
    def _of(self, df: DataFrame, same: bool = False) -> BlockMatrix:
        return BlockMatrix(self.graph if same else BlockGraph(self.graph.dims, df.select("bi", "bj")), df)

    def duplicate(self, independent_graph: bool = True) -> BlockMatrix:
        """A copy; plans are immutable, so nothing is copied."""
        self._ready()
        return BlockMatrix(self.graph, self.df)

    copy = duplicate

    def copy_from(self, other: BlockMatrix) -> None:
        """Take the values of a matrix of the same structure, else ValueError."""
        self._ready()
        if self._cx != other._cx or not self.graph.same(other.graph):
            raise ValueError("structures differ")
        self.df = other.df

    def scale(self, alpha: complex) -> None:
        if isinstance(alpha, complex) and not self._cx:
            raise TypeError("a complex factor for a real matrix")
        self.df = ew.scale(self.df, alpha)

    def conj_(self) -> None:
        self.df = ew.conjugate(self.df)

    def conjugate(self) -> BlockMatrix:
        return self._of(ew.conjugate(self.df), True)

    conj = conjugate

    @property
    def real(self) -> BlockMatrix:
        return self._of(ew.real(self.df), True)

    @property
    def imag(self) -> BlockMatrix:
        return self._of(ew.imag(self.df), True)

    def transpose(self) -> BlockMatrix:
        """A^H."""
        return self._of(ew.transpose(self.df))

    T = property(transpose)

    def transpose_(self) -> None:
        x = self.transpose()
        self.graph, self.df = x.graph, x.df

    def shift(self, alpha: float) -> None:
        self.df = ew.shift(self.df, alpha)

    def add_diagonal(self, x: Vector | np.ndarray) -> None:
        """ValueError if an array is shorter than the diagonal."""
        self.df = ew.add_diagonal(self.df, self._as_vector(x).df)

    def commutator_diagonal(self, x: Vector | np.ndarray) -> BlockMatrix:
        return self._of(ew.commutator_diagonal(self.df, self._as_vector(x).df), True)

    def filter_blocks(self, eps: float) -> None:
        self._ready()
        x = self._of(ew.filter_blocks(self.df, eps))
        self.graph, self.df = x.graph, x.df

    def zero_diagonal_blocks(self) -> None:
        self.df = ew.zero_diagonal_blocks(self.df)

    def hermitize_diagonal_blocks(self) -> None:
        self.df = ew.hermitize_diagonal_blocks(self.df)

    def frobenius_norm(self) -> float:
        return float(ew.frobenius(self.df).first()["frobenius"] or 0.0)

    def maxabs(self) -> float:
        return float(ew.frobenius(self.df).first()["maxabs"] or 0.0)

    # -- products and sums ------------------------------------------------------------------------------
    def _same_family(self, other: BlockMatrix) -> None:
        if not isinstance(other, BlockMatrix):
            raise TypeError("not a block matrix")
        if self._cx != other._cx:
            raise TypeError("operands must both be real or both be complex")

    def spmm(self, other: BlockMatrix, threshold: float = 0.0, trans_a: bool = False, trans_b: bool = False) -> BlockMatrix:
        self._same_family(other)
        return self._of(pr.spgemm(self.df, other.df, threshold, trans_a, trans_b))

    def spmm_self(self, threshold: float = 0.0, trans: bool = False) -> BlockMatrix:
        return self.spmm(self, threshold, trans_a=trans)

    def spmm_inplace(self, other: BlockMatrix, threshold: float = 0.0) -> None:
        if other is self:
            raise ValueError("the operand must be another matrix")
        x = self.spmm(other, threshold)
        self.graph, self.df = x.graph, x.df

    def spmm_hermitian(self, other: BlockMatrix, threshold: float = 0.0) -> BlockMatrix:
        self._same_family(other)
        return self._of(pr.spgemm_hermitian(self.df, other.df, threshold))

    def spmm_hermitian_upper(self, other: BlockMatrix, threshold: float = 0.0) -> BlockMatrix:
        self._same_family(other)
        return self._of(pr.spgemm(self.df, other.df, threshold, upper=True))

    def symbolic(self, other: BlockMatrix, threshold: float = 0.0, upper: bool = False) -> DataFrame:
        """bi, bj and bound of the product's blocks, from norms alone."""
        return pr.symbolic(self.df, other.df, threshold, upper)

    def complete_hermitian(self) -> BlockMatrix:
        return self._of(pr.complete_hermitian(self.df))

    def complete_hermitian_inplace(self) -> None:
        x = self.complete_hermitian()
        self.graph, self.df = x.graph, x.df

    def square_polynomial_upper(self, c2: float, c1: float, c0: float, threshold: float = 0.0) -> BlockMatrix:
        """Upper blocks of c2 A^2 + c1 A + c0 I."""
        one = self.graph.rows().select(F.col("b").alias("bi"), F.col("b").alias("bj"), "r", F.col("r").alias("c"), F.lit(1.0).alias("v"), *([F.lit(0.0).alias("w")] if self._cx else []))
        return self._of(pr.square_polynomial_upper(self.df, one, c2, c1, c0, threshold))

    def rarh_upper(self, b: BlockMatrix, threshold: float = 0.0) -> BlockMatrix:
        """Upper blocks of A B A^H."""
        self._same_family(b)
        return self._of(pr.rarh_upper(self.df, b.df, threshold))

    def rhar_upper(self, b: BlockMatrix, threshold: float = 0.0) -> BlockMatrix:
        """Upper blocks of A^H B A."""
        self._same_family(b)
        return self._of(pr.rhar_upper(self.df, b.df, threshold))

    def axpby(self, alpha: complex, x: BlockMatrix, beta: complex) -> None:
        """Becomes alpha X + beta times itself, on the union of patterns."""
        self._same_family(x)
        y = self._of(pr.axpby(alpha, x.df, beta, self.df))
        self.graph, self.df = y.graph, y.df

    def axpy(self, alpha: complex, x: BlockMatrix) -> None:
        self.axpby(alpha, x, 1.0)

    def add(self, other: BlockMatrix, alpha: complex = 1.0, beta: complex = 1.0) -> BlockMatrix:
        """alpha times itself + beta other."""
        out = self.duplicate()
        out.axpby(beta, other, alpha)
        return out

    def __add__(self, other: BlockMatrix) -> BlockMatrix:
        return self.add(other)

    def __sub__(self, other: BlockMatrix) -> BlockMatrix:
        return self.add(other, 1.0, -1.0)

    def __iadd__(self, other: BlockMatrix) -> BlockMatrix:
        self.axpby(1.0, other, 1.0)
        return self

    def __isub__(self, other: BlockMatrix) -> BlockMatrix:
        self.axpby(-1.0, other, 1.0)
        return self

    def __mul__(self, alpha: complex) -> BlockMatrix:
        if not isinstance(alpha, Number):
            raise TypeError("only numbers multiply element-wise; use @")
        out = self.duplicate()
        out.scale(alpha)
        return out

    __rmul__ = __mul__

    def __imul__(self, alpha: complex) -> BlockMatrix:
        self.scale(alpha)
        return self

    def __truediv__(self, alpha: complex) -> BlockMatrix:
        return self * (1 / alpha)

    def __neg__(self) -> BlockMatrix:
        return self * -1.0

    def dot(self, other):
        """A product with a matrix, vector, multivector or array."""
        return self.spmm(other) if isinstance(other, BlockMatrix) else self.mult(other)

    __matmul__ = dot

    # -- parts --------------------------------------------------------------------------------------------
    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"old": np.asarray(ids, np.int64), "new": np.arange(len(ids))}))

    def extract_submatrix(self, ids: Sequence[int]) -> BlockMatrix:
        """Rows and columns of ``ids``, renumbered in that order."""
        which = self._ids(ids)
        dims = self.graph.dims.join(which, F.col("b") == F.col("old")).select(F.col("new").alias("b"), "n")
        df = ew.extract(self.df, which)
        return BlockMatrix(BlockGraph(dims, df.select("bi", "bj")), df)

    def extract_submatrix_batched(self, batches: DataFrame) -> DataFrame:
        """Entries with ``batch`` of many submatrices at once, by (batch, old, new)."""
        return ew.extract_batched(self.df, batches)

    def insert_submatrix(self, sub: BlockMatrix, ids: Sequence[int]) -> None:
        """Blocks of ``sub`` replace those of ``ids``; blocks outside the pattern are left out."""
        self.df = ew.insert(self.df, sub.df, self._ids(ids))

    def redistribute(self, graph: BlockGraph, mode: AssemblyMode = AssemblyMode.INSERT) -> BlockMatrix:
        """The stored blocks that ``graph`` has, on it; blocks that only it has are zeros; with ADD, equal places are summed."""
        return BlockMatrix(graph, ew.redistribute(self.df, graph.places(), mode.value))

    def redistribute_cross(self, graph: BlockGraph, copies: Sequence[BlockMatrix] = (), op: str = "Copy") -> BlockMatrix:
        """On ``graph``: a copy, or the sum over this and other copies."""
        df = self.df
        for x in copies if op == "Sum" else ():
            df = df.unionByName(x.df)
        return BlockMatrix(graph, ew.redistribute(df, graph.places(), "ADD" if op == "Sum" else "INSERT"))

    def spmf(self, name: str | Callable, action: Callable | None = None) -> BlockMatrix:
        """f(A) by graph-local neighbourhoods, or a dense action on them; see ``plans.iterate.graph_function``."""
        from tesserae.plans.iterate import graph_function

        return self._of(graph_function(self.df, name, action), True)

    def checkpoint(self) -> None:
        """Cut the lineage."""
        from tesserae.plans.iterate import cut

        self.df = cut(self.df)
