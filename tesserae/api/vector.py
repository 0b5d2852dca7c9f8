"""Vectors and multivectors aligned to a block graph."""

from __future__ import annotations

from numbers import Number

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.api.graph import BlockGraph
from tesserae.functions.spectral import random_values
from tesserae.operators.products import dot, pointwise, vector_axpby
from tesserae.schema import Cx, constant, is_complex, value


class Vector:
    """One number for each scalar row of a graph: ``df`` (b, r, v[, w])."""

    keys = ("b", "r")
    ghost_size = 0
    comm_seconds, comm_calls = 0.0, 0

    def __init__(self, graph: BlockGraph, df: DataFrame | None = None, dtype: type = np.float64):
        self.graph = graph
        self.df = self._filled(0.0, dtype) if df is None else df

    def _rows(self) -> DataFrame:
        return self.graph.rows()

    def _filled(self, x: complex, dtype: type) -> DataFrame:
        cols = Cx(F.lit(float(x.real)), F.lit(float(x.imag)) if np.dtype(dtype).kind == "c" else None).columns()
        return self._rows().select(*self.keys, *cols)

    def _with(self, df: DataFrame):
        return type(self)(self.graph, df)

    # -- extents ---------------------------------------------------------------
    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.complex128 if is_complex(self.df) else np.float64)

    @property
    def local_size(self) -> int:
        return self.graph.global_scalar_rows

    full_size = size = property(lambda self: self.local_size)

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.local_size,)

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def T(self):
        return self

    def sync_ghosts(self) -> None:
        """Nothing to do: joins move what is needed."""

    def reduce_ghosts(self) -> None:
        """Nothing to do: sums are by key already."""

    def reset_comm_stats(self) -> None:
        """Nothing is counted."""

    # -- exchange ----------------------------------------------------------------
    def _ordered(self) -> pa.Table:
        x = self.df.join(self.graph.dims.select("b", "off"), "b")
        return x.orderBy(F.col("off") + F.col("r"), *self.keys[2:]).select(*[c for c in ("v", "w") if c in self.df.columns]).toArrow()

    def to_numpy(self) -> np.ndarray:
        t = self._ordered()
        x = t.column("v").to_numpy()
        return (x + 1j * t.column("w").to_numpy() if "w" in t.column_names else x).reshape(self.shape)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        x = self.to_numpy()
        return x if dtype is None else x.astype(dtype)

    def from_numpy(self, x: np.ndarray) -> None:
        """Take the values of an array of the same shape, else ValueError."""
        x = np.asarray(x)
        if x.shape != self.shape:
            raise ValueError(f"shape {x.shape} isn't {self.shape}")
        dims = self.graph._dims
        n = dims.column("n").to_numpy()
        b = np.repeat(dims.column("b").to_numpy(), n)
        r = (np.arange(len(b)) - np.repeat(dims.column("off").to_numpy(), n)).astype(np.int32)
        wide = x.reshape(len(b), -1)
        k = wide.shape[1]
        cols = {"b": np.repeat(b, k), "r": np.repeat(r, k)} | ({"col": np.tile(np.arange(k, dtype=np.int32), len(b))} if "col" in self.keys else {})
        cols["v"] = np.ascontiguousarray(wide.real.ravel(), np.float64)
        if np.iscomplexobj(x) or is_complex(self.df):
            cols["w"] = np.ascontiguousarray(wide.imag.ravel(), np.float64)
        self.df = self.graph.spark.createDataFrame(pa.table(cols))

    # -- filling -------------------------------------------------------------------
    def set_constant(self, x: complex) -> None:
        self.df = self._filled(x, complex if isinstance(x, complex) or is_complex(self.df) else float)

    def set_random(self, seed: int = 0, normalize: bool = True, kind: str | None = None) -> None:
        """Values by (seed, block, row, column) alone: +-1, for complex vectors random phases; "gaussian" on request."""
        cx = is_complex(self.df)
        kind = kind or ("phase" if cx else "rademacher")
        col = F.col("col") if "col" in self.keys else F.lit(0)
        x = self._rows().withColumn("x", random_values(kind, seed, cx)(F.col("b"), F.col("r"), col))
        self.df = x.select(*self.keys, F.col("x.v").alias("v"), *([F.col("x.w").alias("w")] if cx else []))
        if normalize and kind != "gaussian":
            self.scale(1 / max(1, self.graph.global_scalar_rows) ** 0.5)
        elif normalize:
            n = dot(self.df, self.df)
            if "col" in self.keys:
                f = F.broadcast(n.select("col", (1 / F.sqrt("v")).alias("_f")))  # one row a column
                self.df = self.df.join(f, "col").select(*self.keys, *(Cx(F.col("_f")) * value(self.df)).columns())
            else:
                self.scale(1 / n.first()["v"] ** 0.5)

    # -- arithmetic ------------------------------------------------------------------
    def duplicate(self):
        return self._with(self.df)

    copy = duplicate

    def copy_from(self, other) -> None:
        if not self.graph.same(other.graph) or type(self) is not type(other):
            raise ValueError("structures differ")
        self.df = other.df

    def scale(self, alpha: complex) -> None:
        self.df = self.df.select(*self.keys, *(constant(alpha) * value(self.df)).columns())

    def conjugate(self) -> None:
        self.df = self.df.select(*self.keys, *value(self.df).conj().columns())

    def axpy(self, alpha: complex, x) -> None:
        """Adds alpha x."""
        self.axpby(alpha, x, 1.0)

    def axpby(self, alpha: complex, x, beta: complex) -> None:
        """Becomes alpha x + beta times itself."""
        self.df = vector_axpby(alpha, x.df, beta, self.df)

    def pointwise_mult(self, x: Vector) -> None:
        self.df = pointwise(self.df, x.df)

    def dot(self, other) -> complex:
        """sum conj(self) other."""
        x = dot(self.df, other.df).first()
        re, im = x["v"] or 0.0, (x["w"] or 0.0) if "w" in x.asDict() else None
        return re if im is None else complex(re, im)

    def checkpoint(self) -> None:
        """Cut the lineage."""
        from tesserae.plans.iterate import cut

        self.df = cut(self.df)

    def _operand(self, other):
        if isinstance(other, Vector):
            return other
        x = type(self)(self.graph, self.df)
        if isinstance(other, Number):
            x.set_constant(other)
        else:
            x.from_numpy(np.broadcast_to(np.asarray(other), self.shape))
        return x

    def _sum(self, other, alpha: complex, beta: complex):
        return self._with(vector_axpby(alpha, self.df, beta, self._operand(other).df))

    def __add__(self, other):
        return self._sum(other, 1.0, 1.0)

    def __sub__(self, other):
        return self._sum(other, 1.0, -1.0)

    def __iadd__(self, other):
        self.df = self._sum(other, 1.0, 1.0).df
        return self

    def __isub__(self, other):
        self.df = self._sum(other, 1.0, -1.0).df
        return self

    def __neg__(self):
        return self * -1.0

    def __mul__(self, other):
        out = self.duplicate()
        out.scale(other) if isinstance(other, Number) else out.pointwise_mult(self._operand(other))
        return out

    __rmul__ = __mul__

    def __imul__(self, other):
        self.df = (self * other).df
        return self

    def __truediv__(self, other: complex):
        return self * (1 / other)

    def __itruediv__(self, other: complex):
        self.scale(1 / other)
        return self

    def __matmul__(self, other):
        return self.dot(other)


class MultiVector(Vector):
    """``k`` vectors side by side: ``df`` (b, r, col, v[, w])."""

    keys = ("b", "r", "col")
    ghost_rows = 0

    def __init__(self, graph: BlockGraph, df: DataFrame | None = None, dtype: type = np.float64, k: int | None = None):
        self._k = k
        super().__init__(graph, df, dtype)

    def _rows(self) -> DataFrame:
        return self.graph.rows().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(self.num_vectors - 1))))

    def _with(self, df: DataFrame) -> MultiVector:
        return MultiVector(self.graph, df, k=self.num_vectors)

    @property
    def num_vectors(self) -> int:
        if self._k is None:
            self._k = (self.df.agg(F.max("col")).first()[0] or 0) + 1
        return self._k

    local_rows = property(lambda self: self.graph.global_scalar_rows)

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.local_rows, self.num_vectors)

    size = property(lambda self: self.local_rows * self.num_vectors)

    def _operand(self, other):
        if isinstance(other, Vector):
            return other
        x = self._with(self.df)
        if isinstance(other, Number):
            x.set_constant(other)
        else:
            x.from_numpy(np.broadcast_to(np.asarray(other), self.shape))
        return x

    def bdot(self, other: MultiVector) -> np.ndarray:
        """sum conj(self) other of each column."""
        got = dot(self.df, other.df).collect()
        out = np.zeros(self.num_vectors, complex if is_complex(self.df) or is_complex(other.df) else float)
        for x in got:
            out[x["col"]] = complex(x["v"], x["w"]) if "w" in x.asDict() else x["v"]
        return out

    dot = bdot
    pointwise_mult_vec = Vector.pointwise_mult

    def get_col(self, j: int) -> Vector:
        return Vector(self.graph, self.df.where(F.col("col") == j).drop("col"))

    def set_col(self, j: int, x: Vector) -> None:
        self.df = self.df.where(F.col("col") != j).unionByName(x.df.withColumn("col", F.lit(j)).select(self.df.columns))

    def swap(self, other: MultiVector) -> None:
        """Exchange values with another multivector of the same shape."""
        if self.shape != other.shape:
            raise ValueError("shapes differ")
        self.df, other.df = other.df, self.df

    def __radd__(self, other):
        return self + other

    def __rsub__(self, other):
        return self * -1.0 + other
