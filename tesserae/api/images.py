"""Image sets: one block matrix for each lattice shift of an atom graph."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.api.atoms import AtomGraph
from tesserae.api.matrix import AssemblyMode, BlockMatrix, block_rows
from tesserae.operators import atomic
from tesserae.operators import elementwise as ew
from tesserae.schema import is_complex

SHIFT = ("rx", "ry", "rz")
PLACE = (*SHIFT, "bi", "bj", "r", "c")
_MODES = {"add": AssemblyMode.ADD, "insert": AssemblyMode.INSERT, "set": AssemblyMode.INSERT}


def _shift(r: Sequence[int] | None) -> tuple[int, int, int]:
    out = (0, 0, 0) if r is None else tuple(int(x) for x in r)
    if len(out) != 3:
        raise ValueError("a shift has three numbers")
    return out


class ImageSet:
    """``df`` (rx, ry, rz, bi, bj, r, c, v[, w]) on the blocks that the atoms' edges and the diagonal at shift 0 give."""

    def __init__(self, atoms: AtomGraph, dtype: type = np.float64, df: DataFrame | None = None):
        if np.dtype(dtype) not in (np.dtype(np.float64), np.dtype(np.complex128)):
            raise ValueError("only float64 and complex128")
        self.atoms, self.spark = atoms, atoms.spark
        self._cx = np.dtype(dtype).kind == "c" if df is None else is_complex(df)
        zero = F.lit(0).cast("int")
        onsite = atoms.atoms.select(*(zero.alias(c) for c in SHIFT), F.col("gid").alias("bi"), F.col("gid").alias("bj"))
        self.pattern = atoms.edges.select(*(F.col(c).cast("int").alias(c) for c in SHIFT), F.col("src").alias("bi"), F.col("dst").alias("bj")).union(onsite).distinct()
        self.df = self._places().withColumns({c: F.lit(0.0) for c in ("v", "w")[: 1 + self._cx]}) if df is None else df
        self._pending: list[tuple] = []
        self._logs: list[DataFrame] = []

    def _places(self) -> DataFrame:
        row = self.atoms.atoms.select(F.col("gid").alias("bi"), F.col("norb").alias("_r"))
        col = self.atoms.atoms.select(F.col("gid").alias("bj"), F.col("norb").alias("_c"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        return self.pattern.join(row, "bi").join(col, "bj").withColumn("r", upto("_r")).withColumn("c", upto("_c")).select(*PLACE)

    def shifts(self) -> DataFrame:
        """The set of lattice shifts."""
        return self.pattern.select(*SHIFT).distinct()

    # -- assembly -------------------------------------------------------------------
    def add_block(self, row: int, col: int, block: np.ndarray, shift: Sequence[int] | None = None, mode: str | AssemblyMode = "add") -> None:
        """Note a block for ``assemble``."""
        self.add_blocks([row], [col], [block], [_shift(shift)], mode)

    def add_blocks(self, rows: Sequence[int], cols: Sequence[int], blocks: Sequence[np.ndarray], shifts: Sequence[Sequence[int]] | None = None, mode: str | AssemblyMode = "add") -> None:
        """Note blocks; ValueError for a mode that isn't add, insert or set, TypeError for complex blocks of a real set."""
        if isinstance(mode, str) and mode.lower() not in _MODES:
            raise ValueError(f"unknown mode {mode}")
        how = _MODES[mode.lower()] if isinstance(mode, str) else mode
        for i, j, x, r in zip(rows, cols, blocks, shifts or [None] * len(rows), strict=True):
            if np.iscomplexobj(x) and not self._cx:
                raise TypeError("a complex block for real images")
            self._pending.append((*_shift(r), int(i), int(j), np.atleast_2d(np.asarray(x)), how))

    def add_log(self, log: DataFrame) -> None:
        """Note a whole log (seq, rx, ry, rz, bi, bj, r, c, v[, w], mode) after what was noted before."""
        self._flush()
        self._logs.append(log)

    def _flush(self) -> None:
        if self._pending:
            self._logs.append(block_rows(self.spark, self._pending, (*SHIFT, "bi", "bj"), self._cx))
            self._pending = []

    def assemble(self) -> None:
        """Replay what was noted; ValueError for a shift that no edge has; blocks outside a shift's pattern are left out."""
        self._flush()
        values = ["v", "w"] if self._cx else ["v"]
        for log in self._logs:
            lost = log.select(*(F.col(c).cast("int").alias(c) for c in SHIFT)).distinct().join(self.shifts(), list(SHIFT), "left_anti").first()
            if lost is not None:
                raise ValueError(f"no edge has shift {tuple(lost)}")
            stored = self.df.select(F.lit(-1).cast("long").alias("seq"), *PLACE, *values, F.lit("ADD").alias("mode"))
            log = log.select(F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("int").alias(c) for c in SHIFT), *stored.columns[4:])
            self.df = ew.assemble(stored.unionByName(log), self.pattern, (*SHIFT, "bi", "bj"))
        self._logs = []

    def get_block(self, row: int, col: int, shift: Sequence[int] | None = None) -> np.ndarray | None:
        """A block of one shift, None if it isn't stored."""
        at = _shift(shift)
        t = self.df.where((F.col("rx") == at[0]) & (F.col("ry") == at[1]) & (F.col("rz") == at[2]) & (F.col("bi") == row) & (F.col("bj") == col)).toArrow()
        if not t.num_rows:
            return None
        r, c, v = (t.column(x).to_numpy() for x in ("r", "c", "v"))
        out = np.zeros((r.max() + 1, c.max() + 1), complex if self._cx else float)
        out[r, c] = v + 1j * t.column("w").to_numpy() if self._cx else v
        return out

    # -- sums over images --------------------------------------------------------------
    def accumulate_weighted_images(self, image_weight: tuple[Column, Column], block_weight: tuple[Column, Column] | None = None) -> DataFrame:
        """Complex sums over shifts with weights (re, im) of (rx, ry, rz) and of (bi, bj); see ``operators.atomic.weighted_images``."""
        return atomic.weighted_images(self.df, image_weight, block_weight)

    def sample_k(self, k: Sequence[float], convention: str = "R", symm: bool = False) -> BlockMatrix:
        """The complex matrix at fractional k; convention "R" or "R+tau"; (A + A^H) / 2 if ``symm``."""
        k = tuple(float(x) for x in np.asarray(k, float).ravel())
        if len(k) != 3:
            raise ValueError("k has three numbers")
        if convention not in ("R", "R+tau"):
            raise ValueError(f"unknown convention {convention}")
        df = atomic.sample_k(self.df, k, symm, (self.atoms.atoms, self.atoms.cell) if convention == "R+tau" else None)
        return BlockMatrix(self.atoms.graph, df)

    def axpy_into(self, other: ImageSet, alpha: float) -> None:
        """Adds alpha times another set, all of whose blocks this one has; else ValueError."""
        keys = [*SHIFT, "bi", "bj"]
        if not other.pattern.join(self.pattern, keys, "left_anti").isEmpty():
            raise ValueError("the other set has blocks that this one hasn't")
        values = ["v", "w"] if self._cx else ["v"]
        scaled = other.df.select(*PLACE, *((F.col(c) * F.lit(float(alpha))).alias(c) if c in other.df.columns else F.lit(0.0).alias(c) for c in values))
        self.df = self.df.select(*PLACE, *values).unionByName(scaled).groupBy(*PLACE).agg(*(F.sum(c).alias(c) for c in values))

    def redistribute_into(self, target: ImageSet, op: str = "Copy", others: Sequence[ImageSet] = ()) -> None:
        """Give a set on the same geometry this one's blocks, or the sum over this and others; ValueError for shifts that it hasn't."""
        if op not in ("Copy", "Sum"):
            raise ValueError(f"unknown operation {op}")
        if not self.shifts().join(target.shifts(), list(SHIFT), "left_anti").isEmpty():
            raise ValueError("the target has no image for a shift")
        df = self.df
        for x in others if op == "Sum" else ():
            df = df.unionByName(x.df)
        target.df = ew.redistribute(df, target._places(), "ADD" if op == "Sum" else "INSERT")
