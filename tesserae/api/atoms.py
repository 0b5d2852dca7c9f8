"""Atoms with their cell and directed edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.api.graph import BlockGraph
from tesserae.operators import atomic
from tesserae.sources import formats


def by_type(param: float | Mapping | Sequence, numbers: np.ndarray, name: str) -> list:
    """One value for each of the sorted unique atomic numbers: a scalar, a mapping by number or symbol with "default", or a list."""
    if np.isscalar(param):
        return [param] * len(numbers)
    if isinstance(param, Mapping):
        out = []
        for z in numbers.tolist():
            symbol = formats.SYMBOLS[z - 1] if 0 < z <= len(formats.SYMBOLS) else None
            got = next((param[k] for k in (z, symbol, "default") if k in param), None)
            if got is None:
                raise ValueError(f"{name} missing for atomic number {z}")
            out.append(got)
        return out
    values = list(param)
    if len(values) == 1:
        return values * len(numbers)
    if len(values) != len(numbers):
        raise ValueError(f"{name} has {len(values)} values for {len(numbers)} types")
    return values


class AtomGraph:
    """``atoms`` (gid, input_index, z, type, norb, x, y, zc), ``edges`` (src, dst, rx, ry, rz), cell and periodic axes."""

    def __init__(self, atoms: DataFrame, edges: DataFrame, cell: Sequence[Sequence[float]], pbc: Sequence[bool]):
        self.spark, self.atoms, self.edges = atoms.sparkSession, atoms, edges
        self._cell, self._pbc = np.asarray(cell, float).reshape(3, 3), atomic.axes(pbc)

    # -- constructors --------------------------------------------------------------
    @classmethod
    def from_frame(cls, points: DataFrame, cell, pbc, r_max, type_norb=1) -> AtomGraph:
        """From points (gid, z, x, y, zc[, input_index]); types are ranks of the unique numbers, edges reach r_i + r_j."""
        numbers = np.array(sorted(r["z"] for r in points.select("z").distinct().collect()), np.int64)  # elements: a hundred or so
        radius, norb = by_type(r_max, numbers, "r_max"), by_type(type_norb, numbers, "type_norb")
        rank = F.array_position(F.array(*(F.lit(int(z)) for z in numbers)), F.col("z").cast("int")) - 1 if len(numbers) else F.lit(0)
        of = lambda values: F.get(F.array(*map(F.lit, values)) if values else F.array(F.lit(0)), F.col("type"))
        index = F.col("input_index") if "input_index" in points.columns else F.col("gid")
        atoms = points.select("gid", index.alias("input_index"), "z", rank.cast("int").alias("type"), "x", "y", "zc").withColumn("norb", of([int(n) for n in norb]))
        edges = atomic.edges(atoms, [float(r) for r in radius] or [0.0], cell if any(atomic.axes(pbc)) else None, pbc)
        return cls(atoms, edges, cell, pbc)

    @classmethod
    def from_points(cls, spark: SparkSession, pos, z, cell, pbc, r_max, type_norb=1) -> AtomGraph:
        """From arrays; ValueError unless positions and numbers agree."""
        x, n = np.asarray(pos, float).reshape(-1, 3), np.asarray(z, np.int64).reshape(-1)
        if len(x) != len(n):
            raise ValueError("pos and z must describe the same number of atoms")
        points = pa.table({"gid": np.arange(len(n)), "z": n.astype(np.int32), "x": x[:, 0].copy(), "y": x[:, 1].copy(), "zc": x[:, 2].copy()})
        return cls.from_frame(spark.createDataFrame(points), cell, pbc, r_max, type_norb)

    @classmethod
    def from_distributed(cls, points: DataFrame, cell, pbc, r_max, type_norb=1) -> AtomGraph:
        """From points (part, pos, z, x, y, zc[, input_index]) dealt by a caller; ids ascend by (part, pos) without gaps."""
        counts = points.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a part
        first = np.concatenate([[0], np.cumsum([r["n"] for r in counts])]).tolist()
        base = F.element_at(F.create_map(*(F.lit(v) for r, f in zip(counts, first, strict=False) for v in (r["part"], f))), F.col("part")) if counts else F.lit(0)
        place = F.row_number().over(_by_part()) - 1
        x = points.withColumn("_p", place).withColumn("gid", (base + F.col("_p")).cast("long"))
        index = F.col("input_index") if "input_index" in points.columns else F.col("gid")
        return cls.from_frame(x.select("gid", index.alias("input_index"), "z", "x", "y", "zc"), cell, pbc, r_max, type_norb)

    @classmethod
    def from_graph_arrays(cls, spark: SparkSession, pos, z, cell, pbc, edge_index, edge_shift, type_norb=1) -> AtomGraph:
        """From a graph made elsewhere: edge_index (e, 2), edge_shift (e, 3); ValueError if shapes or ids don't fit."""
        x, n = np.asarray(pos, float).reshape(-1, 3), np.asarray(z, np.int64).reshape(-1)
        e, s = np.asarray(edge_index, np.int64).reshape(-1, 2), np.asarray(edge_shift, np.int64).reshape(-1, 3)
        if len(x) != len(n) or len(e) != len(s) or (len(e) and (e.min() < 0 or e.max() >= len(n))):
            raise ValueError("atoms, edges and shifts don't fit together")
        numbers = np.unique(n)
        norb = np.array(by_type(type_norb, numbers, "type_norb"), np.int64)
        kind = np.searchsorted(numbers, n)
        atoms = pa.table({"gid": np.arange(len(n)), "input_index": np.arange(len(n)), "z": n.astype(np.int32), "type": kind.astype(np.int32), "x": x[:, 0].copy(), "y": x[:, 1].copy(), "zc": x[:, 2].copy(), "norb": norb[kind].astype(np.int32)})
        edges = pa.table({"src": e[:, 0].copy(), "dst": e[:, 1].copy()} | {c: s[:, i].astype(np.int32) for i, c in enumerate(("rx", "ry", "rz"))})
        return cls(spark.createDataFrame(atoms), spark.createDataFrame(edges), cell, pbc)

    @classmethod
    def from_ase(cls, spark: SparkSession, atoms, r_max, type_norb=1) -> AtomGraph:
        """From an object with get_positions, get_atomic_numbers, get_cell and get_pbc."""
        return cls.from_points(spark, atoms.get_positions(), atoms.get_atomic_numbers(), np.asarray(atoms.get_cell()), atoms.get_pbc(), r_max, type_norb)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, r_max, type_norb=1) -> AtomGraph:
        """From a POSCAR or XYZ file."""
        points, cell, periodic = formats.read_structure(spark, path)
        return cls.from_frame(points, cell, periodic, r_max, type_norb)

    def to_ase(self):
        """An ``ase.Atoms``; ImportError where that library is missing."""
        from ase import Atoms

        return Atoms(numbers=self.atomic_numbers, positions=self.positions, cell=self.cell, pbc=self.pbc)

    # -- attributes ------------------------------------------------------------------------
    @cached_property
    def _table(self) -> pa.Table:
        return self.atoms.orderBy("gid").toArrow()

    def _column(self, name: str) -> np.ndarray:
        return self._table.column(name).to_numpy()

    @property
    def positions(self) -> np.ndarray:
        return np.stack([self._column(c) for c in ("x", "y", "zc")], 1)

    pos = positions
    atom_indices = indices = property(lambda self: self._column("input_index"))
    atom_types = property(lambda self: self._column("type"))
    n_atom = property(lambda self: self._table.num_rows)
    cell = property(lambda self: self._cell)
    pbc = property(lambda self: list(self._pbc))

    @property
    def atomic_numbers(self) -> np.ndarray:
        """RuntimeError where numbers are unknown."""
        if self._table.column("z").null_count:
            raise RuntimeError("atomic numbers are unknown")
        return self._column("z")

    z = atomic_numbers

    @cached_property
    def _edges(self) -> pa.Table:
        v = atomic.edge_vectors(self.atoms, self.edges, self._cell)
        return v.orderBy("src", "dst", "rx", "ry", "rz").toArrow()

    @property
    def edge_index(self) -> np.ndarray:
        return np.stack([self._edges.column(c).to_numpy() for c in ("src", "dst")], 1)

    @property
    def edge_shift(self) -> np.ndarray:
        return np.stack([self._edges.column(c).to_numpy() for c in ("rx", "ry", "rz")], 1)

    @property
    def edge_vectors(self) -> np.ndarray:
        """r_j + R cell - r_i."""
        return np.stack([self._edges.column(c).to_numpy() for c in ("dx", "dy", "dz")], 1)

    def norb(self) -> int:
        """Orbitals of all atoms."""
        return int(self.atoms.agg(F.coalesce(F.sum("norb"), F.lit(0))).first()[0])

    def get_atom_norb(self, gid: int) -> int:
        return int(self._column("norb")[np.searchsorted(self._column("gid"), gid)])

    def volume(self, axis: int | None = None) -> float:
        return formats.volume(self._cell.tolist(), axis)

    @cached_property
    def graph(self) -> BlockGraph:
        """Blocks of orbitals: edges of any shift, and the diagonal."""
        onsite = self.atoms.select(F.col("gid").alias("bi"), F.col("gid").alias("bj"))
        return BlockGraph(self.atoms.select(F.col("gid").alias("b"), F.col("norb").alias("n")), self.edges.select(F.col("src").alias("bi"), F.col("dst").alias("bj")).union(onsite))

    # -- three-body graphs ---------------------------------------------------------------------
    def _near(self, left: Sequence[float], right: Sequence[float]) -> DataFrame:
        return atomic.within(self.atoms, self.edges, self._cell, left, right)

    def get_graph3b(self, left: Sequence[float], right: Sequence[float]) -> BlockGraph:
        """Pairs of neighbours of a common centre within left[type of centre] + right[type of neighbour], with the two-body edges and the diagonal."""
        e = atomic.graph3b(self._near(left, right), self.edges)
        onsite = self.atoms.select(F.col("gid").alias("bi"), F.col("gid").alias("bj"))
        return BlockGraph(self.graph.dims, e.select(F.col("src").alias("bi"), F.col("dst").alias("bj")).union(onsite))

    def get_atomicdata3b(self, left: Sequence[float], right: Sequence[float]) -> AtomGraph:
        """The same pairs with their shifts, as atoms with edges."""
        return AtomGraph(self.atoms, atomic.graph3b(self._near(left, right), self.edges), self._cell, self._pbc)


def _by_part():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("pos")
