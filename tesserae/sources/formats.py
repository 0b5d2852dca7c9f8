"""Readers and writers: Matrix Market lines, CSR arrays, POSCAR and extended XYZ structures."""

from __future__ import annotations

from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
NUMBER = {s.lower(): i + 1 for i, s in enumerate(SYMBOLS)}


def atomic_number(symbol: str) -> int:
    """Number of an element's symbol, whatever its case and surrounding blanks."""
    return NUMBER[symbol.strip().lower()]


def matrix_market(entries: DataFrame, n: int) -> DataFrame:
    """Lines (place, line) of a general coordinate file of entries (i, j, v[, w]), 1-based; every stored scalar counts."""
    has_w = "w" in entries.columns
    nnz = entries.agg(F.count(F.lit(1)).alias("n"))
    kind = "complex" if has_w else "real"
    head = nnz.select(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.format_string(f"%%%%MatrixMarket matrix coordinate {kind} general\n{n} {n} %d", "n").alias("line"))
    values = [F.col("v"), F.col("w")] if has_w else [F.col("v")]
    body = entries.select("i", "j", F.format_string("%d %d" + " %.16e" * len(values), F.col("i") + 1, F.col("j") + 1, *values).alias("line"))
    return head.unionByName(body)


def write_matrix_market(entries: DataFrame, n: int, path: str) -> None:
    """Text files in the folder ``path`` that, in the order of their names, are one Matrix Market file: the head, then entries by row and column."""
    matrix_market(entries, n).orderBy("i", "j").select("line").write.mode("overwrite").text(path)


def from_csr(spark: SparkSession, ptr: np.ndarray, col: np.ndarray, data: np.ndarray) -> DataFrame:
    """Entries of CSR arrays of scalars, or of blocks (n, s, t); the arrays must fit together."""
    ptr, col, x = np.asarray(ptr, np.int64), np.asarray(col, np.int64), np.asarray(data)
    if ptr[0] != 0 or (np.diff(ptr) < 0).any() or ptr[-1] != len(col) or len(col) != len(x):
        raise ValueError("row pointers, columns and data don't fit together")
    x = x.reshape(len(x), 1, 1) if x.ndim == 1 else x
    h, w = x.shape[1:]
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    r, c = np.divmod(np.arange(h * w, dtype=np.int32), w) if h * w else (np.empty(0, np.int32),) * 2
    cols = {"bi": np.repeat(rows, h * w), "bj": np.repeat(col, h * w), "r": np.tile(r, len(x)).astype(np.int32), "c": np.tile(c, len(x)).astype(np.int32), "v": np.ascontiguousarray(x.real, np.float64).ravel()}
    if np.iscomplexobj(x):
        cols["w"] = np.ascontiguousarray(x.imag, np.float64).ravel()
    return spark.createDataFrame(pa.table(cols))


def to_dense(entries: DataFrame, n: int, limit: int = 4096) -> np.ndarray:
    """A small matrix (i, j, v[, w]) as an array; larger ones than ``limit`` are refused."""
    if n > limit:
        raise ValueError(f"{n} rows are more than {limit}")
    got = entries.toArrow()
    cx = "w" in entries.columns
    out = np.zeros((n, n), complex if cx else float)
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    np.add.at(out, (i, j), v + 1j * got.column("w").to_numpy() if cx else v)
    return out


def read_structure(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]], bool]:
    """Atoms (gid, z, x, y, zc), cell and whether it is periodic, by the file's name."""
    name = PurePosixPath(path).name.lower()
    text = [r.value for r in spark.read.text(path, wholetext=True).collect()][0]  # one structure file
    if name.endswith(".vasp") or "poscar" in name:
        return parse_poscar(spark, text)
    if name.endswith(".xyz"):
        return parse_xyz(spark, text)
    raise ValueError(f"no reader for {path}")


_ATOM = "gid long, z int, x double, y double, zc double"


def parse_poscar(spark: SparkSession, text: str) -> tuple[DataFrame, list[list[float]], bool]:
    """VASP 4 (dummy numbers 1, 2, ...) or 5; the scale multiplies the cell and Cartesian positions."""
    ls = [x.split() for x in text.splitlines()]
    factor = float(ls[1][0])
    cell = [[factor * float(x) for x in ls[i][:3]] for i in (2, 3, 4)]
    named = not ls[5][0].lstrip("+-").isdigit()
    numbers = [atomic_number(s) for s in ls[5]] if named else list(range(1, len(ls[5]) + 1))
    counts = [int(x) for x in ls[6 if named else 5]]
    at = 7 if named else 6
    direct = ls[at][0][0] in "dD"
    out = []
    kinds = [z for z, n in zip(numbers, counts, strict=True) for _ in range(n)]
    for gid, (z, row) in enumerate(zip(kinds, ls[at + 1 :], strict=False)):
        p = np.array([float(x) for x in row[:3]])
        out.append((gid, z, *map(float, p @ np.array(cell) if direct else p * factor)))
    return spark.createDataFrame(out, _ATOM), cell, True


def parse_xyz(spark: SparkSession, text: str) -> tuple[DataFrame, list[list[float]], bool]:
    """XYZ; Lattice="..." in the comment makes it periodic; short lines are skipped."""
    ls = text.splitlines()
    cell, periodic = [[0.0] * 3 for _ in range(3)], False
    if 'Lattice="' in ls[1]:
        n = [float(x) for x in ls[1].split('Lattice="')[1].split('"')[0].split()]
        cell, periodic = [n[0:3], n[3:6], n[6:9]], True
    rows = [x.split() for x in ls[2 : 2 + int(ls[0])]]
    rows = [x for x in rows if len(x) >= 4]
    return spark.createDataFrame([(i, atomic_number(x[0]), *map(float, x[1:4])) for i, x in enumerate(rows)], _ATOM), cell, periodic


def supercell(atoms: DataFrame, cell: list[list[float]], factors: tuple[int, int, int]) -> tuple[DataFrame, list[list[float]]]:
    """Atoms of n1 x n2 x n3 cells, image by image."""
    if min(factors) < 1:
        raise ValueError("factors must be positive")
    steps = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in factors]
    out = atoms
    for name, s in zip(("a1", "a2", "a3"), steps, strict=True):
        out = out.withColumn(name, s)
    moved = [F.col(x) + sum(F.col(f"a{k + 1}") * cell[k][d] for k in range(3)) for d, x in enumerate(("x", "y", "zc"))]
    n = atoms.count()
    gid = ((F.col("a1") * factors[1] + F.col("a2")) * factors[2] + F.col("a3")) * n + F.col("gid")
    return out.select(gid.alias("gid"), "z", *(m.alias(x) for m, x in zip(moved, ("x", "y", "zc"), strict=True))), [[factors[k] * v for v in cell[k]] for k in range(3)]


def volume(cell: list[list[float]], axis: int | None = None) -> float:
    """|det| of the cell, or the area of the face across ``axis``."""
    c = np.array(cell, float)
    if axis is None:
        return float(abs(np.linalg.det(c)))
    if axis not in (0, 1, 2):
        raise ValueError("axis must be 0, 1 or 2")
    return float(np.linalg.norm(np.cross(c[(axis + 1) % 3], c[(axis + 2) % 3])))
