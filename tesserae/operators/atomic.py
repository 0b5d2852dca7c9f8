"""Neighbour lists, edges, three-body graphs and Bloch sums.

A neighbour list is a range join: atoms are put into cubes of the cutoff's
size, each image is offered to the 27 cubes around its own, and the join is on
the cube with the distance as a residual test. On periodic axes atoms are first
moved into the cell, then only those images are made that lie within the cutoff
of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.elementwise import scale, transpose
from tesserae.schema import Cx


XYZ = ("x", "y", "zc")
SHIFT = ("rx", "ry", "rz")


def axes(pbc: bool | Sequence[bool]) -> tuple[bool, bool, bool]:
    """One flag for each axis."""
    out = (bool(pbc),) * 3 if np.isscalar(pbc) else tuple(bool(x) for x in pbc)
    if len(out) != 3:
        raise ValueError("pbc has one or three values")
    return out


def _inverse(cell: Sequence[Sequence[float]]) -> np.ndarray:
    c = np.asarray(cell, float).reshape(3, 3)
    if abs(np.linalg.det(c)) < 1e-12:
        raise ValueError("degenerate cell")
    return np.linalg.inv(c)


def fractional(cell: Sequence[Sequence[float]], xyz: Sequence[Column | str] = XYZ) -> list[Column]:
    """Coordinates in units of the cell's vectors."""
    inverse = _inverse(cell)
    return [sum((F.col(x) if isinstance(x, str) else x) * float(inverse[k, d]) for k, x in enumerate(xyz)) for d in range(3)]


def cartesian(cell: Sequence[Sequence[float]], parts: Sequence[Column | str]) -> list[Column]:
    """The inverse of ``fractional``."""
    c = np.asarray(cell, float).reshape(3, 3)
    return [sum((F.col(x) if isinstance(x, str) else x) * float(c[k, d]) for k, x in enumerate(parts)) for d in range(3)]


def _images(atoms: DataFrame, cutoff: float, cell: Sequence[Sequence[float]], periodic: tuple[bool, bool, bool]) -> tuple[DataFrame, DataFrame]:
    """Atoms moved into the cell (with the cells wx, wy, wz that they moved by), and their images (mx, my, mz) within the cutoff of it."""
    inverse = _inverse(cell)
    x = atoms.select("gid", *XYZ)
    for d, (f, on) in enumerate(zip(fractional(cell), periodic, strict=True)):
        x = x.withColumn(f"f{d}", f).withColumn(f"w{d}", (F.floor(F.col(f"f{d}")) if on else F.lit(0)).cast("int"))
    x = x.withColumns({n: F.col(n) - m for n, m in zip(XYZ, cartesian(cell, ["w0", "w1", "w2"]), strict=True)})
    y = x
    for d, on in enumerate(periodic):
        reach = cutoff * float(np.linalg.norm(inverse[:, d])) + 1e-9
        n = math.ceil(reach)
        y = y.withColumn(f"m{d}", F.explode(F.sequence(F.lit(-n), F.lit(n))) if on else F.lit(0))
        if on:
            at = F.col(f"f{d}") - F.col(f"w{d}") + F.col(f"m{d}")
            y = y.where((at >= -reach) & (at <= 1 + reach))
    y = y.withColumns({n: F.col(n) + m for n, m in zip(XYZ, cartesian(cell, ["m0", "m1", "m2"]), strict=True)})
    return x, y


def neighbours(atoms: DataFrame, cutoff: float, cell: Sequence[Sequence[float]] | None = None, pbc: bool | Sequence[bool] = True, places: bool = False) -> DataFrame:
    """src, dst, rx, ry, rz, d2 of all directed pairs with d2 < cutoff^2; images on the periodic axes if there is a cell.

    Shifts count from the atoms' positions as given. Only an atom with itself at
    shift 0 is left out. With ``places``, also both atoms' fractional coordinates
    (_p0, ..., _q0, ...) and the cube of src (_i, _j, _k), by which the rows are
    dealt: what is summed by src within its cube needs no shuffle.
    """
    periodic = axes(pbc) if cell is not None else (False,) * 3
    if any(periodic):
        x, y = _images(atoms, cutoff, cell, periodic)
        a = x.select(F.col("gid").alias("src"), *XYZ, *(F.col(f"w{d}").alias(f"v{d}") for d in range(3)))
        b = y.select(F.col("gid").alias("dst"), *(F.col(n).alias(f"{n}2") for n in XYZ), *((F.col(f"m{d}") - F.col(f"w{d}")).alias(f"s{d}") for d in range(3)))
    else:
        a = atoms.select(F.col("gid").alias("src"), *XYZ, *(F.lit(0).alias(f"v{d}") for d in range(3)))
        b = atoms.select(F.col("gid").alias("dst"), *(F.col(n).alias(f"{n}2") for n in XYZ), *(F.lit(0).alias(f"s{d}") for d in range(3)))
    if places:
        with_f = lambda d, g, p, base: d.join(base.select(F.col("gid").alias(g), *(f.alias(f"{p}{k}") for k, f in enumerate(fractional(cell)))), g)
        a, b = with_f(a, "src", "_p", atoms), with_f(b, "dst", "_q", atoms)
    cube = lambda n: F.floor(F.col(n) / cutoff)
    for name, n in zip("ijk", XYZ, strict=True):
        b = b.withColumn(name, F.explode(F.array(*(cube(f"{n}2") + k for k in (-1, 0, 1)))))
    a = a.withColumns({name: cube(n) for name, n in zip("ijk", XYZ, strict=True)})
    out = (a.hint("merge") if places else a).join(b, ["i", "j", "k"]).withColumn("d2", sum((F.col(f"{n}2") - F.col(n)) * (F.col(f"{n}2") - F.col(n)) for n in XYZ))
    out = out.withColumns({r: (F.col(f"s{d}") + F.col(f"v{d}")).cast("int") for d, r in enumerate(SHIFT)})
    itself = (F.col("src") == F.col("dst")) & (F.col("rx") == 0) & (F.col("ry") == 0) & (F.col("rz") == 0)
    more = [*(f"{p}{k}" for p in ("_p", "_q") for k in range(3)), *(F.col(n).alias(f"_{n}") for n in "ijk")] if places else []
    return out.where((F.col("d2") < cutoff * cutoff) & ~itself).select("src", "dst", *SHIFT, "d2", *more)


def edge_vectors(atoms: DataFrame, e: DataFrame, cell: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Edges with dx, dy, dz: r_dst + R cell - r_src."""
    at = lambda name: atoms.select(F.col("gid").alias(name), *(F.col(n).alias(f"{name}_{n}") for n in XYZ))
    moved = cartesian(cell, SHIFT) if cell is not None else [F.lit(0.0)] * 3
    x = e.join(at("src"), "src").join(at("dst"), "dst")
    return x.select(*e.columns, *((F.col(f"dst_{n}") - F.col(f"src_{n}") + m).alias(d) for n, m, d in zip(XYZ, moved, ("dx", "dy", "dz"), strict=True)))


def within(atoms: DataFrame, e: DataFrame, cell: Sequence[Sequence[float]] | None, left: Sequence[float], right: Sequence[float]) -> DataFrame:
    """Edges no longer than left[type of src] + right[type of dst] + 1e-9."""
    kind = lambda name: atoms.select(F.col("gid").alias(name), F.col("type").alias(f"{name}_t"))
    of = lambda r, t: F.coalesce(F.get(F.array(*(F.lit(float(v)) for v in r)), F.col(t)), F.lit(float(r[-1])))
    x = edge_vectors(atoms, e, cell).join(kind("src"), "src").join(kind("dst"), "dst")
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return x.where(d <= of(left, "src_t") + of(right, "dst_t") + 1e-9).select(*e.columns)


def edges(atoms: DataFrame, radius: list[float], cell: Sequence[Sequence[float]] | None = None, pbc: bool | Sequence[bool] = True) -> DataFrame:
    """Directed edges with distance <= r_i + r_j + 1e-9; ``type`` picks the radius, short lists go on with their last."""
    near = neighbours(atoms, 2 * max(radius), cell, pbc)
    r = F.array(*map(F.lit, radius))
    of = lambda t: F.coalesce(F.get(r, F.col(t)), F.lit(radius[-1]))
    types = atoms.select(F.col("gid"), F.col("type"))
    x = near.join(types.select(F.col("gid").alias("src"), F.col("type").alias("t1")), "src").join(types.select(F.col("gid").alias("dst"), F.col("type").alias("t2")), "dst")
    return x.where(F.sqrt("d2") <= of("t1") + of("t2") + 1e-9).select("src", "dst", "rx", "ry", "rz")


def graph3b(e: DataFrame, two_body: DataFrame | None = None) -> DataFrame:
    """Pairs (j, k) with a common centre and their shift, with the two-body edges (``e`` unless given), without a site to itself at shift 0."""
    a = e.select("src", F.col("dst").alias("j"), *[F.col(c).alias(f"{c}1") for c in SHIFT])
    b = e.select("src", F.col("dst").alias("k"), *[F.col(c).alias(f"{c}2") for c in SHIFT])
    pairs = a.join(b, "src").select(F.col("j").alias("src"), F.col("k").alias("dst"), *((F.col(f"{c}2") - F.col(f"{c}1")).alias(c) for c in SHIFT))
    onsite = (F.col("src") == F.col("dst")) & (F.col("rx") == 0) & (F.col("ry") == 0) & (F.col("rz") == 0)
    return pairs.union((e if two_body is None else two_body).select(pairs.columns)).where(~onsite).distinct()


def weighted_images(images: DataFrame, image_weight: tuple[Column, Column], block_weight: tuple[Column, Column] | None = None) -> DataFrame:
    """Complex sums over shifts of A(R) with weights (re, im): of the shift, and of the block beside.

    Images, and blocks, whose weight is 1e-12 or less in size add nothing, but their places stay.
    Where images tell the cube of their row's atom (``neighbours`` with ``places``), sums stay in it.
    """
    w = Cx(*image_weight)
    use = F.sqrt(w.abs2()) > 1e-12
    if block_weight is not None:
        w = w * Cx(*block_weight)
        use = use & (F.sqrt(w.abs2()) > 1e-12)
    x = Cx(F.col("v"), F.col("w") if "w" in images.columns else None) * w
    some = Cx(F.when(use, x.re).otherwise(0.0), F.when(use, x.im).otherwise(0.0))
    cube = [c for c in ("_i", "_j", "_k") if c in images.columns]
    return images.groupBy(*cube, "bi", "bj", "r", "c").agg(*some.sums()).drop(*cube)


def _phase(k: Sequence[float], parts: Sequence[Column | str]) -> tuple[Column, Column]:
    angle = -2 * math.pi * sum((F.col(x) if isinstance(x, str) else x) * float(q) for q, x in zip(k, parts, strict=True))
    return F.cos(angle), F.sin(angle)


def sample_k(images: DataFrame, k: Sequence[float], symmetric: bool = False, tau: tuple[DataFrame, Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """A(k) = sum over R of A(R) exp(-2 pi i k R), complex, on the union of patterns; (A + A^H) / 2 if ``symmetric``.

    With ``tau`` (atoms and cell) a block's phase counts from its atoms' places: R + r_j - r_i in units of the cell.
    """
    block = None
    if tau is not None:
        at = lambda side, p: tau[0].select(F.col("gid").alias(side), *(f.alias(f"{p}{d}") for d, f in enumerate(fractional(tau[1]))))
        if "_p0" not in images.columns:
            images = images.join(at("bi", "_p"), "bi").join(at("bj", "_q"), "bj")
        block = _phase(k, [F.col(f"_q{d}") - F.col(f"_p{d}") for d in range(3)])
    out = weighted_images(images, _phase(k, SHIFT), block)
    if symmetric:
        half = scale(out, 0.5)
        out = half.unionByName(transpose(half)).groupBy("bi", "bj", "r", "c").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    return out
