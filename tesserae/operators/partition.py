"""Spatial partitions: Morton order, recursive inertial bisection, and classes of points by its planes.

They only say where rows go; results of other operators don't depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "zc")
BITS = 21


def _spread(x: Column) -> Column:
    """Bits of a 21-bit number, two zeros after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(points: DataFrame, low: tuple[float, float, float] | None = None, high: tuple[float, float, float] | None = None) -> DataFrame:
    """``points`` (x, y, zc) with ``code``: 21 bits an axis, interleaved; bounds are taken from the points unless given."""
    if low is None or high is None:
        ends = points.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max))).first()  # one row
        low, high = (tuple(ends[f"{n}_{c}"] or 0.0 for c in XYZ) for n in ("min", "max"))
    code = F.lit(0).cast("long")
    for d, c in enumerate(XYZ):
        width = high[d] - low[d] or 1.0
        cell = F.least(F.greatest(F.floor((F.col(c) - low[d]) / width * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
        code = code.bitwiseOR(F.shiftleft(_spread(cell), d))
    return points.withColumn("code", code)


def by_morton(points: DataFrame, parts: int) -> DataFrame:
    """Partitioned into ranges of Morton codes, sorted within."""
    return morton(points).repartitionByRange(parts, "code").sortWithinPartitions("code")


@dataclass(frozen=True)
class Plane:
    """Points with normal . x <= offset go to ``left``, others to ``right``: a plane's place in the list, or -1 - part."""

    normal: tuple[float, float, float]
    offset: float
    left: int
    right: int


def inertial_bisection(points: DataFrame, parts: int, weight: str | None = None) -> list[Plane]:
    """Planes that cut the points into ``parts`` of about equal weight, each across the longest inertial axis of what it cuts.

    All cuts of a level are found together: one grouped sum of moments and one
    grouped weighted median; only a few numbers a part come to the driver.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    planes: list[Plane | None] = []
    todo = [(-1, parts, 0, None)]  # (plane to continue from, parts, first part, side)
    pending: dict[int, tuple[int, int]] = {}
    if parts > 1:
        pending[0] = (parts, 0)
        planes.append(None)
    while pending:
        ids = sorted(pending)
        x = points.withColumn("_w", w).withColumn("_at", _descend(planes)).where(F.col("_at").isin(ids))
        sums = [F.sum("_w").alias("w"), *(F.sum(F.col("_w") * F.col(c)).alias(c) for c in XYZ), *(F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(XYZ) for b in XYZ[i:])]
        moments = {r["_at"]: r for r in x.groupBy("_at").agg(*sums).collect()}
        normals = {}
        for n in ids:
            r = moments.get(n)
            if r is None or not r["w"]:
                normals[n] = (1.0, 0.0, 0.0)
                continue
            mean = np.array([r[c] for c in XYZ]) / r["w"]
            second = np.array([[r[f"{a}_{b}" if XYZ.index(a) <= XYZ.index(b) else f"{b}_{a}"] for b in XYZ] for a in XYZ]) / r["w"]
            v = np.linalg.eigh(second - np.outer(mean, mean))[1][:, -1]
            normals[n] = tuple((v if v[int(np.abs(v).argmax())] > 0 else -v).tolist())
        along, share = F.lit(0.0), F.lit(0.5)
        for n in ids:
            along = F.when(F.col("_at") == n, sum(F.col(c) * float(q) for c, q in zip(XYZ, normals[n], strict=True))).otherwise(along)
        cuts = _medians(x.withColumn("_s", along), {n: (pending[n][0] // 2) / pending[n][0] for n in ids})
        new: dict[int, tuple[int, int]] = {}
        for n in ids:
            count, first = pending[n]
            sides = []
            for size, at in ((count // 2, first), (count - count // 2, first + count // 2)):
                if size > 1:
                    planes.append(None)
                    new[len(planes) - 1] = (size, at)
                    sides.append(len(planes) - 1)
                else:
                    sides.append(-1 - at)
            planes[n] = Plane(normals[n], cuts.get(n, 0.0), *sides)
        pending = new
    return planes


def _medians(x: DataFrame, shares: dict[int, float], bins: int = 1024, rounds: int = 3) -> dict[int, float]:
    """The value of ``_s`` below which a share of the weight of each ``_at`` lies, by histograms that are refined round the bin it falls in."""
    ends = {r["_at"]: [r["lo"], r["hi"], 0.0, r["w"]] for r in x.groupBy("_at").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"), F.sum("_w").alias("w")).collect()}
    for _ in range(rounds):
        lo, hi = F.lit(0.0), F.lit(1.0)
        for n, (a, b, *_rest) in ends.items():
            lo, hi = F.when(F.col("_at") == n, a).otherwise(lo), F.when(F.col("_at") == n, b).otherwise(hi)
        inside = x.where((F.col("_s") >= lo) & (F.col("_s") <= hi))
        bin_ = F.least(F.floor((F.col("_s") - lo) / F.greatest(hi - lo, F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("int")
        counts: dict[int, np.ndarray] = {n: np.zeros(bins) for n in ends}
        for r in inside.groupBy("_at", bin_.alias("bin")).agg(F.sum("_w").alias("w")).collect():  # bins * parts rows at most
            counts[r["_at"]][r["bin"]] = r["w"]
        for n, e in ends.items():
            below = e[2] + np.cumsum(counts[n])
            at = int(np.searchsorted(below, shares[n] * e[3] - 1e-12))
            at = min(at, bins - 1)
            width = (e[1] - e[0]) / bins
            e[2] = below[at] - counts[n][at]
            e[0], e[1] = e[0] + at * width, e[0] + (at + 1) * width
    return {n: e[1] for n, e in ends.items()}


def _descend(planes: list[Plane | None]) -> Column:
    """Where each point ends: the first plane that is open (its place), or -1 - part."""

    def at(n: int) -> Column:
        if n < 0 or planes[n] is None:
            return F.lit(n)
        p = planes[n]
        side = sum(F.col(c) * float(q) for c, q in zip(XYZ, p.normal, strict=True)) <= float(p.offset)
        return F.when(side, at(p.left)).otherwise(at(p.right))

    return at(0) if planes else F.lit(-1)


def classify(points: DataFrame, planes: list[Plane]) -> DataFrame:
    """``points`` with ``part``, by the planes alone; any point has one."""
    return points.withColumn("part", (-1 - _descend(planes)).cast("int"))


def reach(points: DataFrame, planes: list[Plane], radius: float) -> DataFrame:
    """One row for each part that a ball of ``radius`` round a point may touch, with ``part``."""

    def parts(n: int) -> Column:
        if n < 0:
            return F.array(F.lit(-1 - n))
        p = planes[n]
        d = sum(F.col(c) * float(q) for c, q in zip(XYZ, p.normal, strict=True)) - float(p.offset)
        none = F.array().cast("array<int>")
        return F.concat(F.when(d <= radius, parts(p.left)).otherwise(none), F.when(d > -radius, parts(p.right)).otherwise(none))

    return points.withColumn("part", F.explode(parts(0) if planes else F.array(F.lit(0))))
