"""Generated crystals: zinc-blende nanocrystals, strained trilayers, two-centre Hamiltonian blocks, and structure files."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tesserae.sources.formats import SYMBOLS

#: The four bonds of a tetrahedral site, in quarters of the lattice constant.
BONDS = ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))


def nanocrystal(spark: SparkSession, shells: int, lattice: float = 5.8687, cation: int = 49, anion: int = 15, cap: int | None = 1, cap_bond: float = 1.7) -> DataFrame:
    """Atoms (gid, z, x, y, zc) of ``shells`` coordination shells (an even number) round a cation; dangling bonds end in ``cap``.

    Cations are the sites of a face-centred lattice at most shells / 2 steps from
    the centre, anions the neighbours of all but the outermost of them, and caps
    sit on the outermost cations' bonds that lead to no anion.
    """
    if shells < 0 or shells % 2:
        raise ValueError("shells must be even and not negative")
    k = shells // 2
    side = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    grid = spark.range(1).select(side.alias("i")).withColumn("j", side).withColumn("l", side)
    steps = F.greatest(F.abs("i"), F.abs("j"), F.abs("l"), F.floor((F.abs(F.col("i")) + F.abs(F.col("j")) + F.abs(F.col("l"))) / 2))
    # in quarters of the lattice constant, so that every site has whole coordinates
    inner = grid.where((F.col("i") + F.col("j") + F.col("l")) % 2 == 0).withColumn("s", steps).where(F.col("s") <= k).select(*((2 * F.col(c)).alias(c) for c in "ijl"), "s")
    bonds = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(b, "xyz", strict=True))) for b in BONDS)))
    ends = inner.withColumn("b", bonds).select("i", "j", "l", "s", "b", *((F.col(c) + F.col(f"b.{d}")).alias(f"e{c}") for c, d in zip("ijl", "xyz", strict=True)))
    anions = ends.where(F.col("s") < k).select("ei", "ej", "el").distinct()
    at = lambda *c: [(F.col(x) * (lattice / 4)).alias(n) for x, n in zip(c, ("x", "y", "zc"), strict=True)]
    out = inner.select(F.lit(0).alias("kind"), F.lit(cation).alias("z"), *at("i", "j", "l")).unionByName(anions.select(F.lit(1).alias("kind"), F.lit(anion).alias("z"), *at("ei", "ej", "el")))
    if cap is not None and k:
        loose = ends.where(F.col("s") == k).join(anions, ["ei", "ej", "el"], "left_anti")
        moved = [(F.col(c) * (lattice / 4) + F.col(f"b.{d}") * (cap_bond / math.sqrt(3))).alias(n) for c, d, n in zip("ijl", "xyz", ("x", "y", "zc"), strict=True)]
        out = out.unionByName(loose.select(F.lit(2).alias("kind"), F.lit(cap).alias("z"), *moved))
    return numbered(out, ("kind", "x", "y", "zc"))


def numbered(atoms: DataFrame, order: Sequence[str]) -> DataFrame:
    """gid from 0 without gaps in the given order: ranges are sorted side by side, then counted."""
    from pyspark.sql import Window

    x = atoms.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return x.join(base, "_p").select(place.cast("long").alias("gid"), "z", "x", "y", "zc")


def nanocrystal_counts(shells: int) -> tuple[int, int, int]:
    """Cations, anions and dangling bonds in closed form."""
    k = shells // 2
    return 1 + 10 * k * (k + 1) * (2 * k + 1) // 6 + 2 * k, 10 * k * (k + 1) * (k - 1) // 3 + 4 * k, (20 * k * k + 12 * k + 4) if k else 0


# -- trilayers -----------------------------------------------------------------------
def _gaussian_stretch(strain: float, sigma: float, centres: Sequence[float]):
    """Displacement from the origin under strains exp(-(x - c)^2 / (2 sigma^2)) round the centres."""
    area, scale = strain * sigma * math.sqrt(math.pi / 2), math.sqrt(2) * sigma
    erf = np.vectorize(math.erf, otypes=[float])

    @pandas_udf("double")
    def shift(x: pd.Series) -> pd.Series:
        v = x.to_numpy()
        return pd.Series(sum(area * (erf((v - c) / scale) - math.erf(-c / scale)) for c in centres))

    return shift


def trilayer(spark: SparkSession, nx: int, ny: int, lattice: float = 3.16, half_height: float = 1.565, vacuum: float = 20.0, profile: str = "flat", strain: float = 0.0, biaxial: bool = False, edges: tuple[float, float] | None = None, sigma: float = 10.0, metal: int = 42, chalcogen: int = 16) -> tuple[DataFrame, list[list[float]]]:
    """Atoms and cell of an nx x ny sheet of a 1H trilayer in rectangular cells of two formula units (lengths in the unit of ``lattice``).

    ``profile``: flat; uniform strain (in both directions if ``biaxial``);
    periodic, a cosine over the length; contact, Gaussians at two ``edges``.
    """
    if profile not in ("flat", "uniform", "periodic", "contact"):
        raise ValueError(f"unknown profile {profile}")
    if strain < 0 or (biaxial and profile != "uniform"):
        raise ValueError("strain must not be negative, and biaxial strain is uniform")
    ax, ay = math.sqrt(3) * lattice, lattice
    length, width, height = nx * ax, ny * ay, 2 * half_height + vacuum
    basis = [(m, fx * ax, fy * ay, h) for fx, fy, m, h in ((0, 0, metal, 0.0), (1 / 3, 0, chalcogen, half_height), (1 / 3, 0, chalcogen, -half_height), (1 / 2, 1 / 2, metal, 0.0), (5 / 6, 1 / 2, chalcogen, half_height), (5 / 6, 1 / 2, chalcogen, -half_height))]
    site = F.get(F.array(*(F.struct(F.lit(m).alias("z"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(h)).alias("h")) for m, x, y, h in basis)), (F.col("id") % 6).cast("int"))
    cell = F.floor(F.col("id") / 6)
    atoms = spark.range(6 * nx * ny).select(F.col("id").alias("gid"), site.alias("s"), (cell % nx).alias("i"), F.floor(cell / nx).alias("j"))
    x, y = F.col("i") * ax + F.col("s.x"), F.col("j") * ay + F.col("s.y")
    out_x, out_y = length, width
    if profile == "uniform":
        x, out_x = x * (1 + strain), length * (1 + strain)
        y, out_y = (y * (1 + strain), width * (1 + strain)) if biaxial else (y, width)
    elif profile == "periodic":
        wave = 2 * math.pi / length
        x = x + strain / wave * F.sin(wave * x)
    elif profile == "contact":
        if edges is None or not 0 < edges[0] < edges[1] < length or sigma <= 0:
            raise ValueError("contacts need two edges within the length and a positive width")
        images = max(1, math.ceil(8 * sigma / length))
        centres = [e + n * length for e in edges for n in range(-images, images + 1)]
        area, scale = strain * sigma * math.sqrt(math.pi / 2), math.sqrt(2) * sigma
        out_x = length + sum(area * (math.erf((length - c) / scale) - math.erf(-c / scale)) for c in centres)
        x = x + _gaussian_stretch(strain, sigma, centres)(x)
    placed = atoms.select("gid", F.col("s.z").alias("z"), x.alias("x"), y.alias("y"), (F.col("s.h") + height / 2).alias("zc"))
    return placed, [[out_x, 0.0, 0.0], [0.0, out_y, 0.0], [0.0, 0.0, height]]


# -- two-centre blocks ----------------------------------------------------------------
def _harmonics(l: int, p: np.ndarray) -> np.ndarray:
    """Real s, p or d harmonics (columns m = -l .. l, equal norms) at unit vectors p."""
    x, y, z = p.T
    if l == 0:
        return np.ones((len(p), 1))
    if l == 1:
        return np.stack([y, z, x], 1)
    if l == 2:
        r3 = math.sqrt(3)
        return np.stack([r3 * x * y, r3 * y * z, (3 * z * z - 1) / 2, r3 * x * z, r3 * (x * x - y * y) / 2], 1)
    raise ValueError("only s, p and d orbitals")


_rng = np.random.default_rng(0)
_POINTS = _rng.normal(size=(24, 3))
_POINTS /= np.linalg.norm(_POINTS, axis=1)[:, None]


def rotation(l: int, frame: np.ndarray) -> np.ndarray:
    """Matrix that gives harmonics along the frame's axes (rows) from those along x, y, z, by solving at sample points."""
    return np.linalg.lstsq(_harmonics(l, _POINTS), _harmonics(l, _POINTS @ frame.T), rcond=None)[0].T


def bond_frame(d: np.ndarray) -> np.ndarray:
    """A right-handed frame whose third axis is along d."""
    n = np.asarray(d, float) / np.linalg.norm(d)
    a = np.cross(n, np.eye(3)[int(np.abs(n).argmin())])
    a /= np.linalg.norm(a)
    return np.stack([a, np.cross(n, a), n])


def pair_block(d: np.ndarray, shells_i: Sequence[int], shells_j: Sequence[int], channels: Mapping[tuple[int, int, int], float]) -> np.ndarray:
    """Block of two atoms' orbitals for bond vector d; ``channels`` gives the integral of (l of i, l of j, |m|), each for the order that it is stated in.

    Where l_i > l_j, odd channels change their sign, as the bond runs the other way.
    """
    frame = bond_frame(d)
    turn = {l: rotation(l, frame) for l in {*shells_i, *shells_j}}
    at = lambda shells: np.concatenate([[0], np.cumsum([2 * l + 1 for l in shells])])
    oi, oj = at(shells_i), at(shells_j)
    out = np.zeros((oi[-1], oj[-1]))
    for (li, lj, m), v in channels.items():
        if not 0 <= m <= min(li, lj):
            raise ValueError(f"no channel m = {m} between l = {li} and {lj}")
        aligned = np.zeros((2 * li + 1, 2 * lj + 1))
        for s in {m, -m}:
            aligned[li + s, lj + s] = -v if li > lj and (li + lj) % 2 else v
        for i in (x for x, l in enumerate(shells_i) if l == li):
            for j in (x for x, l in enumerate(shells_j) if l == lj):
                out[oi[i] : oi[i + 1], oj[j] : oj[j + 1]] += turn[li].T @ aligned @ turn[lj]
    return out


def two_centre(vectors: DataFrame, shells: Mapping[int, Sequence[int]], channels: Mapping[tuple[int, int], Mapping[tuple[int, int, int], float]]) -> DataFrame:
    """Entries (rx, ry, rz, bi, bj, r, c, v) of edges (src, dst, rx, ry, rz, dx, dy, dz, zi, zj): one block an edge.

    ``channels`` may state a pair of elements in one order only; the other is its transpose.
    """

    def block(zi: int, zj: int, d: np.ndarray) -> np.ndarray:
        if (zi, zj) in channels:
            return pair_block(d, shells[zi], shells[zj], channels[zi, zj])
        return pair_block(-d, shells[zj], shells[zi], channels[zj, zi]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rx", "ry", "rz", "bi", "bj", "r", "c", "v"]
        for batch in batches:
            made: dict[tuple, np.ndarray] = {}
            t = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            d = np.stack([t[n] for n in ("dx", "dy", "dz")], 1)
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for e in range(batch.num_rows):
                key = (int(t["zi"][e]), int(t["zj"][e]), *np.round(d[e], 9).tolist())
                if key not in made:
                    made[key] = block(key[0], key[1], d[e])
                x = made[key]
                r, c = np.divmod(np.arange(x.size), x.shape[1])
                for col, v in zip(cols, (*(np.full(x.size, t[n][e]) for n in ("rx", "ry", "rz", "src", "dst")), r, c, x.ravel()), strict=True):
                    col.append(v)
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.float64()]
            arrays = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    src = vectors.select("src", "dst", *(F.col(c).cast("int").alias(c) for c in ("rx", "ry", "rz")), "dx", "dy", "dz", "zi", "zj")
    return src.mapInArrow(run, "rx int, ry int, rz int, bi long, bj long, r int, c int, v double")


# -- structure files -------------------------------------------------------------------
def xyz_text(atoms: DataFrame, cell: Sequence[Sequence[float]] | None = None) -> str:
    """Extended XYZ of atoms (gid, z, x, y, zc); a file of one structure, so they come to the driver."""
    t = atoms.orderBy("gid").select("z", "x", "y", "zc").toArrow().to_pylist()
    head = "" if cell is None else 'Lattice="' + " ".join(f"{x:.10f}" for v in cell for x in v) + '"'
    return "\n".join([str(len(t)), head, *(f"{SYMBOLS[a['z'] - 1]} {a['x']:.10f} {a['y']:.10f} {a['zc']:.10f}" for a in t)]) + "\n"


def poscar_text(atoms: DataFrame, cell: Sequence[Sequence[float]], title: str = "structure") -> str:
    """VASP 5 with Cartesian coordinates; atoms by number, then gid."""
    t = atoms.orderBy("z", "gid").select("z", "x", "y", "zc").toArrow().to_pylist()
    kinds = sorted({a["z"] for a in t})
    rows = [title, "1.0", *(" ".join(f"{x:.10f}" for x in v) for v in cell), " ".join(SYMBOLS[z - 1] for z in kinds), " ".join(str(sum(a["z"] == z for a in t)) for z in kinds), "Cartesian"]
    return "\n".join([*rows, *(f"{a['x']:.10f} {a['y']:.10f} {a['zc']:.10f}" for a in t)]) + "\n"
