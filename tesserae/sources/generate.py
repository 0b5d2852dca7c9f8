"""Matrices and vectors from tables, and generated lattices, all by ``spark.range`` and arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import PLACE


#: Bytes of a stored table for each partition that it is dealt into.
PART_BYTES = 2 << 20


def parts(table: DataFrame) -> int:
    """Partitions for a stored table, so that what a task holds stays the same while the table grows."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; shuffles begin with as many partitions as it needs, and Spark joins small ones."""
    x = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, n = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", parts(x)
    if n > int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(key, n)
    return x


def cooccurrence(spark: SparkSession, sf_dir: str, by: str = "l_partkey", q: str = "l_quantity") -> DataFrame:
    """A_ij = sum over orders of q_i q_j for the keys that ``by`` (SQL) gives the order's lines, as a matrix of 1 x 1 blocks.

    Only pairs with i <= j are made and summed, as A is symmetric. Orders are
    dealt into partitions of bounded size: nearly all pairs of one differ, so
    the partial sums of a task hold a row for each.
    """
    lines = read(spark, sf_dir, "lineitem")
    x = lines.select("l_orderkey", F.expr(by).alias("k"), F.expr(q).cast("double").alias("q")).repartition(parts(lines), "l_orderkey")
    y = x.select(F.col("l_orderkey").alias("_o"), F.col("k").alias("j"), F.col("q").alias("p"))
    once = F.coalesce(F.col("k") <= F.col("j"), F.lit(True))  # a missing key is a key
    half = x.join(y, (F.col("l_orderkey") == F.col("_o")) & once).groupBy(F.col("k").alias("i"), "j").agg(F.sum(F.col("q") * F.col("p")).alias("v"))
    at = lambda i, j: F.struct(F.col(i).alias("bi"), F.col(j).alias("bj"))
    both = F.when(F.col("i") < F.col("j"), F.array(at("i", "j"), at("j", "i"))).otherwise(F.array(at("i", "j")))
    return half.select(F.explode(both).alias("at"), "v").select("at.bi", "at.bj", F.lit(0).alias("r"), F.lit(0).alias("c"), "v")


def blocked(a: DataFrame) -> DataFrame:
    """1 x 1 blocks regrouped into blocks of sizes 1, 2, 3, 4 over every ten ids."""
    def block(k: Column) -> tuple[Column, Column]:
        t = k % 10
        b = F.when(t < 1, 0).when(t < 3, 1).when(t < 6, 2).otherwise(3)
        first = F.when(t < 1, 0).when(t < 3, 1).when(t < 6, 3).otherwise(6)
        return (F.floor(k / 10) * 4 + b).cast("long"), (t - first).cast("int")

    (bi, r), (bj, c) = block(F.col("bi")), block(F.col("bj"))
    return a.select(bi.alias("_i"), bj.alias("_j"), r.alias("r"), c.alias("c"), *[x for x in ("v", "w") if x in a.columns]).withColumnsRenamed({"_i": "bi", "_j": "bj"})


def part_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x_i = p_size of part i."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"), F.lit(0).alias("r"), F.col("p_size").cast("double").alias("v"))


def _hops(spark: SparkSession, sites: int, pairs: list[tuple[Column, float]], diagonal: float) -> DataFrame:
    i = F.col("id")
    hops = F.explode(F.array(F.struct(i.alias("j"), F.lit(diagonal).alias("v")), *(F.struct(j.cast("long").alias("j"), F.lit(v).alias("v")) for j, v in pairs)))
    x = spark.range(sites).select(i.alias("bi"), hops.alias("x")).select("bi", F.col("x.j").alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("x.v").alias("v"))
    return x.groupBy(*PLACE).agg(F.sum("v").alias("v"))


def poisson(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Five-point stencil 4.1 / -1 on a periodic nx x ny grid."""
    x, y = F.col("id") % nx, F.floor(F.col("id") / nx)
    at = lambda a, b: F.pmod(a, F.lit(nx)) + F.pmod(b, F.lit(ny)) * nx
    return _hops(spark, nx * ny, [(at(x + 1, y), -1.0), (at(x - 1, y), -1.0), (at(x, y + 1), -1.0), (at(x, y - 1), -1.0)], 4.1)


def graphene(spark: SparkSession, nx: int, ny: int, t: float = -2.7) -> DataFrame:
    """Honeycomb lattice of 2 nx ny sites, periodic, complex 1 x 1 blocks with a stored zero diagonal."""
    s, cell = F.col("id") % 2, F.floor(F.col("id") / 2)
    x, y = cell % nx, F.floor(cell / nx)
    d = F.when(s == 0, -1).otherwise(1)
    at = lambda a, b: 2 * (F.pmod(a, F.lit(nx)) + F.pmod(b, F.lit(ny)) * nx) + 1 - s
    return _hops(spark, 2 * nx * ny, [(at(x, y), t), (at(x + d, y), t), (at(x, y + d), t)], 0.0).withColumn("w", F.lit(0.0))


def truss_beam_dims(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Block sizes of a grid whose left half has 3 and right half 6 degrees of freedom a node."""
    return spark.range(nx * ny).select(F.col("id").alias("b"), F.when(F.col("id") % nx < nx // 2, 3).otherwise(6).alias("n"))


def truss_beam(spark: SparkSession, nx: int, ny: int, nz: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sizes and entries of a grid of nodes: 3 degrees of freedom below half the height, 6 above; 100 I on the diagonal, values in (-1, 0] to the six neighbours."""
    i = F.col("id")
    x, y, z = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    dof = lambda layer: F.when(layer < nz // 2, 3).otherwise(6)
    dims = spark.range(nx * ny * nz).select(i.alias("b"), dof(z).alias("n"))
    step = lambda ok, by: F.when(ok, F.struct((i + by).alias("b"), dof(z + by // (nx * ny) if abs(by) >= nx * ny else z).alias("n")))
    near = F.array(F.struct(i.alias("b"), dof(z).alias("n")), step(x > 0, -1), step(x < nx - 1, 1), step(y > 0, -nx), step(y < ny - 1, nx), step(z > 0, -nx * ny), step(z < nz - 1, nx * ny))
    pairs = spark.range(nx * ny * nz).select(i.alias("bi"), dof(z).alias("n"), F.explode(F.filter(near, lambda q: q.isNotNull())).alias("q"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    at = pairs.select("bi", F.col("q.b").alias("bj"), "n", F.col("q.n").alias("m")).withColumn("r", upto(F.col("n"))).withColumn("c", upto(F.col("m")))
    v = F.when(F.col("bi") != F.col("bj"), -uniform(*PLACE, seed=seed)).when(F.col("r") == F.col("c"), 100.0).otherwise(0.0)
    return dims, at.select(*PLACE, v.alias("v"))


def uniform(*cols: str | Column, seed: int = 1) -> Column:
    """In [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(*cols: str | Column, seed: int = 1) -> Column:
    """Standard normal from two hashes of the columns."""
    return F.sqrt(-2 * F.log(F.greatest(uniform(*cols, seed=2 * seed), F.lit(1e-300)))) * F.cos(2 * F.pi() * uniform(*cols, seed=2 * seed + 1))


def _filled(pairs: DataFrame, dims: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every scalar place of block pairs (bi, bj, *keep)."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = pairs.join(dims.select(F.col("b").alias("bi"), F.col("n").alias("_r")), "bi").join(dims.select(F.col("b").alias("bj"), F.col("n").alias("_c")), "bj")
    return x.withColumn("r", upto("_r")).withColumn("c", upto("_c")).select(*PLACE, "_r", "_c", *(keep or []))


def random_blocks(spark: SparkSession, n: int, size_min: int, size_max: int, density: float, seed: int = 42, complex_: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sizes (b, n) from ``size_min`` to ``size_max``, and entries on self, ring and int(n density) - 2 hashed neighbours a row; values in [0, 1)."""
    i = F.col("id")
    dims = spark.range(n).select(i.alias("b"), (size_min + F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(size_max - size_min + 1))).cast("int").alias("n"))
    pairs = random_matrix(spark, n, max(0, int(n * density) - 2), seed).select("bi", "bj")
    values = [uniform(*PLACE, seed=seed + k).alias(c) for k, c in enumerate(("v", "w")[: 1 + complex_])]
    return dims, _filled(pairs, dims).select(*PLACE, *values)


def lattice_cutoff(degree: int, spacing: float = 1.0) -> float:
    """Distance of the degree-th nearest site (itself counted) of a cubic lattice."""
    n = math.ceil(degree ** (1 / 3)) + 1
    d2 = sorted(x * x + y * y + z * z for x in range(-n, n + 1) for y in range(-n, n + 1) for z in range(-n, n + 1))
    return spacing * math.sqrt(d2[max(2, degree) - 1]) * 1.000001


def geometric_matrix(spark: SparkSession, shape: tuple[int, int, int], degree: int = 12, sizes: tuple[int, ...] = (9, 13, 15, 20), decay: float = 1.0, jitter: float = 0.1, offdiagonal: float = 0.2, diagonal: float = 2.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sizes and entries of a jittered periodic lattice: blocks within the cutoff that gives the degree, sizes drawn from ``sizes``, normal values that fall off with distance."""
    from tesserae.operators.atomic import neighbours

    n, i = math.prod(shape), F.col("id")
    grid = [i % shape[0], F.floor(i / shape[0]) % shape[1], F.floor(i / (shape[0] * shape[1]))]
    atoms = spark.range(n).select(i.alias("gid"), *((g + jitter * (2 * uniform(i, F.lit(d), seed=seed) - 1)).alias(x) for d, (g, x) in enumerate(zip(grid, ("x", "y", "zc"), strict=True))))
    cell = [[float(shape[a]) if a == b else 0.0 for b in range(3)] for a in range(3)]
    near = neighbours(atoms, lattice_cutoff(degree), cell).groupBy(F.col("src").alias("bi"), F.col("dst").alias("bj")).agg(F.min("d2").alias("d2"))
    pairs = near.where("bi != bj").union(spark.range(n).select(i, i, F.lit(0.0)))
    dims = spark.range(n).select(i.alias("b"), F.get(F.array(*map(F.lit, sizes)), F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(sizes))).cast("int")).alias("n"))
    on = F.col("bi") == F.col("bj")
    size = F.when(on, 1.0).otherwise(offdiagonal * F.exp(-F.sqrt("d2") / decay)) / F.sqrt(F.col("_r") * F.col("_c"))
    v = normal(*PLACE, seed=seed) * size + F.when(on & (F.col("r") == F.col("c")), diagonal + 0.01 * (F.col("bi") % 17)).otherwise(0.0)
    return dims, _filled(pairs, dims, ["d2"]).select(*PLACE, v.alias("v"))


def random_matrix(spark: SparkSession, n: int, degree: int, seed: int = 1) -> DataFrame:
    """Self, ring neighbours and ``degree`` hashed neighbours a row; values in [0, 1) from a hash of the place."""
    i = F.col("id")
    js = F.array_distinct(F.concat(F.array(i, (i + 1) % n, F.pmod(i - 1, F.lit(n))), F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda k: F.pmod(F.xxhash64(i, k, F.lit(seed)), F.lit(n)))))
    x = spark.range(n).select(i.alias("bi"), F.explode(js).alias("bj"))
    return x.select("bi", "bj", F.lit(0).alias("r"), F.lit(0).alias("c"), (F.pmod(F.xxhash64("bi", "bj", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("v"))
