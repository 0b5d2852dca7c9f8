"""Element-wise operations, filters and block metadata; none but the norms needs a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.schema import PLACE, Cx, constant, is_complex, value


def scale(a: DataFrame, alpha: complex) -> DataFrame:
    """alpha A."""
    return a.select(*PLACE, *(constant(alpha) * value(a)).columns())


def conjugate(a: DataFrame) -> DataFrame:
    """Entries conjugated; a real matrix stays as it is."""
    return a.select(*PLACE, *value(a).conj().columns())


def real(a: DataFrame) -> DataFrame:
    """Real parts on the same pattern."""
    return a.select(*PLACE, "v")


def imag(a: DataFrame) -> DataFrame:
    """Imaginary parts on the same pattern; stored zeros for a real matrix."""
    return a.select(*PLACE, (F.col("w") if is_complex(a) else F.lit(0.0)).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    """Conjugate transpose."""
    return a.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.col("c").alias("r"), F.col("r").alias("c"), *value(a).conj().columns())


def shift(a: DataFrame, alpha: float) -> DataFrame:
    """alpha added to the diagonal of stored diagonal blocks; absent blocks stay absent."""
    on = (F.col("bi") == F.col("bj")) & (F.col("r") == F.col("c"))
    return a.withColumn("v", F.when(on, F.col("v") + F.lit(float(alpha))).otherwise(F.col("v")))


def add_diagonal(a: DataFrame, d: DataFrame) -> DataFrame:
    """Vector d added to the diagonal of stored diagonal blocks."""
    dv = d.select(F.col("b").alias("_b"), F.col("r").alias("_r"), F.col("v").alias("_v"))
    on = (F.col("bi") == F.col("bj")) & (F.col("r") == F.col("c")) & (F.col("bi") == F.col("_b")) & (F.col("r") == F.col("_r"))
    return a.join(dv, on, "left").withColumn("v", F.col("v") + F.coalesce("_v", F.lit(0.0))).drop("_b", "_r", "_v")


def commutator_diagonal(a: DataFrame, d: DataFrame) -> DataFrame:
    """A_rc (d_c - d_r)."""
    row = d.select(F.col("b").alias("bi"), F.col("r"), F.col("v").alias("_dr"))
    col = d.select(F.col("b").alias("bj"), F.col("r").alias("c"), F.col("v").alias("_dc"))
    x = a.join(row, ["bi", "r"]).join(col, ["bj", "c"])
    return x.select(*PLACE, *(value(a) * Cx(F.col("_dc") - F.col("_dr"))).columns())


def block_norms(a: DataFrame) -> DataFrame:
    """Frobenius norm and number of scalars of each stored block."""
    return a.groupBy("bi", "bj").agg(F.sqrt(F.sum(value(a).abs2())).alias("norm"), F.count(F.lit(1)).alias("n"))


def filter_blocks(a: DataFrame, eps: float) -> DataFrame:
    """Blocks of norm eps or more; all of them if eps <= 0. The diagonal is not spared."""
    if eps <= 0:
        return a
    return a.join(block_norms(a).where(F.col("norm") >= eps).select("bi", "bj"), ["bi", "bj"], "left_semi").select(a.columns)


def zero_diagonal_blocks(a: DataFrame) -> DataFrame:
    """Diagonal blocks as stored zeros."""
    zero = lambda c: F.when(F.col("bi") == F.col("bj"), F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return a.select(*PLACE, *map(zero, [c for c in ("v", "w") if c in a.columns]))


def hermitize_diagonal_blocks(a: DataFrame) -> DataFrame:
    """Diagonal blocks D as (D + D^H) / 2."""
    on = F.col("bi") == F.col("bj")
    half = scale(a.where(on).select(a.columns), 0.5)
    both = half.unionByName(transpose(half))
    return a.where(~on).unionByName(both.groupBy(*PLACE).agg(*value(a).sums()))


def get_block(a: DataFrame, i: int, j: int) -> DataFrame:
    """The scalars of one block; none if it isn't stored."""
    return a.where((F.col("bi") == i) & (F.col("bj") == j)).select("r", "c", *[x for x in ("v", "w") if x in a.columns])


def frobenius(a: DataFrame) -> DataFrame:
    """One row: norm and the largest absolute value."""
    return a.agg(F.sqrt(F.sum(value(a).abs2())).alias("frobenius"), F.sqrt(F.max(value(a).abs2())).alias("maxabs"))


def counts(a: DataFrame, n_blocks: int) -> DataFrame:
    """One row: stored scalars, stored blocks and block density."""
    return a.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("nnz"), F.count(F.lit(1)).alias("blocks")).withColumn("density", F.col("blocks") / F.lit(float(n_blocks) ** 2))


def shapes(a: DataFrame) -> DataFrame:
    """How many blocks have which shape."""
    each = a.groupBy("bi", "bj").agg((F.max("r") + 1).cast("long").alias("rows"), (F.max("c") + 1).cast("long").alias("cols"))
    return each.groupBy("rows", "cols").agg(F.count(F.lit(1)).alias("blocks"))


def row_pointers(a: DataFrame) -> DataFrame:
    """Block row, its columns in order, and how many there are; offsets are prefix sums of the counts."""
    return a.select("bi", "bj").distinct().groupBy("bi").agg(F.array_sort(F.collect_list("bj")).alias("cols"), F.count(F.lit(1)).alias("n"))


def extract(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and columns of ``ids`` (old, new), renumbered."""
    row = ids.select(F.col("old").alias("bi"), F.col("new").alias("_i"))
    col = ids.select(F.col("old").alias("bj"), F.col("new").alias("_j"))
    x = a.join(row, "bi").join(col, "bj")
    return x.select(F.col("_i").alias("bi"), F.col("_j").alias("bj"), *[c for c in a.columns if c not in ("bi", "bj")])


def insert(a: DataFrame, sub: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored blocks of ``sub`` (numbered as ``new``) replace those of A; blocks that A has not are dropped."""
    back = extract(sub, ids.select(F.col("new").alias("old"), F.col("old").alias("new")))
    new = back.select(*PLACE, *[F.col(c).alias(f"_{c}") for c in ("v", "w") if c in a.columns])
    x = a.join(new, list(PLACE), "left")
    return x.select(*PLACE, *[F.coalesce(f"_{c}", c).alias(c) for c in ("v", "w") if c in a.columns])


def assemble(log: DataFrame, pattern: DataFrame | None = None, keys: tuple[str, ...] = ("bi", "bj")) -> DataFrame:
    """A log (seq, *keys, r, c, v, mode) replayed: the last INSERT of a block, if any, and the ADDs after it.

    Blocks outside ``pattern`` (keys), if that is given, are dropped.
    """
    last = log.groupBy(*keys).agg(F.max(F.when(F.col("mode") == "INSERT", F.col("seq"))).alias("_last"))
    x = log.join(last, list(keys)).where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last")))
    out = x.groupBy(*keys, "r", "c").agg(*value(log).sums())
    return out if pattern is None else out.join(pattern, list(keys), "left_semi")


def extract_batched(a: DataFrame, batches: DataFrame) -> DataFrame:
    """Many submatrices at once: entries with ``batch``, renumbered by (batch, old, new)."""
    row = batches.select("batch", F.col("old").alias("bi"), F.col("new").alias("_i"))
    col = batches.select("batch", F.col("old").alias("bj"), F.col("new").alias("_j"))
    x = a.join(row, "bi").join(col, ["batch", "bj"])
    return x.select("batch", F.col("_i").alias("bi"), F.col("_j").alias("bj"), *[c for c in a.columns if c not in ("bi", "bj")])


def redistribute(a: DataFrame, places: DataFrame, mode: str = "INSERT") -> DataFrame:
    """``a`` on exactly ``places`` (its key columns), zeros where it has nothing; equal places are summed if ``mode`` is ADD."""
    keys, values = places.columns, [c for c in ("v", "w") if c in a.columns]
    x = a.groupBy(*keys).agg(*value(a).sums()) if mode == "ADD" else a.select(*keys, *values)
    return places.join(x, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in values))


def expand(a: DataFrame, dims: DataFrame) -> DataFrame:
    """Scalar coordinates i, j by the block offsets of ``dims`` (b, n, off)."""
    row = dims.select(F.col("b").alias("bi"), F.col("off").alias("_i"))
    col = dims.select(F.col("b").alias("bj"), F.col("off").alias("_j"))
    return a.join(row, "bi").join(col, "bj").select((F.col("_i") + F.col("r")).alias("i"), (F.col("_j") + F.col("c")).alias("j"), *[c for c in ("v", "w") if c in a.columns])


def offsets(dims: DataFrame, buckets: int = 1024) -> DataFrame:
    """dims (b, n) with exclusive prefix sums ``off``: within buckets of b, then over the few buckets, so no task sorts everything."""
    from pyspark.sql import Window

    x = dims.withColumn("_g", F.floor(F.col("b") / buckets))
    inner = Window.partitionBy("_g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = x.groupBy("_g").agg(F.sum("n").alias("_s"))
    outer = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    base = sums.select("_g", (F.sum("_s").over(outer) - F.col("_s")).alias("_base"))  # one row a bucket
    return x.join(base, "_g").select("b", "n", (F.col("_base") + F.sum("n").over(inner) - F.col("n")).cast("long").alias("off"))
