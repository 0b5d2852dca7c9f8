"""Sums and products of matrices and vectors as joins with grouped sums.

Products of matrices go by panels of rows (``operators.rows``); those of three
factors join on the inner index and sum by the outer ones, with partial sums
before the shuffle. A transposed operand only changes the key. Thresholds:
a pair of blocks is left out if the product of their norms is under eps over
the number of blocks in A's row, and result blocks of norm under eps are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import rows
from tesserae.operators.elementwise import block_norms, filter_blocks, hermitize_diagonal_blocks, redistribute, scale, transpose
from tesserae.schema import PLACE, Cx, constant, is_complex, same_kind, value


def _side(a: DataFrame, p: str) -> DataFrame:
    return a.select(*[F.col(c).alias(f"{p}{c}") for c in a.columns])


def axpby(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    """alpha X + beta Y on the union of patterns; alpha = 0 keeps Y's pattern, beta = 0 keeps X's."""
    same_kind(x, y)
    if alpha == 0:
        return scale(y, beta)
    if beta == 0:
        return scale(x, alpha)
    if x is y:
        return scale(x, alpha + beta)
    return scale(x, alpha).unionByName(scale(y, beta)).groupBy(*PLACE).agg(*value(x).sums())


def spmv(a: DataFrame, x: DataFrame, adjoint: bool = False) -> DataFrame:
    """A x, or A^H x. A multivector's ``col`` is kept."""
    extra = ["col"] if "col" in x.columns else []
    inner, outer = (("bi", "r"), ("bj", "c")) if adjoint else (("bj", "c"), ("bi", "r"))
    xs = x.select(F.col("b").alias(inner[0]), F.col("r").alias(inner[1]), *extra, F.col("v").alias("x_v"), *([F.col("w").alias("x_w")] if "w" in x.columns else []))
    av = value(a).conj() if adjoint else value(a)
    xv = Cx(F.col("x_v"), F.col("x_w") if "w" in x.columns else None)
    return a.join(xs, list(inner)).groupBy(F.col(outer[0]).alias("b"), F.col(outer[1]).alias("r"), *extra).agg(*(av * xv).sums())


def _norms(a: DataFrame, row: str, col: str, norm: str, n: str) -> DataFrame:
    """Block norms with the number of blocks in the row."""
    x = block_norms(a).select(F.col("bi").alias(row), F.col("bj").alias(col), F.col("norm").alias(norm))
    return x.join(x.groupBy(row).agg(F.count(F.lit(1)).alias(n)), row)


def _need(eps: float) -> Column:
    return F.lit(float(eps)) / F.greatest(F.lit(1), F.col("_n"))


def symbolic(a: DataFrame, b: DataFrame, eps: float = 0.0, upper: bool = False) -> DataFrame:
    """bi, bj and bound (sum of products of norms) of the blocks of A B that can exceed eps, from block norms alone."""
    x = _norms(a, "bi", "bk", "_na", "_n").join(_norms(b, "bk", "bj", "_nb", "_m"), "bk").where(F.col("_na") * F.col("_nb") >= _need(eps))
    x = x.where("bj >= bi") if upper else x
    return x.groupBy("bi", "bj").agg(F.sum(F.col("_na") * F.col("_nb")).alias("bound")).where(F.col("bound") > eps)


def _multiply(left: DataFrame, right: DataFrame, keep: Column | None = None, upper: bool = False) -> DataFrame:
    """Sums over the inner index of pairs that ``keep`` holds for; the test is part of the join, so what it drops is never made.

    Columns beside places and values serve ``keep`` and must have different names.
    """
    extra = lambda d: [c for c in d.columns if c not in (*PLACE, "v", "w")]
    x = left.select("bi", F.col("bj").alias("bk"), "r", F.col("c").alias("k"), *extra(left), *[F.col(c).alias(f"a_{c}") for c in ("v", "w") if c in left.columns])
    y = right.select(F.col("bi").alias("_bk"), "bj", F.col("r").alias("_k"), "c", *extra(right), *[F.col(c).alias(f"b_{c}") for c in ("v", "w") if c in right.columns])
    on = (F.col("bk") == F.col("_bk")) & (F.col("k") == F.col("_k"))
    on = on & keep if keep is not None else on
    on = on & (F.col("bj") >= F.col("bi")) if upper else on
    return x.join(y, on).groupBy(*PLACE).agg(*(value(left, "a_") * value(right, "b_")).sums())


def spgemm(a: DataFrame, b: DataFrame, eps: float = 0.0, trans_a: bool = False, trans_b: bool = False, upper: bool = False, final: bool = True) -> DataFrame:
    """op(A) op(B) with thresholds; only block columns bj >= bi if ``upper``.

    With a threshold, norms go first: blocks that meet no partner are left out
    before values meet, and pairs are tested before they are multiplied.
    """
    same_kind(a, b)
    a = transpose(a) if trans_a else a
    b = transpose(b) if trans_b else b
    if eps <= 0:
        return rows.multiply(a, b, upper)
    na, nb = _norms(a, "bi", "bj", "_na", "_n"), block_norms(b).select("bi", "bj", F.col("norm").alias("_nb"))
    best_b = nb.groupBy(F.col("bi").alias("bj")).agg(F.max("_nb").alias("_best"))
    some_a = na.join(best_b, "bj").where(F.col("_na") * F.col("_best") >= _need(eps)).drop("_best")
    best_a = na.groupBy(F.col("bj").alias("bi")).agg(F.max(F.col("_na") / _need(eps)).alias("_best"))
    some_b = nb.join(best_a, "bi").where(F.col("_nb") * F.col("_best") >= 0.999999).drop("_best")  # rounding can't lose a pair
    out = rows.multiply(a.join(some_a.withColumn("_need", _need(eps)), ["bi", "bj"]), b.join(some_b, ["bi", "bj"]), upper)
    return filter_blocks(out, eps) if final else out


def complete_hermitian(u: DataFrame) -> DataFrame:
    """Upper triangle (by blocks) and its mirror; what is below the diagonal is ignored."""
    return u.where("bj >= bi").unionByName(transpose(u.where("bj > bi").select(u.columns)))


def spgemm_hermitian(a: DataFrame, b: DataFrame, eps: float = 0.0) -> DataFrame:
    """A product known to be Hermitian: half of it, mirrored, diagonal blocks averaged."""
    return hermitize_diagonal_blocks(complete_hermitian(spgemm(a, b, eps, upper=True)))


def square_polynomial_upper(a: DataFrame, identity: DataFrame, c2: float, c1: float, c0: float, eps: float = 0.0) -> DataFrame:
    """Upper blocks of c2 A^2 + c1 A + c0 I, one plan with a single final threshold."""
    parts = scale(spgemm(a, a, eps, upper=True, final=False), c2).unionByName(scale(a.where("bj >= bi"), c1)).unionByName(scale(identity, c0))
    return filter_blocks(parts.groupBy(*PLACE).agg(*value(a).sums()), eps)


def _triple(left: DataFrame, b: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Upper blocks of L B R with half the threshold as the error budget of each step and one truncation at the end.

    First step: a pair of blocks goes if the product of norms is under eps / (2 n m
    max |R|), n and m being the blocks in the rows of L and B, so that all that
    can reach one result adds up to eps / 2 at most. Second step: the summed
    bounds of a block of L B times the norm in R against eps / (2 t), t being the
    blocks in that row of L B.
    """
    if eps <= 0:
        return rows.multiply(rows.multiply(left, b), right, upper=True)
    one = F.lit(1)
    nr = block_norms(right).select("bi", "bj", F.col("norm").alias("_nr"))
    top = nr.agg(F.max("_nr").alias("_top")).withColumn("_one", one)
    nl = _norms(left, "bi", "bj", "_na", "_n").withColumn("_one", one).join(F.broadcast(top), "_one").drop("_one")  # one row
    nb = _norms(b, "bi", "bj", "_nb", "_m")
    enough = F.col("_na") * F.col("_nb") >= F.lit(float(eps)) / (2.0 * F.greatest(one, F.col("_n")) * F.col("_m") * F.col("_top"))
    inner = _multiply(left.join(nl, ["bi", "bj"]), b.join(nb, ["bi", "bj"]), enough)
    pairs = nl.withColumnRenamed("bj", "bk").join(nb.select(F.col("bi").alias("bk"), "bj", "_nb", "_m"), "bk").where(enough)
    bound = pairs.groupBy("bi", "bj").agg(F.sum(F.col("_na") * F.col("_nb")).alias("_bound"))
    bound = bound.join(bound.groupBy("bi").agg(F.count(one).alias("_t")), "bi")
    out = _multiply(inner.join(bound, ["bi", "bj"]), right.join(nr, ["bi", "bj"]), F.col("_bound") * F.col("_nr") >= F.lit(float(eps)) / (2.0 * F.col("_t")), upper=True)
    return filter_blocks(out, eps)


def rarh_upper(a: DataFrame, b: DataFrame, eps: float = 0.0) -> DataFrame:
    """Upper blocks of A B A^H, with error budgets; see ``_triple``."""
    same_kind(a, b)
    return _triple(a, b, transpose(a), eps)


def rhar_upper(a: DataFrame, b: DataFrame, eps: float = 0.0) -> DataFrame:
    """Upper blocks of A^H B A, with error budgets; see ``_triple``."""
    same_kind(a, b)
    return _triple(transpose(a), b, a, eps)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """sum conj(x) y, by column for multivectors."""
    keys = [c for c in ("b", "r", "col") if c in x.columns]
    got = _side(x, "x_")
    joined = got.join(y, [F.col(f"x_{k}") == F.col(k) for k in keys])
    sums = (value(x, "x_").conj() * value(y)).sums()
    return joined.groupBy("col").agg(*sums) if "col" in keys else joined.agg(*sums)


def vector_axpby(alpha: complex, x: DataFrame, beta: complex, y: DataFrame) -> DataFrame:
    """alpha x + beta y over the union of places."""
    keys = [c for c in ("b", "r", "col") if c in x.columns]
    both = is_complex(x) or is_complex(y) or isinstance(alpha, complex) or isinstance(beta, complex)

    def scaled(s: complex, d: DataFrame) -> DataFrame:
        out = constant(s) * value(d)
        return d.select(*keys, *Cx(out.re, out.im if out.im is not None or not both else F.lit(0.0)).columns())

    parts = scaled(alpha, x).unionByName(scaled(beta, y))
    return parts.groupBy(*keys).agg(*value(parts).sums())


def pointwise(x: DataFrame, y: DataFrame) -> DataFrame:
    """x times y, entry by entry; a vector y counts for every column of a multivector x."""
    keys = [c for c in ("b", "r", "col") if c in x.columns and c in y.columns]
    other = y.select(*keys, *[F.col(c).alias(f"y_{c}") for c in ("v", "w") if c in y.columns])
    places = [c for c in ("b", "r", "col") if c in x.columns]
    return x.join(other, keys).select(*places, *(value(x) * value(y, "y_")).columns())


def khop(a: DataFrame, k: int) -> DataFrame:
    """A on the pattern of A^k: A's values where it has them, stored zeros elsewhere, for blocks whose rows and columns A knows."""
    sizes = a.select(F.col("bi").alias("b"), F.col("r").alias("p")).union(a.select("bj", "c")).groupBy("b").agg((F.max("p") + 1).alias("n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = a.select("bi", "bj").distinct()
    if k < 2:
        places = base.join(sizes.select(F.col("b").alias("bi"), F.col("n").alias("_r")), "bi").join(sizes.select(F.col("b").alias("bj"), F.col("n").alias("_c")), "bj")
        return redistribute(a, places.withColumn("r", upto("_r")).withColumn("c", upto("_c")).select(*PLACE))
    return rows.on_pattern(khop_pattern(a, k - 1), base, a, sizes)


def khop_pattern(a: DataFrame, k: int) -> DataFrame:
    """Block pattern of A^k."""
    base = a.select("bi", "bj").distinct()
    out = base
    for _ in range(k - 1):
        out = rows.pattern(out, base)
    return out


def gershgorin(a: DataFrame) -> DataFrame:
    """One row: bounds of the spectrum from row sums, padded by the larger of 1 % of the half width and 1e-6."""
    on = (F.col("bi") == F.col("bj")) & (F.col("r") == F.col("c"))
    rows = a.groupBy("bi", "r").agg(F.sum(F.when(on, F.col("v")).otherwise(0.0)).alias("d"), F.sum(F.when(~on, F.sqrt(value(a).abs2())).otherwise(0.0)).alias("s"))
    ends = rows.agg(F.min(F.col("d") - F.col("s")).alias("lo"), F.max(F.col("d") + F.col("s")).alias("hi"))
    pad = F.greatest(0.01 * (F.col("hi") - F.col("lo")) / 2, F.lit(1e-6))
    return ends.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
