"""Queries over the test tables, one for each operator, with the same in DuckDB SQL.

Matrices come from ``lineitem``: quantities are whole numbers, so sums of
products are exact and don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.api import BlockGraph, BlockMatrix, MultiVector, Vector
from tesserae.functions.spectral import KEY_BLOCK, KEY_COL, KEY_ROW, MASK, MUL_1, MUL_2, STEP, chebyshev_coefficients, chebyshev_values, fermi_dirac, gaussian, jackson, random_values
from tesserae.operators import atomic, elementwise as ew, partition, products as pr, triples
from tesserae.plans import iterate
from tesserae.schema import PLACE
from tesserae.sources import crystals, formats, generate
from tesserae.streaming.assembly import assemble_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- the same matrices in both dialects ------------------------------------
_BLK = "(({0} // 10) * 4 + CASE WHEN {0} % 10 < 1 THEN 0 WHEN {0} % 10 < 3 THEN 1 WHEN {0} % 10 < 6 THEN 2 ELSE 3 END)"
_ROW = "({0} % 10 - CASE WHEN {0} % 10 < 1 THEN 0 WHEN {0} % 10 < 3 THEN 1 WHEN {0} % 10 < 6 THEN 3 ELSE 6 END)"


def _co(name: str, by: str = "l_partkey", q: str = "l_quantity") -> str:
    return f"{name}l AS (SELECT l_orderkey o, {by} k, CAST({q} AS DOUBLE) q FROM lineitem), {name} AS (SELECT x.k bi, y.k bj, 0 r, 0 c, sum(x.q * y.q) v FROM {name}l x JOIN {name}l y ON x.o = y.o GROUP BY 1, 2)"


def _blk(name: str, of: str) -> str:
    return f"{name} AS (SELECT CAST({_BLK.format('bi')} AS BIGINT) bi, CAST({_BLK.format('bj')} AS BIGINT) bj, CAST({_ROW.format('bi')} AS INTEGER) r, CAST({_ROW.format('bj')} AS INTEGER) c, v FROM {of})"


_X = "x AS (SELECT p_partkey b, 0 r, CAST(p_size AS DOUBLE) v FROM part)"
_ALL = "SELECT bi, bj, r, c, v FROM "
#: Parts that occur in the same orders, and the same in blocks.
R, B = _co("a"), _co("a") + ", " + _blk("m", "a")
#: All lines, parts by remainder: small enough for products of three factors at any scale.
_MOD, _LINE = "l_partkey % 40", "l_linenumber"
S1 = _co("a", _MOD, _LINE)
S = S1 + ", " + _blk("m", "a")
#: Orders by parts, and parts by suppliers: whole tables, few entries a row.
Q = "q AS (SELECT l_orderkey bi, l_partkey bj, 0 r, 0 c, sum(l_quantity) v FROM lineitem GROUP BY 1, 2)"
QB = Q + ", " + _blk("m", "q")
PS = "ps AS (SELECT l_partkey bi, l_suppkey bj, 0 r, 0 c, sum(l_quantity) v FROM lineitem GROUP BY 1, 2)"


def _r(s: SparkSession, d: str) -> DataFrame:
    return generate.cooccurrence(s, d)


def _n(s: SparkSession, d: str) -> DataFrame:
    return generate.cooccurrence(s, d, "l_suppkey")


def _b(s: SparkSession, d: str) -> DataFrame:
    return generate.blocked(_r(s, d))


def _s1(s: SparkSession, d: str) -> DataFrame:
    return generate.cooccurrence(s, d, _MOD, _LINE)


def _s(s: SparkSession, d: str) -> DataFrame:
    return generate.blocked(_s1(s, d))


def _entries(s: SparkSession, d: str, row: str, col: str) -> DataFrame:
    x = generate.read(s, d, "lineitem").groupBy(F.expr(row).alias("bi"), F.expr(col).alias("bj")).agg(F.sum("l_quantity").alias("v"))
    return x.select("bi", "bj", F.lit(0).alias("r"), F.lit(0).alias("c"), "v")


def _q(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d, "l_orderkey", "l_partkey")


def _ps(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d, "l_partkey", "l_suppkey")


def _x(s: SparkSession, d: str) -> DataFrame:
    return generate.part_vector(s, d)


def _cplx(s: SparkSession, d: str) -> DataFrame:
    """Supplier x part matrix of quantity + i line number."""
    return generate.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("bi"), F.col("l_partkey").alias("bj")).agg(F.sum("l_quantity").alias("v"), F.sum(F.col("l_linenumber").cast("double")).alias("w")).select("bi", "bj", F.lit(0).alias("r"), F.lit(0).alias("c"), "v", "w")


_CX = "z AS (SELECT l_suppkey bi, l_partkey bj, 0 r, 0 c, sum(l_quantity) v, sum(CAST(l_linenumber AS DOUBLE)) w FROM lineitem GROUP BY 1, 2)"


# -- products ---------------------------------------------------------------
@query(f"WITH {_co('a')}, {_X} SELECT a.bi b, 0 r, sum(a.v * x.v) v FROM a JOIN x ON a.bj = x.b GROUP BY 1")
def spmv(s, d):
    return pr.spmv(generate.cooccurrence(s, d), _x(s, d))


@query(f"WITH {R}, {_X} SELECT a.bj b, 0 r, sum(a.v * x.v) v FROM a JOIN x ON a.bi = x.b GROUP BY 1")
def spmv_adjoint(s, d):
    return pr.spmv(_r(s, d), _x(s, d), adjoint=True)


def _mvec(s, d):
    return _x(s, d).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select("b", "r", F.col("k").alias("col"), (F.col("v") + F.col("k")).alias("v"))


_MX = _X + ", mx AS (SELECT b, r, col, v + col v FROM x, (SELECT unnest([0, 1, 2]) col))"


@query(f"WITH {R}, {_MX} SELECT a.bi b, 0 r, col, sum(a.v * mx.v) v FROM a JOIN mx ON a.bj = mx.b GROUP BY 1, 3")
def spmm_dense(s, d):
    return pr.spmv(_r(s, d), _mvec(s, d))


@query(f"WITH {R}, {_MX} SELECT a.bj b, 0 r, col, sum(a.v * mx.v) v FROM a JOIN mx ON a.bi = mx.b GROUP BY 1, 3")
def spmm_dense_adjoint(s, d):
    return pr.spmv(_r(s, d), _mvec(s, d), adjoint=True)


_PROD = "SELECT x.bi, y.bj, x.r, y.c, sum(x.v * y.v) v FROM {0} x JOIN {1} y ON x.bj = y.bi AND x.c = y.r GROUP BY 1, 2, 3, 4"


_QT = "t AS (SELECT bj bi, bi bj, c r, r c, v FROM {0})"


@query(f"WITH {Q}, {_QT.format('q')} " + _PROD.format("t", "q"))
def spgemm_exact(s, d):
    q = _q(s, d)
    return pr.spgemm(q, q, trans_a=True)


_THRESH = """na AS (SELECT bi, bj, sqrt(sum(v * v)) n FROM {a} GROUP BY 1, 2), nb AS (SELECT bi, bj, sqrt(sum(v * v)) n FROM {b} GROUP BY 1, 2), rows AS (SELECT bi, count(*) n FROM na GROUP BY 1),
p AS (SELECT x.bi, y.bj, x.r, y.c, sum(x.v * y.v) v FROM {a} x JOIN {b} y ON x.bj = y.bi AND x.c = y.r
 JOIN na nx ON nx.bi = x.bi AND nx.bj = x.bj JOIN nb ny ON ny.bi = y.bi AND ny.bj = y.bj JOIN rows ON rows.bi = x.bi
 WHERE nx.n * ny.n >= {e} / greatest(1, rows.n) GROUP BY 1, 2, 3, 4),
k AS (SELECT bi, bj FROM p GROUP BY 1, 2 HAVING sqrt(sum(v * v)) >= {e})
SELECT p.* FROM p SEMI JOIN k ON p.bi = k.bi AND p.bj = k.bj"""


@query(f"WITH {Q}, {_QT.format('q')}, " + _THRESH.format(a="t", b="q", e="2000.5"))
def spgemm_threshold(s, d):
    q = _q(s, d)
    return pr.spgemm(q, q, 2000.5, trans_a=True)


@query(f"WITH {QB}, {_QT.format('m')}, " + _THRESH.format(a="t", b="m", e="2500.5"))
def spgemm_blocked_threshold(s, d):
    m = generate.blocked(_q(s, d))
    return pr.spgemm(m, m, 2500.5, trans_a=True)


@query(f"WITH {Q}, {_QT.format('q')}, rows AS (SELECT bi, count(*) n FROM t GROUP BY 1) SELECT x.bi, y.bj, sum(abs(x.v) * abs(y.v)) bound FROM t x JOIN q y ON x.bj = y.bi JOIN rows ON rows.bi = x.bi WHERE abs(x.v) * abs(y.v) >= 900.5 / greatest(1, rows.n) GROUP BY 1, 2 HAVING sum(abs(x.v) * abs(y.v)) > 900.5")
def symbolic_multiply(s, d):
    q = _q(s, d)
    return pr.symbolic(ew.transpose(q), q, 900.5).withColumn("bound", F.round("bound", 3))


_T = "t AS (SELECT bj bi, bi bj, c r, r c, v FROM m)"


@query(f"WITH {S}, {_T} " + _PROD.format("t", "m"))
def spgemm_trans_a(s, d):
    m = _s(s, d)
    return pr.spgemm(m, m, trans_a=True)


@query(f"WITH {S}, {_T} " + _PROD.format("m", "t"))
def spgemm_trans_b(s, d):
    m = _s(s, d)
    return pr.spgemm(m, m, trans_b=True)


@query(f"WITH {S}, p AS ({_PROD.format('m', 'm')}) SELECT * FROM p WHERE bj >= bi")
def spgemm_hermitian_upper(s, d):
    m = _s(s, d)
    return pr.spgemm(m, m, upper=True)


@query(f"WITH {S} " + _PROD.format("m", "m"))
def spgemm_hermitian(s, d):
    m = _s(s, d)
    return pr.spgemm_hermitian(m, m)


@query(f"WITH {S} SELECT bi, bj, r, c, v FROM m WHERE bj >= bi UNION ALL SELECT bj, bi, c, r, v FROM m WHERE bj > bi")
def complete_hermitian(s, d):
    return pr.complete_hermitian(_s(s, d))


@query(f"WITH {S}, p AS ({_PROD.format('m', 'm')}), u AS (SELECT bi, bj, r, c, 2 * v v FROM p WHERE bj >= bi UNION ALL SELECT bi, bj, r, c, -3 * v FROM m WHERE bj >= bi UNION ALL SELECT DISTINCT bi, bi, r, r, 7.0 FROM m) SELECT bi, bj, r, c, sum(v) v FROM u GROUP BY 1, 2, 3, 4")
def square_polynomial(s, d):
    m = _s(s, d)
    one = m.select("bi", F.col("bi").alias("bj"), "r", F.col("r").alias("c")).distinct().withColumn("v", F.lit(1.0))
    return pr.square_polynomial_upper(m, one, 2.0, -3.0, 7.0)


@query(f"WITH {S}, p AS ({_PROD.format('m', 'm')}), {_T}, q AS ({_PROD.format('p', 't')}) SELECT * FROM q WHERE bj >= bi")
def rarh(s, d):
    m = _s(s, d)
    return pr.rarh_upper(m, m)


@query(f"WITH {S}, {_T}, p AS ({_PROD.format('t', 'm')}), q AS ({_PROD.format('p', 'm')}) SELECT * FROM q WHERE bj >= bi")
def rhar(s, d):
    m = _s(s, d)
    return pr.rhar_upper(m, m)


#: Budgets of both steps for 1 x 1 blocks: L B R, upper half.
_BUDGET = """nl AS (SELECT *, count(*) OVER (PARTITION BY bi) n FROM {l}), nb AS (SELECT *, count(*) OVER (PARTITION BY bi) m FROM a), top AS (SELECT max(abs(v)) t FROM a),
pairs AS (SELECT x.bi, y.bj, x.v * y.v v FROM nl x JOIN nb y ON x.bj = y.bi, top WHERE abs(x.v) * abs(y.v) >= {e} / (2.0 * greatest(1, x.n) * y.m * top.t)),
inr AS (SELECT bi, bj, sum(v) v, sum(abs(v)) bound FROM pairs GROUP BY 1, 2), ins AS (SELECT *, count(*) OVER (PARTITION BY bi) t FROM inr),
res AS (SELECT x.bi, y.bj, 0 r, 0 c, sum(x.v * y.v) v FROM ins x JOIN {r} y ON x.bj = y.bi WHERE y.bj >= x.bi AND x.bound * abs(y.v) >= {e} / (2.0 * x.t) GROUP BY 1, 2)
SELECT * FROM res WHERE abs(v) >= {e}"""
_AT1 = "t AS (SELECT bj bi, bi bj, 0 r, 0 c, v FROM a)"


@query(f"WITH {S1}, {_AT1}, " + _BUDGET.format(l="a", r="t", e="3e8"))
def rarh_threshold(s, d):
    a = _s1(s, d)
    return pr.rarh_upper(a, a, 3e8)


@query(f"WITH {S1}, {_AT1}, " + _BUDGET.format(l="t", r="a", e="5e8"))
def rhar_threshold(s, d):
    a = _s1(s, d)
    return pr.rhar_upper(a, a, 5e8)


@query(f"WITH {S1}, n AS (SELECT *, count(*) OVER (PARTITION BY bi) n FROM a), u AS (SELECT x.bi, y.bj, 2 * x.v * y.v v FROM n x JOIN a y ON x.bj = y.bi WHERE y.bj >= x.bi AND abs(x.v) * abs(y.v) >= 2e6 / greatest(1, x.n) UNION ALL SELECT bi, bj, -3 * v FROM a WHERE bj >= bi UNION ALL SELECT DISTINCT bi, bi, 7.0 FROM a) SELECT bi, bj, 0 r, 0 c, sum(v) v FROM u GROUP BY 1, 2 HAVING abs(sum(v)) >= 2e6")
def square_polynomial_threshold(s, d):
    a = _s1(s, d)
    one = a.select("bi", F.col("bi").alias("bj"), "r", "c").distinct().withColumn("v", F.lit(1.0))
    return pr.square_polynomial_upper(a, one, 2.0, -3.0, 7.0, 2e6)


_HOP = "b0 AS (SELECT DISTINCT bi, bj FROM ps), b2 AS (SELECT DISTINCT x.bi, y.bj FROM b0 x JOIN b0 y ON x.bj = y.bi)"


@query(f"WITH {PS}, {_HOP} SELECT * FROM b2")
def khop_pattern(s, d):
    return pr.khop_pattern(_ps(s, d), 2)


@query(f"WITH {PS}, {_HOP} SELECT b2.bi, b2.bj, 0 r, 0 c, coalesce(ps.v, 0) v FROM b2 LEFT JOIN ps ON ps.bi = b2.bi AND ps.bj = b2.bj")
def khop_values(s, d):
    return pr.khop(_ps(s, d), 2)


# -- sums and element-wise -----------------------------------------------------
_AB = _co("a") + ", " + _co("n", "l_suppkey")
_SUM = "SELECT bi, bj, r, c, sum(v) v FROM (SELECT bi, bj, r, c, {0} * v v FROM a UNION ALL SELECT bi, bj, r, c, {1} * v FROM n) GROUP BY 1, 2, 3, 4"


@query(f"WITH {_AB} " + _SUM.format(2.0, -3.0))
def axpby(s, d):
    return pr.axpby(2.0, _r(s, d), -3.0, _n(s, d))


@query(f"WITH {_AB} " + _SUM.format(1.0, 1.0))
def add(s, d):
    return pr.axpby(1.0, _r(s, d), 1.0, _n(s, d))


@query(f"WITH {_AB} " + _SUM.format(1.0, -1.0))
def sub(s, d):
    return pr.axpby(1.0, _r(s, d), -1.0, _n(s, d))


@query(f"WITH {R} SELECT bi, bj, r, c, 4 * v v FROM a")
def scale(s, d):
    return ew.scale(_r(s, d), 4.0)


@query(f"WITH {B} SELECT bi, bj, r, c, v + CASE WHEN bi = bj AND r = c THEN 5 ELSE 0 END v FROM m")
def shift(s, d):
    return ew.shift(_b(s, d), 5.0)


@query(f"WITH {R}, {_X} SELECT a.bi, a.bj, a.r, a.c, a.v + CASE WHEN a.bi = a.bj THEN coalesce(x.v, 0) ELSE 0 END v FROM a LEFT JOIN x ON a.bi = x.b")
def add_diagonal(s, d):
    return ew.add_diagonal(_r(s, d), _x(s, d))


@query(f"WITH {R}, {_X} SELECT a.bi, a.bj, a.r, a.c, a.v * (y.v - x.v) v FROM a JOIN x ON a.bi = x.b JOIN x y ON a.bj = y.b")
def commutator_diagonal(s, d):
    return ew.commutator_diagonal(_r(s, d), _x(s, d))


@query(f"WITH {B} SELECT bj bi, bi bj, c r, r c, v FROM m")
def transpose(s, d):
    return ew.transpose(_b(s, d))


@query(f"WITH {B}, k AS (SELECT bi, bj FROM m GROUP BY 1, 2 HAVING sqrt(sum(v * v)) >= 900.5) SELECT m.* FROM m SEMI JOIN k ON m.bi = k.bi AND m.bj = k.bj")
def filter_blocks(s, d):
    return ew.filter_blocks(_b(s, d), 900.5)


@query(f"WITH {B} SELECT bi, bj, r, c, CASE WHEN bi = bj THEN 0 ELSE v END v FROM m")
def zero_diagonal_blocks(s, d):
    return ew.zero_diagonal_blocks(_b(s, d))


@query(f"WITH {B} SELECT bi, bj, r, c, v FROM m WHERE bi <> bj UNION ALL SELECT bi, bj, r, c, sum(v) FROM (SELECT bi, bj, r, c, v / 2 v FROM m WHERE bi = bj UNION ALL SELECT bj, bi, c, r, v / 2 FROM m WHERE bi = bj) GROUP BY 1, 2, 3, 4")
def hermitize_diagonal_blocks(s, d):
    return ew.hermitize_diagonal_blocks(_b(s, d))


@query(f"WITH {B} SELECT r, c, v FROM m WHERE bi = 3 AND bj = 3")
def get_block(s, d):
    return ew.get_block(_b(s, d), 3, 3)


_IDS = "ids AS (SELECT p_partkey old, CAST(p_partkey // 2 AS BIGINT) AS new FROM part WHERE p_partkey % 2 = 0)"


def _ids(s, d):
    return generate.read(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("old"), F.floor(F.col("p_partkey") / 2).cast("long").alias("new"))


@query(f"WITH {R}, {_IDS} SELECT x.new bi, y.new bj, r, c, v FROM a JOIN ids x ON a.bi = x.old JOIN ids y ON a.bj = y.old")
def extract(s, d):
    return ew.extract(_r(s, d), _ids(s, d))


@query(f"WITH {_AB}, {_IDS} SELECT n.bi, n.bj, n.r, n.c, coalesce(CASE WHEN a.bi % 2 = 0 AND a.bj % 2 = 0 THEN a.v END, n.v) v FROM n LEFT JOIN a ON a.bi = n.bi AND a.bj = n.bj")
def insert(s, d):
    ids = _ids(s, d)
    return ew.insert(_n(s, d), ew.extract(_r(s, d), ids), ids)


# -- assembly --------------------------------------------------------------------
def _log(s, d, mode):
    x = generate.read(s, d, "lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 50).alias("bi"), (F.col("l_suppkey") % 50).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"), mode.alias("mode"))


_LOG = "u AS (SELECT l_orderkey * 10 + l_linenumber seq, l_partkey % 50 bi, l_suppkey % 50 bj, 0 r, 0 c, l_quantity v, {0} mode FROM lineitem)"
_REPLAY = "SELECT bi, bj, r, c, sum(v) v FROM (SELECT *, max(CASE WHEN mode = 'INSERT' THEN seq END) OVER (PARTITION BY bi, bj) l FROM u) WHERE l IS NULL OR seq >= l GROUP BY 1, 2, 3, 4"


@query("WITH " + _LOG.format("'ADD'") + " " + _REPLAY)
def assemble_add(s, d):
    return ew.assemble(_log(s, d, F.lit("ADD")))


@query("WITH " + _LOG.format("'INSERT'") + " " + _REPLAY)
def assemble_insert(s, d):
    return ew.assemble(_log(s, d, F.lit("INSERT")))


@query("WITH " + _LOG.format("CASE WHEN l_returnflag = 'R' THEN 'INSERT' ELSE 'ADD' END") + " " + _REPLAY)
def assemble_mixed(s, d):
    return ew.assemble(_log(s, d, F.when(F.col("l_returnflag") == "R", "INSERT").otherwise("ADD")))


_GRID = "g AS (SELECT i bi, j bj, 0 r, 0 c FROM range(9) x(i), range(5) y(j))"


def _grid(s):
    return s.range(9).select(F.col("id").alias("bi"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"))


@query(f"WITH {_GRID}, u AS (SELECT l_partkey % 7 bi, l_suppkey % 5 bj, sum(l_quantity) v FROM lineitem GROUP BY 1, 2) SELECT g.bi, g.bj, r, c, coalesce(v, 0) v FROM g LEFT JOIN u ON u.bi = g.bi AND u.bj = g.bj")
def redistribute_sum(s, d):
    x = generate.read(s, d, "lineitem").select((F.col("l_partkey") % 7).alias("bi"), (F.col("l_suppkey") % 5).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"))
    return ew.redistribute(x, _grid(s), "ADD")


@query(f"WITH {_GRID}, u AS (SELECT l_partkey % 12 bi, l_suppkey % 12 bj, sum(l_quantity) v FROM lineitem GROUP BY 1, 2) SELECT g.bi, g.bj, r, c, coalesce(v, 0) v FROM g LEFT JOIN u ON u.bi = g.bi AND u.bj = g.bj")
def redistribute_copy(s, d):
    return ew.redistribute(_entries(s, d, "l_partkey % 12", "l_suppkey % 12"), _grid(s))


@query(f"WITH {R}, ids AS (SELECT p_partkey % 3 batch, p_partkey old, CAST(p_partkey // 3 AS BIGINT) AS new FROM part) SELECT x.batch, x.new bi, y.new bj, r, c, v FROM a JOIN ids x ON a.bi = x.old JOIN ids y ON a.bj = y.old AND x.batch = y.batch")
def extract_batched(s, d):
    k = F.col("p_partkey")
    return ew.extract_batched(_r(s, d), generate.read(s, d, "part").select((k % 3).alias("batch"), k.alias("old"), F.floor(k / 3).cast("long").alias("new")))


@query("SELECT l_linenumber - 4 rx, 0 ry, 0 rz, l_partkey % 20 bi, l_suppkey % 20 bj, 0 r, 0 c, sum(v) v FROM (SELECT *, CASE WHEN l IS NULL OR seq >= l THEN l_quantity ELSE 0 END v, (l IS NULL OR seq >= l) keep FROM (SELECT *, l_orderkey * 10 + l_linenumber seq, max(CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) OVER (PARTITION BY l_linenumber, l_partkey % 20, l_suppkey % 20) l FROM lineitem)) WHERE keep GROUP BY 1, 4, 5")
def image_assemble(s, d):
    x = generate.read(s, d, "lineitem")
    log = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_linenumber") - 4).alias("rx"), F.lit(0).alias("ry"), F.lit(0).alias("rz"), (F.col("l_partkey") % 20).alias("bi"), (F.col("l_suppkey") % 20).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"), F.when(F.col("l_returnflag") == "R", "INSERT").otherwise("ADD").alias("mode"))
    return ew.assemble(log, keys=("rx", "ry", "rz", "bi", "bj"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, user_id % 20 bi, length(event_type) bj, CAST(user_id % 3 AS INTEGER) r, CAST(event_id % 2 AS INTEGER) c, CAST(sum(event_id) AS BIGINT) v, count(*) n FROM events GROUP BY 1, 2, 3, 4, 5")
def streaming_assembly_batch(s, d):
    x = generate.read(s, d, "events").select("ts", (F.col("user_id") % 20).alias("bi"), F.length("event_type").cast("long").alias("bj"), (F.col("user_id") % 3).cast("int").alias("r"), (F.col("event_id") % 2).cast("int").alias("c"), F.col("event_id").alias("v"))
    return assemble_stream(x, "ts").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), *PLACE, "v", "n")


# -- block metadata -----------------------------------------------------------------
@query(f"WITH {B} SELECT bi, bj, CAST(round(sum(v * v)) AS BIGINT) norm2, count(*) n FROM m GROUP BY 1, 2")
def block_norms(s, d):
    return ew.block_norms(_b(s, d)).select("bi", "bj", F.round(F.col("norm") * F.col("norm")).cast("long").alias("norm2"), "n")


@query(f"WITH {B} SELECT CAST(round(sum(v * v)) AS BIGINT) frobenius2, max(abs(v)) maxabs FROM m")
def frobenius(s, d):
    return ew.frobenius(_b(s, d)).select(F.round(F.col("frobenius") * F.col("frobenius")).cast("long").alias("frobenius2"), "maxabs")


@query(f"WITH {B} SELECT CAST(sum(n) AS BIGINT) nnz, count(*) blocks, round(count(*) / 640000.0, 9) density FROM (SELECT count(*) n FROM m GROUP BY bi, bj)")
def counts(s, d):
    return ew.counts(_b(s, d), 800).withColumn("density", F.round("density", 9))


@query(f"WITH {B} SELECT CAST(h AS BIGINT) \"rows\", CAST(w AS BIGINT) cols, count(*) blocks FROM (SELECT max(r) + 1 h, max(c) + 1 w FROM m GROUP BY bi, bj) GROUP BY 1, 2")
def shape_classes(s, d):
    return ew.shapes(_b(s, d))


@query(f"WITH {B} SELECT bi, array_to_string(list(bj ORDER BY bj), ',') cols, count(*) n FROM (SELECT DISTINCT bi, bj FROM m) GROUP BY 1")
def csr_arrays(s, d):
    return ew.row_pointers(_b(s, d)).select("bi", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"), "n")


_DIMS = f"dims AS (SELECT CAST({_BLK.format('p_partkey')} AS BIGINT) b, count(*) n FROM part GROUP BY 1), off AS (SELECT b, n, CAST(sum(n) OVER (ORDER BY b) - n AS BIGINT) off FROM dims)"


def _dims(s, d):
    x = generate.blocked(generate.read(s, d, "part").select(F.col("p_partkey").alias("bi"), F.col("p_partkey").alias("bj"), F.lit(0.0).alias("v")))
    return ew.offsets(x.groupBy(F.col("bi").alias("b")).agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_DIMS} SELECT * FROM off")
def block_offsets(s, d):
    return _dims(s, d)


@query(f"WITH {B}, {_DIMS} SELECT x.off + r i, y.off + c j, v FROM m JOIN off x ON m.bi = x.b JOIN off y ON m.bj = y.b")
def block_to_csr(s, d):
    return ew.expand(_b(s, d), _dims(s, d))


@query(f"WITH {R} SELECT bi i, bj j, printf('%d %d %.16e', bi + 1, bj + 1, v) line FROM a UNION ALL SELECT -1, -1, '%%MatrixMarket matrix coordinate real general' || chr(10) || '2000 2000 ' || (SELECT count(*) FROM a)")
def matrix_market(s, d):
    return formats.matrix_market(_r(s, d).select(F.col("bi").alias("i"), F.col("bj").alias("j"), "v"), 2000)


@query("SELECT DISTINCT l_suppkey b FROM lineitem WHERE l_partkey % 2 = 0 AND NOT (l_suppkey % 2 = 0)")
def ghost_blocks(s, d):
    ids = generate.read(s, d, "part").select(F.col("p_partkey").alias("b"), F.lit(1).alias("n"))
    graph = BlockGraph(ids, _ps(s, d).select("bi", "bj"))
    return graph.ghosts(ids.where("b % 2 = 0"))


@query("SELECT true AS same, false AS after_filter, true AS still_contained")
def structure_tests(s, d):
    a = _b(s, d)
    whole, part = BlockGraph.of(a), BlockGraph(BlockGraph.of(a).dims, ew.filter_blocks(a, 900.5).select("bi", "bj"))
    return s.createDataFrame([(whole.same(BlockGraph.of(a)), whole.same(part), whole.contains(part))], "same boolean, after_filter boolean, still_contained boolean")


@query(f"WITH {S1} SELECT bi, bj, r, c, v FROM a")
def csr_round_trip(s, d):
    data, ind, ptr = BlockMatrix.of(_s1(s, d)).to_scipy()
    return BlockMatrix.from_csr(s, ptr, ind, data).df


@query(f"WITH {S} SELECT bi, bj, r, c, -v v FROM m")
def dense_round_trip(s, d):
    m = BlockMatrix.of(_s(s, d))
    m.from_dense(-m.to_dense())
    return m.df


# -- vectors -----------------------------------------------------------------------
@query(f"WITH {_X} SELECT sum(v * v) v FROM x")
def dot(s, d):
    x = _x(s, d)
    return pr.dot(x, x)


@query(f"WITH {_MX} SELECT col, sum(v * v) v FROM mx GROUP BY 1")
def bdot(s, d):
    x = _mvec(s, d)
    return pr.dot(x, x)


@query("SELECT b, 0 r, sum(v) v FROM (SELECT p_partkey b, CAST(2 * p_size AS DOUBLE) v FROM part UNION ALL SELECT s_suppkey, CAST(3 * s_nationkey AS DOUBLE) FROM supplier) GROUP BY 1")
def axpby_vector(s, d):
    y = generate.read(s, d, "supplier").select(F.col("s_suppkey").alias("b"), F.lit(0).alias("r"), F.col("s_nationkey").cast("double").alias("v"))
    return pr.vector_axpby(2.0, _x(s, d), 3.0, y)


@query(f"WITH {_MX} SELECT mx.b, mx.r, col, mx.v * x.v v FROM mx JOIN x ON mx.b = x.b")
def pointwise(s, d):
    return pr.pointwise(_mvec(s, d), _x(s, d))


@query(f"WITH {_MX} SELECT b, r, CASE WHEN col = 1 THEN 2 * v ELSE v END v, CAST(col AS INTEGER) col FROM (SELECT b, r, col, CASE WHEN col = 1 THEN v - 1 ELSE v END v FROM mx)")
def multivector_columns(s, d):
    ids = generate.read(s, d, "part").select(F.col("p_partkey").alias("b"), F.lit(1).alias("n"))
    x = MultiVector(BlockGraph(ids, ids.select(F.col("b").alias("bi"), F.col("b").alias("bj"))), _mvec(s, d), k=3)
    x.set_col(1, x.get_col(0) * 2.0)
    return x.df


@query("SELECT p_partkey b, 0 r, 2.5 - CAST(p_size AS DOUBLE) v FROM part")
def vector_arithmetic(s, d):
    ids = generate.read(s, d, "part").select(F.col("p_partkey").alias("b"), F.lit(1).alias("n"))
    x = Vector(BlockGraph(ids, ids.select(F.col("b").alias("bi"), F.col("b").alias("bj"))), _x(s, d))
    y = x.copy()
    y.set_constant(2.5)
    return (y - x).df


# -- complex ----------------------------------------------------------------------
@query(f"WITH {_CX}, {_X} SELECT z.bi b, 0 r, sum(z.v * x.v) v, sum(z.w * x.v) w FROM z JOIN x ON z.bj = x.b GROUP BY 1")
def complex_spmv(s, d):
    return pr.spmv(_cplx(s, d), _x(s, d).withColumn("w", F.lit(0.0)))


@query(f"WITH {_CX} SELECT bj bi, bi bj, c r, r c, v, -w w FROM z")
def complex_conj_transpose(s, d):
    return ew.transpose(_cplx(s, d))


@query(f"WITH {_CX} SELECT x.bi, y.bi bj, 0 r, 0 c, sum(x.v * y.v + x.w * y.w) v, sum(x.w * y.v - x.v * y.w) w FROM z x JOIN z y ON x.bj = y.bj GROUP BY 1, 2")
def complex_spgemm(s, d):
    z = _cplx(s, d)
    return pr.spgemm(z, z, trans_b=True)


@query(f"WITH {_CX} SELECT bi, bj, r, c, w v FROM z")
def complex_imag(s, d):
    return ew.imag(_cplx(s, d))


@query(f"WITH {_CX} SELECT bi, bj, r, c, v FROM z")
def complex_real(s, d):
    return ew.real(_cplx(s, d))


@query(f"WITH {_CX} SELECT bi, bj, r, c, v, -w w FROM z")
def complex_conjugate(s, d):
    return ew.conjugate(_cplx(s, d))


# -- atoms ----------------------------------------------------------------------
def _atoms(s, d):
    e = F.col("embedding")
    return generate.read(s, d, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").alias("type"), *(e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "zc"))))


_AT = "atm AS (SELECT vec_id gid, label t, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings)"
_D2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
_ED = f"ed AS (SELECT a.gid src, b.gid dst, 0 rx, 0 ry, 0 rz FROM atm a JOIN atm b ON a.gid <> b.gid WHERE {_D2} < 0.08 * 0.08 AND sqrt({_D2}) <= CASE WHEN a.t = 0 THEN 0.03 ELSE 0.04 END + CASE WHEN b.t = 0 THEN 0.03 ELSE 0.04 END + 1e-9)"


@query(f"WITH {_AT} SELECT a.gid src, b.gid dst FROM atm a JOIN atm b ON a.gid <> b.gid WHERE {_D2} < 0.05 * 0.05")
def neighbour_list(s, d):
    return atomic.neighbours(_atoms(s, d), 0.05).select("src", "dst")


@query(f"WITH {_AT}, {_ED} SELECT * FROM ed")
def edges_by_type(s, d):
    return atomic.edges(_atoms(s, d), [0.03, 0.04])


@query(f"WITH {_AT}, {_ED} SELECT x.dst src, y.dst dst, 0 rx, 0 ry, 0 rz FROM ed x JOIN ed y ON x.src = y.src WHERE x.dst <> y.dst UNION SELECT * FROM ed")
def graph3b(s, d):
    return triples.three_body(_atoms(s, d), 0.08, [0.03, 0.04], [0.03, 0.04])


# -- a cell: periodic along x and y, atoms may lie outside
_CELL = [[1.5, 0.0, 0.0], [0.3, 1.4, 0.0], [0.0, 0.0, 9.0]]
_IMG = "im AS (SELECT CAST(i - 3 AS INTEGER) rx, CAST(j - 3 AS INTEGER) ry FROM range(7) t(i), range(7) u(j))"
_VEC = "(b.x + 1.5 * rx + 0.3 * ry - a.x) dx, (b.y + 1.4 * ry - a.y) dy, (b.z - a.z) dz"
_PER = f"pe AS (SELECT a.gid src, b.gid dst, rx, ry, 0 rz, a.t ta, b.t tb, {_VEC} FROM atm a JOIN im ON true JOIN atm b ON abs(b.z - a.z) < 0.05 AND abs(b.y + 1.4 * ry - a.y) < 0.05 AND abs(b.x + 1.5 * rx + 0.3 * ry - a.x) < 0.05 WHERE NOT (a.gid = b.gid AND rx = 0 AND ry = 0)), pn AS (SELECT * FROM pe WHERE dx * dx + dy * dy + dz * dz < 0.05 * 0.05)"


def _periodic(s, d):
    return atomic.neighbours(_atoms(s, d), 0.05, _CELL, (True, True, False))


@query(f"WITH {_AT}, {_IMG}, {_PER} SELECT src, dst, rx, ry, rz FROM pn")
def neighbour_list_periodic(s, d):
    return _periodic(s, d).select("src", "dst", "rx", "ry", "rz")


@query(f"WITH {_AT}, {_IMG}, {_PER} SELECT src, dst, rx, ry, rz, round(dx, 6) + 0.0 dx, round(dy, 6) + 0.0 dy, round(dz, 6) + 0.0 dz FROM pn")
def edge_vectors(s, d):
    e = _periodic(s, d).drop("d2")
    v = atomic.edge_vectors(_atoms(s, d), e, _CELL)
    return v.select("src", "dst", "rx", "ry", "rz", *((F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "dz")))


@query(f"WITH {_AT}, {_IMG}, {_PER}, nr AS (SELECT * FROM pn WHERE sqrt(dx * dx + dy * dy + dz * dz) <= CASE WHEN ta = 0 THEN 0.02 ELSE 0.03 END + CASE WHEN tb = 0 THEN 0.01 ELSE 0.015 END + 1e-9) SELECT x.dst src, y.dst dst, y.rx - x.rx rx, y.ry - x.ry ry, 0 rz FROM nr x JOIN nr y ON x.src = y.src WHERE NOT (x.dst = y.dst AND x.rx = y.rx AND x.ry = y.ry) UNION SELECT src, dst, rx, ry, rz FROM pn")
def graph3b_radii(s, d):
    return triples.three_body(_atoms(s, d), 0.05, [0.02, 0.03], [0.01, 0.015], _CELL, (True, True, False), by_vectors=True)


_UNSKEW = "((x - 0.3 * y / 1.4) / 1.5)"


@query(f"""WITH {_AT}, {_IMG}, {_PER}, f AS (SELECT gid, {_UNSKEW} u, y / 1.4 w FROM atm),
 p AS (SELECT src bi, dst bj, -2 * pi() * (0.1 * (rx + g.u - f.u) + 0.2 * (ry + g.w - f.w)) t FROM pn JOIN f ON f.gid = src JOIN f g ON g.gid = dst)
 SELECT bi, bj, 0 r, 0 c, round(sum(2.0 * cos(t)), 6) + 0.0 v, round(sum(2.0 * sin(t)), 6) + 0.0 w FROM p GROUP BY 1, 2""")
def sample_k_positions(s, d):
    near = atomic.neighbours(_atoms(s, d), 0.05, _CELL, (True, True, False), places=True)
    e = near.select(*[c for c in near.columns if c.startswith("_")], "rx", "ry", "rz", F.col("src").alias("bi"), F.col("dst").alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(2.0).alias("v"))
    out = atomic.sample_k(e, (0.1, 0.2, 0.0), tau=(_atoms(s, d), _CELL))
    return out.select(*PLACE, (F.round("v", 6) + 0.0).alias("v"), (F.round("w", 6) + 0.0).alias("w"))


@query("SELECT l_partkey % 30 bi, l_suppkey % 30 bj, 0 r, 0 c, sum(CASE WHEN l_linenumber > 2 THEN l_quantity * (l_linenumber - 2) ELSE 0 END) v, sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) w FROM lineitem GROUP BY 1, 2")
def weighted_images(s, d):
    x = generate.read(s, d, "lineitem").select((F.col("l_linenumber") - 2).alias("rx"), F.lit(0).alias("ry"), F.lit(0).alias("rz"), (F.col("l_partkey") % 30).alias("bi"), (F.col("l_suppkey") % 30).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"))
    use = F.col("rx") > 0
    return atomic.weighted_images(x, (F.when(use, F.col("rx").cast("double")).otherwise(0.0), F.when(use, 1.0).otherwise(0.0)))


@query(f"WITH {_AT} SELECT gid, round({_UNSKEW}, 9) + 0.0 f0, round(y / 1.4, 9) + 0.0 f1, round(z / 9.0, 9) + 0.0 f2 FROM atm")
def fractional_coordinates(s, d):
    return _atoms(s, d).select("gid", *((F.round(f, 9) + 0.0).alias(f"f{i}") for i, f in enumerate(atomic.fractional(_CELL))))


@query(f"WITH {_AT}, c AS (SELECT gid, list_transform([x, y, z], lambda q: CAST(least(greatest(floor((q + 2.0) / 4.0 * 2097152), 0), 2097151) AS BIGINT)) q FROM atm) SELECT gid, CAST(list_sum(list_transform(range(63), lambda k: ((q[k % 3 + 1] >> CAST(k // 3 AS INTEGER)) & 1) * (1::BIGINT << CAST(k AS INTEGER)))) AS BIGINT) code FROM c")
def morton_codes(s, d):
    return partition.morton(_atoms(s, d), (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0)).select("gid", "code")


@query("""SELECT l_partkey % 30 bi, l_suppkey % 30 bj, 0 r, 0 c, round(sum(l_quantity * cos(-2 * pi() * (l_linenumber - 4) * 0.25)), 4) + 0.0 v,
 round(sum(l_quantity * sin(-2 * pi() * (l_linenumber - 4) * 0.25)), 4) + 0.0 w FROM lineitem GROUP BY 1, 2""")
def sample_k(s, d):
    x = generate.read(s, d, "lineitem").select((F.col("l_linenumber") - 4).alias("rx"), F.lit(0).alias("ry"), F.lit(0).alias("rz"), (F.col("l_partkey") % 30).alias("bi"), (F.col("l_suppkey") % 30).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"))
    # + 0.0 turns a rounded -0.0 into 0.0
    return atomic.sample_k(x, (0.25, 0.0, 0.0)).select(*PLACE, (F.round("v", 4) + 0.0).alias("v"), (F.round("w", 4) + 0.0).alias("w"))


# -- generators and spectral methods ----------------------------------------------------
@query("""WITH s AS (SELECT i, i % 6 x, i // 6 y FROM range(30) t(i)), h AS (SELECT i bi, i bj, 4.1 v FROM s UNION ALL SELECT i, (x + 1) % 6 + y * 6, -1 FROM s
 UNION ALL SELECT i, (x + 5) % 6 + y * 6, -1 FROM s UNION ALL SELECT i, x + (y + 1) % 5 * 6, -1 FROM s UNION ALL SELECT i, x + (y + 4) % 5 * 6, -1 FROM s)
 SELECT bi, bj, 0 r, 0 c, CAST(sum(v) AS DOUBLE) v FROM h GROUP BY 1, 2""")
def poisson_entries(s, d):
    return generate.poisson(s, 6, 5)


@query("""WITH s AS (SELECT i, i % 2 u, (i // 2) % 4 x, i // 8 y, CASE WHEN i % 2 = 0 THEN -1 ELSE 1 END t FROM range(32) g(i)),
 h AS (SELECT i bi, i bj, 0.0 v FROM s UNION ALL SELECT i, 2 * (x + y * 4) + 1 - u, -2.7 FROM s UNION ALL SELECT i, 2 * ((x + t + 4) % 4 + y * 4) + 1 - u, -2.7 FROM s
 UNION ALL SELECT i, 2 * (x + (y + t + 4) % 4 * 4) + 1 - u, -2.7 FROM s) SELECT bi, bj, 0 r, 0 c, CAST(sum(v) AS DOUBLE) v, 0.0::DOUBLE w FROM h GROUP BY 1, 2""")
def graphene_entries(s, d):
    return generate.graphene(s, 4, 4)


@query("SELECT i b, CASE WHEN i % 8 < 4 THEN 3 ELSE 6 END n FROM range(64) t(i)")
def truss_beam_dims(s, d):
    return generate.truss_beam_dims(s, 8, 8)


@query("WITH g AS (SELECT i, i % 3 x, (i // 3) % 4 y, i // 12 z, CASE WHEN i // 12 < 2 THEN 3 ELSE 6 END n FROM range(48) t(i)), e AS (SELECT a.i bi, b.i bj, a.n, b.n m FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1) SELECT bi, bj, CAST(r AS INTEGER) r, CAST(c AS INTEGER) c, CAST(CASE WHEN bi = bj AND r = c THEN 100 ELSE 0 END AS DOUBLE) v FROM e, range(6) p(r), range(6) q(c) WHERE r < n AND c < m")
def truss_beam_stiffness(s, d):
    return generate.truss_beam(s, 3, 4, 4)[1].select(*PLACE, F.when(F.col("bi") == F.col("bj"), F.col("v")).otherwise(0.0).alias("v"))


@query("SELECT * FROM (VALUES (49, 1 + 10 * 3 * 4 * 7 // 6 + 6), (15, 10 * 3 * 4 * 2 // 3 + 12), (1, 20 * 9 + 12 * 3 + 4)) v(z, n)")
def nanocrystal_counts(s, d):
    return crystals.nanocrystal(s, 6).groupBy("z").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT i gid, CASE WHEN i % 3 = 0 THEN 42 ELSE 16 END z, round(CAST((i // 6) % 5 + [0, 1, 1, 1.5, 2.5, 2.5][i % 6 + 1] / 3 AS DOUBLE) * sqrt(3) * 3.16, 6) x, round(CAST(i // 30 + CASE WHEN i % 6 < 3 THEN 0 ELSE 0.5 END AS DOUBLE) * 3.16 * 1.02, 6) y FROM range(120) t(i)")
def trilayer_sheet(s, d):
    flat, strained = (crystals.trilayer(s, 5, 4, profile=p, strain=e, biaxial=p == "uniform")[0] for p, e in (("flat", 0.0), ("uniform", 0.02)))
    return flat.select("gid", "z", F.round("x", 6).alias("x")).join(strained.select("gid", F.round("y", 6).alias("y")), "gid")


@query("SELECT k, round(((64 - k + 1) * cos(pi() * k / 65) + sin(pi() * k / 65) / tan(pi() / 65)) / 65, 9) g FROM range(64) t(k)")
def jackson_kernel(s, d):
    return s.createDataFrame([(k, float(g)) for k, g in enumerate(jackson(64))], "k long, g double").select("k", F.round("g", 9).alias("g"))


@query(f"WITH {_co('a')}, e AS (SELECT bi, sum(CASE WHEN bi = bj THEN v ELSE 0 END) d, sum(CASE WHEN bi <> bj THEN abs(v) ELSE 0 END) s FROM a GROUP BY 1), m AS (SELECT min(d - s) lo, max(d + s) hi FROM e) SELECT round(lo - greatest(0.01 * (hi - lo) / 2, 1e-6), 3) lo, round(hi + greatest(0.01 * (hi - lo) / 2, 1e-6), 3) hi FROM m")
def gershgorin(s, d):
    x = pr.gershgorin(_r(s, d))
    return x.select(F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


# Two coupled sites for each supplier, [[a, b], [b, a]] with eigenvalues a + b and a - b: every function of it has a closed form.
_PAIR = "h AS (SELECT s_suppkey k, (10 + s_suppkey % 5) / 20.0 a, (1 + s_suppkey % 7) / 24.0 b, CAST(1 + s_nationkey % 3 AS DOUBLE) x, CAST(s_suppkey % 4 AS DOUBLE) y FROM supplier)"


def _pair(s, d):
    k = F.col("s_suppkey")
    x = generate.read(s, d, "supplier").select(k, ((10 + k % 5) / 20.0).alias("a"), ((1 + k % 7) / 24.0).alias("b"))
    e = lambda i, j, v: F.struct((2 * k + i).alias("bi"), (2 * k + j).alias("bj"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col(v).alias("v"))
    return x.select(F.explode(F.array(e(0, 0, "a"), e(1, 1, "a"), e(0, 1, "b"), e(1, 0, "b"))).alias("e")).select("e.*")


def _pair_vector(s, d):
    k = F.col("s_suppkey")
    x = generate.read(s, d, "supplier")
    e = lambda i, v: F.struct((2 * k + i).alias("b"), F.lit(0).alias("r"), v.cast("double").alias("v"))
    return x.select(F.explode(F.array(e(0, 1 + F.col("s_nationkey") % 3), e(1, k % 4))).alias("e")).select("e.*")


def _of_pair(f: str) -> str:
    """Entries of f on the pairs; ``f`` holds {0} for the eigenvalue."""
    hi, lo = f.format("(a + b)"), f.format("(a - b)")
    return f"WITH {_PAIR} SELECT 2 * k + i bi, 2 * k + j bj, 0 r, 0 c, round(({hi} + CASE WHEN i = j THEN 1 ELSE -1 END * {lo}) / 2, 7) v FROM h, range(2) u(i), range(2) w(j)"


def _vector_of_pair(f: str) -> str:
    """f times the vector (x, y) on the pairs."""
    hi, lo = f.format("(a + b)"), f.format("(a - b)")
    return f"WITH {_PAIR} SELECT 2 * k + i b, 0 r, round({hi} * (x + y) / 2 + CASE WHEN i = 0 THEN 1 ELSE -1 END * {lo} * (x - y) / 2, 6) + 0.0 v FROM h, range(2) u(i)"


def _spmf(name):
    def run(s, d):
        return iterate.graph_function(_pair(s, d), name).withColumn("v", F.round("v", 7))

    run.__name__ = f"spmf_{name}"
    return run


for _name, _f in (("exp", "exp({0})"), ("sqrt", "sqrt({0})"), ("inv", "(1 / ({0} + 1e-10))"), ("isqrt", "(1 / (sqrt({0}) + 1e-10))")):
    query(_of_pair(_f))(_spmf(_name))


@query(_of_pair("({0} * {0} * {0})"))
def spmf_dense_action(s, d):
    return iterate.graph_function(_pair(s, d), "exp", lambda m, cols: (m @ m @ m)[:, cols]).withColumn("v", F.round("v", 7))


def _rounded(x):
    return x.select("b", F.lit(0).alias("r"), (F.round("v", 6) + 0.0).alias("v"))


@query(_vector_of_pair("(1 / {0})"))
def cg_solution(s, d):
    return _rounded(iterate.conjugate_gradients(_pair(s, d), _pair_vector(s, d), 60, 1e-10)[0])


@query(_vector_of_pair("(1 / {0})"))
def preconditioned_cg(s, d):
    a = _pair(s, d)
    return _rounded(iterate.preconditioned_gradients(a, _pair_vector(s, d), iterate.half_preconditioner(iterate.cut(iterate.graph_function(a, "isqrt"))), 20, 1e-10)[0])


_MOMENT = f"WITH {_PAIR} SELECT k2 k, round(sum(cos(k2 * acos(a + b)) * (x + y) * (x + y) / 2 + cos(k2 * acos(a - b)) * (x - y) * (x - y) / 2), 5) + 0.0 mu FROM h, range(8) u(k2) GROUP BY 1"


@query(_MOMENT)
def kpm_moments(s, d):
    mu = iterate.kpm_moments(ew.scale(_pair(s, d), 1.0), _pair_vector(s, d), 8)
    return s.createDataFrame([(k, float(m)) for k, m in enumerate(mu)], "k long, mu double").select("k", (F.round("mu", 5) + 0.0).alias("mu"))


_COEF = chebyshev_coefficients(np.exp, 12, 0.5, 0.6)
_CHEB = "(" + " + ".join(f"({c!r}) * cos({j} * acos(({{0}} - 0.5) / 0.6))" for j, c in enumerate(_COEF.tolist())) + ")"


@query(_vector_of_pair(_CHEB))
def kpm_apply(s, d):
    return _rounded(iterate.kpm_apply(_pair(s, d), _pair_vector(s, d), np.exp, 12, 0.5, 0.6))


@query(f"""WITH {_PAIR}, m AS (SELECT n, sum(cos(n * acos(a + b)) * (x + y) * (x + y) / 2 + cos(n * acos(a - b)) * (x - y) * (x - y) / 2) / 100 mu FROM h, range(8) u(n) GROUP BY 1),
 g AS (SELECT n, mu * ((8 - n + 1) * cos(pi() * n / 9) + sin(pi() * n / 9) / tan(pi() / 9)) / 9 mu FROM m), e AS (SELECT i, cos(pi() * (19 - i + 0.5) / 20) x FROM range(20) t(i))
 SELECT i, round(sum(CASE WHEN n = 0 THEN mu ELSE 2 * mu * cos(n * acos(e.x)) END) / (pi() * sqrt(1 - any_value(e.x) * any_value(e.x))), 5) + 0.0 dos FROM e, g GROUP BY i""")
def kpm_dos(s, d):
    mu = iterate.kpm_moments(_pair(s, d), _pair_vector(s, d), 8)
    dos = iterate.density_of_states(mu, 100.0, 1.0, 20)[1]
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(dos)], "i long, dos double").select("i", (F.round("dos", 5) + 0.0).alias("dos"))


@query(f"WITH {_PAIR} SELECT 2 * k + i b, 0 r, round(cos(2 * a) * cos(2 * b) * p - sin(2 * a) * sin(2 * b) * q, 6) + 0.0 v, round(-sin(2 * a) * cos(2 * b) * p - cos(2 * a) * sin(2 * b) * q, 6) + 0.0 w FROM (SELECT *, CASE WHEN i = 0 THEN x ELSE y END p, CASE WHEN i = 0 THEN y ELSE x END q FROM h, range(2) u(i))")
def propagation(s, d):
    zero = lambda x: x.withColumn("w", F.lit(0.0))
    out = iterate.propagate(zero(_pair(s, d)), zero(_pair_vector(s, d)), 2.0, 24, 1.2)
    return out.select("b", F.lit(0).alias("r"), (F.round("v", 6) + 0.0).alias("v"), (F.round("w", 6) + 0.0).alias("w"))


_UNDER = "CASE WHEN {0} < 0.62 THEN 1.0 ELSE 0.0 END"


@query(_of_pair(f"({_UNDER})").replace(", 7) v", ", 4) + 0.0 v"))
def purification(s, d):
    p = iterate.purify(_pair(s, d), 0.04, 1.2, 0.0, 40, 1e-12)[0]
    return p.select(*PLACE, (F.round("v", 4) + 0.0).alias("v"))


@query("SELECT p_partkey b, round(1 / (1 + exp((p_size - 25.0) * 0.3)), 9) f, round(exp(-(p_size / 10.0 - 2.5) * (p_size / 10.0 - 2.5)), 9) g, round(cos(3 * acos(p_size / 50.0)), 9) t3 FROM part")
def spectral_functions(s, d):
    x = generate.read(s, d, "part").select(F.col("p_partkey").alias("b"), F.col("p_size").cast("double").alias("e"))
    return x.select("b", F.round(fermi_dirac(F.col("e"), 25.0, 0.3), 9).alias("f"), F.round(gaussian(F.col("e") / 10.0, 2.5), 9).alias("g"), F.round(chebyshev_values(4, F.col("e") / 50.0)[3], 9).alias("t3"))


# Random vectors: the counter hash in whole numbers modulo 2^64.
def _mix(of: str, name: str, x: str) -> str:
    """CTEs that hash ``x`` (UBIGINT) of ``of`` into column h of ``name``."""
    up = lambda e: f"CAST(({e}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    big = lambda e: f"CAST({e} AS UHUGEINT)"
    return (f"{name}1 AS (SELECT *, {up(big(x) + f' + {STEP}::UHUGEINT')} z FROM {of}), {name}2 AS (SELECT * EXCLUDE (z), {up(big('xor(z, z >> 30)') + f' * {MUL_1}::UHUGEINT')} z FROM {name}1), "
            f"{name}3 AS (SELECT * EXCLUDE (z), {up(big('xor(z, z >> 27)') + f' * {MUL_2}::UHUGEINT')} z FROM {name}2), {name} AS (SELECT * EXCLUDE (z), xor(z, z >> 31) h FROM {name}3)")


def _hashed() -> str:
    up = lambda e, k: f"CAST((CAST({e} AS UHUGEINT) * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    steps = [_mix("(SELECT p_partkey b, col FROM part, range(2) t(col))", "h0", f"{(7 + STEP) & MASK}::UBIGINT")]
    for n, (key, k) in enumerate((("b", KEY_BLOCK), ("0", KEY_ROW), ("col", KEY_COL))):
        steps.append(_mix(f"(SELECT * EXCLUDE (h), xor(h, {up(key, k)}) y FROM h{n})", f"g{n}", "y"))
        steps.append(f"h{n + 1} AS (SELECT * EXCLUDE (y) FROM g{n})")
    return ", ".join(steps)


@query(f"WITH {_hashed()} SELECT b, 0 r, CAST(col AS INTEGER) col, CAST(CASE WHEN h >> 63 = 1 THEN 1 ELSE -1 END AS DOUBLE) v, round(cos(2 * pi() * CAST(h >> 11 AS DOUBLE) / 9007199254740992.0), 9) + 0.0 phase FROM h3")
def random_vectors(s, d):
    x = generate.read(s, d, "part").select(F.col("p_partkey").alias("b"), F.lit(0).alias("r"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"))
    at = (F.col("b"), F.col("r"), F.col("col"))
    return x.select("b", "r", "col", random_values("rademacher", 7, False)(*at)["v"].alias("v"), (F.round(random_values("phase", 7, True)(*at)["v"], 9) + 0.0).alias("phase"))


@query(f"WITH {S1}, p AS ({_PROD.format('a', 'a')}), q AS ({_PROD.format('p', 'a')}) SELECT bi, bj, r, c, sum(v) v FROM (SELECT bi, bj, r, c, 3 * v v FROM p UNION ALL SELECT bi, bj, r, c, -2 * v FROM q) GROUP BY 1, 2, 3, 4")
def mcweeny_step(s, d):
    return iterate.mcweeny_step(_s1(s, d))


@query("SELECT ((a * 2 + b) * 2 + c) * 2 + g AS gid, CAST(z AS INTEGER) z, CAST(x + a * 4.0 AS DOUBLE) x, CAST(y + b * 4.0 AS DOUBLE) y, CAST(w + c * 4.0 AS DOUBLE) zc FROM (VALUES (0, 1, 0.0, 0.0, 0.0), (1, 8, 1.5, 0.0, 0.0)) v(g, z, x, y, w), range(2) s(a), range(2) t(b), range(2) u(c)")
def supercell(s, d):
    atoms = s.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (1, 8, 1.5, 0.0, 0.0)], "gid long, z int, x double, y double, zc double")
    return formats.supercell(atoms, [[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]], (2, 2, 2))[0]


@query("SELECT 64.0::DOUBLE volume, 16.0::DOUBLE face")
def volume(s, d):
    c = [[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]]
    return s.createDataFrame([(round(formats.volume(c), 9), round(formats.volume(c, 0), 9))], "volume double, face double")
