"""What a task holds, and what is shuffled, doesn't grow faster than the tables: plans and results on small ones."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.api import BlockGraph
from tesserae.operators import atomic, products, rows, triples
from tesserae.plans import catalog, iterate
from tesserae.sources import generate


def _partitions(df, column: str) -> set[int]:
    """Partition counts of the plan's exchanges by ``column``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(rf"hashpartitioning\({column}#[^)]*?(\d+)\)", plan)}


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Tables dealt as if they were large; the session is as before afterwards."""
    monkeypatch.setattr(generate, "PART_BYTES", 8 << 10)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_cooccurrence_is_dealt_by_size(spark, sf, small_parts):
    """Both exchanges, by orders and by pairs, have as many partitions as the table needs, beyond the session's 4; half of the pairs are made."""
    a = generate.cooccurrence(spark, sf)
    n = generate.parts(generate.read(spark, sf, "lineitem"))
    assert n > 4
    assert _partitions(a, "l_orderkey") == {n}
    assert _partitions(a, "k") == {n}


def test_cooccurrence_with_missing_keys(spark, tmp_path):
    """A missing part is a part; repeated ones of an order meet each other and themselves."""
    rows = [(1, 5, 2.0), (1, 5, 3.0), (1, 7, 1.0), (1, None, 4.0), (2, None, 1.0), (2, 5, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["bi"], r["bj"]): r["v"] for r in generate.cooccurrence(spark, str(tmp_path)).collect()}
    want: dict = {}
    for o, i, p in rows:
        for u, j, q in rows:
            if o == u:
                want[i, j] = want.get((i, j), 0.0) + p * q
    assert got == want


def test_a_checkpoint_forgets_the_guessed_size(spark):
    """Five products in a row: the planner's guess at the bytes is no larger after the last than after the first."""
    a = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 1, 0, 0, 0.25), (1, 0, 0, 0, 0.25), (1, 1, 0, 0, 0.5)], "bi long, bj long, r int, c int, v double")
    guess = lambda x: int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    p = first = iterate.cut(a)
    for _ in range(5):
        p = iterate.cut(products.spgemm(p, a))
    assert guess(p) <= guess(first)
    want = np.linalg.matrix_power(np.array([[0.5, 0.25], [0.25, 0.5]]), 6)
    assert {(r["bi"], r["bj"]): r["v"] for r in p.collect()} == pytest.approx({(i, j): want[i, j] for i in (0, 1) for j in (0, 1)})


def test_a_recurrence_makes_each_product_once(spark, monkeypatch):
    """Four terms between two cuts: products are read from checkpoints, so plans stay small, and no vector goes to the driver."""
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(iterate, "cut", spy)
    h = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 1, 0, 0, 0.25), (1, 0, 0, 0, 0.25), (1, 1, 0, 0, 0.5)], "bi long, bj long, r int, c int, v double")
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "b long, r int, v double")
    c = [0.5, 0.25, 0.125, 0.0625, 1.0, 2.0, 3.0, 4.0]
    got = {r["b"]: r["v"] for r in iterate._recurrence(h, x, np.array(c), 4).collect()}
    assert max(p.count("Join ") for p in plans) == 1 and not any("Broadcast" in p for p in plans)
    m, t0, t1 = np.array([[0.5, 0.25], [0.25, 0.5]]), np.array([1.0, 2.0]), np.array([1.0, 1.25])
    want = c[0] * t0 + c[1] * t1
    for k in range(2, 8):
        t0, t1 = t1, 2 * m @ t1 - t0
        want = want + c[k] * t1
    assert got == pytest.approx(dict(enumerate(want)))


def test_graphs_are_compared_in_one_pass(spark):
    """Both directions, and sizes, from one reading of each graph; the same plan is not read at all."""
    reads = spark.sparkContext.accumulator(0)

    def counted(rows, names):
        def see(batches):
            reads.add(1)
            yield from batches

        df = spark.createDataFrame(rows, names).coalesce(1)
        return df.mapInArrow(see, df.schema)

    whole = counted([(0, 0), (0, 1), (1, 1)], "bi long, bj long")
    part = counted([(0, 0), (1, 1)], "bi long, bj long")
    sizes, other = (spark.createDataFrame([(0, 2), (1, n)], "b long, n int") for n in (3, 4))
    a, b, p, q = BlockGraph(sizes, whole), BlockGraph(sizes, whole), BlockGraph(sizes, part), BlockGraph(other, whole)
    assert a.same(b) and a.contains(b) and reads.value == 0
    assert not a.same(p) and a.contains(p) and reads.value == 2
    assert not p.contains(a) and not p.same(a)
    assert not a.contains(q) and not q.same(a)
    assert BlockGraph(sizes, whole.where("bi > 5")).same(BlockGraph(sizes, part.where("bi > 6")))


def _matrix(rng, n_rows: int, n_cols: int, count: int, block: int = 2):
    """Entries of a random block matrix, some of its rows and columns missing, and the same as a dictionary."""
    blocks = {(int(rng.integers(n_rows)), int(rng.integers(n_cols))) for _ in range(count)}
    entries = {(i, j, r, c): float(rng.integers(-3, 4)) for i, j in blocks for r in range(block) for c in range(block)}
    return entries, [(*k, v) for k, v in entries.items()]


PLACES = "bi long, bj long, r int, c int, v double"


@pytest.fixture(params=[(2, 1 << 20), (512, 1 << 20), (4, 7)], ids=["small panels", "one panel", "few pairs at once"])
def panels_of(request, monkeypatch):
    monkeypatch.setattr(rows, "PANEL", request.param[0])
    monkeypatch.setattr(rows, "PAIRS", request.param[1])


def test_khop_makes_no_product_rows(spark, panels_of):
    """Pattern and values as in plain Python, for blocks of two sizes; no shuffle is by the result's rows and columns."""
    rng = np.random.default_rng(3)
    entries, listed = _matrix(rng, 12, 12, 25)
    listed += [(None, 3, 0, 0, 1.0), (3, None, 0, 0, 1.0)]
    a = spark.createDataFrame(listed, PLACES)
    blocks = {(i, j) for i, j, *_ in entries}
    two = {(i, k) for i, j in blocks for h, k in blocks if h == j}
    three = {(i, k) for i, j in two for h, k in blocks if h == j}
    plain = a.where("bi IS NOT NULL AND bj IS NOT NULL")
    for k, want in ((2, two), (3, three)):
        got = [tuple(x) for x in products.khop_pattern(plain, k).collect()]
        assert sorted(got) == sorted(want)
        got = {tuple(x[:4]): x[4] for x in products.khop(a, k).collect()}
        assert got == {(i, j, r, c): entries.get((i, j, r, c), 0.0) for i, j in want for r in (0, 1) for c in (0, 1)}
    lost = [tuple(x) for x in products.khop_pattern(a, 2).collect()]
    own = {(None if i == -1 else i, None if j == -1 else j) for i, j in {(i, k) for i, j in blocks | {(-1, 3)} for h, k in blocks | {(3, -1)} if h == j}}
    assert len(lost) == len(own) and set(lost) == own
    plan = products.khop_pattern(plain, 2)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Aggregate" not in above


@pytest.mark.parametrize("cx", [False, True], ids=["real", "complex"])
def test_products_by_panels(spark, panels_of, cx):
    """Values, places and missing ones as in plain Python, at any panel and any number of pairs at once; products are not shuffled."""
    rng = np.random.default_rng(5)
    one, listed = _matrix(rng, 10, 9, 30)
    two, other = _matrix(rng, 9, 11, 30)
    w = lambda k: float(sum(k) % 5 - 2) if cx else 0.0
    tail = lambda rows: [(*x, w(x[:4])) for x in rows] if cx else rows
    kind = PLACES + (", w double" if cx else "")
    a, b = spark.createDataFrame(tail(listed), kind), spark.createDataFrame(tail(other), kind)
    want: dict = {}
    for (i, k, r, m), v in one.items():
        for (h, j, n, c), u in two.items():
            if (k, m) == (h, n):
                want[i, j, r, c] = want.get((i, j, r, c), 0) + (v + 1j * w((i, k, r, m))) * (u + 1j * w((h, j, n, c)))
    made = products.spgemm(a, b)
    got = {tuple(x[:4]): x["v"] + (1j * x["w"] if cx else 0) for x in made.collect()}
    assert got == want and made.count() == len(want)
    upper = {tuple(x[:4]) for x in products.spgemm(a, b, upper=True).collect()}
    assert upper == {p for p in want if p[1] >= p[0]}
    plan = made._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Aggregate" not in above


def test_products_with_missing_numbers(spark, panels_of):
    """As SQL has it: a missing value adds nothing but its place stays, missing rows and columns are a row and a column, a missing inner index meets nothing."""
    a = spark.createDataFrame([(0, 0, 0, 0, 2.0), (0, 1, 0, 0, None), (1, 1, 0, 0, None), (None, 0, 0, 0, 3.0), (2, None, 0, 0, 9.0)], PLACES)
    b = spark.createDataFrame([(0, 0, 0, 0, 5.0), (1, 0, 0, 0, 7.0), (0, None, 0, 0, 1.0), (None, 0, 0, 0, 9.0)], PLACES)
    for x, y in ((a, b), (a, b.withColumn("v", F.when(F.col("v") == 7, None).otherwise(F.col("v"))))):
        got = {(r["bi"], r["bj"]): r["v"] for r in products.spgemm(x, y).collect()}
        assert got == {(0, 0): 10.0, (1, 0): None, (0, None): 2.0, (None, 0): 15.0, (None, None): 3.0}
    y = b.withColumn("v", F.when(F.col("bi") == 0, F.col("v")))
    full = a.where("v IS NOT NULL")
    got = {(r["bi"], r["bj"]): r["v"] for r in products.spgemm(full, y).collect()}
    assert got == {(0, 0): 10.0, (0, None): 2.0, (None, 0): 15.0, (None, None): 3.0}
    got = {(r["bi"], r["bj"]): r["v"] for r in products.spgemm(full, b.withColumn("v", F.lit(None).cast("double"))).collect()}
    assert got == dict.fromkeys([(0, 0), (0, None), (None, 0), (None, None)])


@pytest.mark.parametrize("cells", [1 << 22, 300], ids=["whole", "in parts"])
@pytest.mark.parametrize("periodic", [None, (True, True, False), (True, True, True)], ids=["open", "slab", "bulk"])
def test_three_body_is_the_same_without_pairs(spark, monkeypatch, periodic, cells):
    """As from the edges, for clusters, gaps, types without a radius, atoms outside of the cell and one without a place; nothing is shuffled after."""
    monkeypatch.setattr(triples, "CELLS", cells)
    rng = np.random.default_rng(11)
    xyz = np.concatenate([rng.normal(0.0, 0.08, (40, 3)), rng.uniform(-1.0, 1.0, (60, 3))])
    kinds = [None if i == 7 else i % 4 for i in range(100)]
    at = spark.createDataFrame([(i, kinds[i], *map(float, xyz[i])) for i in range(100)] + [(100, 0, None, 0.0, 0.0)], "gid long, type int, x double, y double, zc double")
    cell = [[0.6, 0.0, 0.0], [0.1, 0.5, 0.0], [0.0, 0.0, 0.7]] if periodic else None
    rows_of = lambda df: sorted(tuple(r) for r in df.select("src", "dst", "rx", "ry", "rz").collect())
    radius = [0.05, 0.06]
    made = triples.three_body(at, 0.12, radius, radius, cell, periodic or False)
    assert rows_of(made) == rows_of(atomic.graph3b(atomic.edges(at, radius, cell, periodic or False)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
    if periodic:
        e = atomic.neighbours(at, 0.12, cell, periodic).drop("d2")
        want = atomic.graph3b(atomic.within(at, e, cell, [0.05, 0.06], [0.03, 0.04]), e)
        got = triples.three_body(at, 0.12, [0.05, 0.06], [0.03, 0.04], cell, periodic, by_vectors=True)
        assert rows_of(got) == rows_of(want) and want.count() > 500


def test_phases_by_positions_shuffle_no_edges(spark, sf):
    """Between the join of neighbours and the sums there is no exchange."""
    plan = catalog.QUERIES["sample_k_positions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("SortMergeJoin [i#")]
    assert "HashAggregate" in before and "Exchange" not in before
