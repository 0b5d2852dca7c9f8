"""Exact top-k by inner product: best-first search of M-trees of bounded size.

Inner products become a metric: with M the largest norm, x is extended by
sqrt(M^2 - |x|^2) and a query by 0; then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the
nearest rows are those of highest product. Rows go to the nearest of a bounded
set of routing objects and, with them, into trees of at most ``TREE_ROWS`` rows,
so a crowded region is many trees. A tree's nodes are pages that keep centre,
covering radius and distance to the parent's centre; a leaf entry keeps its
distance to the leaf's centre. The search takes the page with the best bound
next. |d(q, parent) - d(parent, child)| - radius bounds a page, and
|d(q, leaf) - d(leaf, row)| a row, before any distance to it is computed.

Queries come in blocks of bounded size, one after the other: a block is broadcast
to all trees, its best rows are written, and it is let go before the next, so
neither the driver's memory nor a plan grows with the queries. A bounded sample
of rows gives each query a first threshold. Pages are left out only if
their bound is under the tenth score so far by more than rounding can be, so
results are exact, ties included. Only a task's best k of each query move.

Edge cases: vectors that are null or hold null or non-finite components, or such
as are 2^53 or more once multiplied, take no part; shorter vectors count as padded with zeros; fewer than k other rows give
fewer results; equal scores go to the smaller id; repeated ids count as one row
(the one whose vector is largest in order); extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Stash

SCALE = 1024
TREE_ROWS = 4096
LEAF_ROWS = 64
FANOUT = 8
ROUTING = 64
SAMPLE = 2048
QUERY_BLOCK = 20_000
TASK_BLOCK = 512


def _int_rows(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    keep, out = [], []
    for row, x in enumerate(lists.to_pylist()):
        if x is not None and None not in x:
            v = np.array(x, np.float64)
            if np.isfinite(v).all() and (np.abs(v) < 2.0**53 / SCALE).all():
                keep.append(row)
                out.append(np.floor(SCALE * v).astype(np.int64))
    return np.array(keep, np.int64), out


def int_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and ``v`` (binary: little-endian 64-bit integers floor(1024 x)) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = _int_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([float((r.astype(float) ** 2).sum()) for r in rows], pa.float64())], ["vec_id", "v", "norm2"])

    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    return src.mapInArrow(run, "vec_id long, v binary, norm2 double").groupBy("vec_id").agg(F.max(F.struct("v", "norm2")).alias("x")).select("vec_id", "x.v", "x.norm2")


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    """Rows as one array of ``dim`` columns, padded with zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<i8")
        out[i, : len(v)] = v
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a b^T: by BLAS where doubles hold every partial sum, else in integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def extended(x: np.ndarray, big: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(0.0, big - (f * f).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n points, each the farthest from those before."""
    chosen, near = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def build(ids: np.ndarray, x: np.ndarray, big: float) -> bytes:
    """One M-tree as arrays: pages in order of creation, a leaf's rows next to each other."""
    points = extended(x, big)
    centre, radius, parent, to_parent, first, count, order = [], [], [], [], [], [], []
    todo = [(np.arange(len(ids)), -1, points.mean(0))]
    while todo:
        rows, up, c = todo.pop()
        d = distances(points[rows], c[None])[:, 0]
        me = len(centre)
        centre.append(c)
        radius.append(float(d.max()))
        parent.append(up)
        to_parent.append(float(np.linalg.norm(c - centre[up])) if up >= 0 else 0.0)
        routes = farthest_first(points[rows], FANOUT) if len(rows) > LEAF_ROWS else np.zeros(1, np.int64)
        if len(rows) <= LEAF_ROWS or len(routes) == 1:  # equal points stay in one leaf
            first.append(len(order))
            count.append(len(rows))
            order.extend(rows[np.argsort(d, kind="stable")].tolist())
            continue
        first.append(-1)
        count.append(0)
        to = distances(points[rows], points[rows[routes]]).argmin(1)
        for j in range(len(routes)):
            part = rows[to == j]
            if len(part):
                todo.append((part, me, points[part].mean(0)))
    at = np.array(order)
    leaf = np.repeat(np.flatnonzero(np.array(first) >= 0), [n for n, f in zip(count, first, strict=True) if f >= 0])
    starts = {int(p): first[p] for p in range(len(first)) if first[p] >= 0}
    by_start = sorted(starts, key=starts.get)
    leaf = np.repeat(by_start, [count[p] for p in by_start])
    to_leaf = np.linalg.norm(points[at] - np.array(centre)[leaf], axis=1)
    out = io.BytesIO()
    np.savez(out, ids=ids[at], x=x[at], centre=np.array(centre), radius=np.array(radius), parent=np.array(parent), to_parent=np.array(to_parent), first=np.array(first), count=np.array(count), to_leaf=to_leaf)
    return out.getvalue()


class Search:
    """The best k rows so far of each query of a block, over any number of trees."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, big: float, k: int):
        self.qids, self.q, self.big, self.k = qids, q, big, k
        self.points = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        self.norm2 = (self.points**2).sum(1)
        self.tau = floor.astype(np.float64)
        self.top = np.full((len(q), k), -np.inf)
        self.slack = 1e-6 * (1 + np.sqrt(self.norm2 * max(big, 1.0)))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.computed = 0

    def bound(self, least: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Highest score possible at distance ``least`` or more."""
        return (self.norm2[who] + self.big - np.maximum(0.0, least) ** 2) / 2

    def tree(self, blob: bytes) -> None:
        t = np.load(io.BytesIO(blob))
        ids, x, centre, radius, to_parent, first, count, to_leaf = (t[n] for n in ("ids", "x", "centre", "radius", "to_parent", "first", "count", "to_leaf"))
        children: dict[int, list[int]] = {}
        for page, up in enumerate(t["parent"].tolist()):
            children.setdefault(up, []).append(page)
        everyone = np.arange(len(self.q))
        heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def offer(page: int, who: np.ndarray) -> None:
            d = distances(self.points[who], centre[page][None])[:, 0]
            self.computed += len(who)
            best = self.bound(d - radius[page], who)
            in_it = best + self.slack[who] >= self.tau[who]
            if in_it.any():
                heapq.heappush(heap, (-float((best - self.tau[who])[in_it].max()), page, who[in_it], d[in_it]))

        offer(0, everyone)
        while heap:
            _, page, who, d = heapq.heappop(heap)
            on = self.bound(d - radius[page], who) + self.slack[who] >= self.tau[who]
            who, d = who[on], d[on]
            if not len(who):
                continue
            if first[page] < 0:
                for child in children[page]:
                    near = np.abs(d - to_parent[child]) - radius[child]
                    may = self.bound(near, who) + self.slack[who] >= self.tau[who]
                    if may.any():
                        offer(child, who[may])
                continue
            rows = np.arange(first[page], first[page] + count[page])
            least = np.abs(d[:, None] - to_leaf[rows][None, :])
            may = (self.norm2[who] + self.big)[:, None] / 2 - least**2 / 2 + self.slack[who][:, None] >= self.tau[who][:, None]
            rows, mine = rows[may.any(0)], may.any(1)
            who = who[mine]
            if not len(rows):
                continue
            self.computed += len(who) * len(rows)
            score = product(self.q[who], x[rows])
            other = ids[rows][None, :] != self.qids[who][:, None]
            hit = other & (score >= self.tau[who][:, None])
            a, b = np.nonzero(hit)
            self.found.append((who[a], ids[rows][b], score[a, b]))
            both = np.hstack([self.top[who], np.where(hit, score, -np.inf)])
            self.top[who] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            self.tau[who] = np.maximum(self.tau[who], self.top[who].min(1))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores of at most k rows a query."""
        if not self.found:
            return (np.empty(0, np.int64),) * 3
        who, ids, score = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        start = np.searchsorted(who, np.arange(len(self.q)))
        keep = np.arange(len(who)) - start[who] < self.k
        return self.qids[who[keep]], ids[keep], score[keep]


def _sample(vecs: DataFrame) -> list:
    return vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()


def index(vecs: DataFrame, stash: Stash, dim: int, big: float, sample: list) -> DataFrame:
    """Trees (one row each, ``tree`` binary) over all rows; the sample only chooses routing objects."""
    spark = vecs.sparkSession
    points = extended(matrix([r["v"] for r in sample], dim), big)
    routing = spark.sparkContext.broadcast(points[farthest_first(points, ROUTING)])  # at most ROUTING rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = extended(matrix(batch.column(1).to_pylist(), dim), big)
            to = distances(x, routing.value).argmin(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.int32())], ["vec_id", "v", "route"])

    routed = stash.write(vecs.select("vec_id", "v").mapInArrow(assign, "vec_id long, v binary, route int"), "routed")
    counts = {r["route"]: r["n"] for r in routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}  # ROUTING rows at most
    parts = F.element_at(F.create_map(*(F.lit(y) for k, n in sorted(counts.items()) for y in (k, -(-n // TREE_ROWS)))), F.col("route"))

    def tree(table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(table.column("v").to_pylist(), dim)
        return pa.table({"tree": pa.array([build(ids[order], x[order], big)], pa.binary())})

    return stash.write(routed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)).groupBy("route", "part").applyInArrow(tree, "tree binary"), "trees")


def top_k(spark: SparkSession, df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest product for each row whose id is divisible by ``every``."""
    stash = Stash(spark)
    out = "query_id long, rank int, vec_id long, score long"
    vecs = stash.write(int_vectors(df, id_col, vec_col), "vectors")
    is_query = F.col("vec_id") % every == 0
    facts = vecs.agg(F.max("norm2").alias("big"), F.max(F.length("v")).alias("bytes"), F.sum(is_query.cast("long")).alias("queries")).first()
    if not facts["queries"]:
        return spark.createDataFrame([], out)
    big, dim = float(facts["big"]), max(1, facts["bytes"] // 8)
    sample = _sample(vecs)
    trees = index(vecs, stash, dim, big, sample)
    known = matrix([r["v"] for r in sample], dim)
    known_ids = np.array([r["vec_id"] for r in sample])
    blocks = -(-facts["queries"] // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        rows = vecs.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        qids, q = np.array([r["vec_id"] for r in rows]), matrix([r["v"] for r in rows], dim)
        floor = np.empty(len(q))
        for at in range(0, len(q), 1024):
            s = product(q[at : at + 1024], known).astype(np.float64)
            s[known_ids[None, :] == qids[at : at + 1024, None]] = -np.inf
            floor[at : at + 1024] = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] if s.shape[1] >= k else -np.inf
        held = spark.sparkContext.broadcast((qids, q, floor))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, q, floor = held.value
            blocks = [Search(qids[a : a + TASK_BLOCK], q[a : a + TASK_BLOCK], floor[a : a + TASK_BLOCK], big, k) for a in range(0, len(q), TASK_BLOCK)]
            for batch in batches:
                for blob in batch.column(0):
                    data = blob.as_py()
                    for s in blocks:
                        s.tree(data)
            for s in blocks:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in s.best()], ["query_id", "vec_id", "score"])

        mine = trees.mapInArrow(search, "query_id long, vec_id long, score long")
        if blocks > 1:
            mine = stash.write(mine, "found")
            held.destroy()
        found = mine if found is None else found.unionByName(mine)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
