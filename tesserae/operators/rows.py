"""Products of sparse matrices by panels of rows: what a panel makes is final, so products are never shuffled.

A panel of ``PANEL`` block rows of A goes to one group together with the rows of
B that it names, each once. The group expands at most ``PAIRS`` products at a
time and sums them in NumPy. Shuffles hold A and, for each panel, the rows of B
that it names; products, of which there may be many times as many, are not
among them. A group holds its panel of A and these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.schema import PLACE

PANEL = 512
PAIRS = 1 << 20
#: Stands for a missing row or column within a group.
NONE = -(1 << 63)

Arrays = dict[str, np.ndarray]


def _read(batches: Iterator[pa.RecordBatch]) -> Callable[[int], Arrays]:
    """The group's rows by their ``side``; missing numbers are NaN with ``<name>?`` True, where there are any."""
    t = pa.Table.from_batches(list(batches))
    cols: Arrays = {}
    for name in t.column_names:
        c = t.column(name).combine_chunks()
        if c.null_count and pa.types.is_floating(c.type):
            cols[f"{name}?"] = c.is_null().to_numpy(zero_copy_only=False)
        cols[name] = (c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False)
    return lambda side: {n: v[cols["side"] == side] for n, v in cols.items()}


def _ids(*pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (block, place) of all ``pairs`` in order, and where each pair's are among them."""
    x, r = (np.concatenate(z) for z in zip(*pairs, strict=True))
    blocks, at = np.unique(x, return_inverse=True)
    m = int(r.max()) + 1 if len(r) else 1
    keys, where = np.unique(at * m + r, return_inverse=True)
    cuts = np.cumsum([len(p[0]) for p in pairs])[:-1]
    return (blocks[keys // m] if len(keys) else blocks), keys % m, np.split(where, cuts)


def _chunks(row: np.ndarray, inner_l: np.ndarray, inner_r: np.ndarray, n_rows: int) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """First and last of some rows, and their pairs (entries of A, of B) in pieces.

    There is one piece, unless one row alone has more than ``PAIRS``.
    """
    by_row, by_inner = np.argsort(row, kind="stable"), np.argsort(inner_r, kind="stable")
    first = np.searchsorted(inner_r[by_inner], inner_l[by_row])
    count = np.searchsorted(inner_r[by_inner], inner_l[by_row], "right") - first
    ends = np.searchsorted(row[by_row], np.arange(n_rows), "right")
    total = np.concatenate([[0], np.cumsum(count)])

    def pieces(a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while a < b:
            to = min(b, max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1))
            n = count[a:to]
            step = np.arange(total[to] - total[a]) - np.repeat(total[a:to] - total[a], n)
            yield np.repeat(by_row[a:to], n), by_inner[np.repeat(first[a:to], n) + step]
            a = to

    done = at = 0
    while done < n_rows:
        to = max(done + 1, int(np.searchsorted(total[ends], total[at] + PAIRS, "right")))
        yield done, to, pieces(at, int(ends[to - 1]))
        done, at = to, int(ends[to - 1])


def _panel(b: str | Column) -> Column:
    return F.floor(F.coalesce(b if isinstance(b, Column) else F.col(b), F.lit(NONE)) / PANEL)


def _sides(*frames: DataFrame) -> DataFrame:
    """One table of several, told apart by ``side``; columns that one has not are missing there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (f.withColumn("side", F.lit(k)) for k, f in enumerate(frames)))


def _known(x: DataFrame) -> DataFrame:
    back = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return x.select(back("bi"), back("bj"), *[c for c in x.columns if c not in ("bi", "bj")])


def multiply(a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    """A B of stored entries; only block columns bj >= bi if ``upper``.

    If A has ``_na`` and ``_need`` and B has ``_nb``, only pairs with ``_na`` times ``_nb`` of at least ``_need`` count.
    """
    cx, test = "w" in a.columns, "_need" in a.columns
    some = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    values = [F.col(c).cast("double").alias(c) for c in ("v", "w")[: 1 + cx]]
    left = a.where("bj IS NOT NULL AND c IS NOT NULL").select(_panel("bi").alias("p"), some("bi").alias("x"), F.col("r").alias("xr"), F.col("bj").cast("long").alias("y"), F.col("c").alias("yr"), *values, *(["_na", "_need"] if test else []))
    named = left.select("p", "y").distinct()
    right = b.select(F.col("bi").cast("long").alias("y"), some("bj").alias("x"), F.col("c").alias("xr"), F.col("r").alias("yr"), *values, *(["_nb"] if test else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _read(batches)
        p, q = side(0), side(1)
        if not len(q["x"]):
            return
        rows, rr, (row,) = _ids((p["x"], p["xr"]))
        cols, cc, (col,) = _ids((q["x"], q["xr"]))
        _, _, (ip, iq) = _ids((p["y"], p["yr"]), (q["y"], q["yr"]))
        width = len(cols)
        lost = any(f"{n}?" in p for n in ("v", "w"))  # numbers may be missing: such products are, and sums leave them out
        pv, qv = ((z["v"] + 1j * z["w"] if cx else z["v"]) for z in (p, q))
        gone = [z.get("v?", np.zeros(len(z["x"]), bool)) | z.get("w?", np.zeros(len(z["x"]), bool)) for z in (p, q)] if lost else []
        for first, to, pieces in _chunks(row, ip, iq, len(rows)):
            dense, got = to - first == 1, []
            acc = np.zeros(width, pv.dtype) if dense else None
            seen, valid = (np.zeros(width, bool), np.zeros(width, bool)) if dense else (None, None)
            for i, j in pieces:
                use = np.ones(len(i), bool)
                if test:
                    use &= p["_na"][i] * q["_nb"][j] >= p["_need"][i]
                if upper:
                    use &= (q["x"][j] >= p["x"][i]) & (q["x"][j] != NONE) & (p["x"][i] != NONE)
                if test or upper:
                    i, j = i[use], j[use]
                key, val = (row[i] - first) * width + col[j], pv[i] * qv[j]
                ok = ~(gone[0][i] | gone[1][j]) if lost else None
                if lost:
                    val = np.where(ok, val, 0)
                if dense or len(key) * 16 >= (to - first) * width:
                    n = (to - first) * width
                    if not dense:
                        acc, seen, valid = np.zeros(n, pv.dtype), np.zeros(n, bool), np.zeros(n, bool)
                    acc = acc + (np.bincount(key, val.real, n) + 1j * np.bincount(key, val.imag, n) if cx else np.bincount(key, val, n))
                    seen[key] = True
                    valid[key if ok is None else key[ok]] = True
                    if not dense:
                        at = np.flatnonzero(seen)
                        got.append((at, acc[at], valid[at]))
                elif len(key):
                    order = np.argsort(key, kind="stable")
                    k = key[order]
                    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    got.append((k[start], np.add.reduceat(val[order], start), np.ones(len(start), bool) if ok is None else np.logical_or.reduceat(ok[order], start)))
            if dense:
                at = np.flatnonzero(seen)
                got.append((at, acc[at], valid[at]))
            for at, v, ok in got:
                i, j = first + at // width, at % width
                number = lambda z: pa.array(np.ascontiguousarray(z), mask=None if ok.all() else ~ok)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(cols[j]), pa.array(rr[i].astype(np.int32)), pa.array(cc[j].astype(np.int32)), number(v.real), *([number(v.imag)] if cx else [])], [*PLACE, "v", *(["w"] if cx else [])])

    both = _sides(left, named.join(right, "y"))
    return _known(both.groupBy("p").applyInArrow(run, "bi long, bj long, r int, c int, v double" + (", w double" if cx else "")))


def _pattern(p: Arrays, q: Arrays) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows from and to, the distinct (row - from) * width + column of the product's pattern among them, all rows and all columns."""
    zero = lambda z: np.zeros(len(z), np.int64)
    rows, _, (row,) = _ids((p["x"], zero(p["x"])))
    cols, _, (col,) = _ids((q["x"], zero(q["x"])))
    _, _, (ip, iq) = _ids((p["y"], zero(p["y"])), (q["y"], zero(q["y"])))
    width = len(cols)
    for first, to, pieces in _chunks(row, ip, iq, len(rows)):
        seen, found = np.zeros(width, bool) if to - first == 1 else None, []
        for i, j in pieces:
            key = (row[i] - first) * width + col[j]
            if seen is not None:
                seen[key] = True
            elif len(key) * 64 >= (to - first) * width:
                mark = np.zeros((to - first) * width, bool)
                mark[key] = True
                found.append(np.flatnonzero(mark))
            else:
                found.append(np.unique(key))
        yield first, to, np.flatnonzero(seen) if seen is not None else np.concatenate(found), rows, cols


def _met(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Panels of A's pattern, and the rows of B's that each names, with what else B has."""
    some = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    left = a.where("bj IS NOT NULL").select(_panel("bi").alias("p"), some("bi").alias("x"), F.col("bj").cast("long").alias("y"))
    right = b.select(F.col("bi").cast("long").alias("y"), some("bj").alias("x"), *[c for c in b.columns if c not in ("bi", "bj")])
    return left, left.select("p", "y").distinct().join(right, "y")


def pattern(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct bi, bj of the product of two patterns (bi, bj), themselves distinct."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _read(batches)
        p, q = side(0), side(1)
        if not len(q["x"]):
            return
        for first, _, key, rows, cols in _pattern(p, q):
            yield pa.RecordBatch.from_arrays([pa.array(rows[first + key // len(cols)]), pa.array(cols[key % len(cols)])], ["bi", "bj"])

    return _known(_sides(*_met(a, b)).groupBy("p").applyInArrow(run, "bi long, bj long"))


def on_pattern(a: DataFrame, b: DataFrame, values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries of ``values`` on the pattern of A B, stored zeros at its other places; ``sizes`` (b, n) has the blocks' sizes, and blocks without one are left out."""
    cx = "w" in values.columns
    left, right = _met(a, b.join(sizes.select(F.col("b").alias("bj"), F.col("n").cast("int").alias("n")), "bj"))
    known = sizes.where("b IS NOT NULL").select(_panel("b").alias("p"), F.col("b").cast("long").alias("x"), F.col("n").cast("int").alias("n"))
    stored = values.where("bi IS NOT NULL AND bj IS NOT NULL").select(_panel("bi").alias("p"), F.col("bi").cast("long").alias("x"), F.col("bj").cast("long").alias("y"), F.col("r").cast("int").alias("xr"), F.col("c").cast("int").alias("yr"), *[F.col(c).cast("double").alias(c) for c in ("v", "w")[: 1 + cx]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _read(batches)
        p, q, high, old = map(side, range(4))
        if not len(q["x"]) or not len(p["x"]):
            return
        tall = dict(zip(high["x"].tolist(), high["n"].tolist(), strict=True))
        names = ("v", "w")[: 1 + cx]
        order = np.argsort(old["x"], kind="stable")
        old = {k: v[order] for k, v in old.items()}
        wide = None
        for first, to, key, rows, cols in _pattern(p, q):
            if wide is None:
                wide = np.zeros(len(cols), np.int64)
                wide[np.searchsorted(cols, q["x"])] = q["n"]
                heights = np.array([tall.get(x, 0) for x in rows.tolist()], np.int64)
            i, j = first + key // len(cols), key % len(cols)
            n = heights[i] * wide[j]
            start = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(start, n)
            oi, oj = np.repeat(i, n), np.repeat(j, n)
            r, c = step // wide[oj], step % wide[oj]
            # the stored entries of these rows, and their places among those just made
            lo, hi = np.searchsorted(old["x"], rows[first]), np.searchsorted(old["x"], rows[to - 1], "right")
            e = {k: v[lo:hi] for k, v in old.items()}
            er, ec = np.searchsorted(rows, e["x"]), np.minimum(np.searchsorted(cols, e["y"]), len(cols) - 1)
            ek = (er - first) * len(cols) + ec
            at = np.minimum(np.searchsorted(key, ek), max(len(key) - 1, 0))
            hit = (cols[ec] == e["y"]) & (rows[np.minimum(er, len(rows) - 1)] == e["x"])
            hit &= (key[at] == ek) if len(key) else False
            place = start[at] + e["xr"] * wide[ec] + e["yr"] if len(key) else at
            hit &= (e["xr"] < heights[np.minimum(er, len(rows) - 1)]) & (e["yr"] < wide[ec])
            free = np.ones(len(step), bool)
            free[place[hit]] = False
            out = [np.concatenate([z[free], w[hit]]) for z, w in ((rows[oi], e["x"]), (cols[oj], e["y"]), (r.astype(np.int32), e["xr"].astype(np.int32)), (c.astype(np.int32), e["yr"].astype(np.int32)))]
            zeros = np.zeros(int(free.sum()))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, [*out, *(np.concatenate([zeros, np.where(e[f"{v}?"], 0.0, e[v])[hit] if f"{v}?" in e else e[v][hit]]) for v in names)])), [*PLACE, *names])

    both = _sides(left, right, known, stored)
    return _known(both.groupBy("p").applyInArrow(run, "bi long, bj long, r int, c int, v double" + (", w double" if cx else "")))
