"""Products of matrices with large blocks, block by block in NumPy.

The same matrices as elsewhere, but one row for each block: (bi, bj, h, w, v[,
u]) with the h x w values by rows, u being the imaginary parts. One join row
then stands for some hundred scalars, and kernels are dense products.

A product of two matrices goes by panels of ``PANEL`` block rows: the panel's
blocks of A are met by each row of B that they name, once, and the panel's rows
of the result are final, so nothing is summed after. A panel whose rows name
more than ``CHUNK`` blocks is dealt in chunks of the inner index, and only then
results are summed by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.schema import PLACE, is_complex

PANEL = 64
CHUNK = 8192
_BLOCK = "bi long, bj long, h int, w int, v array<double>"


def to_blocks(a: DataFrame) -> DataFrame:
    """One row for each block of stored entries."""
    cx = is_complex(a)
    cell = F.struct("r", "c", "v", *(["w"] if cx else []))
    x = a.groupBy("bi", "bj").agg(F.sort_array(F.collect_list(cell)).alias("x"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("_w"))
    pick = lambda n: F.transform("x", lambda q: q[n])
    return x.select("bi", "bj", F.col("h").cast("int").alias("h"), F.col("_w").cast("int").alias("w"), pick("v").alias("v"), *([pick("w").alias("u")] if cx else []))


def to_entries(blocks: DataFrame) -> DataFrame:
    """Stored entries of blocks."""
    cx = "u" in blocks.columns
    pairs = F.arrays_zip("v", "u") if cx else F.transform("v", lambda v: F.struct(v.alias("v")))
    x = blocks.select("bi", "bj", F.col("w").alias("_w"), F.posexplode(pairs).alias("p", "x"))
    return x.select("bi", "bj", F.floor(F.col("p") / F.col("_w")).cast("int").alias("r"), (F.col("p") % F.col("_w")).cast("int").alias("c"), F.col("x.v").alias("v"), *([F.col("x.u").alias("w")] if cx else []))


def _values(t: pa.Table | pa.RecordBatch, cx: bool, v: str = "v", u: str = "u") -> tuple[np.ndarray, np.ndarray]:
    """All values end to end, and where each row's start."""
    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        col = t.column(name)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        off = col.offsets.to_numpy()
        return col.values.to_numpy()[off[0] : off[-1]] if len(col) else np.empty(0), off - (off[0] if len(off) else 0)

    x, off = flat(v)
    return (x + 1j * flat(u)[0], off) if cx else (x, off)


def apply(blocks: DataFrame, x: DataFrame, adjoint: bool = False) -> DataFrame:
    """A x or A^H x for a vector or multivector (b, r[, col], v[, w]); its columns are met all at once."""
    cx = "u" in blocks.columns
    if cx != is_complex(x):
        raise TypeError("operands must both be real or both be complex")
    many = "col" in x.columns
    cell = F.struct("r", *(["col"] if many else []), "v", *(["w"] if cx else []))
    wide = x.groupBy(F.col("b").alias("_b")).agg(F.sort_array(F.collect_list(cell)).alias("x"))
    pick = lambda n: F.transform("x", lambda q: q[n])
    wide = wide.select("_b", pick("v").alias("xv"), *([pick("w").alias("xw")] if cx else []))
    inner, outer = ("bi", "bj") if adjoint else ("bj", "bi")
    joined = blocks.join(wide, F.col(inner) == F.col("_b")).select(F.col(outer).alias("b"), "h", "w", "v", *(["u"] if cx else []), "xv", *(["xw"] if cx else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, h, w = (batch.column(i).to_numpy() for i in range(3))
            (a, at), (y, yt) = _values(batch, cx), _values(batch, cx, "xv", "xw")
            sums: dict[int, np.ndarray] = {}
            for i in range(len(b)):
                m = a[at[i] : at[i + 1]].reshape(h[i], w[i])
                m = m.conj().T if adjoint else m
                got = m @ y[yt[i] : yt[i + 1]].reshape(m.shape[1], -1)
                sums[b[i]] = sums[b[i]] + got if b[i] in sums else got
            rows = [s.shape for s in sums.values()]
            out = np.concatenate([s.ravel() for s in sums.values()])
            n = np.array([p * q for p, q in rows])
            place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
            k = rows[0][1]
            cols = [np.repeat(np.fromiter(sums, np.int64, len(sums)), n), (place // k).astype(np.int32), *([(place % k).astype(np.int32)] if many else []), np.ascontiguousarray(out.real), *([np.ascontiguousarray(out.imag)] if cx else [])]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["b", "r", *(["col"] if many else []), "v", *(["w"] if cx else [])])

    keys = ["b", "r", *(["col"] if many else [])]
    parts = joined.mapInArrow(run, "b long, r int" + (", col int" if many else "") + ", v double" + (", w double" if cx else ""))
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("v", "w")[: 1 + cx]))


def multiply(a: DataFrame, b: DataFrame, eps: float = 0.0, upper: bool = False, panel: int = PANEL) -> DataFrame:
    """Blocks of A B with the thresholds of ``operators.products.spgemm``; only block columns bj >= bi if ``upper``."""
    cx = "u" in a.columns
    if cx != ("u" in b.columns):
        raise TypeError("operands must both be real or both be complex")
    row = F.floor(F.col("bi") / panel)
    counts = a.groupBy("bi").agg(F.count(F.lit(1)).alias("n")) if eps > 0 else None
    sizes = a.groupBy(row.alias("p")).agg(F.count(F.lit(1)).alias("m"))
    chunks = F.ceil(F.col("m") / CHUNK)
    split = not sizes.where(F.col("m") > CHUNK).isEmpty()
    left = a.withColumn("p", row)
    left = left.join(counts, "bi") if counts is not None else left.withColumn("n", F.lit(1).cast("long"))
    left = left.join(sizes.select("p", chunks.alias("k")), "p").withColumn("q", F.pmod(F.xxhash64("bj"), F.col("k"))) if split else left.withColumn("q", F.lit(0).cast("long"))
    left = left.select("p", "q", "bi", "bj", "n", "h", "w", "v", *(["u"] if cx else []))
    named = left.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("bj").alias("bi")).distinct()
    right = named.join(b, "bi").select("p2", "q2", "bi", "bj", "h", "w", "v", *(["u"] if cx else []))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        bi, bk, n, h = (x.column(c).to_numpy() for c in ("bi", "bj", "n", "h"))
        (av, at), (bv, bt) = _values(x, cx), _values(y, cx)
        kk, jj, hh, ww = (y.column(c).to_numpy() for c in ("bi", "bj", "h", "w"))
        # the panel's column space, and each row of B laid side by side in it
        js, which = np.unique(jj, return_inverse=True)
        width = np.zeros(len(js), np.int64)
        width[which] = ww
        start = np.cumsum(width) - width
        rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(kk).tolist():
            mine = np.flatnonzero(kk == k)
            blocks = [bv[bt[i] : bt[i + 1]].reshape(hh[i], ww[i]) for i in mine]
            rows[k] = (np.concatenate(blocks, 1), which[mine], np.array([np.linalg.norm(q) for q in blocks]))
        out: list[tuple[int, int, int, int, np.ndarray]] = []
        for i in np.unique(bi).tolist():
            mine = [q for q in np.flatnonzero(bi == i) if bk[q] in rows]
            if not mine:
                continue
            height = h[mine[0]]
            total, touched = np.zeros((height, int(width.sum())), av.dtype), np.zeros(len(js), bool)
            for q in mine:
                block = av[at[q] : at[q + 1]].reshape(height, -1)
                wide, cols, norms = rows[int(bk[q])]
                use = np.ones(len(cols), bool)
                if eps > 0:
                    use = np.linalg.norm(block) * norms >= eps / max(1, n[q])
                if upper:
                    use &= js[cols] >= i
                if not use.any():
                    continue
                spans = np.concatenate([np.arange(start[c], start[c] + width[c]) for c in cols[use]])
                part = wide if use.all() else wide[:, np.repeat(use, width[cols])]
                total[:, spans] += block @ part
                touched[cols[use]] = True
            for c in np.flatnonzero(touched).tolist():
                got = total[:, start[c] : start[c] + width[c]]
                if split or eps <= 0 or np.linalg.norm(got) >= eps:
                    out.append((i, int(js[c]), height, int(width[c]), got))
        flat = np.concatenate([o[4].ravel() for o in out]) if out else np.empty(0, av.dtype)
        off = pa.array(np.cumsum([0] + [o[4].size for o in out]), pa.int32())
        ids = [pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(z))) for z in ((flat.real, flat.imag) if cx else (flat,))]
        return pa.Table.from_arrays([*ids, *lists], ["bi", "bj", "h", "w", "v", *(["u"] if cx else [])])

    made = left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInArrow(run, _BLOCK + (", u array<double>" if cx else ""))
    if not split:
        return made
    from tesserae.operators.elementwise import filter_blocks

    summed = to_entries(made).groupBy(*PLACE).agg(*(F.sum(c).alias(c) for c in ("v", "w")[: 1 + cx]))
    return to_blocks(filter_blocks(summed, eps))
