"""Iterative methods: each step is a plan over DataFrames; lineage is cut by checkpoints in the shared folder."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.spectral import bessel, chebyshev_coefficients, jackson
from tesserae.operators.elementwise import filter_blocks, scale, shift
from tesserae.operators.products import axpby, dot, spgemm, spmv, vector_axpby
from tesserae.schema import PLACE, constant, is_complex, value


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in ``spark.checkpoint.dir`` where that is set.

    Spark's keeps the size that it guessed for the plan. With a join in each
    step, the next guess is a power of the last, and after some twenty steps
    its digits alone take hours; so only the rows are kept.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tesserae-"))
    kept = df.checkpoint()._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), df.sparkSession)


def _real(*frames: DataFrame) -> None:
    if any(is_complex(x) for x in frames):
        raise TypeError("only real operands")


def _number(x: DataFrame, y: DataFrame) -> float:
    return float(dot(x, y).first()["v"] or 0.0)


def conjugate_gradients(a: DataFrame, b: DataFrame, steps: int = 20, tol: float = 1e-8) -> tuple[DataFrame, float]:
    """x with A x = b, and the last residual norm; TypeError for complex operands."""
    _real(a, b)
    x, r, p = scale_vector(b, 0.0), cut(b), cut(b)
    rr = _number(r, r)
    for _ in range(steps):
        if rr <= tol * tol:
            break
        ap = cut(spmv(a, p))
        alpha = rr / _number(p, ap)
        x, r = cut(vector_axpby(1.0, x, alpha, p)), cut(vector_axpby(1.0, r, -alpha, ap))
        new = _number(r, r)
        p, rr = cut(vector_axpby(1.0, r, new / rr, p)), new
    return x, rr**0.5


def scale_vector(x: DataFrame, s: complex) -> DataFrame:
    """s x."""
    return x.select(*[c for c in ("b", "r", "col") if c in x.columns], *(constant(s) * value(x)).columns())


def preconditioned_gradients(a: DataFrame, b: DataFrame, m: DataFrame | Callable[[DataFrame], DataFrame] | None = None, steps: int = 50, tol: float = 1e-8) -> tuple[DataFrame, list[float]]:
    """x with A x = b, and the norms of all residuals; ``m``, a matrix or a function, approximates the inverse of A.

    Ends at tol times the first residual, or 1e-12.
    """
    _real(a, b)
    apply = (lambda r: r) if m is None else m if callable(m) else lambda r: spmv(m, r)
    x, r = cut(scale_vector(b, 0.0)), cut(b)
    z = cut(apply(r))
    p, rho = z, _number(r, z)
    norms = [_number(r, r) ** 0.5]
    for _ in range(steps):
        if norms[-1] < max(tol * norms[0], 1e-12):
            break
        q = cut(spmv(a, p))
        pq = _number(p, q)
        if pq == 0:
            break
        alpha = rho / pq
        x, r = cut(vector_axpby(1.0, x, alpha, p)), cut(vector_axpby(1.0, r, -alpha, q))
        norms.append(_number(r, r) ** 0.5)
        z = cut(apply(r))
        new = _number(r, z)
        p, rho = cut(vector_axpby(1.0, z, new / rho, p)), new
    return x, norms


def half_preconditioner(root: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """With ``root`` near A^-1/2: r to root (root r)."""
    return lambda r: spmv(root, spmv(root, r))


def _recurrence(h: DataFrame, x: DataFrame, c: np.ndarray, every: int) -> DataFrame:
    """sum c_k T_k(H) x, cut every ``every`` terms; H has its spectrum in [-1, 1]."""
    step = lambda t: spmv(h, t.hint("merge"))  # noqa: E731 - a broadcast would send each vector to the driver
    t0, t1 = x, cut(step(x))
    y = vector_axpby(c[0], t0, c[1] if len(c) > 1 else 0.0, t1)
    for k in range(2, len(c)):
        t0, t1 = t1, cut(vector_axpby(2.0, step(t1), -1.0, t0))  # two later ones and the sum read it
        y = vector_axpby(1.0, y, c[k], t1)
        if k % every == 0:
            y = cut(y)
    return y


def kpm_apply(h: DataFrame, x: DataFrame, f: Callable, n: int, center: float, half: float, every: int = 4) -> DataFrame:
    """f(H) x by the Chebyshev recurrence; columns of a multivector are done at once."""
    return _recurrence(cut(scale(shift(h, -center), 1 / half)), x, chebyshev_coefficients(f, n, center, half), every)


def propagate(h: DataFrame, psi: DataFrame, dt: float, n: int, half: float, every: int = 4) -> DataFrame:
    """exp(-i H dt) psi for complex H and psi with H's spectrum in [-half, half]: coefficients (2 - d_k0) (-i)^k J_k(half dt)."""
    if not (is_complex(h) and is_complex(psi)):
        raise TypeError("only complex operands")
    c = np.array([(2.0 if k else 1.0) * (-1j) ** k for k in range(n)]) * bessel(n, half * dt)
    return _recurrence(cut(scale(h, 1 / half)), psi, c, every)


def kpm_moments(h: DataFrame, x: DataFrame, n: int) -> list[float]:
    """mu_k = x T_k(H) x for k < n, two from each product by the doubling identities; summed over a multivector's columns."""
    _real(h, x)
    total = lambda a, b: float(dot(a, b).agg(F.sum("v")).first()[0] or 0.0)
    t0, t1 = cut(x), cut(spmv(h, x))
    mu = [total(t0, t0), total(t0, t1)]
    m0, m1 = mu
    for _ in range(1, (n + 1) // 2):
        mu.append(2 * total(t1, t1) - m0)
        t0, t1 = t1, cut(vector_axpby(2.0, spmv(h, t1), -1.0, t0))
        mu.append(2 * total(t0, t1) - m1)
    return mu[:n]


def density_of_states(moments: list[float], weight: float, half: float, points: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Energies and Jackson-damped density from moments; ``weight`` is what moment 0 sums to for density 1 (rows times vectors)."""
    mu = np.asarray(moments, float) / weight * jackson(len(moments))
    x = np.cos(np.pi * (np.arange(points)[::-1] + 0.5) / points)  # ends of the interval are poles
    t = np.cos(np.arange(1, len(mu))[:, None] * np.arccos(x)[None, :])
    return x * half, (mu[0] + 2 * mu[1:] @ t) / (np.pi * np.sqrt(1 - x * x)) / half


def kpm_dos(h: DataFrame, x: DataFrame, n: int, half: float, rows: int, vectors: int, points: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Density of states of H, spectrum in [-half, half], from random vectors ``x`` (a multivector)."""
    return density_of_states(kpm_moments(cut(scale(h, 1 / half)), x, n), rows * vectors, half, points)


def mcweeny_step(p: DataFrame, eps: float = 0.0) -> DataFrame:
    """3 P^2 - 2 P^3, thresholded."""
    p2 = spgemm(p, p, eps)
    return filter_blocks(axpby(3.0, p2, -2.0, spgemm(p2, p, eps)), eps)


def purify(h: DataFrame, low: float, high: float, eps: float = 0.0, steps: int = 30, tol: float = 1e-8) -> tuple[DataFrame, list[int]]:
    """McWeeny purification of (high - H) / (high - low) towards the projector on the lower half, and the stored blocks after each step.

    Ends early once trace(P - P^2) changes by tol a row at most.
    """
    p = cut(shift(scale(h, -1 / (high - low)), high / (high - low)))
    history: list[int] = []
    before = math.inf
    for _ in range(steps):
        p = cut(mcweeny_step(p, eps))
        history.append(p.select("bi", "bj").distinct().count())
        on = (F.col("bi") == F.col("bj")) & (F.col("r") == F.col("c"))
        now = p.agg((F.sum(F.when(on, F.col("v"))) - F.sum(value(p).abs2())).alias("x"), F.count(F.when(on, 1)).alias("n")).first()
        if abs(before - now["x"]) <= tol * max(1, now["n"]):
            break
        before = now["x"]
    return p, history


FUNCTIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"inv": lambda x: 1 / (x + 1e-10), "isqrt": lambda x: 1 / (np.sqrt(x) + 1e-10), "sqrt": np.sqrt, "exp": np.exp}


def graph_function(a: DataFrame, name: str | Callable, action: Callable[[np.ndarray, list[int]], np.ndarray] | None = None) -> DataFrame:
    """f(A) approximated on each block's neighbourhood: the centre's column of f of the neighbourhood's submatrix.

    ``name`` is one of FUNCTIONS (else KeyError) or a function of eigenvalues;
    ``action``, if given, is used in its place and makes the wanted columns of
    any dense submatrix. A is taken as Hermitian; a missing diagonal block is an
    error. Subgraphs are as large as a row's degree squared.
    """
    f = FUNCTIONS[name] if isinstance(name, str) else name
    near = a.select(F.col("bi").alias("j"), F.col("bj").alias("center")).distinct()
    rows = near.select("center", F.col("j").alias("bi")).join(a, "bi")
    sub = rows.join(near.select("center", F.col("j").alias("bj")), ["center", "bj"])
    cx = "w" in a.columns

    def run(t):
        center = t.column("center")[0].as_py()
        bi, bj, r, c = (t.column(n).to_numpy() for n in PLACE)
        keys = sorted({*zip(bi.tolist(), r.tolist(), strict=True), *zip(bj.tolist(), c.tolist(), strict=True)})
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((len(keys), len(keys)), complex if cx else float)
        v = t.column("v").to_numpy() + (1j * t.column("w").to_numpy() if cx else 0)
        m[[at[k] for k in zip(bi.tolist(), r.tolist(), strict=True)], [at[k] for k in zip(bj.tolist(), c.tolist(), strict=True)]] = v
        mine = [i for i, k in enumerate(keys) if k[0] == center]
        if not mine or not ((bi == center) & (bj == center)).any():
            raise ValueError(f"diagonal block {center} is missing")
        if action is not None:
            out = np.asarray(action(m, mine))
        else:
            w, u = np.linalg.eigh(m)
            out = (u * f(w)) @ u.conj().T[:, mine]
        i, j = np.divmod(np.arange(out.size), len(mine))
        cols = [pa.array([keys[x][0] for x in i], pa.int64()), pa.array([center] * out.size, pa.int64()), pa.array([keys[x][1] for x in i], pa.int32()), pa.array([keys[mine[x]][1] for x in j], pa.int32()), pa.array(out.real.ravel())]
        return pa.Table.from_arrays(cols + ([pa.array(out.imag.ravel())] if cx else []), [*PLACE, "v", *(["w"] if cx else [])])

    found = sub.groupBy("center").applyInArrow(run, "bi long, bj long, r int, c int, v double" + (", w double" if cx else ""))
    return found.join(a.select("bi", "bj").distinct(), ["bi", "bj"], "left_semi").groupBy(*PLACE).agg(F.sum("v").alias("v"), *([F.sum("w").alias("w")] if cx else []))
