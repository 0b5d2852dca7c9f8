"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]);
the sum-of-squares identity gives all pairwise interactions in time linear in
the number of features present. Features are the distinct hashed words of the
whole text (scaled by 1/sqrt of their number), structure statistics (shares of
character classes, repetition of words and lines, lengths) and the table's
length metadata as a bucket.

The model is fitted on the driver to at most ``MAX_TRAIN`` labelled rows (those
of least hash, and of an id that occurs with several texts one of them), a
documented bound on the fit only; every row is scored.

Edge cases: null or empty text has structure features only and still gets a
score; null labels are no labels; without any label each score is 0.5; repeated
rows each get their score; words are cut at white space, however long the text;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shingles import word_hashes

WORD_BITS = 14
N_STRUCT = 14
N_META = 16
FACTORS = 4
MAX_TRAIN = 8000
THRESHOLD = 0.3
_WORDS = 1 << WORD_BITS
SIZE = _WORDS + N_STRUCT + N_META


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if c.isascii() and c.islower() else 2 if c.isascii() and c.isupper() else 3 if c.isascii() and c.isdigit() else 4 if b in b" \t\r\x0b\x0c" else 5 if b == 10 else 6 if c in ".,;:'\"?!-()" else 7 if b < 128 else 0
    return out


_CLASSES = _byte_classes()


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASSES[raw], minlength=8) / max(1, len(raw))
    ids = (word_hashes(text) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    n = len(ids)
    distinct, counts = np.unique(ids, return_counts=True)
    lines = [x for x in text.split("\n") if x]
    struct = np.array(
        [
            share[2] * 4, share[3] * 4, share[6] * 4, share[7] * 8, share[5] * 8, share[0],
            min(2.0, len(raw) / max(1, n) / 8),
            len(distinct) / max(1, n),
            float((ids[1:] == ids[:-1]).mean()) * 4 if n > 1 else 0.0,
            counts.max() / n * 4 if n else 0.0,
            1 - len(set(lines)) / max(1, len(lines)),
            math.log1p(n) / 8,
            min(2.0, n / max(1, len(lines)) / 32),
            1.0 if n == 0 else 0.0,
        ]
    )
    meta = _WORDS + N_STRUCT + (min(N_META - 1, int(math.log2(n_chars)) + 1) if n_chars and n_chars > 0 else 0)
    return np.concatenate([distinct, np.arange(_WORDS, _WORDS + N_STRUCT), [meta]]), np.concatenate([np.full(len(distinct), 1 / math.sqrt(max(1, len(distinct)))), struct, [1.0]])


@dataclass
class FactorisationMachine:
    """Bias, weights (SIZE) and factors (SIZE, FACTORS)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums over v x, of rows laid end to end."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores in 0 to 1; each row has at least one feature."""
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z, _ = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on log loss over mini-batches; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS)))
    if not len(rows):
        fm.factors[:] = 0
        return fm
    p = float(np.clip(labels.mean(), 0.02, 0.98))
    fm.bias = math.log(p / (1 - p))
    acc_b, acc_w, acc_v = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            z, sums = fm.raw(index, value, starts)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            each = np.repeat(err, sizes) * value / len(part)
            seen, where = np.unique(index, return_inverse=True)
            g_w = np.bincount(where, each, len(seen)) + decay * fm.weights[seen]
            vx = fm.factors[index]
            g_all = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx * value[:, None])
            g_v = np.stack([np.bincount(where, g_all[:, f], len(seen)) for f in range(FACTORS)], 1) + decay * fm.factors[seen]
            g_b = err.mean()
            acc_b += g_b * g_b
            acc_w[seen] += g_w * g_w
            acc_v[seen] += g_v * g_v
            fm.bias -= rate * g_b / math.sqrt(acc_b)
            fm.weights[seen] -= rate * g_w / np.sqrt(acc_w[seen])
            fm.factors[seen] -= rate * g_v / np.sqrt(acc_v[seen])
    return fm


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5, is 0: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit to the labelled rows that aren't held out, at most ``max_train`` of them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    picked = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([i.astype("<u2").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["doc_id", "y", "i", "v"])

    # one row of each id, however often it occurs, so the bound on ids bounds what comes to the driver: a kilobyte or two each
    made = picked.mapInArrow(run, "doc_id long, y double, i binary, v binary").groupBy("doc_id").agg(F.min(F.struct("i", "v", "y")).alias("x")).select("doc_id", "x.y", "x.i", "x.v")
    got = made.toArrow().sort_by([("doc_id", "ascending")])
    rows = [(np.frombuffer(i.as_py(), "<u2").astype(np.int64), np.frombuffer(v.as_py(), "<f4").astype(np.float64)) for i, v in zip(got.column("i"), got.column("v"), strict=True)]
    return fit(rows, got.column("y").to_numpy())


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (1 + FACTORS) numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fm.score(rows), pa.float64())], ["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                at_n = part.schema.get_field_index("n_chars")
                counts = part.column(at_n).to_pylist() if at_n >= 0 else [len(t or "") for t in texts]
                scores = fm.score([features(t or "", n) for t, n in zip(texts, counts, strict=True)])
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
