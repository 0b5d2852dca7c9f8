"""The sum-of-squares identity, held-out accuracy and odd inputs."""

from zlib import crc32

import numpy as np

from tesserae.llm import quality


def test_identity():
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    i, x = rng.choice(quality.SIZE, 12, False), rng.normal(size=12)
    z = fm.raw(i, x, np.array([0]))[0][0]
    pairs = sum(fm.factors[i[a]] @ fm.factors[i[b]] * x[a] * x[b] for a in range(12) for b in range(a))
    assert np.isclose(z, 0.3 + fm.weights[i] @ x + pairs)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op8(docs, labels).join(labels, "doc_id").where("quality is not null").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([r["predicted"] == r["quality"] for r in held])
    assert auc > 0.9 and accuracy > 0.9, (auc, accuracy)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, None, 0.1), (2, "", 0, 0.2), (3, "x " * 50000, 100000, 0.3), (3, "x", 1, 0.4), (None, "y", -5, 0.5)], "doc_id long, text string, n_chars int, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.op8(docs, none).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    some = spark.createDataFrame([(1, None, 0), (2, 1, None), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.op8(docs, some).collect())
    assert quality.op8(docs.limit(0), some).count() == 0
    kept = quality.keep_good(docs, quality.fit([], np.empty(0)))
    assert kept.schema == docs.schema and kept.count() == 5


def test_one_id_many_times(spark):
    """An id that a hundred thousand rows have brings one row to the fit."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda rows, y, **k: (seen.append(len(rows)), fit(rows, y, **k))[1]
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen == [1]
