"""The stages one after another on the smallest table."""

import corpus_pipeline
from tesserae.llm import common, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, stash = docs.columns, common.Stash(spark)
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash.write(stage(spark, docs, sf), name)
        assert docs.columns == want
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] == seen[3] == seen[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_decisions_take_effect(spark, sf, tmp_path):
    near = " ".join(f"word{i}" for i in range(200))
    rows = [(1, near, "en", "s", len(near)), (2, near + " end", "en", "s", 0), (3, "Write to a@b.co. " + near[:50], "en", "s", 0), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    stages = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stages["near_dedup"](spark, df, sf).collect()} == {1, 3, 4}
    assert "<EMAIL>" in {r["doc_id"]: r["text"] for r in stages["pii"](spark, df, sf).collect()}[3]
    assert {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, df, sf).collect()}[2] == "end"
    model = quality.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(quality.keep_good(df, model, 0.0).columns) == set(df.columns)
    empty = df.limit(0)
    for name in ("near_dedup", "substring_dedup", "pii", "packing", "quality"):
        assert stages[name](spark, empty, sf).count() == 0


def test_repeated_and_null_ids(spark, sf):
    """No stage loses or mixes rows for the sake of their ids; clashing columns stay."""
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, words("a", 80), 1, 2), (1, words("b", 80), 1, 2), (None, words("c", 80), 1, 2), (None, None, 1, 2), (2, words("d", 40) + " " + words("a", 60), 1, 2), (3, words("long", 50_000), 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, comp long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_dedup", "substring_dedup", "pii"):
        got = stages[name](spark, df, sf)
        assert got.columns == df.columns and got.count() == len(rows), name
    cut = {(r["doc_id"], len((r["text"] or "").split())) for r in stages["substring_dedup"](spark, df, sf).collect()}
    assert cut == {(1, 80), (None, 80), (None, 0), (2, 40), (3, 50_000)}
    assert stages["packing"](spark, df, sf).where("start = 0").count() == len(rows)


def test_run_leaves_only_its_last_input(spark, sf):
    """All stages in turn give what they give one by one, and their tables are gone."""
    import os

    root = common.shared_dir(spark).removeprefix("file:")
    before = {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs}
    out = corpus_pipeline.run(spark, sf)
    new = {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs} - before
    assert out.count() > 0 and {p.split("/")[-2].rsplit("-", 1)[0] for p in new if p.endswith(".parquet")} == {"pii"}


def test_substring_stage_cuts_all_similar_passages(spark, sf):
    """Ten lines of 30 words stand in 70 documents each; of those the 50th has what the 20th has round it but for one word."""
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = []
    for k in range(10):
        for i in range(70):
            who = f"{k}_20" if i == 50 else f"{k}_{i}"
            left, right = words(f"u{who}_", 20), words(f"v{who}_", 10)
            left = left.replace(f"u{who}_14", "edit") if i == 50 else left
            rows.append((100 * k + i, f"{words(f'c{k}_{i}_', 30)} {left} {words(f'l{k}_', 30)} {right} {words(f'd{k}_{i}_', 30)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: len(r["text"].split()) for r in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, df, sf).collect()}
    assert cut == {100 * k + i: 60 if i == 50 else 120 for k in range(10) for i in range(70)}


def test_substring_stage_sends_no_texts_for_short_lines(spark, sf, monkeypatch):
    """Lines of 14 words in 30 documents are no reason to compare these; texts are sent for pairs only."""
    from tesserae.llm import windows

    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    df = spark.createDataFrame([(i, " ".join(f"{words(f'l{k}_', 14)} {words(f'a{i}_{k}_', 30)}" for k in range(8))) for i in range(30)], "doc_id long, text string")
    sent, compared = [], windows._compared
    monkeypatch.setattr(windows, "_compared", lambda docs, names, pairs, stash: sent.append(pairs.count()) or compared(docs, names, pairs, stash))
    cut = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, df, sf)
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in df.collect()} and sum(sent) == 0
