"""Near duplicates against all pairs of true word tuples."""

import re

import numpy as np
import pytest

from tesserae.llm import minhash, shingles


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.integers(len(out))] = f"e{rng.integers(1 << 30)}"
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [None, "", "  \t\n", "One", "one", "two words", "TWO  words", "x y z"]
    for _ in range(6):  # groups of near copies, at and around the threshold
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        out += [" ".join(edited(rng, base, n)) for n in rng.integers(0, 9, 25)]
    base = [f"v{x}" for x in rng.integers(0, 500, 200)]
    out += [" ".join(edited(rng, base, 5)) for _ in range(300)]  # pairs about the threshold, hub or not
    chain = [f"c{i}" for i in range(400)]
    out += [" ".join(chain[i : i + 200]) for i in range(0, 200, 10)]  # linked only through neighbours
    out += [" ".join(map(str, rng.integers(0, 50, 40))) for _ in range(50)] + ["same text here " * 40] * 30
    return list(enumerate(out, 100))


def test_components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").fillna("", "text").repartition(5)
    got = minhash.op5(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_alone_find_all(spark, rows, monkeypatch):
    """With tiny blocks the links across components are the same."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    docs = spark.createDataFrame(rows[150:], "doc_id long, text string")
    got = minhash.near_duplicates(docs, 5, 80).collect()
    assert sorted(tuple(r) for r in got) == brute(rows[150:], 5, 80)


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "z"), (2, "A b c d e"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in minhash.op5(docs).collect())
    assert len(got) == 5 and ("2", 2, 1) in got
    assert minhash.op5(docs.limit(0)).count() == 0


def test_bounds_of_the_posterior():
    least = minhash.least_matches(0.8)
    assert len(least) == 8 and list(least) == sorted(least) and least[-1] < 0.8 * 128
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, (4000, 128)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert len(minhash.survives(a, b, 0.8)) >= 3999
    assert not len(minhash.survives(a, a + 1, 0.8))


def test_words(monkeypatch):
    h = shingles.word_hashes
    odd = ["", "  ", "a", " A  b\tc\nd\x0be", "\x1cx\x85y z q É", "a b ab ba aa a" * 50, "x" * 300 + " y"]
    for t in odd:
        assert len(h(t)) == len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert (h("Ab c") == h(" aB\nC")).all() and len(set(h("a b ab ba aa a").tolist())) == 5
    whole = [h(t) for t in odd]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert all((h(t) == w).all() for t, w in zip(odd, whole, strict=True))


def test_long_chain(spark):
    """Two chains of 1500 links each, names in random order: one component each, whatever the diameter."""
    name = [bytes(x) for x in np.random.default_rng(8).integers(0, 256, (3002, 16), np.uint8)]
    chains = name[:1501], name[1501:]
    links = spark.createDataFrame([(max(x), min(x)) for c in chains for x in zip(c, c[1:])], "a binary, b binary")
    got = {bytes(r["c"]): bytes(r["comp"]) for r in minhash.components(links, minhash.Stash(spark)).collect()}
    assert got == {x: min(c) for c in chains for x in c}


def test_one_of_each_stays(spark):
    """Other texts under one id, rows without an id and rows without words stay; copies and repeated rows go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 7), (1, b, 7), (None, c, 7), (2, a + " more", 7), (None, b, 8), (3, None, 9), (3, None, 9), (4, "", 9), (5, c.replace("c1 ", "x "), 1), (5, c.replace("c1 ", "x "), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c long")
    got = sorted(minhash.keep_one(df).collect(), key=str)
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [(1, a, 7), (1, b, 7), (3, None, 9), (3, None, 9), (4, "", 9), (5, c.replace("c1 ", "x "), 1)]))
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_links_of_rows_without_id(spark):
    """A class whose rows have no id still links others."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[i : i + 200]) for i in range(0, 60, 10)]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.op5(df).collect()} == {0}


def test_against_sql(spark, sf):
    """The registered SQL gives the same components on the smallest table."""
    import duckdb

    from tesserae.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {tuple(r) for r in con.execute(queries.ORACLE["op5_minhash"]).fetchall()}
    assert {tuple(r) for r in queries.op5_minhash(spark, sf).collect()} == want and len(want) == 200


def test_clashing_columns_and_long_texts(spark):
    from tesserae.llm.common import documents

    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long, "a", 1, 2), (2, long + " x", "b", 1, 2), (3, "short one here now", "c", 1, 2), (3, "short one here now", "c", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string, h long, key long")
    got = sorted(tuple(r) for r in minhash.op5(documents(df)).collect())
    assert got == [(1, 99_997, 1, True), (2, 99_998, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert minhash.keep_one(df).columns == df.columns and {r["doc_id"] for r in minhash.keep_one(df).collect()} == {1, 3}
