"""Ids equal those of the tokenizers library, split or not."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe


@pytest.fixture(scope="module")
def ours():
    return bpe.load(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(bpe.default_vocabulary())


def texts():
    rng = np.random.default_rng(6)
    parts = list("aébß 1²\n\t '　!?.‍") + ["the", "ing", "'s", "'ll", "<|endoftext|>", "<|endof", "  ", "\r\n", "日本", "😀", "000", "'"]
    out = ["", " ", "a", "<|endoftext|>", "x" * 700, " " * 300, "'" * 90 + "s", "ab" * 400 + "<|endoftext|>" + "é" * 300, "1" * 500]
    return out + ["".join(rng.choice(parts, rng.integers(1, 300))) for _ in range(150)]


def test_whole_and_split(ours, theirs):
    for t in texts():
        want = theirs.encode(t, add_special_tokens=False).ids
        ids = ours.encode(t)
        assert ids.tolist() == want, t
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)
        for size in (7, 33, 128):
            assert ours.encode_split(t, size).tolist() == want, (size, t)


def test_frame(spark, theirs):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(900, None, "n"), (901, "dup", "d"), (901, "dup", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode_decode(df, split_chars=100).collect()
    assert len(got) == len(rows)
    want = {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    for r in got:
        ids = want[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0)).count() == 0
