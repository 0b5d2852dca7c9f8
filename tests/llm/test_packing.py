"""Every id once, in order, and the best cuts."""

import zlib

import numpy as np
import pytest

from tesserae.llm import bpe, packing


def test_cuts_are_best():
    rng = np.random.default_rng(8)
    for _ in range(30):
        at = np.unique(np.concatenate([[0, 900], rng.integers(1, 900, 60), np.arange(0, 900, 100)]))
        pen = rng.choice([0.0, 1.0, 4.0], len(at))
        cost, back = packing.solve(at, pen, 256)
        best = [0.0]
        for j in range(1, len(at)):
            ways = [best[i] + pen[j] + packing.WINDOW_COST + (0 if at[j] - at[i] == 128 else 256 - at[j] + at[i]) for i in range(j) if at[j] - at[i] <= 256]
            best.append(min(ways))
        assert np.allclose(cost, best) and all(at[j] - at[back[j]] <= 256 for j in range(1, len(at)))


@pytest.mark.parametrize("block", [700, 1 << 19])
def test_stream(block):
    rng = np.random.default_rng(9)
    docs = [(i, np.append(rng.integers(1, 50000, n), 0).astype(np.uint32)) for i, n in enumerate(rng.integers(0, 900, 80))]
    sentence = rng.random(50258) < 0.05
    pieces = list(packing.pack_stream(iter(docs), sentence, 256, block))
    joined = np.concatenate([p[2] for p in pieces])
    assert np.array_equal(joined, np.concatenate([d[1] for d in docs]))
    lengths = {}
    for doc, start, ids, total, seq, offset in pieces:
        assert offset == lengths.get(seq, 0) and np.array_equal(docs[doc][1][start : start + len(ids)], ids) and total == len(docs[doc][1])
        lengths[seq] = offset + len(ids)
    assert max(lengths.values()) <= 256
    assert packing.padding(np.array(list(lengths.values())), 256) <= 0.1 * len(joined)


def test_query(spark):
    texts = [(1, None), (2, ""), (3, "A sentence. " * 3000), (4, "word " * 50), (4, "word " * 50), (None, "x")]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, start long").coalesce(1)
    rows = packing.op4(spark, df).collect()
    tok = bpe.load(bpe.default_vocabulary())
    for doc, t in texts[:4]:
        want = np.append(tok.encode(t or ""), 0).astype("<u4")
        mine = [r for r in rows if r["doc_id"] == doc][: None if doc != 4 else 1]
        for r in mine:
            assert r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t or "")) + 1 for _, t in texts)
    assert packing.op4(spark, df.limit(0)).count() == 0


def cost(lengths, ends, kinds, capacity):
    total, at = 0.0, 0
    for n in lengths:
        at += n
        total += (0 if n & (n - 1) == 0 and 128 <= n else capacity - n) + packing.WINDOW_COST + {0: 0.0, 1: packing.SENTENCE_PENALTY, 2: packing.HARD_PENALTY}[kinds[at]]
    return total


@pytest.mark.parametrize("block", [300, 1500, 1 << 19])
def test_blocks_give_the_optimum_of_the_whole_stream(block):
    """Whatever the block, the windows cost what the best ones over all document and sentence ends of the stream cost."""
    rng = np.random.default_rng(12)
    docs = [(i, np.append(rng.integers(1, 50000, n), 0).astype(np.uint32)) for i, n in enumerate(rng.integers(0, 400, 60))]
    sentence = rng.random(50258) < 0.08
    ids = np.concatenate([d[1] for d in docs])
    ends = np.cumsum([len(d[1]) for d in docs])
    at, pen = packing.places(ids, ends, sentence)
    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + pen[j] + packing.WINDOW_COST + (0 if (n := int(at[j] - at[i])) & (n - 1) == 0 and 128 <= n else 256 - n) for i in range(j) if at[j] - at[i] <= 256))
    lengths = {}
    for _, _, piece, _, seq, _ in packing.pack_stream(iter(docs), sentence, 256, block):
        lengths[seq] = lengths.get(seq, 0) + len(piece)
    kinds = dict(zip(at.tolist(), [{0.0: 0, packing.SENTENCE_PENALTY: 1, packing.HARD_PENALTY: 2}[x] for x in pen.tolist()], strict=True))
    assert np.isclose(cost([lengths[k] for k in sorted(lengths)], ends, kinds, 256), best[-1])
