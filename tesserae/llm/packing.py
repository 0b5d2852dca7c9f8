"""Order-preserving packing of token streams by dynamic programming.

Documents keep their order within a task's share of the input. Over its token
stream, places for cuts are document ends, sentence ends and, in stretches
without either, every ``HARD`` tokens. Among all ways to cut into windows of at
most ``capacity`` tokens the one of least cost is taken: padding of each window
plus a penalty for each cut inside a document (less at a sentence end). With
f(j) the least cost up to place j, f(j) = min over i of f(i) + capacity -
(p(j) - p(i)) + penalty(j); f(i) + p(i) is kept in a monotone queue over the
last ``capacity`` tokens, so each place costs constant time. Windows whose length
is a power of two need no padding and are tried as well, by direct look-up.

The stream is solved in blocks of ``BLOCK`` tokens or more. Whatever comes later,
the best way goes through some place of a block's last ``capacity`` tokens; where
the best ways to all of these meet, the windows before are settled, and what
follows goes on into the next block. So the result is the optimum of the whole
stream, whatever the block, and memory does not grow with the input. Only a
task's last window may be short.

Edge cases: null or empty text is one token (the end id); a document longer
than a window spans several; repeated rows are packed as often as they occur;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.bpe import default_vocabulary, load

CAPACITY = 1024
END_ID = 0
HARD = 32
BLOCK = 1 << 19
SENTENCE_PENALTY = 1.0
HARD_PENALTY = 4.0
WINDOW_COST = 24.0


def places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts (tokens before them) with their penalties; 0 and the end are among them."""
    n = len(ids)
    kind = np.full(n + 1, 255, np.uint8)
    kind[np.flatnonzero(sentence[ids]) + 1] = 1
    kind[doc_ends] = 0
    kind[0] = kind[n] = 0
    at = np.flatnonzero(kind < 255)
    for g in np.flatnonzero(np.diff(at) > hard):
        kind[at[g] + hard : at[g + 1] : hard] = 2
    at = np.flatnonzero(kind < 255)
    return at, np.array([0.0, SENTENCE_PENALTY, HARD_PENALTY])[kind[at]]


def solve(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> tuple[list[float], list[int]]:
    """Least cost up to each place and the place before it on the best way."""
    pos, pen = at.tolist(), penalty.tolist()
    index = {p: j for j, p in enumerate(pos)}
    powers = [1 << k for k in range(capacity.bit_length() - 1, 6, -1) if 1 << k < capacity]
    cost, back = [0.0] * len(pos), [-1] * len(pos)
    queue: deque[tuple[int, float]] = deque([(0, 0.0)])
    get = index.get
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - capacity
        while pos[queue[0][0]] < low:
            queue.popleft()
        i, key = queue[0]
        best = key + capacity - p
        for power in powers:
            k = get(p - power)
            if k is not None and cost[k] < best:
                i, best = k, cost[k]
        best += pen[j] + WINDOW_COST
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][1] >= key:
            queue.pop()
        queue.append((j, key))
    return cost, back


def windows(at: np.ndarray, penalty: np.ndarray, capacity: int, last: bool) -> list[int]:
    """Ends of the windows; unless ``last``, those before the place where the best ways to all of the last ``capacity`` tokens' places meet."""
    _, back = solve(at, penalty, capacity)
    j = len(at) - 1
    if not last:
        open_ = {*range(int(np.searchsorted(at, at[-1] - capacity, "right")), len(at))}
        while len(open_) > 1:
            open_.add(back[max(open_)])
            open_.remove(max(open_))
        j = open_.pop()
    out = []
    while j > 0:
        out.append(int(at[j]))
        j = back[j]
    return out[::-1]


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], sentence: np.ndarray, capacity: int = CAPACITY, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of a stream of (doc_id, ids)."""
    held: list[tuple] = []  # (doc_id, ids not yet packed, start, doc_tokens)
    size, sequence, enough = 0, 0, block

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence, enough
        if not held:
            return
        ids = np.concatenate([h[1] for h in held])
        ends = np.cumsum([len(h[1]) for h in held])
        at, penalty = places(ids, ends, sentence)
        stops = windows(at, penalty, capacity, last)
        begin, d, used = 0, 0, 0
        for stop in stops:
            offset = 0
            while begin < stop:
                doc, tokens, start, total = held[d]
                n = min(len(tokens) - used, stop - begin)
                yield doc, start + used, tokens[used : used + n], total, sequence, offset
                begin, offset, used = begin + n, offset + n, used + n
                if used == len(tokens):
                    d, used = d + 1, 0
            sequence += 1
        rest = held[d:]
        if rest and used:
            doc, tokens, start, total = rest[0]
            rest[0] = (doc, tokens[used:], start + used, total)
        held, size = rest, size - begin
        enough = max(block, 2 * size)  # where nothing has met yet, a longer stretch is solved next

    for doc, ids in docs:
        held.append((doc, ids, 0, len(ids)))
        size += len(ids)
        if size >= enough:
            yield from flush(False)
    while held:
        yield from flush(True)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all texts, in the order of the input, into windows of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids (binary: little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Each task packs its own
    share of the input, so there is no shuffle.
    """
    path = path or default_vocabulary()
    src = df.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sentence = bpe.ends_sentence()
        part = [0]
        end = np.array([end_id], np.uint32)

        def stream() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    part[0] = batch.column(0)[0].as_py()
                for at in range(0, batch.num_rows, 256):
                    few = batch.slice(at, 256)
                    for doc, text in zip(few.column(1).to_pylist(), few.column(2).to_pylist(), strict=True):
                        yield doc, np.concatenate([bpe.encode(text), end])

        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*rows, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array([(part[0] << 36) + s for s in seq], pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for row in pack_stream(stream(), sentence, capacity):
            rows.append(row)
            if len(rows) >= 4096:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return src.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padding(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Tokens of padding of windows with these lengths: none at a power of two."""
    n = np.asarray(lengths)
    return int(np.where(n & (n - 1) == 0, 0, capacity - n).sum())


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns: pieces with the CRC-32 of their ids."""
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
