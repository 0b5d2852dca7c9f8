"""MinHash near-dedup with sequential Bayesian verification.

1. Texts of equal shingle sets are one class; one row each goes on.
2. Signatures of 128 min-hashes are cut into 32 bands of 4; classes that share
   a band hash are in one bucket. At similarity 0.8 a pair shares no bucket with
   probability (1 - 0.8^4)^32, about 5e-8.
3. A bucket's members are each compared with its least member only: linear in
   the bucket, whatever its size.
4. Comparison is sequential: after each batch of 16 min-hashes with m matches in
   n, a pair is dropped once the posterior P(J >= 0.8 | m, n) under a uniform
   prior is below ``MISS``. Survivors are verified on their full shingle sets.
5. Verified links make components. In buckets that still span several, members
   of other components than the largest are compared with all the others, in
   blocks of ``BLOCK`` signatures, across components only, with the same pruning;
   what survives is verified on full sets in its block, which gives spanning
   links and never a list of all pairs. The largest component's members are not
   dealt against each other, so a great group of copies with few strangers costs
   what the strangers cost. So no link between different texts is lost for want
   of a common hub.
6. Components come by hooking trees onto smaller labels, with shortcuts, on
   written tables, until no label moves.

Texts move only for pairs that survive pruning, and signatures only for classes
in a bucket with others.

Edge cases: null and empty texts have no shingles and stay alone; fewer words
than a shingle make one shingle; repeated rows are members of one class; ids
that occur with several texts are told apart by the set's digest; rows without
an id link others and get the least id of their component, null if none has
any; an empty table gives an empty result; ties go to the smaller digest; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Stash
from tesserae.llm.shingles import min_hashes, shingle_set, similar

HASHES = 128
BAND = 4
BATCH = 16
MISS = 1e-6
BLOCK = 256
#: Shingles of a block's side, about; bounds the memory of a task.
BLOCK_SHINGLES = 1 << 21
#: Class ids (16 bytes) and row ids that may be broadcast.
FEW_IDS = 200_000
MAX_ROUNDS = 60


@lru_cache(maxsize=8)
def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """For each batch end n, the fewest matches m with P(J >= threshold | m, n) >= miss.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of signatures a, b (uint16) pass every batch's bound; later batches look at survivors only."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(threshold)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[matches[left] >= least]
        if not len(left):
            break
    return left


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of id and text), n (shingles), c (digest of the set), sig (128 x uint16), bands (32 x long); the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                has = [i for i, s in enumerate(sets) if len(s)]
                c, sig, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if has:
                    low = min_hashes([sets[i] for i in has], HASHES)
                    short = low.astype(np.uint16)
                    for row, i in enumerate(has):
                        c[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        sig[i] = short[row].tobytes()
                        bands[i] = [xxhash.xxh3_64_intdigest(short[row, j : j + BAND].tobytes(), seed=j) - (1 << 63) for j in range(0, HASHES, BAND)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(c, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "n", "c", "sig", "bands"])

    return docs.select("doc_id", "text", row_hash()).mapInArrow(run, "doc_id long, h long, n long, c binary, sig binary, bands array<long>")


def row_hash() -> Column:
    """``h``: what a class's text is looked up by. Texts of equal hash are told apart by their sets' digests."""
    return F.xxhash64("doc_id", "text").alias("h")


def prune(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures survive the sequential test."""
    sig = lambda x: classes.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
                keep = pa.array(survives(a, b, threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, stash: Stash) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets; texts come from the classes' first documents."""
    pairs = stash.write(pairs, "survivors")
    needed = stash.write(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().join(classes.select("c", "h"), "c"), "needed")
    # a short list of rows is broadcast, so that only the texts it names are moved
    few = needed.limit(FEW_IDS + 1).count() <= FEW_IDS
    kept = stash.write(docs.select(row_hash(), "text").join(F.broadcast(needed) if few else needed, "h").dropDuplicates(["c", "text"]), "texts")
    texts = kept.select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[bytes, str, np.ndarray] = (b"", "", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                a, b, ta, tb = (batch.column(i)[row].as_py() for i in range(4))
                if (b, tb) != hub[:2]:
                    hub = (b, tb, shingle_set(tb, width))
                sa = shingle_set(ta, width)
                # rows of equal hash bring several texts: only the class's own counts
                if xxhash.xxh3_128_digest(sa.tobytes()) == a and xxhash.xxh3_128_digest(hub[2].tobytes()) == b and similar(sa, hub[2], percent):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    text = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"t_{x}"))
    joined = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "t_a", "t_b")
    out = stash.write(joined.mapInArrow(run, "a binary, b binary").distinct(), "links")
    stash.drop(kept)
    return out


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """c and comp (least c of its component) of every class in a link.

    Each round, a class and its parent take the least grandparent label among
    the class's neighbours, so whole trees hook onto smaller ones, and labels
    are cut short by one step; rounds grow with the logarithm of the length of
    a chain. Labels only fall, and none moves once all are right.
    """
    both = stash.write(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "edges")
    labels = stash.write(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("comp")), "labels")
    for _ in range(MAX_ROUNDS):
        up = labels.select(F.col("c").alias("comp"), F.col("comp").alias("top"))
        tops = stash.write(labels.join(up, "comp").select("c", "comp", "top"), "tops")
        near = both.join(tops.select(F.col("c").alias("b"), F.col("top").alias("l")), "b").groupBy(F.col("a").alias("c")).agg(F.min("l").alias("l"))
        step = stash.write(tops.join(near, "c"), "step")
        hooked = step.groupBy(F.col("comp").alias("c")).agg(F.min("l").alias("h"))
        least = F.least("top", "l", "h")  # skips nulls
        new = stash.write(step.join(hooked, "c", "left").select("c", least.alias("comp"), (least < F.col("comp")).alias("moved")), "labels")
        more = not new.where("moved").isEmpty()
        for x in (tops, step, labels):
            stash.drop(x)
        labels = new.select("c", "comp")
        labels.stash_path = new.stash_path
        if not more:
            return labels
    raise RuntimeError(f"components: labels still move after {MAX_ROUNDS} rounds")


def _open_pairs(table: pa.Table, sig: np.ndarray, code: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row of a block, the right rows to verify against it.

    These are of another component, of a size that allows the threshold, share
    no earlier band (else the bucket of that band has the pair) and survive.
    """
    cell, size, pos = (table.column(x).to_numpy() for x in ("cell", "n_shingles", "pos"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    bands = sig.view(np.uint64)  # four hashes of 16 bits: one band in one number
    right = np.flatnonzero(cell == j)
    for x in np.flatnonzero(cell == i).tolist():
        others = right[right > x] if i == j else right
        others = others[(code[others] != code[x]) & (np.minimum(size[others], size[x]) >= threshold * np.maximum(size[others], size[x]) - 1e-9)]
        if len(others):
            others = others[~(bands[others, : pos[x]] == bands[x, : pos[x]]).any(1)]
        if len(others):
            yield x, others[survives(np.broadcast_to(sig[x], (len(others), HASHES)), sig[others], threshold)]


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
    return sig, np.unique(np.array([x.hex() for x in table.column("comp").to_pylist()]), return_inverse=True)[1]


def across(open_members: DataFrame, docs: DataFrame, width: int, percent: int, stash: Stash) -> DataFrame:
    """Links (a, b) that join different components within each bucket; enough of them to span what is linked.

    ``open_members`` has key, pos, top (the bucket's largest component), c, h,
    n_shingles, comp and sig. Buckets are dealt in blocks of bounded members and
    shingles: cells below ``others`` hold members of other components than the
    largest and meet each other and all the rest; the largest's cells meet only
    those. A first pass keeps the rows of a block with a surviving pair, a few
    hundred at most; their full sets are joined, and a second pass verifies
    pairs, skipping those already joined within the block, so that neither pass
    gives more rows than it gets.
    """
    threshold = percent / 100
    main = F.col("comp") == F.col("top")
    cells = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = open_members.groupBy("key", main.alias("main")).agg(cells.alias("cells"))
    sizes = sizes.groupBy("key").agg(F.max(F.when(F.col("main"), F.col("cells"))).alias("mains"), F.max(F.when(~F.col("main"), F.col("cells"))).alias("others"))
    cell = lambda n: F.pmod(F.xxhash64("c", F.lit(5)), n).cast("int")
    placed = open_members.join(sizes, "key").withColumn("cell", F.when(main, F.col("others") + cell(F.col("mains"))).otherwise(cell(F.col("others"))))
    last = F.when(main, F.col("others") - 1).otherwise(F.col("others") + F.coalesce("mains", F.lit(0)) - 1)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(F.col("cell"), o).alias("i"), F.greatest(F.col("cell"), o).alias("j")))
    dealt = placed.select("key", "pos", "c", "h", "n_shingles", "comp", "sig", "cell", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "pos", "c", "h", "n_shingles", "comp", "sig", "cell")

    def alive(table: pa.Table) -> pa.Table:
        sig, code = _arrays(table)
        keep = np.zeros(len(code), bool)
        for x, others in _open_pairs(table, sig, code, threshold):
            if len(others):
                keep[x] = True
                keep[others] = True
        return table.filter(pa.array(keep))

    kind = "key long, i int, j int, pos int, c binary, h long, n_shingles long, comp binary, sig binary, cell int"
    left = stash.write(dealt.groupBy("key", "i", "j").applyInArrow(alive, kind), "alive")
    needed = stash.write(left.select("c", "h").distinct(), "needed")
    few = needed.limit(FEW_IDS + 1).count() <= FEW_IDS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()]
                # rows of equal hash bring several texts: only the class's own counts
                mine = pa.array([xxhash.xxh3_128_digest(s) == c for s, c in zip(made, part.column(0).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["c", "set"]).filter(mine)

    own = docs.select(row_hash(), "text").join(F.broadcast(needed) if few else needed, "h").select("c", "text").mapInArrow(sets, "c binary, set binary").dropDuplicates(["c"])

    def forest(table: pa.Table) -> pa.Table:
        sig, code = _arrays(table)
        members = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        c, top = table.column("c").to_pylist(), list(range(int(code.max()) + 1))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        a, b = [], []
        for x, others in _open_pairs(table, sig, code, threshold):
            for y in others.tolist():
                if find(code[x]) != find(code[y]) and similar(members[x], members[y], percent):
                    top[find(code[x])] = find(code[y])
                    a.append(max(c[x], c[y]))
                    b.append(min(c[x], c[y]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return left.join(own, "c").groupBy("key", "i", "j").applyInArrow(forest, "a binary, b binary").distinct()


def _components(docs: DataFrame, width: int, percent: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, c) of ``docs``, and c and comp of every class in a link."""
    threshold = percent / 100
    base = stash.write(signatures(docs, width), "signatures")
    # rows without an id come last
    x = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "n", "sig", "bands")
    classes = stash.write(base.where("c is not null").groupBy("c").agg(F.min(x).alias("x")).select("c", "x.h", F.col("x.n").alias("n_shingles"), "x.sig", "x.bands"), "classes")
    banded = classes.select("c", "n_shingles", F.posexplode("bands").alias("pos", "key"))
    hubs = banded.groupBy("key").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash.write(banded.drop("n_shingles").join(hubs, "key"), "members")
    small = stash.write(classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "h", "n_shingles", "sig"), "banded")
    stash.drop(classes)
    star = members.where("c != hub").select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct()
    links = verify(prune(star, small, threshold), small, docs, width, percent, stash)
    labels = components(links, stash)
    # a bucket of two has been compared in full; others may hold pairs that no hub has joined
    known = members.where("n > 2").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    sizes = known.where("c != hub").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", "top")
    open_members = stash.write(known.where("c != hub").join(spans, "key").join(small, "c").select("key", "pos", "top", "c", "h", "n_shingles", "comp", "sig"), "open")
    rest = stash.write(across(open_members, docs, width, percent, stash), "across")
    stash.drop(open_members)
    if not rest.isEmpty():
        links = stash.write(links.union(rest), "all-links")
        labels = components(links, stash)
    stash.drop(members)
    stash.drop(small)
    stash.free()
    return base.select("doc_id", "h", "n", "c"), labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of the component) of every row of ``docs`` (doc_id, text)."""
    base, labels = _components(docs, width, percent, Stash(docs.sparkSession))
    # the least doc_id over a component, and each row's component by its class
    first = base.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    low = first.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = first.join(low, "comp").select("c", "component_id")
    return base.join(by_class, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the least (doc_id, hash of the text), ids before none.

    Rows are told apart by id and text, so other texts under the same id, and
    rows without an id, stay unless they are near duplicates themselves; rows
    equal in both are one. Texts without words are in no component and all stay.
    """
    stash = Stash(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base, labels = _components(src, width, percent, stash)
    rows = base.where("c is not null").groupBy("h", "c").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    rows = stash.write(rows, "rows")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("x")).select("comp", F.col("x.h").alias("best"))
    # what isn't kept, and what is kept but occurs more than once
    odd = stash.write(rows.join(best, "comp").where("h != best or n > 1").select(F.col("h").alias("_h"), (F.col("h") == F.col("best")).alias("_again")), "dropped")
    few = odd.limit(FEW_IDS + 1).count() <= FEW_IDS
    marked = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))).join(F.broadcast(odd) if few else odd, F.col("_key") == F.col("_h"), "left")
    once = marked.where("_again").dropDuplicates(["_key"])
    return marked.where("_again is null").unionByName(once).select(*docs.columns)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns, over four-word shingles."""
    return near_duplicates(docs, 4, 80).withColumn("kept", F.col("doc_id") == F.col("component_id"))
