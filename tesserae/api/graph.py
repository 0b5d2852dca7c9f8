"""Block graphs: sizes of blocks and which pairs of them are stored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.elementwise import offsets, row_pointers


class BlockGraph:
    """``dims`` (b, n, off) and ``pattern`` (bi, bj); every block is owned, so there are no ghosts."""

    rank, size = 0, 1

    def __init__(self, sizes: DataFrame, pattern: DataFrame):
        self.spark = sizes.sparkSession
        self.dims = sizes if "off" in sizes.columns else offsets(sizes.select(F.col("b").cast("long").alias("b"), F.col("n").cast("int").alias("n")))
        self._stored = pattern.select(F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"))
        self.pattern = self._stored.distinct()
        self._compared: WeakKeyDictionary[BlockGraph, tuple[bool, bool]] = WeakKeyDictionary()

    # -- constructors -----------------------------------------------------
    @classmethod
    def construct_serial(cls, spark: SparkSession, sizes: Sequence[int], adjacency: Sequence[Sequence[int]]) -> BlockGraph:
        """Blocks 0, 1, ... with their sizes and neighbours."""
        return cls.construct_distributed(spark, range(len(sizes)), sizes, adjacency)

    @classmethod
    def construct_distributed(cls, spark: SparkSession, ids: Sequence[int], sizes: Sequence[int], adjacency: Sequence[Sequence[int]]) -> BlockGraph:
        """As ``construct_serial`` for blocks of any ascending ids."""
        counts = np.fromiter(map(len, adjacency), np.int64, len(adjacency))
        flat = np.concatenate([np.asarray(a, np.int64) for a in adjacency]) if len(adjacency) else np.empty(0, np.int64)
        return cls.construct_distributed_flat(spark, ids, sizes, np.concatenate([[0], np.cumsum(counts)]), flat)

    @classmethod
    def construct_distributed_flat(cls, spark: SparkSession, ids: Sequence[int], sizes: Sequence[int], ptr: Sequence[int], ind: Sequence[int]) -> BlockGraph:
        """From CSR arrays; ValueError unless ids ascend and pointers start at 0, don't fall and fit the indices."""
        b, n, p, j = (np.asarray(x, np.int64) for x in (ids, sizes, ptr, ind))
        if (np.diff(b) <= 0).any() or len(b) != len(n) or (n <= 0).any():
            raise ValueError("ids must ascend and each have a positive size")
        if len(p) != len(b) + 1 or p[0] != 0 or (np.diff(p) < 0).any() or p[-1] != len(j):
            raise ValueError("row pointers don't fit the ids or the indices")
        if len(j) and not np.isin(j, b).all():
            raise ValueError("a neighbour has no size")
        dims = pa.table({"b": b, "n": n.astype(np.int32), "off": np.cumsum(n) - n})
        return cls(spark.createDataFrame(dims), spark.createDataFrame(pa.table({"bi": np.repeat(b, np.diff(p)), "bj": j})))

    @classmethod
    def of(cls, entries: DataFrame, sizes: DataFrame | None = None) -> BlockGraph:
        """The graph of stored entries; sizes from the places seen unless given."""
        if sizes is None:
            sides = entries.select(F.col("bi").alias("b"), F.col("r").alias("p")).union(entries.select("bj", "c"))
            sizes = sides.groupBy("b").agg((F.max("p") + 1).alias("n"))
        return cls(sizes, entries.select("bi", "bj"))

    # -- views --------------------------------------------------------------
    @cached_property
    def _dims(self) -> pa.Table:
        return self.dims.orderBy("b").toArrow()

    @property
    def owned_global_indices(self) -> np.ndarray:
        return self._dims.column("b").to_numpy()

    @property
    def ghost_global_indices(self) -> np.ndarray:
        return np.empty(0, np.int64)

    @property
    def block_sizes(self) -> np.ndarray:
        return self._dims.column("n").to_numpy()

    @cached_property
    def _rows(self) -> dict[int, list[int]]:
        return {r["bi"]: r["cols"] for r in row_pointers(self.pattern).collect()}

    @property
    def adj_ptr(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(self._rows.get(b, ())) for b in self.owned_global_indices.tolist()])]).astype(np.int64)

    @property
    def adj_ind(self) -> np.ndarray:
        place = {b: i for i, b in enumerate(self.owned_global_indices.tolist())}
        return np.array([place[j] for b in place for j in self._rows.get(b, ())], np.int64)

    @cached_property
    def global_scalar_rows(self) -> int:
        return int(self.dims.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    owned_scalar_rows = local_scalar_cols = global_scalar_cols = property(lambda self: self.global_scalar_rows)
    #: A plan for a halo has nothing to say here.
    send_counts = recv_counts = send_counts_scalar = recv_counts_scalar = send_ranks = recv_ranks = property(lambda self: [])

    @cached_property
    def n_blocks(self) -> int:
        return self.dims.count()

    def get_local_index(self, gid: int) -> int:
        """Place of a block among all by id, -1 if there is none."""
        at = np.searchsorted(self.owned_global_indices, gid)
        return int(at) if at < len(self.owned_global_indices) and self.owned_global_indices[at] == gid else -1

    def get_global_index(self, lid: int) -> int:
        return int(self.owned_global_indices[lid])

    # -- structure -------------------------------------------------------------
    def ghosts(self, owned: DataFrame) -> DataFrame:
        """Blocks ``b`` that rows of ``owned`` (b) refer to and that aren't among them."""
        mine = self.pattern.join(owned.select(F.col("b").alias("bi")), "bi", "left_semi").select(F.col("bj").alias("b")).distinct()
        return mine.join(owned.select("b"), "b", "left_anti")

    def _against(self, other: BlockGraph) -> tuple[bool, bool]:
        """Whether ``other`` has blocks or sizes that are not here, and the reverse; one pass over both, done once.

        Tables of the same plan have the same rows and are not read.
        """
        if other not in self._compared:
            sides = [(g._stored.select(F.lit(False).alias("size"), F.col("bi").alias("x"), F.col("bj").alias("y")), g.dims.select(F.lit(True).alias("size"), F.col("b").alias("x"), F.col("n").cast("long").alias("y"))) for g in (self, other)]
            parts = [d.withColumn("side", F.lit(k)) for pair in zip(*sides, strict=True) if not pair[0].sameSemantics(pair[1]) for k, d in enumerate(pair, 1)]
            seen = (False, False)
            if parts:
                each = reduce(DataFrame.union, parts).groupBy("size", "x", "y").agg(F.bit_or("side").alias("side"))
                only = lambda k: F.coalesce(F.max(F.col("side") == k), F.lit(False))
                seen = tuple(each.agg(only(2), only(1)).first())
            self._compared[other] = seen
        return self._compared[other]

    def contains(self, other: BlockGraph) -> bool:
        """Whether the blocks of ``other`` are all here, of the same sizes."""
        return not self._against(other)[0]

    def same(self, other: BlockGraph) -> bool:
        return self is other or not any(self._against(other))

    def union(self, other: BlockGraph) -> BlockGraph:
        return BlockGraph(self.dims, self.pattern.union(other.pattern))

    def places(self) -> DataFrame:
        """bi, bj, r, c of every scalar of the stored blocks."""
        row = self.dims.select(F.col("b").alias("bi"), F.col("n").alias("_r"))
        col = self.dims.select(F.col("b").alias("bj"), F.col("n").alias("_c"))
        x = self.pattern.join(row, "bi").join(col, "bj")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        return x.withColumn("r", upto("_r")).withColumn("c", upto("_c")).select("bi", "bj", "r", "c")

    def rows(self) -> DataFrame:
        """b and r of every scalar row."""
        return self.dims.select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r"))
