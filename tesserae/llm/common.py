"""Helpers shared by the operators: reading tables, cutting lineage, names.

Every operator keeps to these rules: null text counts as empty; rows that are
repeated are kept as often as they occur; extra columns of the input, whatever
their names, are ignored, since inputs are first projected to the columns used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name``, read by Spark's own Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (never null) only."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on a local master, as in tests, a temporary one."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stash:
    """Intermediate tables, written as Parquet in the shared folder so that any executor can be lost.

    A table is removed by ``drop`` once nothing reads it any more, by ``closing``
    or when the driver's process ends.
    """

    opened: list[Stash] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tesserae-{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        Stash.opened.append(self)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Run ``df`` now and return the written table."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that ``write`` returned."""
        path = getattr(df, "stash_path", None)
        if path in self.paths:
            self.paths.discard(path)
            _delete(self.spark, path)

    def free(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more; else they stay until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Remove what is left; a session that has ended already is no error here."""
        try:
            if self.paths and self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass
        self.paths.clear()


@contextmanager
def closing() -> Iterator[None]:
    """Removes the tables of every stash that was opened within, once what they were for has been written elsewhere."""
    n = len(Stash.opened)
    yield
    for stash in Stash.opened[n:]:
        stash.close()
    del Stash.opened[n:]
