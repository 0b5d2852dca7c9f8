"""A stream of updates ends with the sums of the batch."""

from pyspark.sql import functions as F

from tesserae.streaming.assembly import assemble_stream


def test_stream_equals_batch(spark, sf, tmp_path):
    x = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("user_id") % 5).alias("bi"), F.lit(0).cast("long").alias("bj"), F.col("event_id").alias("v"))
    x.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = assemble_stream(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in assemble_stream(x).collect()}
    assert {tuple(r) for r in spark.table("sums").collect()} == want
