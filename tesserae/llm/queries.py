"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, media, minhash, mtree, packing, pii, quality, quotes, sitetree, windows
from tesserae.llm.common import documents, table


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over all conversations."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a PGM image, read back, with features."""
    df = media.text_media(table(spark, sf_dir, "documents"), with_media=False)
    n = F.octet_length("payload").cast("long")
    return df.select("doc_id", "n_bytes", n.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", F.sha2("tile_npy", 256).alias("tile_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    df = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return packing.op4(spark, table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return minhash.op5(documents(table(spark, sf_dir, "documents")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.op6(table(spark, sf_dir, "pages"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has as well."""
    return windows.repeated_passages(documents(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each vector whose id is divisible by 100."""
    return mtree.top_k(spark, table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.op10(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quotes, op2_media, op3_bpe, op4_packing, op5_minhash, op6_main_text, op7_substrings, op8_quality, op9_mtree, op10_pii)}

#: Only what DuckDB does on whole tables in little time; the others are held against brute force in tests.
ORACLE: dict[str, str] = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), low AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept FROM n LEFT JOIN low ON low.x = doc_id
""",
    "op9_mtree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
