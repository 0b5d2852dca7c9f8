"""A pipeline over ``documents``: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``; other columns of ``docs`` are kept as they are, whatever their
names.

Edge cases, the same in every stage: null text counts as empty (and stays null
where nothing is changed); an empty table gives an empty one. Quality: without
labels all scores are 0.5 and nothing goes. Near duplicates: of texts that are
near copies one stays, ties going to the least (doc_id, hash of the text);
texts without words all stay; other texts under an id that is repeated, and rows
without an id, stay unless they are copies themselves. Repeated passages: rows
without an id are left whole; a text's places are cut in that text only, though
others share its id; what is left of a text may be empty. Personal data: where
spans overlap the earlier is replaced whole. Packing: a text without tokens is
one token, and rows are packed as often as they occur. Texts are taken whole,
however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import common, minhash, packing, pii, quality, windows
from tesserae.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is under the threshold."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8), that of least id; see ``minhash.keep_one``.

    Documents without words, without an id or with an id that others have stay
    unless they are near duplicates themselves; rows that repeat one stay once.
    """
    ship(spark)
    return minhash.keep_one(docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has as well; see ``windows.cut_repeats``."""
    ship(spark)
    return windows.cut_repeats(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets."""
    ship(spark)
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 1024 tokens; one row per piece, with its ids."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality_classifier), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", mask_pii), ("packing", pack)]

#: Min-hashing, the classifiers and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's tables go once its result is written."""
    stash = common.Stash(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.closing():
            new = stash.write(stage(spark, docs, sf_dir), name)
        stash.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
