"""A corpus made fit for training: five stages, each over all that the one before kept.

All stages but the last return the columns of ``documents``. A null text is treated
as empty and stays null; extra columns stay, whatever their names but for key_ and nth_.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flurstrom.llm import decontaminate as leaks
from flurstrom.llm import minhash, packing, suffix
from flurstrom.llm import toxicity as tox
from flurstrom.llm.common import bounded, cut, table

#: Bytes of a batch of rows for Python: an executor keeps the buffers of one stage beside the memory of the next.
BATCH = "2m"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = tox.fit(bounded(docs, BATCH), table(spark, sf_dir, "labels"), tox.held(0, 5))
    return docs.where(tox.score_of(F.col("text"), model, spark) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, 0.8) the document with the least id.

    A document is a row's id and text: rows with one id and other texts are others, rows without id come last."""
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")))
    ids = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key")).alias("id"), "text")
    kept = minhash.near_duplicates(ids, id_col="id").where("kept").select(F.col("doc_id.key").alias("key_")).distinct()
    # of rows with equal id and text one stays
    once = docs.withColumn("key_", key).join(kept, "key_", "left_semi")
    return once.withColumn("nth_", F.row_number().over(Window.partitionBy("key_").orderBy("key_"))).where("nth_ = 1").drop("key_", "nth_")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings and the passages of suffix.PASSAGE words that repeat; n_chars is counted anew."""
    out = suffix.remove_repeats(docs, words=suffix.PASSAGE)
    text = F.when(~F.col("row.no_text"), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_passage_bytes") > 0, F.char_length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    texts = docs.select(F.unhex(F.md5("text")).alias("key"), "text").where("text IS NOT NULL")
    found = leaks.overlaps(texts, table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(found, F.unhex(F.md5(docs["text"])) == found["key"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
