"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, chat, decontaminate, fingerprint, gif, language, licenses, minhash, packing, pages, repair, suffix, toxicity
from .common import table


def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix.digest(table(spark, sf_dir, "documents"), words=suffix.PASSAGE)


def op3_html_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"), pages.learnt())


def op4_language_id(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), toxicity.held(2, 4)
    return language.predict(docs, language.fit(docs, held), held)


def op5_toxicity(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), toxicity.held(0, 5)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), held), held)


def op6_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op7_best_fit_packing(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))
    records = chat.records_of_rows(table(spark, sf_dir, "conversations")).unionByName(probe, allowMissingColumns=True)
    return chat.read_back(chat.formatted(chat.canonical(records)))


def op10_media_columns(spark, sf_dir):
    return gif.read_back(gif.to_media(table(spark, sf_dir, "documents")))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


def op13_document_fingerprints(spark, sf_dir):
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_html_extraction, op4_language_id, op5_toxicity, op6_minhash_near_dedup, op7_best_fit_packing, op8_decontaminate, op9_chat_format, op10_media_columns, op11_cross_tokenizer_alignment, op12_conversation_repair, op13_document_fingerprints)}
ORACLE_SQL = {
    "op1_license_scan": licenses.sql(),
    "op8_decontaminate": decontaminate.SQL,
    "op9_chat_format": chat.SQL,
    "op12_conversation_repair": repair.sql(),
    "op13_document_fingerprints": fingerprint.sql(),
}
