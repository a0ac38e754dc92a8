"""The queries of the operators, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm import (collocations, decontaminate, language, licences, nb_svm, ngram_join, packing, pii, quality, secrets_scan,
                            source_audit, toxicity, urls)
from codewarden.llm.common import fold, table


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), with_ids=False).drop("source")


def op4_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"))


def op5_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets_scan.scan(table(spark, d, "documents"))


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"))


def op7_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join(table(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    langs, model = language.fit(docs.where(fold("doc_id", 4) != 2))
    return language.predict(docs, langs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(table(spark, d, "documents"), licences.known_licences(spark))


def op11_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = nb_svm.fit(docs, labels.where(fold("doc_id", 4) != 2))
    return nb_svm.score(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= nb_svm.THRESHOLD).cast("int").alias("predicted"), "margin")


def op12_source_audit(spark: SparkSession, d: str) -> DataFrame:
    return source_audit.audit(table(spark, d, "documents"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.mine(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_personal_data": op4_personal_data,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_license_scan": op10_license_scan,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_source_audit": op12_source_audit,
    "op13_collocations": op13_collocations,
}
