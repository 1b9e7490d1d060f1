"""The queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import allocation, crosssplit, formatting, leakage, lookalike, mixing, subjects, tokens, truncation


def _held():
    return ~F.lower(F.trim(F.col("original_split"))).isin("train", "external_train")


def _zoo(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "zoo_predictions"), table(spark, d, "zoo_references"), "row_no", "id", "model_name", "target"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncations(*_zoo(spark, d)).filter("cut").select(F.col("row").alias("row_no"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(*_zoo(spark, d)).withColumnRenamed("model", "model_name")


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    dimensions = {"source": F.col("source"), "language": tokens.meant_language(F.col("language")), "text_domain": F.col("text_domain")}
    return tokens.token_budget(table(spark, d, "lm_text"), "row_no", ["transcription", "text"], dimensions)


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The filled records behind every total, and whether all of them have tokens."""
    return p2_token_budget(spark, d).select("dimension", "value", "n_records", (F.col("n_tokens") >= F.col("n_records")).alias("counted"))


def p2_row_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "lm_text"), "row_no", ["transcription", "text"]).withColumnRenamed("id", "row_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = crosssplit.overlap_pairs(table(spark, d, "generalization_mix"), "row_no", "transcription", _held())
    return pairs.select(F.least("train_id", "held_id").alias("row_no_a"), F.greatest("train_id", "held_id").alias("row_no_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    report = crosssplit.overlap_report(table(spark, d, "generalization_mix"), "row_no", "transcription", _held(), "original_split", "source_dataset")
    return report.withColumnsRenamed({"split": "original_split", "source": "source_dataset"})


def _speakers(spark: SparkSession, d: str) -> tuple:
    language = F.coalesce(F.nullif(F.substring_index("id", "_", 1), F.lit("")), F.col("language"))
    return table(spark, d, "prepared_rows"), allocation.speaker_key(language, F.col("speaker_id")), language


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, speaker, _ = _speakers(spark, d)
    return allocation.group_leaks(rows, "row_no", speaker, allocation.split_name(F.col("original_split"))).withColumnRenamed("id", "row_no")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    rows, speaker, language = _speakers(spark, d)
    return allocation.assign_splits(rows, "row_no", speaker, language, F.col("id")).select(F.col("id").alias("row_no"), F.col("grp").alias("speaker"), "new_split")


def p4_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Per new split its rows, and in all the speakers that stand in two."""
    out = p4_splits(spark, d)
    rows = out.groupBy("new_split").agg(F.count(F.lit(1)).alias("n_rows"))
    parted = out.filter("speaker IS NOT NULL").groupBy("speaker").agg((F.min("new_split") < F.max("new_split")).alias("p")).agg(F.count_if("p").alias("n_parted"))
    return rows.crossJoin(F.broadcast(parted))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copy_pairs(table(spark, d, "lm_text"), "row_no", ["transcription", "text"]).select(F.col("a").alias("row_no_a"), F.col("b").alias("row_no_b"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    records = formatting.collapsed_records(table(spark, d, "lm_text"), "row_no", ["transcription", "text"])
    return records.withColumnsRenamed({"rep": "row_no", "field_0": "transcription", "field_1": "text"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "generalization_mix"), "row_no", "transcription").select(F.col("a").alias("row_no_a"), F.col("b").alias("row_no_b"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_forms(table(spark, d, "generalization_mix"), "row_no", "transcription").select(F.col("id").alias("row_no"), "form", "n_letters")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_leaked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "eval_set")
    found = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(found, "item_id", "left").fillna(0, ["n_docs"])


def _mixture(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source"


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(*_mixture(spark, d)).select(F.col("id").alias("doc_id"), "source", "n_tokens", "repeats")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(*_mixture(spark, d))


def p8_shares_beyond(spark: SparkSession, d: str) -> DataFrame:
    """A mixture twice as large as all sources together: repeats bind and shares are missed."""
    return mixing.mixture_shares(*_mixture(spark, d), scale=2.0)


def _subjects(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), table(spark, d, "subject_terms"), table(spark, d, "subject_labels"), "doc_id", "text"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(*_subjects(spark, d))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(*_subjects(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p2_token_budget, p2_row_tokens, p2_records, p3_found, p3_report, p4_found, p4_splits, p4_quotas, p5_found, p5_records,
        p6_found, p6_forms, p7_found, p7_leaked, p8_mixture, p8_shares, p8_shares_beyond, p9_found, p9_composition,
    )
}
