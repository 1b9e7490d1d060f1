"""Views of the test tables that queries and their SQL share.

``refs`` are the reference texts, ``hyps`` the last delivered prediction of every model and utterance. DuckDB's
``levenshtein`` counts bytes, so both fold what is not ASCII to one letter; white space is collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_wins
from ..session import table

SYSTEMS = ["ctc_small", "ctc_wide", "seq_adapter", "seq_large", "seq_mixed"]
ANCHOR = "seq_large"


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " "), r"[^\x20-\x7E]", "x"))


def sql_plain(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]+', ' ', 'g'), '[^\x20-\x7E]', 'x', 'g'))"


def refs(spark: SparkSession, d: str) -> DataFrame:
    """(id, language, ref)"""
    language = F.coalesce(F.nullif("language", F.lit("")), F.substring_index("id", "_", 1))
    return table(spark, d, "zoo_references").filter("id IS NOT NULL").select("id", language.alias("language"), plain(F.col("target")).alias("ref"))


def hyps(spark: SparkSession, d: str) -> DataFrame:
    """(id, system, ord, hyp)"""
    rows = table(spark, d, "zoo_predictions").filter("id IS NOT NULL").select("id", F.col("model_name").alias("system"), F.col("row_no").alias("ord"), plain(F.col("target")).alias("hyp"))
    return last_wins(rows, ["id", "system"], "ord")


def system(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(id, hyp) of one model"""
    return hyps(spark, d).filter(F.col("system") == name).select("id", "hyp")


SQL = rf"""WITH refs AS (
  SELECT id, coalesce(nullif(language, ''), split_part(id, '_', 1)) AS language, {sql_plain("target")} AS ref FROM zoo_references WHERE id IS NOT NULL),
hyps AS (
  SELECT id, model_name AS system, row_no AS ord, {sql_plain("target")} AS hyp FROM zoo_predictions WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, model_name ORDER BY row_no DESC) = 1)"""


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def word_distance_sql(a: str, b: str) -> str:
    """Both word lists as bytes; at most 126 distinct words a pair."""
    v = f"list_distinct(list_concat({a}, {b}))"
    spell = lambda x: f"list_reduce(list_transform({x}, lambda w: chr(list_position({v}, w)::int)), lambda p, q: p || q, '')"
    return f"levenshtein({spell(a)}, {spell(b)})"


NO_PUNCT = r"[!-#%-*,-/:;?@\[-\]_{}]"


def sql_norm(c: str) -> str:
    """Lower case, punctuation to blanks, blanks collapsed (of an ASCII text)."""
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '{NO_PUNCT}', ' ', 'g'), ' +', ' ', 'g'))"


#: (id, system, language, we, wn, ce, cn) of every pair of reference and prediction, normalized.
PAIRS_SQL = f"""{SQL},
joined AS (SELECT id, system, language, {sql_norm("ref")} AS r, {sql_norm("hyp")} AS h, ref, hyp FROM refs JOIN hyps USING (id)),
split AS (SELECT *, {words_sql("r")} AS rw, {words_sql("h")} AS hw FROM joined),
pairs AS (SELECT id, system, language, ref, hyp, {word_distance_sql("rw", "hw")}::BIGINT AS we, len(rw)::BIGINT AS wn, levenshtein(r, h)::BIGINT AS ce, length(r)::BIGINT AS cn FROM split)"""


def rate_sql(e: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN CASE WHEN {e} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE {e}::DOUBLE / {n} END"
