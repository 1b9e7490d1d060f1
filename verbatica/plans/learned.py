"""Queries on voting, mined rules and the learned router; most have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import block_error_counts, phrase_rules
from ..functions.text import id_language
from ..operators import learn, scoring
from .registry import query
from .scores import candidates, of, pairs
from .views import ANCHOR, SQL, hyps, refs


@query("h15_rover")
def h15(spark, d):
    return learn.rover_texts(candidates(spark, d), {0: 1.5})


@query("g13_block_errors")
def g13(spark, d):
    joined = refs(spark, d).join(of(hyps(spark, d), "ctc_wide"), "id")
    return joined.withColumn("e", block_error_counts("ref", "hyp")).groupBy("language").agg(F.sum("e.word_errors").alias("word_errors"), F.sum("e.char_errors").alias("char_errors"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).join(of(hyps(spark, d), "ctc_small").select("id", "hyp"), "id")


@query("h19_rules")
def h19(spark, d):
    return learn.mine_rules(_pairs(spark, d), least=1)


@query("h19_rule_report")
def h19r(spark, d):
    return learn.rule_report(_pairs(spark, d), learn.mine_rules(_pairs(spark, d), least=1))


@query("e15_phrase_rules")
def e15(spark, d):
    rules = {"eng": [("goat dog", "goat-dog"), ("the", "The")], "lin": [("nze", "nzé")]}
    return of(hyps(spark, d), "ctc_wide").select("id", phrase_rules(rules)("hyp", id_language(F.col("id"))).alias("text"))


def _router_rows(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    gains = scoring.exact_gains(of(p, "ctc_wide"), of(p, ANCHOR))
    named = lambda s, c: of(hyps(spark, d), s).select("id", F.col("hyp").alias(c))
    return gains.join(named("ctc_wide", "p"), "id").join(named(ANCHOR, "f"), "id").withColumn("language", id_language(F.col("id")))


@query("f13_router_features")
def f13(spark, d):
    features = learn.router_features(F.col("p"), F.col("f"), F.col("language"), ["lin", "lug", "sna"])
    return _router_rows(spark, d).select("id", *[F.round(v, 9).alias(k) for k, v in features.items()])


@query("h16_learned_router")
def h16(spark, d):
    return learn.nested_router(_router_rows(spark, d), ["lin", "lug", "sna"])


@query("h16_folds", f"{SQL}, a AS (SELECT id FROM hyps WHERE system = 'ctc_wide' AND id IN (SELECT id FROM refs)), b AS (SELECT id FROM hyps WHERE system = 'seq_large'), r AS (SELECT id, split_part(id, '_', 1) AS language FROM a JOIN b USING (id)), p AS (SELECT *, (row_number() OVER (PARTITION BY language ORDER BY sha1(id), id) - 1) % 3 AS fold FROM r) SELECT fold::INT AS fold, count(*) AS n FROM p GROUP BY fold")
def h16f(spark, d):
    """Every row is predicted in one fold, and folds have the same part of every language."""
    return h16(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
