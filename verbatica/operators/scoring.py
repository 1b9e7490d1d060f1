"""Error rates of predictions against references.

Errors and lengths are summed as integers and divided once. Pair scores are one row a prediction; every report is an
aggregate of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.editdist import error_columns, safe_rate, word_distance
from ..functions.text import normalize, tokens
from .audit import with_overall

_COUNTS = ("word_errors", "word_count", "char_errors", "char_count")


def pair_scores(refs: DataFrame, hyps: DataFrame, policy: str = "no_punct_lower", key: str = "id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Errors and lengths of every prediction that has a reference; the other columns stay."""
    joined = refs.join(hyps, key)
    r, h = normalize(F.col(ref), policy), normalize(F.col(hyp), policy)
    prepared = joined.withColumns({"__r": r, "__h": h})
    return prepared.withColumns(error_columns(F.col("__r"), F.col("__h"))).drop("__r", "__h")


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]]


def rates(df: DataFrame) -> DataFrame:
    """WER, CER and their mean from summed errors and lengths."""
    out = df.withColumns({"wer": safe_rate(F.col("word_errors"), F.col("word_count")), "cer": safe_rate(F.col("char_errors"), F.col("char_count"))})
    return out.withColumn("combined", 0.5 * F.col("wer") + 0.5 * F.col("cer"))


def group_metrics(pairs: DataFrame, *groups: str) -> DataFrame:
    return rates(pairs.groupBy(*groups).agg(*sums()))


def score_report(pairs: DataFrame, language: str = "language") -> DataFrame:
    """One row a language, ``overall`` (all errors over all lengths) and ``macro`` (mean of the languages)."""
    micro = rates(with_overall(pairs, language, *sums()))
    means = micro.filter(F.col(language) != "overall").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _COUNTS], *[F.avg(c).alias(c) for c in ("wer", "cer", "combined")])
    return micro.unionByName(means.withColumn(language, F.lit("macro")).filter("n > 0"))


def all_policies(refs: DataFrame, hyps: DataFrame, policies: list[str], *groups: str) -> DataFrame:
    """The same metrics under every policy; the join is made once."""
    joined = refs.join(hyps, "id").withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    pick = lambda c: F.coalesce(*[F.when(F.col("policy") == p, normalize(F.col(c), p)) for p in policies])
    prepared = joined.withColumns({"__r": pick("ref"), "__h": pick("hyp")})
    return group_metrics(prepared.withColumns(error_columns(F.col("__r"), F.col("__h"))), "policy", *groups)


def weighted_score(per_language: DataFrame, weights: dict[str, float], value: str = "combined") -> DataFrame:
    """(weighted, macro, n_languages): over the languages that have a weight and a score."""
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("language")]
    scored = per_language.withColumn("w", w).filter("w IS NOT NULL")
    return scored.agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("weighted"), F.avg(value).alias("macro"), F.count(F.lit(1)).alias("n_languages"))


def candidate_score(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """Per language a WER blind to case and a CER that sees it, on texts with collapsed blanks only."""
    joined = refs.join(hyps, "id")
    r, h = F.col("ref"), F.col("hyp")
    lower = lambda c: tokens(F.lower(c))
    scored = joined.withColumns({"word_errors": word_distance(lower(r), lower(h)).cast("bigint"), "word_count": F.size(tokens(r)).cast("bigint"), "char_errors": F.levenshtein(r, h).cast("bigint"), "char_count": F.length(r).cast("bigint")})
    return group_metrics(scored, "language")


def verdict(score: Column, baseline: Column, margin: float = 0.0005) -> Column:
    return F.when(score - baseline > margin, "better").when(baseline - score > margin, "worse").otherwise("same")


def by_selection(pairs: DataFrame, selection: DataFrame, *groups: str) -> DataFrame:
    """Metrics of a mixed system: ``selection`` names a system for every id."""
    return group_metrics(pairs.join(selection, ["id", "system"]), *groups)


def exact_gains(base: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """(id, gain): what taking the other system for one row takes off the corpus error, whose lengths are fixed."""
    total = base.agg(F.sum("word_count").alias("W"), F.sum("char_count").alias("C"))
    both = base.select(key, F.col("word_errors").alias("w0"), F.col("char_errors").alias("c0")).join(other.select(key, F.col("word_errors").alias("w1"), F.col("char_errors").alias("c1")), key)
    gain = 0.5 * (F.col("w0") - F.col("w1")) / F.col("W") + 0.5 * (F.col("c0") - F.col("c1")) / F.col("C")
    return both.crossJoin(F.broadcast(total)).select(key, gain.alias("gain"))


def compare_systems(base: DataFrame, other: DataFrame, threshold: float, *groups: str) -> DataFrame:
    """How often another system is clearly better or worse than the base, row by row."""
    value = lambda df, name: rates(df).select("id", *groups, F.col("combined").alias(name))
    joined = value(base, "a").join(value(other, "b").drop(*groups), "id")
    delta = F.col("b") - F.col("a")
    return joined.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(delta < -threshold).alias("n_better"), F.count_if(delta > threshold).alias("n_worse"))
