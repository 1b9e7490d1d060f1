"""Thresholds, folds and grids: choosing parameters without looking at what they are judged on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_fold
from .skew import ranked


def threshold_gains(samples: DataFrame, thresholds: list[float], *groups: str) -> DataFrame:
    """(groups, threshold, gain, switches) of samples (margin, forced, delta).

    Each sample is counted under every threshold where it is; the sums are what is shuffled.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    each = samples.select(*groups, "margin", "forced", "delta", grid)
    on = F.col("forced") | (F.col("margin") > F.col("threshold"))
    return each.groupBy(*groups, "threshold").agg(F.round(F.sum(F.when(on, F.col("delta")).otherwise(0.0)), 12).alias("gain"), F.count_if(on).alias("switches"))


def choose_threshold(gains: DataFrame, *groups: str) -> DataFrame:
    """The threshold with the largest gain, then the fewest switches, then the largest threshold."""
    best = F.max_by(F.struct("threshold", "gain", "switches"), F.struct("gain", (-F.col("switches")).alias("s"), "threshold"))
    return gains.groupBy(*groups).agg(best.alias("r")).select(*groups, "r.*")


def out_of_fold(samples: DataFrame, thresholds: list[float], folds: int, *groups: str) -> DataFrame:
    """The samples with their ``fold``, the ``threshold`` chosen on all other folds, and whether they ``switched``.

    The gain of all other folds is that of all less that of the fold, so one pass over the samples serves every fold.
    """
    folded = samples.withColumn("fold", stable_fold(F.col("id"), folds))
    inside = threshold_gains(folded, thresholds, "fold", *groups)
    w = Window.partitionBy(*groups, "threshold") if groups else Window.partitionBy("threshold")
    outside = inside.withColumns({"gain": F.round(F.sum("gain").over(w) - F.col("gain"), 12), "switches": F.sum("switches").over(w) - F.col("switches")})
    chosen = choose_threshold(outside, "fold", *groups).select("fold", *groups, "threshold")
    judged = folded.join(F.broadcast(chosen), ["fold", *groups])
    return judged.withColumn("switched", F.col("forced") | (F.col("margin") > F.col("threshold")))


def grid_tune(selections: DataFrame, folds: int, *parameters: str) -> DataFrame:
    """(fold, parameters, error, switches): for every fold the parameters with the least error on the others.

    ``selections``: (id, parameters, errors, switched) with the additive error of each row under each parameter set.
    """
    folded = selections.withColumn("fold", stable_fold(F.col("id"), folds))
    inside = folded.groupBy("fold", *parameters).agg(F.sum("errors").alias("e"), F.count_if("switched").alias("s"))
    w = Window.partitionBy(*parameters)
    outside = inside.withColumns({"error": F.round(F.sum("e").over(w) - F.col("e"), 12), "switches": F.sum("s").over(w) - F.col("s")})
    best = F.min_by(F.struct(*parameters, "error", "switches"), F.struct("error", "switches", *parameters))
    return outside.groupBy("fold").agg(best.alias("r")).select("fold", "r.*")


def nested_choice(choices: DataFrame, margins: list[float], errors: DataFrame, folds: int) -> DataFrame:
    """(fold, anchor_weight, temperature, margin, error, switches): the parameters with the least error, then the fewest
    switches, on all other folds.

    ``choices``: those of ``select.mbr_grid``; ``errors``: (id, text, word_errors, word_count, char_errors, char_count).
    Every choice is judged under every margin where it is; what is shuffled are sums by fold and parameters.
    """
    each = choices.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    each = each.withColumn("switched", F.col("is_other") & (F.col("advantage") > F.col("margin"))).withColumn("said", F.when(F.col("switched"), F.col("text")).otherwise(F.col("anchor")))
    judged = each.join(errors.withColumnRenamed("text", "said"), ["id", "said"]).withColumn("fold", stable_fold(F.col("id"), folds))
    parameters, sums = ["anchor_weight", "temperature", "margin"], ["word_errors", "word_count", "char_errors", "char_count"]
    inside = judged.groupBy("fold", *parameters).agg(*[F.sum(c).alias(c) for c in sums], F.count_if("switched").alias("switches"))
    w = Window.partitionBy(*parameters)
    outside = inside.select("fold", *parameters, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in [*sums, "switches"]])
    rate = lambda e, n: F.col(e) / F.greatest(F.col(n), F.lit(1))
    outside = outside.withColumn("error", F.round(0.5 * rate("word_errors", "word_count") + 0.5 * rate("char_errors", "char_count"), 12))
    best = F.min_by(F.struct(*parameters, "error", "switches"), F.struct("error", "switches", *parameters))
    return outside.groupBy("fold").agg(best.alias("r")).select("fold", "r.*")


def contiguous_margins(samples: DataFrame, margins: list[float], folds: int, language: str, order: str, score: Column) -> DataFrame:
    """(language, margin, mean): mean scores over contiguous folds of equal size; rows past the last fold are dropped.

    ``score`` may use the column ``margin``; it is computed for every row under every margin.
    """
    sizes = samples.groupBy(F.col(language).alias("__l")).agg(F.greatest(F.expr(f"count(1) div {folds}"), F.lit(1)).alias("__size"))
    placed = ranked(samples, order, language, "__at").join(F.broadcast(sizes), F.col(language).eqNullSafe(F.col("__l")))
    kept = placed.filter(F.col("__at") < F.col("__size") * folds)
    each = kept.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    return each.groupBy(language, "margin").agg(F.round(F.avg(score), 9).alias("mean"))


def sweep_best(metrics: DataFrame, value: str, *parameters: str) -> DataFrame:
    """The parameter set with the least value of a finished sweep."""
    return metrics.agg(F.min_by(F.struct(*parameters, value), F.struct(value, *parameters)).alias("r")).select("r.*")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
