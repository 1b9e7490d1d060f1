"""Choosing among several hypotheses of one utterance.

Candidates are a long table with one row a hypothesis and its place in an order; an utterance has as many as there are
systems or samples. Pair costs are computed once for each unordered pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.editdist import pair_cost
from ..functions.shape import ngram_top, said_words
from ..session import cut

#: Digits to which risks are rounded before they are compared, so that ties do not hang on the order of a sum.
PLACES = 9


def unique_texts(candidates: DataFrame, key: str = "id", text: str = "norm", order: str = "idx") -> DataFrame:
    """The first candidate of every distinct text."""
    rest = [c for c in candidates.columns if c not in (key, text)]
    return candidates.groupBy(key, text).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, text, "r.*")


def pair_costs(candidates: DataFrame, key: str = "id", text: str = "norm", order: str = "idx") -> DataFrame:
    """(id, i, j, cost) of every ordered pair of different candidates, each unordered pair computed once."""
    a = candidates.select(key, F.col(order).alias("i"), F.col(text).alias("x"))
    b = candidates.select(key, F.col(order).alias("j"), F.col(text).alias("y"))
    once = a.join(b, key).filter("i < j").select(key, "i", "j", pair_cost(F.col("x"), F.col("y")).alias("cost"))
    both = F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return once.select(key, "cost", F.explode(both).alias("p")).select(key, "p.i", "p.j", "cost")


def risks(candidates: DataFrame, weights: str | None = None, key: str = "id", order: str = "idx", costs: DataFrame | None = None) -> DataFrame:
    """The candidates with ``risk``: the mean cost to all candidates, itself among them, weighted if asked.

    ``costs``: those of ``pair_costs`` where they are known already.
    """
    costs = pair_costs(candidates, key, "norm", order) if costs is None else costs
    w = candidates.select(key, F.col(order).alias("j"), (F.col(weights) if weights else F.lit(1.0)).alias("w"))
    summed = costs.join(w, [key, "j"]).groupBy(key, F.col("i").alias(order)).agg(F.sum(F.col("cost") * F.col("w")).alias("__c"))
    total = w.groupBy(key).agg(F.sum("w").alias("__w"))
    joined = candidates.join(summed, [key, order], "left").join(total, key)
    return joined.withColumn("risk", F.round(F.coalesce(F.col("__c"), F.lit(0.0)) / F.greatest(F.col("__w"), F.lit(1e-12)), PLACES)).drop("__c", "__w")


def mbr_medoid(candidates: DataFrame) -> DataFrame:
    """(id, idx, text, risk, anchor_risk, advantage, n): the candidate closest to all, the earliest on a tie.

    ``candidates``: (id, idx, text, norm); the anchor has idx 0.
    """
    scored = risks(unique_texts(candidates))
    best = scored.groupBy("id").agg(
        F.min_by(F.struct("idx", "text", "risk"), F.struct("risk", "idx")).alias("b"), F.max(F.when(F.col("idx") == 0, F.col("risk"))).alias("anchor_risk"), F.count(F.lit(1)).alias("n")
    )
    return best.select("id", "b.idx", "b.text", "b.risk", "anchor_risk", F.round(F.col("anchor_risk") - F.col("b.risk"), PLACES).alias("advantage"), "n")


def weighted_candidates(samples: DataFrame, anchors: DataFrame, anchor_weight: float, temperature: float | None) -> DataFrame:
    """(id, idx, norm, text, is_anchor, weight, sample_count) of samples (id, idx, text, norm, score) and anchors (id, text, norm).

    Equal texts add up; a sample counts 1, or less the further its score is from the best one. The anchor keeps its
    surface and stands first.
    """
    if temperature:
        best = F.max("score").over(Window.partitionBy("id"))
        samples = samples.withColumn("w", F.exp(F.greatest((F.col("score") - best) / temperature, F.lit(-50.0))))
    else:
        samples = samples.withColumn("w", F.lit(1.0))
    grouped = samples.groupBy("id", "norm").agg(F.min("idx").alias("idx"), F.min_by("text", "idx").alias("text"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    known = anchors.select("id", "norm", F.col("text").alias("anchor"))
    # utterances without an anchor are left out, anchors without samples stay
    joined = known.select("id").join(grouped, "id").join(known, ["id", "norm"], "full_outer")
    return joined.select(
        "id", "norm", F.when(F.col("anchor").isNotNull(), -1).otherwise(F.col("idx")).alias("idx"), F.coalesce("anchor", "text").alias("text"), F.col("anchor").isNotNull().alias("is_anchor"),
        (F.coalesce("w", F.lit(0.0)) + F.when(F.col("anchor").isNotNull(), anchor_weight).otherwise(0.0)).alias("weight"), F.coalesce("n", F.lit(0)).alias("sample_count"),
    )


def weighted_mbr(samples: DataFrame, anchors: DataFrame, anchor_weight: float = 1.0, temperature: float | None = None, margin: float = 0.0, costs: DataFrame | None = None) -> DataFrame:
    """(id, text, switched, anchor_risk, best_risk, advantage): leave the anchor only for more than a margin."""
    scored = risks(weighted_candidates(samples, anchors, anchor_weight, temperature), "weight", costs=costs)
    best = scored.groupBy("id").agg(
        F.min_by(F.struct("text", "risk", "is_anchor"), F.struct("risk", (~F.col("is_anchor")).alias("other"), (-F.col("weight")).alias("light"), "idx")).alias("b"),
        F.max_by(F.struct("text", "risk"), "is_anchor").alias("a"),
    )
    advantage = F.round(F.col("a.risk") - F.col("b.risk"), PLACES)
    switched = ~F.col("b.is_anchor") & (advantage > margin)
    return best.select("id", F.when(switched, F.col("b.text")).otherwise(F.col("a.text")).alias("text"), switched.alias("switched"), F.col("a.risk").alias("anchor_risk"), F.col("b.risk").alias("best_risk"), advantage.alias("advantage"))


def mbr_grid(samples: DataFrame, anchors: DataFrame, anchor_weights: list[float], temperatures: list[float | None]) -> DataFrame:
    """(id, anchor_weight, temperature, anchor, text, is_other, advantage): the weighted choice under every pair of parameters.

    Margins are not part of it: whether a choice is taken is told by its advantage. Costs hang on neither parameter and
    are computed once.
    """
    costs = cut(pair_costs(weighted_candidates(samples, anchors, 0.0, None)))
    named, out = anchors.select("id", F.col("text").alias("anchor")), None
    for weight in anchor_weights:
        for t in temperatures:
            chosen = weighted_mbr(samples, anchors, weight, t, -1.0, costs)
            part = chosen.select("id", F.lit(float(weight)).alias("anchor_weight"), F.lit(t).cast("double").alias("temperature"), "text", F.col("switched").alias("is_other"), "advantage")
            out = part if out is None else out.unionByName(part)
    return out.join(named, "id")


def nbest_features(samples: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per utterance the scores' best, gap, mean and spread, the numbers of samples and texts, and the mean cost of the
    anchor to all samples."""
    r = samples.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "idx")))
    stats = r.groupBy("id").agg(
        F.max("score").alias("score_best"), (F.max("score") - F.max(F.when(F.col("r") == 2, F.col("score")))).alias("score_gap"), F.round(F.avg("score"), PLACES).alias("score_mean"),
        F.round(F.stddev_pop("score"), PLACES).alias("score_std"), F.count(F.lit(1)).alias("n_samples"), F.count_distinct("norm").alias("n_unique"), F.max_by("norm", F.struct("score", (-F.col("idx")).alias("i"))).alias("best"),
    )
    # equal texts have equal costs: one comparison a text
    counted = samples.groupBy("id", "norm").agg(F.count(F.lit(1)).alias("n"))
    cost = anchors.select("id", F.col("norm").alias("a")).join(counted, "id").withColumn("c", pair_cost(F.col("a"), F.col("norm")) * F.col("n"))
    anchor_risk = cost.groupBy("id").agg(F.round(F.sum("c") / F.sum("n"), PLACES).alias("anchor_risk"))
    same = anchors.select("id", F.col("norm").alias("a"))
    return stats.join(anchor_risk, "id").join(same, "id").withColumn("best_equals_anchor", F.col("best") == F.col("a")).drop("best", "a")


def alternatives(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(id, text): the other system's text, or the primary's where the other has none."""
    joined = primary.select("id", F.col("text").alias("p")).join(other.select("id", F.col("text").alias("o")), "id", "left")
    return joined.select("id", F.when(F.trim(F.coalesce("o", F.lit(""))) != "", F.col("o")).otherwise(F.col("p")).alias("text"))


def loops(text: Column, order: int = 4, times: int = 4) -> Column:
    return ngram_top(said_words(text), order) >= times


def margin_gate(primary: DataFrame, decisions: DataFrame, threshold: float) -> DataFrame:
    """(id, text, outcome): a decision (id, anchor, alternative, advantage) is taken when its advantage exceeds the
    threshold, unless the primary text is no longer the anchor or the alternative loops."""
    joined = primary.join(decisions, "id", "left")
    qualifies = (F.col("advantage") > threshold) & (F.trim("alternative") != "")
    outcome = F.when(~F.coalesce(qualifies, F.lit(False)), "kept").when(F.col("text") != F.col("anchor"), "blocked_changed").when(loops(F.col("alternative")), "blocked_loop").otherwise("switched")
    judged = joined.withColumn("outcome", outcome)
    return judged.select("id", F.when(F.col("outcome") == "switched", F.col("alternative")).otherwise(F.col("text")).alias("text"), "outcome")


def nbest_oracle(pairs: DataFrame) -> DataFrame:
    """The rows of pair scores (id, idx, ...) with the least corpus cost of their utterance, the earliest on a tie."""
    total = pairs.select("id", "word_count", "char_count").distinct().agg(F.sum("word_count").alias("W"), F.sum("char_count").alias("C"))
    cost = F.round(0.5 * F.col("word_errors") / F.greatest("W", F.lit(1)) + 0.5 * F.col("char_errors") / F.greatest("C", F.lit(1)), 15)
    scored = pairs.crossJoin(F.broadcast(total)).withColumn("cost", cost)
    rest = [c for c in pairs.columns if c != "id"]
    return scored.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("cost", "idx")).alias("r")).select("id", "r.*")


def review_queue(current: DataFrame, samples: DataFrame, top: int) -> DataFrame:
    """(id, expected_loss, risk, n_distinct, central, longest): the utterances whose transcripts are least certain.

    The loss expected of a text is its mean cost to the samples times its words.
    """
    counted = samples.groupBy("id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))
    cost = current.select("id", F.col("norm").alias("c")).join(counted, "id").withColumn("cost", pair_cost(F.col("c"), F.col("norm")) * F.col("n"))
    # a sum of few terms is rounded once, so that it does not hang on their order
    risk = cost.groupBy("id").agg(F.round(F.sum("cost") / F.sum("n"), PLACES).alias("risk"), F.count(F.lit(1)).alias("n_distinct"), F.max_by("norm", F.struct(F.length("norm").alias("l"), (-F.col("idx")).alias("i"))).alias("longest"))
    weighted = risks(counted.withColumn("w", F.col("n").cast("double")), "w")
    central = weighted.groupBy("id").agg(F.min_by("norm", F.struct("risk", "idx")).alias("central"))
    words = current.select("id", F.size(F.filter(F.split("norm", " "), lambda w: w != "")).alias("words"))
    out = risk.join(central, "id").join(words, "id").withColumn("expected_loss", F.round(F.col("risk") * F.col("words"), 6))
    return out.orderBy(F.col("expected_loss").desc(), "id").limit(top).select("id", "expected_loss", "risk", "n_distinct", "central", "longest")
