"""Routing: which system's output to keep for which utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import degenerate, health_reasons, ngram_top, said_words, usable_reasons
from ..functions.text import bind
from .scoring import group_metrics, rates

LOOP_ORDER, LOOP_TIMES = 4, 4


def strategies(pairs: DataFrame, base: str, bad_base: DataFrame, language: str, order: str = "idx") -> DataFrame:
    """(strategy, id, system): the base alone, the best system of each language, the best of each utterance by CER,
    that only where the base is bad or missing, and that only in one language.

    ``pairs``: (id, language, system, idx, errors and lengths); ``bad_base``: (id) of unhealthy base texts.
    """
    scored = rates(pairs)
    ids = pairs.select("id", "language").distinct()
    on_base = pairs.filter(F.col("system") == base).select("id", "system")
    per_language = rates(pairs.groupBy("language", "system", order).agg(*[F.sum(c).alias(c) for c in ("word_errors", "word_count", "char_errors", "char_count")]))
    best_language = per_language.groupBy("language").agg(F.min_by("system", F.struct("combined", order)).alias("system"))
    best = scored.groupBy("id").agg(F.min_by("system", F.struct("cer", order)).alias("best"))
    healthy = on_base.join(bad_base, "id", "left_anti").select("id", F.col("system").alias("kept"))
    chosen = ids.join(best, "id").join(healthy, "id", "left")
    parts = {
        "base": on_base,
        "best_per_language": pairs.select("id", "language", "system").join(best_language, ["language", "system"]).select("id", "system"),
        "best_per_sample": best.select("id", F.col("best").alias("system")),
        "only_bad_base": chosen.select("id", F.coalesce("kept", "best").alias("system")),
        "only_language": ids.join(best, "id").join(on_base.withColumnRenamed("system", "b"), "id", "left").select("id", F.when(F.col("language") == language, F.col("best")).otherwise(F.col("b")).alias("system")).filter("system IS NOT NULL"),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("strategy"), "id", "system")
        out = part if out is None else out.unionByName(part)
    return out


def strategy_report(pairs: DataFrame, selections: DataFrame) -> DataFrame:
    """Metrics of every strategy by one join and one aggregate."""
    return group_metrics(pairs.join(selections, ["id", "system"]), "strategy")


def priority_route(hyps: DataFrame, base: str, priorities: dict[str, list[str]]) -> DataFrame:
    """(id, system, text): an unhealthy base text gives way to the first healthy system of its language's priorities.

    ``hyps``: (id, language, system, hyp). Medians are those of the base's own texts.
    """
    medians = hyps.filter(F.col("system") == base).groupBy("language").agg(F.median(F.length(F.trim("hyp"))).alias("med"))
    listed = [(lang, s, i) for lang, order in priorities.items() for i, s in enumerate(order)]
    table = hyps.sparkSession.createDataFrame(listed, "language string, system string, place int")
    judged = hyps.join(F.broadcast(medians), "language", "left").join(F.broadcast(table), ["language", "system"], "left")
    judged = judged.withColumn("healthy", F.size(health_reasons(F.col("hyp"), median=F.col("med"))) == 0).withColumn("is_base", F.col("system") == base)
    pick = F.struct("system", "hyp")
    best = judged.groupBy("id").agg(
        F.max_by(pick, "is_base").alias("b"), F.max(F.when(F.col("is_base"), F.col("healthy"))).alias("fine"),
        F.min_by(F.when(F.col("healthy") & F.col("place").isNotNull(), pick), F.when(F.col("healthy"), F.col("place"))).alias("alt"), F.max("is_base").alias("has_base"),
    )
    chosen = F.when(F.col("fine") | F.col("alt").isNull(), F.col("b")).otherwise(F.col("alt"))
    out = best.filter("has_base").withColumn("c", chosen)
    return out.select("id", "c.system", F.when(F.trim("c.hyp") == "", ".").otherwise(F.col("c.hyp")).alias("text"))


def language_fallback(base: DataFrame, fallbacks: dict[str, DataFrame]) -> DataFrame:
    """(id, language, text, action): per language its own fallback, taken where the base is bad and it is usable.

    ``base``: (id, language, text, ref); ``fallbacks``: language: (id, text).
    """
    joined = base.withColumn("bad", F.size(usable_reasons(F.col("text"), F.col("language"), F.col("ref"))) > 0)
    text, action = F.col("text"), F.when(F.col("bad"), F.concat(F.lit("keep_base_bad_"), F.col("language"))).otherwise("keep_base")
    for lang, df in fallbacks.items():
        joined = joined.join(df.select("id", F.col("text").alias(f"f_{lang}")), "id", "left")
        candidate, here = F.col(f"f_{lang}"), (F.col("language") == lang) & F.col("bad")
        usable = candidate.isNotNull() & (F.size(usable_reasons(candidate, F.col("language"), F.col("ref"))) == 0)
        text = F.when(here & usable, candidate).otherwise(text)
        action = F.when(here & usable, f"replace_{lang}").when(here, f"keep_base_{lang}_unusable").otherwise(action)
    return joined.select("id", "language", F.when(F.trim(text) == "", ".").otherwise(text).alias("text"), action.alias("action"))


def loop_count(text: Column, order: int = LOOP_ORDER) -> Column:
    return ngram_top(said_words(text), order)


def loop_repair(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, text, switched): a looping text gives way to one that loops less."""
    joined = primary.select("id", F.col("text").alias("p")).join(fallback.select("id", F.col("text").alias("f")), "id", "left")
    n = loop_count(F.col("p"))
    switched = F.col("f").isNotNull() & (n >= LOOP_TIMES) & (loop_count(F.col("f")) < n)
    return joined.withColumn("switched", switched).select("id", F.when(F.col("switched"), F.col("f")).otherwise(F.col("p")).alias("text"), "switched")


def splice(base: DataFrame, overlay: DataFrame, routes: DataFrame, languages: list[str]) -> DataFrame:
    """(id, language, text): the overlay's text in some languages, the base's in the others; ``unk`` without a route."""
    joined = base.select("id", F.col("text").alias("a")).join(overlay.select("id", F.col("text").alias("b")), "id").join(routes.select("id", "language"), "id", "left")
    language = F.coalesce("language", F.lit("unk"))
    return joined.select("id", language.alias("language"), F.when(language.isin(languages), F.col("b")).otherwise(F.col("a")).alias("text"))


def rules_router(candidates: DataFrame, margin: float | None) -> DataFrame:
    """(id, idx): a degenerate or looping first candidate gives way to the first sound one; otherwise the running best
    by model score moves on only for more than a margin.

    ``candidates``: (id, idx, text, score); an utterance has as many as there are systems.
    """
    bad = degenerate(F.col("text")) | (ngram_top(said_words(F.col("text")), 3) >= 3)
    listed = candidates.withColumn("bad", bad).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "bad", "score"))).alias("c"))
    first = F.element_at("c", 1)
    sound = F.try_element_at(F.filter("c", lambda x: (x["idx"] > 0) & ~x["bad"]), F.lit(1))
    by_score = first["idx"]
    if margin is not None:
        better = lambda a, x: F.when((x["idx"] > 0) & x["score"].isNotNull() & (a["score"].isNull() | (x["score"] > a["score"] + margin)), F.struct(x["idx"].alias("idx"), x["score"].alias("score"))).otherwise(a)
        by_score = F.aggregate("c", F.struct(first["idx"].alias("idx"), first["score"].alias("score")), better, lambda a: a["idx"])
    return listed.select("id", F.when(first["bad"] & sound.isNotNull(), sound["idx"]).otherwise(by_score).alias("idx"))


# ---- character language models ----------------------------------------------------------------------------------

_START, _END = "\x02", "\x03"


def _grams(df: DataFrame, text: str, order: int, *keep: str) -> DataFrame:
    """(kept columns, context, char) of every position of the padded text."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s\p{Z}]+", " "))
    padded = F.concat(F.lit(_START * (order - 1)), clean, F.lit(_END))
    at = lambda p: F.sequence(F.lit(1), F.length(p) - (order - 1))
    gram = bind(padded, lambda p: F.transform(at(p), lambda i: F.struct(F.substring(p, i, F.lit(order - 1)).alias("context"), F.substring(p, i + (order - 1), F.lit(1)).alias("char"))))
    return df.select(*keep, F.explode(gram).alias("g")).select(*keep, "g.context", "g.char")


def train_char_lm(df: DataFrame, text: str, language: str, order: int) -> tuple[DataFrame, DataFrame]:
    """(language, context, char, n) and (language, v): n-gram counts, and the letters, end and unknown to share."""
    grams = _grams(df, text, order, language).groupBy(language, "context", "char").agg(F.count(F.lit(1)).alias("n"))
    return grams, grams.groupBy(language).agg((F.count_distinct("char") + 1).alias("v"))


def score_char_lm(df: DataFrame, text: str, language: str, key: str, model: tuple[DataFrame, DataFrame], order: int, alpha: float) -> DataFrame:
    """(key, language, lm_score): mean log probability a character, counts smoothed by ``alpha``.

    Every position meets its n-gram and its context by a join, so that neither table has to fit anywhere.
    """
    grams, sizes = model
    contexts = grams.groupBy(language, "context").agg(F.sum("n").alias("c"))
    wanted = _grams(df, text, order, key, language)
    # equal n-grams of a text are looked up once
    counted = wanted.groupBy(key, language, "context", "char").agg(F.count(F.lit(1)).alias("times"))
    joined = counted.join(grams, [language, "context", "char"], "left").join(contexts, [language, "context"], "left").join(F.broadcast(sizes), language)
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("c", F.lit(0)) + alpha * F.col("v"))
    return joined.groupBy(key, language).agg((F.sum(F.ln(p) * F.col("times")) / F.sum("times")).alias("lm_score"))


def lm_margin_route(primary: DataFrame, fallback: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(id, margin, looped, switched): the fallback where the primary loops more, or is less likely by more than the
    language's threshold. Both: (id, language, text, lm_score)."""
    joined = primary.select("id", "language", F.col("text").alias("p"), F.col("lm_score").alias("sp")).join(fallback.select("id", F.col("text").alias("f"), F.col("lm_score").alias("sf")), "id")
    n = loop_count(F.col("p"))
    looped = (n >= LOOP_TIMES) & (loop_count(F.col("f")) < n)
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("language")]
    margin = F.round(F.col("sf") - F.col("sp"), 9)
    return joined.select("id", margin.alias("margin"), looped.alias("looped"), (looped | F.coalesce(margin > limit, F.lit(False))).alias("switched"))


def recommend(rows: DataFrame, agree: float = 0.35, review: float = 0.65, correct: float = 0.85, low: float = 0.3, high: float = 30.0, max_cps: float = 35.0, max_wps: float = 7.0) -> DataFrame:
    """(id, recommendation, reasons) from (id, original, teacher, duration, flags, combined): keep, review, correct or suspect.

    Rules are tried in order; the reasons collect what was found on the way.
    """
    o, t = F.trim(F.coalesce("original", F.lit(""))), F.trim(F.coalesce("teacher", F.lit("")))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    d = F.coalesce("duration", F.lit(0.0))
    cps, wps = F.when(d > 0, F.length(o) / d).otherwise(0.0), F.when(d > 0, words(o) / d).otherwise(0.0)
    # fixed values: texts that say nothing
    blank = (t == "") | t.isin(".", "...", ",", "?", "!", ";", ":")
    t_bad = blank | (F.length(t) < 12) | (words(t) < 3)
    fast = (cps > max_cps) | (wps > max_wps)
    o_bad = (o == "") | (d < low) | fast
    c = F.col("combined")
    ladder = [
        (blank, "keep_original", None), (o_bad & ~t_bad, "manual_review", "original_suspicious_teacher_plausible"), (c <= agree, "keep_original", "teacher_agrees"),
        ((c >= correct) & ~t_bad, "potential_teacher_correction", "extreme_teacher_disagreement"), (c >= review, "suspicious_label", "high_teacher_disagreement"),
    ]
    name, last = F.lit("manual_review"), F.lit("moderate_teacher_disagreement")
    for holds, value, reason in reversed(ladder):
        name, last = F.when(holds, value).otherwise(name), F.when(holds, F.lit(reason)).otherwise(last)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    found = [
        F.when(o == "", "empty_original"), F.when(d < low, "too_short_audio"), F.when(d > high, "long_audio"), F.when(F.array_contains(flags, "low_energy"), "low_energy"),
        F.when(F.array_contains(flags, "clipped"), "clipped"), F.when(fast, "original_text_rate_extreme"), F.when(t_bad, "teacher_blank_or_short"), last,
    ]
    return rows.select("id", name.alias("recommendation"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("reasons"))


