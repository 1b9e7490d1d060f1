"""Mined replacement rules and a learned router."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shape
from ..functions.editdist import word_distance
from ..functions.sequence import block_error_counts, in_places, own_phrase_rules, phrase_key, phrase_rules, phrases_in, substitutions
from ..functions.text import compression_ratio, stable_fold
from ..session import cut
from .audit import linear_quantiles
from .lid import marker_scores
from .skew import attach_by_key, ranked

#: ``collect_rules`` refuses to bring a larger rule table to the driver; ``exchanged_phrases`` takes tables of any size.
MOST_RULES = 20_000


def rover_texts(candidates: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """(id, text): the vote of the candidates (id, idx, text) of every utterance, the first one the pivot.

    Each candidate says for every word of the pivot what it has in its place. The ballots are added up by place and
    word; the pivot's word stands unless another choice, which may be to leave it out, has strictly more weight.
    """
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("idx")], F.lit(1.0))
    given = candidates.select("id", "idx", F.coalesce("text", F.lit("")).alias("text"), w.cast("double").alias("w"))
    first = given.groupBy("id").agg(F.min_by("text", "idx").alias("pivot"))
    said = given.join(first, "id").select("id", "idx", "w", F.posexplode(in_places("pivot", "text")).alias("at", "word")).filter("word IS NOT NULL")
    key = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    # what has no letter is no ballot; a word that is left out is
    ballots = said.withColumn("key", key).filter("key <> '' OR word = ''").groupBy("id", "at", "key").agg(F.sum("w").alias("w"), F.max_by("word", F.struct("w", -F.col("idx"))).alias("word"), F.min("idx").alias("by"))
    own = first.select("id", F.posexplode(F.filter(F.split("pivot", r"\s+"), lambda x: x != "")).alias("at", "own"))
    own = own.withColumn("own_key", F.regexp_replace(F.lower("own"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    both = own.join(ballots, ["id", "at"], "left").groupBy("id", "at", "own", "own_key").agg(
        F.max_by(F.struct("key", "word", "w"), F.struct("w", (F.col("key") == F.col("own_key")).alias("own"), (-F.col("by")).alias("by"))).alias("best"), F.sum(F.when(F.col("key") == F.col("own_key"), F.col("w")).otherwise(0.0)).alias("own_w")
    )
    outvoted = (F.col("own_key") != "") & (F.col("best.key") != F.col("own_key")) & (F.col("best.w") > F.col("own_w") + 1e-9)
    words = both.withColumn("said", F.when(outvoted, F.col("best.word")).otherwise(F.col("own"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("l"))
    text = F.array_join(F.transform(F.filter("l", lambda x: x["said"] != ""), lambda x: x["said"]), " ")
    return first.select("id").join(words, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("text"))


def mine_rules(pairs: DataFrame, least: int = 3, reverse: float = 0.34) -> DataFrame:
    """(language, said, meant, n, n_reverse): replacements that occur often and seldom the other way round.

    ``pairs``: (id, language, ref, hyp); every other row in the order of identifiers is mined.
    """
    half = halves(pairs).filter("mined")
    found = half.select("language", F.explode(substitutions("ref", "hyp")).alias("s")).groupBy("language", "s.said", "s.meant").agg(F.count(F.lit(1)).alias("n"))
    other = found.select("language", F.col("said").alias("meant"), F.col("meant").alias("said"), F.col("n").alias("n_reverse"))
    joined = found.filter(F.col("n") >= least).join(other, ["language", "said", "meant"], "left").fillna(0, ["n_reverse"])
    return joined.filter((F.col("n_reverse") <= reverse * F.col("n")) & (F.length("said") >= 2) & (F.col("said") != F.col("meant"))).select("language", "said", "meant", "n", "n_reverse")


def halves(pairs: DataFrame) -> DataFrame:
    """``mined``: every other row in the order of identifiers."""
    return ranked(pairs, "id", out="__at").withColumn("mined", F.col("__at") % 2 == 0).drop("__at")


def collect_rules(rules: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """The rules of every language, the longest phrases first."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: (-len(r["said"]), -r["n"], r["said"], r["meant"])):
        out.setdefault(r["language"], []).append((r["said"], r["meant"]))
    return out


def exchanged_phrases(rows: DataFrame, rules: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: ``text`` with the phrases of the rules of its ``language`` exchanged, as ``phrase_rules`` does with ``collect_rules``.

    ``rules``: (language, said, meant, n), of any number. They stay a table; a text is sent the rules of the phrases
    that stand in it, by the empty phrase it learns that its language has rules at all.
    """
    # a phrase has no line break in it and a null language no mark, so that no two keys are alike
    key = F.concat_ws("\n", F.concat(F.lit("="), "language"), "__said").alias("__key")
    listed = rules.select("language", "said", "meant", "n", F.explode(F.array(phrase_key("said"), F.lit(""))).alias("__said"))
    before = F.struct((-F.length("said")).alias("size"), (-F.col("n")).alias("n"), "said", "meant")
    first = cut(listed.groupBy(key, "__said").agg(F.min_by("meant", before).alias("__meant")))
    longest = first.agg(F.max(F.size(F.split("__said", " ")))).first()[0] or 0
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    there = cut(numbered.select("__row", "language", F.explode(phrases_in(longest)(text)).alias("__said")).select("__row", key))
    facts = cut(there.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).join(first, "__key"))
    own = attach_by_key(there, facts, "__key", "__n", there.count()).groupBy("__row").agg(F.collect_list(F.struct("__said", "__meant")).alias("__rules"))
    return numbered.join(own, "__row", "left").withColumn(out, own_phrase_rules(text, "__rules.__said", "__rules.__meant")).drop("__row", "__rules")


def rule_report(pairs: DataFrame, rules: DataFrame | dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Per language the errors on the rows that were not mined, before and after, and whether the rules are kept.

    ``rules``: the table of ``mine_rules``, however large, or what ``collect_rules`` brought to the driver.
    """
    held = halves(pairs).filter("NOT mined")
    held = held.withColumn("new", phrase_rules(rules)("hyp", "language")) if isinstance(rules, dict) else exchanged_phrases(held, rules, "hyp", "new")
    scored = held.withColumns({"b": block_error_counts("ref", "hyp"), "a": block_error_counts("ref", "new")})
    sums = scored.groupBy("language").agg(
        F.sum("b.word_errors").alias("words_before"), F.sum("a.word_errors").alias("words_after"), F.sum("b.char_errors").alias("chars_before"), F.sum("a.char_errors").alias("chars_after"),
        F.sum(F.size(F.filter(F.split("ref", r"\s+"), lambda w: w != ""))).alias("n_words"), F.sum(F.length("ref")).alias("n_chars"),
    )
    cost = lambda w, c: F.col(w) / F.greatest("n_words", F.lit(1)) + F.col(c) / F.greatest("n_chars", F.lit(1))
    return sums.withColumn("kept", cost("words_after", "chars_after") < cost("words_before", "chars_before"))


def router_features(p: Column, f: Column, language: Column, languages: list[str]) -> dict[str, Column]:
    """What may tell whether a fallback beats a primary text: lengths, overlap, distances, repetition, compression."""
    pw, fw = shape.said_words(p), shape.said_words(f)
    safe = lambda a, b: a / F.greatest(b, F.lit(1))
    out: dict[str, Column] = {}
    for name, t, w in (("p", p, pw), ("f", f, fw)):
        odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
        sizes = F.transform(w, F.length)
        out |= {
            f"{name}_log_chars": F.log1p(F.length(t)), f"{name}_log_words": F.log1p(F.size(w)), f"{name}_distinct": safe(F.size(F.array_distinct(w)), F.size(w)), f"{name}_compression": compression_ratio(t),
            f"{name}_punctuation": safe(odd, F.length(t)), f"{name}_mean_word": safe(F.aggregate(sizes, F.lit(0), lambda s, x: s + x), F.size(w)), f"{name}_longest_word": F.coalesce(F.array_max(sizes), F.lit(0)),
        }
        for n in range(1, 6):
            out |= {f"{name}_top{n}": shape.ngram_top(w, n), f"{name}_repeated{n}": shape.repeated_share(w, n)}
    out |= {
        "chars_ratio": F.ln((F.length(p) + 1) / (F.length(f) + 1)), "words_ratio": F.ln((F.size(pw) + 1) / (F.size(fw) + 1)),
        "jaccard": safe(F.size(F.array_intersect(pw, fw)), F.size(F.array_union(pw, fw))), "word_distance": safe(word_distance(pw, fw), F.greatest(F.size(pw), F.size(fw))),
        "char_distance": safe(F.levenshtein(F.lower(p), F.lower(f)), F.greatest(F.length(p), F.length(f))),
    }
    for name, t in (("p", p), ("f", f)):  # what the words themselves say of the language
        marks = marker_scores(t)
        total = sum(marks.values(), F.lit(0.0))
        out |= {f"{name}_marked_{k}": F.when(total > 0, v / total).otherwise(0.0) for k, v in marks.items()}
    return {k: v.cast("double") for k, v in out.items()} | {f"is_{x}": (language == x).cast("double") for x in languages}


def nested_router(rows: DataFrame, languages: list[str], folds: int = 3, rates: tuple[float, ...] = (0.1, 0.3), least_folds: int = 2, trees: int = 20, seed: int = 5) -> DataFrame:
    """(id, fold, gain, predicted, rate, selected, stable): the rows of every fold judged by what the others taught.

    ``rows``: (id, language, p, f, gain). Folds have the same part of every language. Within the other folds, rows are
    predicted out of their fold and the rate of selection with the largest mean gain is chosen; a forest fitted on all of
    them then predicts the fold. ``stable``: the selections gain in at least ``least_folds`` folds and on the whole.
    """
    features = router_features(F.col("p"), F.col("f"), F.col("language"), languages)
    placed = ranked(rows.withColumn("__o", F.struct(F.sha1(F.col("id").cast("binary")), "id")), "__o", "language", "__at").withColumn("fold", (F.col("__at") % folds).cast("int"))
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(placed.withColumns(features)).select("id", "fold", "gain", "features")
    ready = cut(ready)

    def predicted(train: DataFrame, held: DataFrame) -> DataFrame:
        model = RandomForestRegressor(featuresCol="features", labelCol="gain", numTrees=trees, maxDepth=5, seed=seed).fit(train)
        return model.transform(held).select("id", "fold", "gain", F.col("prediction").alias("predicted"))

    out = None
    for k in range(folds):
        others = [i for i in range(folds) if i != k]
        inner = reduce(DataFrame.unionByName, [predicted(ready.filter(~F.col("fold").isin(k, i)), ready.filter(F.col("fold") == i)) for i in others])
        inner = cut(inner)
        gains = {r: top_rate(inner, r).agg(F.sum(F.when(F.col("selected"), F.col("gain")).otherwise(0.0))).first()[0] or 0.0 for r in rates}
        rate = max(rates, key=lambda r: (gains[r], -r))
        part = top_rate(predicted(ready.filter(F.col("fold") != k), ready.filter(F.col("fold") == k)), rate).withColumn("rate", F.lit(rate))
        out = part if out is None else out.unionByName(part)
    out = cut(out)
    of = out.groupBy("fold").agg(F.sum(F.when(F.col("selected"), F.col("gain")).otherwise(0.0)).alias("g"))
    stable = of.agg(((F.count_if(F.col("g") > 0) >= least_folds) & (F.sum("g") > 0)).alias("stable"))
    return out.crossJoin(F.broadcast(stable))


def top_rate(predicted: DataFrame, rate: float) -> DataFrame:
    """``selected``: the part of the rows with the highest positive predictions; the limit is a quantile, no global sort."""
    limit = linear_quantiles(predicted, F.col("predicted"), {"__limit": 1 - rate})
    return predicted.crossJoin(F.broadcast(limit)).withColumn("selected", (F.col("predicted") >= F.col("__limit")) & (F.col("predicted") > 0)).drop("__limit")
