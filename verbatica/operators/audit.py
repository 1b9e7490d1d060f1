"""Counts, quantiles, inventories and overlaps of keyed text tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .skew import grouped_prefix_sum


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def nearest_ranks(df: DataFrame, value: Column, quantiles: dict[str, float], *groups: str) -> DataFrame:
    """For every name the value at index ``floor(q * (n - 1))`` of the sorted values of a group, counted from 0.

    Values are counted before they are ranked, so that no group's rows are gathered.
    """
    counted = df.groupBy(*groups, value.alias("v")).agg(F.count(F.lit(1)).alias("c")).filter("v IS NOT NULL")
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    upto = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    return ranked.groupBy(*groups).agg(*[F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q), F.col("v"))).alias(k) for k, q in quantiles.items()])


def linear_quantile(values: str, q: float) -> Column:
    """A quantile as an aggregate, for lengths and other values of which there are few different ones: it keeps a count of
    each. For measures use ``linear_quantiles``."""
    return F.expr(f"percentile({values}, {q}D)")


def linear_quantiles(df: DataFrame, value: Column, quantiles: dict[str, float], *groups: str) -> DataFrame:
    """For every name the value at ``q * (n - 1)`` of the sorted values of a group, between two of them in proportion.

    Values are counted before they are ranked, and ranked in ranges, so that no group's values are gathered. A group
    without values has nulls.
    """
    counted = df.groupBy(*groups, value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    keys = F.struct(*[F.col(g) for g in groups]) if groups else F.lit(1)
    known = counted.filter("v IS NOT NULL").withColumn("__g", keys)
    n = known.groupBy("__g").agg(F.sum("c").alias("n"))
    # the values around each wanted place, by sums over ranges of values
    upto = grouped_prefix_sum(known, "__g", "v", "c", "upto").join(F.broadcast(n) if not groups else n, "__g")
    ends = []
    for k, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        ends += [F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias(f"__lo_{k}"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias(f"__hi_{k}"), F.first(at - F.floor(at)).alias(f"__part_{k}")]
    found = upto.groupBy("__g").agg(*ends)
    between = [(F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__part_{k}")).alias(k) for k in quantiles]
    every = counted.select(keys.alias("__g")).distinct() if groups else df.sparkSession.range(1).select(F.lit(1).alias("__g"))
    out = every.join(found, every["__g"].eqNullSafe(found["__g"]), "left")
    return out.select(*[every["__g"][g].alias(g) for g in groups], *between)


def length_stats(df: DataFrame, text: str, *groups: str) -> DataFrame:
    """Minimum, median, 95th percentile (nearest rank) and maximum of characters and words.

    Lengths have few distinct values: they are counted first, so that no group's rows are gathered.
    """
    out = None
    for name, size in (("chars", F.length(text)), ("words", F.size(tokens(F.col(text))))):
        counted = df.groupBy(*groups, size.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
        upto = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
        n = F.col("n")
        stats = ranked.groupBy(*groups).agg(
            F.min("v").cast("bigint").alias(f"min_{name}"),
            ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0).alias(f"median_{name}"),
            at(F.floor((n - 1) * 0.95)).cast("bigint").alias(f"p95_{name}"),
            F.max("v").cast("bigint").alias(f"max_{name}"),
        )
        out = stats if out is None else (out.join(stats, list(groups)) if groups else out.crossJoin(stats))
    return out


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing): nulls and empty strings, in one pass."""
    one = df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("e")).select("e.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def set_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_left, n_right, n_both, n_only_left, n_only_right) of the distinct keys."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("a") == F.col("b")).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_only_left"), F.count_if(F.col("a").isNull()).alias("n_only_right"))


QUIRKS = {
    "whitespace": lambda c: c != F.trim(c),
    "newline": lambda c: c.contains("\n"),
    "uppercase": lambda c: c.rlike("[A-Z]"),
    "apostrophe": lambda c: c.rlike("['’]"),
    "non_ascii": lambda c: c.rlike(r"[^\x00-\x7F]"),
    "digit": lambda c: c.rlike("[0-9]"),
    "empty": lambda c: F.trim(c) == "",
}


def quirk_counts(df: DataFrame, text: str, *groups: str) -> DataFrame:
    """Rows whose text has each of seven oddities."""
    c = F.coalesce(F.col(text), F.lit(""))
    return df.groupBy(*groups).agg(*[F.count_if(f(c)).alias(f"n_{k}") for k, f in QUIRKS.items()])


def quirk_examples(df: DataFrame, text: str, key: str, order: str, k: int = 8) -> DataFrame:
    """(quirk, rank, key): the first rows with each oddity."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(F.array(*[F.when(f(c), F.lit(q)) for q, f in QUIRKS.items()]), lambda x: x.isNotNull())
    each = df.select(key, order, F.explode(found).alias("quirk"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("quirk").orderBy(order))).filter(F.col("rank") <= k).select("quirk", F.col("rank").cast("bigint").alias("rank"), key)


def character_inventory(df: DataFrame, text: str, group: str, top: int = 40) -> DataFrame:
    """(group, char, n, rank): the most frequent characters of every group, ties by character.

    Texts are counted inside the tasks first: what is shuffled is one row a character and task.
    """
    chars = df.select(group, F.explode(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda x: x != "")).alias("char"))
    counted = chars.groupBy(group, "char").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "char")
    return counted.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top)


def duplicate_surplus(df: DataFrame, text: Column, *groups: str) -> DataFrame:
    """Rows beyond the first of every text."""
    per = df.groupBy(*groups, text.alias("__t")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*groups).agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("c") - 1).alias("n_surplus"))


def shared_texts(df: DataFrame, text: Column, source: str) -> DataFrame:
    """(text, n_sources, n_rows) of texts that several sources have."""
    return df.groupBy(text.alias("text")).agg(F.count_distinct(source).alias("n_sources"), F.count(F.lit(1)).alias("n_rows")).filter("n_sources > 1")


def group_stats(df: DataFrame, text: str, duration: str, *groups: str) -> DataFrame:
    """Rows, empty texts, mean and median of known durations and of characters, hours, repeated texts."""
    t, d = F.coalesce(F.col(text), F.lit("")), F.when(F.col(duration) >= 0, F.col(duration))
    n = F.length(t)
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t == "").alias("n_empty"),
        F.round(F.avg(d), 6).alias("mean_duration"),
        F.round(F.avg(n), 6).alias("mean_chars"),
        F.median(n).alias("median_chars"),  # of lengths there are few different ones
        F.round(F.sum(d) / 3600, 2).alias("hours"),
        (F.count(F.lit(1)) - F.count_distinct(t)).alias("n_repeated"),
    )
    middle = linear_quantiles(df, d, {"median_duration": 0.5}, *groups)
    if not groups:
        return sums.crossJoin(middle)
    middle = middle.withColumnsRenamed({g: f"__{g}" for g in groups})
    return sums.join(middle, reduce(and_, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups])).drop(*[f"__{g}" for g in groups])


def flag_histogram(df: DataFrame, flags: Column, *groups: str) -> DataFrame:
    """(groups, flag, n) of an array of flags."""
    return df.select(*groups, F.explode(flags).alias("flag")).groupBy(*groups, "flag").agg(F.count(F.lit(1)).alias("n"))


def deciles(df: DataFrame, value: Column) -> DataFrame:
    """(decile, n) of a value of [0, 1]; what lies above is in the last."""
    return df.select(F.least(F.floor(value * 10), F.lit(9)).cast("int").alias("decile")).groupBy("decile").agg(F.count(F.lit(1)).alias("n"))


def change_report(left: DataFrame, right: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """How far two systems' texts differ: changed at all, and strongly in length."""
    joined = left.select(key, group, F.col(text).alias("x")).join(right.select(key, F.col(text).alias("y")), key)
    a, b = F.length("x"), F.length("y")
    ratio = b / F.greatest(a, F.lit(1))
    strong = (ratio < 0.65) | (ratio > 1.55) | (F.abs(a - b) > 160)
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != F.col("y")).alias("n_changed"), F.count_if((F.col("x") != F.col("y")) & strong).alias("n_strong"))


def speaker_overlap(rows: DataFrame, language: str, speaker: Column, train: Column) -> DataFrame:
    """Per language: evaluation rows and speakers seen in training, unseen, and without a known speaker."""
    r = rows.select(F.col(language).alias("language"), speaker.alias("s"), train.alias("train")).filter("train IS NOT NULL")
    facts = r.groupBy("language", "s").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")).filter("n_eval > 0")
    known, seen = F.col("s").isNotNull(), F.col("n_train") > 0
    return facts.groupBy("language").agg(
        F.sum(F.when(known & seen, F.col("n_eval")).otherwise(0)).alias("seen_rows"),
        F.sum(F.when(known & ~seen, F.col("n_eval")).otherwise(0)).alias("unseen_rows"),
        F.sum(F.when(~known, F.col("n_eval")).otherwise(0)).alias("unknown_rows"),
        F.count_if(known & seen).alias("seen_speakers"),
        F.count_if(known & ~seen).alias("unseen_speakers"),
    )


def with_overall(df: DataFrame, group: str, *aggregates: Column, name: str = "overall") -> DataFrame:
    """Aggregates per group and of everything, in one pass."""
    out = df.rollup(group).agg(F.grouping(group).alias("__all"), *aggregates)
    return out.withColumn(group, F.when(F.col("__all") == 1, F.lit(name)).otherwise(F.col(group))).drop("__all")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


GATES = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def confidence_gates(df: DataFrame, truth: str, guess: str, confidence: str, gates: tuple[float, ...] = GATES) -> DataFrame:
    """(gate, n_kept, n_right): what remains above each confidence, in one pass over the rows."""
    each = df.select(F.explode(F.filter(F.array(*[F.lit(g) for g in gates]), lambda g: F.col(confidence) >= g)).alias("gate"), (F.col(truth) == F.col(guess)).alias("right"))
    return each.groupBy("gate").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("right").alias("n_right"))


def unusual_characters(df: DataFrame, text: str, group: str, usual: str = r"[\p{L}\p{M}\p{N}\s.,!?;:'\"()-]") -> DataFrame:
    """(group, char, n): rows of the group that have each character outside the usual ones."""
    odd = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda x: (x != "") & ~x.rlike(usual)))
    return df.select(group, F.explode(odd).alias("char")).groupBy(group, "char").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, words: Column) -> DataFrame:
    """(word, n): every distinct word with its occurrences."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def letter_ids(df: DataFrame, text: str) -> DataFrame:
    """(letter, letter_id): the characters of a corpus numbered in their order, the blank as ``|``."""
    seen = df.select(F.explode(F.split(F.col(text), "")).alias("letter")).filter("letter <> ''").distinct().select(F.when(F.col("letter") == " ", "|").otherwise(F.col("letter")).alias("letter")).distinct()
    # an alphabet is small whatever the corpus, so its global order is no bottleneck
    return seen.withColumn("letter_id", (F.row_number().over(Window.orderBy("letter")) - 1).cast("bigint"))
