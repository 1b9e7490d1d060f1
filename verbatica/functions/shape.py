"""Shape and degeneracy features of transcripts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, token_key, tokens

# Thresholds of the health flags.
SHORT_CHARS, MIN_WORDS, RUN, CHAR_RUN, REF_RATIO, MEDIAN_RATIO = 4, 2, 3, 12, 0.20, 0.15
# What a text of nothing but punctuation may consist of.
PUNCTUATION_ONLY = r"""^[\s.,!?;:'"()\[\]{}\-_/\\|]+$"""


def is_empty(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def is_dots(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).rlike(r"^\.+$")


def is_punctuation(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).rlike(PUNCTUATION_ONLY)


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours in an array."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, x: Column) -> Column:
        run = F.when((state["run"] > 0) & (x == state["last"]), state["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda s: s["best"])


def token_run(c: Column) -> Column:
    """The most times a word is said in a row, case aside."""
    return longest_run(F.transform(tokens(c), F.lower))


def char_run(c: Column) -> Column:
    """The most times a character stands in a row; white space ends a run."""
    runs = F.transform(tokens(c), lambda w: longest_run(F.filter(F.split(w, ""), lambda x: x != "")))
    return F.coalesce(F.array_max(runs), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a word array, joined by blanks."""
    none = F.array().cast("array<string>")
    return bind(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def repeats_at_once(words: Column, n: int = 3) -> Column:
    """Whether some n words are said again right behind themselves."""
    at = lambda w: F.when(F.size(w) >= 2 * n, F.sequence(F.lit(1), F.size(w) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
    return bind(words, lambda w: F.exists(at(w), lambda i: F.slice(w, i, n) == F.slice(w, i + n, n)))


def ngram_top(words: Column, n: int) -> Column:
    """How often the most frequent n-gram of a word array occurs."""
    sorted_grams = F.array_sort(ngrams(words, n))  # equal ones stand together: one pass finds the longest run
    return longest_run(sorted_grams)


def said_words(c: Column) -> Column:
    """Words by their comparison keys, without bare punctuation."""
    return F.filter(F.transform(tokens(c), token_key), lambda w: w != "")


def repeated_share(words: Column, n: int) -> Column:
    """The part of the n-grams that has occurred before."""
    return bind(ngrams(words, n), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def very_short(c: Column, chars: int = 12, words: int = 3) -> Column:
    return (F.length(F.trim(c)) < chars) | (F.size(tokens(c)) < words)


def very_long(c: Column, chars: int = 650, words: int = 90) -> Column:
    return (F.length(F.trim(c)) > chars) | (F.size(tokens(c)) > words)


def with_language_median(df: DataFrame, text: str, language: Column, out: str = "med") -> DataFrame:
    """``out``: the median number of characters of the stripped texts of a row's language.

    Lengths are counted by value inside the aggregate; the medians, one a language, are sent to the rows.
    """
    named = df.withColumn("__l", language)
    medians = named.groupBy("__l").agg(F.median(F.length(F.trim(text))).alias(out)).withColumnRenamed("__l", "__m")
    return named.join(F.broadcast(medians), F.col("__l").eqNullSafe(F.col("__m")), "left").drop("__l", "__m")


def degenerate(c: Column, least: int = 3) -> Column:
    """Fewer than ``least`` characters but dots and blanks."""
    return F.length(F.translate(F.coalesce(c, F.lit("")), ". ", "")) < least


def reasons(**flags: Column) -> Column:
    """The names of the flags that hold, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull())


def health_reasons(c: Column, reference: Column | None = None, median: Column | None = None) -> Column:
    """What is wrong with a prediction; empty when it is healthy."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = F.length(t)
    flags = {
        "empty": n == 0,
        "dot_only": is_dots(t),
        "length_le_threshold": n <= SHORT_CHARS,
        "fewer_than_min_words": F.size(tokens(t)) < MIN_WORDS,
        "punctuation_only": is_punctuation(t),
        "repeated_token_collapse": token_run(t) >= RUN,
        "repeated_ngram": repeats_at_once(F.transform(tokens(t), F.lower)),
        "ctc_char_collapse": char_run(t) >= CHAR_RUN,
    }
    if reference is not None:
        size = F.length(F.trim(reference))
        flags["low_reference_ratio"] = (size > 0) & (n < REF_RATIO * size)
    if median is not None:
        flags["low_language_median_ratio"] = (median > 0) & (n < MEDIAN_RATIO * median)
    return reasons(**flags)


def usable_reasons(c: Column, language: Column, reference: Column | None = None, short: dict[str, tuple[int, int]] | None = None, least_ratio: float = 0.20) -> Column:
    """The stricter variant with limits of its own for some languages: (fewest characters, most words that are too few)."""
    short = short if short is not None else {"lin": (12, 2), "sna": (12, 2)}
    t = F.trim(F.coalesce(c, F.lit("")))
    n, w = F.length(t), F.size(tokens(t))
    flags = {
        "empty": n == 0,
        "dot_only": is_dots(t),
        "length_le_3": n <= 3,
        "punctuation_only": is_punctuation(t),
        "repeated_token_run_ge3": token_run(t) >= RUN,
        "ctc_char_collapse": char_run(t) >= CHAR_RUN,
        **{f"very_short_{k}": (language == k) & ((n < c0) | (w <= w0)) for k, (c0, w0) in short.items()},
    }
    if reference is not None:
        size = F.length(F.trim(reference))
        flags["very_short_vs_reference"] = language.isin(*short) & (size > 0) & (n < least_ratio * size)
    return reasons(**flags)


SEVERE = ["empty", "dot_only", "length_le_3", "punctuation_only", "repeated_token_run_ge3", "ctc_char_collapse"]
