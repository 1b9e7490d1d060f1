"""Mixing sources to target weights.

Every source contributes its share of the mixture's tokens. The whole is as large as the scarcest source allows when it
is repeated as often as it may be (or as large as asked for). What a source contributes are complete epochs of all its
documents and then a fraction of one more, drawn by weighted sampling without replacement: every document gets an
exponential key scaled by its quality weight, the keys are taken in order, and the documents up to the token budget
are in. A larger mixture may be asked for than the repeats allow; then shares are missed, which the report shows.

The order within a source is never a sort of the source: keys are cut into ranges by their quantiles, the token sums of
the ranges are accumulated, and only rows of one range are ordered together, so a source with a third of all rows is no
single task, however its weights are distributed.

The quality weight is the geometric mean of four parts of a text: words that are written in letters, characters that
are letters, blanks or usual punctuation, lines that are no repeats, and neighbouring word triples that are no repeats.

Defined results: documents with a null id, a source without target or no token are left out; a target without
documents contributes nothing and the other targets keep their proportions; null shares and limits count as 0 and 1;
ties of keys are broken by a hash of id and length; repeated rows are documents of their own; an empty table
gives an empty mixture; extra columns are not looked at. Texts are counted whole.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import grouped_prefix_sum, unit_hash
from ..session import cut
from .tokens import TOKENIZER, token_counts

#: Targets are a table of a few rows, one a source; more than this are refused rather than brought to the driver.
MOST_TARGETS = 100_000
_MARKS = ".,;:!?\"'()[]«»“”‘’…-–—"
_USUAL = regex.compile(r"[\p{L}\p{M}\p{N}\s.,;:!?\"'()«»“”‘’…\-–—]+")


def quality_weight(text: str | None) -> float:
    """How much a text looks like written language, from 0.1 to 1."""
    words = text.split() if text else []
    if not words:
        return 0.1
    lettered = sum(1 for w in words if w.strip(_MARKS).replace("-", "").replace("'", "").replace("’", "").isalpha()) / len(words)
    strange = len(_USUAL.sub("", text)) / len(text)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    fresh = len(set(lines)) / len(lines)
    triples = len(words) - 2
    said_once = len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 1.0
    return max(0.1, (lettered * (1 - strange) * fresh * said_once) ** 0.25)


@F.pandas_udf(T.DoubleType())
def _weights(texts: pd.Series) -> pd.Series:
    return pd.Series([quality_weight(t) for t in texts], dtype="float64")


def budgets(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None = None) -> dict[str, tuple[int, int, int]]:
    """source: (tokens wanted, complete epochs, tokens of the fraction)."""
    live = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and tokens.get(s, 0) > 0]
    whole = sum(w for _, w, _ in live)
    if not live:
        return {}
    most = min(r * tokens[s] * whole / w for s, w, r in live)
    size = most if total is None else total
    out = {}
    for s, w, r in live:
        wanted = min(round(size * w / whole), r * tokens[s])
        out[s] = (wanted, wanted // tokens[s], wanted % tokens[s])
    return out


def _mix(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total: int | None, seed: int, tokenizer: str, scale: float | None) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    listed = targets.select(F.col("source").cast("string"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats"))
    wanted = [(r["source"], r["share"], r["repeats"]) for r in listed.filter("source IS NOT NULL").limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    # at most MOST_TARGETS names
    names = spark.createDataFrame([(s,) for s in sorted({s for s, _, _ in wanted})], "__source string")
    named = docs.filter(F.col(f"`{id_col}`").isNotNull()).join(F.broadcast(names), F.col(f"`{source_col}`") == F.col("__source"), "left_semi")
    counted = cut(token_counts(named, id_col, [text_col], {"source": F.col(f"`{source_col}`"), "w": _weights(F.col(f"`{text_col}`"))}, tokenizer).filter("n_tokens > 0"))
    sizes = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = budgets(wanted, sizes, round(scale * sum(sizes.values())) if scale else total)
    table = spark.createDataFrame([(s, int(e), int(f)) for s, (_, e, f) in plan.items()], "source string, epochs int, fraction bigint")
    u = F.greatest(unit_hash(F.col("id"), F.lit(seed)), F.lit(2.0**-54))
    keyed = counted.withColumns({"at": -F.log(u) / F.col("w"), "tie": F.xxhash64("id", "n_tokens", F.lit(seed))})
    upto = grouped_prefix_sum(keyed, "source", ["at", "tie"], "n_tokens", "upto")
    mixed = upto.join(F.broadcast(table), "source").withColumn("repeats", F.col("epochs") + F.when(F.col("upto") <= F.col("fraction"), 1).otherwise(0))
    report = spark.createDataFrame([(s, float(w), int(r), int(sizes.get(s, 0)), int(plan.get(s, (0, 0, 0))[0])) for s, w, r in wanted], "source string, target_share double, max_repeats int, source_tokens bigint, wanted_tokens bigint")
    return mixed.filter("repeats > 0").select("id", "source", "n_tokens", "w", "repeats"), report


def mixture(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, scale: float | None = None) -> DataFrame:
    """(id, source, n_tokens, w, repeats): the documents of the mixture and how often each is in it.

    ``total`` tokens are wanted, or ``scale`` times those of all sources, or as many as reach every share.
    """
    return _mix(docs, targets, id_col, text_col, source_col, total, seed, tokenizer, scale)[0]


def mixture_shares(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, scale: float | None = None) -> DataFrame:
    """Per target the tokens it contributes, the share reached and the most repeats of a document."""
    mixed, report = _mix(docs, targets, id_col, text_col, source_col, total, seed, tokenizer, scale)
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    filled = report.join(got, "source", "left").fillna(0, ["n_docs", "mixed_tokens", "most_repeats"])
    return filled.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
