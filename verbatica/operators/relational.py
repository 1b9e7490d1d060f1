"""Keyed filters, samples, joins and alignments.

Tables carry an ``ord`` column where the order of rows matters; nothing depends on the physical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import ranked


def split_language_filter(df: DataFrame, languages: list[str] | None = None, split: str | None = None, language_col: str = "language", split_col: str = "original_split") -> DataFrame:
    """Rows of the languages and the split; either may be left open."""
    if languages is not None:
        df = df.filter(F.col(language_col).isin(languages))
    return df if split is None else df.filter(F.col(split_col) == split)


def semi_by_id(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the manifest."""
    return df.join(manifest.select(key), key, "left_semi")


def missing_by_id(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys of the manifest that the rows lack."""
    return manifest.select(key).distinct().join(df.select(key), key, "left_anti")


def duration_filter(df: DataFrame, low: float, high: float, col: str = "duration") -> DataFrame:
    """Rows within the range, and those whose duration is unknown (null or negative)."""
    d = F.col(col)
    return df.filter(d.isNull() | (d < 0) | d.between(low, high))


def seeded_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: the SHA-1 of seed and key."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def first_per_group(df: DataFrame, groups: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of every group; only n rows a group and task are ever shuffled."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def capped_sample(df: DataFrame, groups: list[str], cap: int, key: str, seed: int) -> DataFrame:
    """A seeded sample of at most ``cap`` rows a group."""
    return first_per_group(df, groups, cap, seeded_order(F.col(key), seed), F.col(key))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """A seeded sample of ``n`` rows."""
    return df.orderBy(seeded_order(F.col(key), seed), F.col(key)).limit(n)


def contiguous_shard(df: DataFrame, shards: int, index: int, key: str) -> DataFrame:
    """The ``index``-th of ``shards`` parts of the rows in the order of a key; the first parts take the remainder."""
    total = df.count()
    size, rest = divmod(total, shards)
    start = index * size + min(index, rest)
    stop = start + size + (1 if index < rest else 0)
    return ranked(df, key, out="__at").filter((F.col("__at") >= start) & (F.col("__at") < stop)).drop("__at")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one that comes last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one that comes first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def left_default(df: DataFrame, other: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with values for what the other side lacks."""
    joined = df.join(other, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns])


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n, example): keys that only one side has; empty when both cover each other."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))
    return only.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))


def assert_coverage(left: DataFrame, right: DataFrame, key: str) -> None:
    found = coverage(left, right, key).collect()
    if found:
        raise ValueError("; ".join(f"{r['n']} {r['side']} keys, such as {r['example']}" for r in found))


def in_all_systems(df: DataFrame, key: str, system: str, n: int) -> DataFrame:
    """Keys that each of ``n`` systems has."""
    return df.groupBy(key).agg(F.count_distinct(system).alias("__n")).filter(F.col("__n") == n).select(key)


def disjoint_union(frames: list[DataFrame], key: str) -> DataFrame:
    """The rows of all frames; a key in more than one is an error."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    twice = out.groupBy(key).count().filter("count > 1").select(key).limit(3).collect()
    if twice:
        raise ValueError(f"keys in more than one input: {[r[0] for r in twice]}")
    return out


def text_anti(df: DataFrame, other: DataFrame, key: Column, other_key: Column) -> DataFrame:
    """Rows whose text key does not occur on the other side; empty keys on that side count for nothing."""
    held = other.select(other_key.alias("__k")).filter(F.col("__k") != "").distinct()
    return df.withColumn("__k", key).join(held, "__k", "left_anti").drop("__k")


def text_overlap(df: DataFrame, other: DataFrame, key: Column, other_key: Column, group: str) -> DataFrame:
    """Per group the rows and how many of their texts occur on the other side."""
    held = other.select(other_key.alias("__k")).filter(F.col("__k") != "").distinct().withColumn("__in", F.lit(1))
    return df.withColumn("__k", key).join(held, "__k", "left").groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count("__in").alias("n_shared"))


def align_to(sample: DataFrame, predictions: DataFrame, key: str, order: str, fill: str = ".") -> DataFrame:
    """The predictions in the order and with the keys of the sample; missing ones filled."""
    joined = sample.select(key, order).join(predictions, key, "left")
    rest = [c for c in joined.columns if c not in (key, order)]
    return joined.select(key, order, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in rest])


def order_mismatches(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """(n_left, n_right, n_misplaced): whether two tables list the same keys in the same order."""
    a = left.select(F.col(order).alias("__o"), F.col(key).alias("a"))
    b = right.select(F.col(order).alias("__o"), F.col(key).alias("b"))
    both = a.join(b, "__o", "full_outer")
    return both.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_misplaced"))


def speaker_capped(df: DataFrame, languages: str, speaker: str, per_speaker: int, per_language: int, order: str, full: bool = False) -> DataFrame:
    """In order, at most so many rows a speaker and then so many a language; ``full``: fails if a language has fewer."""
    w1 = Window.partitionBy(languages, speaker).orderBy(order)
    w2 = Window.partitionBy(languages).orderBy(order)
    kept = df.withColumn("__s", F.row_number().over(w1)).filter(F.col("__s") <= per_speaker)
    out = kept.withColumn("__l", F.row_number().over(w2)).filter(F.col("__l") <= per_language).drop("__s", "__l")
    if full:
        short = out.groupBy(languages).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < per_language).limit(20).collect()
        if short:
            raise ValueError(f"fewer than {per_language} rows: { {r[0]: r[1] for r in short} }")
    return out


def balanced(df: DataFrame, group: str, order: str) -> DataFrame:
    """Every group repeated up to the size of the largest: whole copies, then its first rows; ``copy`` tells them apart."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    top = sizes.agg(F.max("__n").alias("__top"))
    plan = sizes.crossJoin(F.broadcast(top)).select(group, F.expr("__top div __n").alias("__k"), F.expr("__top % __n").alias("__rest"))
    placed = ranked(df, order, group, "__rn").join(F.broadcast(plan.withColumnRenamed(group, "__h")), F.col(group).eqNullSafe(F.col("__h")))
    copies = F.sequence(F.lit(1), (F.col("__k") + F.when(F.col("__rn") < F.col("__rest"), 1).otherwise(0)).cast("int"))
    return placed.withColumn("copy", F.explode(copies)).drop("__rn", "__k", "__rest", "__h")
