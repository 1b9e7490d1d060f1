"""Building blocks for keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot when it holds at least this share of the rows: there can be at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.002
#: Tasks of a step that are always well; beyond them each gets up to so many times the work before there are more.
MANY_TASKS, LARGER = 512, 4


def hot_limit(n_rows: int, share: float = HOT_SHARE, least: int = 64) -> int:
    """The number of rows from which a key counts as hot; at most ``1 / share`` keys can reach it."""
    return max(least, int(n_rows * share))


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, size: str, n_rows: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key), safe against hot keys.

    ``size`` is the column of ``facts`` with the number of rows of the key. The facts of the hot keys, at most
    ``1 / share`` of them by construction, are broadcast; their rows are never shuffled. All other keys meet in
    an ordinary shuffled join, where no key has more than ``share`` of the rows.
    """
    limit = hot_limit(n_rows, share)
    hot = facts.filter(F.col(size) >= limit)
    hot_keys = hot.select(key)
    from_hot = rows.join(F.broadcast(hot), key, "inner")
    cold = rows.join(F.broadcast(hot_keys), key, "left_anti").join(facts.filter(F.col(size) < limit), key, "inner")
    return from_hot.select(*cold.columns).unionByName(cold)


def grouped_prefix_sum(df: DataFrame, group: str, order: str | list[str], weight: str | Column, out: str, buckets: int | None = None) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows of the group that come before or at this row in ``order``.

    Rows are cut into ranges of group and order by quantiles of the rows themselves, whatever the order's distribution,
    and written once so that all uses see the same ranges; inside a range they are summed, and the sums of the ranges
    before are added. No task ever holds a whole group. Rows with equal order come one after another in any order: give
    a tie-break as the last column. ``buckets`` is the number of ranges, by default that of shuffle partitions.
    """
    order = [order] if isinstance(order, str) else order
    weight = F.col(weight) if isinstance(weight, str) else weight
    ranged = cut(df.withColumn("__w", weight).repartitionByRange(*([buckets] if buckets else []), group, *order).withColumn("__p", F.spark_partition_id()))
    # as many rows as there are ranges, and one more for every group that ends inside one
    sums = ranged.groupBy("__p", group).agg(F.sum("__w").alias("__s"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__p").alias("__q"), F.col(group).alias("__of"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__in", F.sum("__w").over(inside))
    joined = summed.join(offsets, (F.col("__p") == F.col("__q")) & F.col(group).eqNullSafe(F.col("__of")))
    return joined.withColumn(out, F.col("__before") + F.col("__in")).drop("__w", "__p", "__q", "__of", "__in", "__before")


def ranked(df: DataFrame, order: str, group: str | None = None, out: str = "rank", parts: int | None = None) -> DataFrame:
    """``out``: the place of every row in ``order``, counted from 0, in its group or in the whole table.

    Rows are cut into ranges of group and order, written once so that both uses see the same ranges; inside a range
    they are numbered, and the sizes of the ranges before are added. No task ever holds a whole group.
    """
    keys = [order] if group is None else [group, order]
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys).withColumn("__p", F.spark_partition_id())
    ranged = cut(ranged)
    inner = ["__p"] if group is None else ["__p", group]
    sizes = ranged.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as there are ranges, and one more for every group that ends inside one
    w = Window.orderBy("__p") if group is None else Window.partitionBy(group).orderBy("__p")
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = ranged.withColumn("__r", F.row_number().over(Window.partitionBy(*inner).orderBy(order)))
    if group is None:
        joined = numbered.join(before, "__p")
    else:
        joined = numbered.join(before.withColumnsRenamed({group: "__g", "__p": "__q"}), (F.col("__p") == F.col("__q")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.col("__b") + F.col("__r") - 1).drop("__p", "__q", "__g", "__b", "__r")


def unit_hash(*columns: Column) -> Column:
    """A hash of the columns as a fraction of [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def even_slots(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that a hash partitioning into ``n`` sends there.

    Hashing the numbers of the partitions themselves would leave some empty and give others several.
    """
    found: dict[int, int] = {}
    tried, step = 0, 16 * n + 64
    while len(found) < n:
        numbers = spark.range(tried, tried + step).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        found = {r["p"]: r["id"] for r in numbers.groupBy("p").agg(F.min("id").alias("id")).collect()} | found
        tried += step
    return [found[p] for p in range(n)]


def fewer_tasks(spark: SparkSession, n: int) -> int:
    """For a step that would have ``n`` tasks: fewer and larger ones where there are many, as each costs the driver memory."""
    return min(n, max(MANY_TASKS, 4 * spark.sparkContext.defaultParallelism, -(-n // LARGER)))
