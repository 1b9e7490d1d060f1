"""Duplicates hidden by formatting differences.

Two records are copies when their fields, in either order and an absent field not counting, agree in all letters
(with their accents), marks and digits, whatever their case, spacing, punctuation and symbols.

Defined results: a null, empty or symbol-only field is absent; records without any letter or digit have no content and
are in no group; records with a null identifier are left out; a repeated identifier counts as one copy per row but is
never paired with itself; ties in the representative cannot occur because it is the minimum identifier; an empty table
gives an empty result; extra columns, whatever their names, are not looked at. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import HOT_SHARE, hot_limit
from ..session import cut

_NOT_CONTENT = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def content_letters(text: str | None) -> str:
    """The letters, marks and digits of a text, composed and case-folded."""
    if not text:
        return ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())
    return _NOT_CONTENT.sub("", folded)


def content_digest(fields: list[str | None]) -> bytes | None:
    """16 bytes that are equal for records of the same content; None without content."""
    parts = sorted(x for x in map(content_letters, fields) if x)
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest() if parts else None


@F.pandas_udf(T.BinaryType())
def _digest_of(fields: pd.DataFrame) -> pd.Series:
    columns = [fields[c].tolist() for c in fields.columns]
    return pd.Series([content_digest(list(row)) for row in zip(*columns)], dtype=object)


def keyed_content(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, key): the content key of every record that has an identifier and content, written once."""
    packed = F.struct(*[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), packed.alias("f")).filter("id IS NOT NULL").select("id", _digest_of("f").alias("key"))
    return cut(keyed.filter("key IS NOT NULL"))


def _hot_keys(keyed: DataFrame, share: float) -> tuple[DataFrame, int]:
    """The keys that hold at least ``share`` of the rows, exactly, from partial counts; there are at most 1/share."""
    limit = hot_limit(keyed.count(), share)
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("key"), limit


def collapse(keyed: DataFrame, hot: DataFrame, salts: int = 32) -> DataFrame:
    """(key, rep, n_copies) of every content.

    Hot keys go through a salted first level, all others through one shuffle on the key.
    """
    salted = keyed.join(F.broadcast(hot), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    first = salted.groupBy("key", "salt").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    from_hot = first.groupBy("key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n_copies"))
    cold = keyed.join(F.broadcast(hot), "key", "left_anti").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    return from_hot.unionByName(cold)


def copies(df: DataFrame, id_col: str, fields: list[str], share: float = HOT_SHARE) -> DataFrame:
    """(id, rep, n_copies): every record with content, its representative and the size of its group."""
    keyed = keyed_content(df, id_col, fields)
    hot = cut(_hot_keys(keyed, share)[0])
    groups = collapse(keyed, hot)
    grouped_hot = groups.join(F.broadcast(hot), "key", "left_semi")
    grouped_cold = groups.join(F.broadcast(hot), "key", "left_anti")
    of_hot = keyed.join(F.broadcast(grouped_hot), "key")
    of_cold = keyed.join(F.broadcast(hot), "key", "left_anti").join(grouped_cold, "key")
    return of_hot.unionByName(of_cold).select("id", "rep", "n_copies")


def copy_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(a, b): for every group of copies its smallest identifier with each other identifier."""
    return copies(df, id_col, fields).filter("n_copies > 1 AND id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()


def collapsed_records(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The records of ``df`` that represent their group, with ``n_copies``; records without content are left out.

    Where the smallest identifier stands on several rows, one of them is returned per row of the table.
    """
    counts = copies(df, id_col, fields).filter("id = rep").groupBy("rep").agg(F.max("n_copies").alias("n_copies"))
    kept = df.select(F.col(f"`{id_col}`").alias("rep"), *[F.col(f"`{f}`").alias(f"field_{i}") for i, f in enumerate(fields)])
    return kept.join(counts, "rep")
