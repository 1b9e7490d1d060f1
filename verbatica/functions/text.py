"""Text normalization and scalar string functions, as Column expressions.

Python's notion of white space is wider than that of Java's ``\\s``; ``SPACE`` names all of it.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: Tags that transcribers leave for what is not speech.
TAGS = ["music", "noise", "silence", "laughter", "applause", "inaudible", "unk"]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Nothing outside a lambda is shared with its rounds: an expression named inside is evaluated anew for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_space(c: Column) -> Column:
    """Runs of any white space become one blank, none is left at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_punctuation(c: Column) -> Column:
    """Punctuation of any script becomes a blank."""
    return F.regexp_replace(c, r"\p{P}", " ")


def drop_punctuation(c: Column) -> Column:
    """Punctuation of any script is removed, joining what it parted."""
    return F.regexp_replace(c, r"\p{P}", "")


def remove_artifacts(c: Column) -> Column:
    """Control tokens, bracketed tags, notes and control characters become blanks."""
    for pattern in (r"<\|[^|]+\|>", r"(?i)\[(?:" + "|".join(TAGS) + r")\]", "[♪♫♬]", r"\p{C}"):
        c = F.regexp_replace(c, pattern, " ")
    return c


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; the one step of normalization that Spark has no expression for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _raw(c: Column) -> Column:
    return collapse_space(c)


def _starter_lower(c: Column) -> Column:
    return F.lower(collapse_space(c))


def _no_punct_lower(c: Column) -> Column:
    return collapse_space(strip_punctuation(F.lower(c)))


def _language_safe(c: Column) -> Column:
    return collapse_space(strip_punctuation(remove_artifacts(F.lower(c))))


#: Named policies; the input is taken to be composed (apply ``nfc`` first where it may not be).
POLICIES: dict[str, Callable[[Column], Column]] = {
    "raw": _raw,
    "starter_lower": _starter_lower,
    "no_punct_lower": _no_punct_lower,
    "language_safe": _language_safe,
}


def normalize(c: Column, policy: str, compose: bool = False) -> Column:
    """A text under a named policy; null counts as empty."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    c = F.coalesce(c, F.lit(""))
    return POLICIES[policy](nfc(c) if compose else c)


def sanitize(c: Column, fallback: str = ".") -> Column:
    """Fit for a one-line text column: no replacement or control characters, never empty."""
    clean = collapse_space(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "�", ""), r"\p{C}", " "))
    return F.when(clean == "", fallback).otherwise(clean)


def tokens(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), lambda w: w != "")


def token_key(w: Column) -> Column:
    """A word for comparison: lower case, nothing but letters and digits at its ends."""
    return F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def collapse_trailing_dots(c: Column, least: int = 3, keep: bool = False) -> Column:
    """A run of at least ``least`` dots at the end goes, or becomes one; an emptied text is a dot."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?:\s*\.){" + str(least) + r",}\s*$", "." if keep else "")
    bare = collapse_space(bare)
    return F.when(bare == "", ".").otherwise(bare)


def sentence_case(c: Column) -> Column:
    """Upper case for the first character and for plain letters that begin a sentence."""
    first = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    pieces = F.split(first, r"(?<=[.!?]['\")\]]?\s{1,64})(?=[a-z])")
    return F.array_join(F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)), "")


def file_safe(c: Column) -> Column:
    """Letters, digits and ``-_.`` stay, anything else is an underscore, none of which stays at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), "^_+|_+$", "")


def ctc_text(c: Column) -> Column:
    """Output of a letter model: its word delimiter is a blank."""
    return collapse_space(F.translate(c, "|", " "))


def sentence_split(c: Column) -> Column:
    """Parts of a document behind closing punctuation and at line breaks, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s) != "")


def stitch(left: Column, right: Column, most: int = 25, least: int = 2) -> Column:
    """Two overlapping word arrays as one: the longest end of ``left`` that begins ``right`` is said once."""
    keys = F.struct(F.transform(left, token_key).alias("l"), F.transform(right, token_key).alias("r"))
    upto = F.least(F.lit(most), F.size(left), F.size(right))
    sizes = F.when(upto >= least, F.sequence(upto, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = bind(keys, lambda k: F.filter(sizes, lambda n: F.slice(k["l"], F.size(k["l"]) - n + 1, n) == F.slice(k["r"], F.lit(1), n)))
    n = F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))
    return F.concat(left, F.slice(right, n + 1, F.greatest(F.size(right), F.lit(1))))


def window_plan(duration: Column, window: float, overlap: float) -> Column:
    """(start, end) of the windows that cover a duration, the last one cut at its end."""
    step = window - overlap
    count = F.when(duration <= window, F.lit(0)).otherwise(F.ceil((duration - window) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((i * step).cast("double").alias("start"), F.least(i * step + window, duration).cast("double").alias("end")))


#: Ways to look at a text when the normalization behind a published score is unknown.
PROBES: dict[str, Callable[[Column], Column]] = {
    "raw": lambda c: c,
    "lower": F.lower,
    "no_punct": lambda c: collapse_space(drop_punctuation(c)),
    "lower_no_punct": lambda c: collapse_space(drop_punctuation(F.lower(c))),
}


def rate(amount: Column, duration: Column) -> Column:
    """Amount per second; 0 without a positive duration."""
    return F.when(duration > 0, amount / duration).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Deflated bytes for each character of a text; loops make it small."""
    return texts.map(lambda t: len(zlib.compress((t or "").encode())) / max(len(t or ""), 1)).astype("float64")


def stable_fold(key: Column, k: int) -> Column:
    """The fold of a key: the first four bytes of its SHA-1, modulo ``k``."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def id_language(key: Column, aliases: dict[str, str] | None = None) -> Column:
    """The language that begins an identifier, aliases resolved."""
    code = F.substring_index(key, "_", 1)
    if not aliases:
        return code
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[code], code)


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def safe_double(c: Column, default: float = 0.0) -> Column:
    """A number from text; empty, garbage, NaN and infinity give the default."""
    v = F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def flag_set(c: Column, mark: str = ";") -> Column:
    """Flags joined in a string, as an array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{mark}]"), lambda f: F.trim(f)), lambda f: f != "")
