"""Edit distances on characters and words without a Python function.

Spark's ``levenshtein`` counts code points. Words become code points of a private alphabet of the pair, so the same
function counts words; the mapping is one to one, hence the distance exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, tokens

#: The first code point of the alphabet, how many follow it before the surrogates, and how many there are in all with
#: the planes behind the first.
_BASE, _NEAR, _ROOM = 19968, 35328, 35328 + (1 << 20)


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays; with 1,083,904 distinct words or more in a pair the query fails."""

    def spelled(p: Column, words: Column) -> Column:
        near = lambda at: F.decode(F.unhex(F.lpad(F.hex(F.lit(_BASE) + at), 4, "0")), "UTF-16BE")
        far = lambda at: F.decode(F.unhex(F.lpad(F.hex(F.lit((1 << 16) - _NEAR) + at), 8, "0")), "UTF-32")
        spell = lambda x, letter: F.array_join(F.transform(x, lambda w: letter(F.array_position(words, w))), "")
        any_letter = lambda at: F.when(at < _NEAR, near(at)).otherwise(far(at))
        short = F.levenshtein(spell(p["a"], near), spell(p["b"], near))
        long = F.levenshtein(spell(p["a"], any_letter), spell(p["b"], any_letter))
        too_many = F.raise_error(F.lit(f"a pair of texts has {_ROOM} different words or more")).cast("int")
        return F.when(F.size(words) < _NEAR, short).when(F.size(words) < _ROOM, long).otherwise(too_many)

    # inside a lambda nothing is shared: without the two bindings every word would list the words of the pair anew
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: bind(F.array_distinct(F.concat(p["a"], p["b"])), lambda words: spelled(p, words)))


def error_columns(reference: Column, hypothesis: Column) -> dict[str, Column]:
    """Errors and reference lengths in words and characters."""
    r, h = tokens(reference), tokens(hypothesis)
    return {
        "word_errors": word_distance(r, h).cast("bigint"),
        "word_count": F.size(r).cast("bigint"),
        "char_errors": char_distance(reference, hypothesis).cast("bigint"),
        "char_count": F.length(reference).cast("bigint"),
    }


def safe_rate(errors: Column, count: Column) -> Column:
    """Errors by count; without anything to count 0, or 1 if there are errors."""
    return F.when(count == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / count)


def pair_cost(a: Column, b: Column) -> Column:
    """Symmetric cost of two texts: the mean of their word and character distances over the longer lengths."""
    x, y = tokens(a), tokens(b)
    words = F.greatest(F.size(x), F.size(y), F.lit(1))
    chars = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 0.5 * word_distance(x, y) / words + 0.5 * char_distance(a, b) / chars
