"""Visually identical text with different characters.

Every text is brought to one consistent form: full-width, half-width and styled forms become plain ones, joined letters
and Roman numerals their letters, look-alike letters of other scripts the Latin letter they look like, every single
space an ordinary one, invisible characters nothing, and accents are composed. Case, punctuation, accents and the number of spaces are kept, so that texts of one form look the same.

The work is done by DuckDB inside Arrow batches on the executors, with its bundled functions.

Defined results: a null text has a null form and an empty text an empty one; rows with a null identifier are left out
of the pairs; rows whose characters are the same are never paired, nor a row with itself; texts with fewer than
``least`` letters and digits are left out of the pairs; an empty table gives an empty result; other columns are not
looked at. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from ..session import cut

#: Rows of a form that are paired together.
SLICE_ROWS = 512

# Letters of other scripts and the Latin ones they look like.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝёїАВЕЅЗІЈКМНОРСТУХԌԚԜЁЇЬҮү", "aeopcyxijshdqwëïABES3IJKMHOPCTYXGQWËÏbYy"))
GREEK = dict(zip("οναιρυϲϳκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹόάίύΐϊϋΆΈΉΊΌΎ", "ovaipucjĸABEZHIKMNOPTYXCóáíúḯïüÁÉHÍÓÝ"))
ARMENIAN = dict(zip("օոսհցզՕՍՏ", "onuhgqOUS"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"))
EPSILON = {"ε": "ɛ", "έ": "ɛ́", "ͻ": "ɔ", "Ͻ": "Ɔ", "Ԑ": "Ɛ", "ԑ": "ɛ"}
# What no reader sees (soft hyphen, joiners, marks of direction, fillers, variation selectors, tags).
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
# Blocks whose compatibility forms look like the letters they stand for: joined letters, Roman numerals.
JOINED = [(0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4), (0x2160, 0x2180), (0xFB00, 0xFB07), (0xFB13, 0xFB18)]


@lru_cache(maxsize=1)
def compatibility_forms() -> dict[str, str]:
    """Wide, narrow and styled characters and joined letters, as what they look like.

    Other compatibility forms (superscripts, fractions, circled digits, ...) do not look like their plain ones.
    """
    unseen = _ranges(INVISIBLE) | _ranges(SPACES)
    joined = {c for lo, hi in JOINED for c in range(lo, hi)}
    out = {}
    for c in range(0x80, 0x20000):
        kind = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if c not in unseen and (kind in ("<wide>", "<narrow>", "<font>") or (c in joined and kind == "<compat>")):
            out[chr(c)] = unicodedata.normalize("NFKC", chr(c))
    return out


def _ranges(pattern: str) -> set[int]:
    """The code points of a class of escapes."""
    out: set[int] = set()
    for lo, hi in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", pattern):
        out.update(range(int(lo, 16), int(hi or lo, 16) + 1))
    return out


@lru_cache(maxsize=1)
def single_forms() -> dict[str, str]:
    """Every character that becomes one other, a space or nothing."""
    letters = {k: v for k, v in {**compatibility_forms(), **EPSILON}.items() if len(v) == 1}
    letters |= CYRILLIC | GREEK | ARMENIAN | CHEROKEE | {"ɡ": "g", "ı": "i"}
    return letters | {chr(c): "" for c in _ranges(INVISIBLE)} | {chr(c): " " for c in _ranges(SPACES)}


@lru_cache(maxsize=1)
def several_forms() -> dict[str, str]:
    """Every character that becomes several."""
    return {k: v for k, v in {**compatibility_forms(), **EPSILON}.items() if len(v) > 1}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translated(column: str, forms: dict[str, str]) -> str:
    return f"translate({column}, {_quoted(''.join(forms))}, {_quoted(''.join(forms.values()))})"


def form_sql(column: str = "t") -> str:
    """The DuckDB expression of the consistent form.

    What is rare (styled letters, joined letters) is looked for first; texts in ASCII are what they are.
    """
    single = {k: v for k, v in single_forms().items() if len(v) == 1 and v != " "}
    wide = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    rare = {k: v for k, v in compatibility_forms().items() if len(v) == 1 and k not in wide}
    usual = wide | {k: v for k, v in single.items() if k not in rare}
    several = several_forms()
    bare = f"regexp_replace(nfc_normalize({column}), '{INVISIBLE}', '', 'g')"
    spaced = f"regexp_replace({bare}, '{SPACES}', ' ', 'g')"
    joined = "x"
    for k, v in several.items():
        joined = f"replace({joined}, {_quoted(k)}, {_quoted(v)})"
    found = "[" + "".join(f"\\x{{{ord(k):X}}}" for k in several) + "]"
    styled = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _spans({ord(k) for k in rare})) + "]"
    one = f"list_transform([{spaced}], lambda x: CASE WHEN regexp_matches(x, '{found}') THEN {joined} ELSE x END)[1]"
    two = f"list_transform([{one}], lambda x: CASE WHEN regexp_matches(x, '{styled}') THEN {_translated('x', rare)} ELSE x END)[1]"
    return f"CASE WHEN regexp_full_match({column}, '[\x00-\x7F]*') THEN {column} ELSE nfc_normalize({_translated(two, usual)}) END"


def _spans(points: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def consistent_form(text: str) -> str:
    """The same form in Python, for single texts."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_table()))


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return str.maketrans(single_forms() | several_forms())


def with_forms(df: DataFrame, id_col: str, text_col: str, keep: list[str] = []) -> DataFrame:
    """(id, raw, form, n_letters and the kept columns): the consistent form of every text."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString().replace(":", " ", 1) for f in picked.schema.fields]
    schema = ", ".join([fields[0], "raw string", "form string", "n_letters bigint", *fields[2:]])
    extra = "".join(f", k{i}" for i in range(len(keep)))
    # letters and digits are counted without accents; the form is normalized once, in the inner query
    query = f"SELECT id, t AS raw, f AS form, length(regexp_replace(f, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::BIGINT AS n_letters{extra} FROM (SELECT *, {form_sql()} AS f FROM batch)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(query).to_arrow_table().to_batches()
            con.unregister("batch")

    return picked.mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, least: int = 12) -> DataFrame:
    """(a, b), a < b: rows whose texts have one form but not the same characters.

    Only forms that occur with several spellings go on. The rows of a form are cut into slices by their number, and
    slices meet two by two, so that a form of many rows is many small blocks.
    """
    forms = with_forms(df.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)
    keyed = cut(forms.filter(F.col("n_letters") >= least).select("id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("raw")).alias("raw")))
    spellings = keyed.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("n").alias("n_rows")).filter("n_raw > 1").select("form", "n_rows")
    n_slices = F.ceil(F.col("n_rows") / SLICE_ROWS)
    kept = attach_by_key(keyed, mixed, "form", "n_rows", keyed.count()).withColumn("slice", F.pmod(F.xxhash64("id"), n_slices))
    slices = cut(kept.groupBy("form", "slice").agg(F.collect_set(F.struct("id", "raw")).alias("rows"), F.first("n_rows").alias("n_rows")))
    left = slices.select("form", F.col("slice").alias("first"), F.col("rows").alias("x"), F.explode(F.sequence("slice", n_slices - 1)).alias("slice"))
    met = left.join(slices.select("form", "slice", F.col("rows").alias("y")), ["form", "slice"])
    pairs = met.select("first", "slice", F.explode("x").alias("x"), "y").select("first", "slice", "x", F.explode("y").alias("y"))
    pairs = pairs.filter("x.raw <> y.raw AND (first < slice OR x.id < y.id)").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return pairs.filter("a < b").distinct()


def spelling_report(df: DataFrame, id_col: str, text_col: str, group_col: str) -> DataFrame:
    """Per group the rows, the rows whose text was not in its consistent form, and the distinct texts before and after."""
    forms = with_forms(df, id_col, text_col, [group_col])
    return forms.groupBy(F.col("k0").alias("grp")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("raw") != F.col("form")).alias("n_changed"),
        F.count("raw").alias("n_texts"),
    )
