"""Token budget per source, language and domain under an existing public tokenizer.

The tokenizer splits a text by a pattern and encodes every piece on its own. A text is therefore cut, without changing
its number of tokens, before a single space between two characters that are no white space, and between a letter and a
digit: no piece of the pattern reaches over either, and what follows is matched as if it stood alone. Oversized texts
are cut at such places only, the chunks are spread over the workers by a salted hash, and their counts are summed.

Defined results: null and empty fields have no tokens; a record whose fields are blank is not filled and is left out;
two fields of the very same text count once; a text without a safe place to cut stays whole; repeated rows count each;
an empty table gives an empty result; extra columns are not looked at. Texts are counted whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are cut.
CHUNK_CHARS = 1 << 18
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
# How the languages are written.
LANGUAGES = {
    "lin": ["lin", "ln", "lingala"],
    "lug": ["lug", "lg", "luganda", "ganda"],
    "sna": ["sna", "sn", "shona"],
    "xog": ["xog", "sog", "lusoga", "soga"],
    "myx": ["myx", "mas", "lumasaba", "masaba", "masaaba"],
    "eng": ["eng", "en", "english"],
}


def _here(path: str) -> str:
    """The copy of a file that was sent to this worker, or its own path."""
    try:
        sent = SparkFiles.get(Path(path).name)
    except Exception:  # noqa: BLE001 - no application is running
        return path
    return sent if Path(sent).is_file() else path


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    import tiktoken

    with open(_here(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def safe_chunks(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Pieces of about ``most`` characters whose token counts add up to that of the text."""
    out, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def meant_language(language: Column) -> Column:
    """The language that a code, locale or name means; ``und`` for null and anything unknown."""
    bare = F.lower(F.trim(language))
    bare = F.when(F.length(bare) > 3, F.regexp_replace(bare, r"[_-].*$", "")).otherwise(bare)
    pairs = [F.lit(x) for code, names in LANGUAGES.items() for name in names for x in (name, code)]
    return F.coalesce(F.create_map(*pairs)[bare], F.lit("und"))


def _counter(path: str):
    @F.pandas_udf(T.LongType())
    def count(texts: pd.DataFrame) -> pd.Series:
        encode = encoder(path).encode_ordinary
        lists = [texts[c].tolist() for c in texts.columns]
        return pd.Series([sum(len(encode(x)) for x in dict.fromkeys(row) if x) for row in zip(*lists)], dtype="int64")

    return count


def token_counts(df: DataFrame, id_col: str, fields: list[str], carry: dict[str, Column] | None = None, tokenizer: str = TOKENIZER, most: int = CHUNK_CHARS, salts: int = 64) -> DataFrame:
    """(id, n_tokens and the carried columns) of every filled record."""
    carry = carry or {}
    if Path(tokenizer).is_file():  # workers read what the driver has, wherever they run
        df.sparkSession.sparkContext.addFile(tokenizer)
    picked = df.select(F.col(f"`{id_col}`").alias("id"), *[v.alias(k) for k, v in carry.items()], F.struct(*[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).alias("t"))
    parts = [F.col(f"t.f{i}") for i in range(len(fields))]
    filled = picked.filter(F.trim(F.concat_ws("", *parts)) != "")
    oversized = F.greatest(*[F.coalesce(F.length(p), F.lit(0)) for p in [*parts, parts[0]]]) > most
    usual = filled.filter(~oversized).select("id", *carry, _counter(tokenizer)("t").alias("n_tokens"))

    kept = list(carry)
    columns = ["id", *kept, "uid", "i", "piece"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i, t, *carried in zip(b["id"], b["t"], *[b[c] for c in kept]):
                texts = [x for x in dict.fromkeys(t.values()) if x]
                name = hashlib.blake2b(repr((i, carried, texts)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for k, piece in enumerate(p for x in texts for p in safe_chunks(x, most)):
                    out.append((i, *carried, name, k, piece))
                    size += len(piece)
                    if size > 32 * most:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    kinds = {f.name: f.dataType.simpleString() for f in filled.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in ["id", *carry]], "uid binary, i bigint, piece string"])
    cut_up = filled.filter(oversized).mapInPandas(chunks, schema).repartition(salts, "uid", "i")
    counted = cut_up.select("id", *carry, "uid", "i", _counter(tokenizer)(F.struct("piece")).alias("n"))
    # a record delivered k times has k first pieces; each of its rows gets an equal, whole part
    whole = counted.groupBy("id", *carry, "uid").agg(F.sum("n").alias("n"), F.count_if(F.col("i") == 0).alias("k"))
    large = whole.select("id", *carry, F.expr("n div k").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("__k")).drop("__k")
    return usual.unionByName(large)


def token_budget(df: DataFrame, id_col: str, fields: list[str], dimensions: dict[str, Column], tokenizer: str = TOKENIZER) -> DataFrame:
    """(dimension, value, n_records, n_tokens): totals by each dimension, by their combinations and of all records."""
    counts = token_counts(df, id_col, fields, dimensions, tokenizer)
    names = list(dimensions)
    # one shuffle on the finest slices, which are few; the coarser totals come from their sums
    fine = counts.groupBy(*names).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    total = [F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens")]
    entries = F.array(
        *[F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(n).cast("string"), F.lit("(none)")).alias("value")) for n in names],
        F.struct(F.lit("slice").alias("dimension"), F.concat_ws("/", *[F.coalesce(F.col(n).cast("string"), F.lit("(none)")) for n in names]).alias("value")),
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
    )
    return fine.withColumn("e", F.explode(entries)).groupBy("e.dimension", "e.value").agg(*total)
