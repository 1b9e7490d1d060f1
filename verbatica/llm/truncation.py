"""Text cut off by field limits.

A text is truncated when it stops before its utterance does. Two kinds of evidence are combined. The vocabulary of the
corpus, laid out as a trie (one row per node, with the number of known words below it), tells whether the final token
is an unknown proper prefix of known words. Length evidence comes from the other deliveries of the utterance and its
reference: the text is aligned word by word with the beginning of each, and either ends where they end, or they go on
after what it aligns with, inside the last word or behind it.

Both are scores that are added: by how much less it costs to go on than to end, and a fixed worth of a last token that
the trie calls an unfinished word. A text is cut when the sum is not clearly negative (what ends in the same place may
have been cut there too); without any other delivery to compare with, when the trie calls it unfinished and no closing
punctuation follows. Repeated phrases count once, so that a finished loop neither makes a text longer
nor its siblings cut; what trails off at the end of the utterance ends where the others end.

Defined results: null, empty and artifact-only texts are never cut, but count as rows; rows with a null identifier
have no siblings; a null group is a group; equal rows are judged alike, each for itself; every
different text of an utterance is compared once with all others and with its reference, in slices where there are
many; an empty table gives an empty result; other columns are not looked at. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from ..session import cut

#: Texts of an utterance that meet in one piece of work; the longest phrase that is looked at as a loop.
SLICE_TEXTS, LOOP = 64, 8
#: What going on may cost more than ending, and what an unfinished last word is worth; no alignment costs so much.
SLACK, TRIE_SCORE, _NEVER = 0.5, 0.4, 99.0
#: A word is known from so many rows, in which it is not the last one.
KNOWN_FROM = 3
_ARTIFACT = regex.compile(r"<\|[^|>]*(?:\|>|\|?$)|\[[^\]]*(?:\]|$)|\([^)]*\)|♪")
_APOSTROPHE = regex.compile(r"['’ʼ`´‘]")
_BETWEEN = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_CLOSED = regex.compile(r"[.?!][\"'”’»)]*\s*$")


def spoken_words(text: str | None) -> list[str]:
    """The words of a transcript, without case, punctuation and artifacts."""
    if not text:
        return []
    bare = _ARTIFACT.sub(" ", unicodedata.normalize("NFC", text).lower())
    return _BETWEEN.sub(" ", _APOSTROPHE.sub("", bare)).split()


def without_loops(words: list[str], times: int = 3, longest: int = LOOP) -> list[str]:
    """Phrases of up to ``longest`` words said at least ``times`` times in a row are kept once, a begun repeat not."""
    out: list[str] = []
    i, n = 0, len(words)
    while i < n:
        for p in range(1, min(longest, (n - i) // times) + 1):
            if words[i] != words[i + p]:
                continue
            k = 1
            while words[i : i + p] == words[i + k * p : i + (k + 1) * p]:
                k += 1
            if k >= times:
                out += words[i : i + p]
                i += k * p
                q = 0
                while i < n and q < p - 1 and words[i] == out[len(out) - p + q]:
                    i, q = i + 1, q + 1
                break
        else:
            out.append(words[i])
            i += 1
    return out


@lru_cache(maxsize=1 << 17)
def unlike(a: str, b: str) -> float:
    """0 for the same word, 1 for another, between them for a slip."""
    if a == b:
        return 0.0
    if len(a) == len(b):
        d = sum(map(str.__ne__, a, b))
        return d / len(a) if d == 1 or 2 * d < len(a) else 1.0
    if abs(len(a) - len(b)) > 2 or len(a) < 4 or len(b) < 4:
        return 1.0
    return 0.5 if a[:3] == b[:3] or a[-3:] == b[-3:] else 1.0


def align_prefix(x: list[str], s: list[str], most: float) -> tuple[float, int, int] | None:
    """Cost of ``x`` against the beginning of ``s``, the number of words of ``s`` it takes, and how many characters of
    the last of them are missing; None if it costs more than ``most``.

    Only the cells of the table that cost no more are filled.
    """
    m, n, k = len(s), len(x), 0
    while k < n - 1 and k < m and x[k] == s[k]:
        k += 1
    lo, before = k, [0.8 * t for t in range(min(m - k, int(most / 0.8)) + 1)]
    for a in x[k:-1]:
        row: list[float] = []
        diagonal = left = _NEVER
        for up, b in zip(before, s[lo - 1 : lo + len(before)] if lo else ["", *s[: len(before)]]):
            best = up + 1.0
            if diagonal < best:
                best = diagonal if a == b else min(best, diagonal + unlike(a, b))
            if left + 0.8 < best:
                best = left + 0.8
            left = best if best <= most else _NEVER
            diagonal = up
            row.append(left)
        for b in s[lo + len(before) - 1 :]:
            best = min(left + 0.8, diagonal if a == b else diagonal + unlike(a, b) if diagonal <= most else _NEVER)
            if best > most:
                break
            row.append(best)
            left, diagonal = best, _NEVER
        while row and row[-1] > most:
            row.pop()
        first = 0
        while first < len(row) and row[first] > most:
            first += 1
        if first == len(row):
            return None
        lo, before = lo + first, row[first:]
    last, found = x[-1], (_NEVER, 0, 0)
    for j in range(max(lo, 0) + 1, min(m, lo + len(before)) + 1):
        b, part = s[j - 1], 0
        if last == b:
            c = 0.0
        elif len(last) < len(b) and (b.startswith(last) or (len(last) >= 4 and sum(map(str.__ne__, last, b)) == 1)):
            c, part = (0.05 if b.startswith(last) else 0.3), len(b) - len(last)
        else:
            c = unlike(last, b)
        if before[j - 1 - lo] + c <= found[0] + 1e-9:
            found = (before[j - 1 - lo] + c, j, part)
    t = min(range(len(before)), key=lambda t: (before[t], -t))
    found = min(found, (before[t] + 1.0, lo + t, 0))
    return found if found[0] <= most else None


def _forms(words: list[str]) -> list[list[str]]:
    """The words, and the words without their loops where there are any."""
    if len(set(words)) == len(words):
        return [words]
    bare = without_loops(words)
    return [words] if bare == words else [words, bare]


def evidence(x: Text, others: list[Text]) -> tuple[float, float, int, bool, str]:
    """The least costs of going on and of ending, the characters that follow, whether anything compares, and which
    text goes on at least cost."""
    on, end, rest, compared, by = _NEVER, _NEVER, 0, False, ""
    words = x.words
    for o in others:
        if o.text == x.text:
            if x.several:
                end, compared = 0.0, True
            continue
        s = o.words
        if len(words) > 2 and len(s) > 2 and abs(len(words) - len(s)) <= 2 and words[-1][-1] == s[-1][-1] and len(words[-1]) >= len(s[-1]):
            c = sum(map(unlike, words[-3:], s[-3:]))
            if c <= 0.5:
                end, compared = min(end, c), True
                continue
        for a in x.forms:
            most = 0.2 * len(a) + 0.7
            for b in o.forms:
                if len(a) - len(b) > most:
                    continue
                found = align_prefix(a, b, most)
                if found is None:
                    continue
                cost, j, part = found
                compared = True
                after = b[j:]
                looped = not part and after and all(any(unlike(w, y) <= 0.25 for y in a[-LOOP:]) for w in after)
                if (part or after) and not looped:
                    if cost < on or (cost == on and (len(o.text), o.text) > (len(by), by)):
                        on, rest, by = cost, part + sum(len(w) + 1 for w in after), o.text
                else:
                    end = min(end, cost)
    return on, end, rest, compared, by


class Text:
    """A text of an utterance; ``several``: more than one model, or the reference, has it."""

    __slots__ = ("forms", "several", "text", "words")

    def __init__(self, text: str, several: bool) -> None:
        self.text, self.several, self.words = text, several, text.split(" ")
        self.forms = _forms(self.words)


def _spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words = [spoken_words(t) for t in b["t"]]
        joined = [" ".join(w) for w in words]
        names = [hashlib.blake2b(f"{i}\0{w}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for i, w in zip(b["id"], joined)]
        yield b[["row", "id", "model"]].assign(words=joined, last=[w[-1] if w else None for w in words], closed=[bool(_CLOSED.search(t or "")) for t in b["t"]], said=names)


EVIDENCE = ["said", "on", "end", "rest", "compared", "by"]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The evidence on every delivered text of ``asking`` from the texts of ``others``; without these, from its own."""
    for b in batches:
        out = []
        others = b["others"] if "others" in b else b["asking"]
        for asking, known in zip(b["asking"], others):
            texts = [Text(o["words"], o["several"]) for o in known]
            mine = texts if known is asking else [Text(o["words"], o["several"]) for o in asking]
            out += [(o["said"], *evidence(x, texts)) for o, x in zip(asking, mine) if o["delivered"]]
        yield pd.DataFrame(out, columns=EVIDENCE)


def _evidence(texts: DataFrame) -> DataFrame:
    """Evidence on every delivered text of every utterance, each text compared with each other one once.

    The texts of an utterance meet in one piece of work, or in slices two by two where there are many.
    """
    schema = "said binary, on double, end double, rest bigint, compared boolean, by string"
    sizes = cut(texts.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / SLICE_TEXTS).alias("parts")).filter("parts > 1"))
    item = F.collect_list(F.struct("said", "words", "several", "delivered"))
    if sizes.isEmpty():
        return texts.groupBy("id").agg(item.alias("asking")).select("asking").mapInPandas(_compared, schema).drop("by")
    few = texts.join(sizes, "id", "left_anti").groupBy("id").agg(item.alias("asking")).select("asking").mapInPandas(_compared, schema)
    sliced = texts.join(sizes, "id").withColumn("slice", F.pmod(F.xxhash64("said"), F.col("parts"))).groupBy("id", "slice").agg(item.alias("asking"), F.first("parts").alias("parts"))
    sliced = cut(sliced)
    met = sliced.select("id", "asking", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("slice")).join(sliced.select("id", "slice", F.col("asking").alias("others")), ["id", "slice"])
    parts = met.select("asking", "others").mapInPandas(_compared, schema)
    # of equal costs the longest text's counts, as it does inside a slice
    best = F.min(F.struct("on", (-F.length("by")).alias("order"), F.lit(0).alias("tie"), "rest"))
    least = parts.groupBy("said").agg(best.alias("best"), F.min("end").alias("end"), F.max("compared").alias("compared"))
    return few.drop("by").unionByName(least.select("said", "best.on", "end", "best.rest", "compared"))


def vocabulary_trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word) of the known words, and (node, n_below): the inner nodes of their trie with the known words below each."""
    counted = words.select(F.explode(F.slice(F.split("words", " "), 1, F.greatest(F.lit(0), F.size(F.split("words", " ")) - 1))).alias("word"))
    known = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= KNOWN_FROM).select("word")
    inner = known.filter(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("node"))
    return known, inner.groupBy("node").agg(F.count(F.lit(1)).alias("n_below"))


def truncations(df: DataFrame, references: DataFrame | None, row_col: str, id_col: str, model_col: str, text_col: str, ref_id: str = "id", ref_text: str = "target") -> DataFrame:
    """(row, model, cut, n_missing, length_score, trie_score): every row with words, whether it was cut, the characters
    known to follow and the two scores it was judged by."""
    picked = df.select(F.col(f"`{row_col}`").cast("bigint").alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{model_col}`").cast("string").alias("model"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = "row bigint, id string, model string, words string, last string, closed boolean, said binary"
    rows = cut(picked.mapInPandas(_spoken, schema).filter("last IS NOT NULL"))
    said = rows.select("said", "id", F.coalesce("model", F.lit("")).alias("model"), "words", F.lit(True).alias("delivered"))
    if references is not None:
        given = references.select(F.lit(None).cast("bigint").alias("row"), F.col(f"`{ref_id}`").cast("string").alias("id"), F.lit("=reference").alias("model"), F.col(f"`{ref_text}`").cast("string").alias("t"))
        said = said.unionByName(given.mapInPandas(_spoken, schema).filter("last IS NOT NULL").select("said", "id", "model", "words", F.lit(False).alias("delivered")))
    known, trie = vocabulary_trie(rows.select("words"))
    final = rows.select(F.col("last").alias("word")).distinct()
    unknown = final.join(known, "word", "left_anti")
    unfinished = unknown.join(trie, unknown["word"] == trie["node"], "left_semi").select(F.col("word").alias("last"), F.lit(True).alias("unfinished"))
    texts = said.filter("id IS NOT NULL").groupBy("said").agg(F.first("id").alias("id"), F.first("words").alias("words"), (F.min("model") < F.max("model")).alias("several"), F.count_if("delivered").alias("n"))
    texts = cut(texts.withColumn("delivered", F.col("n") > 0))
    facts = cut(_evidence(texts.drop("n")).join(texts.filter("delivered").select("said", "n"), "said"))
    marked = cut(rows.join(unfinished, "last", "left").select("row", "id", "model", "said", "closed", F.coalesce("unfinished", F.lit(False)).alias("unfinished")))
    linked = attach_by_key(marked.filter("id IS NOT NULL"), facts, "said", "n", marked.count())
    alone = marked.filter("id IS NULL").select("*", F.lit(False).alias("compared"), F.lit(_NEVER).alias("on"), F.lit(_NEVER).alias("end"), F.lit(0).cast("bigint").alias("rest"))
    kept = ["row", "model", "closed", "unfinished", "compared", "on", "end", "rest"]
    judged = linked.select(*kept).unionByName(alone.select(*kept))
    # whoever ends where this text ends may have been cut there too: going on may cost SLACK more than ending; a last
    # token that is an unfinished word is worth TRIE_SCORE more, and decides alone where there is nothing to compare
    judged = judged.withColumns({"length_score": F.when(F.col("compared"), F.col("end") - F.col("on")), "trie_score": F.when(F.col("unfinished"), F.lit(TRIE_SCORE)).otherwise(F.lit(0.0))})
    is_cut = F.when(F.col("compared"), F.col("length_score") + F.col("trie_score") > -SLACK).otherwise(F.col("unfinished") & ~F.col("closed"))
    judged = judged.withColumn("cut", is_cut)
    return judged.select("row", "model", "cut", F.when(F.col("cut") & F.col("compared") & (F.col("on") < _NEVER), F.col("rest")).otherwise(F.lit(0).cast("bigint")).alias("n_missing"), "length_score", "trie_score")


def truncation_rates(df: DataFrame, references: DataFrame | None, row_col: str, id_col: str, model_col: str, text_col: str) -> DataFrame:
    """Per group (model): rows, rows with words, cut rows, their rate and the characters known to be missing."""
    judged = truncations(df, references, row_col, id_col, model_col, text_col)
    found = judged.groupBy("model").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.sum("n_missing").alias("n_missing"))
    rows = df.groupBy(F.col(f"`{model_col}`").cast("string").alias("model")).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = rows.join(found.withColumnRenamed("model", "m"), F.col("model").eqNullSafe(F.col("m")), "left").drop("m").fillna(0, ["n_texts", "n_cut", "n_missing"])
    return joined.withColumn("cut_rate", F.coalesce(F.try_divide("n_cut", "n_texts"), F.lit(0.0)))
