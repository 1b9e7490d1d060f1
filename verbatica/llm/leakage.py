"""Evaluation texts leaking into training text.

A document holds an item when at least ``share`` of the item's words, and at least ``least`` of them, stand in it in
the item's order and in one stretch; layout, formatting and small slips do not count.

Items are partitioned by size. For every size class a document is read in windows of twice the class's largest size,
each overlapping the next by half, so that a passage lies whole in one of them. Items and windows are sketched by the
minwise hashes of their shingles of two words: of every class the hashes in the lowest part of their range, a smaller
part for larger items, so that a sketch has about ``KEPT`` values whatever the size; the part of an item's values that a
window has estimates its containment. Candidates agree in enough values for their sketch; they are verified by the exact
containment of the item's shingles in the window and then by aligning the words.

Up to ``SENT`` characters of items are sent to the workers and documents are not shuffled at all. More items meet the
documents in a join of the values of their sketches, values of many documents by broadcast, and the texts follow only
for the pairs that agree.

Defined results: null and empty texts hold nothing; documents and items with null identifiers are left out; items with
fewer than ``least`` words are never found; copies of a document and repeated items count for themselves, repeated
rows once; an empty table on either side gives an empty result; other columns are not looked at. Texts are read whole.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from ..session import cut

#: Characters of items that are sent to every worker; values of a sketch; from so many values two have to agree.
SENT, KEPT, SURE = 1 << 24, 16, 8
#: Items of one value that are joined together.
SLICE_ITEMS = 1024
#: The least part of an item's shingles in a window: half of the words, every fifth of them with a slip, leaves more.
CONTAINED = 0.15
_BREAK = re.compile(r"(?<=\w)[-\u00ad\u2010]\n\s*(?=[^\W\d_])")
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff'\u2019\u02bc`\u00b4\u2018]+")
_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def plain_words(text: str | None) -> list[str]:
    """The words of a text without its layout: entities, hyphens at line ends, accents, apostrophes, case.

    Time stamps, line numbers and tags stay as words of their own; the alignment passes over them.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "\u00ad" in text:
        text = _BREAK.sub("", text)
    text = text.lower().replace("'", "")
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def shingles(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A hash for each two neighbouring words."""
    import xxhash

    if len(words) < 2:
        return np.empty(0, dtype=np.uint64)
    get = known.get
    ids = []
    for w in words:
        h = get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    a = np.array(ids, dtype=np.uint64)
    return _mixed(a[:-1] * _A + a[1:])


def size_class(n_words: int) -> int:
    """The largest number of words in the class of an item: a power of two."""
    return 1 << max(4, math.ceil(math.log2(max(n_words, 1))))


def sampled(h: np.ndarray, upper: int) -> np.ndarray:
    """Which hashes belong to the sketches of a size class."""
    return h < np.uint64((1 << 64) // max(1, upper // KEPT) - 1)


def needed(n_values: int) -> int:
    """In how many values an item has to agree with a window."""
    return 1 if n_values < SURE else 2


class ItemIndex:
    """The sketches of some items, by size class."""

    def __init__(self, items: list[tuple[int, str]], share: float, least: int) -> None:
        self.items: dict[int, tuple[int, list[str], dict[int, list[int]], int, int]] = {}
        tables: dict[int, dict[int, list[int]]] = {}
        known: dict[str, int] = {}
        for n, (item_id, text) in enumerate(items):
            words = plain_words(text)
            if len(words) < max(least, 2):
                continue
            h = shingles(words, known)
            places: dict[int, list[int]] = {}
            for i, x in enumerate(h.tolist()):
                places.setdefault(x, []).append(i)
            upper = size_class(len(words))
            own = np.array(list(places), dtype=np.uint64)
            sketch = own[sampled(own, upper)]
            if not len(sketch):  # the least hash stands for a sketch without values
                sketch = own[own.argmin() : own.argmin() + 1]
            self.items[n] = (item_id, words, places, max(least, math.ceil(share * len(words))), needed(len(sketch)))
            for x in sketch.tolist():
                tables.setdefault(upper, {}).setdefault(x, []).append(n)
        self.classes = [(upper, np.array(sorted(t), dtype=np.uint64), t) for upper, t in sorted(tables.items())]

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, window begin, window end) where the sketches agree and the exact containment is large enough."""
        for upper, values, table in self.classes:
            at = np.searchsorted(values, h)
            at[at == len(values)] = 0
            hits = np.flatnonzero(values[at] == h)
            if not len(hits):
                continue
            agreeing: dict[tuple[int, int], set[int]] = {}
            for p, x in zip(hits.tolist(), h[hits].tolist()):
                w = p // upper
                for n in table[x]:
                    agreeing.setdefault((n, w), set()).add(x)
                    if w:
                        agreeing.setdefault((n, w - 1), set()).add(x)
            inside: dict[int, set[int]] = {}
            for (n, w), values_of in agreeing.items():
                places, least = self.items[n][2], self.items[n][4]
                if len(values_of) < least:
                    continue
                if w not in inside:
                    inside[w] = set(h[w * upper : (w + 2) * upper].tolist())
                shared = len(places.keys() & inside[w])
                if shared >= 2 and shared >= CONTAINED * len(places):
                    yield n, w * upper, min(len(h), (w + 2) * upper)

    def found_in(self, words: list[str], known: dict[str, int]) -> list[int]:
        """The identifiers of the items that the words of a document hold."""
        if len(words) < 2:
            return []
        h = shingles(words, known)
        found: set[int] = set()
        for n, lo, hi in self.candidates(h):
            item_id, item, places, wanted, _ = self.items[n]
            if item_id not in found and holds(item, places, wanted, words, h, lo, hi):
                found.add(item_id)
        return sorted(found)


def same_word(a: str, b: str) -> bool:
    """Equal but for a small slip."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) <= (1 if len(a) < 8 else 2) or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def holds(item: list[str], places: dict[int, list[int]], wanted: int, words: list[str], h: np.ndarray, lo: int, hi: int) -> bool:
    """Whether ``wanted`` words of the item stand in one stretch around the window, in order.

    Shared shingles lie near one diagonal of item and document; around the diagonal with most of them the words are
    aligned.
    """
    n = len(item)
    lo, hi = max(0, lo - n), min(len(h), hi + n)
    points = [(i, lo + p) for p, x in enumerate(h[lo:hi].tolist()) for i in places.get(x, ())]
    if not points:
        return False
    slack = max(8, n // 2)
    diagonals = sorted(p - i for i, p in points)
    best, begin = (0, 0), 0
    for end, d in enumerate(diagonals):
        while d - diagonals[begin] > slack:
            begin += 1
        best = max(best, (end - begin + 1, -begin))
    base = diagonals[-best[1]]
    # words of the document opposite the item, with room for what layout put between
    first = max(0, base - 2)
    part = words[first : base + slack + n + 2]
    m = len(part)
    before = [0] * (m + 1)
    for a in item:  # longest common subsequence with slips
        row = [0] * (m + 1)
        for j in range(1, m + 1):
            b = part[j - 1]
            if a == b or (before[j - 1] >= before[j] and before[j - 1] >= row[j - 1] and same_word(a, b)):
                row[j] = before[j - 1] + 1
            else:
                row[j] = before[j] if before[j] >= row[j - 1] else row[j - 1]
        before = row
    return before[m] >= wanted


def _values(batches: Iterator[pd.DataFrame], uppers: list[int] | None, least: int) -> Iterator[pd.DataFrame]:
    """(id, value, upper): of items the values of their own class, of documents those of all classes; windows aside."""
    known: dict[str, int] = {}
    for b in batches:
        out = []
        for i, t in zip(b["id"].tolist(), b["t"].tolist()):
            words = plain_words(t)
            if len(words) < max(least, 2):
                continue
            h = np.unique(shingles(words, known))
            for upper in uppers if uppers is not None else [size_class(len(words))]:
                kept = h[sampled(h, upper)]
                if uppers is None and not len(kept):
                    kept = h[:1]
                out.append((i, upper, kept.view(np.int64).tolist()))
        if len(known) > 500_000:
            known.clear()
        yield pd.DataFrame([(i, x, u) for i, u, xs in out for x in xs], columns=["id", "value", "upper"]).astype("int64")


def _verified(batches: Iterator[pd.DataFrame], share: float, least: int) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    last, words = None, []
    for b in batches:
        out = []
        for d, t, i, x in zip(b["doc_id"].tolist(), b["t"], b["item_id"].tolist(), b["item"]):
            if (d, t) != last:
                last, words = (d, t), plain_words(t)
            if ItemIndex([(i, x)], share, least).found_in(words, known):
                out.append((d, i))
        if len(known) > 500_000:
            known.clear()
        yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")


def _joined(texts: DataFrame, items: DataFrame, share: float, least: int) -> DataFrame:
    """The leaks of any number of items, by a join of the values of sketches."""
    schema = "id bigint, value bigint, upper bigint"
    own = cut(items.select(F.col("item_id").alias("id"), "t").mapInPandas(lambda it: _values(it, None, least), schema))
    uppers = sorted(r["upper"] for r in own.select("upper").distinct().collect())  # one for every power of two
    if not uppers:
        return items.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    of_items = own.withColumn("need", F.when(F.count(F.lit(1)).over(Window.partitionBy("id")) < SURE, 1).otherwise(2))
    counts = own.groupBy("value", "upper").agg(F.ceil(F.count(F.lit(1)) / SLICE_ITEMS).alias("slices"))
    listed = of_items.join(counts, ["value", "upper"]).groupBy("value", "upper", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice")).agg(F.collect_set(F.struct("id", "need")).alias("items"))
    # the value itself carries the class: documents name only values that some item has
    of_docs = texts.select(F.col("doc_id").alias("id"), "t").mapInPandas(lambda it: _values(it, uppers, least), schema)
    wanted = counts.select("value", "upper")
    met = cut(of_docs.join(wanted, ["value", "upper"], "left_semi").withColumn("key", F.struct("value", "upper")))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    facts = listed.withColumn("key", F.struct("value", "upper")).join(sizes, "key").select("key", "items", "n")
    linked = attach_by_key(met.select("key", F.col("id").alias("doc_id")), facts, "key", "n", met.count()).select("doc_id", F.explode("items").alias("i"))
    pairs = linked.groupBy("doc_id", F.col("i.id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.first("i.need").alias("need")).filter("n >= need").select("doc_id", "item_id")
    both = pairs.join(texts, "doc_id").join(items.select("item_id", F.col("t").alias("item")), "item_id")
    return both.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(lambda it: _verified(it, share, least), "doc_id bigint, item_id bigint").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, text_col: str, item_id: str, item_text: str, share: float = 0.5, least: int = 12) -> DataFrame:
    """(doc_id, item_id): documents with each item they hold."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("doc_id IS NOT NULL AND t IS NOT NULL")
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("item_id IS NOT NULL AND t IS NOT NULL").distinct()
    if (asked.agg(F.sum(F.length("t").cast("bigint") + 8)).first()[0] or 0) > SENT:
        return _joined(texts, asked, share, least)
    sent = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in asked.collect()], share, least))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, known = sent.value, {}
        for b in batches:
            out = [(d, i) for d, t in zip(b["doc_id"].tolist(), b["t"].tolist()) for i in index.found_in(plain_words(t), known)]
            if len(known) > 500_000:
                known.clear()
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return texts.mapInPandas(search, "doc_id bigint, item_id bigint").distinct()
