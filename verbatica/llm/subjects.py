"""Subject area of each document.

For every subject a language model is trained on the tokens of the documents in which the listed terms of the subject
occur in a good part of the sentences, against a background model of all other documents: words, and pairs of words
under the word before, interpolated with the background. The models are pruned to the words and pairs that are more
frequent in the subject beyond chance; what is left out keeps its background probability, scaled so that the whole adds
up to one. The weights of pair, word and background are fitted by expectation maximization on labelled documents.

A sentence is about the subject whose model lowers its per-token cross-entropy most against the background, if by at
least a margin, which is calibrated on the labelled documents. A document has every subject that at least ``share`` of
its sentences are about: none, one or several.

Counts and scores cover all documents and whole texts, all words and all pairs. Words are hashed to 56 bits; counts of
some million tokens are packed into sorted binary columns, one row for a range of hashes, and summed by range. What is
sent to the workers are the entries of the pruned models: each makes up ``LEAST_RATE`` of the tokens or more, so there
are at most ``1 / LEAST_RATE`` words and as many pairs, whatever the number of documents. Weights and margin are fitted
on at most ``CALIBRATE_ON`` labelled documents, those with the least hash of their identifier.

Defined results: null, empty and wordless texts have no sentence and no subject; rows with a null identifier are left
out; repeated rows of one document give one row; a sentence between two subjects with equal scores is about both;
without labels the default margin and weights hold; without terms or documents the result is empty; other columns are
not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import even_slots
from ..session import cut
from .minhash import _from_planes, _planes

SHARE = 0.2
SEED_SHARE = 0.15
#: The least part of the tokens, and the least number, from which a word or pair is in a model.
LEAST_RATE, LEAST = 2e-6, 5
CALIBRATE_ON = 2000
MARGIN = 0.08
WEIGHTS = (0.3, 0.5, 0.2)  # pair, word, background
#: Tokens whose counts are packed together; characters of documents for a range of hashes; documents scored together.
PACKED, RANGE_CHARACTERS, SCORED = 1 << 21, 1 << 24, 1024
#: How often a listed term that is too rare to be counted is said in its subject for once elsewhere.
RARE_TERM = 50.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_END = re.compile(r"[.!?]+\s+|\n\s*\n")
_PUNCTUATION = ",;:()[]<>|\"“”«»…"


def fold(text: str) -> str:
    """Composed, in lower case, with plain apostrophes and without entities."""
    if "&" in text:
        text = html.unescape(text)
    return unicodedata.normalize("NFC", text.lower()).replace("’", "'")


def sentences(text: str | None) -> list[list[str]]:
    """The words of every sentence.

    In texts whose lines are mostly closed by no punctuation a line is a sentence; in others line breaks alone do not
    end one. Fragments of fewer than two words (numbering, speakers, time stamps) are no sentences.
    """
    if not text:
        return []
    text = fold(text)
    for c in _PUNCTUATION:
        if c in text:
            text = text.replace(c, " ")
    lines = [x for x in text.split("\n") if x.strip()]
    closed = sum(x.rstrip()[-1:] in ".?!" for x in lines)
    units = [x.rstrip(" .?!") for x in lines] if closed * 5 < len(lines) else _END.split(text.rstrip(" .?!\n"))
    out = []
    for u in units:
        words = u.split()
        if len(words) > 4 or sum(w[0].isalpha() for w in words) >= 2:
            out.append(words)
    return out


class Ids(dict):
    """Words and their even 56-bit hashes."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 9 << 1
        return h


class Tokens:
    """The sentences of some documents as one array of hashes."""

    def __init__(self) -> None:
        self.ids = Ids()
        self.clear()

    def clear(self) -> None:
        self.words: list[int] = []
        self.lengths: list[int] = []  # of sentences
        self.counts: list[int] = []  # sentences of documents
        if len(self.ids) > 500_000:
            self.ids.clear()

    def add(self, text: str | None) -> None:
        doc = sentences(text)
        for words in doc:
            self.words.extend(map(self.ids.__getitem__, words))
            self.lengths.append(len(words))
        self.counts.append(len(doc))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of words, hashes of the pairs that end at them (0 at the beginning of a sentence), the sentence of
        each word, the document of each sentence, and the sentences of each document."""
        words = np.array(self.words, dtype=np.uint64)
        lengths, counts = np.array(self.lengths, dtype=np.int64), np.array(self.counts, dtype=np.int64)
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        pairs = np.zeros_like(words)
        if len(words) > 1:
            x = words[:-1] * _PAIR + words[1:]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            inside = sentence[1:] == sentence[:-1]
            pairs[1:] = np.where(inside, x >> np.uint64(8) | np.uint64(1), np.uint64(0))
        return words, pairs, sentence, np.repeat(np.arange(len(counts)), counts), counts


class Terms:
    """The listed terms as hashes, each with its subjects."""

    def __init__(self, seeds: dict[str, tuple[int, ...]], n_subjects: int) -> None:
        ids = Ids()
        entries = sorted((ids[w], k) for w, ks in seeds.items() for k in ks)
        self.keys = np.array([h for h, _ in entries], dtype=np.uint64)
        self.subjects = np.array([k for _, k in entries], dtype=np.int64)
        self.n = n_subjects

    def seeded(self, words: np.ndarray, sentence: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row for every document, a column for every subject: whether its listed terms stand in at least two
        sentences and ``SEED_SHARE`` of them."""
        first, last = np.searchsorted(self.keys, words, "left"), np.searchsorted(self.keys, words, "right")
        hits = np.flatnonzero(last > first)
        times = (last - first)[hits]
        entry = np.repeat(first[hits], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        said = np.unique(np.repeat(sentence[hits], times) * self.n + self.subjects[entry])
        with_terms = np.bincount(doc[said // self.n] * self.n + said % self.n, minlength=len(counts) * self.n).reshape(-1, self.n)
        return (with_terms >= 2) & (with_terms >= SEED_SHARE * counts[:, None])


COUNTED = ["part", "keys", "columns", "counts"]


def _counted(batches: Iterator[pd.DataFrame], terms: Terms, width: int, slots: list[int] | None = None) -> Iterator[pd.DataFrame]:
    """Counts of words and pairs in all documents (column 0) and in those of every subject (1 ...), packed by ranges of
    hashes; part -1 has the numbers of words and of pairs by column."""
    tokens, totals = Tokens(), np.zeros((2, terms.n + 1), dtype=np.int64)

    def packed() -> pd.DataFrame:
        words, pairs, sentence, doc, counts = tokens.arrays()
        tokens.clear()
        of = terms.seeded(words, sentence, doc, counts)
        pairs_at = np.flatnonzero(pairs)
        keys, columns, numbers = [], [], []
        for column in range(terms.n + 1):
            here = np.ones(len(words), dtype=bool) if not column else of[:, column - 1][doc[sentence]]
            if here.any():
                there = pairs_at[here[pairs_at]]
                totals[:, column] += here.sum(), len(there)
                k, c = np.unique(np.concatenate([words[here], pairs[there]]), return_counts=True)
                keys.append(k)
                columns.append(np.full(len(k), column, dtype=np.uint64))
                numbers.append(c.astype(np.uint64))
        k, col, num = (np.concatenate(x) for x in (keys, columns, numbers))
        order = np.argsort(k, kind="stable")
        k, col, num = k[order], col[order], num[order]
        parts = (k // np.uint64(width)).astype(np.int64)
        ends = np.flatnonzero(np.concatenate([parts[1:] != parts[:-1], [True]])) + 1
        begins = np.concatenate([[0], ends[:-1]])
        rows = [(slots[parts[i]] if slots else int(parts[i]), _planes(k[i:j], 7), _planes(col[i:j], 2), _planes(num[i:j], 4)) for i, j in zip(begins, ends)]
        return pd.DataFrame(rows, columns=COUNTED)

    for b in batches:
        for text in b["t"].tolist():
            tokens.add(text)
            if len(tokens.words) >= PACKED:
                yield packed()
    if tokens.words:
        yield packed()
    yield pd.DataFrame([(-1, b"", b"", totals.tobytes())], columns=COUNTED)


def _summed(batches: Iterator[pd.DataFrame], n_subjects: int) -> Iterator[pd.DataFrame]:
    """(key, n, k, m): what was counted ``n`` times, of them ``m`` in subject ``k``, where that is much; k = -1: totals."""
    waiting: list[tuple] = []

    def done() -> pd.DataFrame:
        k, col, num = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        order = np.argsort(k << np.uint64(8) | col)
        k, col, num = k[order], col[order], num[order]
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (col[1:] != col[:-1])]))
        k, col, num = k[starts], col[starts].astype(np.int64), np.add.reduceat(num, starts).astype(np.int64)
        n = num[np.maximum.accumulate(np.where(col == 0, np.arange(len(col)), 0))]
        much = (col > 0) & (n >= LEAST) & (4 * num >= n)
        return pd.DataFrame({"key": k[much].astype(np.int64), "n": n[much], "k": col[much] - 1, "m": num[much]})

    part = None
    for b in batches:
        for row in b.itertuples(index=False):
            if row.part == -1:
                totals = np.frombuffer(row.counts, dtype=np.int64)
                yield pd.DataFrame({"key": np.arange(len(totals)), "n": totals, "k": -1, "m": 0})
                continue
            if row.part != part and waiting:
                yield done()
            part = row.part
            waiting.append((_from_planes(row.keys, 7), _from_planes(row.columns, 2), _from_planes(row.counts, 4)))
    if waiting:
        yield done()


class Model:
    """The pruned models of all subjects: for every kept hash by how much it is likelier under each subject."""

    def __init__(self, rows: pd.DataFrame, words: np.ndarray, pairs: np.ndarray, terms: Terms) -> None:
        """``rows``: (key, n, k, m); ``words``, ``pairs``: their numbers in all documents and in those of each subject."""
        n, m, k = (rows[c].to_numpy(np.int64) for c in ("n", "m", "k"))
        key = rows["key"].to_numpy(np.int64).astype(np.uint64)
        odd = (key & np.uint64(1)).astype(bool)
        total, of = np.where(odd, pairs[0], words[0]), np.where(odd, pairs[1:][k], words[1:][k])
        r, base = m / np.maximum(n, 1), of / np.maximum(total, 1)
        # the lower end of the 95 % interval of the subject's part lies a quarter of the way from its usual part to 1
        low = (r + 1.92 / n - 1.96 * np.sqrt((r * (1 - r) + 0.96 / n) / n)) / (1 + 3.84 / n)
        kept = (low >= base + 0.25 * (1 - base)) & (n >= LEAST_RATE * total)
        key, k, n, m, total, of, odd = (x[kept] for x in (key, k, n, m, total, of, odd))
        inside, outside = m / of, (n - m + 0.5) / np.maximum(total - of, 1)
        self.keys = np.unique(np.concatenate([key, terms.keys]))
        # what is not kept keeps its background probability, scaled to what is left
        mass = np.zeros((2, terms.n))
        np.add.at(mass, (0, k[~odd]), inside[~odd])
        np.add.at(mass, (1, k[~odd]), outside[~odd])
        self.rest = (1 - np.minimum(mass[0], 0.9)) / (1 - np.minimum(mass[1], 0.9))
        self.ratio = np.tile(self.rest.astype(np.float32), (len(self.keys), 1))
        listed = np.searchsorted(self.keys, terms.keys)
        counted = np.isin(terms.keys, key)
        self.ratio[listed[~counted], terms.subjects[~counted]] = RARE_TERM
        self.ratio[np.searchsorted(self.keys, key), k] = inside / outside
        self.weights = WEIGHTS

    def _at(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``ratio``, -1 for what is not kept."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, -1)

    def tokens(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that are not left to the background, and by how much the pair, under the word before, and
        the word are likelier there under each subject."""
        w, p = self._at(words), np.where(pairs > 0, self._at(pairs), -1)
        hits = np.flatnonzero((w >= 0) | (p >= 0))
        w, p = w[hits], p[hits]
        word = np.where(w[:, None] >= 0, self.ratio[w], self.rest)
        before = self._at(words[hits - 1])
        before = np.where(before[:, None] >= 0, self.ratio[before], self.rest)
        return hits, np.where(p[:, None] >= 0, self.ratio[p] / before, word), word

    def gains(self, words: np.ndarray, pairs: np.ndarray, sentence: np.ndarray, n_sentences: int) -> np.ndarray:
        """By how much each subject's model lowers the per-token cross-entropy of every sentence."""
        pair, word, back = self.weights
        usual = np.log((pair + word) * self.rest + back)
        hits, p, w = self.tokens(words, pairs)
        more = np.log(pair * p + word * w + back) - usual
        lengths = np.maximum(np.bincount(sentence, minlength=n_sentences), 1)
        sums = np.stack([np.bincount(sentence[hits], weights=more[:, k], minlength=n_sentences) for k in range(more.shape[1])], axis=1)
        return sums / lengths[:, None] + usual

    def fit_weights(self, words: np.ndarray, pairs: np.ndarray, of: np.ndarray, rounds: int = 20) -> None:
        """Expectation maximization on words of documents with known subjects; ``of``: the subject of each word."""
        hits, p, w = self.tokens(words, pairs)
        of_hits = of[hits]
        some = of_hits >= 0
        p, w, k = p[some], w[some], of_hits[some]
        if not len(k):
            return
        each = np.stack([p[np.arange(len(k)), k], w[np.arange(len(k)), k], np.ones(len(k))], axis=1)
        weights = np.array(WEIGHTS)
        for _ in range(rounds):
            part = each * weights
            weights = np.maximum((part / part.sum(axis=1, keepdims=True)).mean(axis=0), 0.02)
            weights /= weights.sum()
        self.weights = tuple(weights.tolist())


def about(gains: np.ndarray, margin: float) -> np.ndarray:
    """Which subjects the sentences are about: those with the largest gain, if it reaches the margin."""
    best = gains.max(axis=1, keepdims=True)
    return (gains >= best - 1e-9) & (best >= margin)


def _score(batches: Iterator[pd.DataFrame], model: Model, margin: float) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for b in batches:
        for i in range(0, len(b), SCORED):
            ids = b["id"].to_numpy()[i : i + SCORED]
            tokens.clear()
            for text in b["t"].tolist()[i : i + SCORED]:
                tokens.add(text)
            words, pairs, sentence, doc, counts = tokens.arrays()
            if not len(words):
                continue
            told = about(model.gains(words, pairs, sentence, len(doc)), margin)
            n = np.stack([np.bincount(doc, weights=told[:, k], minlength=len(counts)) for k in range(told.shape[1])], axis=1).astype(np.int64)
            d, k = np.nonzero(n)
            yield pd.DataFrame({"id": ids[d], "k": k.astype(np.int32), "n_about": n[d, k], "n_sentences": counts[d]})


def calibrate(texts: dict[int, str], labels: dict[int, set[int]], model: Model, share: float) -> float:
    """Fits the weights of the model and returns the margin with the best F1 of subjects against the labels; the middle
    of several equally good ones."""
    tokens, given = Tokens(), []
    for d, t in texts.items():
        tokens.add(t)
        given.append(labels[d])
    words, pairs, sentence, doc, counts = tokens.arrays()
    if not len(words):
        return MARGIN
    # only documents of one subject tell whose words they are
    of = np.array([next(iter(x)) if len(x) == 1 else -1 for x in given])
    model.fit_weights(words, pairs, of[doc[sentence]])
    gains = model.gains(words, pairs, sentence, len(doc))
    wanted = np.zeros((len(counts), gains.shape[1]), dtype=bool)
    for i, x in enumerate(given):
        wanted[i, list(x)] = True
    scored = []
    for margin in (0.0, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3):
        told = about(gains, margin)
        n = np.stack([np.bincount(doc, weights=told[:, k], minlength=len(counts)) for k in range(told.shape[1])], axis=1)
        got = (n >= share * counts[:, None]) & (n > 0)
        scored.append((round(2 * (got & wanted).sum() / max(1, got.sum() + wanted.sum()), 4), margin))
    best = max(s for s, _ in scored)
    good = [m for s, m in scored if s >= best - 0.002]
    return good[len(good) // 2] if best > 0 else MARGIN


def trained(texts: DataFrame, terms: Terms) -> Model:
    """The models of the documents (t)."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(terms)
    characters = texts.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0
    n_parts = max(1, -(-characters // RANGE_CHARACTERS))
    width, slots = -(-(1 << 56) // n_parts), even_slots(spark, n_parts)
    packed = texts.select("t").mapInPandas(lambda it: _counted(it, sent.value, width, slots), "part bigint, keys binary, columns binary, counts binary")
    n = terms.n
    summed = cut(packed.repartition(n_parts, "part").sortWithinPartitions("part").mapInPandas(lambda it: _summed(it, n), "key bigint, n bigint, k bigint, m bigint"))
    totals = {r["key"]: r["n"] for r in summed.filter("k = -1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    words, pairs = (np.array([totals.get(kind * (n + 1) + c, 0) for c in range(n + 1)], dtype=np.int64) for kind in (0, 1))
    # at most 1 / LEAST_RATE words and as many pairs, each with at most four subjects
    rows = summed.filter((F.col("k") >= 0) & (F.col("n") >= LEAST_RATE * float(min(words[0], pairs[0]) if pairs[0] else words[0])))
    return Model(rows.toPandas(), words, pairs, terms)


def subject_shares(docs: DataFrame, terms: DataFrame, labels: DataFrame | None, doc_id: str, text_col: str, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, n_about, n_sentences) for every subject that some sentence of a document is about."""
    spark = docs.sparkSession
    listed = [(r[0], r[1]) for r in terms.select(F.lower(F.trim("subject")).alias("s"), F.col("term").cast("string")).dropna().distinct().collect()]
    names = sorted({s for s, _ in listed})
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string, n_about bigint, n_sentences bigint")
    number = {s: k for k, s in enumerate(names)}
    found: dict[str, set[int]] = {}
    for s, term in listed:
        found.setdefault(fold(term), set()).add(number[s])
    seeds = Terms({w: tuple(sorted(v)) for w, v in found.items()}, len(names))
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    model, margin = trained(texts, seeds), MARGIN
    if labels is not None:
        named = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("s")).dropna()
        chosen = named.select("id").distinct().orderBy(F.xxhash64("id")).limit(CALIBRATE_ON)
        told: dict[int, set[int]] = {}
        for r in named.join(F.broadcast(chosen), "id", "left_semi").collect():
            told.setdefault(r["id"], set()).update({number[r["s"]]} if r["s"] in number else ())
        if told:
            wanted = spark.createDataFrame([(i,) for i in told], "id bigint")
            margin = calibrate({r["id"]: r["t"] for r in texts.join(F.broadcast(wanted), "id", "left_semi").collect()}, told, model, share)
    sent = spark.sparkContext.broadcast(model)
    scored = texts.mapInPandas(lambda it: _score(it, sent.value, margin), "id bigint, k int, n_about bigint, n_sentences bigint")
    return scored.select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(s) for s in names]), F.col("k") + 1).alias("subject"), "n_about", "n_sentences")


def subjects_of(docs: DataFrame, terms: DataFrame, labels: DataFrame | None, doc_id: str, text_col: str, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): every subject that at least ``share`` of a document's sentences are about."""
    return subject_shares(docs, terms, labels, doc_id, text_col, share).filter(F.col("n_about") >= F.lit(share) * F.col("n_sentences")).select("doc_id", "subject").distinct()


def composition(docs: DataFrame, terms: DataFrame, labels: DataFrame | None, doc_id: str, text_col: str, share: float = SHARE) -> DataFrame:
    """Per subject the documents that have it and the sentences about it, in these documents and in passing."""
    s = subject_shares(docs, terms, labels, doc_id, text_col, share)
    has = F.col("n_about") >= F.lit(share) * F.col("n_sentences")
    return s.groupBy("subject").agg(F.count_if(has).alias("n_docs"), F.sum(F.when(has, F.col("n_about")).otherwise(0)).alias("n_sentences"), F.sum(F.when(has, 0).otherwise(F.col("n_about"))).alias("n_in_passing"))
