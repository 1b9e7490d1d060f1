"""Sequence algorithms without a relational form: the package's few Arrow functions.

All rest on the stretches of two sequences that lie between their matching blocks, as the standard library finds them;
its choices differ from those of a least edit distance. They work on the words of one utterance at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the punctuation that does not count at the ends of a word of a phrase.
PHRASE_MARKS = ".,!?;:"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    return _EDGES.sub("", word.lower())


def stretches(a: Sequence, b: Sequence) -> Iterator[tuple[slice, slice, bool]]:
    """The two sequences cut into stretches, side by side, each the same in both or different."""
    i = j = 0
    for block in SequenceMatcher(None, a, b).get_matching_blocks():
        if i < block.a or j < block.b:
            yield slice(i, block.a), slice(j, block.b), False
        i, j = block.a + block.size, block.b + block.size
        if block.size:
            yield slice(block.a, i), slice(block.b, j), True


def width(s: slice) -> int:
    return s.stop - s.start


def placed(pivot: str, other: str) -> list[str | None]:
    """For every word of ``pivot`` the word of ``other`` in its place: '' where it has none, None where that is open."""
    theirs = other.split()
    places: list[str | None] = [None] * len(pivot.split())
    for p, o, _ in stretches([bare(w) for w in pivot.split()], [bare(w) for w in theirs]):
        if not width(o):
            places[p] = [""] * width(p)
        elif width(p) == width(o):
            places[p] = theirs[o]
    return places


@F.pandas_udf(T.ArrayType(T.StringType()))
def in_places(pivots: pd.Series, others: pd.Series) -> pd.Series:
    """``placed`` of two texts; null texts are empty."""
    return pd.Series([placed(p or "", o or "") for p, o in zip(pivots, others)], dtype=object)


def block_errors(reference: Sequence, hypothesis: Sequence) -> int:
    """Errors by matching blocks: of every differing stretch the longer side."""
    return sum(max(width(r), width(h)) for r, h, same in stretches(reference, hypothesis) if not same)


@F.pandas_udf(T.StructType([T.StructField("word_errors", T.LongType()), T.StructField("char_errors", T.LongType())]))
def block_error_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    pairs = [(r or "", h or "") for r, h in zip(reference, hypothesis)]
    return pd.DataFrame({"word_errors": [block_errors(r.split(), h.split()) for r, h in pairs], "char_errors": [block_errors(r, h) for r, h in pairs]}, dtype="int64")


def phrase_words(text: str | None) -> list[str]:
    return [w.strip(PHRASE_MARKS) for w in (text or "").lower().split()]


def exchanged(reference: str | None, hypothesis: str | None, longest: int = 2) -> list[dict[str, str]]:
    """Stretches of at most ``longest`` words that stand for each other in two texts."""
    meant, said = phrase_words(reference), phrase_words(hypothesis)
    sides = [(said[h], meant[r]) for r, h, same in stretches(meant, said) if not same]
    return [{"said": " ".join(s), "meant": " ".join(m)} for s, m in sides if 0 < len(s) <= longest and 0 < len(m) <= longest]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("said", T.StringType()), T.StructField("meant", T.StringType())])))
def substitutions(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """``exchanged`` of two texts."""
    return pd.Series([exchanged(r, h) for r, h in zip(reference, hypothesis)], dtype=object)


class Phrases:
    """Rules of phrases as a trie of their words; of the phrases that begin at a word the longest is exchanged.

    A text is read once and what was exchanged is not read again; of two rules for one phrase the first counts.
    """

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.root: dict = {}
        for said, meant in rules:
            node = self.root
            for w in said.lower().split():
                node = node.setdefault(w, {})
            if node is not self.root:
                node.setdefault(None, meant)

    def longest(self, words: list[str], begin: int) -> tuple[int, str] | None:
        """How many words the longest phrase at ``begin`` has, and what it becomes."""
        node, found = self.root, None
        for n, w in enumerate(words[begin:], 1):
            node = node.get(w)
            if node is None:
                break
            if None in node:
                found = (n, node[None])
        return found

    def apply(self, text: str) -> str:
        """The text with its phrases exchanged; punctuation around a phrase and the capital that begins it stay."""
        raw, words = text.split(), phrase_words(text)
        out, at = [], 0
        while at < len(raw):
            found = self.longest(words, at)
            if found is None:
                out.append(raw[at])
                at += 1
                continue
            n, meant = found
            if meant:
                whole = " ".join(raw[at : at + n])
                core = whole.strip(PHRASE_MARKS)
                before, _, after = whole.partition(core)
                out.append(before + (meant[:1].upper() + meant[1:] if core[:1].isupper() else meant) + after)
            at += n
        return " ".join(out)


def phrase_rules(rules: dict[str, list[tuple[str, str]]]):
    """A function of (text, language) that applies each language's rules; a rule table is a few hundred rows."""
    tries = {language: Phrases(listed) for language, listed in rules.items()}

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([tries[lang].apply(t) if t is not None and lang in tries else t for t, lang in zip(texts, languages)], dtype=object)

    return apply


@F.pandas_udf(T.StringType())
def phrase_key(phrases: pd.Series) -> pd.Series:
    """The words of a rule's phrase as ``Phrases`` looks for them, with a blank between them."""
    return pd.Series([" ".join((p or "").lower().split()) for p in phrases], dtype=object)


def phrases_of(text: str, longest: int) -> list[str]:
    """The different phrases of at most ``longest`` words that stand in a text, the empty one among them."""
    words = phrase_words(text)
    runs = (words[i : i + n] for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return ["", *dict.fromkeys(" ".join(r) for r in runs if all(r))]


def phrases_in(longest: int):
    """A function of a text: ``phrases_of``, null for a null text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else phrases_of(t, longest) for t in texts], dtype=object)

    return found


@F.pandas_udf(T.StringType())
def own_phrase_rules(texts: pd.Series, said: pd.Series, meant: pd.Series) -> pd.Series:
    """Every text with its own rules applied; without rules it stays as it is."""
    return pd.Series([t if t is None or s is None else Phrases(list(zip(s, m))).apply(t) for t, s, m in zip(texts, said, meant)], dtype=object)
