"""The training-data operators on small tables: brute force, edges, hot groups."""

import itertools
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbatica.llm import allocation, crosssplit, formatting, leakage, lookalike, minhash, mixing, subjects, tokens, truncation
from verbatica.operators import skew


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def with_clashes(df):
    """Extra columns named like those the operators use inside."""
    for c in ("id", "t", "key", "rep", "letters", "words", "n", "grp", "k", "source_", "held", "form", "raw", "w", "at"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


# ---- 1 ----------------------------------------------------------------------------------------------------------

ZOO = "row_no bigint, id string, model_name string, target string"
SAID = "the quick brown fox jumps over the lazy dog near the river bank today"


def zoo(spark, rows):
    return with_clashes(spark.createDataFrame(rows, ZOO))


def cut_rows(spark, rows, references=None):
    refs = spark.createDataFrame(references or [], "id string, target string")
    return [r["row"] for r in truncation.truncations(zoo(spark, rows), refs, "row_no", "id", "model_name", "target").filter("cut").orderBy("row").collect()]


def test_truncation(spark):
    rows = [
        (1, "u1", "a", SAID), (2, "u1", "b", "The quick brown fox jumps over the lazy dog near the riv"), (3, "u1", "c", "the quick brown fox jumps over the"), (4, "u1", "d", "the quick fox jumps over the lazy dog near the river bank today"),
        (5, "u1", "e", SAID + " ..."), (6, "u1", "f", None), (7, "u1", "g", ""), (8, "u1", "h", "[music]"), (9, "u1", "c", "the quick brown fox jumps over the"),
        (10, "u1", "i", SAID + " bank today bank today bank today bank today"), (11, None, "a", SAID), (12, "u2", None, "hello there my friend"),
    ]
    assert cut_rows(spark, rows) == [2, 3, 9]


def test_truncation_by_reference_and_by_trie(spark):
    assert cut_rows(spark, [(1, "u", "a", "the quick brown fox jumps")], [("u", SAID)]) == [1]
    common = [(10 + i, f"w{i}", "a", "many people walk along the river bank again") for i in range(4)]
    alone = [(1, "x", "a", "people walk along the riv"), (2, "y", "a", "people walk along the riv."), (3, "z", "a", "people walk along the river")]
    assert cut_rows(spark, common + alone) == [1]


def test_truncation_of_nothing(spark):
    assert cut_rows(spark, []) == []
    rates = truncation.truncation_rates(zoo(spark, []), spark.createDataFrame([], "id string, target string"), "row_no", "id", "model_name", "target")
    assert rates.count() == 0


def test_loops():
    assert truncation.without_loops("a b c b c b c b".split()) == ["a", "b", "c"]
    assert truncation.without_loops(["x"] * 5) == ["x"] and truncation.without_loops([]) == []
    assert truncation.without_loops("a b a b".split()) == "a b a b".split()


def test_truncation_with_a_hot_utterance(spark):
    rows = [(i, "hot", f"m{i % 40}", SAID if i % 10 else "the quick brown fox jumps over the") for i in range(400)]
    assert cut_rows(spark, rows) == [i for i in range(400) if i % 10 == 0]


def test_truncation_beside_many_longer_texts(spark):
    loops = [(100 + i, "u", f"x{i}", " ".join(f"noise{i} other{i} thing{j}" for j in range(5))) for i in range(12)]
    assert 1 in cut_rows(spark, [(1, "u", "a", "the quick brown fox jumps over the lazy dog")] + loops, [("u", SAID)])
    loops = [(100 + i, "u", f"x{i}", " ".join(f"noise{i} other{i} thing{j}" for j in range(5))) for i in range(70)]
    rows = [(1, "u", "a", "the quick brown fox jumps over the lazy dog"), (1, "u", "a", "the quick brown fox jumps over the lazy dog"), (2, "u", "b", SAID)]
    assert [r for r in cut_rows(spark, rows + loops, [("u", SAID)]) if r < 100] == [1, 1]


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_chunks_count_like_the_whole():
    rng = random.Random(1)
    alphabet = ["a", "ŋ", " ", "  ", "\n", "7", "'s", "don't", "ɛ́", "!", " ", "日本", "🙂", "x1y2"]
    for _ in range(200):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 80)))
        parts = tokens.safe_chunks(text, rng.randint(1, 12))
        assert "".join(parts) == text
        assert sum(map(tokens.n_tokens, parts)) == tokens.n_tokens(text)


def test_token_counts(spark):
    long = "word " * 30_000
    rows = [(1, "a b", None, "s"), (2, None, "", "s"), (3, "same", "same", None), (4, long, "tail 1", "t"), (4, long, "tail 1", "t"), (None, "x", None, "s")]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, transcription string, text string, source string"))
    got = sorted((r["id"] or 0, r["n_tokens"]) for r in tokens.token_counts(df, "row_no", ["transcription", "text"], {"source": F.col("source")}, most=1000).collect())
    n = tokens.n_tokens
    assert got == sorted([(1, n("a b")), (3, n("same")), (4, n(long) + n("tail 1")), (4, n(long) + n("tail 1")), (0, n("x"))])
    budget = {(r["dimension"], r["value"]): (r["n_records"], r["n_tokens"]) for r in tokens.token_budget(df, "row_no", ["transcription", "text"], {"source": F.col("source")}).collect()}
    assert budget["all", "all"] == (5, sum(t for _, t in got)) and budget["source", "(none)"] == (1, n("same"))
    assert tokens.token_budget(df.limit(0), "row_no", ["text"], {"source": F.col("source")}).count() == 0


def test_meant_languages(spark):
    df = spark.createDataFrame([(x,) for x in ["LIN", "ln_cd", "Lingala", "sog", "mas", None, "und", "??", "en"]], "l string")
    assert [r[0] for r in df.select(tokens.meant_language(F.col("l"))).collect()] == ["lin", "lin", "lin", "xog", "myx", "und", "und", "und", "eng"]


# ---- 3 ----------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    syllables = ["ba", "ko", "mi", "lu", "ŋo", "té", "ndi", "sa", "zu", "gwe"]
    base = ["".join(rng.choice(syllables) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randint(8, 45))) for _ in range(60)]
    rows = []
    for i, t in enumerate(base):
        rows.append((2 * i, t, False))
        other = list(t)
        for _ in range(rng.choice([0, 1, 3, int(len(t) * 0.1), int(len(t) * 0.4)])):
            other[rng.randrange(len(other))] = rng.choice("xyq")
        rows.append((2 * i + 1, "".join(other).upper() + "!", True))
    rows += [(900, None, True), (901, "", False), (902, "short", True), (903, "short", False), (904, base[0], None), (None, base[0], True), (0, base[0], False)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, transcription string, is_held boolean"))
    got = set(pairs(crosssplit.overlap_pairs(df, "row_no", "transcription", F.col("is_held")), "train_id", "held_id"))
    letters = {(i, h): crosssplit.read_letters(t) for i, t, h in rows if i is not None and h is not None}
    want = {
        (a, b) for (a, ha), x in letters.items() for (b, hb), y in letters.items()
        if not ha and hb and min(len(x), len(y)) >= 12 and edits(x, y) <= 0.2 * max(len(x), len(y))
    }
    assert got <= want and len(got) >= 0.95 * len(want)
    sure = {(a, b) for a, b in want if edits(letters[a, False], letters[b, True]) <= 0.1 * len(letters[a, False])}
    assert sure <= got


def test_comparing_all_pairs_finds_every_overlap(spark):
    rng = random.Random(11)
    syllables = ["ba", "ko", "mi", "lu", "no", "te", "ndi", "sa", "zu", "gwe"]
    rows, want = [], set()
    for i in range(60):
        t = "".join(rng.choice(syllables) for _ in range(rng.randint(14, 120)))[: rng.choice([35, 60, 90, 150, 230])]
        k, other = len(t) // 5, list(t)
        at = range(4, len(t), 5) if i % 3 == 0 else rng.sample(range(len(t)), k)  # evenly spread, at random places, lost
        for j in list(at)[:k]:
            other[j] = "" if i % 3 == 2 else "q"
        rows += [(2 * i, t, False), (2 * i + 1, "".join(other), True)]
        want.add((2 * i, 2 * i + 1))
    rows += [(900, "ba" * 40, False), (901, "ba" * 33, True), (902, "ba" * 31, True)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, transcription string, is_held boolean"))
    got = set(pairs(crosssplit.overlap_pairs(df, "row_no", "transcription", F.col("is_held"), complete=True), "train_id", "held_id"))
    letters = {(i, h): t for i, t, h in rows}
    brute = {(a, b) for (a, ha), x in letters.items() for (b, hb), y in letters.items() if not ha and hb and 5 * edits(x, y) <= max(len(x), len(y))}
    assert want <= brute and got == brute


@pytest.mark.parametrize("part,least", [(0.1, 0.995), (0.15, 0.98), (0.2, 0.92)])
def test_bands_and_sketches_find_nearly_all(part, least):
    rng = random.Random(5)
    syllables = ["ba", "ko", "mi", "lu", "no", "te", "ndi", "sa", "zu", "gwe", "ŋa", "chi", "pfu", "hre"]
    texts = ["".join(rng.choices(syllables, k=90))[: rng.choice([25, 40, 60, 90, 150])] for _ in range(1000)]
    others = []
    for t in texts:
        other = list(t)
        for j in rng.sample(range(len(t)), int(part * len(t) + 1e-9)):
            other[j] = rng.choice("abdefgiklmnostuz")
        others.append("".join(other))
    n = len(texts)
    packed = minhash._packed(np.arange(2 * n), texts + others, np.array([1] * n + [2] * n), 0.2, 1 << minhash.KEY_BITS)
    matched = pd.concat(minhash._matched(iter([packed]), 0.2))
    found = set(zip(matched["t"], matched["h"]))
    assert sum((i, n + i) in found for i in range(n)) >= least * n
    assert len(found) < 2 * n  # few others


def test_hot_keys_leave_in_slices(spark, monkeypatch):
    texts = [f"mangabolukunzelikembatosala{i:02d}" for i in range(60)]
    classes = spark.createDataFrame([(i, t, 1 + i % 2) for i, t in enumerate(texts)], "cid bigint, letters string, side int")
    usual = set(pairs(minhash.candidates(classes, 0.2), "t", "h"))
    assert usual == {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2)}
    assert len(list(minhash._matched(iter([minhash._packed(np.arange(60), texts, np.array([1, 2] * 30), 0.2, 1 << 48)]), 0.2))) == 1
    for name, value in {"HOT": 8, "SLICE": 4, "RANGE_KEYS": 50}.items():
        monkeypatch.setattr(minhash, name, value)
    sliced = pd.concat(minhash._matched(iter([minhash._packed(np.arange(60), texts, np.array([1, 2] * 30), 0.2, 1 << 48)] * 2), 0.2))
    sides = sliced[sliced["side"] > 0]
    assert len(sides) > 10 and sides["cids"].str.len().max() <= 32 and not sides.duplicated(["key", "side", "slice"]).any()
    crossed = sides[sides["side"] == 1].merge(sides[sides["side"] == 2], on="key", suffixes=("", "_h"))
    met = pd.concat(minhash._crossed(iter([crossed]), 0.2))
    rest = sliced[sliced["side"] == 0]
    assert set(zip(met["t"], met["h"])) | set(zip(rest["t"], rest["h"])) == usual


def test_tasks_and_ranges_of_large_inputs(spark, monkeypatch):
    for n in (1, 250_000, 1_500_000, 65_000_000):
        r = minhash.ranges_of(n)
        held = n * 1.5 * (80 / r * 17 + (1 - (1 - 1 / r) ** 80) * 42)  # a key, and the text that comes with the first of its keys
        assert held <= 151e6 and (r == 1 or held > 60e6)
    assert [skew.fewer_tasks(spark, n) for n in (0, 7, 512, 2000, 4000, 40_000)] == [0, 7, 512, 512, 1000, 10_000]
    rng = random.Random(4)
    texts = ["".join(rng.choices(["ba", "ko", "mi", "lu", "no", "te", "ndi"], k=20)) for _ in range(40)]
    texts = [x for t in texts for x in (t, t[:9] + "q" + t[10:])]
    rows = [(i, t, i % 2 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_no bigint, t0 string, h boolean")
    usual = set(pairs(crosssplit.overlap_pairs(df, "row_no", "t0", F.col("h")), "train_id", "held_id"))
    assert usual >= {(i, i + 1) for i in range(0, 80, 2)}
    for module, name, value in ((skew, "MANY_TASKS", 3), (minhash, "RANGE_BYTES", 5000), (minhash, "SENT", 500), (crosssplit, "TASK_CLASSES", 1)):
        monkeypatch.setattr(module, name, value)
    assert minhash.ranges_of(80) > 64  # more than tasks, which are at most four for each core here, or a quarter
    assert crosssplit._classes(df, "row_no", "t0", F.col("h"), 12)[1].rdd.getNumPartitions() <= 20
    assert set(pairs(crosssplit.overlap_pairs(df, "row_no", "t0", F.col("h")), "train_id", "held_id")) == usual


def test_letters_of_many_texts():
    texts = ["ﬁn Ⅳ x\n yＡ\u200bｂ！", "𝐇𝐞𝐥𝐥𝐨 ｶﾞ", "", "ǅ ß ŉ İstanbul", "Ὀδυσσεύς ΑΎΤΟ", "plain, text 12", "ndɔ́ɛ̂ \U0001f642", "x" * 50_000, "\n\n", "е\u0301té"]
    marks = lambda t: sum(unicodedata.category(c)[0] == "M" for c in t)
    assert crosssplit.read_letters_of(texts) == [(x, len(x) - marks(x)) for x in map(crosssplit.read_letters, texts)]
    assert crosssplit.read_letters_of([]) == []


def test_jaccard_rejects_only_what_is_too_far():
    rng = random.Random(3)
    x = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(12, 60))) for _ in range(300)]
    y = ["".join(c if rng.random() > 0.15 else rng.choice("abcdefghijklmnopq") for c in t) for t in x[:150]] + x[:150][::-1]
    got = pd.concat(crosssplit._similar(iter([pd.DataFrame({"x": x, "y": y})]), 0.2))
    near = {i for i in range(300) if edits(x[i], y[i]) <= int(0.2 * max(len(x[i]), len(y[i])) + 1e-9)}
    assert near <= set(got.index) and len(got) < 250
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    assert all(abs(r.jaccard - len(grams(r.x) & grams(r.y)) / len(grams(r.x) | grams(r.y))) < 1e-12 for r in got.itertuples())


def test_overlap_report_counts_hot_copies(spark):
    text = "manga bokulu nze likemba tosala"
    rows = [(i, text, False, "train", "s") for i in range(300)] + [(1000 + i, text.upper(), True, "dev", "e") for i in range(5)] + [(2000, "kitu kingine kabisa hapa leo", True, "dev", "e")]
    df = spark.createDataFrame(rows, "row_no bigint, t0 string, h boolean, sp string, so string")
    r = crosssplit.overlap_report(df, "row_no", "t0", F.col("h"), "sp", "so").collect()
    assert [(x["split"], x["source"], x["n_rows"], x["n_overlapping"], x["n_pairs"]) for x in r] == [("dev", "e", 6, 5, 1500)]
    assert crosssplit.overlap_pairs(df, "row_no", "t0", F.col("h")).count() == 1500
    assert crosssplit.overlap_pairs(df.limit(0), "row_no", "t0", F.col("h")).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_speakers_and_splits_are_read(spark):
    rows = [("LUG-SPK-0000007/s01", "lug:7"), ("7", "lug:7"), ("\tLug.Spk.7", "lug:7"), ("SPK 007 ", "lug:7"), ("anon", None), ("", None), (None, None), ("-", None), ("spk-0", "lug:0")]
    df = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(rows)], "s string, i int")
    assert [r[0] for r in df.orderBy("i").select(allocation.speaker_key(F.lit("LUG"), F.col("s"))).collect()] == [k for _, k in rows]
    names = spark.createDataFrame([(x,) for x in [" Train", "DEV", "val", "test\t", None, "x"]], "s string")
    assert [r[0] for r in names.select(allocation.split_name(F.col("s"))).collect()] == ["train", "validation", "validation", "test", None, None]


def test_group_leaks(spark):
    rows = [(1, "a", "train"), (2, "a", "test"), (3, "b", "test"), (4, None, "test"), (5, None, "train"), (6, "a", None), (7, "c", "train"), (None, "a", "validation")] + [(100 + i, "a", "test") for i in range(200)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, s string, sp string"))
    assert pairs(allocation.group_leaks(df, "row_no", F.col("s"), F.col("sp")), "id") == [(2,)] + [(100 + i,) for i in range(200)]


def test_allocation_is_close_and_whole():
    rng = random.Random(2)
    for _ in range(20):
        bundles = {}
        for _ in range(rng.randint(1, 40)):
            key = (rng.choice([1, 1, 2, 3, 5, 8, 30, 120]), rng.choice("xyz"))
            bundles[key] = bundles.get(key, 0) + rng.randint(1, 9)
        plan = allocation.allocate([(s, lab, n) for (s, lab), n in bundles.items()], allocation.SPLITS)
        assert {k: sum(v.values()) for k, v in plan.items()} == bundles
        assert all(n >= 0 for v in plan.values() for n in v.values())
        total = sum(s * n for (s, _), n in bundles.items())
        got = {s: sum(k[0] * v.get(s, 0) for k, v in plan.items()) for s in allocation.SPLITS}
        ones = sum(n for (s, _), n in bundles.items() if s == 1)
        if ones > 40 and max(s for s, _ in bundles) < 0.1 * total:
            assert all(abs(got[s] - q) <= 1 for s, q in allocation.quotas(total, allocation.SPLITS).items())
    assert allocation.allocate([], allocation.SPLITS) == {}


def test_many_bundles_are_allocated_fast():
    import time

    rng = random.Random(1)
    bundles = {(s, "xyzuvw"[s % 6]): 1 for s in range(1, 5000)}
    while len(bundles) < 30_000:
        bundles[rng.randint(1, 30_000), rng.choice("xyzuvw")] = rng.randint(1, 9)
    began = time.process_time()
    plan = allocation.allocate([(s, lab, n) for (s, lab), n in bundles.items()], allocation.SPLITS)
    assert time.process_time() - began < 30
    total = sum(s * n for (s, _), n in bundles.items())
    got = {s: sum(k[0] * v.get(s, 0) for k, v in plan.items()) for s in allocation.SPLITS}
    assert all(abs(got[s] - q) <= 1 for s, q in allocation.quotas(total, allocation.SPLITS).items())
    assert {k: sum(v.values()) for k, v in plan.items()} == bundles and min(n for v in plan.values() for n in v.values()) >= 0


def test_splits_do_not_change_from_run_to_run(spark):
    df = spark.createDataFrame([(i, None, "lin", None) for i in range(200)], "row_no bigint, s string, l string, u string")
    runs = [pairs(allocation.assign_splits(df.repartition(k), "row_no", F.col("s"), F.col("l"), F.col("u")), "id", "new_split") for k in (1, 3)]
    assert runs[0] == runs[1]


def test_splits_keep_groups_together(spark):
    rng = random.Random(6)
    rows = [(i, f"s{min(int(rng.expovariate(0.1)), 60)}" if rng.random() < 0.8 else None, "lin", f"u{i // 2}") for i in range(1500)] + [(5000 + i, "hot", "lin", f"h{i}") for i in range(700)] + [(9000, None, None, None)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, s string, l string, u string"))
    out = allocation.assign_splits(df, "row_no", F.col("s"), F.col("l"), F.col("u")).cache()
    assert out.count() == len(rows)
    assert out.filter("grp IS NOT NULL").groupBy("grp").agg(F.count_distinct("new_split").alias("n")).filter("n > 1").count() == 0
    got = {r["new_split"]: r["count"] for r in out.groupBy("new_split").count().collect()}
    assert all(abs(got[k] - 0.01 * p * len(rows)) <= 2 for k, p in {"train": 80, "validation": 10, "test": 10}.items())
    assert allocation.assign_splits(df.limit(0), "row_no", F.col("s"), F.col("l"), F.col("u")).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------------------------


def brute_content(a, b):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFC", unicodedata.normalize("NFD", t or "").casefold()) if unicodedata.category(c)[0] in "LMN")
    return tuple(sorted(x for x in (fold(a), fold(b)) if x))


def test_copies_against_brute_force(spark):
    rng = random.Random(8)
    words = ["Été", "été", "BA", "ba ", "ba.", "b a", "", None, "♪", "ba ", "x\ty", "XY", "“xy”", "bá"]
    rows = [(i, rng.choice(words), rng.choice(words)) for i in range(300)] + [(1000 + i, "hot text", None) for i in range(400)] + [(7, "BA", ""), (None, "ba", None)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, transcription string, text string"))
    groups = {}
    for i, a, b in rows:
        if i is not None and brute_content(a, b):
            groups.setdefault(brute_content(a, b), []).append(i)
    want = sorted({(min(g), i) for g in groups.values() for i in g if i != min(g)})
    assert pairs(formatting.copy_pairs(df, "row_no", ["transcription", "text"]), "a", "b") == want
    records = formatting.collapsed_records(df, "row_no", ["transcription", "text"])
    kept = {r["rep"]: r["n_copies"] for r in records.collect()}
    assert {min(g): len(g) for g in groups.values()} == kept
    assert formatting.copy_pairs(df.limit(0), "row_no", ["text"]).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------------------------


def test_forms(spark):
    raw = ["Ａ​ｂ！", "bо­n", "é", "a b", "a  b", None, "", "Caps", "ο⁠ν", "ﬁn", "it's «x»", "x" * 100_000 + "‍"]
    want = ["Ab!", "bon", "é", "a b", "a  b", None, "", "Caps", "ov", "fin", "it's «x»", "x" * 100_000]
    df = with_clashes(spark.createDataFrame(list(enumerate(raw)), "row_no bigint, transcription string"))
    assert [r["form"] for r in lookalike.with_forms(df, "row_no", "transcription").orderBy("id").collect()] == want
    assert [lookalike.consistent_form(t) for t in raw if t is not None] == [t for t in want if t is not None]


def test_lookalike_pairs(spark):
    a, b, c = "mabele ya koko te", "mаbele ya koko te", "mabele ya koko​ te"
    rows = [(1, a), (2, b), (3, c), (4, a), (5, "Mabele ya koko te"), (6, "short а"), (7, "short a"), (8, None), (None, b), (1, a)] + [(100 + i, a) for i in range(100)]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, transcription string"))
    ids = {i: t for i, t in rows if i is not None and t is not None and len(t) > 12 and t[0] == "m"}
    want = sorted((x, y) for x, y in itertools.combinations(sorted(ids), 2) if ids[x] != ids[y])
    assert pairs(lookalike.lookalike_pairs(df, "row_no", "transcription"), "a", "b") == want
    assert lookalike.lookalike_pairs(df.limit(0), "row_no", "transcription").count() == 0


def test_rows_of_a_large_form_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "SLICE_ROWS", 7)
    spelled = ["mabele ya koko te", "mаbele ya koko te", "mabele ya kоko te"]
    rows = [(i, spelled[i % 3]) for i in range(60)]
    got = pairs(lookalike.lookalike_pairs(spark.createDataFrame(rows, "row_no bigint, t string"), "row_no", "t"), "a", "b")
    assert got == sorted((i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3)


def test_styled_and_joined_forms():
    assert lookalike.consistent_form("𝐇𝑖 𝟙Ⅳ ﬁ ｶﾞ ℂ") == "Hi 1IV fi ガ C" and lookalike.consistent_form("x² ½ ①") == "x² ½ ①"
    assert lookalike.consistent_form("ոօ ᎪᎢ") == "no AT"


# ---- 7 ----------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abdegikmnostu", k=rng.randint(3, 9))) for _ in range(3000)]
    item = [" ".join(rng.choices(vocabulary, k=n)) for n in (20, 28, 41, 11, 12)]
    noise = lambda n: " ".join(rng.choices(vocabulary, k=n))
    w = item[1].split()
    slipped = [x[:2] + "z" + x[3:] if i in (4, 11, 15) and len(x) > 4 else x for i, x in enumerate(w)]
    docs = [
        (1, noise(90) + " " + item[0].upper() + ". " + noise(60)), (2, noise(33) + "\n[00:01:02] A: " + " ".join(w[3:10]) + "\n[00:01:09] B: " + " ".join(w[10:20]) + "\n" + noise(50)),
        (3, noise(70) + " " + " ".join(slipped) + " " + noise(20)), (4, noise(40) + " " + " ".join(w[:9]) + " " + noise(80)), (5, noise(500) + " " + item[2] + " " + noise(3000)), (6, item[3]), (7, item[4]), (8, None), (9, ""),
        (10, " ".join(w[i] + " " + noise(4) for i in range(28))), (None, item[0]), (11, item[0] + " " + item[1]), (11, item[0] + " " + item[1]), (12, noise(20) + " " + " ".join(item[2].split()[20:]) + " " + noise(9)),
    ]
    d = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    e = with_clashes(spark.createDataFrame([(i, t) for i, t in enumerate(item)] + [(None, item[0]), (99, None)], "item_id bigint, text string"))
    got = pairs(leakage.leaked_items(d, e, "doc_id", "text", "item_id", "text"), "doc_id", "item_id")
    assert got == [(1, 0), (2, 1), (3, 1), (5, 2), (7, 4), (11, 0), (11, 1), (12, 2)]
    assert leakage.leaked_items(d, e.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.leaked_items(d.limit(0), e, "doc_id", "text", "item_id", "text").count() == 0


def test_more_items_than_can_be_sent_give_the_same(spark, monkeypatch):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, text + " " + str(i)) for i in range(7)], "item_id bigint, text string")
    monkeypatch.setattr(leakage, "SENT", 2)
    monkeypatch.setattr(leakage, "SLICE_ITEMS", 3)
    assert leakage.leaked_items(d, e, "doc_id", "text", "item_id", "text").count() == 7
    assert leakage.leaked_items(d, e.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def leaking(rng, n_docs=150):
    """Documents with parts of items in them, with slips, and the items."""
    vocabulary = ["".join(rng.choices("abdegikmnostu", k=rng.randint(3, 8))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([14, 25, 40, 90, 200])))) for i in range(30)]
    docs = []
    for d in range(n_docs):
        body = rng.choices(vocabulary, k=rng.randint(20, 300))
        if d % 2:
            w = items[rng.randrange(30)][1].split()
            n = max(8, int(len(w) * rng.uniform(0.3, 1.0)))
            begin = rng.randint(0, len(w) - n)
            part = [x[:1] + "z" + x[2:] if rng.random() < 0.08 else x for x in w[begin : begin + n]]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, " ".join(body)))
    return docs, items


def test_leaks_against_brute_force(spark, monkeypatch):
    docs, items = leaking(random.Random(13))

    def brute(item, words):
        wanted = max(12, -(-len(item) // 2))
        for begin in range(len(words)):  # the item against every stretch of its size and some room
            part = words[begin : begin + len(item) + 2]
            row = [0] * (len(part) + 1)
            for a in item:
                new = [0]
                for j, b in enumerate(part, 1):
                    new.append(max(row[j], new[-1], row[j - 1] + leakage.same_word(a, b)))
                row = new
            if row[-1] >= wanted:
                return True
        return False

    small = [(d, t.split()) for d, t in docs if len(t.split()) < 160][:40]
    want = {(d, i) for d, w in small for i, t in items if len(t.split()) < 60 and set(t.split()) & set(w) and brute(t.split(), w)}
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = set(pairs(leakage.leaked_items(d, e, "doc_id", "text", "item_id", "text"), "doc_id", "item_id"))
    assert want and len(got & want) >= 0.95 * len(want)
    monkeypatch.setattr(leakage, "SENT", 0)
    joined = set(pairs(leakage.leaked_items(d, e, "doc_id", "text", "item_id", "text"), "doc_id", "item_id"))
    assert joined == got
    monkeypatch.setattr(leakage, "KEPT", 1 << 30)  # sketches that hold every shingle
    whole = set(pairs(leakage.leaked_items(d, e, "doc_id", "text", "item_id", "text"), "doc_id", "item_id"))
    assert got <= whole and len(got) >= 0.97 * len(whole)


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_budgets():
    got = mixing.budgets([("a", 0.5, 2), ("b", 0.5, 1), ("c", 0.0, 1), ("d", 0.3, 1)], {"a": 100, "b": 1000})
    assert got == {"a": (200, 2, 0), "b": (200, 0, 200)}
    assert mixing.budgets([("a", 1.0, 3)], {"a": 100}, total=250) == {"a": (250, 2, 50)}
    assert mixing.budgets([], {}) == {}


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(["kala", "moto", "ndako", "1234"], k=rng.randint(5, 60))), rng.choice(["big"] * 8 + ["small"])) for i in range(1200)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "x y", None), (None, "x y", "big"), (5003, "x y", "other")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets, "doc_id", "text", "source").collect()
    assert max(r["repeats"] for r in mixed if r["source"] == "small") <= 3 and {r["repeats"] for r in mixed if r["source"] == "big"} == {1}
    got = {s: sum(r["repeats"] * r["n_tokens"] for r in mixed if r["source"] == s) for s in ("big", "small")}
    assert abs(got["big"] / sum(got.values()) - 0.5) < 0.01 and len({r["id"] for r in mixed}) == len(mixed)
    shares = {r["source"]: r for r in mixing.mixture_shares(docs, targets, "doc_id", "text", "source").collect()}
    assert shares["absent"]["actual_share"] == 0 and shares["big"]["mixed_tokens"] == got["big"]
    again = mixing.mixture(docs.repartition(7), targets, "doc_id", "text", "source").collect()
    assert sorted(r["id"] for r in again) == sorted(r["id"] for r in mixed)
    assert mixing.mixture(docs.limit(0), targets, "doc_id", "text", "source").count() == 0


def test_weights_favour_good_documents(spark):
    rows = [(i, ("moto ndako kala " if i % 2 else "12 34 56 ") * 10, "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = mixing.mixture(docs, targets, "doc_id", "text", "source", total=12_000).groupBy((F.col("id") % 2).alias("good")).count().collect()
    by = {r["good"]: r["count"] for r in n}
    assert by[1] > 2 * by.get(0, 0)


def test_low_weights_leave_no_ties_and_no_large_ranges(spark):
    from verbatica.operators.skew import grouped_prefix_sum, unit_hash

    df = spark.range(20_000).select("id", F.lit("s").alias("source"), F.lit(3).alias("n_tokens"), (-F.log(unit_hash(F.col("id"), F.lit(11))) / 0.1).alias("at"))
    assert df.select("at").distinct().count() == 20_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    try:
        sizes = df.repartitionByRange("source", "at").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        rows = sorted((r["at"], r["upto"]) for r in grouped_prefix_sum(df, "source", ["at", "id"], "n_tokens", "upto").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes <= 0.01 * 20_000 * 1.3 and [u for _, u in rows] == [3 * (i + 1) for i in range(20_000)]


def test_a_mixture_beyond_its_repeats_misses_shares(spark):
    rows = [(i, "moto ndako kala mingi", "big" if i % 4 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 3), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mixture_shares(docs, targets, "doc_id", "text", "source", scale=2.0).collect()}
    assert shares["small"]["most_repeats"] == 2 and shares["small"]["mixed_tokens"] == 2 * shares["small"]["source_tokens"]
    assert shares["small"]["actual_share"] < 0.45 and abs(shares["big"]["mixed_tokens"] - shares["big"]["wanted_tokens"]) < 20


def test_quality_weights():
    good, same, odd = "The old man went home, and the dog followed. It rained.", "la la la la la la la la la la", "### 12 || 44 %% 9 ~~ 33"
    assert mixing.quality_weight(good) > 0.95 > mixing.quality_weight(same) > mixing.quality_weight(odd) >= 0.1
    assert mixing.quality_weight(None) == mixing.quality_weight(" ") == 0.1
    assert mixing.quality_weight("one line\n" * 50) < 0.5


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_sentences():
    assert subjects.sentences("Q. Who is it?\nA. It was me, he\nsaid. Yes indeed!") == [["who", "is", "it"], ["it", "was", "me", "he", "said"], ["yes", "indeed"]]
    assert subjects.sentences("one two\nthree four\n\nfive") == [["one", "two"], ["three", "four"]]
    assert subjects.sentences(None) == [] == subjects.sentences("♪ 12 13.")


def test_subjects(spark):
    rng = random.Random(12)
    common = ["".join(rng.choices("aeioukmnt", k=6)) for _ in range(200)]
    vocabulary = {"sport": [f"sport{c}" for c in "abcdefgh"], "law": [f"law{c}" for c in "abcdefgh"], "trade": [f"trade{c}" for c in "abcdefgh"]}
    sentence = lambda s=None: " ".join(rng.sample(common, 8) + (rng.sample(vocabulary[s], 2) if s else [])).capitalize() + "."
    docs, want, labels = [], set(), []
    for i in range(600):
        chosen = rng.choice([(), ("sport",), ("law",), ("sport", "law"), ("trade",)])
        body = [sentence(s) for s in chosen for _ in range(5)] + [sentence() for _ in range(6)]
        if rng.random() < 0.3:
            body.append(sentence("trade"))  # in passing
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        want |= {(i, s) for s in chosen}
        if i % 10 == 0:
            labels += [(i, s.upper() if i % 20 else s) for s in chosen or ("none",)]
    docs += [(9000, None), (9001, ""), (None, "x y z."), (0, docs[0][1])]
    d = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    terms = spark.createDataFrame([(s, "eng", w) for s, ws in vocabulary.items() for w in ws[:4]] + [(None, "eng", "x"), ("law", "eng", None)], "subject string, language string, term string")
    told = spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = set(pairs(subjects.subjects_of(d, terms, told, "doc_id", "text"), "doc_id", "subject"))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    without = set(pairs(subjects.subjects_of(d, terms, None, "doc_id", "text"), "doc_id", "subject"))
    assert len(without & want) >= 0.95 * len(want)
    assert subjects.subjects_of(d, terms.limit(0), told, "doc_id", "text").count() == 0
    assert subjects.subjects_of(d.limit(0), terms, told, "doc_id", "text").count() == 0


# ---- all --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p9_found", "p2_token_budget", "p8_shares"])
def test_queries_run(spark, data, name):
    from verbatica.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0


def test_oracles_agree(spark, data):
    import glob
    import os

    import duckdb

    from verbatica.llm.oracles import ORACLES
    from verbatica.llm.queries import QUERIES

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    for name, sql in ORACLES.items():
        result = con.execute(sql)
        names = [x[0] for x in result.description]
        rows = sorted(map(repr, result.fetchall()))
        assert sorted(repr(tuple(r[c] for c in names)) for r in QUERIES[name](spark, data).collect()) == rows


def counted(texts, seeds, n_subjects):
    terms = subjects.Terms(seeds, n_subjects)
    packed = pd.concat(subjects._counted(iter([pd.DataFrame({"t": texts})]), terms, 1 << 56)).sort_values("part")
    return pd.concat(subjects._summed(iter([packed]), n_subjects)), terms


def hash_of(text):
    t = subjects.Tokens()
    t.add(text)
    words, pairs, *_ = t.arrays()
    return int(words[0]) if len(words) == 1 or " " not in text else int(pairs[1])


def test_pairs_are_counted_in_every_document(monkeypatch):
    monkeypatch.setattr(subjects, "LEAST", 1)
    about, passing = "the tax rises now. the tax rises again.", "we saw the tax rises here. birds sing all day. rain falls every day. wind blows every day. snow melts every day. the sun shines. the moon shines. a dog barks."
    rows, _ = counted([about, passing, passing], {"tax": (0,)}, 1)
    by = {r.key: (r.n, r.m) for r in rows.itertuples() if r.k == 0}
    # twice in the document about it, once in each of the others
    assert by[hash_of("tax rises")] == (4, 2) == by[int(subjects.Ids()["tax"])]
    totals = {r.key: r.n for r in rows.itertuples() if r.k == -1}
    assert totals == {0: 8 + 2 * 31, 1: 8, 2: 6 + 2 * 23, 3: 6}


def test_counts_do_not_depend_on_packing(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["tax", "law", "the", "sun", "dog", "and"], k=30)) + "." for _ in range(80)]
    whole, _ = counted(texts, {"tax": (0,), "law": (1,)}, 2)
    monkeypatch.setattr(subjects, "PACKED", 50)
    small, _ = counted(texts, {"tax": (0,), "law": (1,)}, 2)
    key = ["key", "k"]
    assert whole[whole.k >= 0].sort_values(key).values.tolist() == small[small.k >= 0].sort_values(key).values.tolist()
    told = lambda r: r[r.k < 0].groupby("key")["n"].sum().to_dict()
    assert told(whole) == told(small)


def test_models_add_up_to_one():
    words, pairs = np.array([1000, 100, 200]), np.array([900, 90, 180])
    terms = subjects.Terms({"tax": (0,), "law": (1,)}, 2)
    keys = [int(subjects.Ids()[w]) for w in ("tax", "law", "court")]
    rows = pd.DataFrame({"key": keys, "n": [20, 50, 40], "k": [0, 1, 1], "m": [19, 48, 39]})
    model = subjects.Model(rows, words, pairs, terms)
    background = {keys[0]: (0, 1.5 / 900), keys[1]: (1, 2.5 / 800), keys[2]: (1, 1.5 / 800)}
    for k in (0, 1):
        kept = [(model.ratio[np.searchsorted(model.keys, np.uint64(key)), k], p) for key, (of, p) in background.items() if of == k]
        inside = sum(r * p for r, p in kept)
        assert abs(inside + model.rest[k] * (1 - sum(p for _, p in kept)) - 1) < 1e-5
    model.fit_weights(np.array([keys[0]] * 5, np.uint64), np.zeros(5, np.uint64), np.zeros(5, np.int64))
    assert abs(sum(model.weights) - 1) < 1e-9 and model.weights[2] < 0.1
    assert model.gains(np.array([keys[0], 2], np.uint64), np.zeros(2, np.uint64), np.array([0, 0]), 1).argmax() == 0
