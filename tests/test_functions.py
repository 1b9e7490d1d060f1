import itertools
import random

import pytest
from pyspark.sql import functions as F

from verbatica.functions import editdist, sequence, shape, text, wave
from verbatica.operators import learn


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expression(F.col("t"))).collect()]


def test_whitespace_of_every_kind(spark):
    assert apply(spark, ["a \tb", "  a\x1cb\x85c ", "", "a\n\nb"], text.collapse_space) == ["a b", "a b c", "", "a b"]


def test_policies(spark):
    raw = ["<|en|> Hello, [Music] World♪!", None, "Don't STOP", "[unk] x"]
    assert apply(spark, raw, lambda c: text.normalize(c, "language_safe")) == ["hello world", "", "don t stop", "x"]
    assert apply(spark, raw, lambda c: text.normalize(c, "raw"))[2] == "Don't STOP"
    assert apply(spark, ["é"], lambda c: text.normalize(c, "raw", compose=True)) == ["é"]
    with pytest.raises(ValueError):
        text.normalize(F.lit("a"), "nonsense")


def test_sanitize_and_dots(spark):
    assert apply(spark, ["a�b", "", None, "\x07", "x ..."], text.sanitize) == ["ab", ".", ".", ".", "x ..."]
    assert apply(spark, ["x . . . .", "...", "x..", None], text.collapse_trailing_dots) == ["x", ".", "x..", "."]
    assert apply(spark, ["x ....", "x.."], lambda c: text.collapse_trailing_dots(c, keep=True)) == ["x.", "x.."]


def test_sentence_case(spark):
    assert apply(spark, ['hello. world? "yes" ok', "été. a", "1. b", "a.' c"], text.sentence_case) == ['Hello. World? "yes" ok', "Été. A", "1. B", "A.' C"]


def test_tokens_keys_and_names(spark):
    assert apply(spark, ["a  b", "", None, " "], text.tokens) == [["a", "b"], [], [], []]
    assert apply(spark, ["“Hi!”", "--", "a-b."], text.token_key) == ["hi", "", "a-b"]
    assert apply(spark, ["a b/c", "__x__"], text.file_safe) == ["a_b_c", "x"]


def stitched(left, right, most=25, least=2):
    for n in range(min(most, len(left), len(right)), least - 1, -1):
        if left[-n:] == right[:n]:
            return left + right[n:]
    return left + right


def test_stitch_against_a_loop(spark):
    rng = random.Random(3)
    pairs = [(rng.choices("abc", k=rng.randint(0, 6)), rng.choices("abc", k=rng.randint(0, 6))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in df.orderBy("i").select(text.stitch(F.col("a"), F.col("b"))).collect()]
    assert got == [stitched(a, b) for a, b in pairs]


def test_window_plan(spark):
    got = apply(spark, [3.0, 4.0, 10.0], lambda c: text.window_plan(c, 4.0, 1.0), "double")
    assert [[(w["start"], w["end"]) for w in x] for x in got] == [[(0, 3)], [(0, 4)], [(0, 4), (3, 7), (6, 10)]]


def test_safe_values(spark):
    assert apply(spark, ["1.5", "", "x", "nan", "inf", None], text.safe_double) == [1.5, 0, 0, 0, 0, 0]
    assert apply(spark, ["Yes", "0", None, " TRUE "], text.safe_bool) == [True, False, False, True]
    assert apply(spark, ["a;;b; c", "", None], text.flag_set) == [["a", "b", "c"], [], []]


def runs(items):
    return max((len(list(g)) for _, g in itertools.groupby(items)), default=0)


def test_runs_and_ngrams_against_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["aa", "b", "AA", "c"], k=rng.randint(0, 12))) for _ in range(60)] + ["", "a" * 12, "aa aaa"]
    words = [t.split() for t in texts]
    assert apply(spark, texts, shape.token_run) == [runs([w.lower() for w in ws]) for ws in words]
    assert apply(spark, texts, shape.char_run) == [max((runs(w) for w in ws), default=0) for ws in words]
    assert apply(spark, texts, lambda c: shape.repeats_at_once(text.tokens(c))) == [any(ws[i : i + 3] == ws[i + 3 : i + 6] for i in range(len(ws) - 5)) for ws in words]
    grams = [[" ".join(w.lower() for w in ws[i : i + 2]) for i in range(len(ws) - 1)] for ws in words]
    assert apply(spark, texts, lambda c: shape.ngram_top(shape.said_words(c), 2)) == [max(map(g.count, g), default=0) for g in grams]


def test_health_at_the_limits(spark):
    got = apply(spark, ["", "...", "abcd", "ab cde", "a a a b", None, "xx aaaaaaaaaaaa", "?!"], shape.health_reasons)
    assert got[0][:2] == ["empty", "length_le_threshold"] and "dot_only" in got[1] and "length_le_threshold" in got[2]
    assert got[3] == [] and got[4] == ["repeated_token_collapse"] and got[5][0] == "empty" and got[6] == ["ctc_char_collapse"] and "punctuation_only" in got[7]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance_against_a_table(spark):
    rng = random.Random(7)
    pairs = [(rng.choices(["a", "b", "é", "dd"], k=rng.randint(0, 8)), rng.choices(["a", "b", "é", "e"], k=rng.randint(0, 8))) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in df.orderBy("i").select(editdist.word_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [distance(a, b) for a, b in pairs]


def test_safe_rate(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (1, 4)], "e int, n int")
    assert [r[0] for r in df.select(editdist.safe_rate(F.col("e"), F.col("n"))).collect()] == [0.0, 1.0, 0.25]


def test_wave_edges(spark):
    waves = [[], [0.0] * 6, [1.0] * 6, [0.0, 0.0, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0], [0.5]]
    df = column(spark, waves, "array<double>").withColumn("sr", F.lit(1000))
    a, sr = F.col("t"), F.col("sr")
    s = wave.extended_stats(a, sr, 2.0, 0.1)
    t = wave.trim_edges(a, sr, 20.0, 1.0, 2.0)
    rows = df.orderBy("i").select(s["silence_ratio"].alias("sil"), s["clipping_ratio"].alias("clip"), s["leading_silence"].alias("lead"), t["trimmed"].alias("cut"), t["status"].alias("st"), wave.usable(a, sr, 0.002).alias("u"), wave.hop_silence(a, sr, 2.0, 1.0).alias("h")).collect()
    assert [r["sil"] for r in rows] == [1, 1, 0, 0.75, 0] and [r["clip"] for r in rows] == [0, 0, 1, 0, 0]
    assert [r["st"] for r in rows] == ["likely_empty_audio", "likely_empty_audio", "unchanged", "cleaned_ok", "unchanged"]
    assert rows[3]["cut"] == [0.0, 0.9, 0.0, 0.0] and abs(rows[3]["lead"] - 0.004) < 1e-9
    assert [r["u"] for r in rows] == ["empty", "silent", "ok", "ok", "too_short"] and rows[0]["h"] == 1.0


def test_mono(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [3.0, 2.0, 1.0]],), ([[1.0, 3.0], [2.0, 4.0], [0.0, 0.0]],)], "c array<array<double>>")
    assert [r[0] for r in df.select(wave.mono(F.col("c"))).collect()] == [[2.0, 2.0, 2.0], [2.0, 3.0, 0.0]]


def voted(spark, *hypotheses):
    rows = [("u", i, t, w) for i, (t, w) in enumerate(hypotheses)]
    out = learn.rover_texts(spark.createDataFrame(rows, "id string, idx int, text string, w double").drop("w"), {i: w for i, (_, w) in enumerate(hypotheses)}).collect()
    return [r["text"] for r in out]


def test_vote(spark):
    assert voted(spark, ("the cat sat", 1.0), ("the bat sat", 1.0), ("the bat sat", 1.0)) == ["the bat sat"]
    assert voted(spark, ("the cat sat", 1.0), ("the bat sat", 1.0)) == ["the cat sat"]
    assert voted(spark, ("the big cat", 1.0), ("the cat", 1.0), ("the cat", 0.5)) == ["the cat"]
    assert voted(spark, ("The cat, sat!", 1.0), ("the CAT sat", 3.0)) == ["The cat, sat!"]
    assert voted(spark, ("a b", 1.0), ("a x b", 5.0)) == ["a b"]  # nothing is inserted
    assert voted(spark, ("- cat", 1.0), ("cat", 9.0)) == ["- cat"]  # a word without letters is no ballot
    assert voted(spark, ("", 1.0), ("x", 1.0)) == [""] and voted(spark, (None, 1.0), ("x", 1.0)) == [""]
    assert voted(spark, ("a b", 1.0), ("c", 2.0), ("c", 2.0)) == ["a b"]  # two words against one: open


def test_phrases():
    rules = lambda *r: sequence.Phrases(list(r)).apply
    assert rules(("goat dog", "goat-dog"))("Goat dog, goat") == "Goat-dog, goat"
    assert rules(("a b", ""))("a b") == "" and rules(("a", "b"))("") == ""
    assert rules(("a", "x"), ("a b", "y"))("a b a ,A b!? (a b).") == "y x ,Y!? (a b)."
    assert rules(("a", "b"), ("b", "c"))("a b") == "b c"
    assert rules(("the", "le grand"))('"The end') == '"The end' and rules(("the", "le grand"))("The end") == "Le grand end"
    assert rules(("a b c", "x"))("a b a b c") == "a b x" and rules()("a  b") == "a b"


def test_stretches_and_block_errors():
    assert sequence.block_errors("a b c".split(), "a x c d".split()) == 2 and sequence.block_errors("", "abc") == 3 and sequence.block_errors("ab", "ab") == 0
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        parts = list(sequence.stretches(a, b))
        assert "".join(a[x] for x, _, _ in parts) == a and "".join(b[y] for _, y, _ in parts) == b
        assert all((a[x] == b[y]) == same for x, y, same in parts)
        assert distance(a, b) <= sequence.block_errors(a, b) <= max(len(a), len(b)) + min(len(a), len(b))
    assert sequence.exchanged("I saw the dog. today", "i saw a dok today") == [{"said": "a dok", "meant": "the dog"}]
    assert sequence.exchanged("a b c x", "d e f x") == [] and sequence.exchanged(None, "x") == []
    assert sequence.placed("a b c", "a x y c") == ["a", None, "c"] and sequence.placed("a b c", "a c") == ["a", "", "c"]


def test_mined_rules(spark):
    rows = [(f"u{i:02d}", "lin", "nzela ya monene", "njela ya monene") for i in range(12)] + [(f"v{i}", "lin", "moto te", "moto ta") for i in range(2)]
    df = spark.createDataFrame(rows, "id string, language string, ref string, hyp string")
    rules = learn.mine_rules(df, least=3)
    assert [(r["said"], r["meant"], r["n"], r["n_reverse"]) for r in rules.collect()] == [("njela", "nzela", 6, 0)]
    report = learn.rule_report(df, learn.collect_rules(rules)).first()
    assert (report["words_before"], report["words_after"], report["kept"]) == (7, 1, True)


def test_distance_of_very_many_words(spark):
    a = [f"w{i}" for i in range(36_000)]
    b = a[:10] + ["x"] + a[11:35_990] + ["y", "z"] + a[35_990:]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(editdist.word_distance(F.slice("a", 35_000, 1001), F.slice("b", 35_000, 1003))).first()[0] == 2
    assert df.select(editdist.word_distance(F.slice("a", 1, 1000), F.slice("b", 1, 1000))).first()[0] == 1


def test_folds_partition(spark):
    got = apply(spark, [f"id{i}" for i in range(50)], lambda c: text.stable_fold(c, 4))
    assert set(got) == {0, 1, 2, 3}
