from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatica.functions.sequence import phrase_rules
from verbatica.functions.text import normalize
from verbatica.operators import audit, learn, lid, manifest, relational, route, scoring, select, skew, tune
from verbatica.plans import QUERIES


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_attach_by_key_with_hot_keys(spark):
    facts_of = {k: (2000 if k == "hot" else 3) for k in ["hot", "a", "b"]}
    left = spark.range(2000).select(F.lit("hot").alias("k"), "id").unionByName(spark.createDataFrame([(k, i) for k in "abz" for i in range(3)], "k string, id bigint"))
    facts = spark.createDataFrame(list(facts_of.items()), "k string, n bigint")
    out = skew.attach_by_key(left, facts, "k", "n", 2009)
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == facts_of


def test_prefix_sum_is_a_running_total(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.lit(2).alias("w")).withColumn("at", skew.unit_hash(F.col("id")))
    got = skew.grouped_prefix_sum(df, "g", "at", "w", "upto", buckets=8).collect()
    for g in range(3):
        mine = sorted((r["at"], r["upto"]) for r in got if r["g"] == g)
        assert [u for _, u in mine] == [2 * (i + 1) for i in range(len(mine))]


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), (None, 1, "n")], "k string, o int, v string")
    assert sorted((r["k"] or "", r["v"] or "") for r in relational.last_wins(df, ["k"], "o").collect()) == [("", "n"), ("a", "")]
    assert sorted((r["k"] or "", r["v"] or "") for r in relational.first_wins(df, ["k"], "o").collect()) == [("", "n"), ("a", "x")]


def test_shards_cover_everything_once(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    parts = [relational.contiguous_shard(df, 5, i, "k") for i in range(5)]
    assert [p.count() for p in parts] == [5, 5, 5, 4, 4]
    assert sorted(r["k"] for p in parts for r in p.collect()) == list(range(23))


def test_coverage_and_unions(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert rows(relational.coverage(a, b, "id"), "side", "n") == [("extra", 1), ("missing", 1)]
    with pytest.raises(ValueError):
        relational.assert_coverage(a, b, "id")
    relational.assert_coverage(a, a, "id")
    with pytest.raises(ValueError):
        relational.disjoint_union([a, b], "id")
    assert relational.disjoint_union([a, b.filter("id = 'z'")], "id").count() == 3


def test_balance_makes_equal_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "g string, o int")
    assert rows(relational.balanced(df, "g", "o").groupBy("g").count(), "g", "count") == [("a", 7), ("b", 7)]


def test_nearest_rank_and_lengths(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "v int")
    assert audit.nearest_ranks(df, F.col("v"), {"q": 0.95}).first()["q"] == 4
    t = spark.createDataFrame([("a",), ("bb cc",), (None,)], "t string").fillna("")
    r = audit.length_stats(t, "t").first()
    assert (r["min_chars"], r["median_chars"], r["max_chars"], r["max_words"]) == (0, 1.0, 5, 2)


def test_scoring_identities(spark):
    refs = spark.createDataFrame([("a", "lin", "x y z"), ("b", "lin", ""), ("c", "sna", "q")], "id string, language string, ref string")
    hyps = spark.createDataFrame([("a", "x y"), ("b", "w"), ("c", "Q.")], "id string, hyp string")
    pairs = scoring.pair_scores(refs, hyps)
    report = {r["language"]: r for r in scoring.score_report(pairs).collect()}
    assert report["sna"]["wer"] == 0 and report["lin"]["word_errors"] == 2 and report["overall"]["word_count"] == 4
    assert abs(report["macro"]["wer"] - report["lin"]["wer"] / 2) < 1e-9
    one = {r["language"]: r["wer"] for r in scoring.score_report(pairs.filter("language = 'lin'")).collect()}
    assert one["macro"] == one["overall"] == one["lin"]


def test_mbr_properties(spark):
    c = spark.createDataFrame([("a", 0, "x y", "x y"), ("b", 0, "p q", "p q"), ("b", 1, "p r", "p r"), ("b", 2, "p r", "p r"), ("b", 3, "p s", "p s"), ("t", 0, "m", "m"), ("t", 1, "n", "n")], "id string, idx int, text string, norm string")
    got = {r["id"]: r for r in select.mbr_medoid(c).collect()}
    assert got["a"]["text"] == "x y" and got["a"]["risk"] == 0 and got["t"]["idx"] == 0 and got["b"]["n"] == 3
    samples = c.filter("idx > 0").withColumn("score", F.lit(0.0))
    w = {r["id"]: r for r in select.weighted_mbr(samples, c.filter("idx = 0").select("id", "text", "norm"), 1.0, None, 0.0).collect()}
    assert w["a"]["text"] == "x y" and not w["a"]["switched"] and w["b"]["text"] == "p r" and w["b"]["switched"]


def test_routes(spark):
    p = spark.createDataFrame([("a", "x y z w x y z w x y z w x y z w"), ("b", "fine text")], "id string, text string")
    f = spark.createDataFrame([("a", "x y z w")], "id string, text string")
    assert rows(route.loop_repair(p, f), "id", "switched") == [("a", True), ("b", False)]
    c = spark.createDataFrame([("a", 0, "..", -1.0), ("a", 1, "good text", None), ("b", 0, "good text", -1.0), ("b", 1, "better text", -0.5), ("c", 0, "good", -1.0), ("c", 1, "text", -0.9)], "id string, idx int, text string, score double")
    assert rows(route.rules_router(c, 0.2), "id", "idx") == [("a", 1), ("b", 1), ("c", 0)]


def test_markers_and_fusion(spark):
    df = spark.createDataFrame([("bakhasi abandu khu", 1), ("tye dok woko", 2), ("hello", 3), (None, 4)], "t string, i int")
    assert [r["language"] for r in lid.by_markers(df, "t").orderBy("i").collect()] == ["myx", "ach", "unk", "unk"]
    one = spark.createDataFrame([(0.7, 0.3, 0.2, 0.8)], "a double, b double, c double, d double")
    fused = lid.fuse({"x": F.col("a"), "y": F.col("b")}, {"x": F.col("c"), "y": F.col("d")}, 1.0)
    r = one.select(fused["x"].alias("x"), fused["y"].alias("y")).first()
    assert abs(r["x"] - 0.7) < 1e-9 and abs(r["x"] + r["y"] - 1) < 1e-9


def test_threshold_ties(spark):
    s = spark.createDataFrame([("a", 0.5, False, 0.0), ("b", 0.1, False, 0.0)], "id string, margin double, forced boolean, delta double")
    r = tune.choose_threshold(tune.threshold_gains(s, [0.0, 0.2, 0.6, 0.9])).first()
    assert r["threshold"] == 0.9 and r["switches"] == 0
    folded = tune.out_of_fold(s, [0.0, 0.9], 2)
    assert folded.count() == 2


def test_bucket_partition_is_total(spark):
    df = spark.createDataFrame(
        [("", [], 2.0, 0.0, 0.0, 5.0, 1.0), ("t", None, None, None, None, None, None), ("t", ["too_long"], 40.0, 0.0, 0.0, 5.0, 1.0), ("t", ["clipped"], 2.0, 0.0, 0.0, 5.0, 1.0), ("t", [], 2.0, 0.05, 0.0, 5.0, 1.0), ("t", [], 2.0, 0.0, 0.0, 5.0, 1.0)],
        "text string, flags array<string>, duration double, clipping double, silence double, cps double, wps double",
    ).withColumns({"n_teachers": F.lit(0), "teacher_max": F.lit(0.0), "teacher_mean": F.lit(0.0)})
    got = [(r["bucket"], r["reasons"]) for r in manifest.quality_buckets(df).collect()]
    assert [b for b, _ in got] == ["excluded", "excluded", "noisy", "medium", "excluded", "clean"]
    assert got[0][1] == ["empty_transcript"] and got[1][1] == ["missing_audio_quality"] and got[4][1] == ["severe_clipping"]


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("lin", "a b c d e f", 1), ("lin", "A  b c d e f", 2), ("sna", "a b c d e f", 3)], "language string, t string, o int")
    once = manifest.assemble_corpus([("s", df, 1, None)], "t", "language", "o", 3, lambda c: normalize(c, "no_punct_lower"))
    again = manifest.assemble_corpus([("s", once.withColumn("o", F.lit(1)), 1, None)], "text", "language", "o", 3, lambda c: normalize(c, "no_punct_lower"))
    assert rows(once, "language", "text") == rows(again, "language", "text") == [("lin", "a b c d e f"), ("sna", "a b c d e f")]


def test_rules_are_mined_and_judged(spark):
    pairs = spark.createDataFrame([(f"i{k:03}", "eng", "the goat-dog ran", "the goad ran") for k in range(20)], "id string, language string, ref string, hyp string")
    rules = learn.mine_rules(pairs)
    assert rows(rules, "said", "meant", "n") == [("goad", "goat-dog", 10)]
    report = learn.rule_report(pairs, learn.collect_rules(rules)).first()
    assert report["kept"] and report["words_after"] == 0


def test_any_number_of_rules_is_judged(spark, tmp_path):
    refs, hyps = [], []
    for k in range(420):  # 98 rules in every mined row, which the row after it needs
        words = [(f"k{i}", f"m{k // 2}z{i}", f"s{k // 2}z{i}") for i in range(98)]
        refs.append((f"lin_{k:04}", "lin", " ".join(f"{a} {m}" for a, m, _ in words)))
        hyps.append((k, f"lin_{k:04}", "ctc_small", " ".join(f"{a} {s}" for a, _, s in words)))
    spark.createDataFrame(refs, "id string, language string, target string").write.parquet(f"{tmp_path}/zoo_references.parquet")
    spark.createDataFrame(hyps, "row_no bigint, id string, model_name string, target string").write.parquet(f"{tmp_path}/zoo_predictions.parquet")
    assert QUERIES["h19_rules"](spark, str(tmp_path)).count() == 210 * 98 > learn.MOST_RULES
    report = QUERIES["h19_rule_report"](spark, str(tmp_path)).first()
    assert (report["words_before"], report["words_after"], report["chars_after"], report["n_words"], report["kept"]) == (210 * 98, 0, 0, 210 * 196, True)


def test_rules_in_a_table_do_what_collected_rules_do(spark):
    rules = spark.createDataFrame(
        [("eng", "a b", "x", 2), ("eng", "A  b", "y", 1), ("eng", "b", "", 9), ("eng", "b", "q", 9), ("eng", "a c", "z", 1), ("eng", "a c", "w", 3), (" ", "d", "e", 1), (None, "b", "n", 1)], "language string, said string, meant string, n bigint"
    )
    texts = ["A b, c", "a  c.  b?", "b b", "", "  ", None, "a . b", "a a b a c", "no  rule", "d  D"]
    given = spark.createDataFrame([(t, lang) for t in texts for lang in ("eng", "lin", " ", "", None)] * 2, "hyp string, language string")
    want = given.withColumn("new", phrase_rules(learn.collect_rules(rules))("hyp", "language"))
    got = learn.exchanged_phrases(given, rules, "hyp", "new")
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())
    assert Counter(learn.exchanged_phrases(given, rules.limit(0), "hyp", "new").select("hyp", "new").collect()) == Counter((t, t) for t in texts for _ in range(10))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, language string, ref string")
    hyps = spark.createDataFrame([], "id string, hyp string")
    assert scoring.score_report(scoring.pair_scores(none, hyps)).filter("language NOT IN ('overall')").count() == 0
    assert relational.balanced(none, "language", "id").count() == 0


def test_linear_quantiles_against_numpy(spark):
    import numpy as np

    from verbatica.operators import audit

    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 30)) for v in rng.choice([rng.normal(), 1.5, -2.0, 7.25], n)] + [("d", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in audit.linear_quantiles(df, df["v"], {"lo": 0.25, "hi": 0.9}, "g").collect()}
    for g in ("a", "b", "c", None):
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(values, [0.25, 0.9]))
    assert got["d"] == (None, None) and len(got) == 5
    one = audit.linear_quantiles(df, df["v"], {"m": 0.5}).first()["m"]
    assert np.isclose(one, np.median([v for _, v in rows if v is not None]))
    assert audit.linear_quantiles(df.limit(0), df["v"], {"m": 0.5}, "g").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from verbatica import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077", setCheckpointDir=lambda p: None)
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_even_slots(spark):
    for n in (1, 7, 64):
        slots = skew.even_slots(spark, n)
        df = spark.createDataFrame([(s,) for s in slots], "s bigint").repartition(n, "s").withColumn("p", F.spark_partition_id())
        assert df.select("p").distinct().count() == n == len(set(slots))


def test_caps_can_be_made_to_fail(spark):
    import pytest

    df = spark.createDataFrame([("lin", "a", i) for i in range(5)] + [("sna", s, i) for i, s in enumerate("abcd")], "l string, s string, o int")
    assert relational.speaker_capped(df, "l", "s", 3, 3, "o", full=True).count() == 6
    with pytest.raises(ValueError):
        relational.speaker_capped(df, "l", "s", 3, 4, "o", full=True)


def test_text_language_is_learned(spark):
    from verbatica.operators import lid

    rows = [(i, "lin", f"nakoki kozonga na ndako {i}") for i in range(40)] + [(100 + i, "eng", f"the house near the river number {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, language string, t string")
    model = lid.train_text_lid(df.filter("i % 4 > 0"), "t", "language", features=1 << 12)
    told = lid.apply_text_lid(model, df.filter("i % 4 = 0"), "t").collect()
    assert all(r["predicted"] == r["language"] and r["confidence"] > 0.5 for r in told) and len(told) == 15
