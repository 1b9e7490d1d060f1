"""Queries on language identification and on tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import id_language, stable_fold
from ..operators import audit, lid, route, scoring, select, tune
from ..session import cut, table
from .basic import lm, mix
from .registry import query
from .routes import _LM, ORDER
from .scores import anchors, of, pairs, samples, weighted_sql
from .views import ANCHOR, PAIRS_SQL, SQL, hyps, refs

_LANGS = ["eng", "lin", "lug", "sna"]


def _hash(view: str, lang: str):
    return F.conv(F.substring(F.sha1(F.concat("id", F.lit(view + lang)).cast("binary")), 1, 4), 16, 10).cast("double")


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """(id, truth, a_<lang>, b_<lang>): two views' probabilities drawn from hashes, the true language favoured."""
    rows = table(spark, d, "zoo_predictions").select("id").distinct().withColumn("truth", F.substring_index("id", "_", 1)).filter(F.col("truth").isin(_LANGS))
    out = rows
    for view, favour in (("a", 30000.0), ("b", 20000.0)):
        raw = {k: _hash(view, k) + F.when(F.col("truth") == k, favour).otherwise(1.0) for k in _LANGS}
        total = sum(raw.values(), F.lit(0.0))
        out = out.withColumns({f"{view}_{k}": v / total for k, v in raw.items()})
    return out


def _view_sql() -> str:
    h = lambda v, k: f"('0x' || substr(sha1(id || '{v}{k}'), 1, 4))::INT::DOUBLE + CASE WHEN truth = '{k}' THEN {30000.0 if v == 'a' else 20000.0} ELSE 1.0 END"
    total = {v: "(" + " + ".join(h(v, k) for k in _LANGS) + ")" for v in "ab"}
    columns = ", ".join(f"({h(v, k)}) / {total[v]} AS {v}_{k}" for v in "ab" for k in _LANGS)
    return f"WITH r AS (SELECT DISTINCT id, split_part(id, '_', 1) AS truth FROM zoo_predictions WHERE split_part(id, '_', 1) IN ('eng', 'lin', 'lug', 'sna')), v AS (SELECT id, truth, {columns} FROM r)"


_VIEW = _view_sql()
_RANKED = lambda cols: "list_sort([" + ", ".join(f"{{'p': -({c}), 'k': '{k}'}}" for k, c in cols.items()) + "])"
_A = {k: f"a_{k}" for k in _LANGS}


def _fused_sql(w: str) -> dict[str, str]:
    raw = {k: f"exp({w} * ln(greatest(a_{k}, 1e-9)) + (1 - {w}) * ln(greatest(b_{k}, 1e-9)))" for k in _LANGS}
    return {k: f"{v} / ({' + '.join(raw.values())})" for k, v in raw.items()}


def _marker_sql() -> str:
    score = {}
    for k, listed in lid.MARKERS.items():
        s = f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in listed)})))::DOUBLE"
        for where, weight, what in lid.SPELLINGS:
            if where == k:
                s += f" + {weight} * ((length(low) - length(replace(low, '{what}', ''))) / {len(what)})"
        for where, weight, what, longer in lid.PREFIXES:
            if where == k:
                s += f" + {weight} * len(list_filter(w, lambda x: starts_with(x, '{what}') AND length(x) > {longer}))"
        score[k] = s
    return ", ".join(f"{s} AS s_{k}" for k, s in score.items())


@query(
    "i1_markers",
    f"WITH t AS (SELECT row_no, lower(coalesce(transcription, '')) AS low, list_filter(string_split_regex(lower(coalesce(transcription, '')), '[^a-z'']+'), lambda x: x <> '') AS w FROM lm_text), s AS (SELECT row_no, len(w) AS n, {_marker_sql()} FROM t), "
    "b AS (SELECT *, s_ach + s_nyn + s_xog + s_myx AS total, list_max([{'s': round(s_ach, 9), 'o': 0, 'k': 'ach'}, {'s': round(s_nyn, 9), 'o': -1, 'k': 'nyn'}, {'s': round(s_xog, 9), 'o': -2, 'k': 'xog'}, {'s': round(s_myx, 9), 'o': -3, 'k': 'myx'}]) AS best FROM s) "
    "SELECT row_no, CASE WHEN total = 0 OR best.s < 2 OR (best.s / total < 0.45 AND best.s / greatest(n, 1) < 0.08) THEN 'unk' ELSE best.k END AS language, CASE WHEN total > 0 THEN round(best.s / total, 9) ELSE 0 END AS confidence FROM b",
)
def i1(spark, d):
    return lid.by_markers(lm(spark, d).select("row_no", "transcription"), "transcription").select("row_no", "language", "confidence")


@query("i2_text_lid")
def i2(spark, d):
    rows = mix(spark, d).filter("language IS NOT NULL AND trim(transcription) <> ''").select("row_no", "language", "transcription", stable_fold(F.col("id"), 5).alias("fold"))
    model = lid.train_text_lid(rows.filter("fold > 0"), "transcription", "language")
    guessed = lid.apply_text_lid(model, rows.filter("fold = 0").withColumnRenamed("language", "truth"), "transcription")
    return audit.confusion(guessed, "truth", "predicted")


@query("i2_held_out", f"SELECT language AS truth, count(*) AS n FROM generalization_mix WHERE language IS NOT NULL AND trim(transcription) <> '' AND ('0x' || substr(sha1(id), 1, 8))::BIGINT % 5 = 0 GROUP BY ALL HAVING count(*) > 0")
def i2_held_out(spark, d):
    """Every held-out row is told some language: the row sums of the confusion."""
    return i2(spark, d).groupBy("truth").agg(F.sum("n").alias("n"))


@query("i3_top_two", f"{_VIEW}, s AS (SELECT id, {_RANKED(_A)} AS r FROM v) SELECT id, CASE WHEN -r[1].p < 0.35 THEN 'unk' ELSE r[1].k END AS language, round(-r[1].p, 9) AS confidence, round(-r[1].p + r[2].p, 9) AS margin FROM s")
def i3(spark, d):
    out = lid.top_two({k: F.col(f"a_{k}") for k in _LANGS}, 0.35)
    return probabilities(spark, d).select("id", out["language"].alias("language"), F.round(out["confidence"], 9).alias("confidence"), F.round(out["margin"], 9).alias("margin"))


@query("i4_fusion", f"{_VIEW} SELECT id, " + ", ".join(f"round({v}, 9) AS p_{k}" for k, v in _fused_sql("0.6").items()) + " FROM v")
def i4(spark, d):
    fused = lid.fuse({k: F.col(f"a_{k}") for k in _LANGS}, {k: F.col(f"b_{k}") for k in _LANGS}, 0.6)
    return probabilities(spark, d).select("id", *[F.round(v, 9).alias(f"p_{k}") for k, v in fused.items()])


_GRID = f"{_VIEW}, g AS (SELECT *, unnest(range(0, 101)) / 100.0::DOUBLE AS weight FROM v), f AS (SELECT weight, truth, ({_RANKED(_fused_sql('weight'))})[1].k = truth AS r FROM g), a AS (SELECT weight, truth, count(*) FILTER (r) / count(*) AS acc FROM f GROUP BY ALL), m AS (SELECT weight, round(avg(acc), 9) AS macro_accuracy FROM a GROUP BY weight)"


@query("i5_weight_grid", f"{_GRID} SELECT weight, macro_accuracy FROM m")
def i5(spark, d):
    return lid.fusion_grid(probabilities(spark, d), {k: f"a_{k}" for k in _LANGS}, {k: f"b_{k}" for k in _LANGS}, "truth")


@query("i5_best_weight", f"{_GRID} SELECT weight, macro_accuracy FROM m ORDER BY macro_accuracy DESC, round(abs(weight - 0.5), 9), weight LIMIT 1")
def i5b(spark, d):
    return lid.best_weight(i5(spark, d))


_ALL_LM = (
    _LM.replace("w AS (SELECT id, system, split_part(id, '_', 1) AS language,", "w AS (SELECT id, system, v.language,").replace("AS p FROM hyps)", "AS p FROM hyps, v WHERE system = 'seq_mixed')")
)


def _all_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every text of a system under the model of every language."""
    model = route.train_char_lm(refs(spark, d), "ref", "language", ORDER)
    model = (cut(model[0]), model[1])
    languages = sorted(r["language"] for r in model[1].select("language").collect() if r["language"])
    h = hyps(spark, d).filter("system = 'seq_mixed'").withColumn("language", F.explode(F.array(*[F.lit(x) for x in languages])))
    return route.score_char_lm(h, "hyp", "language", "id", model, ORDER, 0.1)


@query("i6_lm_language", f"{_ALL_LM}, q AS (SELECT id, language, round(lm_score, 9) AS s FROM lm) SELECT id, arg_max(language, (s, language)) AS language FROM q GROUP BY id")
def i6(spark, d):
    return lid.by_likelihood(_all_scores(spark, d).withColumn("lm_score", F.round("lm_score", 9))).select("id", "language")


@query("i7_likelihood_margin", f"{_ALL_LM}, q AS (SELECT id, language, round(lm_score, 9) AS s FROM lm), r AS (SELECT id, list_reverse_sort(list(s)) AS l, arg_max(language, (s, language)) AS language FROM q GROUP BY id) SELECT id, language, round(l[1] - coalesce(l[2], l[1]), 9) AS margin FROM r")
def i7(spark, d):
    return lid.by_likelihood(_all_scores(spark, d).withColumn("lm_score", F.round("lm_score", 9)))


@query("i8_vector_lid")
def i8(spark, d):
    rows = table(spark, d, "embeddings").filter("label IS NOT NULL").withColumn("fold", stable_fold(F.col("vec_id").cast("string"), 5))
    model = lid.train_vector_lid(rows.filter("fold > 0"), "embedding", "label")
    return audit.confusion(lid.apply_vector_lid(model, rows.filter("fold = 0"), "embedding"), "label", "predicted")


@query("d21_confusion", f"{_VIEW}, s AS (SELECT truth, ({_RANKED(_A)})[1].k AS guess FROM v) SELECT truth, guess, count(*) AS n FROM s GROUP BY ALL")
def d21(spark, d):
    out = lid.top_two({k: F.col(f"a_{k}") for k in _LANGS})
    return audit.confusion(probabilities(spark, d).withColumn("guess", out["language"]), "truth", "guess")


@query("d21_gates", f"{_VIEW}, s AS (SELECT truth, ({_RANKED(_A)})[1] AS r FROM v), g AS (SELECT unnest([0.0, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS gate) SELECT gate, count(*) AS n_kept, count(*) FILTER (r.k = truth) AS n_right FROM s, g WHERE -r.p >= gate GROUP BY gate")
def d21g(spark, d):
    out = lid.top_two({k: F.col(f"a_{k}") for k in _LANGS})
    scored = probabilities(spark, d).withColumns({"guess": out["language"], "confidence": out["confidence"]})
    return audit.confidence_gates(scored, "truth", "guess", "confidence", (0.0, 0.3, 0.4, 0.5, 0.6))


# ---- tuning -----------------------------------------------------------------------------------------------------

_THRESHOLDS = [0.0, 0.1, 0.2, 0.35, 0.5]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """(id, language, margin, forced, delta): what switching from one system to another gains, and a margin from a hash."""
    p = cut(pairs(spark, d).select("id", "language", "system", "word_errors", "word_count", "char_errors", "char_count"))
    gains = scoring.exact_gains(of(p, "ctc_wide"), of(p, ANCHOR))
    margin = F.conv(F.substring(F.sha1(F.concat("id", F.lit("m")).cast("binary")), 1, 4), 16, 10).cast("int") / 65536.0 - F.when(F.col("gain") < 0, 0.3).otherwise(0.0)
    return gains.withColumn("gain", F.round("gain", 12)).select("id", id_language(F.col("id")).alias("language"), margin.alias("margin"), F.lit(False).alias("forced"), F.col("gain").alias("delta"))


_SAMP = f"""{PAIRS_SQL}, tot AS (SELECT sum(wn) AS w, sum(cn) AS c FROM pairs WHERE system = 'ctc_wide'), gn AS (SELECT a.id, split_part(a.id, '_', 1) AS language, round(0.5 * (a.we - b.we) / w + 0.5 * (a.ce - b.ce) / c, 12) AS delta FROM pairs a JOIN pairs b ON a.id = b.id, tot WHERE a.system = 'ctc_wide' AND b.system = 'seq_large'),
sm AS (SELECT *, ('0x' || substr(sha1(id || 'm'), 1, 4))::INT / 65536.0::DOUBLE - CASE WHEN delta < 0 THEN 0.3 ELSE 0 END AS margin, ('0x' || substr(sha1(id), 1, 8))::BIGINT % 4 AS fold FROM gn), th AS (SELECT unnest({_THRESHOLDS}::DOUBLE[]) AS threshold)"""


@query("l1_folds", "SELECT DISTINCT id, ('0x' || substr(sha1(id), 1, 8))::BIGINT % 10 AS fold FROM zoo_predictions WHERE id IS NOT NULL")
def l1(spark, d):
    return table(spark, d, "zoo_predictions").filter("id IS NOT NULL").select("id", stable_fold(F.col("id"), 10).alias("fold")).distinct()


@query("l2_threshold", f"{_SAMP}, g AS (SELECT threshold, round(sum(CASE WHEN margin > threshold THEN delta ELSE 0 END), 12) AS gain, count(*) FILTER (margin > threshold) AS switches FROM sm, th GROUP BY threshold) SELECT threshold, round(gain, 9) AS gain, switches FROM g ORDER BY g.gain DESC, switches, threshold DESC LIMIT 1")
def l2(spark, d):
    return tune.choose_threshold(tune.threshold_gains(_samples(spark, d), _THRESHOLDS)).withColumn("gain", F.round("gain", 9))


@query(
    "l3_out_of_fold",
    f"{_SAMP}, g AS (SELECT fold, language, threshold, round(sum(CASE WHEN margin > threshold THEN delta ELSE 0 END), 12) AS gain, count(*) FILTER (margin > threshold) AS switches FROM sm, th GROUP BY ALL), o AS (SELECT fold, language, threshold, round(sum(gain) OVER (PARTITION BY language, threshold) - gain, 12) AS gain, sum(switches) OVER (PARTITION BY language, threshold) - switches AS switches FROM g), "
    "c AS (SELECT fold, language, threshold FROM o QUALIFY row_number() OVER (PARTITION BY fold, language ORDER BY gain DESC, switches, threshold DESC) = 1) SELECT id, sm.fold, c.threshold, margin > c.threshold AS switched FROM sm JOIN c ON sm.fold = c.fold AND sm.language = c.language",
)
def l3(spark, d):
    return tune.out_of_fold(_samples(spark, d), _THRESHOLDS, 4, "language").select("id", "fold", "threshold", "switched")


_ANCHOR_WEIGHTS, _TEMPERATURES, _MARGINS = [0.5, 1.0], [0.1, 0.25], [0.0, 0.02, 0.05]
_CHOICES = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS anchor_weight, {t}::DOUBLE AS temperature, id, atext AS anchor, btext AS text, NOT banchor AS other, round(anchor_risk - best_risk, 9) AS advantage FROM ({weighted_sql(a, t)} SELECT * FROM w)" for a in _ANCHOR_WEIGHTS for t in _TEMPERATURES)


@query(
    "l4_grid",
    f"{PAIRS_SQL}, ch AS ({_CHOICES}), mg AS (SELECT unnest({_MARGINS}::DOUBLE[]) AS margin), er AS (SELECT id, hyp AS said, any_value(we) AS we, any_value(wn) AS wn, any_value(ce) AS ce, any_value(cn) AS cn FROM pairs GROUP BY id, hyp), "
    "ea AS (SELECT id, ('0x' || substr(sha1(id), 1, 8))::BIGINT % 4 AS fold, anchor_weight, temperature, margin, other AND advantage > margin AS switched, CASE WHEN other AND advantage > margin THEN text ELSE anchor END AS said FROM ch, mg), "
    "ins AS (SELECT fold, anchor_weight, temperature, margin, sum(we) AS we, sum(wn) AS wn, sum(ce) AS ce, sum(cn) AS cn, count(*) FILTER (switched) AS s FROM ea JOIN er USING (id, said) GROUP BY ALL), "
    "ou AS (SELECT fold, anchor_weight, temperature, margin, sum(we) OVER p - we AS we, sum(wn) OVER p - wn AS wn, sum(ce) OVER p - ce AS ce, sum(cn) OVER p - cn AS cn, (sum(s) OVER p - s)::BIGINT AS switches FROM ins WINDOW p AS (PARTITION BY anchor_weight, temperature, margin)), "
    "fi AS (SELECT *, round(0.5 * (we::DOUBLE / greatest(wn, 1)) + 0.5 * (ce::DOUBLE / greatest(cn, 1)), 12) AS error FROM ou) "
    "SELECT fold, anchor_weight, temperature, margin, error, switches FROM fi QUALIFY row_number() OVER (PARTITION BY fold ORDER BY error, switches, anchor_weight, temperature, margin) = 1",
)
def l4(spark, d):
    choices = select.mbr_grid(samples(spark, d), anchors(spark, d), _ANCHOR_WEIGHTS, _TEMPERATURES)
    errors = pairs(spark, d).select("id", F.col("hyp").alias("text"), "word_errors", "word_count", "char_errors", "char_count").dropDuplicates(["id", "text"])
    return tune.nested_choice(choices, _MARGINS, errors, 4)


@query(
    "l5_margins",
    f"{_SAMP}, r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY language) AS n FROM sm) SELECT language, threshold AS margin, round(avg(CASE WHEN r.margin > threshold THEN delta ELSE 0 END), 9) AS mean FROM r, th WHERE r < greatest(n // 3, 1) * 3 GROUP BY ALL",
)
def l5(spark, d):
    rows = _samples(spark, d).withColumnRenamed("margin", "m")
    return tune.contiguous_margins(rows, _THRESHOLDS, 3, "language", "id", F.when(F.col("m") > F.col("margin"), F.col("delta")).otherwise(0.0))


@query("l6_sweep", f"{PAIRS_SQL}, m AS (SELECT system, 0.5 * sum(we)::DOUBLE / sum(wn) + 0.5 * sum(ce)::DOUBLE / sum(cn) AS combined FROM pairs GROUP BY system) SELECT system, round(combined, 9) AS combined FROM m ORDER BY m.combined, system LIMIT 1")
def l6(spark, d):
    return tune.sweep_best(scoring.group_metrics(pairs(spark, d), "system"), "combined", "system").withColumn("combined", F.round("combined", 9))


@query("l8_pending", f"{SQL} SELECT DISTINCT id FROM hyps WHERE system = 'seq_large' AND id NOT IN (SELECT id FROM hyps WHERE system = 'ctc_small')")
def l8(spark, d):
    h = hyps(spark, d)
    return tune.pending(of(h, ANCHOR).select("id").distinct(), of(h, "ctc_small"), "id")


@query("l10_stream_shuffle", "SELECT row_no, row_number() OVER (ORDER BY sha1('5|' || row_no), row_no) AS place FROM lm_text")
def l10(spark, d):
    from ..operators.relational import seeded_order
    from ..operators.skew import ranked

    keyed = lm(spark, d).select("row_no", F.struct(seeded_order(F.col("row_no"), 5).alias("h"), "row_no").alias("o"))
    return ranked(keyed, "o", out="at").select("row_no", (F.col("at") + 1).alias("place"))


@query(
    "l7_resumable_ingest",
    "SELECT id, row_no, language, duration FROM (SELECT * FROM generalization_mix WHERE id IS NOT NULL AND duration BETWEEN 2 AND 9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no) = 1) QUALIFY row_number() OVER (PARTITION BY language ORDER BY row_no) <= 50",
)
def l7(spark, d):
    """The table streamed as one file into an empty sink, then again: the second run adds nothing."""
    import uuid

    from ..session import shared_folder
    from ..streaming.ingest import start_ingest

    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = mix(spark, d).select("id", "row_no", "language", "duration")
    source = spark.readStream.schema(mix(spark, d).schema).parquet(f"{d}/generalization_mix.parquet*").select(*rows.columns)
    for checkpoint in ("a", "b"):
        start_ingest(source, f"{folder}/table", f"{folder}/{checkpoint}", "id", "language", 50, "row_no", "duration", 2.0, 9.0).awaitTermination()
    return spark.read.parquet(f"{folder}/table")
