"""Queries on error rates and on choosing among hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editdist
from ..functions.text import normalize
from ..operators import scoring, select
from ..operators.relational import last_wins
from ..session import table
from .registry import query
from .views import ANCHOR, PAIRS_SQL, SQL, SYSTEMS, hyps, rate_sql, refs, sql_norm, word_distance_sql, words_sql


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair scores of all systems (id, language, ref, system, ord, hyp, ...)."""
    return scoring.pair_scores(refs(spark, d), hyps(spark, d))


def of(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("system") == name)


_SHORT = {"word_errors": "we", "word_count": "wn", "char_errors": "ce", "char_count": "cn"}
_RATES = f"{rate_sql('sum(we)', 'sum(wn)')} AS wer, {rate_sql('sum(ce)', 'sum(cn)')} AS cer, 0.5 * {rate_sql('sum(we)', 'sum(wn)')} + 0.5 * {rate_sql('sum(ce)', 'sum(cn)')} AS combined"
_SUMS = "count(*) AS n, sum(we)::BIGINT AS word_errors, sum(wn)::BIGINT AS word_count, sum(ce)::BIGINT AS char_errors, sum(cn)::BIGINT AS char_count"


@query("g1_distances", f"{PAIRS_SQL} SELECT id, system, we AS word_errors, ce AS char_errors FROM pairs")
def g1(spark, d):
    return pairs(spark, d).select("id", "system", "word_errors", "char_errors")


@query("g2_error_sums", f"{PAIRS_SQL} SELECT system, {_SUMS} FROM pairs GROUP BY system")
def g2(spark, d):
    return pairs(spark, d).groupBy("system").agg(*scoring.sums())


_REAL = r"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"
_UNFOLDED = f"""WITH r AS (SELECT id, {_REAL.format(c='target')} AS r FROM zoo_references WHERE id IS NOT NULL),
h AS (SELECT id, model_name AS system, {_REAL.format(c='target')} AS h FROM zoo_predictions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, model_name ORDER BY row_no DESC) = 1),
b AS (SELECT id, system, r, h, string_split(r, '') AS rc, string_split(h, '') AS hc, {words_sql("r")} AS rw, {words_sql("h")} AS hw FROM r JOIN h USING (id))"""


@query("g1_unfolded", f"{_UNFOLDED} SELECT id, system, {word_distance_sql('rw', 'hw')}::BIGINT AS word_errors, CASE WHEN r = '' OR h = '' THEN length(r) + length(h) ELSE {word_distance_sql('rc', 'hc')} END::BIGINT AS char_errors FROM b")
def g1u(spark, d):
    """Distances of the texts as they are, accents, full-width forms and other scripts included; at most 126 different
    characters and words a pair for the SQL."""
    real = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " "))
    rows = table(spark, d, "zoo_predictions").filter("id IS NOT NULL").select("id", F.col("model_name").alias("system"), F.col("row_no").alias("ord"), real(F.col("target")).alias("hyp"))
    given = table(spark, d, "zoo_references").filter("id IS NOT NULL").select("id", real(F.col("target")).alias("ref"))
    e = editdist.error_columns(F.col("ref"), F.col("hyp"))
    return given.join(last_wins(rows, ["id", "system"], "ord"), "id").select("id", "system", e["word_errors"].alias("word_errors"), e["char_errors"].alias("char_errors"))


@query("g3_row_rates", f"{PAIRS_SQL} SELECT id, system, {rate_sql('we', 'wn')} AS wer, {rate_sql('ce', 'cn')} AS cer FROM pairs")
def g3(spark, d):
    return scoring.rates(pairs(spark, d)).select("id", "system", "wer", "cer")


@query("g4_by_language", f"{PAIRS_SQL} SELECT language, {_SUMS}, {_RATES} FROM pairs WHERE system = 'seq_large' GROUP BY language")
def g4(spark, d):
    """Word and character error rates by language: the flagship query."""
    one = scoring.pair_scores(refs(spark, d), hyps(spark, d).filter(F.col("system") == ANCHOR))
    return scoring.group_metrics(one, "language")


@query(
    "g5_score_report",
    f"{PAIRS_SQL}, l AS (SELECT language, {_SUMS}, {_RATES} FROM pairs WHERE system = 'ctc_wide' GROUP BY language), u AS (SELECT * FROM l UNION ALL SELECT 'overall', {_SUMS}, {_RATES} FROM pairs WHERE system = 'ctc_wide' "
    "UNION ALL SELECT 'macro', sum(n)::BIGINT, sum(word_errors)::BIGINT, sum(word_count)::BIGINT, sum(char_errors)::BIGINT, sum(char_count)::BIGINT, avg(wer), avg(cer), avg(combined) FROM l) SELECT * REPLACE (round(wer, 9) AS wer, round(cer, 9) AS cer, round(combined, 9) AS combined) FROM u",
)
def g5(spark, d):
    report = scoring.score_report(scoring.pair_scores(refs(spark, d), hyps(spark, d).filter("system = 'ctc_wide'")))
    return report.withColumns({c: F.round(c, 9) for c in ("wer", "cer", "combined")})


def _policy_sql(name: str, norm: str) -> str:
    r, h = norm.replace("{c}", "ref"), norm.replace("{c}", "hyp")
    a, b = words_sql(r), words_sql(h)
    return f"SELECT '{name}' AS policy, language, {word_distance_sql(a, b)}::BIGINT AS we, len({a})::BIGINT AS wn, levenshtein({r}, {h})::BIGINT AS ce, length({r})::BIGINT AS cn FROM refs JOIN hyps USING (id) WHERE system = 'seq_mixed'"


@query("g6_all_policies", f"{SQL}, p AS ({_policy_sql('raw', '{c}')} UNION ALL {_policy_sql('starter_lower', 'lower({c})')} UNION ALL {_policy_sql('no_punct_lower', sql_norm('{c}'))}) SELECT policy, language, {_SUMS}, {_RATES} FROM p GROUP BY policy, language")
def g6(spark, d):
    return scoring.all_policies(refs(spark, d), hyps(spark, d).filter("system = 'seq_mixed'"), ["raw", "starter_lower", "no_punct_lower"], "language")


_WEIGHTS = {"lin": 448.0, "sna": 444.0, "lug": 300.0}


@query(
    "g7_weighted",
    f"{PAIRS_SQL}, l AS (SELECT language, {_RATES} FROM pairs WHERE system = 'seq_large' GROUP BY language), w AS (SELECT combined, CASE language WHEN 'lin' THEN 448.0 WHEN 'sna' THEN 444.0 WHEN 'lug' THEN 300.0 END AS w FROM l) "
    "SELECT round(sum(combined * w) / sum(w), 9) AS weighted, round(avg(combined), 9) AS macro, count(*) AS n_languages FROM w WHERE w IS NOT NULL",
)
def g7(spark, d):
    per = scoring.group_metrics(of(pairs(spark, d), ANCHOR), "language")
    return scoring.weighted_score(per, _WEIGHTS).withColumns({"weighted": F.round("weighted", 9), "macro": F.round("macro", 9)})


_LW = (words_sql("lower(ref)"), words_sql("lower(hyp)"))


@query("g8_candidate", f"{SQL}, p AS (SELECT language, {word_distance_sql(*_LW)}::BIGINT AS we, len({_LW[0]})::BIGINT AS wn, levenshtein(ref, hyp)::BIGINT AS ce, length(ref)::BIGINT AS cn FROM refs JOIN hyps USING (id) WHERE system = 'seq_adapter') SELECT language, {_SUMS}, {_RATES} FROM p GROUP BY language")
def g8(spark, d):
    return scoring.candidate_score(refs(spark, d), hyps(spark, d).filter("system = 'seq_adapter'"))


@query("g8_verdicts", f"{PAIRS_SQL}, s AS (SELECT system, 1 - ({_RATES.split(' AS cer, ')[1].replace(' AS combined', '')}) AS score FROM pairs GROUP BY system) SELECT a.system, round(a.score, 9) AS score, CASE WHEN a.score - b.score > 0.0005 THEN 'better' WHEN b.score - a.score > 0.0005 THEN 'worse' ELSE 'same' END AS verdict FROM s a, s b WHERE b.system = 'seq_large'")
def g8v(spark, d):
    score = scoring.group_metrics(pairs(spark, d), "system").select("system", (1 - F.col("combined")).alias("score"))
    base = score.filter(F.col("system") == ANCHOR).select(F.col("score").alias("b"))
    return score.crossJoin(F.broadcast(base)).select("system", F.round("score", 9).alias("score"), scoring.verdict(F.col("score"), F.col("b")).alias("verdict"))


@query("g9_pair_table", f"{PAIRS_SQL} SELECT id, system, language, we AS word_errors, wn AS word_count, ce AS char_errors, cn AS char_count FROM pairs")
def g9(spark, d):
    return pairs(spark, d).select("id", "system", "language", *_SHORT)


@query("g10_selection", f"{PAIRS_SQL} SELECT language, {_SUMS}, {_RATES} FROM pairs WHERE system = CASE WHEN language = 'lin' THEN 'seq_mixed' ELSE 'ctc_small' END GROUP BY language")
def g10(spark, d):
    p = pairs(spark, d)
    chosen = refs(spark, d).select("id", F.when(F.col("language") == "lin", "seq_mixed").otherwise("ctc_small").alias("system"))
    return scoring.by_selection(p, chosen, "language")


def cost_sql(x: str, y: str) -> str:
    a, b = words_sql(x), words_sql(y)
    return f"(0.5 * {word_distance_sql(a, b)} / greatest(len({a}), len({b}), 1) + 0.5 * levenshtein({x}, {y}) / greatest(length({x}), length({y}), 1))"


@query("g11_pair_cost", f"{SQL} SELECT a.id, round({cost_sql('a.hyp', 'b.hyp')}, 9) AS cost FROM hyps a JOIN hyps b USING (id) WHERE a.system = 'ctc_small' AND b.system = 'seq_large'")
def g11(spark, d):
    a = of(hyps(spark, d), "ctc_small").select("id", F.col("hyp").alias("x"))
    b = of(hyps(spark, d), ANCHOR).select("id", F.col("hyp").alias("y"))
    return a.join(b, "id").select("id", F.round(editdist.pair_cost(F.col("x"), F.col("y")), 9).alias("cost"))


@query("g12_gains", f"{PAIRS_SQL}, t AS (SELECT sum(wn) AS w, sum(cn) AS c FROM pairs WHERE system = 'ctc_wide') SELECT a.id, round(0.5 * (a.we - b.we) / w + 0.5 * (a.ce - b.ce) / c, 12) AS gain FROM pairs a JOIN pairs b USING (id), t WHERE a.system = 'ctc_wide' AND b.system = 'seq_large'")
def g12(spark, d):
    p = pairs(spark, d)
    return scoring.exact_gains(of(p, "ctc_wide"), of(p, ANCHOR)).withColumn("gain", F.round("gain", 12))


@query("g14_better_worse", f"{PAIRS_SQL}, r AS (SELECT id, language, system, 0.5 * {rate_sql('we', 'wn')} + 0.5 * {rate_sql('ce', 'cn')} AS c FROM pairs) SELECT a.language, count(*) AS n, count(*) FILTER (b.c - a.c < -0.05) AS n_better, count(*) FILTER (b.c - a.c > 0.05) AS n_worse FROM r a JOIN r b USING (id) WHERE a.system = 'seq_large' AND b.system = 'seq_mixed' GROUP BY a.language")
def g14(spark, d):
    p = pairs(spark, d)
    return scoring.compare_systems(of(p, ANCHOR), of(p, "seq_mixed"), 0.05, "language")


# ---- selection --------------------------------------------------------------------------------------------------


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(id, idx, text, norm): all systems of every utterance that the anchor covers, the anchor first."""
    order = [ANCHOR, *[s for s in SYSTEMS if s != ANCHOR]]
    h = hyps(spark, d).filter(F.col("system").isin(order))
    idx = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("system")) - 1
    long = h.select("id", idx.cast("int").alias("idx"), F.col("hyp").alias("text"), normalize(F.col("hyp"), "no_punct_lower").alias("norm"))
    return long.join(h.filter(F.col("system") == ANCHOR).select("id"), "id", "left_semi")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(id, idx, text, norm, score): the systems other than the anchor as samples with a score drawn from a hash."""
    score = -F.conv(F.substring(F.sha1(F.concat("id", F.col("idx").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") / 65536.0
    return candidates(spark, d).filter("idx > 0").withColumn("score", score)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).filter("idx = 0").select("id", "text", "norm")


_CAND = f"""{SQL}, cand AS (SELECT id, CASE system WHEN 'seq_large' THEN 0 WHEN 'ctc_small' THEN 1 WHEN 'ctc_wide' THEN 2 WHEN 'seq_adapter' THEN 3 ELSE 4 END AS idx, hyp AS text, {sql_norm('hyp')} AS norm FROM hyps WHERE id IN (SELECT id FROM hyps WHERE system = 'seq_large')),
samp AS (SELECT *, -(('0x' || substr(sha1(id || idx), 1, 4))::INT) / 65536.0::DOUBLE AS score FROM cand WHERE idx > 0)"""
_MBR = f"""{_CAND}, u AS (SELECT id, norm, min(idx) AS idx, arg_min(text, idx) AS text FROM cand GROUP BY id, norm),
r AS (SELECT a.id, a.idx, any_value(a.text) AS text, round(sum(CASE WHEN a.idx = b.idx THEN 0 ELSE {cost_sql('a.norm', 'b.norm')} END) / count(*), 9) AS risk, count(*) AS n FROM u a JOIN u b USING (id) GROUP BY a.id, a.idx),
m AS (SELECT id, arg_min(idx, (risk, idx)) AS idx, arg_min(text, (risk, idx)) AS text, min(risk) AS risk, max(risk) FILTER (idx = 0) AS anchor_risk, max(n) AS n FROM r GROUP BY id)"""


@query("h1_mbr_medoid", f"{_MBR} SELECT id, idx, text, risk, anchor_risk, round(anchor_risk - risk, 9) AS advantage, n FROM m")
def h1(spark, d):
    return select.mbr_medoid(candidates(spark, d))


def weighted_sql(anchor_weight: float, temperature: float) -> str:
    return f"""{_CAND}, b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM samp), g AS (SELECT id, norm, min(idx) AS idx, arg_min(text, idx) AS text, sum(exp(greatest((score - best) / {temperature}, -50.0))) AS w FROM b GROUP BY id, norm),
an AS (SELECT id, norm, text FROM cand WHERE idx = 0),
k AS (SELECT coalesce(g.id, an.id) AS id, coalesce(g.norm, an.norm) AS norm, CASE WHEN an.id IS NOT NULL THEN -1 ELSE g.idx END AS idx, coalesce(an.text, g.text) AS text, an.id IS NOT NULL AS anchor, coalesce(w, 0) + CASE WHEN an.id IS NOT NULL THEN {anchor_weight} ELSE 0 END AS weight FROM g FULL JOIN an ON g.id = an.id AND g.norm = an.norm),
r AS (SELECT a.id, a.idx, any_value(a.text) AS text, any_value(a.anchor) AS anchor, any_value(a.weight) AS weight, round(sum(b.weight * CASE WHEN a.idx = b.idx THEN 0 ELSE {cost_sql('a.norm', 'b.norm')} END) / greatest(sum(b.weight), 1e-12), 9) AS risk FROM k a JOIN k b USING (id) GROUP BY a.id, a.idx),
w AS (SELECT id, arg_min(text, (risk, NOT anchor, -weight, idx)) AS btext, arg_min(anchor, (risk, NOT anchor, -weight, idx)) AS banchor, min(risk) AS best_risk, max(text) FILTER (anchor) AS atext, max(risk) FILTER (anchor) AS anchor_risk FROM r GROUP BY id)"""


@query("h2_weighted_mbr", f"{weighted_sql(0.5, 0.25)} SELECT id, CASE WHEN NOT banchor AND round(anchor_risk - best_risk, 9) > 0.02 THEN btext ELSE atext END AS text, NOT banchor AND round(anchor_risk - best_risk, 9) > 0.02 AS switched, anchor_risk, best_risk, round(anchor_risk - best_risk, 9) AS advantage FROM w")
def h2(spark, d):
    return select.weighted_mbr(samples(spark, d), anchors(spark, d), 0.5, 0.25, 0.02)


@query(
    "h3_nbest_features",
    f"{_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS r FROM samp), s AS (SELECT id, max(score) AS score_best, max(score) - max(score) FILTER (r = 2) AS score_gap, round(avg(score), 9) AS score_mean, round(stddev_pop(score), 9) AS score_std, count(*) AS n_samples, count(DISTINCT norm) AS n_unique, max(norm) FILTER (r = 1) AS best FROM r GROUP BY id), "
    f"k AS (SELECT a.id, any_value(a.norm) AS anorm, round(avg({cost_sql('a.norm', 's.norm')}), 9) AS anchor_risk FROM cand a JOIN samp s USING (id) WHERE a.idx = 0 GROUP BY a.id) SELECT s.* EXCLUDE (best), anchor_risk, best = anorm AS best_equals_anchor FROM s JOIN k USING (id)",
)
def h3(spark, d):
    return select.nbest_features(samples(spark, d), anchors(spark, d))


@query("h4_alternatives", f"{SQL} SELECT p.id, CASE WHEN trim(coalesce(o.hyp, '')) <> '' THEN o.hyp ELSE p.hyp END AS text FROM (SELECT * FROM hyps WHERE system = 'seq_large') p LEFT JOIN (SELECT * FROM hyps WHERE system = 'ctc_wide') o USING (id)")
def h4(spark, d):
    named = lambda s: of(hyps(spark, d), s).select("id", F.col("hyp").alias("text"))
    return select.alternatives(named(ANCHOR), named("ctc_wide"))


_K4 = "list_filter(list_transform(string_split({c}, ' '), lambda w: regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '')"


def top4_sql(c: str) -> str:
    w = _K4.format(c=c)
    return f"coalesce(list_max(map_values(list_histogram(list_transform(range(1, greatest(len({w}) - 2, 1)), lambda i: array_to_string(({w})[i:i + 3], ' '))))), 0)"


@query("h5_margin_gate", f"{_MBR}, a AS (SELECT id, text AS anchor FROM cand WHERE idx = 0), j AS (SELECT a.id, a.anchor, m.text AS alt, round(anchor_risk - risk, 9) > 0.03 AND trim(m.text) <> '' AS q, {top4_sql('m.text')} >= 4 AS looped FROM a JOIN m USING (id)) SELECT id, CASE WHEN q AND NOT looped THEN alt ELSE anchor END AS text, CASE WHEN NOT q THEN 'kept' WHEN looped THEN 'blocked_loop' ELSE 'switched' END AS outcome FROM j")
def h5(spark, d):
    primary = anchors(spark, d).select("id", "text")
    decided = select.mbr_medoid(candidates(spark, d)).select("id", F.col("text").alias("alternative"), "advantage")
    return select.margin_gate(primary, decided.join(primary.withColumnRenamed("text", "anchor"), "id"), 0.03)


_IDX = "CASE system WHEN 'seq_large' THEN 0 WHEN 'ctc_small' THEN 1 WHEN 'ctc_wide' THEN 2 WHEN 'seq_adapter' THEN 3 ELSE 4 END"


@query("h6_oracle", f"{PAIRS_SQL}, t AS (SELECT sum(wn) AS w, sum(cn) AS c FROM (SELECT DISTINCT id, wn, cn FROM pairs)), s AS (SELECT pairs.*, {_IDX} AS idx, round(0.5 * we / greatest(w, 1) + 0.5 * ce / greatest(c, 1), 15) AS cost FROM pairs, t) SELECT id, idx, system, we AS word_errors, ce AS char_errors FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, idx) = 1")
def h6(spark, d):
    order = F.array(*[F.lit(s) for s in [ANCHOR, *[s for s in SYSTEMS if s != ANCHOR]]])
    p = pairs(spark, d).withColumn("idx", (F.array_position(order, F.col("system")) - 1).cast("int"))
    return select.nbest_oracle(p).select("id", "idx", "system", "word_errors", "char_errors")


@query(
    "h17_review",
    f"{_CAND}, k AS (SELECT id, norm, count(*) AS n, min(idx) AS idx FROM samp GROUP BY id, norm), c AS (SELECT * FROM cand WHERE idx = 0), r AS (SELECT c.id, any_value(c.norm) AS cn, round(sum({cost_sql('c.norm', 'k.norm')} * n) / sum(n), 9) AS risk, count(*) AS n_distinct, arg_max(k.norm, (length(k.norm), -k.idx)) AS longest FROM c JOIN k USING (id) GROUP BY c.id), "
    f"m AS (SELECT a.id, a.norm, any_value(a.idx) AS idx, round(sum(b.n * CASE WHEN a.idx = b.idx THEN 0 ELSE {cost_sql('a.norm', 'b.norm')} END) / sum(b.n), 9) AS risk FROM k a JOIN k b USING (id) GROUP BY a.id, a.norm), z AS (SELECT id, arg_min(norm, (risk, idx)) AS central FROM m GROUP BY id) "
    "SELECT id, round(risk * len(list_filter(string_split(cn, ' '), lambda w: w <> '')), 6) AS expected_loss, risk, n_distinct, central, longest FROM r JOIN z USING (id) ORDER BY expected_loss DESC, id LIMIT 50",
)
def h17(spark, d):
    return select.review_queue(anchors(spark, d), samples(spark, d), 50)


