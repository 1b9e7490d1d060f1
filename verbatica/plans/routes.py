"""Queries on routing among systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shape import health_reasons, with_language_median
from ..functions.text import id_language
from ..operators import route, scoring
from ..session import cut
from .registry import query
from .scores import _CAND, _RATES, _SUMS, of, pairs, samples, top4_sql
from .texts import _RUN, _W
from .views import ANCHOR, PAIRS_SQL, SQL, SYSTEMS, hyps, rate_sql, refs, system

_BLANK = "regexp_full_match(hyp, '[\\s.,!?;:''\"()\\[\\]{}\\-_/\\\\|]+')"


def bad_sql(ref: str | None, med: str) -> str:
    """Whether a text ``hyp`` with words ``w`` and run ``run`` is unhealthy."""
    parts = [
        "length(hyp) <= 4", "len(w) < 2", _BLANK, "run >= 3", "(len(w) >= 6 AND len(list_filter(range(1, len(w) - 4), lambda i: w[i:i + 2] = w[i + 3:i + 5])) > 0)",
        f"coalesce({med} > 0 AND length(hyp) < 0.15 * {med}, false)",
    ]
    if ref:
        parts.append(f"coalesce(length({ref}) > 0 AND length(hyp) < 0.20 * length({ref}), false)")
    return "(" + " OR ".join(parts) + ")"


_IDX = "CASE system WHEN 'ctc_small' THEN 0 WHEN 'ctc_wide' THEN 1 WHEN 'seq_adapter' THEN 2 WHEN 'seq_large' THEN 3 ELSE 4 END"


@query(
    "h7_strategies",
    f"""{PAIRS_SQL}, p AS (SELECT *, {_IDX} AS idx FROM pairs), r AS (SELECT *, {rate_sql('ce', 'cn')} AS cer FROM p), ids AS (SELECT DISTINCT id, language FROM p),
base AS (SELECT id, system FROM p WHERE system = 'seq_large'),
hb AS (SELECT h.id, hyp, ref, {_W} AS w, median(length(hyp)) OVER (PARTITION BY split_part(h.id, '_', 1)) AS med FROM hyps h LEFT JOIN refs r ON h.id = r.id WHERE system = 'seq_large'), hr AS (SELECT *, coalesce({_RUN('w')}, 0) AS run FROM hb), bad AS (SELECT id FROM hr WHERE {bad_sql('ref', 'med')}),
pl AS (SELECT language, system, idx, {_RATES} FROM p GROUP BY ALL), bl AS (SELECT language, arg_min(system, (combined, idx)) AS system FROM pl GROUP BY language), best AS (SELECT id, arg_min(system, (cer, idx)) AS system FROM r GROUP BY id),
sel AS (SELECT 'base' AS strategy, id, system FROM base UNION ALL SELECT 'best_per_language', p.id, p.system FROM p JOIN bl ON p.language = bl.language AND p.system = bl.system UNION ALL SELECT 'best_per_sample', id, system FROM best
 UNION ALL SELECT 'only_bad_base', best.id, coalesce(g.system, best.system) FROM best LEFT JOIN (SELECT * FROM base WHERE id NOT IN (SELECT id FROM bad)) g ON best.id = g.id
 UNION ALL SELECT 'only_language', ids.id, CASE WHEN language = 'lin' THEN best.system ELSE base.system END FROM ids JOIN best ON ids.id = best.id LEFT JOIN base ON ids.id = base.id)
SELECT strategy, {_SUMS}, {_RATES} FROM p JOIN sel ON p.id = sel.id AND p.system = sel.system GROUP BY strategy""",
)
def h7(spark, d):
    order = F.array(*[F.lit(s) for s in SYSTEMS])
    p = cut(pairs(spark, d).withColumn("idx", F.array_position(order, F.col("system")) - 1).select("id", "language", "system", "idx", "word_errors", "word_count", "char_errors", "char_count"))
    base = with_language_median(system(spark, d, ANCHOR).join(refs(spark, d).select("id", "ref"), "id", "left"), "hyp", id_language(F.col("id")))
    bad = base.filter(F.size(health_reasons(F.col("hyp"), F.col("ref"), F.col("med"))) > 0).select("id")
    return route.strategy_report(p, route.strategies(p, ANCHOR, bad, "lin"))


_PRIORITIES = {"lin": ["seq_mixed", "ctc_wide"], "sna": ["ctc_small"], "lug": ["seq_adapter", "seq_mixed", "ctc_small"]}
_PLACE = "CASE " + " ".join(f"WHEN language = '{lang}' AND system = '{s}' THEN {i}" for lang, order in _PRIORITIES.items() for i, s in enumerate(order)) + " END"


@query(
    "h8_priority_route",
    f"""{SQL}, m AS (SELECT split_part(id, '_', 1) AS language, median(length(hyp)) AS med FROM hyps WHERE system = 'seq_large' GROUP BY 1),
b AS (SELECT h.id, split_part(h.id, '_', 1) AS language, system, hyp, med, {_W} AS w FROM hyps h LEFT JOIN m ON m.language = split_part(h.id, '_', 1)), r AS (SELECT *, coalesce({_RUN('w')}, 0) AS run FROM b), j AS (SELECT *, {bad_sql(None, 'med')} AS bad, {_PLACE} AS place FROM r),
a AS (SELECT id, arg_min(system, place) AS system, arg_min(hyp, place) AS hyp FROM j WHERE NOT bad AND place IS NOT NULL GROUP BY id)
SELECT j.id, CASE WHEN j.bad AND a.id IS NOT NULL THEN a.system ELSE j.system END AS system, CASE WHEN trim(CASE WHEN j.bad AND a.id IS NOT NULL THEN a.hyp ELSE j.hyp END) = '' THEN '.' ELSE CASE WHEN j.bad AND a.id IS NOT NULL THEN a.hyp ELSE j.hyp END END AS text FROM j LEFT JOIN a ON j.id = a.id WHERE j.system = 'seq_large'""",
)
def h8(spark, d):
    return route.priority_route(hyps(spark, d).withColumn("language", id_language(F.col("id"))), ANCHOR, _PRIORITIES)


def _usable_sql(hyp: str, w: str, run: str) -> str:
    blank = _BLANK.replace("hyp", hyp)
    return f"({hyp} = '' OR length({hyp}) <= 3 OR {blank} OR {run} >= 3 OR (language IN ('lin', 'sna') AND (length({hyp}) < 12 OR len({w}) <= 2 OR coalesce(length(ref) > 0 AND length({hyp}) < 0.20 * length(ref), false))))"


@query(
    "h9_language_fallback",
    f"""{SQL}, b AS (SELECT id, split_part(id, '_', 1) AS language, system, hyp, {_W} AS w FROM hyps), r AS (SELECT b.*, ref, coalesce({_RUN('w')}, 0) AS run FROM b LEFT JOIN refs ON b.id = refs.id), j AS (SELECT *, {_usable_sql('hyp', 'w', 'run')} AS bad FROM r),
k AS (SELECT a.id, a.language, a.hyp, a.bad, l.hyp AS lh, l.bad AS lb, s.hyp AS sh, s.bad AS sb FROM j a LEFT JOIN (SELECT * FROM j WHERE system = 'ctc_wide') l ON a.id = l.id LEFT JOIN (SELECT * FROM j WHERE system = 'seq_mixed') s ON a.id = s.id WHERE a.system = 'seq_adapter'),
t AS (SELECT id, language, CASE WHEN NOT bad THEN hyp WHEN language = 'lin' AND lb = false THEN lh WHEN language = 'sna' AND sb = false THEN sh ELSE hyp END AS text,
 CASE WHEN NOT bad THEN 'keep_base' WHEN language = 'lin' THEN CASE WHEN lb = false THEN 'replace_lin' ELSE 'keep_base_lin_unusable' END WHEN language = 'sna' THEN CASE WHEN sb = false THEN 'replace_sna' ELSE 'keep_base_sna_unusable' END ELSE 'keep_base_bad_' || language END AS action FROM k)
SELECT id, language, CASE WHEN trim(text) = '' THEN '.' ELSE text END AS text, action FROM t""",
)
def h9(spark, d):
    named = lambda s: system(spark, d, s).withColumnRenamed("hyp", "text")
    base = named("seq_adapter").withColumn("language", id_language(F.col("id"))).join(refs(spark, d).select("id", "ref"), "id", "left")
    return route.language_fallback(base, {"lin": named("ctc_wide"), "sna": named("seq_mixed")})


@query(
    "h10_loop_repair",
    f"{SQL}, j AS (SELECT p.id, p.hyp AS p, f.hyp AS f, {top4_sql('p.hyp')} AS n, {top4_sql(chr(99) + 'oalesce(f.hyp, ' + chr(39) * 2 + ')')} AS m FROM (SELECT * FROM hyps WHERE system = 'seq_mixed') p LEFT JOIN (SELECT * FROM hyps WHERE system = 'ctc_wide') f ON p.id = f.id) SELECT id, CASE WHEN f IS NOT NULL AND n >= 4 AND m < n THEN f ELSE p END AS text, f IS NOT NULL AND n >= 4 AND m < n AS switched FROM j",
)
def h10(spark, d):
    named = lambda s: system(spark, d, s).withColumnRenamed("hyp", "text")
    return route.loop_repair(named("seq_mixed"), named("ctc_wide"))


@query("h11_splice", f"{SQL} SELECT a.id, coalesce(r.language, 'unk') AS language, CASE WHEN coalesce(r.language, 'unk') IN ('lin', 'lug') THEN b.hyp ELSE a.hyp END AS text FROM (SELECT * FROM hyps WHERE system = 'seq_large') a JOIN (SELECT * FROM hyps WHERE system = 'seq_mixed') b ON a.id = b.id LEFT JOIN refs r ON a.id = r.id")
def h11(spark, d):
    named = lambda s: system(spark, d, s).withColumnRenamed("hyp", "text")
    return route.splice(named("seq_large"), named("seq_mixed"), refs(spark, d), ["lin", "lug"])


_TOP3 = top4_sql("text").replace("- 2, 1", "- 1, 1").replace("i:i + 3", "i:i + 2")


@query(
    "h12_rules_router",
    f"""{_CAND}, a AS (SELECT cand.id, cand.idx, cand.text, samp.score FROM cand LEFT JOIN samp ON cand.id = samp.id AND cand.idx = samp.idx), b AS (SELECT *, length(replace(replace(text, '.', ''), ' ', '')) < 3 OR {_TOP3} >= 3 AS bad FROM a),
l AS (SELECT id, list({{'idx': idx, 'score': score}} ORDER BY idx) AS c, bool_or(bad AND idx = 0) AS bad0, min(idx) FILTER (NOT bad AND idx > 0) AS alt FROM b GROUP BY id)
SELECT id, CASE WHEN bad0 AND alt IS NOT NULL THEN alt ELSE list_reduce(c, lambda a, x: CASE WHEN x.score IS NOT NULL AND (a.score IS NULL OR x.score > a.score + 0.2) THEN x ELSE a END).idx END AS idx FROM l""",
)
def h12(spark, d):
    from .scores import candidates

    scored = candidates(spark, d).join(samples(spark, d).select("id", "idx", "score"), ["id", "idx"], "left")
    return route.rules_router(scored, 0.2)


#: Fixed value: the order of the character models.
ORDER = 5
_LM = f"""{SQL}, t AS (SELECT language, trim(lower(ref)) AS t FROM refs WHERE language IS NOT NULL), pad AS (SELECT language, repeat(chr(2), {ORDER - 1}) || t || chr(3) AS p FROM t), g AS (SELECT language, substr(p, i, {ORDER - 1}) AS context, substr(p, i + {ORDER - 1}, 1) AS char FROM (SELECT language, p, unnest(range(1, length(p) - {ORDER - 2})) AS i FROM pad)),
n AS (SELECT language, context, char, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT language, count(DISTINCT char) + 1 AS v FROM n GROUP BY language), c AS (SELECT language, context, sum(n) AS c FROM n GROUP BY ALL),
w AS (SELECT id, system, split_part(id, '_', 1) AS language, repeat(chr(2), {ORDER - 1}) || trim(lower(hyp)) || chr(3) AS p FROM hyps), x AS (SELECT id, system, language, substr(p, i, {ORDER - 1}) AS context, substr(p, i + {ORDER - 1}, 1) AS char FROM (SELECT id, system, language, p, unnest(range(1, length(p) - {ORDER - 2})) AS i FROM w)),
lm AS (SELECT x.id, x.system, x.language, sum(ln((coalesce(n.n, 0) + 0.1) / (coalesce(c.c, 0) + 0.1 * v.v))) / count(*) AS lm_score FROM x LEFT JOIN n ON x.language = n.language AND x.context = n.context AND x.char = n.char LEFT JOIN c ON x.language = c.language AND x.context = c.context JOIN v ON x.language = v.language GROUP BY ALL)"""


def _lm_scores(spark: SparkSession, d: str, name: str) -> DataFrame:
    model = route.train_char_lm(refs(spark, d), "ref", "language", ORDER)
    h = system(spark, d, name).withColumn("language", id_language(F.col("id")))
    return h.join(route.score_char_lm(h, "hyp", "language", "id", model, ORDER, 0.1), ["id", "language"]).withColumnRenamed("hyp", "text")


@query("h13_char_lm", f"{_LM} SELECT id, language, round(lm_score, 6) AS lm_score FROM lm WHERE system = 'ctc_wide'")
def h13(spark, d):
    return _lm_scores(spark, d, "ctc_wide").select("id", "language", F.round("lm_score", 6).alias("lm_score"))


@query(
    "h14_lm_margin",
    f"{_LM}, j AS (SELECT p.id, p.language, round(f.lm_score - p.lm_score, 9) AS margin, {top4_sql('hp.hyp')} AS n, {top4_sql('hf.hyp')} AS m FROM lm p JOIN lm f ON p.id = f.id JOIN hyps hp ON hp.id = p.id AND hp.system = p.system JOIN hyps hf ON hf.id = f.id AND hf.system = f.system WHERE p.system = 'ctc_wide' AND f.system = 'seq_large') "
    "SELECT id, round(margin, 6) AS margin, n >= 4 AND m < n AS looped, (n >= 4 AND m < n) OR coalesce(margin > CASE language WHEN 'lin' THEN 0.05 WHEN 'lug' THEN 0.1 WHEN 'sna' THEN 0.08 END, false) AS switched FROM j",
)
def h14(spark, d):
    out = route.lm_margin_route(_lm_scores(spark, d, "ctc_wide"), _lm_scores(spark, d, "seq_large"), {"lin": 0.05, "lug": 0.1, "sna": 0.08})
    return out.withColumn("margin", F.round("margin", 6))


@query(
    "h18_recommendations",
    f"""{PAIRS_SQL}, z AS (SELECT p.id, p.ref AS o, p.hyp AS t, 0.5 * {rate_sql('we', 'wn')} + 0.5 * {rate_sql('ce', 'cn')} AS c, 1.0 + length(p.ref) / 14.0 AS d FROM pairs p WHERE p.system = 'ctc_small'),
w AS (SELECT *, len(list_filter(string_split(o, ' '), lambda x: x <> '')) AS ow, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS tw FROM z), f AS (SELECT *, t = '' OR t IN ('.', '...', ',', '?', '!', ';', ':') AS blank, t = '' OR t IN ('.', '...', ',', '?', '!', ';', ':') OR length(t) < 12 OR tw < 3 AS tb, o = '' OR d < 0.3 OR length(o) / d > 35 OR ow / d > 7 AS ob FROM w)
SELECT id, CASE WHEN blank THEN 'keep_original' WHEN ob AND NOT tb THEN 'manual_review' WHEN c <= 0.35 THEN 'keep_original' WHEN c >= 0.85 AND NOT tb THEN 'potential_teacher_correction' WHEN c >= 0.65 THEN 'suspicious_label' ELSE 'manual_review' END AS recommendation FROM f""",
)
def h18(spark, d):
    p = scoring.rates(of(pairs(spark, d), "ctc_small"))
    rows = p.select("id", F.col("ref").alias("original"), F.col("hyp").alias("teacher"), (1.0 + F.length("ref") / 14.0).alias("duration"), F.lit(None).cast("array<string>").alias("flags"), "combined")
    return route.recommend(rows).select("id", "recommendation")
