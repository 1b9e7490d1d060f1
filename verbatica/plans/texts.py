"""Queries on text normalization and transcript shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shape, text
from ..session import table
from .basic import lm, mix
from .registry import query
from .views import SQL, hyps, refs

_WS = r"[\s\p{Z}]+"
_COLLAPSE = lambda c: rf"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


@query("e1_whitespace", f"SELECT row_no, {_COLLAPSE('text')} AS t FROM lm_text WHERE text IS NOT NULL")
def e1(spark, d):
    return lm(spark, d).filter("text IS NOT NULL").select("row_no", text.collapse_space(F.col("text")).alias("t"))


@query("e2_punctuation", r"SELECT row_no, regexp_replace(text, '\p{P}', ' ', 'g') AS t FROM lm_text WHERE text IS NOT NULL")
def e2(spark, d):
    return lm(spark, d).filter("text IS NOT NULL").select("row_no", text.strip_punctuation(F.col("text")).alias("t"))


_ARTIFACTS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '<\|[^|]+\|>', ' ', 'g'), '(?i)\[(?:music|noise|silence|laughter|applause|inaudible|unk)\]', ' ', 'g'), '[♪♫♬]', ' ', 'g'), '\p{{C}}', ' ', 'g')"


@query("e3_artifacts", f"SELECT row_no, {_ARTIFACTS.format(c='target')} AS t FROM zoo_predictions WHERE target IS NOT NULL")
def e3(spark, d):
    return table(spark, d, "zoo_predictions").filter("target IS NOT NULL").select("row_no", text.remove_artifacts(F.col("target")).alias("t"))


_NP = lambda c: _COLLAPSE(rf"regexp_replace({c}, '\p{{P}}', ' ', 'g')")


@query(
    "e4_policies",
    f"WITH n AS (SELECT row_no, nfc_normalize(coalesce(transcription, '')) AS t FROM lm_text) SELECT row_no, {_COLLAPSE('t')} AS raw, {_COLLAPSE('lower(t)')} AS starter_lower, {_NP('lower(t)')} AS no_punct_lower, {_NP(_ARTIFACTS.format(c='lower(t)'))} AS language_safe FROM n",
)
def e4(spark, d):
    composed = lm(spark, d).select("row_no", text.nfc(F.coalesce("transcription", F.lit(""))).alias("t"))
    return composed.select("row_no", *[text.normalize(F.col("t"), p).alias(p) for p in text.POLICIES])


_CLEAN = r"trim(regexp_replace(regexp_replace(replace(coalesce(target, ''), chr(65533), ''), '\p{C}', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"


@query("e5_sanitize", f"WITH s AS (SELECT row_no, {_CLEAN} AS t FROM zoo_predictions) SELECT row_no, CASE WHEN t = '' THEN '.' ELSE t END AS t FROM s")
def e5(spark, d):
    return table(spark, d, "zoo_predictions").select("row_no", text.sanitize(F.col("target")).alias("t"))


@query("e6_tokens", rf"SELECT row_no, len(list_filter(string_split_regex(coalesce(transcription, ''), '{_WS}'), lambda w: w <> ''))::BIGINT AS n FROM lm_text")
def e6(spark, d):
    return lm(spark, d).select("row_no", F.size(text.tokens(F.col("transcription"))).cast("bigint").alias("n"))


@query(
    "e7_token_keys",
    rf"WITH w AS (SELECT unnest(list_filter(string_split_regex(coalesce(transcription, ''), '{_WS}'), lambda w: w <> '')) AS w FROM generalization_mix) SELECT regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS key, count(*) AS n FROM w GROUP BY 1",
)
def e7(spark, d):
    words = mix(spark, d).select(F.explode(text.tokens(F.col("transcription"))).alias("w"))
    return words.groupBy(text.token_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_DOTS = r"trim(regexp_replace(regexp_replace(coalesce(target, ''), '(?:\s*\.){3,}\s*$', '.'), '[\s\p{Z}]+', ' ', 'g'))"


@query("e8_trailing_dots", f"WITH t AS (SELECT row_no, {_DOTS} AS t FROM zoo_predictions) SELECT row_no, CASE WHEN t = '' THEN '.' ELSE t END AS t FROM t")
def e8(spark, d):
    return table(spark, d, "zoo_predictions").select("row_no", text.collapse_trailing_dots(F.col("target"), keep=True).alias("t"))


@query(
    "e9_sentence_case",
    f"{SQL}, p AS (SELECT id, system, upper(hyp[1]) || hyp[2:] AS t FROM hyps), s AS (SELECT id, system, string_split(regexp_replace(t, '([.!?][''\")\\]]?\\s+)([a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM p) "
    "SELECT id, system, parts[1] || coalesce(list_reduce(list_transform(parts[2:], lambda x: upper(x[1]) || x[2:]), lambda a, b: a || b, ''), '') AS t FROM s",
)
def e9(spark, d):
    return hyps(spark, d).select("id", "system", text.sentence_case(F.col("hyp")).alias("t"))


@query("e10_file_names", r"SELECT DISTINCT source_dataset, regexp_replace(regexp_replace(source_dataset, '[^\p{L}\p{N}_.\-]', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM generalization_mix")
def e10(spark, d):
    return mix(spark, d).select("source_dataset", text.file_safe(F.col("source_dataset")).alias("name")).distinct()


@query("e11_delimiter", f"{SQL} SELECT id, trim(regexp_replace(replace(replace(hyp, ' ', '|'), '|', ' '), ' +', ' ', 'g')) AS t FROM hyps WHERE system = 'ctc_wide'")
def e11(spark, d):
    piped = F.translate("hyp", " ", "|")
    return hyps(spark, d).filter("system = 'ctc_wide'").select("id", text.ctc_text(piped).alias("t"))


@query("e12_sentences", r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?;])\s+', E'\\1\n', 'g'), '\n+'), lambda s: trim(s) <> ''))::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def e12(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(text.sentence_split(F.col("text"))).cast("bigint").alias("n"))


@query(
    "e13_stitch",
    f"{SQL}, w AS (SELECT id, system, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS w FROM hyps), s AS (SELECT id, system, w[1:len(w) // 2 + 3] AS l, w[greatest(len(w) // 2, 1):] AS r FROM w), "
    "k AS (SELECT *, list_transform(l, lambda x: regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS lk, list_transform(r, lambda x: regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS rk FROM s), "
    "n AS (SELECT *, coalesce(list_max(list_filter(range(2, least(25, len(l), len(r)) + 1), lambda n: lk[len(lk) - n + 1:len(lk)] = rk[1:n])), 0) AS n FROM k) SELECT id, system, array_to_string(list_concat(l, r[n + 1:]), ' ') AS t FROM n",
)
def e13(spark, d):
    """Two overlapping parts of every text as one again."""
    w = hyps(spark, d).select("id", "system", text.tokens(F.col("hyp")).alias("w"))
    left, right = F.slice("w", F.lit(1), F.expr("size(w) div 2 + 3").cast("int")), F.slice("w", F.greatest(F.expr("size(w) div 2"), F.lit(1)).cast("int"), F.greatest(F.size("w"), F.lit(1)))
    return w.select("id", "system", F.array_join(text.stitch(left, right), " ").alias("t"))


@query(
    "e14_windows",
    "WITH p AS (SELECT row_no, duration, unnest(range(0, CASE WHEN duration <= 4 THEN 1 ELSE ceil((duration - 4) / 3)::BIGINT + 1 END)) AS i FROM prepared_rows WHERE duration > 0) SELECT row_no, (i * 3)::DOUBLE AS start, least(i * 3 + 4.0, duration) AS \"end\" FROM p",
)
def e14(spark, d):
    rows = table(spark, d, "prepared_rows").filter("duration > 0")
    return rows.select("row_no", F.explode(text.window_plan(F.col("duration"), 4.0, 1.0)).alias("w")).select("row_no", "w.*")


_BARE = lambda c: _COLLAPSE(rf"regexp_replace({c}, '\p{{P}}', '', 'g')")


@query("e16_probes", f"WITH n AS (SELECT row_no, coalesce(text, '') AS t FROM lm_text) SELECT row_no, t AS raw, lower(t) AS lower, {_BARE('t')} AS no_punct, {_BARE('lower(t)')} AS lower_no_punct FROM n")
def e16(spark, d):
    t = F.coalesce("text", F.lit(""))
    return lm(spark, d).select("row_no", *[f(t).alias(k) for k, f in text.PROBES.items()])


@query("e17_rates", rf"SELECT row_no, CASE WHEN duration > 0 THEN round(length(coalesce(transcription, '')) / duration, 9) ELSE 0 END AS cps, CASE WHEN duration > 0 THEN round(len(list_filter(string_split_regex(coalesce(transcription, ''), '{_WS}'), lambda w: w <> '')) / duration, 9) ELSE 0 END AS wps FROM generalization_mix")
def e17(spark, d):
    t = F.coalesce("transcription", F.lit(""))
    rate = lambda a: F.round(text.rate(a, F.coalesce("duration", F.lit(0.0))), 9)
    return mix(spark, d).select("row_no", rate(F.length(t)).alias("cps"), rate(F.size(text.tokens(t))).alias("wps"))


@query("e18_compression")
def e18(spark, d):
    return hyps(spark, d).select("id", "system", F.round(text.compression_ratio("hyp"), 9).alias("ratio"))


@query("e19_hashes", "SELECT row_no, sha256(transcription) AS h, ('0x' || substr(sha1(id), 1, 8))::BIGINT % 5 AS fold FROM generalization_mix WHERE transcription IS NOT NULL")
def e19(spark, d):
    return mix(spark, d).filter("transcription IS NOT NULL").select("row_no", F.sha2("transcription", 256).alias("h"), text.stable_fold(F.col("id"), 5).alias("fold"))


# ---- shape ------------------------------------------------------------------------------------------------------

_W = "list_filter(string_split(lower(hyp), ' '), lambda w: w <> '')"
_RUN = lambda w: f"list_max(list_transform(range(1, len({w}) + 1), lambda i: list_max(list_filter(range(1, len({w}) - i + 2), lambda k: len(list_distinct({w}[i:i + k - 1])) = 1))))"


@query("f1_blank_kinds", r"""SELECT row_no, trim(coalesce(target, '')) = '' AS empty, regexp_full_match(trim(coalesce(target, '')), '\.+') AS dots, regexp_full_match(trim(coalesce(target, '')), '[\s.,!?;:''"()\[\]{}\-_/\\|]+') AS punctuation FROM zoo_predictions""")
def f1(spark, d):
    t = F.col("target")
    return table(spark, d, "zoo_predictions").select("row_no", shape.is_empty(t).alias("empty"), shape.is_dots(t).alias("dots"), shape.is_punctuation(t).alias("punctuation"))


@query("f2_token_run", f"{SQL}, w AS (SELECT id, system, {_W} AS w FROM hyps) SELECT id, system, coalesce({_RUN('w')}, 0)::BIGINT AS run FROM w")
def f2(spark, d):
    return hyps(spark, d).select("id", "system", shape.token_run(F.col("hyp")).cast("bigint").alias("run"))


@query("f3_adjacent_repeat", f"{SQL}, w AS (SELECT id, system, {_W} AS w FROM hyps) SELECT id, system, len(w) >= 6 AND len(list_filter(range(1, len(w) - 4), lambda i: w[i:i + 2] = w[i + 3:i + 5])) > 0 AS repeats FROM w")
def f3(spark, d):
    return hyps(spark, d).select("id", "system", shape.repeats_at_once(text.tokens(F.lower("hyp"))).alias("repeats"))


_KEYS = "list_filter(list_transform(string_split(hyp, ' '), lambda w: regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '')"
_GRAMS = lambda n: f"list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"


@query("f4_repeated_anywhere", f"{SQL}, w AS (SELECT id, system, {_KEYS} AS w FROM hyps), g AS (SELECT id, system, {_GRAMS(3)} AS g FROM w) SELECT id, system, coalesce(list_max(map_values(list_histogram(g))), 0) >= 3 AS repeated FROM g")
def f4(spark, d):
    return hyps(spark, d).select("id", "system", (shape.ngram_top(shape.said_words(F.col("hyp")), 3) >= 3).alias("repeated"))


@query("f5_ngram_top", f"{SQL}, w AS (SELECT id, system, {_KEYS} AS w FROM hyps) SELECT id, system, " + ", ".join(f"coalesce(list_max(map_values(list_histogram({_GRAMS(n)}))), 0)::BIGINT AS top{n}" for n in (1, 2, 4)) + " FROM w")
def f5(spark, d):
    w = shape.said_words(F.col("hyp"))
    return hyps(spark, d).select("id", "system", *[shape.ngram_top(w, n).cast("bigint").alias(f"top{n}") for n in (1, 2, 4)])


@query("f6_repeated_share", f"{SQL}, w AS (SELECT id, system, {_KEYS} AS w FROM hyps), g AS (SELECT id, system, {_GRAMS(2)} AS g FROM w) SELECT id, system, CASE WHEN len(g) = 0 THEN 0 ELSE round(1 - len(list_distinct(g)) / len(g), 9) END AS share FROM g")
def f6(spark, d):
    return hyps(spark, d).select("id", "system", F.round(shape.repeated_share(shape.said_words(F.col("hyp")), 2), 9).alias("share"))


@query("f7_char_run", f"{SQL}, c AS (SELECT id, system, hyp, string_split(hyp, '') AS c FROM hyps), k AS (SELECT id, system, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM c), b AS (SELECT *, x = ' ' OR x IS DISTINCT FROM lag(x) OVER (PARTITION BY id, system ORDER BY i) AS begins FROM k), r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY id, system ORDER BY i) AS r FROM b), n AS (SELECT id, system, r, count(*) FILTER (x <> ' ' AND x <> '') AS n FROM r GROUP BY ALL) SELECT h.id, h.system, coalesce(max(n), 0)::BIGINT AS run FROM hyps h LEFT JOIN n ON h.id = n.id AND h.system = n.system GROUP BY ALL")
def f7(spark, d):
    return hyps(spark, d).select("id", "system", shape.char_run(F.col("hyp")).cast("bigint").alias("run"))


_HEALTH = f"""{SQL}, base AS (SELECT h.*, split_part(h.id, '_', 1) AS language, r.ref, median(length(hyp)) OVER (PARTITION BY split_part(h.id, '_', 1)) AS med, {_W} AS w FROM hyps h LEFT JOIN refs r ON h.id = r.id WHERE system = 'ctc_wide'),
runs AS (SELECT *, coalesce({_RUN('w')}, 0) AS run FROM base)
SELECT id, list_filter([CASE WHEN hyp = '' THEN 'empty' END, CASE WHEN regexp_full_match(hyp, '\\.+') THEN 'dot_only' END, CASE WHEN length(hyp) <= 4 THEN 'length_le_threshold' END, CASE WHEN len(w) < 2 THEN 'fewer_than_min_words' END,
 CASE WHEN regexp_full_match(hyp, '[\\s.,!?;:''"()\\[\\]{{}}\\-_/\\\\|]+') THEN 'punctuation_only' END, CASE WHEN run >= 3 THEN 'repeated_token_collapse' END, CASE WHEN len(w) >= 6 AND len(list_filter(range(1, len(w) - 4), lambda i: w[i:i + 2] = w[i + 3:i + 5])) > 0 THEN 'repeated_ngram' END,
 CASE WHEN length(ref) > 0 AND length(hyp) < 0.20 * length(ref) THEN 'low_reference_ratio' END, CASE WHEN med > 0 AND length(hyp) < 0.15 * med THEN 'low_language_median_ratio' END], lambda x: x IS NOT NULL) AS reasons FROM runs"""


@query("f8_health", _HEALTH)
def f8(spark, d):
    base = hyps(spark, d).filter("system = 'ctc_wide'").join(refs(spark, d).select("id", "ref"), "id", "left")
    base = shape.with_language_median(base, "hyp", text.id_language(F.col("id")))
    return base.select("id", shape.health_reasons(F.col("hyp"), F.col("ref"), F.col("med")).alias("reasons"))


@query(
    "f9_usable",
    f"""{SQL}, b AS (SELECT h.id, hyp, split_part(h.id, '_', 1) AS language, ref, {_W} AS w FROM hyps h LEFT JOIN refs r ON h.id = r.id WHERE system = 'seq_large'), f AS (SELECT *, coalesce({_RUN('w')}, 0) >= 3 AS looped FROM b)
SELECT id, hyp = '' OR length(hyp) <= 3 OR regexp_full_match(hyp, '[\\s.,!?;:''"()\\[\\]{{}}\\-_/\\\\|]+') OR looped AS severe,
 hyp = '' OR length(hyp) <= 3 OR regexp_full_match(hyp, '[\\s.,!?;:''"()\\[\\]{{}}\\-_/\\\\|]+') OR looped OR (language IN ('lin', 'sna') AND (length(hyp) < 12 OR len(w) <= 2 OR coalesce(length(ref) > 0 AND length(hyp) < 0.20 * length(ref), false))) AS bad FROM f""",
)
def f9(spark, d):
    base = hyps(spark, d).filter("system = 'seq_large'").join(refs(spark, d).select("id", "ref"), "id", "left")
    found = shape.usable_reasons(F.col("hyp"), text.id_language(F.col("id")), F.col("ref"))
    return base.withColumn("r", found).select("id", F.arrays_overlap("r", F.array(*[F.lit(x) for x in shape.SEVERE])).alias("severe"), (F.size("r") > 0).alias("bad"))


@query("f10_length_kinds", f"{SQL} SELECT system, count(*) FILTER (length(hyp) < 12 OR len(list_filter(string_split(hyp, ' '), lambda w: w <> '')) < 3) AS n_short, count(*) FILTER (length(hyp) > 120 OR len(list_filter(string_split(hyp, ' '), lambda w: w <> '')) > 20) AS n_long FROM hyps GROUP BY system")
def f10(spark, d):
    return hyps(spark, d).groupBy("system").agg(F.count_if(shape.very_short(F.col("hyp"))).alias("n_short"), F.count_if(shape.very_long(F.col("hyp"), 120, 20)).alias("n_long"))


@query("f11_medians", f"{SQL} SELECT split_part(id, '_', 1) AS language, median(length(hyp))::DOUBLE AS med FROM hyps WHERE system = 'seq_large' GROUP BY 1")
def f11(spark, d):
    return hyps(spark, d).filter("system = 'seq_large'").groupBy(text.id_language(F.col("id")).alias("language")).agg(F.median(F.length(F.trim("hyp"))).alias("med"))


@query("f12_degenerate", f"{SQL} SELECT id, system FROM hyps WHERE length(replace(replace(hyp, '.', ''), ' ', '')) < 3")
def f12(spark, d):
    return hyps(spark, d).filter(shape.degenerate(F.col("hyp"))).select("id", "system")


@query("d20_prediction_summary", f"{SQL}, b AS (SELECT system, length(hyp) AS n, hyp = '' AS e, length(hyp) < 12 OR len(list_filter(string_split(hyp, ' '), lambda w: w <> '')) < 3 AS s FROM hyps) SELECT coalesce(system, 'overall') AS system, count(*) AS n, count(*) FILTER (e) AS n_empty, count(*) FILTER (s) AS n_short, quantile_cont(n, 0.5)::DOUBLE AS median_chars, quantile_cont(n, 0.95)::DOUBLE AS p95_chars FROM b GROUP BY ROLLUP (system)")
def d20(spark, d):
    from ..operators.audit import linear_quantile, with_overall

    h = hyps(spark, d).withColumn("n_chars", F.length("hyp"))
    flags = [F.count(F.lit(1)).alias("n"), F.count_if(shape.is_empty(F.col("hyp"))).alias("n_empty"), F.count_if(shape.very_short(F.col("hyp"))).alias("n_short")]
    return with_overall(h, "system", *flags, linear_quantile("n_chars", 0.5).alias("median_chars"), linear_quantile("n_chars", 0.95).alias("p95_chars"))
