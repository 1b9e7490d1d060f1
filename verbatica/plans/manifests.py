"""Queries on quality buckets, manifests and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wave
from ..functions.shape import is_dots, is_empty, is_punctuation, reasons
from ..functions.text import collapse_space, id_language, normalize, tokens
from ..operators import manifest, scoring
from ..operators.audit import count_by, deciles
from ..session import table
from .basic import lm, mix, prepared
from .registry import query
from .scores import of, pairs
from .views import PAIRS_SQL, SQL, hyps, rate_sql, system

_A = "coalesce(audio.array, [])::DOUBLE[]"


def waves(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, a, sr): samples as doubles and their rate."""
    return prepared(spark, d).select("row_no", wave.samples(F.col("audio.array")).alias("a"), F.coalesce("audio.sampling_rate", F.lit(0)).alias("sr"))


def _rms(a: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN sqrt(list_sum(list_transform({a}, lambda x: x * x)) / len({a})) ELSE 0 END"


_WAVES = f"WITH w AS (SELECT row_no, {_A} AS a, coalesce(audio.sampling_rate, 0) AS sr FROM prepared_rows)"


@query("k1_mono", f"{_WAVES} SELECT row_no, list_transform(a, lambda x: (0.0::DOUBLE + x + x * 0.5::DOUBLE) / 2) AS m FROM w WHERE len(a) > 2")
def k1(spark, d):
    two = F.array(F.col("a"), F.transform("a", lambda x: x * 0.5))
    return waves(spark, d).filter("size(a) > 2").select("row_no", wave.mono(two).alias("m"))


@query("k2_duration", f"{_WAVES} SELECT row_no, CASE WHEN sr > 0 THEN len(a) / sr ELSE 0 END AS seconds FROM w")
def k2(spark, d):
    return waves(spark, d).select("row_no", wave.seconds(F.col("a"), F.col("sr")).alias("seconds"))


@query("k3_peak_normalize", f"{_WAVES}, p AS (SELECT *, coalesce(list_max(list_transform(a, lambda x: abs(x))), 0) AS p FROM w) SELECT row_no, CASE WHEN p > 0 THEN list_transform(a, lambda x: x / p * 0.95::DOUBLE) ELSE a END AS n FROM p")
def k3(spark, d):
    return waves(spark, d).select("row_no", wave.peak_normalize(F.col("a")).alias("n"))


@query("k4_light_trim", f"{_WAVES}, i AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: abs(a[i]) > 0.05) AS i FROM w) SELECT row_no, len(CASE WHEN len(i) = 0 THEN a ELSE a[greatest(i[1] - 1, 1):least(i[-1] + 1, len(a))] END) AS n FROM i")
def k4(spark, d):
    return waves(spark, d).select("row_no", F.size(wave.light_trim(F.col("a"), 0.05, 1)).cast("bigint").alias("n"))


@query("k5_basic_stats", f"{_WAVES} SELECT row_no, len(a) AS n_samples, round(coalesce(list_max(list_transform(a, lambda x: abs(x))), 0), 9) AS peak, round({_rms('a')}, 9) AS rms, len(a) = 0 OR {_rms('a')} < 1e-5 AS is_silent FROM w")
def k5(spark, d):
    s = wave.basic_stats(F.col("a"), F.col("sr"))
    return waves(spark, d).select("row_no", s.alias("s")).select("row_no", F.col("s.n_samples").cast("bigint").alias("n_samples"), F.round("s.peak", 9).alias("peak"), F.round("s.rms", 9).alias("rms"), "s.is_silent")


#: The test waveforms have a few samples: frames of 0.125 ms are two samples at 16 kHz.
_MS = 0.125
_FRAMES = f"{_WAVES}, f AS (SELECT *, greatest(1, floor(sr * {_MS} / 1000.0))::BIGINT AS f FROM w), r AS (SELECT *, CASE WHEN len(a) = 0 THEN [0.0::DOUBLE] WHEN len(a) < f THEN [{_rms('a')}] ELSE list_transform(range(1, len(a) - f + 2, f), lambda s: sqrt(list_sum(list_transform(a[s:s + f - 1], lambda x: x * x)) / f)) END AS r FROM f)"


@query("k6_frame_rms", f"{_FRAMES} SELECT row_no, list_transform(r, lambda x: round(x, 9)) AS r FROM r")
def k6(spark, d):
    frames = wave.frame_rms(F.col("a"), wave.frame_size(F.col("sr"), _MS))
    return waves(spark, d).select("row_no", F.transform(frames, lambda x: F.round(x, 9)).alias("r"))


@query(
    "k7_extended_stats",
    f"{_FRAMES}, v AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: r[i] >= 0.06) AS i FROM r) SELECT row_no, CASE WHEN len(a) = 0 THEN 1 ELSE round(1 - len(i) / len(r), 9) END AS silence_ratio, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_filter(a, lambda x: abs(x) > 0.99)) / len(a), 9) END AS clipping_ratio, "
    f"round(CASE WHEN len(a) = 0 THEN 0 WHEN len(i) = 0 THEN len(r) * {_MS} / 1000.0 ELSE (i[1] - 1) * {_MS} / 1000.0 END, 12) AS leading_silence, round(CASE WHEN len(a) = 0 THEN 0 WHEN len(i) = 0 THEN len(r) * {_MS} / 1000.0 ELSE (len(r) - i[-1]) * {_MS} / 1000.0 END, 12) AS trailing_silence FROM v",
)
def k7(spark, d):
    s = wave.extended_stats(F.col("a"), F.col("sr"), _MS, 0.06)
    return waves(spark, d).select("row_no", *[F.round(s[c], 9).alias(c) for c in ("silence_ratio", "clipping_ratio")], *[F.round(s[c], 12).alias(c) for c in ("leading_silence", "trailing_silence")])


@query(
    "k8_trim_edges",
    f"{_FRAMES}, l AS (SELECT *, list_max(r) AS top, greatest(list_max(r) * power(10.0, -6.0 / 20.0), 1e-4) AS lim FROM r), v AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: r[i] >= lim) AS i FROM l), e AS (SELECT *, len(a) = 0 OR len(i) = 0 OR top < 1e-4 AS e FROM v), "
    f"c AS (SELECT *, CASE WHEN e THEN 0 ELSE greatest((i[1] - 1) * f - floor(sr * 0.0625 / 1000.0), 0) END AS s, CASE WHEN e THEN len(a) ELSE least(i[-1] * f + floor(sr * 0.0625 / 1000.0), len(a)) END AS t FROM e) SELECT row_no, (t - s)::BIGINT AS n, CASE WHEN e THEN 'likely_empty_audio' WHEN s > 0 OR t < len(a) THEN 'cleaned_ok' ELSE 'unchanged' END AS status FROM c",
)
def k8(spark, d):
    t = wave.trim_edges(F.col("a"), F.col("sr"), 6.0, 0.0625, _MS)
    return waves(spark, d).select("row_no", F.size(t["trimmed"]).cast("bigint").alias("n"), t["status"].alias("status"))


@query("k9_usable", f"{_WAVES} SELECT row_no, CASE WHEN len(a) = 0 THEN 'empty' WHEN CASE WHEN sr > 0 THEN len(a) / sr ELSE 0 END < 0.0002 THEN 'too_short' WHEN {_rms('a')} < 0.05 THEN 'silent' ELSE 'ok' END AS status FROM w")
def k9(spark, d):
    return waves(spark, d).select("row_no", wave.usable(F.col("a"), F.col("sr"), 0.0002, 0.05).alias("status"))


@query(
    "k10_hop_silence",
    f"{_WAVES}, f AS (SELECT *, greatest(1, floor(sr * 0.1875 / 1000.0))::BIGINT AS f, greatest(1, floor(sr * 0.0625 / 1000.0))::BIGINT AS h, greatest(1e-4, 0.10 * {_rms('a')}) AS lim FROM w), r AS (SELECT *, CASE WHEN len(a) < f THEN [{_rms('a')}] ELSE list_transform(range(1, len(a) - f + 2, h), lambda s: sqrt(list_sum(list_transform(a[s:s + f - 1], lambda x: x * x)) / f)) END AS r FROM f) "
    "SELECT row_no, CASE WHEN len(a) = 0 THEN 1 ELSE round(len(list_filter(r, lambda x: x < lim)) / len(r), 9) END AS ratio FROM r",
)
def k10(spark, d):
    return waves(spark, d).select("row_no", F.round(wave.hop_silence(F.col("a"), F.col("sr"), 0.1875, 0.0625), 9).alias("ratio"))


@query(
    "k12_frame_tokens",
    f"{_WAVES}, t AS (SELECT row_no, list_transform(a, lambda x: floor(abs(x) * 20)::BIGINT) AS i, list_transform(a, lambda x: abs(x)) AS p FROM w) SELECT row_no, len(i) AS num_frames, CASE WHEN len(i) > 0 THEN round(len(list_filter(i, lambda x: x = 0)) / len(i), 9) ELSE 0 END AS blank_ratio, CASE WHEN len(i) > 0 THEN round(len(list_filter(range(2, len(i) + 1), lambda k: i[k] = i[k - 1])) / len(i), 9) ELSE 0 END AS repeated_frame_ratio, "
    "CASE WHEN len(p) > 0 THEN round(list_sum(p) / len(p), 9) ELSE 0 END AS mean_max_probability, coalesce(round(list_min(p), 9), 0) AS min_max_probability, coalesce(round(list_max(p), 9), 0) AS max_max_probability FROM t",
)
def k12(spark, d):
    t = waves(spark, d).select("row_no", F.transform("a", lambda x: F.floor(F.abs(x) * 20)).alias("i"), F.transform("a", F.abs).alias("p"))
    s = wave.frame_tokens(F.col("i"), F.col("p"), 0)
    return t.select("row_no", s["num_frames"].cast("bigint").alias("num_frames"), *[F.round(v, 9).alias(k) for k, v in s.items() if k != "num_frames"])


@query("k13_mean_pool", f"{_WAVES} SELECT row_no, list_transform(a, lambda x: (0.0::DOUBLE + x + 2 * x) / 2) AS m FROM w WHERE len(a) > 0")
def k13(spark, d):
    frames = F.array(F.col("a"), F.transform("a", lambda x: 2 * x), F.transform("a", lambda x: 100 * x))
    return waves(spark, d).filter("size(a) > 0").select("row_no", wave.mean_pool(frames, F.lit(2)).alias("m"))


# ---- buckets ----------------------------------------------------------------------------------------------------

_Q = f"""WITH q0 AS (SELECT row_no, id, coalesce(nullif(language, ''), split_part(id, '_', 1)) AS language, speaker_id, lower(trim(original_split)) AS split, trim(regexp_replace(coalesce(transcription, ''), '[\\s\\p{{Z}}]+', ' ', 'g')) AS text, coalesce(duration, 0) AS duration, {_A} AS a FROM prepared_rows),
q AS (SELECT *, round({_rms('a')}, 9) AS rms, round(coalesce(list_max(list_transform(a, lambda x: abs(x))), 0), 9) AS peak, CASE WHEN len(a) > 0 THEN round(len(list_filter(a, lambda x: abs(x) > 0.15)) / len(a), 9) ELSE 0 END AS clipping, CASE WHEN len(a) > 0 THEN round(len(list_filter(a, lambda x: abs(x) < 0.05)) / len(a), 9) ELSE 1 END AS silence, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words FROM q0)"""


def quality(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, id, language, speaker_id, split, text, duration, rms, peak, clipping, silence) of every recording."""
    a = F.col("a")
    rows = prepared(spark, d).select(
        "row_no", "id", F.coalesce(F.nullif("language", F.lit("")), id_language(F.col("id"))).alias("language"), "speaker_id", F.lower(F.trim("original_split")).alias("split"),
        collapse_space(F.coalesce("transcription", F.lit(""))).alias("text"), F.coalesce("duration", F.lit(0.0)).alias("duration"), wave.samples(F.col("audio.array")).alias("a"),
    )
    silence = F.when(F.size(a) == 0, 1.0).otherwise(wave.share(a, lambda x: F.abs(x) < 0.05))
    return rows.withColumns({"rms": F.round(wave.rms(a), 9), "peak": F.round(wave.peak(a), 9), "clipping": F.round(wave.share(a, lambda x: F.abs(x) > 0.15), 9), "silence": F.round(silence, 9)}).drop("a")


_CPS, _WPS = "CASE WHEN duration > 0 THEN length(text) / duration ELSE 0 END", "CASE WHEN duration > 0 THEN words / duration ELSE 0 END"
_AFLAGS = f"""list_filter([CASE WHEN duration < 0.30 THEN 'too_short' END, CASE WHEN duration > 30 THEN 'too_long' END, CASE WHEN rms < 0.003 OR peak < 0.02 THEN 'low_energy' END, CASE WHEN clipping > 0.01 THEN 'clipped' END,
 CASE WHEN text <> '' AND duration > 0 AND ({_CPS} < 1.0 OR {_CPS} > 35.0 OR {_WPS} < 0.20 OR {_WPS} > 7.0) THEN 'text_rate_outlier' END, CASE WHEN text = '' AND coalesce(split, '') <> 'test' THEN 'empty_transcript' END], lambda x: x IS NOT NULL)"""


@query("j4_audio_flags", f"{_Q} SELECT row_no, {_AFLAGS} AS flags FROM q")
def j4(spark, d):
    return _flagged(spark, d).select("row_no", "flags")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    q = quality(spark, d)
    return q.withColumn("flags", manifest.audio_flags(F.col("text"), F.col("duration"), F.col("rms"), F.col("peak"), F.col("clipping"), F.col("split")))


@query(
    "j3_audio_text_flags",
    f"""{_Q} SELECT row_no, list_sort(list_filter([CASE WHEN text = '' THEN 'empty_transcript' END, CASE WHEN regexp_full_match(text, '[.,!?;:\\-]+') THEN 'punctuation_only_transcript' END, CASE WHEN duration <= 0.05 OR rms = 0 THEN 'empty_audio' END, CASE WHEN rms < 0.005 OR silence > 0.95 THEN 'likely_silent' END,
 CASE WHEN duration < 1.5 AND words > 8 THEN 'short_audio_long_transcript' END, CASE WHEN duration < 2 AND length(text) > 20 THEN 'short_audio_many_chars' END, CASE WHEN {_CPS} > 35 THEN 'chars_per_second_too_high' END, CASE WHEN {_CPS} > 0 AND {_CPS} < 2 AND duration > 4 THEN 'chars_per_second_too_low' END,
 CASE WHEN clipping > 0.05 THEN 'heavy_clipping' END, CASE WHEN ((rms < 0.005 OR silence > 0.95) AND length(text) > 10) OR (duration < 1.5 AND words > 8) OR {_CPS} > 35 THEN 'audio_transcript_mismatch' END], lambda x: x IS NOT NULL)) AS flags FROM q""",
)
def j3(spark, d):
    q = quality(spark, d)
    return q.select("row_no", manifest.audio_text_flags(F.col("text"), F.col("duration"), F.col("rms"), F.col("silence"), F.col("clipping")).alias("flags"))


@query(
    "j1_quality_buckets",
    f"""{_Q}, f AS (SELECT *, {_AFLAGS} AS flags, {_CPS} AS cps, {_WPS} AS wps FROM q) SELECT row_no, CASE WHEN text = '' THEN 'excluded' WHEN list_contains(flags, 'too_short') OR duration <= 0.05 THEN 'excluded' WHEN list_contains(flags, 'low_energy') AND silence >= 0.95 THEN 'excluded' WHEN clipping >= 0.05 THEN 'excluded' WHEN cps >= 70 OR wps >= 12 THEN 'excluded'
 WHEN list_has_any(flags, ['too_long', 'text_rate_outlier']) THEN 'noisy' WHEN list_has_any(flags, ['low_energy', 'clipped']) THEN 'medium' ELSE 'clean' END AS bucket FROM f""",
)
def j1(spark, d):
    from ..functions.text import rate

    q = _flagged(spark, d)
    d0 = F.col("duration")
    rows = q.withColumns({"cps": rate(F.length("text"), d0), "wps": rate(F.size(tokens(F.col("text"))), d0), "n_teachers": F.lit(0), "teacher_max": F.lit(None).cast("double"), "teacher_mean": F.lit(None).cast("double")})
    return manifest.quality_buckets(rows).select("row_no", "bucket")


@query(
    "j2_trimmed_buckets",
    f"""{_Q}, t AS (SELECT *, greatest(duration - 1.0, 0) AS d, CASE WHEN len(a) = 0 THEN 'likely_empty_audio' WHEN greatest(duration - 1.0, 0) < 0.3 THEN 'too_short_after_trim' ELSE 'cleaned_ok' END AS status FROM q), c AS (SELECT *, CASE WHEN d > 0 THEN length(text) / d ELSE 0 END AS cps, rms < 0.005 OR silence > 0.95 AS silent FROM t)
SELECT row_no, CASE WHEN text = '' OR status IN ('likely_empty_audio', 'too_short_after_trim') OR (d < 1.5 AND words > 8) OR cps > 35 OR (silent AND length(text) > 10) THEN 'excluded' WHEN silent OR clipping > 0.05 OR (cps > 25 AND cps <= 35) OR (d < 2 AND length(text) > 20) THEN 'noisy' WHEN (cps > 22 AND cps <= 25) OR duration - d > 0.5 * greatest(duration, 1e-6) THEN 'medium' ELSE 'clean' END AS bucket FROM c""",
)
def j2(spark, d):
    q = quality(spark, d)
    trimmed = F.greatest(F.col("duration") - 1.0, F.lit(0.0))
    status = F.when(F.col("peak") == 0, "likely_empty_audio").when(trimmed < 0.3, "too_short_after_trim").otherwise("cleaned_ok")
    rows = q.withColumns({"original_duration": F.col("duration"), "removed": F.col("duration") - trimmed, "status": status}).withColumn("duration", trimmed)
    return manifest.trimmed_buckets(rows).select("row_no", "bucket")


_TEACH = f"{PAIRS_SQL}, z AS (SELECT id, language, ref AS o, hyp AS t, 0.5 * {rate_sql('we', 'wn')} + 0.5 * {rate_sql('ce', 'cn')} AS c, 1.0 + length(ref) / 14.0 AS d FROM pairs WHERE system = 'ctc_wide'), y AS (SELECT *, length(t) / d AS cps, len(list_filter(string_split(t, ' '), lambda x: x <> '')) / d AS wps FROM z), p AS (SELECT *, length(t) >= 3 AND cps BETWEEN 2 AND 25 AND wps BETWEEN 0.25 AND 4.0 AS ok FROM y)"


def _taught(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.rates(of(pairs(spark, d), "ctc_wide"))
    return p.select("id", "language", F.col("ref").alias("original"), F.col("hyp").alias("teacher"), (1.0 + F.length("ref") / 14.0).alias("duration"), F.lit(0.0).alias("silence"), F.array().cast("array<string>").alias("flags"), "combined")


_ACTION = "CASE WHEN o = '' AND NOT ok THEN 'exclude' WHEN NOT ok THEN 'keep_original_review_teacher_implausible' WHEN o = '' THEN 'replace_empty_original_with_teacher' WHEN c <= 0.35 THEN 'keep_original_teacher_agrees' WHEN c >= 0.65 THEN 'replace_with_teacher_high_disagreement' ELSE 'review_moderate_disagreement' END"


@query("j5_clean_labels", f"{_TEACH}, a AS (SELECT *, {_ACTION} AS action FROM p) SELECT id, action, CASE WHEN action = 'exclude' THEN 'excluded' WHEN contains(action, 'review') THEN 'review' ELSE 'clean' END AS bucket, CASE WHEN action = 'exclude' THEN '' WHEN starts_with(action, 'replace') THEN t ELSE o END AS target FROM a")
def j5(spark, d):
    return manifest.clean_labels(_taught(spark, d)).select("id", "action", "bucket", "target")


@query("j6_replace_language", "SELECT row_no, language FROM generalization_mix WHERE original_split = 'train' AND language IS DISTINCT FROM 'lug' UNION ALL SELECT row_no, language FROM generalization_mix WHERE original_split = 'external_train' AND language = 'lug'")
def j6(spark, d):
    m = mix(spark, d).select("row_no", "language", "original_split")
    return manifest.replace_language(m.filter("original_split = 'train'"), m.filter("original_split = 'external_train' AND language = 'lug'"), "lug").select("row_no", "language")


_REC = "CASE WHEN c <= 0.35 THEN 'keep_original' WHEN c >= 0.85 THEN 'potential_teacher_correction' WHEN c >= 0.65 THEN 'suspicious_label' ELSE 'manual_review' END"


@query("j7_recommendation_buckets", f"{_TEACH}, r AS (SELECT {_REC} AS r FROM p) SELECT CASE r WHEN 'keep_original' THEN 'clean' WHEN 'manual_review' THEN 'review' WHEN 'potential_teacher_correction' THEN 'clean' ELSE 'suspicious' END AS bucket, CASE r WHEN 'potential_teacher_correction' THEN 'teacher' ELSE 'original' END AS label_source, count(*) AS n FROM r GROUP BY ALL")
def j7(spark, d):
    r = _taught(spark, d).select(manifest.ladder((F.col("combined") <= 0.35, "keep_original"), (F.col("combined") >= 0.85, "potential_teacher_correction"), (F.col("combined") >= 0.65, "suspicious_label"), otherwise="manual_review").alias("r"))
    bucket, source = manifest.recommendation_buckets(F.col("r"), allow_corrections=True)
    return r.select(bucket.alias("bucket"), source.alias("label_source")).groupBy("bucket", "label_source").agg(F.count(F.lit(1)).alias("n"))


@query("j8_standardize", "SELECT 'lm_' || source || '_' || row_no AS id, transcription, language, 'lm_text' AS source_dataset, 'open' AS source_license, -1.0::DOUBLE AS duration FROM (SELECT row_no, source, coalesce(transcription, '') AS transcription, coalesce(language, '') AS language FROM lm_text) WHERE trim(transcription) <> ''")
def j8(spark, d):
    rows = lm(spark, d).withColumn("id", F.concat_ws("_", "source", "row_no"))
    return manifest.standardize(rows, "lm_", source_dataset="lm_text", source_license="open").select("id", "transcription", "language", "source_dataset", "source_license", "duration")


@query("j9_align_columns", "SELECT id, NULL::VARCHAR AS audio, coalesce(target, '') AS transcription, coalesce(language, '') AS language, '' AS original_split, -1.0::DOUBLE AS duration, '' AS source_dataset, '' AS source_split, '' AS source_language, 'unknown' AS source_license, 'unknown' AS source_risk FROM zoo_references")
def j9(spark, d):
    return manifest.align_columns(table(spark, d, "zoo_references").withColumnRenamed("target", "Transcription"), manifest.MIX)


@query(
    "j10_union_sources",
    "WITH a AS (SELECT 'train' AS source, row_no FROM generalization_mix WHERE original_split = 'train' ORDER BY sha1('9|' || row_no), row_no LIMIT 150), b AS (SELECT 'external' AS source, row_no FROM generalization_mix WHERE original_split = 'external_train') SELECT source, row_no, sha1('9|' || row_no) AS shuffle_key FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
)
def j10(spark, d):
    m = mix(spark, d)
    pick = lambda s: m.filter(F.col("original_split") == s).select("row_no")
    return manifest.union_sources({"train": pick("train"), "external": pick("external_train")}, {"train": 150}, 9, "row_no").select("source", "row_no", "shuffle_key")


_PL = f"{SQL}, p AS (SELECT a.id, lower(trim(a.hyp)) AS g, lower(trim(b.hyp)) AS b, 1.0 + length(b.hyp) / 14.0 AS d FROM hyps a JOIN hyps b ON a.id = b.id WHERE a.system = 'ctc_small' AND b.system = 'ctc_wide'), s AS (SELECT *, levenshtein(g, b) / greatest(length(b), 1) AS dis, length(b) / greatest(d, 0.1) AS r FROM p), o AS (SELECT *, CASE WHEN b = '' THEN 'empty' WHEN dis > 0.10 THEN 'disagreement' WHEN r NOT BETWEEN 4 AND 25 THEN 'rate' WHEN len(list_filter(string_split(b, ' '), lambda w: w <> '')) < 3 THEN 'short' ELSE 'kept' END AS outcome FROM s)"


def _pseudo(spark: SparkSession, d: str) -> DataFrame:
    a = system(spark, d, "ctc_small").withColumnRenamed("hyp", "greedy")
    b = system(spark, d, "ctc_wide").withColumnRenamed("hyp", "beam")
    return manifest.filter_pseudo_labels(a.join(b, "id").withColumn("duration", 1.0 + F.length("beam") / 14.0))


@query("j11_pseudo_labels", f"{_PL} SELECT split_part(id, '_', 1) AS language, outcome, count(*) AS n FROM o GROUP BY ALL")
def j11(spark, d):
    return count_by(_pseudo(spark, d).withColumn("language", id_language(F.col("id"))), "language", "outcome")


@query("d17_deciles", f"{_PL} SELECT least(floor(dis * 10), 9)::INT AS decile, count(*) AS n FROM o WHERE b <> '' GROUP BY 1")
def d17(spark, d):
    return deciles(_pseudo(spark, d).filter("outcome <> 'empty'"), F.col("disagreement"))


_N = lambda c: rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\p{{P}}', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


@query(
    "j12_corpus",
    f"WITH a AS (SELECT language, {_N('transcription')} AS text, row_no AS o, 0 AS p, 'mix' AS source, 2 AS k FROM generalization_mix WHERE original_split = 'train'), b AS (SELECT language, {_N('transcription')} AS text, row_no AS o, 1 AS p, 'lm' AS source, 1 AS k FROM lm_text), b2 AS (SELECT * FROM b WHERE length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY language ORDER BY o) <= 100), "
    "u AS (SELECT * FROM a WHERE length(text) >= 10 UNION ALL SELECT * FROM b2), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY language, text ORDER BY p, o) = 1) SELECT language, text, source, unnest(range(1, k + 1))::INT AS copy FROM f",
)
def j12(spark, d):
    sources = [("mix", mix(spark, d).filter("original_split = 'train'"), 2, None), ("lm", lm(spark, d), 1, 100)]
    return manifest.assemble_corpus(sources, "transcription", "language", "row_no", 10, lambda c: normalize(c, "no_punct_lower"))


@query("j13_with_medium", "WITH u AS (SELECT id, row_no, 0 AS p FROM generalization_mix WHERE original_split = 'train' AND id IS NOT NULL UNION ALL SELECT id, row_no, 1 FROM prepared_rows WHERE original_split = 'train' AND id IS NOT NULL) SELECT id, row_no FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, row_no) = 1")
def j13(spark, d):
    pick = lambda df: df.filter("original_split = 'train' AND id IS NOT NULL").select("id", "row_no")
    return manifest.with_medium(pick(mix(spark, d)), pick(prepared(spark, d)), "id", "row_no")


def _flag(c):
    return reasons(empty=is_empty(c), dot_only=is_dots(c), punctuation_only=is_punctuation(c) & ~is_dots(c), very_short=~is_empty(c) & ((F.length(F.trim(c)) < 12) | (F.size(tokens(c)) <= 2)))


_FL = lambda t: f"({t} = '' OR regexp_full_match({t}, '[\\s.,!?;:''\"()\\[\\]{{}}\\-_/\\\\|]+') OR length({t}) < 12 OR len(list_filter(string_split({t}, ' '), lambda w: w <> '')) <= 2)"


@query(
    "j14_autopsy",
    f"{SQL}, b AS (SELECT id FROM hyps WHERE system = 'ctc_small' AND {_FL('hyp')}), s AS (SELECT DISTINCT id FROM hyps WHERE system <> 'ctc_small' AND hyp <> '' AND NOT {_FL('hyp')}), au AS (SELECT DISTINCT id, ('0x' || substr(sha1(id), 1, 2))::INT / 256.0::DOUBLE AS v FROM hyps) "
    "SELECT b.id, v < 0.1 OR v > 0.9 AS likely_silent, s.id IS NOT NULL AS sane_fallback, CASE WHEN v < 0.1 OR v > 0.9 THEN 'silent' WHEN s.id IS NOT NULL THEN 'rescuable' ELSE 'speech_without_fallback' END AS verdict FROM b JOIN au ON b.id = au.id LEFT JOIN s ON b.id = s.id",
)
def j14(spark, d):
    h = hyps(spark, d)
    v = F.conv(F.substring(F.sha1(F.col("id").cast("binary")), 1, 2), 16, 10).cast("int") / 256.0
    audio = h.select("id").distinct().select("id", (v * 4).alias("duration"), F.lit(0.1).alias("rms"), v.alias("silence"))
    texts = h.withColumnRenamed("hyp", "text")
    return manifest.autopsy(of(texts, "ctc_small"), audio, texts.filter("system <> 'ctc_small'"), _flag).select("id", "likely_silent", "sane_fallback", "verdict")


@query("d25_teachers", f"{PAIRS_SQL}, c AS (SELECT id, system, round(0.5 * {rate_sql('we', 'wn')} + 0.5 * {rate_sql('ce', 'cn')}, 9) AS combined FROM pairs WHERE system <> 'seq_large') SELECT id, count(*) AS n_teachers, min(combined) AS teacher_min, round(avg(combined), 6) AS teacher_mean, max(combined) AS teacher_max, arg_min(system, (combined, system)) AS best_teacher FROM c GROUP BY id")
def d25(spark, d):
    p = scoring.rates(pairs(spark, d)).filter("system <> 'seq_large'").select("id", F.col("system").alias("teacher"), F.col("system").alias("ord"), F.round("combined", 9).alias("combined"))
    return manifest.teacher_summary(p).withColumn("teacher_mean", F.round("teacher_mean", 6))


