"""Quality buckets and training manifests.

A ladder of rules is one expression; flags are arrays, joined only where a text file needs it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rate, tokens
from .relational import first_wins, seeded_order



def when_flags(**flags: Column) -> Column:
    """The names of the flags that hold, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull())


def ladder(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    for holds, value in reversed(rules):
        out = F.when(holds, F.lit(value)).otherwise(out)
    return out


# Limits of the buckets, flags and label rules.
BUCKET = {"severe_silence": 0.95, "severe_clipping": 0.05, "severe_cps": 70.0, "severe_wps": 12.0, "medium_teacher": 0.85, "clean_teacher": 0.55}
TRIM = {"rms": 0.005, "silence": 0.95, "short": 1.5, "short_words": 8, "short2": 2.0, "short2_chars": 20, "exclude_cps": 35.0, "noisy_cps": 25.0, "medium_cps": 22.0, "clipping": 0.05}
AUDIO = {"min": 0.30, "max": 30.0, "rms": 0.003, "peak": 0.02, "clipping": 0.01, "min_cps": 1.0, "max_cps": 35.0, "min_wps": 0.20, "max_wps": 7.0}
TEACHER = {"keep": 0.35, "replace": 0.65, "min_cps": 2.0, "max_cps": 25.0, "min_wps": 0.25, "max_wps": 4.0, "silence": 0.95, "min": 0.30, "max": 50.0}


def quality_buckets(rows: DataFrame, limits: dict[str, float] = BUCKET) -> DataFrame:
    """``bucket`` and ``reasons`` from (text, flags, duration, clipping, silence, cps, wps, n_teachers, teacher_max,
    teacher_mean); rows without measurements have null flags and count as having no duration."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    measured = F.col("flags").isNotNull()
    flags = F.when(measured, F.array_sort(F.array_distinct("flags"))).otherwise(F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    noted = F.when(measured, flags).otherwise(F.array(F.lit("missing_audio_quality")))
    broken = F.exists(flags, lambda f: f.contains("audio_error"))
    short = has("too_short") | (z("duration") <= 0.05)
    silent = has("low_energy") & (z("silence") >= limits["severe_silence"])
    clipped = z("clipping") >= limits["severe_clipping"]
    fast = (z("cps") >= limits["severe_cps"]) | (z("wps") >= limits["severe_wps"])
    taught = F.coalesce("n_teachers", F.lit(0)) > 0
    extreme = taught & (z("teacher_max") >= limits["medium_teacher"])
    moderate = taught & (z("teacher_mean") >= limits["clean_teacher"])
    noisy = has("too_long", "text_rate_outlier")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    bucket = ladder(
        (empty | broken | short | silent | clipped | fast, "excluded"), (extreme | noisy, "noisy"), (moderate | has("low_energy", "clipped") | ~measured, "medium"), otherwise="clean"
    )
    default = lambda name: F.when(F.size(noted) > 0, noted).otherwise(F.array(F.lit(name)))
    reasons = (
        F.when(empty, F.array(F.lit("empty_transcript"))).when(broken, noted).when(short, default("too_short")).when(silent, default("near_silent")).when(clipped, default("severe_clipping"))
        .when(fast, default("severe_text_audio_rate")).when(extreme, F.concat(noted, F.array(F.lit("extreme_teacher_disagreement")))).when(noisy, noted)
        .when(moderate, F.concat(noted, F.array(F.lit("moderate_teacher_disagreement")))).otherwise(noted)
    )
    return rows.withColumns({"bucket": bucket, "reasons": reasons})


def trimmed_buckets(rows: DataFrame, limits: dict[str, float] = TRIM) -> DataFrame:
    """``bucket`` and ``flags`` of trimmed audio (text, duration, original_duration, removed, rms, silence, clipping, status)."""
    t, d = F.coalesce("text", F.lit("")), F.col("duration")
    chars, words, status = F.length(t), F.size(tokens(t)), F.col("status")
    cps = rate(chars, d)
    silent = (F.col("rms") < limits["rms"]) | (F.col("silence") > limits["silence"])
    many = (d < limits["short2"]) & (chars > limits["short2_chars"])
    out = {
        "empty_transcript": chars == 0, "failed_decode": status == "failed_decode", "likely_empty_audio": status == "likely_empty_audio", "too_short_after_trim": status == "too_short_after_trim",
        "short_audio_long_transcript": (d < limits["short"]) & (words > limits["short_words"]), "chars_per_second_unrealistic": cps > limits["exclude_cps"],
        "audio_transcript_mismatch": (silent | (status == "likely_empty_audio")) & (chars > 10),
    }
    excluded = reduce(lambda a, b: a | b, out.values())
    clipped, high = F.col("clipping") > limits["clipping"], (cps > limits["noisy_cps"]) & (cps <= limits["exclude_cps"])
    noisy = silent | clipped | high | many
    elevated, edges = (cps > limits["medium_cps"]) & (cps <= limits["noisy_cps"]), F.col("removed") > 0.5 * F.greatest(F.col("original_duration"), F.lit(1e-6))
    first = {k: out[k] for k in ("empty_transcript", "failed_decode", "likely_empty_audio", "too_short_after_trim")} | {"likely_silent": silent} | {
        "short_audio_long_transcript": out["short_audio_long_transcript"], "short_audio_many_chars": many, "chars_per_second_unrealistic": out["chars_per_second_unrealistic"], "audio_transcript_mismatch": out["audio_transcript_mismatch"],
    }
    later = {"heavy_clipping": clipped & ~excluded, "chars_per_second_high": high & ~excluded, "chars_per_second_elevated": elevated & ~excluded & ~noisy, "mostly_edge_silence": edges & ~excluded & ~noisy}
    return rows.withColumns({"bucket": ladder((excluded, "excluded"), (noisy, "noisy"), (elevated | edges, "medium"), otherwise="clean"), "flags": when_flags(**first, **later)})


def audio_text_flags(text: Column, duration: Column, rms: Column, silence: Column, clipping: Column) -> Column:
    """What does not fit between a transcript and its audio; sorted."""
    t = F.coalesce(text, F.lit(""))
    chars, words = F.length(t), F.size(tokens(t))
    cps = rate(chars, duration)
    silent, long, fast = (rms < 0.005) | (silence > 0.95), (duration < 1.5) & (words > 8), cps > 35.0
    flags = when_flags(
        empty_transcript=chars == 0, punctuation_only_transcript=F.trim(t).rlike(r"^[.,!?;:\-]+$"), empty_audio=(duration <= 0.05) | (rms == 0.0), likely_silent=silent,
        short_audio_long_transcript=long, short_audio_many_chars=(duration < 2.0) & (chars > 20), chars_per_second_too_high=fast, chars_per_second_too_low=(cps > 0) & (cps < 2.0) & (duration > 4.0),
        heavy_clipping=clipping > 0.05, audio_transcript_mismatch=(silent & (chars > 10)) | long | fast,
    )
    return F.array_sort(flags)


def audio_flags(text: Column, duration: Column, rms: Column, peak: Column, clipping: Column, split: Column, limits: dict[str, float] = AUDIO) -> Column:
    """Flags of one recording by its measurements; a missing transcript is one only outside the test split."""
    t, d = F.coalesce(text, F.lit("")), F.coalesce(duration, F.lit(0.0))
    cps, wps = rate(F.length(t), d), rate(F.size(tokens(t)), d)
    odd = (cps < limits["min_cps"]) | (cps > limits["max_cps"]) | (wps < limits["min_wps"]) | (wps > limits["max_wps"])
    return when_flags(
        too_short=d < limits["min"], too_long=d > limits["max"], low_energy=(rms < limits["rms"]) | (peak < limits["peak"]), clipped=clipping > limits["clipping"],
        text_rate_outlier=(t != "") & (d > 0) & odd, empty_transcript=(t == "") & (F.coalesce(split, F.lit("")) != "test"),
    )


def clean_labels(rows: DataFrame, mode: str = "high_disagreement", limits: dict[str, float] = TEACHER) -> DataFrame:
    """``bucket``, ``action`` and ``target`` from (original, teacher, duration, silence, flags, combined): whose label to trust.

    ``mode``: ``all_plausible`` takes every plausible teacher label, ``high_disagreement`` those far from the original,
    ``review_only`` none.
    """
    o, t = F.trim(F.coalesce("original", F.lit(""))), F.trim(F.coalesce("teacher", F.lit("")))
    d, c = F.coalesce("duration", F.lit(0.0)), F.col("combined")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    cps, wps = rate(F.length(t), d), rate(F.size(tokens(t)), d)
    off = (d > 0) & ((cps < limits["min_cps"]) | (cps > limits["max_cps"]) | (wps < limits["min_wps"]) | (wps > limits["max_wps"]))
    plausible = (F.length(t) >= 3) & ~off
    severe = F.col("flags").isNotNull() & ((o == "") | (d < limits["min"]) | (d > limits["max"]) | (F.array_contains(flags, "low_energy") & (F.coalesce("silence", F.lit(0.0)) >= limits["silence"])) | F.exists(flags, lambda f: f.startswith("audio_error")))
    far, near = c >= limits["replace"], c <= limits["keep"]
    action = ladder(
        (severe & ~((o == "") & plausible), "exclude"), (~plausible & (o != ""), "keep_original_review_teacher_implausible"), (~plausible, "exclude"), (o == "", "replace_empty_original_with_teacher"),
        (F.lit(mode == "all_plausible"), "replace_with_teacher_all_plausible"), (near, "keep_original_teacher_agrees"), (far & F.lit(mode == "high_disagreement"), "replace_with_teacher_high_disagreement"),
        (far, "review_high_disagreement"), otherwise="review_moderate_disagreement",
    )
    judged = rows.withColumn("action", action)
    a = F.col("action")
    bucket = F.when(a == "exclude", "excluded").when(a.contains("review"), "review").otherwise("clean")
    target = F.when(a == "exclude", "").when(a.startswith("replace"), F.col("teacher")).otherwise(F.col("original"))
    return judged.withColumns({"bucket": bucket, "target": target})


def replace_language(base: DataFrame, rows: DataFrame, language: str) -> DataFrame:
    """The base manifest with one language's rows exchanged."""
    return base.filter(~F.col("language").eqNullSafe(F.lit(language))).unionByName(rows, allowMissingColumns=True)


def recommendation_buckets(recommendation: Column, allow_corrections: bool = False, include_review: bool = False) -> tuple[Column, Column]:
    """(bucket, label source) of a recommendation."""
    correction = ("clean", "teacher") if allow_corrections else ("suspicious", "original")
    table = {"keep_original": ("clean", "original"), "manual_review": ("clean_review_included" if include_review else "review", "original"), "potential_teacher_correction": correction, "suspicious_label": ("suspicious", "original")}
    pick = lambda i, other: F.coalesce(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[recommendation], F.lit(other))
    return pick(0, "excluded"), pick(1, "original")


MIX = {
    "id": ("string", ""), "audio": ("string", None), "transcription": ("string", ""), "language": ("string", ""), "original_split": ("string", ""), "duration": ("double", -1.0),
    "source_dataset": ("string", ""), "source_split": ("string", ""), "source_language": ("string", ""), "source_license": ("string", "unknown"), "source_risk": ("string", "unknown"),
}


def align_columns(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """The columns of a schema in its order: others dropped, missing ones and nulls by their defaults."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda c, kind, default: F.coalesce(F.col(f"`{have[c.lower()]}`").cast(kind), F.lit(default).cast(kind)) if c.lower() in have else F.lit(default).cast(kind)
    return df.select(*[pick(c, kind, default).alias(c) for c, (kind, default) in schema.items()])


def standardize(df: DataFrame, prefix: str, **provenance: str) -> DataFrame:
    """A source under the common contract: identifiers with a prefix, constants of its provenance, empty texts left out."""
    named = df.withColumns({k: F.lit(v) for k, v in provenance.items()}).withColumn("id", F.concat(F.lit(prefix), F.col("id")))
    return align_columns(named, MIX).filter(F.trim("transcription") != "")


def union_sources(sources: dict[str, DataFrame], caps: dict[str, int], seed: int, key: str = "id") -> DataFrame:
    """The sources with their caps, each capped by a seeded order; ``shuffle_key`` sorts the whole like a shuffle."""
    out = None
    for name, df in sources.items():
        part = df.withColumns({"source": F.lit(name), "shuffle_key": seeded_order(F.col(key), seed)})
        if name in caps:
            part = part.orderBy("shuffle_key", key).limit(caps[name])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def filter_pseudo_labels(rows: DataFrame, most: float = 0.10, low: float = 4.0, high: float = 25.0, least_words: int = 3) -> DataFrame:
    """``disagreement`` and ``outcome`` of (greedy, beam, duration): kept, or the first test that fails."""
    g, b = F.lower(F.trim(F.coalesce("greedy", F.lit("")))), F.lower(F.trim(F.coalesce("beam", F.lit(""))))
    d = F.levenshtein(g, b) / F.greatest(F.length(b), F.lit(1))
    r = F.length(b) / F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.1))
    outcome = ladder((b == "", "empty"), (d > most, "disagreement"), (~r.between(low, high), "rate"), (F.size(tokens(b)) < least_words, "short"), otherwise="kept")
    return rows.withColumns({"disagreement": F.when(b != "", d), "outcome": outcome})


def assemble_corpus(sources: list[tuple[str, DataFrame, int, int | None]], text: str, language: str, order: str, least_chars: int, norm) -> DataFrame:
    """(language, text, source, copy): texts of several sources under one normalization.

    ``sources``: name, rows, repeats, cap per language. A text is kept once a language, from the first source that has
    it; repeats are made of what is kept.
    """
    parts = None
    for place, (name, df, repeats, cap) in enumerate(sources):
        part = df.select(F.col(language).alias("language"), norm(F.col(text)).alias("text"), F.col(order).cast("bigint").alias("ord"), F.lit(place).alias("place"), F.lit(name).alias("source"), F.lit(repeats).alias("repeats"))
        part = part.filter(F.length("text") >= least_chars)
        if cap is not None:
            from .relational import first_per_group

            part = first_per_group(part, ["language"], cap, F.col("ord"))
        parts = part if parts is None else parts.unionByName(part)
    kept = first_wins(parts.withColumn("at", F.struct("place", "ord")), ["language", "text"], "at")
    return kept.select("language", "text", "source", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))


def with_medium(clean: DataFrame, medium: DataFrame, key: str, order: str) -> DataFrame:
    """Clean rows, and the medium ones whose key they lack."""
    both = clean.withColumn("__p", F.lit(0)).unionByName(medium.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return first_wins(both.withColumn("__o", F.struct("__p", order)), [key], "__o").drop("__p", "__o")


def autopsy(predictions: DataFrame, audio: DataFrame, fallbacks: DataFrame, flagged) -> DataFrame:
    """(id, reasons, likely_silent, sane_fallback, verdict) of flagged predictions (id, text) with their audio
    (id, duration, rms, silence) and the other systems' texts (id, text); ``flagged`` maps a text to reasons."""
    bad = predictions.withColumn("reasons", flagged(F.col("text"))).filter(F.size("reasons") > 0).select("id", "reasons")
    sane = fallbacks.filter((F.trim("text") != "") & (F.size(flagged(F.col("text"))) == 0)).select("id").distinct().withColumn("sane", F.lit(True))
    joined = bad.join(audio, "id").join(sane, "id", "left")
    silent = (F.col("rms") < 0.005) | (F.col("silence") > 0.9) | (F.col("duration") < 0.4)
    ok = F.coalesce("sane", F.lit(False))
    return joined.select("id", "reasons", silent.alias("likely_silent"), ok.alias("sane_fallback"), F.when(silent, "silent").when(ok, "rescuable").otherwise("speech_without_fallback").alias("verdict"))


def teacher_summary(scores: DataFrame) -> DataFrame:
    """(id, n_teachers, teacher_min, teacher_mean, teacher_max, best_teacher) of (id, teacher, ord, combined); the first
    of equally good teachers is the best."""
    return scores.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_teachers"), F.min("combined").alias("teacher_min"), F.avg("combined").alias("teacher_mean"), F.max("combined").alias("teacher_max"), F.min_by("teacher", F.struct("combined", "ord")).alias("best_teacher")
    )
