"""Queries on filters, samples, joins, counts and quantiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flag_set, id_language
from ..operators import audit, relational
from ..operators.skew import ranked
from ..session import shared_folder, table
from ..sources import io as sources
from .registry import query
from .views import SQL, hyps, plain, refs, sql_plain, system


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepared_rows").filter("row_no IS NOT NULL")


def mix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generalization_mix")


def lm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lm_text")


# ---- sources ----------------------------------------------------------------------------------------------------


@query("a3_reference_rename", f"SELECT id AS \"ID\", coalesce(target, '') AS \"Target\", coalesce(nullif(language, ''), split_part(id, '_', 1)) AS language FROM zoo_references")
def a3(spark, d):
    return sources.as_references(table(spark, d, "zoo_references"))


@query("a7_pruned_scan", "SELECT DISTINCT id, speaker_id, gender FROM prepared_rows WHERE gender IN ('male', 'M')")
def a7(spark, d):
    return prepared(spark, d).select("id", "speaker_id", "gender").filter(F.col("gender").isin("male", "M")).distinct()


@query("a8_split_scan", "SELECT row_no, id, duration FROM prepared_rows WHERE original_split = 'validation'")
def a8(spark, d):
    return prepared(spark, d).filter("original_split = 'validation'").select("row_no", "id", "duration")


@query("a14_first_column", "SELECT row_no, CASE WHEN trim(transcription) <> '' THEN transcription WHEN trim(text) <> '' THEN text END AS picked FROM lm_text")
def a14(spark, d):
    return sources.pick_text(lm(spark, d), ["transcription", "text"], "picked").select("row_no", "picked")


@query("a15_long_systems", f"{SQL} SELECT system, count(*) AS n, sum(length(hyp))::BIGINT AS n_chars FROM hyps WHERE system IN ('ctc_wide', 'seq_large') GROUP BY system")
def a15(spark, d):
    named = {s: system(spark, d, s) for s in ("ctc_wide", "seq_large")}
    return sources.long_systems(named).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("hyp")).alias("n_chars"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for queries that write and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PLAIN_REFS = "SELECT id, coalesce(target, '') AS target, coalesce(language, '') AS language FROM zoo_references"


@query("a1_csv_round_trip", _PLAIN_REFS)
def a1(spark, d):
    path = _folder(spark, "csv")
    rows = table(spark, d, "zoo_references").select("id", "target", "language").fillna("")
    sources.write_csv(rows, path, ["id", "target", "language"], "id")
    return sources.load_table(spark, path, ["id", "target", "language"], "references")


@query("a6_json_ledger", "SELECT model_name, count(*) * 2 AS n FROM zoo_predictions GROUP BY model_name")
def a6(spark, d):
    path = _folder(spark, "ledger")
    for _ in range(2):
        sources.append_log(audit.count_by(table(spark, d, "zoo_predictions"), "model_name"), path)
    return spark.read.json(path).groupBy("model_name").agg(F.sum("n").alias("n"))


@query("a9_split_folders", "SELECT row_no, CASE WHEN original_split = 'dev' THEN 'new' ELSE 'old' END AS age, original_split FROM generalization_mix WHERE original_split IN ('train', 'dev')")
def a9(spark, d):
    path = _folder(spark, "splits")
    rows = mix(spark, d).select("row_no", "original_split").filter("original_split IN ('train', 'dev')")
    sources.write_splits(rows.withColumn("age", F.lit("old")), path, "original_split")
    sources.write_splits(rows.filter("original_split = 'dev'").withColumn("age", F.lit("new")), path, "original_split")
    return spark.read.parquet(path).select("row_no", "age", "original_split")


@query("a10_manifest", "SELECT audio_filepath, transcription FROM lm_text WHERE audio_filepath IS NOT NULL AND transcription IS NOT NULL AND transcription NOT LIKE '[%'")
def a10(spark, d):
    path = _folder(spark, "manifest")
    rows = lm(spark, d).filter("audio_filepath IS NOT NULL AND transcription IS NOT NULL AND transcription NOT LIKE '[%'")
    rows.select("audio_filepath", "transcription").write.json(path)
    return sources.read_manifest(spark, path)


@query("a11_archive_members", "SELECT id, strlen(target)::BIGINT AS n_bytes FROM zoo_references WHERE target <> '' AND language <> 'eng'")
def a11(spark, d):
    """References packed into archives and found again by the manifest."""
    rows = table(spark, d, "zoo_references").filter("id IS NOT NULL AND target <> ''").select("id", "target", F.pmod(F.xxhash64("id"), F.lit(4)).alias("shard"), "language")

    def packed(part):
        import io
        import tarfile

        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:xz") as tar:
            for i, t in zip(part["id"], part["target"]):
                data = t.encode()
                info = tarfile.TarInfo(f"clips/{i}.txt")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"path": [f"shard-{part['shard'].iloc[0]}.tar.xz"], "content": [out.getvalue()]})

    archives = rows.groupBy("shard").applyInPandas(packed, "path string, content binary")
    manifest = rows.filter("language <> 'eng'").select("id", F.concat(F.lit("audio/x/"), "id", F.lit(".wav")).alias("audio_filepath"))
    return sources.members_of_manifest(sources.archive_members(archives, ".txt"), manifest).select("id", F.length("content").cast("bigint").alias("n_bytes"))


@query("a12_official_files", "WITH o AS (SELECT DISTINCT id FROM zoo_references WHERE id IS NOT NULL), f AS (SELECT DISTINCT id FROM zoo_predictions WHERE model_name = 'ctc_small' AND id IS NOT NULL) SELECT coalesce(o.id, f.id) AS id, CASE WHEN o.id IS NULL THEN 'extra' WHEN f.id IS NULL THEN 'missing' ELSE 'found' END AS status FROM o FULL JOIN f ON o.id = f.id")
def a12(spark, d):
    paths = table(spark, d, "zoo_predictions").filter("model_name = 'ctc_small' AND id IS NOT NULL").select(F.concat(F.lit("clips/x.y/"), "id", F.lit(".wav")).alias("path"))
    files = paths.select(sources.stem(F.col("path")).alias("id"), "path")
    return sources.official_files(files, table(spark, d, "zoo_references").filter("id IS NOT NULL")).select("id", "status")


@query("a13_corpus", f"SELECT language, {sql_plain('transcription')} AS value FROM prepared_rows WHERE language IS NOT NULL AND {sql_plain('transcription')} <> ''")
def a13(spark, d):
    path = _folder(spark, "corpus")
    rows = prepared(spark, d).select("language", plain(F.col("transcription")).alias("t")).filter("language IS NOT NULL AND t <> ''")
    sources.write_corpus(rows, path, "t", "language")
    return spark.read.text(path).select("language", "value")


# ---- filters and order ------------------------------------------------------------------------------------------


@query("b1_split_language", "SELECT row_no, language FROM generalization_mix WHERE language IN ('lin', 'sna') AND original_split = 'train'")
def b1(spark, d):
    return relational.split_language_filter(mix(spark, d), ["lin", "sna"], "train").select("row_no", "language")


@query("b2_metadata", "SELECT id AS \"ID\", coalesce(transcription, '') AS \"Target\", language, original_split FROM generalization_mix WHERE original_split IN ('train', 'validation')")
def b2(spark, d):
    return mix(spark, d).filter(F.col("original_split").isin("train", "validation")).select(F.col("id").alias("ID"), F.coalesce("transcription", F.lit("")).alias("Target"), "language", "original_split")


@query("b3_semi_filter", "SELECT row_no, id FROM zoo_predictions WHERE id IN (SELECT id FROM zoo_references)")
def b3(spark, d):
    return relational.semi_by_id(table(spark, d, "zoo_predictions"), table(spark, d, "zoo_references"), "id").select("row_no", "id")


@query("b3_missing", f"{SQL} SELECT id FROM refs WHERE id NOT IN (SELECT id FROM hyps WHERE system = 'ctc_small')")
def b3m(spark, d):
    return relational.missing_by_id(system(spark, d, "ctc_small"), refs(spark, d), "id")


@query("b4_duration_range", "SELECT row_no, duration FROM prepared_rows WHERE duration IS NULL OR duration < 0 OR duration BETWEEN 1.0 AND 5.0")
def b4(spark, d):
    return relational.duration_filter(prepared(spark, d), 1.0, 5.0).select("row_no", "duration")


@query("b5_source_filter", "SELECT row_no, source_dataset FROM generalization_mix WHERE source_dataset IN ('radio/archive', 'multivoice/field')")
def b5(spark, d):
    return mix(spark, d).filter(F.col("source_dataset").isin("radio/archive", "multivoice/field")).select("row_no", "source_dataset")


@query("b6_filled", r"SELECT row_no FROM generalization_mix WHERE trim(regexp_replace(regexp_replace(lower(transcription), '\p{P}', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) <> ''")
def b6(spark, d):
    from ..functions.text import normalize

    return mix(spark, d).filter(normalize(F.col("transcription"), "no_punct_lower") != "").select("row_no")


@query("b7_first_n", "SELECT language, row_no FROM prepared_rows QUALIFY row_number() OVER (PARTITION BY language ORDER BY row_no) <= 25")
def b7(spark, d):
    return relational.first_per_group(prepared(spark, d).select("language", "row_no"), ["language"], 25, F.col("row_no"))


@query("b8_capped_sample", "SELECT language, row_no FROM prepared_rows QUALIFY row_number() OVER (PARTITION BY language ORDER BY sha1('7|' || row_no), row_no) <= 40")
def b8(spark, d):
    return relational.capped_sample(prepared(spark, d).select("language", "row_no"), ["language"], 40, "row_no", 7)


@query("b9_seeded_sample", "SELECT row_no FROM generalization_mix ORDER BY sha1('3|' || row_no), row_no LIMIT 200")
def b9(spark, d):
    return relational.seeded_sample(mix(spark, d).select("row_no"), 200, "row_no", 3)


@query("b10_shard", "SELECT row_no FROM prepared_rows QUALIFY ntile(7) OVER (ORDER BY row_no) = 3")
def b10(spark, d):
    return relational.contiguous_shard(prepared(spark, d).select("row_no"), 7, 2, "row_no")


@query("b11_top_k", "SELECT row_no, length(transcription) AS n FROM generalization_mix WHERE transcription IS NOT NULL ORDER BY n DESC, row_no LIMIT 25")
def b11(spark, d):
    return mix(spark, d).filter("transcription IS NOT NULL").select("row_no", F.length("transcription").cast("bigint").alias("n")).orderBy(F.col("n").desc(), "row_no").limit(25)


_QUIRKS = r"""CASE WHEN t <> trim(t) THEN 'whitespace' END, CASE WHEN contains(t, chr(10)) THEN 'newline' END, CASE WHEN regexp_matches(t, '[A-Z]') THEN 'uppercase' END,
 CASE WHEN regexp_matches(t, '[''’]') THEN 'apostrophe' END, CASE WHEN regexp_matches(t, '[^\x00-\x7F]') THEN 'non_ascii' END, CASE WHEN regexp_matches(t, '[0-9]') THEN 'digit' END, CASE WHEN trim(t) = '' THEN 'empty' END"""


@query(
    "b12_examples",
    f"WITH q AS (SELECT row_no, unnest(list_filter([{_QUIRKS}], lambda x: x IS NOT NULL)) AS quirk FROM (SELECT row_no, coalesce(transcription, '') AS t FROM lm_text)) "
    "SELECT quirk, row_number() OVER (PARTITION BY quirk ORDER BY row_no) AS rank, row_no FROM q QUALIFY rank <= 8",
)
def b12(spark, d):
    return audit.quirk_examples(lm(spark, d).withColumn("key", F.col("row_no")), "transcription", "key", "row_no").withColumnRenamed("key", "row_no")


@query("b13_align", f"{SQL}, s AS (SELECT row_no AS ord, id FROM zoo_predictions WHERE model_name = 'seq_mixed') SELECT s.id, s.ord, coalesce(h.hyp, '.') AS hyp FROM s LEFT JOIN (SELECT id, hyp FROM hyps WHERE system = 'ctc_small') h USING (id)")
def b13(spark, d):
    sample = table(spark, d, "zoo_predictions").filter("model_name = 'seq_mixed'").select("id", F.col("row_no").alias("ord"))
    return relational.align_to(sample, system(spark, d, "ctc_small"), "id", "ord")


@query(
    "b14_order",
    "WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS o FROM zoo_references), b AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS o FROM zoo_references WHERE language <> 'eng') "
    "SELECT count(a.id) AS n_left, count(b.id) AS n_right, count(*) FILTER (a.id IS DISTINCT FROM b.id) AS n_misplaced FROM a FULL JOIN b USING (o)",
)
def b14(spark, d):
    r = table(spark, d, "zoo_references")
    down = r.filter("language <> 'eng'").select("id")
    # the place from the end is the number of rows less the place
    back = ranked(down, "id", out="o").crossJoin(F.broadcast(down.agg(F.count(F.lit(1)).alias("n")))).select("id", (F.col("n") - 1 - F.col("o")).alias("o"))
    return relational.order_mismatches(ranked(r.select("id"), "id", out="o"), back, "id", "o")


# ---- joins ------------------------------------------------------------------------------------------------------


@query("c1_last_wins_join", f"{SQL} SELECT id, language, hyp FROM refs JOIN hyps USING (id) WHERE system = 'seq_large'")
def c1(spark, d):
    return refs(spark, d).join(system(spark, d, "seq_large"), "id").select("id", "language", "hyp")


@query("c2_left_default", f"{SQL} SELECT id, language, ref, coalesce(hyp, '.') AS hyp FROM refs LEFT JOIN (SELECT id, hyp FROM hyps WHERE system = 'ctc_wide') USING (id)")
def c2(spark, d):
    return relational.left_default(refs(spark, d), system(spark, d, "ctc_wide"), "id", {"hyp": "."})


@query(
    "c3_coverage",
    f"{SQL}, p AS (SELECT DISTINCT id FROM hyps WHERE system = 'ctc_wide'), o AS (SELECT 'missing' AS side, id FROM refs WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT 'extra', id FROM p WHERE id NOT IN (SELECT id FROM refs)) "
    "SELECT side, count(DISTINCT id) AS n, min(id) AS example FROM o GROUP BY side",
)
def c3(spark, d):
    return relational.coverage(refs(spark, d), system(spark, d, "ctc_wide"), "id")


@query("c5_all_systems", f"{SQL} SELECT id FROM hyps GROUP BY id HAVING count(DISTINCT system) = 5")
def c5(spark, d):
    return relational.in_all_systems(hyps(spark, d), "id", "system", 5)


@query("c6_one_to_many", f"{SQL} SELECT id, language, system, hyp FROM refs JOIN hyps USING (id)")
def c6(spark, d):
    return refs(spark, d).join(hyps(spark, d), "id").select("id", "language", "system", "hyp")


@query("c7_disjoint_union", f"{SQL} SELECT id, hyp FROM hyps WHERE (system = 'seq_large' AND split_part(id, '_', 1) = 'lin') OR (system = 'seq_mixed' AND split_part(id, '_', 1) = 'sna')")
def c7(spark, d):
    part = lambda s, lang: system(spark, d, s).filter(id_language(F.col("id")) == lang)
    return relational.disjoint_union([part("seq_large", "lin"), part("seq_mixed", "sna")], "id")


_KEY = sql_plain("lower(transcription)")


@query("c8_text_anti", f"SELECT row_no FROM generalization_mix WHERE original_split = 'external_train' AND {_KEY} NOT IN (SELECT {_KEY} FROM generalization_mix WHERE original_split = 'train' AND {_KEY} <> '')")
def c8(spark, d):
    m, key = mix(spark, d), plain(F.lower("transcription"))
    return relational.text_anti(m.filter("original_split = 'external_train'"), m.filter("original_split = 'train'"), key, key).select("row_no")


@query(
    "c9_text_overlap",
    f"SELECT source_dataset, count(*) AS n_rows, count(*) FILTER ({_KEY} IN (SELECT {_KEY} FROM generalization_mix WHERE original_split = 'train' AND {_KEY} <> '')) AS n_shared FROM generalization_mix WHERE original_split <> 'train' GROUP BY source_dataset",
)
def c9(spark, d):
    m, key = mix(spark, d), plain(F.lower("transcription"))
    return relational.text_overlap(m.filter("original_split <> 'train'"), m.filter("original_split = 'train'"), key, key, "source_dataset")


@query("c13_speaker_semi", "SELECT row_no FROM prepared_rows a WHERE original_split = 'validation' AND EXISTS (SELECT 1 FROM prepared_rows b WHERE b.original_split = 'train' AND b.language = a.language AND b.speaker_id = a.speaker_id)")
def c13(spark, d):
    p = prepared(spark, d)
    return p.filter("original_split = 'validation'").join(p.filter("original_split = 'train'").select("language", "speaker_id").distinct(), ["language", "speaker_id"], "left_semi").select("row_no")


@query("c13_speaker_anti", "SELECT row_no FROM prepared_rows a WHERE original_split = 'test' AND NOT EXISTS (SELECT 1 FROM prepared_rows b WHERE b.original_split = 'train' AND b.language = a.language AND b.speaker_id = a.speaker_id)")
def c13a(spark, d):
    p = prepared(spark, d)
    return p.filter("original_split = 'test'").join(p.filter("original_split = 'train'").select("language", "speaker_id").distinct(), ["language", "speaker_id"], "left_anti").select("row_no")


# ---- counts and statistics --------------------------------------------------------------------------------------


@query("d1_count_by", "SELECT language, count(*) AS n FROM prepared_rows GROUP BY language")
def d1(spark, d):
    return audit.count_by(prepared(spark, d), "language")


@query("d2_count_by_two", "SELECT source_dataset, language, count(*) AS n FROM generalization_mix GROUP BY ALL")
def d2(spark, d):
    return audit.count_by(mix(spark, d), "source_dataset", "language")


@query(
    "d3_nearest_rank",
    "SELECT language, list_sort(list(duration))[(floor(0.5 * (count(duration) - 1)))::INT + 1] AS p50, list_sort(list(duration))[(floor(0.95 * (count(duration) - 1)))::INT + 1] AS p95 FROM prepared_rows WHERE duration IS NOT NULL GROUP BY language",
)
def d3(spark, d):
    return audit.nearest_ranks(prepared(spark, d), F.col("duration"), {"p50": 0.5, "p95": 0.95}, "language")


@query("d4_linear_quantile", "SELECT language, round(quantile_cont(duration, 0.25), 6) AS q25, round(quantile_cont(duration, 0.9), 6) AS q90 FROM prepared_rows GROUP BY language")
def d4(spark, d):
    q = audit.linear_quantiles(prepared(spark, d), F.col("duration"), {"q25": 0.25, "q90": 0.9}, "language")
    return q.select("language", F.round("q25", 6).alias("q25"), F.round("q90", 6).alias("q90"))


def _stats_sql(name: str) -> str:
    return (
        f"min({name}) AS min_{name}, median({name})::DOUBLE AS median_{name}, list_sort(list({name}))[(floor(0.95 * (count(*) - 1)))::INT + 1] AS p95_{name}, max({name}) AS max_{name}"
    )


@query("d5_length_stats", f"{SQL} SELECT system, {_stats_sql('chars')}, {_stats_sql('words')} FROM (SELECT system, length(hyp) AS chars, len(list_filter(string_split(hyp, ' '), lambda w: w <> ''))::BIGINT AS words FROM hyps) GROUP BY system")
def d5(spark, d):
    return audit.length_stats(hyps(spark, d), "hyp", "system")


@query(
    "d6_missing",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (coalesce({c}::VARCHAR, '') = '') AS n_missing FROM prepared_rows" for c in ("id", "language", "speaker_id", "gender", "transcription", "duration")),
)
def d6(spark, d):
    return audit.missing_counts(prepared(spark, d), ["id", "language", "speaker_id", "gender", "transcription", "duration"])


@query("d7_duplicate_ids", "SELECT id, count(*) AS n FROM prepared_rows GROUP BY id HAVING count(*) > 1")
def d7(spark, d):
    return audit.duplicate_keys(prepared(spark, d), "id")


@query(
    "d8_set_overlap",
    f"{SQL}, a AS (SELECT DISTINCT id FROM hyps WHERE system = 'ctc_small'), b AS (SELECT DISTINCT id FROM hyps WHERE system = 'ctc_wide') "
    "SELECT count(a.id) AS n_left, count(b.id) AS n_right, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both, count(*) FILTER (b.id IS NULL) AS n_only_left, count(*) FILTER (a.id IS NULL) AS n_only_right FROM a FULL JOIN b ON a.id = b.id",
)
def d8(spark, d):
    return audit.set_overlap(system(spark, d, "ctc_small"), system(spark, d, "ctc_wide"), "id")


@query(
    "d9_quirks",
    r"SELECT source, count(*) FILTER (t <> trim(t)) AS n_whitespace, count(*) FILTER (contains(t, chr(10))) AS n_newline, count(*) FILTER (regexp_matches(t, '[A-Z]')) AS n_uppercase, count(*) FILTER (regexp_matches(t, '[''’]')) AS n_apostrophe, count(*) FILTER (regexp_matches(t, '[^\x00-\x7F]')) AS n_non_ascii, count(*) FILTER (regexp_matches(t, '[0-9]')) AS n_digit, count(*) FILTER (trim(t) = '') AS n_empty FROM (SELECT source, coalesce(transcription, '') AS t FROM lm_text) GROUP BY source",
)
def d9(spark, d):
    return audit.quirk_counts(lm(spark, d), "transcription", "source")


@query(
    "d10_characters",
    "WITH c AS (SELECT language, unnest(string_split(coalesce(transcription, ''), '')) AS char FROM prepared_rows), n AS (SELECT language, char, count(*) AS n FROM c WHERE char <> '' GROUP BY ALL) SELECT language, char, n, row_number() OVER (PARTITION BY language ORDER BY n DESC, char) AS rank FROM n QUALIFY rank <= 40",
)
def d10(spark, d):
    return audit.character_inventory(prepared(spark, d), "transcription", "language")


@query("d11_surplus", f"SELECT source, count(*) AS n_rows, count(DISTINCT t) AS n_texts, count(*) - count(DISTINCT t) AS n_surplus FROM (SELECT source, {sql_plain('lower(transcription)')} AS t FROM lm_text) GROUP BY source")
def d11(spark, d):
    return audit.duplicate_surplus(lm(spark, d), plain(F.lower("transcription")), "source")


@query("d12_shared_texts", f"SELECT t AS text, count(DISTINCT source) AS n_sources, count(*) AS n_rows FROM (SELECT source, {sql_plain('lower(transcription)')} AS t FROM lm_text) GROUP BY t HAVING count(DISTINCT source) > 1")
def d12(spark, d):
    return audit.shared_texts(lm(spark, d), plain(F.lower("transcription")), "source")


@query(
    "d13_group_stats",
    "SELECT original_split, source_dataset, count(*) AS n_rows, count(*) FILTER (t = '') AS n_empty, round(avg(k), 6) AS mean_duration, median(k) AS median_duration, round(avg(length(t)), 6) AS mean_chars, median(length(t))::DOUBLE AS median_chars, round(sum(k) / 3600, 2) AS hours, count(*) - count(DISTINCT t) AS n_repeated FROM (SELECT *, coalesce(transcription, '') AS t, CASE WHEN duration >= 0 THEN duration END AS k FROM generalization_mix) GROUP BY original_split, source_dataset",
)
def d13(spark, d):
    return audit.group_stats(mix(spark, d).withColumn("transcription", F.col("transcription")), "transcription", "duration", "original_split", "source_dataset")


@query("d14_hours", "SELECT source_dataset, round(sum(duration) / 3600, 2) AS hours FROM generalization_mix WHERE duration >= 0 GROUP BY source_dataset")
def d14(spark, d):
    return mix(spark, d).filter("duration >= 0").groupBy("source_dataset").agg(F.round(F.sum("duration") / 3600, 2).alias("hours"))


@query(
    "d15_flags",
    "WITH f AS (SELECT language, unnest(list_filter(string_split(concat_ws(';', CASE WHEN duration < 2 THEN 'short' END, CASE WHEN duration > 8 THEN 'long' END, CASE WHEN source_risk LIKE '%external%' THEN 'external' END), ';'), lambda x: x <> '')) AS flag FROM generalization_mix) SELECT language, flag, count(*) AS n FROM f GROUP BY ALL",
)
def d15(spark, d):
    joined = F.concat_ws(";", F.when(F.col("duration") < 2, "short"), F.when(F.col("duration") > 8, "long"), F.when(F.col("source_risk").like("%external%"), "external"))
    return audit.flag_histogram(mix(spark, d), flag_set(joined), "language")


@query("d16_first_wins", "SELECT id, original_split, row_no, transcription FROM generalization_mix WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, original_split ORDER BY row_no) = 1")
def d16(spark, d):
    return relational.first_wins(mix(spark, d).filter("id IS NOT NULL").select("id", "original_split", "row_no", "transcription"), ["id", "original_split"], "row_no")


@query(
    "d18_change",
    f"{SQL}, j AS (SELECT split_part(a.id, '_', 1) AS language, a.hyp AS x, b.hyp AS y FROM hyps a JOIN hyps b USING (id) WHERE a.system = 'seq_large' AND b.system = 'ctc_wide') "
    "SELECT language, count(*) AS n, count(*) FILTER (x <> y) AS n_changed, count(*) FILTER (x <> y AND (length(y) / greatest(length(x), 1) < 0.65 OR length(y) / greatest(length(x), 1) > 1.55 OR abs(length(x) - length(y)) > 160)) AS n_strong FROM j GROUP BY language",
)
def d18(spark, d):
    named = lambda s: system(spark, d, s).withColumn("language", id_language(F.col("id")))
    return audit.change_report(named("seq_large"), named("ctc_wide"), "id", "hyp", "language")


@query(
    "d19_speakers",
    "WITH r AS (SELECT language, nullif(trim(speaker_id), '') AS s, lower(trim(original_split)) = 'train' AS train FROM prepared_rows WHERE original_split IS NOT NULL), f AS (SELECT language, s, count(*) FILTER (train) AS nt, count(*) FILTER (NOT train) AS ne FROM r GROUP BY ALL HAVING ne > 0) "
    "SELECT language, coalesce(sum(ne) FILTER (s IS NOT NULL AND nt > 0), 0)::BIGINT AS seen_rows, coalesce(sum(ne) FILTER (s IS NOT NULL AND nt = 0), 0)::BIGINT AS unseen_rows, coalesce(sum(ne) FILTER (s IS NULL), 0)::BIGINT AS unknown_rows, count(*) FILTER (s IS NOT NULL AND nt > 0) AS seen_speakers, count(*) FILTER (s IS NOT NULL AND nt = 0) AS unseen_speakers FROM f GROUP BY language",
)
def d19(spark, d):
    return audit.speaker_overlap(prepared(spark, d), "language", F.nullif(F.trim("speaker_id"), F.lit("")), F.lower(F.trim("original_split")) == "train")


@query(
    "d22_unusual",
    r"WITH c AS (SELECT source, unnest(list_distinct(list_filter(regexp_extract_all(coalesce(transcription, ''), '.'), lambda x: NOT regexp_matches(x, '[\p{L}\p{M}\p{N}\s.,!?;:''\x22()-]')))) AS char FROM lm_text) SELECT source, char, count(*) AS n FROM c GROUP BY ALL",
)
def d22(spark, d):
    return audit.unusual_characters(lm(spark, d), "transcription", "source")


@query(
    "d23_speaker_cap",
    "WITH a AS (SELECT row_no, language, speaker_id FROM prepared_rows WHERE speaker_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY language, speaker_id ORDER BY row_no) <= 3) SELECT row_no, language, speaker_id FROM a QUALIFY row_number() OVER (PARTITION BY language ORDER BY row_no) <= 60",
)
def d23(spark, d):
    rows = prepared(spark, d).filter("speaker_id IS NOT NULL").select("row_no", "language", "speaker_id")
    return relational.speaker_capped(rows, "language", "speaker_id", 3, 60, "row_no")


@query(
    "d24_balance",
    "WITH r AS (SELECT language, row_no, row_number() OVER (PARTITION BY language ORDER BY row_no) AS rn, count(*) OVER (PARTITION BY language) AS n FROM generalization_mix WHERE original_split = 'dev' AND language IS NOT NULL), m AS (SELECT max(n) AS top FROM r) "
    "SELECT language, row_no, unnest(range(1, (top // n + CASE WHEN rn <= top % n THEN 1 ELSE 0 END + 1)::BIGINT))::BIGINT AS copy FROM r, m",
)
def d24(spark, d):
    rows = mix(spark, d).filter("original_split = 'dev' AND language IS NOT NULL").select("language", "row_no")
    return relational.balanced(rows, "language", "row_no").withColumn("copy", F.col("copy").cast("bigint"))


@query("d26_vocabulary", f"{SQL} SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split(lower(ref), ' '), lambda w: w <> '')) AS word FROM refs) GROUP BY word")
def d26(spark, d):
    from ..functions.text import tokens

    return audit.vocabulary(refs(spark, d), tokens(F.lower("ref")))


@query("d26_letters", f"{SQL}, l AS (SELECT DISTINCT CASE WHEN c = ' ' THEN '|' ELSE c END AS letter FROM (SELECT unnest(string_split(lower(ref), '')) AS c FROM refs) WHERE c <> '') SELECT letter, row_number() OVER (ORDER BY letter) - 1 AS letter_id FROM l")
def d26l(spark, d):
    return audit.letter_ids(refs(spark, d).select(F.lower("ref").alias("ref")), "ref")


