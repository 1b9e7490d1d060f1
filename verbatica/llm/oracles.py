"""DuckDB SQL for the queries of the training-data operators that SQL can express on whole tables."""

_SPEAKER = r"""
s AS (
  SELECT row_no, id,
    lower(trim(coalesce(nullif(split_part(id, '_', 1), ''), language))) AS lang,
    regexp_extract(regexp_replace(speaker_id, '\s*/\s*[sS]\s*\d+\s*$', ''), '(\d+)\D*$', 1) AS digits,
    lower(regexp_replace(original_split, '^\s+|\s+$', '', 'g')) AS split
  FROM prepared_rows),
k AS (
  SELECT row_no, CASE WHEN digits <> '' THEN concat_ws(':', lang, CASE WHEN ltrim(digits, '0') = '' THEN '0' ELSE ltrim(digits, '0') END) END AS speaker,
    CASE WHEN split = 'train' THEN 'train' WHEN split IN ('validation', 'val', 'dev', 'valid') THEN 'validation' WHEN split = 'test' THEN 'test' END AS split
  FROM s)"""

_CONTENT = r"""
c AS (
  SELECT row_no, transcription, text,
    regexp_replace(lower(nfc_normalize(coalesce(transcription, ''))), '[^\p{L}\p{M}\p{N}]', '', 'g') AS x,
    regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[^\p{L}\p{M}\p{N}]', '', 'g') AS y
  FROM lm_text),
g AS (
  SELECT row_no, transcription, text, CASE WHEN x < y THEN x ELSE y END AS a, CASE WHEN x < y THEN y ELSE x END AS b FROM c WHERE x <> '' OR y <> ''),
n AS (SELECT *, min(row_no) OVER (PARTITION BY a, b) AS rep, count(*) OVER (PARTITION BY a, b) AS n_copies FROM g)"""

# Fixed values, stated here anew so that the check does not lean on what it checks: look-alike letters side by side.
_LIKE = [
    ("аеорсухіјѕһԁԛԝёїАВЕЅЗІЈКМНОРСТУХԌԚԜЁЇЬҮү", "aeopcyxijshdqwëïABES3IJKMHOPCTYXGQWËÏbYy"),
    ("οναιρυϲϳκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹόάίύΐϊϋΆΈΉΊΌΎ", "ovaipucjĸABEZHIKMNOPTYXCóáíúḯïüÁÉHÍÓÝ"),
    ("εͻϽԐԑɡı", "ɛɔƆƐɛgi"),
]
_PAIRS = ", ".join(f"({ord(a)}, {ord(b)})" for x, y in _LIKE for a, b in zip(x, y))
# every character by itself: wide forms by their distance from the plain ones, spaces and what is not seen by their
# numbers, look-alikes by the table
_FORMS = f"""l(c, p) AS (VALUES {_PAIRS}),
u AS (SELECT row_no, transcription, unnest(string_split(nfc_normalize(transcription), '')) AS ch, generate_subscripts(string_split(nfc_normalize(transcription), ''), 1) AS i FROM generalization_mix WHERE transcription <> ''),
m AS (SELECT row_no, transcription, i, CASE
    WHEN unicode(ch) BETWEEN 65281 AND 65374 THEN chr((unicode(ch) - 65248)::INT)
    WHEN unicode(ch) IN (160, 5760, 8239, 8287, 12288) OR unicode(ch) BETWEEN 8192 AND 8202 THEN ' '
    WHEN unicode(ch) IN (173, 847, 1564, 4447, 4448, 6068, 6069, 12644, 65279, 65440) OR unicode(ch) BETWEEN 6155 AND 6159 OR unicode(ch) BETWEEN 8203 AND 8207 OR unicode(ch) BETWEEN 8234 AND 8238 OR unicode(ch) BETWEEN 8288 AND 8303 OR unicode(ch) BETWEEN 65024 AND 65039 OR unicode(ch) BETWEEN 917504 AND 921599 THEN ''
    WHEN unicode(ch) = 941 THEN 'ɛ' || chr(769)
    WHEN unicode(ch) BETWEEN 64256 AND 64260 THEN (['ff', 'fi', 'fl', 'ffi', 'ffl'])[(unicode(ch) - 64255)::INT]
    WHEN l.p IS NOT NULL THEN chr(l.p::INT) ELSE ch END AS f FROM u LEFT JOIN l ON l.c = unicode(ch)),
f AS (SELECT row_no, transcription, nfc_normalize(string_agg(f, '' ORDER BY i)) AS form FROM m GROUP BY ALL
  UNION ALL SELECT row_no, transcription, transcription FROM generalization_mix WHERE transcription IS NULL OR transcription = ''),
n AS (SELECT *, length(regexp_replace(form, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::BIGINT AS n_letters FROM f)"""

# the largest remainders of 80, 10 and 10 percent, the first name on a tie
_QUOTAS = """n AS (SELECT count(*) AS n FROM prepared_rows),
q AS (SELECT new_split, n, n * p / 100.0 AS x, floor(n * p / 100.0)::BIGINT AS low FROM n, (VALUES ('train', 80), ('validation', 10), ('test', 10)) v(new_split, p)),
r AS (SELECT *, row_number() OVER (ORDER BY x - low DESC, new_split) AS r, n - sum(low) OVER () AS over FROM q)"""

# how languages are written, stated anew
_MEANT = "CASE WHEN l IN ('lin', 'ln', 'lingala') THEN 'lin' WHEN l IN ('lug', 'lg', 'luganda', 'ganda') THEN 'lug' WHEN l IN ('sna', 'sn', 'shona') THEN 'sna' WHEN l IN ('xog', 'sog', 'lusoga', 'soga') THEN 'xog' WHEN l IN ('myx', 'mas', 'lumasaba', 'masaba', 'masaaba') THEN 'myx' WHEN l IN ('eng', 'en', 'english') THEN 'eng' ELSE 'und' END"
_RECORDS = f"""f AS (SELECT coalesce(source, '(none)') AS source, coalesce(text_domain, '(none)') AS domain, CASE WHEN length(lower(trim(language))) > 3 THEN regexp_replace(lower(trim(language)), '[_-].*$', '') ELSE lower(trim(language)) END AS l
  FROM lm_text WHERE trim(concat_ws('', transcription, text)) <> ''),
m AS (SELECT source, domain, {_MEANT} AS lang FROM f),
e AS (SELECT 'source' AS dimension, source AS value FROM m UNION ALL SELECT 'language', lang FROM m UNION ALL SELECT 'text_domain', domain FROM m UNION ALL SELECT 'slice', source || '/' || lang || '/' || domain FROM m UNION ALL SELECT 'all', 'all' FROM m)"""

ORACLES = {
    "p2_records": f"WITH {_RECORDS} SELECT dimension, value, count(*) AS n_records, true AS counted FROM e GROUP BY ALL",
    "p4_found": f"WITH {_SPEAKER} SELECT row_no FROM k WHERE split <> 'train' AND speaker IN (SELECT speaker FROM k WHERE split = 'train' AND speaker IS NOT NULL)",
    "p5_found": f"WITH {_CONTENT} SELECT rep AS row_no_a, row_no AS row_no_b FROM n WHERE row_no <> rep",
    "p5_records": f"WITH {_CONTENT} SELECT row_no, transcription, text, n_copies FROM n WHERE row_no = rep",
    "p6_found": f"WITH {_FORMS} SELECT a.row_no AS row_no_a, b.row_no AS row_no_b FROM n a JOIN n b ON a.form = b.form AND a.row_no < b.row_no AND a.transcription <> b.transcription WHERE a.n_letters >= 12",
    "p6_forms": f"WITH {_FORMS} SELECT row_no, form, n_letters FROM n",
    "p4_quotas": f"WITH {_QUOTAS} SELECT new_split, (low + CASE WHEN r <= over THEN 1 ELSE 0 END)::BIGINT AS n_rows, 0::BIGINT AS n_parted FROM r",
}
