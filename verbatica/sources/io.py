"""Readers and writers with fixed schemas.

Columns of text tables are strings; what is missing is an empty string. Readers fail on missing columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled, id_language

TRAIN = ["id", "transcription", "language", "original_split"]
TEST = ["ID"]
SAMPLE = ["ID", "Target"]
PREDICTION = ["ID", "Target"]


def require_columns(df: DataFrame, columns: list[str], name: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}; it has {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of a CSV file with header: UTF-8 with or without byte order mark, quotes doubled or escaped by a backslash,
    line breaks inside quotes, missing values as empty strings. Rows with too many fields are left out; see
    ``bad_csv_rows``. Without line breaks inside quotes (``multi_line`` off) a large file is read in parts."""
    return _csv(spark, path, columns, multi_line).filter("__bad IS NULL").drop("__bad")


def bad_csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """(row): what could not be read because it has more fields than the header."""
    df = _csv(spark, path, columns, multi_line)
    # the reader gives broken rows only to queries that use a column of the data too
    some = F.length(F.concat_ws("", *[c for c in df.columns if c != "__bad"])) >= 0
    return df.filter(F.col("__bad").isNotNull() & some).select(F.col("__bad").alias("row"))


def _csv(spark: SparkSession, path: str, columns: list[str] | None, multi_line: bool = True) -> DataFrame:
    if columns is None:
        first = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
        columns = [c.lstrip("\ufeff") for c in first.columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "__bad"]])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad")
    raw = reader.option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    # a row with too few fields is no bad row: what it lacks is empty; what is inside quotes parts no fields
    unquoted = F.regexp_replace(F.col("__bad"), r'"(?:[^"\\]|\\.|"")*"', "")
    too_many = F.size(F.split(unquoted, ",")) > len(columns)
    return raw.select(*[F.coalesce(F.regexp_replace(F.col(c), r'\\"', '"'), F.lit("")).alias(c) for c in columns], F.when(F.col("__bad").isNotNull() & too_many, F.col("__bad")).alias("__bad"))


def load_table(spark: SparkSession, path: str, columns: list[str], name: str) -> DataFrame:
    """A CSV table that must have the columns; others stay."""
    return require_columns(read_csv(spark, path), columns, name)


def as_references(df: DataFrame) -> DataFrame:
    """(ID, Target, language) of a table that may say id and transcription; the language falls back to the identifier's."""
    names = {c.lower(): c for c in df.columns}
    key = F.col(names["id"])
    text = F.col(names.get("target") or names["transcription"])
    language = F.coalesce(F.nullif(F.col(names["language"]), F.lit("")), id_language(key)) if "language" in names else id_language(key)
    return df.select(key.alias("ID"), F.coalesce(text, F.lit("")).alias("Target"), language.alias("language"))


def write_csv(df: DataFrame, path: str, columns: list[str], order: str | None = None, one_file: bool = False) -> None:
    """The columns in the order given, others left out; in files that follow the order, or in one for small tables."""
    out = (df.orderBy(order) if order else df).select(*columns)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small report as JSON with sorted keys, on this machine or, with a session, in the file system the path names."""
    text = json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a ledger of JSON lines."""
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split; only the splits among the rows are replaced, each by one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(path)


def write_corpus(df: DataFrame, path: str, text: str, language: str) -> None:
    """Text lines, one folder a language; the rows of a language are spread over several files."""
    df.select(F.col(text).alias("value"), language).repartition(language, F.pmod(F.xxhash64(text), F.lit(16))).write.mode("overwrite").partitionBy(language).text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(audio_filepath, transcription): JSON lines or arrays whose transcription is a string or a list of strings; lines that
    are no JSON are left out."""
    rows = spark.read.option("wholetext", False).text(path).select(F.regexp_replace(F.trim("value"), r"^[\[,]\s*|\s*[\],]$", "").alias("v")).filter("v <> ''")
    parsed = rows.select(F.from_json("v", "transcription string, audio_filepath string").alias("r"), F.col("v")).filter("r IS NOT NULL")
    listed = F.from_json(F.col("r.transcription"), "array<string>")
    # a string is wrapped, a list is what its text parses to
    each = F.when(F.col("r.transcription").startswith("["), F.coalesce(listed, F.array(F.col("r.transcription")))).otherwise(F.array(F.col("r.transcription")))
    return parsed.select(F.col("r.audio_filepath").alias("audio_filepath"), F.explode(each).alias("transcription")).filter("transcription IS NOT NULL")


def column_among(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidates that is a column, whatever its case."""
    names = {c.lower(): c for c in df.columns}
    return next((names[c.lower()] for c in candidates if c.lower() in names), None)


def pick_text(df: DataFrame, candidates: list[str], out: str) -> DataFrame:
    """``out``: the first of the columns, of those that exist, that is filled."""
    found = [c for c in (column_among(df, [x]) for x in candidates) if c]
    if not found:
        raise ValueError(f"none of {candidates} is among {df.columns}")
    return df.withColumn(out, first_filled(*[F.col(c) for c in found]))


def long_systems(named: dict[str, DataFrame]) -> DataFrame:
    """Several systems' tables as one with a ``system`` column."""
    out = None
    for name, df in named.items():
        part = df.withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no systems given")
    return out


def unpack_archives(spark: SparkSession, glob: str, suffix: str = "") -> DataFrame:
    """(archive, stem, name, content) of the members of tar archives, of any compression."""
    return archive_members(spark.read.format("binaryFile").load(glob).select("path", "content"), suffix)


def archive_members(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(archive, stem, name, content) of the members of archives (path, content), each read once from front to back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(suffix):
                            name = Path(member.name).name
                            yield pd.DataFrame({"archive": [Path(path).name], "stem": [Path(name).stem], "name": [name], "content": [tar.extractfile(member).read()]})

    return archives.mapInPandas(run, "archive string, stem string, name string, content binary")


def stem(path: Column) -> Column:
    """The name of a file without folders and its last ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def members_of_manifest(members: DataFrame, manifest: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """The rows of a manifest with the archive member of the same stem, the first by archive and name."""
    one = members.groupBy("stem").agg(F.min_by(F.struct("archive", "name", "content"), F.struct("archive", "name")).alias("m")).select("stem", "m.*")
    return manifest.withColumn("stem", stem(F.col(path))).join(one, "stem")


def files_by_id(spark: SparkSession, glob: str) -> DataFrame:
    """(id, path, length) of loose files named by their identifiers; contents stay unread."""
    return spark.read.format("binaryFile").load(glob).select(stem(F.col("path")).alias("id"), "path", "length")


def official_files(files: DataFrame, official: DataFrame, key: str = "id") -> DataFrame:
    """(id, path, status): every official identifier with its file, ``found`` or ``missing``, and files that no list
    names, ``extra``."""
    listed = official.select(F.col(key).alias("id"), F.lit(True).alias("listed")).distinct()
    both = listed.join(files.groupBy("id").agg(F.min("path").alias("path")), "id", "full_outer")
    status = F.when(F.col("listed").isNull(), "extra").when(F.col("path").isNull(), "missing").otherwise("found")
    return both.select("id", "path", status.alias("status"))


def map_media(df: DataFrame, decode: Callable[[bytes], list[float]], content: str = "content") -> DataFrame:
    """``samples``: the decoded media of every row; what cannot be decoded gives null and an error name."""
    schema = T.StructType([*df.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for x in b[content]:
                try:
                    out.append([float(v) for v in decode(x)])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    out.append(None)
                    errors.append(type(e).__name__)
            yield b.assign(samples=out, error=errors)

    return df.mapInPandas(run, schema)


def merge_config(base: dict, overrides: dict) -> dict:
    """Overrides in a nested configuration; None overrides nothing."""
    out = dict(base)
    for k, v in overrides.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_config(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def read_config(path: str, overrides: dict | None = None) -> dict:
    """A configuration file, YAML or JSON by its ending, with overrides."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        base = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs the yaml package; JSON does not") from e
        base = yaml.safe_load(text)
    if not isinstance(base or {}, dict):
        raise ValueError(f"{path} holds no mapping")
    return merge_config(base or {}, overrides or {})


def cache_matches(record: dict | None, **expected) -> bool:
    """Whether a cached result was made by what is expected now: the same model, revision, identifiers, ..."""
    return record is not None and all(k in record and record[k] == v for k, v in expected.items())


def source_revision(folder: str = ".") -> str | None:
    """The commit of the working tree, with a plus where it has changes; None outside of one."""
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=30)
    try:
        head = git("rev-parse", "HEAD")
        return head.stdout.strip() + ("+" if git("status", "--porcelain").stdout.strip() else "") if head.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


def experiment_record(name: str, config: dict, metrics: dict, artifacts: dict | None = None) -> dict:
    """What is to be kept of a run: a safe name, the configuration, the results, the versions."""
    import platform
    from datetime import datetime, timezone

    import pyspark

    return {
        "run": re.sub(r"[^\w.\-]", "_", name).strip("_"),
        "at": datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"),
        "config": config,
        "metrics": metrics,
        "artifacts": artifacts or {},
        "revision": source_revision(),
        "python": platform.python_version(),
        "spark": pyspark.__version__,
    }
