import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from verbatica.plans.stages import Stage, run_stages
from verbatica.sources import io as sources
from verbatica.streaming.ingest import accept, start_ingest


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿id,transcription\n1,"a, ""b""\nc"\n2,\n3,x,extra\n'.encode())
    got = {r["id"]: r["transcription"] for r in sources.read_csv(spark, str(path)).collect()}
    assert got == {"1": 'a, "b"\nc', "2": ""}
    assert sources.bad_csv_rows(spark, str(path)).count() == 1
    with pytest.raises(ValueError):
        sources.load_table(spark, str(path), ["language"], "train")


def test_short_rows_with_quoted_commas_are_filled(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,x,y\n2,"p,q,r,s"\n3,"p,""q"",r",s,t\n4,"a \\", b",c\n')
    for multi_line in (True, False):
        got = sorted(tuple(r) for r in sources.read_csv(spark, str(path), multi_line=multi_line).collect())
        assert got[:2] == [("1", "x", "y"), ("2", "p,q,r,s", "")] and "3" not in {r[0] for r in got}
        assert sources.bad_csv_rows(spark, str(path), multi_line=multi_line).count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 'q"uote, x'), ("a", "line\nbreak")], "ID string, Target string").withColumn("extra", F.lit(1))
    sources.write_csv(df, str(tmp_path / "o"), ["ID", "Target"], "ID")
    assert {(r["ID"], r["Target"]) for r in sources.read_csv(spark, str(tmp_path / "o")).collect()} == {("b", 'q"uote, x'), ("a", "line\nbreak")}


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"transcription": "one", "audio_filepath": "a"}\n{"transcription": ["two", "three"], "audio_filepath": "b"}\nbroken\n')
    assert sorted((r["audio_filepath"], r["transcription"]) for r in sources.read_manifest(spark, str(path)).collect()) == [("a", "one"), ("b", "three"), ("b", "two")]


def test_archives_and_files(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar.xz", "w:xz") as tar:
        for name in ("x/one.wav", "x/two.wav", "x/note.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    got = sources.unpack_archives(spark, str(tmp_path / "*.tar.xz"), ".wav")
    assert sorted(r["stem"] for r in got.collect()) == ["one", "two"]
    decoded = sources.map_media(got, lambda b: [len(b)] if b else 1 / 0).collect()
    assert all(r["samples"] == [3.0] and r["error"] is None for r in decoded)
    assert [r["id"] for r in sources.files_by_id(spark, str(tmp_path / "*.xz")).collect()] == ["s.tar"]


def test_splits_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    sources.write_splits(df, path)
    sources.write_splits(spark.createDataFrame([("c", "test")], "id string, split string"), path)
    assert sorted((r["id"], r["split"]) for r in spark.read.parquet(path).collect()) == [("a", "train"), ("c", "test")]


def test_small_sinks(spark, tmp_path):
    sources.write_report({"b": 1, "a": {"d": None}}, str(tmp_path / "r" / "x.json"))
    assert list(json.loads((tmp_path / "r" / "x.json").read_text())) == ["a", "b"]
    log = str(tmp_path / "log")
    for k in range(2):
        sources.append_log(spark.createDataFrame([(k,)], "run int"), log)
    assert spark.read.json(log).count() == 2
    sources.write_corpus(spark.createDataFrame([("x", "lin"), ("y", "sna")], "t string, language string"), str(tmp_path / "c"), "t", "language")
    assert (tmp_path / "c" / "language=lin").is_dir()


def test_names_and_configuration(spark):
    df = spark.createDataFrame([("lin_1", "", "x")], "Id string, Text string, Sentence string")
    assert sources.column_among(df, ["nope", "TEXT"]) == "Text"
    assert sources.pick_text(df, ["text", "sentence"], "t").first()["t"] == "x"
    with pytest.raises(ValueError):
        sources.pick_text(df, ["nope"], "t")
    assert sources.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": None}}) == {"a": {"b": 3, "c": 2}}
    assert sources.experiment_record("a b/", {}, {})["run"] == "a_b"


def test_accept_respects_quota_and_keys(spark):
    batch = spark.createDataFrame([("a", "x", 1, 5.0), ("a", "x", 2, 5.0), ("b", "x", 3, 99.0), ("c", "x", 4, 5.0), ("d", None, 5, 5.0), (None, "x", 6, 5.0)], "id string, g string, o int, d double")
    stored = spark.createDataFrame([("z", "x", 0, 5.0)], "id string, g string, o int, d double")
    got = accept(batch, stored, "id", "g", 2, "o", "d", 1.0, 10.0)
    assert sorted((r["id"], r["o"]) for r in got.collect()) == [("a", 1), ("d", 5)]


def test_stream_resumes(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    schema = "id string, g string, o bigint"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).json(str(inbox))
        start_ingest(stream, table, str(tmp_path / checkpoint), "id", "g", 3, "o").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(table).collect())

    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps({"id": f"a{i}", "g": "x", "o": i}) for i in range(2)))
    assert run("c1") == ["a0", "a1"]
    (inbox / "2.json").write_text("\n".join(json.dumps({"id": f"a{i}", "g": "x", "o": i}) for i in range(1, 6)))
    assert run("c1") == ["a0", "a1", "a2"]
    assert run("c2") == ["a0", "a1", "a2"]


def test_stages_are_skipped_when_done(tmp_path):
    made = tmp_path / "a"
    stages = [Stage("one", str(made), lambda: made.write_text("x")), Stage("two", str(tmp_path / "b"), lambda: (tmp_path / "b").write_text("y"), (str(made),))]
    assert run_stages(stages) == {"one": "done", "two": "done"}
    assert run_stages(stages) == {"one": "skipped", "two": "skipped"}
    with pytest.raises(FileNotFoundError):
        run_stages([Stage("x", str(tmp_path / "c"), lambda: None, (str(tmp_path / "missing"),))])


def test_members_meet_their_manifest(spark):
    members = spark.createDataFrame([("a.tar", "u1", "u1.wav", b"x"), ("b.tar", "u1", "u1.mp3", b"yy"), ("a.tar", "u3", "u3.wav", b"z")], "archive string, stem string, name string, content binary")
    manifest = spark.createDataFrame([("clips/u1.flac", "one"), ("u2.wav", "two")], "audio_filepath string, transcription string")
    assert [(r["stem"], r["archive"], r["transcription"]) for r in sources.members_of_manifest(members, manifest).collect()] == [("u1", "a.tar", "one")]
    files = spark.createDataFrame([("u1", "p/u1"), ("u9", "p/u9")], "id string, path string")
    got = sources.official_files(files, spark.createDataFrame([("u1",), ("u2",), ("u2",)], "id string")).collect()
    assert sorted((r["id"], r["status"]) for r in got) == [("u1", "found"), ("u2", "missing"), ("u9", "extra")]


def test_configurations_caches_and_revisions(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: {b: 1, c: x}\n")
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": "x"}}')
    for name in ("c.yaml", "c.json"):
        assert sources.read_config(str(tmp_path / name), {"a": {"b": 2}}) == {"a": {"b": 2, "c": "x"}}
    assert sources.cache_matches({"model": "m", "revision": "1", "ids": ["a"]}, model="m", ids=["a"])
    assert not sources.cache_matches({"model": "m"}, model="m", revision="1") and not sources.cache_matches(None, model="m")
    assert sources.source_revision(str(tmp_path)) is None
    assert "revision" in sources.experiment_record("x", {}, {})


def test_results_in_the_file_system_of_a_path(spark, tmp_path):
    from verbatica.plans.stages import exists_in

    there = exists_in(spark)
    assert not there(f"file:{tmp_path}/r.json")
    sources.write_report({"b": "ŋ", "a": 1}, f"file:{tmp_path}/r.json", spark)
    assert there(f"file:{tmp_path}/r.json") and json.loads((tmp_path / "r.json").read_text()) == {"a": 1, "b": "ŋ"}
    spark.range(1).write.parquet(f"file:{tmp_path}/t")
    assert there(f"file:{tmp_path}/t") and not there(f"file:{tmp_path}")
