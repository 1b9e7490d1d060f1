"""Running stages whose results are files: a stage whose result exists is skipped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    output: str
    run: Callable[[], None]
    needs: tuple[str, ...] = ()


def exists_in(spark: SparkSession) -> Callable[[str], bool]:
    """Whether a finished result is there, in the file system that the path names."""

    def there(path: str) -> bool:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        return fs.exists(at) and (fs.getFileStatus(at).isFile() or fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))

    return there


def run_stages(stages: list[Stage], exists: Callable[[str], bool] | None = None) -> dict[str, str]:
    """``done`` or ``skipped`` for every stage, in order; a stage whose inputs are missing is an error.

    ``exists`` looks on this machine by default; ``exists_in`` gives one for a cluster's file system.
    """
    there = exists or (lambda p: (Path(p) / "_SUCCESS").exists() or Path(p).is_file())
    out: dict[str, str] = {}
    for stage in stages:
        if there(stage.output):
            out[stage.name] = "skipped"
            continue
        missing = [p for p in stage.needs if not there(p)]
        if missing:
            raise FileNotFoundError(f"stage {stage.name} needs {missing}")
        stage.run()
        out[stage.name] = "done"
    return out
