"""Session construction, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "verbatica", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, adaptive execution, Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # edit distances make small partitions dear: they are worth a task each
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of the application, once, so that they need no shared code path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    if package.is_file() or not package.is_dir():  # already running from an archive
        return
    folder = tempfile.mkdtemp(prefix="verbatica-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "verbatica_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; only where neither that nor a folder set by the
    application exists and all runs in one process (tests) is a temporary one made, and it is removed at exit. On a
    cluster a folder of one machine would lose rows with it: there the setting is required.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verbatica-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, so that later steps read files and not its lineage.

    A lost executor costs a re-read, not a recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

