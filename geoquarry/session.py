"""Session helpers: settings the engine likes, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(
    app: str = "geoquarry", master: str | None = None, **settings: str
) -> SparkSession:
    """Return a session with adaptive execution, UTC and case-sensitive names."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Return the folder every executor can reach, as the cluster names it.

    Only a session without the setting (tests, local mode) gets a temporary
    folder, and then the setting is recorded so that later calls agree.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="geoquarry-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def ensure_checkpoints(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder when nothing did so yet."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Return a new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_cores() -> int:
    """Return how many cores a local session should use."""
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="geoquarry-code-")
    archive = os.path.join(folder, "geoquarry_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for package in ("geoquarry", "workload"):
            for place, _folders, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(place, name)
                        packed.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
