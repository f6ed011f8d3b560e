"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC clocks, AQE (coalescing + skew-join split), ANSI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "opsdesk", extra: dict | None = None) -> SparkSession:
    """A session with the library's settings.  Master and shuffle partitions are left to the
    cluster (``spark-submit``) unless given, as local runs and tests do."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (None when unset)."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only in local mode, where driver and tasks share one
    machine, create a private scratch folder for this run when none is configured."""
    existing = checkpoint_dir(spark)
    if existing:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(existing)
        return existing
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"master {master} needs a shared folder in spark.checkpoint.dir: a folder of the "
                           "driver's machine is not seen by the executors")
    local = tempfile.mkdtemp(prefix="opsdesk-ckpt-", dir=os.environ.get("OPSDESK_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for streaming checkpoints and sinks."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write once to a fresh folder of the shared checkpoint folder and read back: cuts the lineage
    and survives lost executors (the owner of that folder removes it)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``opsdesk`` importable in Python workers (pandas UDFs, state functions): zip the
    package once per application into the shared scratch folder and ``addPyFile`` it."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = scratch_path(spark, f"pyfiles-{app}")
    if "://" in target and not target.startswith("file:"):
        # remote checkpoint folder (e.g. hdfs://): build the zip on the driver; addPyFile copies
        # it to Spark's file server, from where every executor fetches it (code, not data)
        target = tempfile.mkdtemp(prefix="opsdesk-pyfiles-")
    target = target[len("file:"):] if target.startswith("file:") else target
    os.makedirs(target, exist_ok=True)
    path = os.path.join(target, "opsdesk.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
