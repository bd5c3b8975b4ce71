"""Spark session helpers.

Library code never builds its own session: every operator takes DataFrames.
These helpers are for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shelfwise") -> SparkSession:
    """Session with AQE, skew-join splitting and Arrow enabled.

    ``shuffle_partitions`` defaults to the number of local cores; on a cluster
    pass a value sized so a shuffle partition stays around 128-256 MB.
    """
    master = master or os.environ.get("SHELFWISE_MASTER", "local[*]")
    cores = os.cpu_count() or 8
    parts = shuffle_partitions or int(os.environ.get("SHELFWISE_SHUFFLE_PARTITIONS", cores))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is
    (a cluster without it is an error, never a machine-local folder). Only
    local-mode runs (tests, bench) get a temporary folder when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder all executors share "
                         "(checkpoints and round-trip tables are written there)")
    folder = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shelfwise`` importable in Python workers, whatever the driver's cwd.

    UDFs and ``mapInPandas`` bodies are pickled by reference to this package.
    The package is zipped and added with ``addPyFile`` (Spark ships it to every
    executor), and for local mode the package root also goes on the workers'
    ``PYTHONPATH``. Done once per application.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    env = sc.environment.get("PYTHONPATH", "")
    if root not in env.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join([p for p in (root, env) if p])
    # driver-side file handed to Spark's file server; executors fetch it from there
    fd, path = tempfile.mkstemp(prefix="shelfwise-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
