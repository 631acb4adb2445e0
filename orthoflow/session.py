"""Session helpers: a local session for tests and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orthoflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a packed row is a whole matrix: cap Arrow batches by bytes as well as by rows
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, named by ``spark.checkpoint.dir``.

    Only a local session, whose driver and tasks share one disk, gets a scratch folder when none
    is configured; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="orthoflow-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for tables written to cut lineage."""
    root = ensure_checkpoint_dir(spark)
    import uuid
    from urllib.parse import urlparse

    if root.startswith("file:"):
        # a plain path, so Python file APIs (the matstream source) and Spark agree on it
        root = urlparse(root).path

    path = os.path.join(root, "orthoflow-tables", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (zip shipped once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_orthoflow_shipped", False):
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="orthoflow-pkg-")
    archive = shutil.make_archive(os.path.join(out, "orthoflow"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="orthoflow")
    sc.addPyFile(archive)
    sc._orthoflow_shipped = True
