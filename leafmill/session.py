"""Session settings and the shared folder for files and checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_base: str | None = None


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "leafmill") -> SparkSession:
    """A single-machine session for tests and the bench. On a cluster use the session it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEAFMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session without the
    setting falls back to a folder of its own; a cluster without it is an error.
    """
    global _local_base
    base = spark.conf.get(_CHECKPOINT_KEY, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="leafmill-")
            atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
        base = _local_base
    return f"{base.rstrip('/')}/leafmill/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
