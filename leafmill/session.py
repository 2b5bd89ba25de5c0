"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEAFMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` decides. Only a local session may fall back to a
    temporary folder: on a cluster that folder would not be visible to all executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="leafmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For results that several later steps use: the work is not repeated, a lost
    executor costs no upstream work, and each reader takes only its columns.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (as ``--py-files`` does)."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="leafmill-package-")) / "leafmill_package"
    # The archive is made on the driver; Spark hands it to the executors itself.
    sc.addPyFile(
        shutil.make_archive(str(base), "zip", root_dir=package.parent, base_dir=package.name)
    )
    sc._leafmill_shipped = True
