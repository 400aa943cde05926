"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", name: str = "factweave", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for tables which cut lineage: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a temporary folder is used, in local mode only, as in tests, since
    no other machine of a cluster could read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
    folder = tempfile.mkdtemp(prefix="factweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
