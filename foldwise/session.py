"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldwise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder all executors share.

    The folder is ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder: on a cluster such a folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="foldwise-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
