"""Where what is written between steps goes: the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, of the session or else of its context; only local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tallyloom-"))
        root = _LOCAL[0]
    return root.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{label}/{uuid4().hex}"
