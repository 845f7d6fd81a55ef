"""Tables that are worked out once for an application and a folder of inputs, and read from the shared folder afterwards."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if Spark is one local process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "ledgerframe-shared")


def stored_path(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """Where write(path) has put `name` of `source`: called once per application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _PATHS:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a Parquet table that is written once per application."""
    return spark.read.parquet(stored_path(spark, source, name, lambda path: make().write.parquet(path)))
