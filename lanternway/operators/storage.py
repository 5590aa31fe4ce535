"""Intermediate tables that are read more than once, or that end a round of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Begin of the name of a session's folder.
RUN = "lanternway-matching"


def run_folder(spark: SparkSession) -> str:
    """The run's own folder below the session's ``spark.checkpoint.dir``.

    A cluster must name one that all machines share; only a local session (tests) without the setting
    gets a temporary folder.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that all machines share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return f"{folder.rstrip('/')}/{RUN}-{spark.sparkContext.applicationId}"


@lru_cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="lanternway-")


def saved(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """`df` written once to the run's folder and read again.

    The files survive a lost executor, and plans that use the table do not grow. `instead`: a table saved
    before that nothing needs once this one is there; it goes.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        for old in {f.rsplit("/", 1)[0] for f in instead.inputFiles()}:
            _remove(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; where it is absent or was not finished, `make` gives it and it is written first."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remove_intermediates(spark: SparkSession) -> None:
    """Removes all tables of this session's runs; results that still read them must be written before."""
    _remove(spark, run_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    if f"/{RUN}-" in folder:  # never anything but what `saved` has made
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
