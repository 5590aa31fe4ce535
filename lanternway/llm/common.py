"""Shared plumbing: where tables are written, how batches are read.

Everything that must survive a lost executor is written as Parquet in the folder that the cluster
names in ``spark.checkpoint.dir``; nothing relies on local checkpoints or machine-local folders.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begin of the name of a session's folder.
RUN = "lanternway"


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder below the session's ``spark.checkpoint.dir``.

    On a cluster the setting must be there: a machine's own folder would be another one on each executor.
    Only a local session (tests) that lacks it gets a temporary folder.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that all machines share")
        found = _local_folder(spark.sparkContext.applicationId)
    return f"{found.rstrip('/')}/{RUN}-{spark.sparkContext.applicationId}"


@lru_cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"{RUN}-")


def written(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """`df` written once to the shared folder and read again: the lineage ends at durable files.

    `instead`: a table that an earlier call wrote and that nothing needs once this one is written; it goes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if instead is not None:
        for old in {f.rsplit("/", 1)[0] for f in instead.inputFiles()}:
            _remove(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> None:
    """Removes all that this session has written to the shared folder; results that still read it must be saved before."""
    _remove(spark, shared_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    if f"/{RUN}-" in folder:  # never anything but what `written` has made
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or it with underscores before it if columns of that name are there."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that no other column can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`, so that memory stays bounded."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = batch.column(at)
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def hex64(values: np.ndarray) -> list[str]:
    return [f"{v:016x}" for v in values.astype(np.uint64).tolist()]
