"""Staged tables: written to the folder that the cluster names in spark.checkpoint.dir and read again.

A staged table is worked out once, so everything read from it agrees, and it outlives lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only where none is set and Spark runs in this process alone, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Staged tables that were made within `scratch`.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are staged within go when it ends: what was computed from them must have been written or counted by then."""
    mark = _made.set([])
    try:
        yield
    finally:
        for df in _made.get():
            unstage(df)
        _made.reset(mark)


def stage(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and no work is done twice. A lasting table outlives `scratch`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if _made.get() is not None and not lasting:
        _made.get().append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads; one that is gone already is no fault."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
