"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("lacuna_written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and Spark runs locally, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lacuna-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back, with its path: what follows does not depend on df's lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"
    if (own := _written.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: small results that many steps read, without the plan that made them."""
    return cut(df, name)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted on leaving: results that still need them must be written or collected before."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for path in paths:
            drop_table(spark, path)
