"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    found = tempfile.mkdtemp(prefix="larkspur-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{folder(spark)}/larkspur-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows from a written table: lineage ends here, and a lost executor costs nothing computed before."""
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table of a frame that `saved` gave, once no frame that is still to be computed reads it."""
    _delete(df.sparkSession, df.saved_at)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written elsewhere."""
    _delete(spark, _own(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column (in any case) has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
