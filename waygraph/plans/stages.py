"""Cutting lineage with files that every executor can read.

Iterative operators and multi-pass operators write an intermediate table and
read it back.  The files go below ``spark.checkpoint.dir`` (shared storage on a
cluster), so a lost executor costs a re-run of single tasks and never the
table.  Only when the setting is absent and Spark runs on this machine alone, as
in unit tests, a temporary folder is used; on a cluster its absence is an error.
Iterative operators release a round's files once the next round is written and
nothing reads them any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-waygraph-"))
    return f"{base.rstrip('/')}/waygraph/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def release(*stages: DataFrame | None) -> None:
    """Delete the files of superseded stages; frames that are no direct result of ``materialise`` are left alone."""
    for df in stages:
        path = getattr(df, "_stage", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists in whatever file system its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
