"""Parquet tables of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: record_id, idx, speaker, text."""
    return read(spark, sf_dir, "conversations").selectExpr("conv_id AS record_id", "turn AS idx", "role AS speaker", "text")


def shared(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``; in local mode without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="annalist-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is; one that is gone doesn't matter."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
