"""Session factory and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine is written for. What the submitter has set (master, partitions, memory, ...) stays; only without a master is it a local one of ``cpus`` threads."""
    given = dict(SparkConf().getAll())
    wanted = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": "pagelattice",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("PAGELATTICE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.config(map={k: v for k, v in wanted.items() if k not in given} | conf).getOrCreate()


def shared_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` materialised in the reliable checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``, which every executor can reach. Only where that is unset and the
    master is this machine alone (a test) a temporary folder is made; on a cluster that is an error. localCheckpoint is never
    used: its only copy dies with an executor.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the same folder, for rounds of a loop: unlike a checkpoint it hands on no size estimates, which multiply from join to join and make each round's planning slower than the last."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagelattice-"))
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
