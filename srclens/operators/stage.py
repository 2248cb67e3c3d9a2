"""Materialization of intermediate fact tables.

``stage`` writes a table once as Parquet below the shared folder that the
session names in ``spark.checkpoint.dir`` and reads it back: the lineage ends
there (a lost executor re-reads files instead of re-running the scan and the
windows), and every reader takes only the columns and row groups it needs. A
session without that setting gets a folder of its own only on a local master
(tests, bench); on a cluster it is an error, because executors would not see
the driver's disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def staging_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark)


def stage(df: DataFrame, name: str = "facts", by: list[str] | None = None) -> DataFrame:
    """``by``: columns whose values get a folder each."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/srclens-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Facts(dict):
    """Fact tables by name, each built (and staged) when first asked for, so that a detector plans and runs only what it reads."""

    def __init__(self, makers: dict):
        super().__init__()
        self.makers = makers

    def keep(self, name: str) -> None:
        """Stage a table that several of the caller's steps read."""
        self[name] = stage(self[name], f"facts-{name}")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table = self.makers[name](self)
        return table
