"""Streaming entry point.

The analysed tool has no stream, watermark, window or state. The only
streaming use kept here is operational: new repository snapshots that land
as ``source_files`` parquet in a folder are analysed as they arrive, each
micro-batch with the same batch plan (``plans.analysis.analyse``). A
snapshot must hold every file of its repos (the package-level detectors
need whole packages); findings are appended to a table partitioned by repo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SOURCE_FILES


def analyse_stream(spark: SparkSession, source_dir: str, findings_dir: str, checkpoint_dir: str):
    """Start a query: parquet snapshots in ``source_dir`` -> findings in
    ``findings_dir``. ``checkpoint_dir`` must be a shared folder."""
    from ..plans.analysis import analyse

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        res = analyse(batch)
        (res["findings"].write.mode("append").partitionBy("repo").parquet(findings_dir))

    stream = spark.readStream.schema(SOURCE_FILES).parquet(source_dir)
    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_dir).start())
