"""Portfolio evaluation of assets that arrive as a stream of files, joined to the static curve table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terragrist.operators.portfolio import Assets, Evaluation


def stream_assets(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(request: Evaluation, arriving: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends the evaluation of each batch of assets; exactly once, by the checkpoint and the file sink. Stateless, so no watermark is needed."""
    a = request.assets
    live = replace(request, assets=Assets(arriving, a.id_col, a.longitude, a.latitude, a.cell_col, a.passthrough))
    return live.evaluate().writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
