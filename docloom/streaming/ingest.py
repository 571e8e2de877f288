"""Pages that arrive as files: the batch queries over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "page_id long, url string, html string"


def pages(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def start(stream: DataFrame, query: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch query on each micro-batch; a batch that is done again replaces its own folder, so results count once."""

    def put(batch: DataFrame, epoch: int) -> None:
        query(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
