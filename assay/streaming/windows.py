"""A fixed window of a stream, taken as a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame


def take_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write all that a streaming frame holds now to ``path`` as Parquet, once, and read it back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
