"""Effects from panel rows that arrive over time (an extension: the batch analyses do not need it).

Components are additive, so arriving residual rows are summed by (year, month, block) within each micro-batch and stored
under the batch's number.  A batch that is run again replaces its own rows, and the table read back sums all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.components import components, merged

KEYS = ["year", "month", "block"]


def accumulate(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that adds the components of a stream of rows with d, r, year, month and block."""

    def add(batch: DataFrame, number: int) -> None:
        components(batch, KEYS).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """The components of all batches so far."""
    return merged(spark.read.option("basePath", path).parquet(path), KEYS)
