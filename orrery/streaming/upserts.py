"""Late and amended rows of a stream: an extension, as the batch operators have no streaming form of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import first_by
from ..operators.panels import upserted


def latest_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_batches(folder: str, keys: list[str], order: str):
    """A function for foreachBatch: each batch makes a new version of the table, and the newest version is the table.

    Versions are named by the batch, so that a batch that runs again writes the same one.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = first_by(batch, keys, [F.col(order).desc()])
        if number:
            new = upserted(batch.sparkSession.read.parquet(f"{folder}/v={number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return run
