"""Each micro-batch of pages is one crawl: the stored index is refreshed by it.

Versions are written side by side and named by batch, so a batch that runs again overwrites
its own version only, and readers keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestream.operators.incremental import refresh
from lodestream.operators.indexing import empty_index
from lodestream.sources import parquet_index


def refresh_from_stream(pages: DataFrame, path: str, checkpoint: str, order: str = "page_order") -> StreamingQuery:
    """pages is a stream of (url, html, order)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = parquet_index.load(spark, f"{path}/v{number - 1}") if number else empty_index(spark)
        new, _ = refresh(old, batch, order)
        parquet_index.save(new, f"{path}/v{number}", mode="overwrite")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
