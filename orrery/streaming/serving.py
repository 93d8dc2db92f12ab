"""Answering streams of queries: each micro-batch is one batch search against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from orrery.config import SearchConfig
from orrery.operators import coarse, index


def serve(queries: DataFrame, path: str, options: SearchConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Searches the index at ``path`` for a stream of (vec_id, embedding).

    ``sink`` gets (query_id, rank, vec_id, dist) and the batch number; a batch that is run again has the same number and
    rows, so a sink that overwrites by it is exactly-once.
    """
    spark = queries.sparkSession
    blocks, cents, config = index.load(spark, path)
    built = coarse.build(cents, config) if options.coarse_kind(cents.count()) != "flat" else None

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(index.search(blocks, df, cents, config, options, built), number)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
