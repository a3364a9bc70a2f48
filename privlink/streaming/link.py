"""Linkage of a stream: each micro-batch of encoded records against a fixed, encoded dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import block


def link_stream(stream: DataFrame, base: DataFrame, groups: list[list[int]], collisions: int, threshold: float, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Calls ``sink(matched pairs, batch number)`` for each batch; matching looks at one record of the stream at a time,
    so batches need no state.  The sink must take a repeated batch number as the same batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(block(df, base, groups, collisions, threshold, **options), n)).start()
