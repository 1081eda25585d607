"""Query columns that arrive as a stream, searched against a static lake batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search


def search_stream(queries: DataFrame, lake: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that hands each batch's result to sink(result, batch number).

    A query column has to arrive within one batch. A batch may be handed over twice after a failure; a
    sink that writes by batch number makes that harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            sink(search(kept, lake, **options), number)
        finally:
            kept.unpersist()

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
