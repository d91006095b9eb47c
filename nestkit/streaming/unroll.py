"""Unrolling on Structured Streaming.

The functions on text work on a streaming frame as they are. Nodes need windows within a document, which streams do not
have, but a document arrives whole, so each micro-batch is unrolled as a batch of its own and handed to a sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.unroll import unrolled


def unroll_stream(stream: DataFrame, by: str | Sequence[str], text: str, upto: int | None, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that gives the nodes of each micro-batch, with the batch's number, to sink; start() it."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(unrolled(batch, by, text, upto, **options), number))


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to a folder of its own, so that a batch that is run again replaces its earlier result."""
    return lambda nodes, number: nodes.write.mode("overwrite").parquet(f"{path}/batch={number}")
