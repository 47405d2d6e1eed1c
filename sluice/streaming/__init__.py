"""Queries over Structured Streaming inputs.

No state crosses records, so none crosses micro-batches: a query of row operators runs as a native streaming plan, any other inside
foreachBatch, where the batch is an ordinary DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Node, Query
from ..operators.lowering import is_row_wise

Writer = Callable[[DataFrame, int], None]


def is_native(query: Query) -> bool:
    """Whether a query runs as a streaming plan of its own."""
    return is_row_wise(query.tree)


def start(query: Query, stream: DataFrame, write: Writer, checkpoint: str, record_key: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query over a stream; `write` gets the rows of each micro-batch and its number.

    A batch may be written again after a failure, under the same number, so a writer that keeps one result for each number
    writes each row once."""
    if is_native(query):
        return query.apply(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            write(query.apply(held, record_key=record_key), number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_node(node: Node, stream: DataFrame, writers: Mapping[str, Writer], checkpoint: str, record_key: str | None = None, **trigger) -> StreamingQuery:
    """Starts all queries of a node over one reading of a stream, each with the writer of its name."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, rows in node.apply(held, record_key=record_key).items():
                if name in writers:
                    writers[name](rows, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
