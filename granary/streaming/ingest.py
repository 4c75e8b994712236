"""Streams of chunks into a collection.

Each micro-batch is one segment of the collection's log, committed under the stream's name and the batch's number: a batch that is run
again after a failure finds itself in the log and changes nothing, and one that failed before its commit was never seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary.sources.store import Collection


def stream_into(chunks: DataFrame, collection: Collection, checkpoint: str, order: str, replace_documents: bool = False, once: bool = True, fold: int = 32) -> StreamingQuery:
    """Start a query that writes a stream of chunks (fields, embedding) into the collection. Of a batch's chunks with one id the
    last by ``order`` counts. once: stop when what is there now has been read. Every ``fold`` batches the segments after the base
    are folded into one."""

    def write(batch: DataFrame, number: int) -> None:
        collection.upsert(batch, order, replace_documents, stream=(checkpoint, number))
        if number % fold == fold - 1:
            collection.compact()

    out = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
