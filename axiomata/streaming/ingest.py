"""Corpus files that arrive as a stream, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from axiomata.operators.store import Store
from axiomata.sources import corpus


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Starts a query that upserts every file of a folder, once.

    Files are whole: one that isn't an array of entries is passed over. Within a batch entries are
    in the order of their files' paths and their places, and the later of an id stays, as in a batch ingest.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        entries, _skipped = corpus.entries_of(batch)
        good, _rejected = corpus.analysed(corpus.sides(entries))
        store.upsert(good, ["seq", "pos"])

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
