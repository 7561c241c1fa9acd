"""Structured Streaming: incremental ingest of files, and folding of answer events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import chatlog
from lexweave.sources import files as S
from lexweave.sources import ingest


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """(path, pages) of text files as they arrive; a path is read once, as the batch ingest does."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.array("value").alias("pages")).where(~F.lower("path").endswith(".meta.json"))


def ingest_stream(spark: SparkSession, root: str, store: S.ChunkStore, checkpoint: str) -> StreamingQuery:
    """Chunk new files and upsert them, batch by batch; repeated batches change nothing. Stops when all is read."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        pages = S.with_sidecars(batch, S.sidecars(spark, [root]))
        store.upsert(ingest.chunks_of(S.assemble(pages)))

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Fold events (conversation_id, seq, type, content) per conversation and hand each update to the sink."""
    return chatlog.fold_events(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
