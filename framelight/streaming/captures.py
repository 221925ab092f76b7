"""Rotating captures as a stream: whole files per micro-batch, so no state crosses batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from framelight.plans.packets import packets
from framelight.sources.capture import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_packets(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 64,
    pattern: str = "*.pcap*") -> StreamingQuery:
    """Dissects each new file once and hands every batch's packet table to ``sink(df, batch_id)``.

    Numbering, anchors and connections live within a file, so a batch of whole files gives the rows that
    a batch read gives.  A replayed batch has the same rows under the same id.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, ident: int) -> None:
        sink(packets(parse_files(batch)), ident)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
