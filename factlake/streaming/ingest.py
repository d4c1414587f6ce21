"""Continuous ingest of landed files: each micro-batch goes through the idempotent sink, so replays add nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_new

#: How long a content's hash stays in the stream's state after its first arrival.
REMEMBERED = "7 days"


def stream_documents(spark: SparkSession, path: str, pattern: str = "*.zip", **options) -> DataFrame:
    """Files as they land; options as of the file source (maxFilesPerTrigger)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).options(**options).load(path)
    return files.select(F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size_bytes"), F.col("path").alias("storage_path"), F.col("modificationTime").alias("first_seen_at"))


def first_arrivals(documents: DataFrame, key: str = "content_sha256", remembered: str = REMEMBERED) -> DataFrame:
    """The stream without contents that arrived before, as far back as they are remembered.

    State is kept by key and expires by time of arrival, so a file is never late, however old it is.
    """
    arrived = "arrived_at"
    return documents.withColumn(arrived, F.current_timestamp()).withWatermark(arrived, remembered).dropDuplicatesWithinWatermark([key]).drop(arrived)


def start_registration(documents: DataFrame, table_path: str, checkpoint: str, remembered: str = REMEMBERED, **trigger) -> StreamingQuery:
    """Registers every new content once; trigger as in writeStream (availableNow=True for what is there).

    What the state remembers never reaches the table. The rest, new contents and forgotten ones, is
    appended by the table's index, which names the files that may hold them, so what a micro-batch reads
    does not grow with the table; a batch that is replayed adds nothing.
    """

    def register(batch: DataFrame, _: int) -> None:
        append_new(batch, table_path, "content_sha256", ["first_seen_at", "storage_path"], "content_sha256")

    return first_arrivals(documents, remembered=remembered).writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
