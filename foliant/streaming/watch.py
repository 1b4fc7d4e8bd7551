"""A folder as a stream of documents, converted by the same stateless operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import uri as U
from ..operators.convert import convert

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, a bounded number a batch."""
    df = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return df.select(F.col("path").alias("document_id"), "content", U.basename("path").alias("filename"), U.extension("path").alias("extension"))


def convert_stream(documents: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append converted documents to a Parquet folder; with ``once`` what is there now, then end."""
    writer = convert(documents).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
