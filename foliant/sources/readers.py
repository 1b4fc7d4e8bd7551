"""Sources of documents: folders of files, URIs with inline data, tables of fetched responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uri as U


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(document_id, content, filename, extension, local_path, ...) of the files under a path; document_id is the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    return df.select(F.col("path").alias("document_id"), "content", U.basename("path").alias("filename"), U.extension("path").alias("extension"), F.col("path").alias("local_path"), F.lit(None).cast("string").alias("mimetype"), F.lit(None).cast("string").alias("charset"), F.lit(None).cast("string").alias("url"), F.col("length").alias("size_bytes"))


def data_uris(df: DataFrame, column: str = "uri") -> DataFrame:
    """Rows with a data URI as documents."""
    d = U.data_uri(column)
    return df.withColumn("_d", d).select("*", F.col("_d.data").alias("content"), F.col("_d.mimetype").alias("mimetype"), F.try_element_at(F.col("_d.attributes"), F.lit("charset")).alias("charset")).drop("_d")


def responses(df: DataFrame) -> DataFrame:
    """Fetched responses (content, content_type, content_disposition, url) with what their headers say."""
    r = U.response_info("content_type", "content_disposition", "url")
    return df.withColumn("_r", r).select(*df.columns, *[F.col(f"_r.{n}").alias(n) for n in ("mimetype", "charset", "filename", "extension")])


def by_kind(df: DataFrame, column: str = "uri") -> dict[str, DataFrame]:
    """URIs split by the reader that takes them; ``None`` has those that no reader takes."""
    kind = df.withColumn("source_kind", U.source_kind(column))
    return {k: kind.where(F.col("source_kind") == k) for k in ("local", "file", "data", "http")} | {"none": kind.where("source_kind is null")}
