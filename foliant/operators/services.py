"""What remote services add, as joins to tables of their results: no call leaves the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import uri as U

#: Modality and analyser of each type that an analysis service takes (fixed values).
MODALITIES = {".pdf": "document", ".docx": "document", ".pptx": "document", ".xlsx": "document", ".html": "document", ".txt": "document", ".md": "document", ".eml": "document", ".msg": "document", ".jpg": "image", ".jpeg": "image", ".png": "image", ".tiff": "image", ".bmp": "image", ".wav": "audio", ".mp3": "audio", ".m4a": "audio", ".flac": "audio", ".mp4": "video", ".mov": "video", ".avi": "video", ".mkv": "video"}
#: Types whose text needs no recognition of characters (fixed values).
TEXTUAL = (".docx", ".pptx", ".xlsx", ".html")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def analysis_route(extension: str = "extension", analyzer: Column | None = None, analyzer_modality: Column | None = None) -> Column:
    """struct(modality, analyzer, features): the caller's analyser if it takes the type (document ones take images too), else the prebuilt one."""
    ext = F.lower(F.col(extension))
    modality = _lookup(MODALITIES, ext)
    prebuilt = F.concat(F.lit("prebuilt-"), modality, F.lit("Search"))
    chosen = prebuilt
    if analyzer is not None:
        fits = (analyzer_modality == modality) | ((analyzer_modality == "document") & (modality == "image"))
        chosen = F.when(fits, analyzer).otherwise(prebuilt)
    features = F.when(ext.isin(*TEXTUAL), F.array().cast("array<string>")).otherwise(F.array(F.lit("formulas"), F.lit("ocrHighResolution"), F.lit("styleFont")))
    return F.when(modality.isNotNull(), F.struct(modality.alias("modality"), chosen.alias("analyzer"), features.alias("features")))


def analysed_markdown(results: DataFrame) -> DataFrame:
    """Results (document_id, markdown) of an analysis, without comments."""
    return results.withColumn("markdown", T.normalize_output(T.strip_comments("markdown")))


def with_transcripts(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """pages (url) with the transcript (video_id, transcript) of their video."""
    return pages.withColumn("video_id", U.video_id("url")).join(transcripts, "video_id", "left")


def with_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """images (document_id, sha256, markdown) with the caption (sha256, caption) of their content under a heading."""
    joined = images.join(captions, "sha256", "left")
    caption = F.trim(F.coalesce("caption", F.lit("")))
    return joined.withColumn("markdown", F.when(caption != "", T.strip(F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n\n# Description:\n"), caption))).otherwise(F.col("markdown"))).drop("caption")


def with_speech(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """audio (document_id, markdown) with what was said (document_id, transcript)."""
    joined = audio.join(transcripts, "document_id", "left")
    said = F.when(F.trim("transcript") == "", "[No speech detected]").otherwise(F.trim("transcript"))
    return joined.withColumn("markdown", F.when(F.col("transcript").isNotNull(), T.strip(F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n\n### Audio Transcript:\n"), said))).otherwise(F.col("markdown"))).drop("transcript")


def ocr_pages(pieces: DataFrame, recognised: DataFrame) -> DataFrame:
    """(document_id, markdown): text pieces (page, top, text) and recognised images (page, top, text) of each page, by height."""
    marked = F.concat(F.lit("*[Image OCR]\n"), F.trim("text"), F.lit("\n[End OCR]*"))
    both = pieces.select("document_id", "page", "top", F.lit(0).alias("kind"), "text").unionByName(recognised.where(F.trim("text") != "").select("document_id", "page", "top", F.lit(1).alias("kind"), marked.alias("text")))
    page = both.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "kind", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    page = page.withColumn("body", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.col("body")))
    return page.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n\n").alias("markdown"))


def image_html(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """Images (resource_sha) whose HTML a caller gives (resource_sha, html); a blank fragment keeps the native form."""
    joined = nodes.join(fragments, "resource_sha", "left")
    return joined.withColumn("html", F.nullif(F.trim("html"), F.lit("")))
