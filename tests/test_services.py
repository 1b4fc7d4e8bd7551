"""Joins to results of services."""

from pyspark.sql import functions as F

from foliant.operators import services as S


def test_routes(spark):
    df = spark.createDataFrame([(".pdf",), (".PNG",), (".docx",), (".bin",)], "extension string")
    rows = [r.r for r in df.select(S.analysis_route(analyzer=F.lit("mine"), analyzer_modality=F.lit("document")).alias("r")).collect()]
    assert [(r.modality, r.analyzer, len(r.features)) if r else None for r in rows] == [("document", "mine", 3), ("image", "mine", 3), ("document", "mine", 0), None]


def test_joins(spark):
    pages = spark.createDataFrame([("https://youtu.be/a",), ("https://x.org/",)], "url string")
    assert {r.transcript for r in S.with_transcripts(pages, spark.createDataFrame([("a", "said")], "video_id string, transcript string")).collect()} == {"said", None}
    audio = spark.createDataFrame([(1, "Title: x"), (2, None), (3, "y")], "document_id int, markdown string")
    got = {r.document_id: r.markdown for r in S.with_speech(audio, spark.createDataFrame([(1, "hi"), (2, " ")], "document_id int, transcript string")).collect()}
    assert got == {1: "Title: x\n\n### Audio Transcript:\nhi", 2: "### Audio Transcript:\n[No speech detected]", 3: "y"}
    images = spark.createDataFrame([(1, "s", "ImageSize: 1x1")], "document_id int, sha256 string, markdown string")
    assert S.with_captions(images, spark.createDataFrame([("s", " a cat ")], "sha256 string, caption string")).first().markdown == "ImageSize: 1x1\n\n# Description:\na cat"
    pieces = spark.createDataFrame([(1, 1, 50.0, "below"), (1, 1, 5.0, "top"), (1, 2, 1.0, "next")], "document_id int, page int, top double, text string")
    seen = spark.createDataFrame([(1, 1, 20.0, "img"), (1, 2, 3.0, " ")], "document_id int, page int, top double, text string")
    assert S.ocr_pages(pieces, seen).first().markdown == "## Page 1\n\ntop\n\n*[Image OCR]\nimg\n[End OCR]*\n\nbelow\n\n## Page 2\n\nnext"
    assert S.analysed_markdown(spark.createDataFrame([("a<!-- x -->  \n",)], "markdown string")).first().markdown == "a\n"
