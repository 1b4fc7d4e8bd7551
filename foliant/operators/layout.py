"""Tables out of word boxes: words (document_id, page, width, text, x0, x1, top) become rows, columns and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("document_id", "page")


def row_bands(words: DataFrame, step: float = 5.0) -> DataFrame:
    """words with ``band``, the nearest multiple of ``step`` to their top (halves go to the even one)."""
    return words.withColumn("band", F.bround(F.col("top") / step) * step)


def gap_groups(words: DataFrame, gap: float = 50.0) -> DataFrame:
    """words with ``group_no`` inside their band: a new one where the distance to the word before exceeds ``gap``."""
    w = Window.partitionBy(*PAGE, "band").orderBy("x0", "x1", "text")
    new = F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def band_rows(words: DataFrame, gap: float = 50.0) -> DataFrame:
    """One row a band: its groups (x0, text), extent, text and whether it is a paragraph (wide and long)."""
    grouped = gap_groups(words, gap).groupBy(*PAGE, "band", "group_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("width").alias("width"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ").alias("text"))
    rows = grouped.groupBy(*PAGE, "band").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("groups"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max("width").alias("width"))
    text = F.array_join(F.transform("groups", lambda g: g["text"]), " ")
    rows = rows.withColumn("text", text)
    paragraph = (F.col("right") - F.col("left") > 0.55 * F.col("width")) & (F.length("text") > 60)
    return rows.withColumns({"paragraph": paragraph, "numbered": F.rlike("text", F.lit(r"^\s*\.\d+(\s|$)"))})


def column_tolerance(rows: DataFrame) -> DataFrame:
    """(document_id, page, tolerance): 70th percentile of the gaps between group starts, held to 25..50; 35 for under three gaps."""
    starts = rows.where("not paragraph").select(*PAGE, F.explode("groups.x0").alias("x")).distinct()
    gaps = starts.withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy(*PAGE).orderBy("x"))).where("gap > 5")
    ranked = gaps.withColumns({"k": F.row_number().over(Window.partitionBy(*PAGE).orderBy("gap")), "n": F.count("*").over(Window.partitionBy(*PAGE))})
    at = ranked.where("k = least(n, int(n * 0.7) + 1)")
    got = at.select(*PAGE, F.when(F.col("n") < 3, 35.0).otherwise(F.greatest(F.lit(25.0), F.least(F.lit(50.0), F.col("gap")))).alias("tolerance"))
    return rows.select(*PAGE).distinct().join(got, list(PAGE), "left").withColumn("tolerance", F.coalesce("tolerance", F.lit(35.0)))


def columns(rows: DataFrame) -> DataFrame:
    """(document_id, page, column_no, x): starts of groups, merged while they are within the page's tolerance of the one before."""
    starts = rows.where("not paragraph").select(*PAGE, F.explode("groups.x0").alias("x")).distinct().join(column_tolerance(rows), list(PAGE))
    w = Window.partitionBy(*PAGE).orderBy("x")
    new = F.when(F.col("x") - F.lag("x").over(w) <= F.col("tolerance"), 0).otherwise(1)
    numbered = starts.withColumn("_new", new).withColumn("column_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*PAGE, "column_no").agg(F.min("x").alias("x"))


def table_rows(rows: DataFrame, aligned: float = 40.0) -> DataFrame:
    """rows with ``is_table``: two groups or more that start within ``aligned`` of different columns, no paragraph, not numbered."""
    cols = columns(rows).groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = rows.join(cols, list(PAGE), "left")
    hits = F.size(F.filter("xs", lambda x: F.exists("groups", lambda g: F.abs(g["x0"] - x) <= aligned)))
    return joined.withColumn("is_table", F.coalesce((hits >= 2) & (F.size("groups") >= 2) & ~F.col("paragraph") & ~F.col("numbered"), F.lit(False)))


def table_regions(rows: DataFrame) -> DataFrame:
    """rows with ``region``: runs of table rows and of others, numbered down the page (gaps and islands)."""
    w = Window.partitionBy(*PAGE).orderBy("band")
    turn = F.when(F.lag("is_table").over(w).eqNullSafe(F.col("is_table")), 0).otherwise(1)
    return rows.withColumn("_turn", turn).withColumn("region", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def cells_of(rows: DataFrame, slack: float = 20.0) -> DataFrame:
    """Table rows with ``cells``: each group goes to the last column that starts at most ``slack`` right of it."""
    at = lambda g: F.greatest(F.lit(0), F.size(F.filter("xs", lambda x: x - slack <= g["x0"])) - 1)
    placed = F.transform("groups", lambda g: F.struct(at(g).alias("c"), g["text"].alias("text")))
    cells = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda c: F.array_join(F.transform(F.filter("placed", lambda p: p["c"] == c), lambda p: p["text"]), " "))
    return rows.where("is_table").withColumn("placed", placed).withColumn("cells", cells).drop("placed")


def page_quality(rows: DataFrame) -> DataFrame:
    """(document_id, page, form): whether the page is a form: columns neither too many nor too narrow, a fifth of its rows in tables."""
    per = rows.groupBy(*PAGE).agg(F.max(F.size(F.coalesce("xs", F.array().cast("array<double>")))).alias("n"), F.max("width").alias("width"), F.avg(F.col("is_table").cast("int")).alias("share"), (F.max("right") - F.min("left")).alias("extent"))
    narrow = F.col("extent") / F.greatest("n", F.lit(1)) < 30
    many = (F.col("n") > F.greatest(F.lit(15.0), 20 * F.col("width") / 612)) | (F.col("n") / (F.col("extent") / 72) > 10)
    return per.select(*PAGE, (~narrow & ~many & (F.col("share") >= 0.2) & (F.col("n") >= 2)).alias("form"))


def form_markdown(words: DataFrame) -> DataFrame:
    """(document_id, page, markdown) of pages that are forms: tables as pipe tables, the lines between as they are."""
    rows = table_regions(table_rows(band_rows(row_bands(words))))
    rows = rows.join(page_quality(rows).where("form"), list(PAGE))
    from ..functions import text as T

    cells = cells_of(rows).select(*PAGE, "region", "band", "cells")
    first = F.row_number().over(Window.partitionBy(*PAGE, "region").orderBy("band")) == 1
    tables = cells.withColumn("line", F.when(first, F.concat_ws("\n", T.pipe_row("cells"), T.pipe_separator(F.size("cells")))).otherwise(T.pipe_row("cells")))
    lines = tables.select(*PAGE, "region", "band", "line").unionByName(rows.where("not is_table").select(*PAGE, "region", "band", F.col("text").alias("line")))
    blocks = lines.groupBy(*PAGE, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "block"))), lambda x: x["block"]), "\n\n").alias("markdown"))


def nearest_columns(words: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """words with the nearest of their page's x-clusters (ties to the left)."""
    w = Window.partitionBy(*PAGE).orderBy("x0")
    xs = words.select(*PAGE, "x0").distinct()
    new = F.when(F.col("x0") - F.lag("x0").over(w) <= tolerance, 0).otherwise(1)
    clusters = xs.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).groupBy(*PAGE, "cluster").agg(F.min("x0").alias("x"))
    per = clusters.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "cluster"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(F.abs(c["x"] - F.col("x0")).alias("d"), c["cluster"].alias("cluster"))))
    return words.join(per, list(PAGE)).withColumn("column_no", near["cluster"]).drop("cs")
