"""Grids as Markdown: pipe tables, aligned tables, sheets and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def trim_blank_rows(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows (key, row, cells) without blank ones before the header, right after it or at the end; a blank row has no cells."""
    w = Window.partitionBy(key)
    solid = F.size("cells") > 0
    first = F.min(F.when(solid, F.col("row"))).over(w)
    last = F.max(F.when(solid, F.col("row"))).over(w)
    second = F.min(F.when(solid & (F.col("row") > F.col("_first")), F.col("row"))).over(w)
    out = rows.withColumns({"_first": first, "_last": last}).withColumn("_second", second)
    keep = (F.col("row") == F.col("_first")) | ((F.col("row") >= F.col("_second")) & (F.col("row") <= F.col("_last")))
    return out.where(keep).drop("_first", "_last", "_second")


def pad_rows(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Every row as wide as the widest of its table."""
    width = F.max(F.size("cells")).over(Window.partitionBy(key))
    return rows.withColumn("_width", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("_width") - F.size("cells")))).drop("_width")


def table_markdown(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, markdown): header, separator, rows. One shuffle by key; lines are put in order inside the aggregate."""
    lines = rows.select(key, "row", T.pipe_row("cells").alias("line"), F.size("cells").alias("width"))
    body = F.array_sort(F.collect_list(F.struct("row", "line")))
    got = lines.groupBy(key).agg(body.alias("b"), F.max("width").alias("width"))
    text = F.concat_ws("\n", F.element_at("b", 1)["line"], T.pipe_separator(F.col("width")), F.array_join(F.transform(F.slice("b", 2, F.size("b")), lambda x: x["line"]), "\n"))
    return got.select(key, F.regexp_replace(text, "\n\\z", "").alias("markdown"))


def grid_to_rows(cells: DataFrame, key: str = "document_id") -> DataFrame:
    """Long cells (key, row, column, value) as rows (key, row, cells), columns in order."""
    return cells.groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", F.coalesce("value", F.lit("")).alias("value")))), lambda x: x["value"]).alias("cells"))


def aligned_table(rows: DataFrame, key: str = "document_id", separator: bool = True) -> DataFrame:
    """(key, markdown): columns as wide as their longest cell, left-aligned; rows without content are dropped."""
    clean = rows.withColumn("cells", F.transform("cells", lambda x: F.coalesce(x, F.lit("")))).where(F.exists("cells", lambda x: F.trim(x) != ""))
    long = clean.select(key, "row", F.posexplode("cells").alias("column", "value"))
    wide = long.groupBy(key, "column").agg(F.max(F.length("value")).alias("width"))
    padded = long.join(wide, [key, "column"]).select(key, "row", "column", F.rpad("value", F.greatest("width", F.lit(1)), F.lit(" ")).alias("cell"), F.repeat(F.lit("-"), F.greatest("width", F.lit(1))).alias("dash"))
    order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", F.col(c).alias("x")))), lambda x: x["x"]), " | ")
    lines = padded.groupBy(key, "row").agg(F.concat(F.lit("| "), order("cell"), F.lit(" |")).alias("line"), F.concat(F.lit("| "), order("dash"), F.lit(" |")).alias("rule"))
    got = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "line", "rule"))).alias("b"))
    head = F.element_at("b", 1)
    rest = F.transform(F.slice("b", 2, F.size("b")), lambda x: x["line"])
    parts = F.concat(F.array(head["line"]), F.array(head["rule"]) if separator else F.array().cast("array<string>"), rest)
    return got.select(key, F.array_join(parts, "\n").alias("markdown"))


def sheets_markdown(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, markdown) from (key, sheet_index, name, markdown): a heading and a table for each sheet, in order."""
    one = F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.trim("markdown"))
    return tables.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_index", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def chart_markdown(points: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, markdown) from points (key, title, category_index, category, series_index, series, value): a table of categories by series.

    A point that is missing reads ``None``.
    """
    names = points.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("series_index", "series"))).alias("names"), F.max("title").alias("title"))
    per = points.groupBy(key, "category_index", "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series_index", "value")))).alias("by"))
    cells = F.concat(F.array(F.col("category")), F.transform("names", lambda s: F.coalesce(F.try_element_at("by", s["series_index"]).cast("string"), F.lit("None"))))
    head = F.concat(F.array(F.lit("Category")), F.transform("names", lambda s: s["series"]))
    joined = per.join(names, key)
    rows = joined.select(key, (F.col("category_index") + 1).alias("row"), cells.alias("cells")).unionByName(names.select(key, F.lit(0).alias("row"), head.alias("cells")))
    heading = F.concat(F.lit("### Chart"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), F.col("title"))).otherwise(""))
    return table_markdown(rows, key).join(names, key).select(key, F.concat(heading, F.lit("\n\n"), F.col("markdown")).alias("markdown"))


def semantic_text(cells: DataFrame, keys: tuple[str, ...] = ("document_id", "node_id")) -> DataFrame:
    """Text of a table node: cells of a row joined by tabs, rows by line breaks."""
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\t").alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("semantic_text"))


def identity_editable(cells: DataFrame, rows: Column, columns: Column, keys: tuple[str, ...] = ("document_id", "node_id")) -> DataFrame:
    """Whether a table can be edited in place: complete, unit spans, cells trimmed and free of breaks and pipes."""
    plain = (F.col("row_span") == 1) & (F.col("column_span") == 1) & (F.col("text") == F.trim("text")) & ~F.rlike("text", F.lit(r"[\r\n|]"))
    return cells.groupBy(*keys).agg((F.bool_and(plain) & (F.count_distinct("row", "column") == F.max(rows) * F.max(columns))).alias("editable"))


def merged_cells(ranges: DataFrame) -> DataFrame:
    """Cells of merged ranges (document_id, r0, c0, r1, c1), and whether two ranges share them."""
    cells = ranges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("column", F.explode(F.sequence("c0", "c1")))
    return cells.groupBy("document_id", "row", "column").agg((F.count("*") > 1).alias("overlap"))
