"""Typed edits: checks in order, overlay, splicing and proofs.

All share one shape: edits are joined to what they target, an ordered CASE
names the first rule that is broken, and one broken edit refuses its whole
document, as a window over the document says before anything is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str]) -> Column:
    out = None
    for broken, code in rules:
        out = F.when(broken, code) if out is None else out.when(broken, code)
    return out


def all_or_none(checked: DataFrame) -> DataFrame:
    """checked with ``accepted``: no edit of the document has a reason."""
    return checked.withColumn("accepted", F.count("reason").over(Window.partitionBy("document_id")) == 0)


def preconditions(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """edits with the first precondition that fails: target, semantic digest, locator digest, old value."""
    seen = nodes.select("document_id", F.col("node_id").alias("target_node_id"), F.col("semantic_digest").alias("_semantic"), F.col("native_locator_digest").alias("_locator"), F.col("value").alias("_value"))
    joined = edits.join(seen, ["document_id", "target_node_id"], "left")
    differs = lambda want, have: F.col(want).isNotNull() & ~F.col(want).eqNullSafe(F.col(have))
    reason = first_reason((F.col("_semantic").isNull(), "target_missing"), (differs("expected_semantic_digest", "_semantic"), "semantic_digest_mismatch"), (differs("expected_native_locator_digest", "_locator"), "native_locator_digest_mismatch"), (differs("expected_old_value", "_value"), "old_value_mismatch"))
    return joined.withColumn("reason", reason).drop("_semantic", "_locator", "_value")


def check_cells(updates: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Table-cell updates (document_id, row, column, old_text, text) with ``reason``.

    tables: document_id, rows, columns; cells: document_id, row, column, text,
    row_span, column_span.  A table with spans or holes takes no updates.
    """
    whole = cells.groupBy("document_id").agg((F.bool_and((F.col("row_span") == 1) & (F.col("column_span") == 1))).alias("_unit"), F.count_distinct("row", "column").alias("_cells"))
    shape = tables.join(whole, "document_id", "left").select("document_id", "rows", "columns", (F.coalesce("_unit", F.lit(False)) & (F.col("_cells") == F.col("rows") * F.col("columns"))).alias("_sound"))
    have = cells.select("document_id", "row", "column", F.col("text").alias("_have"))
    twice = F.count("*").over(Window.partitionBy("document_id", "row", "column")) > 1
    joined = updates.withColumn("_twice", twice).join(shape, "document_id", "left").join(have, ["document_id", "row", "column"], "left")
    outside = ~(F.col("row").between(0, F.col("rows") - 1) & F.col("column").between(0, F.col("columns") - 1))
    reason = first_reason(
        (~F.coalesce("_sound", F.lit(False)), "unsupported_table_structure"),
        (F.col("row").isNull() | F.col("column").isNull() | F.col("text").isNull() | F.col("old_text").isNull(), "invalid_edit_payload"),
        (F.col("_twice"), "duplicate_cell_coordinate"),
        (outside, "cell_out_of_range"),
        (F.col("_have") != F.col("old_text"), "cell_old_value_mismatch"),
        (F.col("text") == F.col("old_text"), "no_op_cell_update"),
    )
    return all_or_none(joined.withColumn("reason", reason)).drop("_twice", "_sound", "_have", "rows", "columns")


def apply_cells(cells: DataFrame, accepted: DataFrame, value: str = "text") -> DataFrame:
    """cells with the accepted updates laid over them."""
    new = accepted.where("accepted").select("document_id", "row", "column", F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return cells.join(new, ["document_id", "row", "column"], "left").withColumn(value, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_hit")


def check_sheet_cells(updates: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Sheet updates (document_id, row, column, old_type, old_value, new_type, new_value) with ``reason``.

    Values are JSON scalars with their type: 1, 1.0 and true are different.
    """
    have = cells.select("document_id", "row", "column", F.col("type").alias("_type"), F.col("value").alias("_value"))
    twice = F.count("*").over(Window.partitionBy("document_id", "row", "column")) > 1
    joined = updates.withColumn("_twice", twice).join(grids, "document_id", "left").join(have, ["document_id", "row", "column"], "left")
    scalar = F.col("new_type").isin("string", "int", "float", "bool", "null")
    reason = first_reason(
        (F.col("rows").isNull(), "unsupported_sheet_structure"),
        (F.col("new_type").isNull() | F.col("old_type").isNull(), "missing_typed_cell_value"),
        (F.col("_twice"), "duplicate_cell_coordinate"),
        (~(F.col("row").between(0, F.col("rows") - 1) & F.col("column").between(0, F.col("columns") - 1)), "cell_out_of_range"),
        (F.col("_type").isin("formula", "error", "date"), "unsupported_source_cell_value"),
        (~scalar, "invalid_cell_value"),
        (~(F.col("_type").eqNullSafe(F.col("old_type")) & F.col("_value").eqNullSafe(F.col("old_value"))), "cell_old_value_mismatch"),
        (F.col("new_type").eqNullSafe(F.col("old_type")) & F.col("new_value").eqNullSafe(F.col("old_value")), "no_op_cell_update"),
    )
    return all_or_none(joined.withColumn("reason", reason)).drop("_twice", "_type", "_value", "rows", "columns")


def check_geometry(edits: DataFrame) -> DataFrame:
    """move_resize (x, y, width, height against old_x ...) with ``reason``: finite, positive size, some change."""
    sides = ("x", "y", "width", "height")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = F.lit(False)
    same = F.lit(True)
    for s in sides:
        bad = bad | ~finite(s)
        same = same & (F.col(s) == F.col(f"old_{s}"))
    reason = first_reason((F.col("old_width").isNull(), "missing_geometry"), (bad, "invalid_geometry"), ((F.col("width") <= 0) | (F.col("height") <= 0), "invalid_size"), (same, "no_op_geometry_update"))
    return all_or_none(edits.withColumn("reason", reason))


def style_fields(style: str) -> Column:
    """A style map in its normal form; null where a value is none of its field's."""
    s = F.col(style)
    at = lambda k: F.try_element_at(s, F.lit(k))
    under = F.when(at("underline") == "true", "single").when(at("underline") == "false", "none").otherwise(at("underline"))
    ok = F.lit(True)
    for k in ("bold", "italic"):
        ok = ok & (at(k).isNull() | at(k).isin("true", "false"))
    size = at("size").try_cast("double")
    ok = ok & (under.isNull() | under.isin("none", "single", "double")) & (at("size").isNull() | (size.isNotNull() & (size > 0) & (size < float("inf"))))
    ok = ok & (at("family").isNull() | (F.trim(at("family")) != "")) & (at("color").isNull() | F.rlike(at("color"), F.lit("^#[0-9A-Fa-f]{6}$")))
    made = F.struct(at("bold").alias("bold"), at("italic").alias("italic"), under.alias("underline"), size.alias("size"), F.trim(at("family")).alias("family"), F.upper(at("color")).alias("color"))
    return F.when(ok, made)


def check_styles(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """Run styles (document_id, node_id, run_index, old_style, style) with ``reason``; runs have kind and style."""
    have = runs.select("document_id", "node_id", "run_index", F.col("kind").alias("_kind"), F.to_json("style").alias("_style"))
    kinds = runs.select("document_id", "node_id", F.col("kind").alias("_node")).distinct()
    joined = updates.join(kinds, ["document_id", "node_id"], "left").join(have, ["document_id", "node_id", "run_index"], "left")
    old, new = F.to_json("old_style"), F.to_json("style")
    reason = first_reason((F.coalesce("_node", F.lit("")) != "text", "wrong_node_kind"), (F.col("_style").isNull(), "run_out_of_range"), (F.col("_style") != old, "run_style_mismatch"), (old == new, "no_op_style_update"))
    return all_or_none(joined.withColumn("reason", reason)).drop("_kind", "_style", "_node")


def check_csv(updates: DataFrame, fields: DataFrame) -> DataFrame:
    """CSV cell changes (document_id, position, row, column, old_text, text) with ``reason``; coordinates strictly ascend."""
    have = fields.select("document_id", "row", "column", F.col("value").alias("_have"))
    before = F.lag(F.struct("row", "column")).over(Window.partitionBy("document_id").orderBy("position"))
    joined = updates.withColumn("_before", before).join(have, ["document_id", "row", "column"], "left")
    reason = first_reason(
        (F.col("row").isNull() | F.col("column").isNull() | (F.col("row") < 0) | (F.col("column") < 0), "invalid_edit_payload"),
        (F.rlike("text", F.lit("[\r\n]")), "newline_in_replacement"),
        (F.col("text") == F.col("old_text"), "no_op_cell_update"),
        (F.col("_before") >= F.struct("row", "column"), "coordinates_not_ascending"),
        (F.col("_have").isNull(), "cell_missing"),
        (F.col("_have") != F.col("old_text"), "cell_old_value_mismatch"),
    )
    return all_or_none(joined.withColumn("reason", reason)).drop("_before", "_have")


def csv_token(text: str, quoted: str, delimiter: str = ",") -> Column:
    """The lexical form of a CSV field: quoted if it was, or if it must be."""
    t = F.col(text)
    need = F.col(quoted) | F.contains(t, F.lit(delimiter)) | F.contains(t, F.lit('"'))
    return F.when(need, F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def check_json(updates: DataFrame, values: DataFrame) -> DataFrame:
    """JSON scalar changes (document_id, pointer, new_raw) with ``reason``; values have kind and raw."""
    have = values.select("document_id", "pointer", F.col("kind").alias("_kind"), F.col("raw").alias("_raw"))
    joined = updates.join(have, ["document_id", "pointer"], "left")
    scalar = F.rlike("new_raw", F.lit(r'^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")$'))
    reason = first_reason((F.col("_kind").isNull(), "target_missing"), (F.col("_kind").isin("object", "array"), "json.container.structural_edit_unsupported"), (~scalar, "invalid_json_scalar"), (F.col("new_raw") == F.col("_raw"), "no_op_json_update"))
    return all_or_none(joined.withColumn("reason", reason)).drop("_kind", "_raw")


def check_text_value(updates: DataFrame, owners: DataFrame, operations: dict[str, str]) -> DataFrame:
    """XML or HTML value changes (document_id, path, operation, new_value) with ``reason``; owners have kind and value."""
    from ..functions.text import xml_chars_valid

    have = owners.select("document_id", "path", F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    joined = updates.join(have, ["document_id", "path"], "left")
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in operations.items() for x in kv]), F.col("_kind"))
    reason = first_reason((F.col("_kind").isNull(), "target_missing"), (~F.col("operation").eqNullSafe(wanted), "operation_kind_mismatch"), (~xml_chars_valid("new_value"), "invalid_character"), (F.col("new_value") == F.col("_value"), "no_op_value_update"))
    return all_or_none(joined.withColumn("reason", reason)).drop("_kind", "_value")


def splice(sources: DataFrame, tokens: DataFrame) -> DataFrame:
    """(document_id, candidate): texts with tokens (document_id, start, end, token) put in place of their spans.

    Tokens of a document are gathered once, in order; the gaps between them
    are copied.  Documents without tokens return their source as it is; spans
    that overlap return null.
    """
    per = tokens.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_t"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, t: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"].cast("int") + 1, (t["start"] - a["at"]).cast("int"))
        return F.struct(F.concat(a["out"], gap, t["token"]).alias("out"), t["end"].cast("long").alias("at"), (a["ok"] & (t["start"] >= a["at"]) & (t["end"] >= t["start"])).alias("ok"))

    made = F.aggregate("_t", begin, step, lambda a: F.when(a["ok"], F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text")))))
    return sources.join(per, "document_id", "left").select("document_id", F.when(F.col("_t").isNull(), F.col("text")).otherwise(made).alias("candidate"))


def untouched_gaps(sources: DataFrame, candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """(document_id, gap, equal): proof that what lies between the spliced spans is the same in source and candidate.

    A source without tokens is one gap.
    """
    w = Window.partitionBy("document_id").orderBy("start")
    grown = tokens.withColumn("_grow", F.length("token") - (F.col("end") - F.col("start")))
    shifted = grown.withColumns({"gap": F.row_number().over(w) - 1, "_from": F.coalesce(F.lag("end").over(w), F.lit(0)), "_shift": F.coalesce(F.sum("_grow").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    last = grown.groupBy("document_id").agg(F.count("*").alias("_n"), F.max("end").alias("_end"), F.sum("_grow").alias("_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    last = sources.select("document_id").join(last, "document_id", "left").select("document_id", none("_n").alias("gap"), none("_end").alias("_from"), F.lit(None).cast("int").alias("start"), none("_sum").alias("_shift"))
    gaps = shifted.select("document_id", F.col("gap").cast("int").alias("gap"), F.col("_from").cast("int"), F.col("start").cast("int"), F.col("_shift").cast("int")).unionByName(last.select("document_id", "gap", F.col("_from").cast("int"), "start", F.col("_shift").cast("int")))
    joined = gaps.join(sources.select("document_id", F.col("text").alias("_s")), "document_id").join(candidates.select("document_id", F.col("candidate").alias("_c")), "document_id")
    size = F.coalesce(F.col("start") - F.col("_from"), F.length("_s") - F.col("_from"))
    same = F.substring(F.col("_s"), F.col("_from") + 1, size) == F.substring(F.col("_c"), F.col("_from") + F.col("_shift") + 1, size)
    return joined.select("document_id", "gap", same.alias("equal"))


def before_after(before: DataFrame, after: DataFrame, requested: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """Differences between two reads: (document_id, keys, verdict); requested changes are ``applied`` or ``not_applied``, others ``unrequested``, and keys on one side only ``topology``."""
    on = ["document_id", *keys]
    a = before.select(*on, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*on, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    r = requested.select(*on, F.col("new_value").alias("_r"), F.lit(True).alias("_asked"))
    joined = a.join(b, on, "full_outer").join(r, on, "left")
    verdict = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), "topology").when(F.col("_asked") & F.col("_b").eqNullSafe(F.col("_r")), "applied").when(F.col("_asked"), "not_applied").when(~F.col("_a").eqNullSafe(F.col("_b")), "unrequested")
    return joined.select(*on, verdict.alias("verdict")).where("verdict is not null")


def source_authority(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims (document_id, format, sha256, size_bytes) with ``reason`` against the bytes at hand."""
    have = sources.select("document_id", F.col("format").alias("_f"), F.sha2("content", 256).alias("_s"), F.length("content").cast("long").alias("_n"))
    joined = claims.join(have, "document_id", "left")
    reason = first_reason((F.col("_s").isNull(), "source_missing"), (F.col("format") != F.col("_f"), "source_format_mismatch"), (F.col("size_bytes") != F.col("_n"), "source_size_mismatch"), (F.col("sha256") != F.col("_s"), "source_digest_mismatch"))
    return joined.withColumn("reason", reason).drop("_f", "_s", "_n")


def package_diff(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Members (document_id, name, sha256) that differ and were not to: (document_id, name, change)."""
    a = before.select("document_id", "name", F.col("sha256").alias("_a"))
    b = after.select("document_id", "name", F.col("sha256").alias("_b"))
    joined = a.join(b, ["document_id", "name"], "full_outer").join(allowed.select("document_id", "name"), ["document_id", "name"], "left_anti")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return joined.select("document_id", "name", change.alias("change")).where("change is not null")
