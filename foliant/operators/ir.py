"""The document model as tables: digests, validation, capabilities, serialization."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import settle

SCHEMA_NAME, SCHEMA_VERSION = "foliant.document", "0.1.0"
NODE_KINDS = ("text", "image", "table", "chart", "group", "shape", "note", "unknown_native")


# -- digests -----------------------------------------------------------------------------------------------------------


def json_digest(*fields: str) -> Column:
    """sha256 of a compact JSON object of the columns, keys sorted, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def node_semantic_text(nodes: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """nodes (document_id, node_id, kind, text, alt_text, title) with semantic_text; tables take theirs from cells."""
    own = F.when(F.col("kind").isin("text", "note", "shape"), F.col("text")).when(F.col("kind") == "image", F.col("alt_text")).when(F.col("kind") == "chart", F.col("title"))
    if cells is None:
        return nodes.withColumn("semantic_text", F.coalesce(own, F.lit("")))
    from .tables import semantic_text

    tables = semantic_text(cells).withColumnRenamed("semantic_text", "_table")
    return nodes.join(tables, ["document_id", "node_id"], "left").withColumn("semantic_text", F.coalesce(F.when(F.col("kind") == "table", F.col("_table")), own, F.lit(""))).drop("_table")


def with_semantic_digest(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("semantic_digest", json_digest("kind", "semantic_role", "semantic_text"))


def locator_digest(locator: str | Column) -> Column:
    """Digest of a locator struct (its fields in sorted order), or of null."""
    text = F.to_json(F.col(locator) if isinstance(locator, str) else locator)
    return F.sha2(F.coalesce(text, F.lit("null")), 256)


# -- validation --------------------------------------------------------------------------------------------------------


def _violation(rows: DataFrame, code: str, subject: str | Column) -> DataFrame:
    who = F.col(subject) if isinstance(subject, str) else subject
    return rows.select("document_id", F.lit(code).alias("code"), who.cast("string").alias("subject"))


def _duplicates(rows: DataFrame, code: str, key: str) -> DataFrame:
    return _violation(rows.groupBy("document_id", key).count().where("count > 1"), code, key)


def _missing(refs: DataFrame, ref: str, found: DataFrame, key: str, code: str, subject: str | None = None) -> DataFrame:
    """References (document_id, ref) whose target is not there: one left anti join."""
    there = found.select("document_id", F.col(key).alias(ref)).distinct()
    return _violation(refs.where(F.col(ref).isNotNull()).join(there, ["document_id", ref], "left_anti"), code, subject or ref)


def cycles(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id) of nodes on a cycle of parents or below one.

    Pointer doubling: after k rounds a node knows its ancestor 2**k steps up;
    those that still have one after more steps than their document has nodes, at
    most, are on or below a cycle.  Each round is one equi-join, settled before the next one.
    """
    up = nodes.select("document_id", "node_id", F.col("parent_id").alias("far")).where("far is not null")
    most = nodes.groupBy("document_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        other = up.select("document_id", F.col("node_id").alias("far"), F.col("far").alias("farther"))
        up = settle(up.join(other, ["document_id", "far"]).select("document_id", "node_id", F.col("farther").alias("far")), "ancestors")
        if up.isEmpty():
            break
    return up.select("document_id", "node_id")


def validate(t: dict[str, DataFrame]) -> DataFrame:
    """All violations (document_id, code, subject) of a star of tables.

    Tables: documents, canvases, nodes, children (document_id, node_id, child_id),
    roots (document_id, node_id), canvas_roots (document_id, canvas_id, node_id);
    optional: provenance, resources, payloads, relationships, edits, cells, images.
    Each code is a filter, an aggregate or an anti-join; nothing is collected.
    """
    docs, canvases, nodes, children = t["documents"], t["canvases"], t["nodes"], t["children"]
    out = [
        _violation(docs.where(F.col("schema_name") != SCHEMA_NAME), "schema.name", "schema_name"),
        _violation(docs.where(~F.rlike("schema_version", F.lit(r"^\d+\.\d+\.\d+$"))), "schema.version_invalid", "schema_version"),
        _violation(docs.where(F.col("sha256").isNotNull() & ~F.rlike("sha256", F.lit("^[0-9a-f]{64}$"))), "digest.invalid", "sha256"),
        _duplicates(canvases, "canvas.duplicate_id", "canvas_id"),
        _duplicates(canvases, "canvas.duplicate_index", "index"),
        _missing(nodes, "canvas_id", canvases, "canvas_id", "node.missing_canvas", "node_id"),
        _missing(t["roots"], "node_id", nodes, "node_id", "document.missing_root"),
        _missing(t["canvas_roots"], "node_id", nodes, "node_id", "canvas.missing_root"),
        _missing(children, "child_id", nodes, "node_id", "node.missing_child"),
        _missing(nodes.where("parent_id is not null"), "parent_id", nodes, "node_id", "node.missing_parent", "node_id"),
    ]
    order = Window.partitionBy("document_id").orderBy("position")
    out.append(_violation(canvases.withColumn("_before", F.lag("index").over(order)).where(F.col("_before") > F.col("index")), "canvas.order", "canvas_id"))
    if "key" in nodes.columns:
        out.append(_violation(nodes.where(F.col("key") != F.col("node_id")), "node.key_mismatch", "key"))
    out.append(_violation(children.groupBy("document_id", "child_id").agg(F.count_distinct("node_id").alias("n")).where("n > 1"), "node.multiple_parents", "child_id"))
    on_canvas = t["canvas_roots"].join(nodes.select("document_id", "node_id", F.col("canvas_id").alias("_own")), ["document_id", "node_id"])
    out.append(_violation(on_canvas.where(~F.col("_own").eqNullSafe(F.col("canvas_id"))), "canvas.root_canvas_mismatch", "node_id"))
    said = children.join(nodes.select("document_id", F.col("node_id").alias("child_id"), "parent_id"), ["document_id", "child_id"])
    down = _violation(said.where(~F.col("parent_id").eqNullSafe(F.col("node_id"))), "node.parent_child_mismatch", "child_id")
    up = nodes.where("parent_id is not null").select("document_id", F.col("parent_id"), F.col("node_id").alias("child_id")).join(nodes.select("document_id", F.col("node_id").alias("parent_id")), ["document_id", "parent_id"], "left_semi")
    lone = up.join(children.select("document_id", F.col("node_id").alias("parent_id"), "child_id"), ["document_id", "parent_id", "child_id"], "left_anti")
    out += [down.unionByName(_violation(lone, "node.parent_child_mismatch", "child_id")).distinct(), _violation(cycles(nodes), "node.cycle", "node_id")]
    if "provenance" in t:
        out.append(_missing(t["provenance"], "canvas_index", canvases, "index", "provenance.missing_canvas", "node_id"))
    for name, key, code in (("resources", "resource_id", "resource"), ("payloads", "payload_id", "native_payload")):
        if name in t:
            out.append(_violation(t[name].where(F.col("key") != F.col(key)), f"{code}.key_mismatch", "key"))
            refs = t.get("images" if name == "resources" else "payload_refs")
            if refs is not None:
                out.append(_missing(refs, key, t[name], key, f"{code}.missing", "node_id"))
    if "cells" in t:
        out.append(_missing(t["cells"], "cell_node_id", nodes, "node_id", "table.missing_node"))
    if "relationships" in t:
        rel = t["relationships"]
        out.append(_duplicates(rel, "relationship.duplicate_id", "relationship_id"))
        known = nodes.select("document_id", F.col("node_id").alias("id"))
        for name, key in (("resources", "resource_id"), ("canvases", "canvas_id"), ("payloads", "payload_id")):
            if name in t:
                known = known.unionByName(t[name].select("document_id", F.col(key).alias("id")))
        known = known.unionByName(docs.select("document_id", F.col("document_id").alias("id")))
        out.append(_missing(rel, "source_id", known, "id", "relationship.missing_source", "relationship_id"))
        out.append(_missing(rel.where("external_target is null"), "target_id", known, "id", "relationship.missing_target", "relationship_id"))
    if "edits" in t:
        out.append(_duplicates(t["edits"], "edit.duplicate_id", "operation_id"))
        out.append(_missing(t["edits"], "target_node_id", nodes, "node_id", "edit.missing_target", "operation_id"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


# -- capabilities and fidelity -----------------------------------------------------------------------------------------


def node_states(nodes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(document_id, node_id, state): writable if any decision is, else derived if any is, else read-only."""
    per = capabilities.groupBy("document_id", "node_id").agg(F.bool_or(F.col("state") == "writable").alias("w"), F.bool_or(F.col("state") == "derived").alias("d"))
    joined = nodes.select("document_id", "node_id").join(per, ["document_id", "node_id"], "left")
    return joined.select("document_id", "node_id", F.when(F.col("w"), "writable").when(F.col("d"), "derived").otherwise("read-only").alias("state"), F.col("w").isNull().alias("unspecified"))


def capability_report(nodes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(document_id, nodes, writable, derived, read_only, unspecified)."""
    n = lambda s: F.count_if(F.col("state") == s)
    return node_states(nodes, capabilities).groupBy("document_id").agg(F.count("*").alias("nodes"), n("writable").alias("writable"), n("derived").alias("derived"), n("read-only").alias("read_only"), F.count_if("unspecified").alias("unspecified"))


def capability_reasons(nodes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(document_id, reason_code, n, rank): reasons by name, nodes without a decision under their own."""
    given = capabilities.where("reason_code is not null").select("document_id", "reason_code")
    silent = nodes.join(capabilities, ["document_id", "node_id"], "left_anti").select("document_id", F.lit("capability.unspecified").alias("reason_code"))
    counted = given.unionByName(silent).groupBy("document_id", "reason_code").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("reason_code")))


def capability_totals(capabilities: DataFrame) -> DataFrame:
    """Counts by (operation, state), by operation and over all, in one scan (grouping sets)."""
    return capabilities.groupingSets([["operation", "state"], ["operation"], []], "operation", "state").agg(F.count("*").alias("n"))


def capability_of(nodes: DataFrame, capabilities: DataFrame, operation: str) -> DataFrame:
    """The decision of each node on an operation; what is not advertised is read-only."""
    one = capabilities.where(F.col("operation") == operation).select("document_id", "node_id", "state", "reason_code")
    joined = nodes.select("document_id", "node_id").join(one, ["document_id", "node_id"], "left")
    return joined.select("document_id", "node_id", F.lit(operation).alias("operation"), F.coalesce("state", F.lit("read-only")).alias("state"), F.coalesce("reason_code", F.when(F.col("state").isNull(), "capability.unspecified")).alias("reason_code"))


def duplicate_decisions(capabilities: DataFrame) -> DataFrame:
    return capabilities.groupBy("document_id", "node_id", "operation").count().where("count > 1").drop("count")


def fidelity(evidence: DataFrame) -> DataFrame:
    """(document_id, claimed_tier, refused): exact-preserve is refused if required evidence failed."""
    failed = F.bool_or((F.col("status") == "failed") & F.col("required"))
    return evidence.groupBy("document_id", "claimed_tier").agg((failed & (F.col("claimed_tier") == "exact-preserve")).alias("refused"))


def rule_capability(kind: Column, table: dict[str, tuple[str | None, str | None]]) -> Column:
    """struct(operation, state, reason_code) by kind from a table {kind: (operation, reason)}; no operation: read-only with the reason."""
    out = None
    for name, (operation, reason) in table.items():
        value = F.struct(F.lit(operation).cast("string").alias("operation"), F.lit("writable" if reason is None else "read-only").alias("state"), F.lit(reason).cast("string").alias("reason_code"))
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


#: Decisions by owner kind (fixed values).
XML_RULES = {"text": ("replace_xml_text", None), "attribute": ("replace_xml_attribute", None), "element": (None, "xml.element.structural_edit_unsupported"), "namespace": (None, "xml.namespace.structural_edit_unsupported"), "cdata": (None, "xml.cdata.lexical_edit_unsupported")}
HTML_RULES = {"text": ("replace_html_text", None), "attribute": ("replace_html_attribute", None), "element": (None, "html.element.structural_edit_unsupported"), "rawtext": (None, "html.raw_text.read_only"), "rcdata": (None, "html.rcdata.read_only")}
JSON_RULES = {"object": (None, "json.container.structural_edit_unsupported"), "array": (None, "json.container.structural_edit_unsupported"), **{k: ("replace_json_scalar", None) for k in ("string", "number", "boolean", "null")}}


# -- serialization -----------------------------------------------------------------------------------------------------


def _clean(x: object) -> object:
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items() if v is not None}
    if isinstance(x, (list, tuple)):
        return [_clean(v) for v in x]
    if isinstance(x, bytes) or (isinstance(x, float) and not math.isfinite(x)):
        raise ValueError("bytes and numbers that are not finite have no canonical form")
    return x


def canonical_json(value: object) -> str:
    """Sorted keys, compact, nulls of objects left out, non-ASCII kept, 10 and 10.0 kept apart."""
    return json.dumps(_clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(df: DataFrame, column: str = "json") -> DataFrame:
    """df with ``canonical`` and ``error``: the canonical form of a JSON column, row errors as values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made, errors = [], []
            for raw in frame[column]:
                try:
                    made.append(None if raw is None else canonical_json(json.loads(raw)))
                    errors.append(None)
                except (ValueError, RecursionError) as e:
                    made.append(None)
                    errors.append(str(e)[:200])
            yield frame.assign(canonical=made, error=errors)

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("canonical", T.StringType()), T.StructField("error", T.StringType())])
    return df.mapInPandas(run, schema)


def unknown_fields(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose JSON object has a key out of ``allowed`` (strict mode refuses them, forward mode ignores the keys)."""
    keys = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed)))
    return df.withColumn("unknown", keys).where(F.size("unknown") > 0)
