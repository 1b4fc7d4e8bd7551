"""Mixing sources to target weights by capped water-filling.

The mix is a given share of all words, dealt to the sources by weight.  A
source stops at a number of epochs (its cap); what is over is dealt again by
weight among the sources that are below theirs, until none is above.  The end
of these rounds is found in one pass: in order of cap / weight, the sources
before the first one that the rest of the mix does not fill are at their caps.

Each source then takes every document ``floor(target / size)`` whole times.
For the fraction left, documents follow a seeded order (the md5 of seed and
doc_id) until its quota of words is reached; the document at the edge gives
its first words only, so a source's words meet its target to a word.  The
order is found without sorting a source: words are summed over 4096 bands of
the md5, and only the band at the edge is put in order.

Everything is DataFrame work on (doc_id, source, size); no text is shuffled.

Rules for unusual rows: a size is the number of ``[^\x20\x09-\x0D]+`` in the
text, 0 for null or empty ones, which are taken as 0 words.  Null is a source
of its own, after all others; a source without words has target 0.  Rows that
share a doc_id are rows of their own.  Null doc_ids come first in their band.
No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import fresh, load, settle

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 42


def word_count(text: str | Column) -> Column:
    """Number of runs of characters that are no ASCII white space."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # a run is counted where it starts: after nothing, or after a space
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size and target of every source, from rows of (source, size).

    One row a source from here on; the windows below run over sources, not rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.select("source", "source_size", turn.alias("w"), (F.lit(epochs) * F.col("source_size")).alias("cap"))
    full = Window.orderBy(F.col("cap") / F.col("w"), "cap", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("ws", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    total = F.lit(share) * F.sum("source_size").over(whole)
    level = (total - F.col("caps")) / (F.sum("w").over(whole) - F.col("ws"))
    per = per.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("caps"), F.col("level")))).over(whole)
    per = per.withColumn("last", first["level"])
    target = F.when(F.col("last").isNull() | (F.col("cap") <= F.col("w") * F.col("last")), F.col("cap")).otherwise(F.col("w") * F.col("last"))
    return per.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    size = word_count("text")
    mark = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.alias("size"), mark.alias("mark")), "sizes")
    rows = rows.withColumn("band", F.substring("mark", 1, 3))
    goal = targets(rows).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    bands = rows.groupBy("source", "band").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    goal = goal.withColumnRenamed("source", "s")
    # one row a source and band: 4096 bands a source at most
    edge = settle(bands.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "bands")
    edge = edge.select(F.col("source").alias("s"), F.col("band").alias("b"), "words", "ahead", "source_size", "target", "whole", "quota")
    joined = rows.join(edge, rows.source.eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    inside = F.col("ahead") + F.col("words") <= F.col("quota")
    at_edge = ~inside & (F.col("ahead") < F.col("quota"))
    clear = joined.where(~at_edge).withColumn("extra", F.when(inside, F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    mixed = joined.where(at_edge).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    mixed = mixed.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - F.col("before")))).drop("before")
    both = clear.unionByName(mixed)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: whole ones repeated, the one at a source's edge with its first words.

    Rows with the same doc_id, source and size are alike to the plan; the
    plan's copies are dealt to them in turn.
    """
    own, src, size, nth, taken, turn, words, copy = fresh(docs, "_own", "_src", "_size", "_nth", "_taken", "_turn", "_words", "_copy")
    alike = lambda *c: Window.partitionBy(*c)
    want = plan(docs).withColumn("k", F.row_number().over(alike("doc_id", "source", "size").orderBy(F.col("taken").desc())))
    want = want.select(F.col("doc_id").alias(own), F.col("source").alias(src), F.col("size").alias(size), F.col("taken").alias(taken), F.col("k").alias(turn))
    rows = docs.withColumn(words, word_count("text"))
    rows = rows.withColumn(nth, F.row_number().over(alike("doc_id", "source", words).orderBy("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(words) == F.col(size)) & (F.col(nth) == F.col(turn))
    copies = F.when(F.col(size) > 0, F.ceil(F.col(taken) / F.col(size))).otherwise(0).cast("int")
    out = rows.join(want, same).where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    part = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size))
    split = F.split(F.regexp_replace("text", "^[\\x20\\x09-\\x0D]++", ""), "[\\x20\\x09-\\x0D]++")
    cut = F.array_join(F.slice(split, F.lit(1), part.cast("int")), " ")
    text = F.when(part < F.col(size), cut).otherwise(F.col("text"))
    chars = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[(text if c == "text" else chars.get(c, F.col(c))).alias(c) for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(load(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM p),
c AS (SELECT *, coalesce(sum(cap) OVER f, 0)::DOUBLE AS caps, coalesce(sum(w) OVER f, 0)::DOUBLE AS ws,
             1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS wall
      FROM w WINDOW f AS (ORDER BY cap / w, cap, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps) / (wall - ws) AS level FROM c),
o AS (SELECT *, (SELECT arg_min(level, caps) FROM l WHERE cap / w > level) AS last FROM l),
t AS (SELECT source, source_size, CASE WHEN last IS NULL OR cap <= w * last THEN cap ELSE w * last END AS target FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
z AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS quota FROM q),
b AS (SELECT d.*, z.source_size, z.target, z.whole, z.quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, quota - before)) AS BIGINT) AS taken FROM b
"""
