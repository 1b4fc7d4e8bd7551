"""Personal data: base patterns, and information-theoretic sanitisation of what gives them away.

Base: e-mail, IP, card and phone, each leftmost and non-overlapping over the
whole text.  A pattern's places follow from what ``split`` leaves between its
matches, so no Python runs.

Method: every base value is a protected entity e.  For each term t (a word of
letters) anywhere in a document with e, the corpus says how strongly t reveals
e: ``PMI(e; t) = log(N n(e,t) / (n(e) (n(t) + SMOOTH)))`` over documents, as a
share of the whole information of e, ``IC(e) = log(N / n(e))``.  A share of
``GENERALISE`` or more has the term generalised wherever it occurs, one of
``REMOVE`` or more removed.  SMOOTH stands for documents not seen that hold t
without e: entities of one document count, on weaker evidence.

Entities that stand in the same documents are revealed by the same terms; one
of them is paired for all.  ``n(e,t) <= n(e)`` bounds n(t) from above, so a term
is paired only with entities that its count allows.

Counts of terms cover all documents.  The terms and rows in question reach
the scan of all texts as a Bloom filter of ``BITS``, which is broadcast; an
exact join follows on what it lets through.

Rules for unusual rows: a null text counts as empty; such rows return zeros,
no spans and the hash of nothing.  Rows with the same doc_id and text count as
one document and return the same result.  A null doc_id stays null.  Columns
besides doc_id and text are ignored.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import load, settle

#: Possessive forms of the contract's patterns: they match the same, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SMOOTH, GENERALISE, REMOVE, BITS, FEW = 1, 0.8, 0.95, 1 << 25, 64
WORD = r"\p{L}{3,}+"
_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """From (gap, match) lengths, the start of each match; sums are kept for every 256 to stay near linear."""
    whole = lambda x: x["gap"] + x["match"]
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + whole(x))
    blocks = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(1), blocks), lambda b: total(F.slice(lengths, (b - 1) * _BLOCK + 1, F.lit(_BLOCK))))
    return F.transform(
        lengths,
        lambda x, i: F.aggregate(F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int")), F.lit(0), lambda a, s: a + s)
        + total(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
        + x["gap"],
    )


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the end is doubled, nines cast out."""
    back = F.reverse(digits)
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _kind_spans(number: int, kind: str) -> Column:
    """The valid spans of a kind from its (gap, match, value) rows."""
    rows = F.col(f"{kind}_l")
    made = F.zip_with(rows, _starts(rows), lambda x, s: F.struct(s.alias("start"), F.lit(number).alias("number"), (s + x["match"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.when(F.size(rows) > 0, F.filter(made, lambda s: _valid(kind, s["value"]))).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,number:int,end:int,kind:string,value:string>>")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of doc_id and text), text, and spans (start, kind number, end, kind, value) in order, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    sign = {"email": "@", "ip": ".", "phone": "+"}
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        there = F.contains("text", F.lit(sign[kind])) if kind in sign else F.lit(True)
        rows = rows.withColumn(f"{kind}_m", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        gaps = F.when(F.size(f"{kind}_m") > 0, F.split("text", pattern, -1)).otherwise(none)
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(f"{kind}_m")), f"{kind}_m", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"), m.alias("value")))
        rows = rows.withColumn(f"{kind}_l", both)
    found = []
    for number, kind in enumerate(KINDS):
        found.append(_kind_spans(number, kind))
    return rows.select("doc_id", "row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _low(text: Column) -> Column:
    """Lower case of the same length: only the dotted capital I would become two characters."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_low(text), F.lit(WORD), F.lit(0)))


def _thin(rows: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose key may be in wanted[column]: by a Bloom filter of BITS, one row of longs."""
    spots = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(BITS)) for k in (1, 2)]
    word = lambda s: F.floor(s / 64).cast("int")
    spot = wanted.select(F.explode(F.array(*spots(F.col(column)))).alias("s"))
    held = spot.groupBy(word(F.col("s")).cast("long").alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("b"))
    every = rows.sparkSession.range(BITS // 64).join(held, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("w"))
    bits = every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["b"]).alias("_bits"))
    there = [F.getbit(F.get("_bits", word(s)), (s % 64).cast("int")) == 1 for s in spots(key)]
    return rows.join(F.broadcast(bits), there[0] & there[1], "left_semi")  # bits is one row


def _information() -> Column:
    return F.log(F.col("all") / F.col("with_entity"))


def _share() -> Column:
    """Smoothed PMI of an entity and a term as a share of the entity's information, from both, with_entity, with_term and all."""
    pmi = F.log(F.col("both") * F.col("all") / (F.col("with_entity") * (F.col("with_term") + SMOOTH)))
    return F.when(_information() > 0, F.try_divide(pmi, _information()))


def revealing_terms(mentions: DataFrame, holders: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms: term, share), and (places: row, term) where the terms that were counted occur.

    mentions has row and entity; holders has row and words, the distinct words
    of each document with a mention; texts has row and text of all.
    """
    one = mentions.distinct()
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"where_{k}") for k in (1, 2)]
    entities = one.groupBy("entity").agg(F.count("*").alias("with_entity"), *where)
    entities = entities.groupBy("with_entity", "where_1", "where_2").agg(F.min("entity").alias("entity")).select("entity", "with_entity")
    total = settle(texts.agg(F.count_distinct("row").alias("all")), "total")  # one row
    words = holders.dropDuplicates(["row"]).select("row", F.explode("words").alias("term"))
    # a term is in as many documents at least as have a mention besides: pairs that fall short even so need no count
    about = words.groupBy("term").agg(F.count("*").alias("with_term"))
    most = entities.agg(F.max("with_entity").alias("with_entity")).join(F.broadcast(total))
    allowed = lambda: F.log(F.col("all") / (F.col("with_term") + SMOOTH)) >= GENERALISE * _information() - 1e-9
    about = about.join(F.broadcast(most), allowed()).select("term", "with_term")
    sides = one.join(entities, "entity").join(F.broadcast(total))
    met = words.join(about, "term").join(sides, "row").where(allowed())
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term"), F.first("all").alias("all"))
    pairs = settle(pairs.where(_share() >= GENERALISE).select("entity", "term", "both", "with_entity"), "pairs")
    wanted = settle(pairs.select("term").distinct(), "terms")
    all_words = texts.select("row", F.explode(_words(F.col("text"))).alias("term"))
    places = settle(_thin(all_words, F.col("term"), wanted, "term").join(wanted, "term", "left_semi").distinct(), "places")
    counts = places.groupBy("term").agg(F.count("*").alias("with_term"))
    scored = pairs.join(counts, "term").join(F.broadcast(total))
    return scored.groupBy("term").agg(F.max(_share()).alias("share")).where(F.col("share") >= GENERALISE), places


def _term_span(start: Column, kind: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(len(KINDS)).alias("number"), (start + F.length(value)).alias("end"), kind.alias("kind"), value.alias("value"))


def term_spans(texts: DataFrame, terms: DataFrame, places: DataFrame) -> DataFrame:
    """row, and spans of the terms in its text."""
    kind = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind")
    hits = places.join(terms, "term").select("row", "term", kind)
    hits = settle(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")), "hits")
    some = _thin(texts.dropDuplicates(["row"]), F.col("row"), hits, "row").join(hits, "row")
    some = some.withColumn("low", _low(F.col("text")))
    # few terms: one pattern of them
    few = some.where(F.size("kinds") <= FEW)
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("kinds"), "|"), F.lit(r")(?!\p{L})"))
    few = few.withColumn("m", F.regexp_extract_all("low", pattern, F.lit(0)))
    few = few.withColumn("g", F.call_function("split", F.col("low"), pattern, F.lit(-1)))
    few = few.withColumn("l", F.zip_with(F.slice("g", F.lit(1), F.size("m")), "m", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"), m.alias("term"))))
    few = few.where(F.size("l") > 0)
    value = lambda s, x: F.substring(F.col("text"), s + 1, x["match"])
    few = few.select("row", F.zip_with("l", _starts(F.col("l")), lambda x, s: _term_span(s, F.element_at("kinds", x["term"]), value(s, x))).alias("more"))
    # many: all pieces of the text
    many = some.where(F.size("kinds") > FEW)
    pieces = many.select("row", "text", "kinds", F.posexplode(F.split("low", r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})", -1)).alias("n", "piece"))
    before = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("row", "piece", F.try_element_at("kinds", F.col("piece")).alias("kind"), F.col("n"))
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int")).where(F.col("kind").isNotNull())
    found = pieces.groupBy("row").agg(F.collect_list(_term_span(F.col("start"), F.col("kind"), F.col("piece"))).alias("more"))
    return few.unionByName(found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row, base and spans (base and method) of every row; a method span that meets a base one is left out."""
    based = base_spans(docs)
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    some = F.size("spans") > 0
    found = settle(based.select("doc_id", "row", "spans", F.when(some, entities).alias("entities"), F.when(some, _words(F.col("text"))).alias("words")), "base")
    texts = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    held = found.where(F.size("spans") > 0)
    terms, places = revealing_terms(held.select("row", F.explode("entities").alias("entity")), held.select("row", "words"), texts)
    more = term_spans(texts, terms, places)
    more = more.select("row", F.array_distinct("more").alias("more"))
    joined = found.join(more, "row", "left")
    apart = F.filter("more", lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "row", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce(apart, _no_spans()))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row: base spans become their kind in brackets, generalised terms <TERM>, removed ones nothing.

    Of spans that overlap, the first one is replaced.
    """
    spans = find(docs).select("row", "spans").dropDuplicates(["row"])
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")).join(spans, "row", "left")
    label = lambda k: F.when(k == "remove", "").when(k == "generalise", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(k), F.lit(">")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        more = F.struct(F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), label(s["kind"])).alias("done"), s["end"].alias("at"))
        return F.when(s["start"] >= a["at"], more).otherwise(a)

    built = F.aggregate("spans", start, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.col("text").isNull(), None).otherwise(built).alias("text"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
