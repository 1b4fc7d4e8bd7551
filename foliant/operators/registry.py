"""Routing: which converters take a row, and in which order they are tried.

The rules are a small table; routing is one array expression over it, so a
million documents are routed in one scan without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uri as U

SPECIFIC, GENERIC = 0.0, 10.0


@dataclass(frozen=True)
class Rule:
    """A converter's accept rule: extensions or mime prefixes, and what else must hold (over the row's columns)."""

    name: str
    extensions: tuple[str, ...] = ()
    mimes: tuple[str, ...] = ()
    priority: float = SPECIFIC
    also: Callable[[], Column] | None = None
    #: Extensions and mimes that count only if ``check`` holds.
    candidate_extensions: tuple[str, ...] = ()
    candidate_mimes: tuple[str, ...] = ()
    check: Callable[[], Column] | None = None

    def accepts(self) -> Column:
        ext, mime = F.lower(F.coalesce("extension", F.lit(""))), F.lower(F.coalesce("mimetype", F.lit("")))

        def listed(extensions: tuple[str, ...], mimes: tuple[str, ...]) -> Column:
            out = ext.isin(*extensions) if extensions else F.lit(False)
            for m in mimes:
                out = out | mime.startswith(m)
            return out

        ok = listed(self.extensions, self.mimes)
        if self.also is not None:
            ok = ok & self.also()
        if self.check is not None:
            ok = ok | (listed(self.candidate_extensions, self.candidate_mimes) & self.check())
        return F.coalesce(ok, F.lit(False))


def _text() -> Column:
    return F.decode("content", "UTF-8")


HTML = ((".html", ".htm"), ("text/html", "application/xhtml"))
FEED = r"(?s)^\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:rss[\s>]|(?:\w+:)?feed[\s>].*<(?:\w+:)?entry[\s>])"
#: The built-in rules in the order of registration: newer ones are tried first among equals (fixed values).
BUILTIN = (
    Rule("text", (".txt", ".text", ".md", ".markdown", ".json", ".jsonl"), ("text/", "application/json", "application/markdown"), GENERIC, check=lambda: F.col("charset").isNotNull(), candidate_mimes=("",)),
    Rule("zip", (".zip",), ("application/zip",), GENERIC),
    Rule("html", *HTML, GENERIC),
    Rule("rss", (".rss", ".atom"), ("application/rss", "application/atom"), candidate_extensions=(".xml",), candidate_mimes=("text/xml", "application/xml"), check=lambda: F.rlike(_text(), F.lit(FEED))),
    Rule("wikipedia", *HTML, also=lambda: U.site("url") == "wikipedia"),
    Rule("youtube", *HTML, also=lambda: U.video_id("url").isNotNull()),
    Rule("bing", *HTML, also=lambda: U.site("url") == "bing"),
    Rule("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    Rule("xlsx", (".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    Rule("xls", (".xls",), ("application/vnd.ms-excel", "application/excel")),
    Rule("pptx", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml",)),
    Rule("audio", (".wav", ".mp3", ".m4a", ".mp4"), ("audio/x-wav", "audio/mpeg", "video/mp4")),
    Rule("image", (".jpg", ".jpeg", ".png"), ("image/jpeg", "image/png")),
    Rule("ipynb", (".ipynb",), candidate_mimes=("application/json",), check=lambda: F.contains(_text(), F.lit("nbformat")) & F.contains(_text(), F.lit("nbformat_minor"))),
    Rule("pdf", (".pdf",), ("application/pdf", "application/x-pdf")),
    Rule("msg", (".msg",), ("application/vnd.ms-outlook",), candidate_mimes=("application/x-ole-storage",), check=lambda: F.contains(F.hex("content"), F.lit("5F005F00730075006200730074006700"))),
    Rule("epub", (".epub",), ("application/epub", "application/x-epub+zip")),
    Rule("csv", (".csv",), ("text/csv", "application/csv")),
)


@dataclass
class Registry:
    """Rules in registration order; ``order()`` is the order in which they are tried."""

    rules: list[Rule] = field(default_factory=lambda: list(BUILTIN))
    converters: dict[str, Callable] = field(default_factory=dict)

    def register(self, rule: Rule, convert: Callable | None = None) -> None:
        self.rules.append(rule)
        if convert is not None:
            self.converters[rule.name] = convert

    def order(self) -> list[Rule]:
        """Lower priority first; among equals the newest first."""
        return [r for _, r in sorted(enumerate(self.rules), key=lambda x: (x[1].priority, -x[0]))]

    def accepted(self) -> Column:
        """Names of the converters that accept a row, in the order of trial."""
        return F.array_compact(F.array(*[F.when(r.accepts(), F.lit(r.name)) for r in self.order()]))


#: Extensions and mime types that name each other (fixed values).
TYPES = {
    ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".xml": "text/xml", ".pdf": "application/pdf", ".zip": "application/zip", ".epub": "application/epub+zip", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".mp4": "video/mp4", ".msg": "application/vnd.ms-outlook", ".xls": "application/vnd.ms-excel",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def mime_of(extension: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.lower(extension))


def extension_of(mime: Column) -> Column:
    back: dict[str, str] = {}
    for e, m in TYPES.items():
        back.setdefault(m, e)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), F.lower(mime))


def overlay(new: str, base: str) -> list[Column]:
    """Fields of ``new`` where it has them, else of ``base`` (struct columns)."""
    return [F.coalesce(F.col(f"{new}.{f}"), F.col(f"{base}.{f}")).alias(f) for f in ("mimetype", "extension", "charset", "filename", "local_path", "url")]


def with_guess(df: DataFrame) -> DataFrame:
    """Fill mimetype and extension from each other, and what a row has neither of from its content's signature.

    ``_other`` is the signature's guess where it contradicts what the row says.
    """
    from ..functions.ids import sniff

    sniffed = F.when(F.length("content") > 0, sniff("content")) if "content" in df.columns else F.lit(None).cast("struct<mimetype:string,extension:string>")
    df = df.withColumn("_sniff", sniffed)
    bare = F.col("extension").isNull() & F.col("mimetype").isNull()
    ext = F.coalesce(F.col("extension"), extension_of(F.col("mimetype")), F.when(bare, F.col("_sniff.extension")))
    mime = F.coalesce(F.col("mimetype"), mime_of(F.col("extension")), F.when(bare, F.col("_sniff.mimetype")))
    agrees = F.coalesce(mime == F.col("_sniff.mimetype"), F.lit(True)) & F.coalesce(F.lower(ext) == F.col("_sniff.extension"), F.lit(True))
    guess = F.struct(ext.alias("extension"), mime.alias("mimetype"), F.when(~agrees, F.col("_sniff")).alias("other"))
    # a generator of one row: the guess is worked out once, not inside each of the rules above it
    df = df.select("*", F.explode(F.array(guess)).alias("_guess"))
    return df.withColumns({"extension": F.col("_guess.extension"), "mimetype": F.col("_guess.mimetype"), "_other": F.col("_guess.other")}).drop("_sniff", "_guess")


def route(df: DataFrame, registry: Registry | None = None) -> DataFrame:
    """df (content, mimetype, extension, charset, url) with ``candidates``, the converters to try in order.

    Guesses are the outer loop: what the row says first, then what its content
    looks like if that is something else; within a guess, the rules' order.
    """
    rules = registry or Registry()
    out = with_guess(df).withColumn("_first", rules.accepted()).withColumns({"_ext": F.col("extension"), "_mime": F.col("mimetype")})
    out = out.withColumns({"extension": F.col("_other.extension"), "mimetype": F.col("_other.mimetype")})
    out = out.withColumn("_second", F.when(F.col("_other").isNotNull(), rules.accepted()).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({"extension": F.col("_ext"), "mimetype": F.col("_mime"), "candidates": F.array_distinct(F.concat("_first", "_second"))})
    return out.drop("_other", "_first", "_second", "_ext", "_mime")
