"""Text rules as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Trailing white space of a line, in all of Unicode, before a break or the end.
_TRAILING = r"(?U)[\s&&[^\n]]+(?=\n|\z)"


def normalize_output(text: str | Column) -> Column:
    """Converter output: CRLF to LF, no blanks at line ends, at most one empty line in a row."""
    lines = F.regexp_replace(_c(text), "\r?\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, _TRAILING, ""), "\n{3,}", "\n\n")


def normalize_block(text: str | Column) -> Column:
    """A projected block: LF only, no blanks at line ends, no outer empty lines, runs of empty lines as one."""
    lines = F.regexp_replace(_c(text), "\r\n?", "\n")
    lines = F.regexp_replace(lines, _TRAILING, "")
    return F.regexp_replace(F.regexp_replace(lines, r"^\n+|\n+\z", ""), "\n{3,}", "\n\n")


def block_digest(text: str | Column) -> Column:
    return F.sha2(normalize_block(text), 256)


def newline_kind(text: str | Column) -> Column:
    """none, lf, crlf, cr or mixed."""
    t = _c(text)
    crlf = F.contains(t, F.lit("\r\n"))
    rest = F.replace(t, F.lit("\r\n"), F.lit(""))
    lf, cr = F.contains(rest, F.lit("\n")), F.contains(rest, F.lit("\r"))
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(kinds > 1, "mixed").when(crlf, "crlf").when(lf, "lf").when(cr, "cr").otherwise("none")


def with_newlines(text: str | Column, kind: str | Column) -> Column:
    """Replacement text in a source's line ends; null where these are mixed, or where there are none and the text has one."""
    plain = F.regexp_replace(_c(text), "\r\n?", "\n")
    k = _c(kind)
    swap = lambda s: F.replace(plain, F.lit("\n"), F.lit(s))
    return F.when(k == "lf", plain).when(k == "crlf", swap("\r\n")).when(k == "cr", swap("\r")).when((k == "none") & ~F.contains(plain, F.lit("\n")), plain)


def merge_partial_numbers(text: str | Column) -> Column:
    """A line that is only ``.12`` joins the next line that is not blank; what was joined is not looked at again."""
    return F.regexp_replace(_c(text), r"(?md)^[ \t]*(\.\d+)[ \t]*\n(?:[ \t]*\n)*[ \t]*(?=[^\s])([^\n]*)", "$1 $2")


def strip_comments(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"(?s)<!--.*?-->", "")


def escape_cell(text: str | Column) -> Column:
    """A pipe-table cell: backslashes before a pipe doubled, the pipe escaped, line breaks as one space."""
    piped = F.regexp_replace(_c(text), r"(\\*)\|", r"$1$1\\|")
    return F.regexp_replace(piped, "\r\n|\n|\r", " ")


def pipe_row(cells: str | Column) -> Column:
    """One row of a pipe table from an array of cells."""
    return F.concat(F.lit("| "), F.array_join(F.transform(_c(cells), escape_cell), " | "), F.lit(" |"))


def pipe_separator(width: int | Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))


def truncate_data_uris(text: str | Column) -> Column:
    """Image links keep only the start of a data URI."""
    return F.regexp_replace(_c(text), r"(?i)(!\[[^\]]*\]\(data:[^,)\s]*),[^)\s]*", "$1...")


def escape_markers(text: str | Column, prefix: str = "foliant") -> Column:
    """User text that looks like an identity marker can't be taken for one."""
    return F.regexp_replace(_c(text), rf"(?m)^(\s*)<!--(\s*{prefix}[:-])", "$1&lt;!--$2")


def marker(kind: str, /, prefix: str = "foliant", **values: str | Column) -> Column:
    """``<!-- prefix:kind key="value" ... -->`` with keys in the given order."""
    parts: list[Column] = [F.lit(f"<!-- {prefix}:{kind}")]
    for k, v in values.items():
        parts += [F.lit(f' {k}="'), _c(v).cast("string"), F.lit('"')]
    return F.concat(*parts, F.lit(" -->"))


def marker_fields(line: str | Column, prefix: str = "foliant") -> Column:
    """Keys and values of a marker line as a map; null if the line is none or breaks the grammar."""
    ok = F.rlike(_c(line), F.lit(rf'^<!-- {prefix}:[a-z]+(?: [a-z]+="[^"<>]*")* -->$'))
    keys = F.regexp_extract_all(_c(line), F.lit(r' ([a-z]+)="[^"<>]*"'), F.lit(1))
    values = F.regexp_extract_all(_c(line), F.lit(r' [a-z]+="([^"<>]*)"'), F.lit(1))
    return F.when(ok & (F.size(F.array_distinct(keys)) == F.size(keys)), F.map_from_arrays(keys, values))


def split_table_row(line: str | Column) -> Column:
    """Cells of a pipe-table line: one outer pipe on each side dropped, cells trimmed."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(_c(line)), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda x: F.trim(x))


def inline_runs(line: str | Column) -> Column:
    """Bold, italic and code tokens and the plain text between them, in order."""
    return F.regexp_extract_all(_c(line), F.lit(r"\*\*[^*]+\*\*|`[^`]+`|\*[^*]+\*|[^*`]+|[*`]"), F.lit(0))


def strip_inline(text: str | Column, rounds: int = 4) -> Column:
    """Without bold, italic and code marks; each round takes one level of nesting."""
    out = _c(text)
    for _ in range(rounds):
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1"), "`([^`]+)`", "$1")
    return out


def heading_text(text: str | Column) -> Column:
    """Flattened text of a heading: non-empty parts joined by one space, null if nothing is left."""
    parts = F.filter(F.transform(F.split(_c(text), r"\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def repartition_source(text: str | Column, segments: int | Column) -> Column:
    """A notebook source dealt to as many segments as before: lines with their ends, padded with empty ones, the tail merged."""
    n = F.lit(segments) if isinstance(segments, int) else segments
    lines = F.regexp_extract_all(_c(text), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    merged = F.concat(F.slice(lines, F.lit(1), n - 1), F.array(F.array_join(F.slice(lines, n, F.greatest(F.size(lines) - n + 1, F.lit(0))), "")))
    padded = F.concat(lines, F.array_repeat(F.lit(""), F.greatest(n - F.size(lines), F.lit(0))))
    return F.when(F.size(lines) > n, merged).otherwise(padded)


def xml_escape(text: str | Column) -> Column:
    out = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute_escape(text: str | Column, quote: str = '"') -> Column:
    out = xml_escape(text)
    for raw, name in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), (quote, "&quot;" if quote == '"' else "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def xml_chars_valid(text: str | Column) -> Column:
    """Whether all characters are allowed in XML 1.0."""
    return ~F.rlike(_c(text), F.lit(r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"))


def email_markdown(sender: Column, to: Column, subject: Column, body: Column) -> Column:
    """A message: headers that are there, then the body."""
    head = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), v, F.lit("\n"))).otherwise("")
    return F.trim(F.concat(F.lit("# Email Message\n\n"), head("From", sender), head("To", to), head("Subject", subject), F.lit("\n## Content\n\n"), F.coalesce(body, F.lit(""))))


def strip(text: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+\z", "")
