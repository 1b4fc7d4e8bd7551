"""URIs, headers and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def scheme(uri: str | Column) -> Column:
    """Lower-case scheme, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(_c(uri)), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def source_kind(uri: str | Column) -> Column:
    """file, data, http, or local for a path; null for a scheme that no reader takes."""
    s = scheme(uri)
    return F.when(s.isNull(), "local").when(s == "file", "file").when(s == "data", "data").when(s.isin("http", "https"), "http")


def host(url: str | Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def path(url: str | Column) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_value(url: str | Column, key: str) -> Column:
    """First value of a query key, still encoded."""
    return F.nullif(F.regexp_extract(_c(url), rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def basename(p: str | Column) -> Column:
    return F.regexp_extract(_c(p), r"([^/\\]*)$", 1)


def extension(p: str | Column) -> Column:
    """Lower-case extension with its dot, null if the base name has none."""
    return F.nullif(F.lower(F.regexp_extract(basename(p), r"^.+(\.[^.]+)$", 1)), F.lit(""))


def percent_decode(text: str | Column) -> Column:
    """%XX sequences decoded as UTF-8; a plus sign stays. Null if they are no UTF-8."""
    return F.try_url_decode(F.regexp_replace(F.replace(_c(text), F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"))


def file_uri_path(uri: str | Column) -> Column:
    """Local path of a file URI; null for another host or a network path."""
    u = F.trim(_c(uri))
    netloc = F.lower(F.regexp_extract(u, r"(?i)^file://([^/]*)", 1))
    local = percent_decode(F.regexp_extract(u, r"(?i)^file:(?://[^/]*)?([^?#]*)", 1))
    good = (scheme(u) == "file") & netloc.isin("", "localhost") & ~F.rlike(local, F.lit(r"^(?://|\\\\)"))
    return F.when(good, local)


def data_uri(uri: str | Column) -> Column:
    """struct(mimetype, attributes, data) of a data URI; null without a comma."""
    u = _c(uri)
    head = F.regexp_extract(u, r"(?i)^\s*data:([^,]*),", 1)
    body = F.regexp_extract(u, r"(?is)^\s*data:[^,]*,(.*)$", 1)
    parts = F.split(head, ";", -1)
    first = F.element_at(parts, 1)
    base64 = F.lower(F.element_at(parts, -1)) == "base64"
    mimetype = F.when(F.contains(first, F.lit("/")), first)
    pairs = F.filter(parts, lambda p: F.contains(p, F.lit("=")))
    names = F.transform(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)))
    values = F.transform(pairs, lambda p: F.regexp_replace(p, "^[^=]*=", ""))
    data = F.when(base64, F.try_to_binary(percent_decode(body), F.lit("base64"))).otherwise(F.to_binary(percent_decode(body), F.lit("utf-8")))
    ok = F.rlike(u, F.lit(r"(?i)^\s*data:[^,]*,"))
    return F.when(ok, F.struct(mimetype.alias("mimetype"), F.map_from_arrays(F.array_distinct(names), F.slice(values, F.lit(1), F.size(F.array_distinct(names)))).alias("attributes"), data.alias("data")))


def content_type(header: str | Column) -> Column:
    """struct(mimetype, charset) of a Content-Type header."""
    h = _c(header)
    mime = F.nullif(F.lower(F.trim(F.substring_index(h, ";", 1))), F.lit(""))
    return F.struct(mime.alias("mimetype"), F.nullif(F.regexp_extract(h, r'(?i);\s*charset\s*=\s*"?([^";\s]+)', 1), F.lit("")).alias("charset"))


def disposition_filename(header: str | Column) -> Column:
    """File name of a Content-Disposition header: the extended form first, else the first plain one."""
    h = _c(header)
    extended = F.nullif(F.regexp_extract(h, r"(?i);\s*filename\*\s*=\s*\"?[^'\";]*'[^'\";]*'([^\";]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(h, r'(?i);\s*filename\s*=\s*"([^"]*)"', 1), F.lit(""))
    plain = F.nullif(F.trim(F.regexp_extract(h, r'(?i);\s*filename\s*=\s*([^";]+)', 1)), F.lit(""))
    return F.coalesce(percent_decode(extended), quoted, plain)


def response_info(headers_type: str | Column, disposition: str | Column, url: str | Column) -> Column:
    """struct(mimetype, charset, filename, extension, url) of a fetched response."""
    name = F.coalesce(disposition_filename(disposition), F.when(extension(path(url)).isNotNull(), basename(path(url))))
    kind = content_type(headers_type)
    return F.struct(kind["mimetype"].alias("mimetype"), kind["charset"].alias("charset"), name.alias("filename"), extension(name).alias("extension"), _c(url).alias("url"))


def video_id(url: str | Column) -> Column:
    """Id of a YouTube page, null for all others."""
    h, p = host(url), path(url)
    long = h.isin("youtube.com", "www.youtube.com", "m.youtube.com")
    by_path = F.regexp_extract(p, r"^/(?:shorts|embed)/([^/]+)", 1)
    found = F.when(h == "youtu.be", F.regexp_extract(p, r"^/([^/]+)", 1)).when(long & (p == "/watch"), query_value(url, "v")).when(long, by_path)
    return F.nullif(found, F.lit(""))


def site(url: str | Column) -> Column:
    """wikipedia, bing, youtube or null (the first pattern's dot is any character)."""
    u = _c(url)
    return F.when(F.rlike(u, F.lit(r"^https?://[a-zA-Z]{2,3}.wikipedia.org/")), "wikipedia").when(F.rlike(u, F.lit(r"^https://www\.bing\.com/search\?q=")), "bing").when(video_id(u).isNotNull(), "youtube")


def redirect_target(url: str | Column) -> Column:
    """Target of a search-result redirect (parameter u: two characters, then URL-safe base64); else the url itself."""
    u = query_value(url, "u")
    body = F.translate(F.substring(u, 3, 1 << 20), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64"))
    return F.coalesce(F.when(F.length(u) > 2, F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string"))), _c(url))


def requote_path(href: str | Column) -> Column:
    """A link's path with spaces and stray percent signs quoted; sequences that are there stay, as do query and fragment."""
    h = _c(href)
    head = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$", 1)
    p = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$", 2)
    rest = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$", 3)
    quoted = F.replace(F.regexp_replace(p, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit(" "), F.lit("%20"))
    return F.concat(head, quoted, rest)


def member_name_safe(name: str | Column) -> Column:
    """Archive member names: not empty, absolute or with a drive letter, backslash, dot segment or empty inner segment."""
    n = _c(name)
    return (n != "") & ~F.rlike(n, F.lit(r"^/|^[A-Za-z]:|\\|(?:^|/)\.\.?(?:/|$)|//|\x00"))
