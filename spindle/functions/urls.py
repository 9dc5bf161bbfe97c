"""URL algebra and path derivation as native column expressions (SURVEY ids in brackets)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindle.functions import fixed

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_ESCAPED = r'(?i)%3A|%2A|%3F|%22|%3C|%3E|%7C|%26|[:*?"<>|&]'


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/{2,}([^/?#]*)", 1)


def hostname(u: Column) -> Column:
    """Host without user and port."""
    return F.lower(F.regexp_extract(authority(u), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(u: Column) -> Column:
    """Path of an absolute URL, at least /."""
    return F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?:/{2,}[^/?#]*)?([^?#]*)", 1), "^$", "/")


def search(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"(?s)(#.*)$", 1)


def is_http(u: Column) -> Column:
    """[F8]"""
    return u.startswith("http://") | u.startswith("https://")


def is_sitemap(u: Column) -> Column:
    """[F9]"""
    return u.contains("/sitemaps/") & (u.endswith("sitemap.xml") | u.endswith("sitemap_other.xml"))


def is_followed(u: Column) -> Column:
    """Not a fragment and not of a skipped scheme; case counts."""
    return ~u.startswith("#") & ~u.rlike("^(?:" + "|".join(s.replace("-", r"\-") for s in fixed.SKIPPED_SCHEMES) + "):")


def bad_protocol(u: Column, ref: Column) -> Column:
    """The scheme is neither http, https, file nor the parent's, or a host is missing."""
    s = scheme(u)
    return ~(s.isin("http", "https", "file") | (s == scheme(ref))) | ((s != "file") & (authority(u) == ""))


def escape_path(s: Column) -> Column:
    """[U4]"""
    return F.regexp_replace(s, _ESCAPED, "_")


def fold_dots(p: Column) -> Column:
    """Removes . and .. segments; .. stops at the root."""
    segments = F.split(p, "/", -1)
    keep = F.aggregate(segments, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(keep, "/"), F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def resolve(raw: Column, ref: Column) -> Column:
    """[U1] Absolute URL of a link in the page ``ref``."""
    root = F.concat(scheme(ref), F.lit("://"), authority(ref))
    bare = F.regexp_replace(ref, r"(?s)#.*$", "")
    relative = F.concat(fold_dots(F.concat(F.regexp_replace(path(ref), r"[^/]*$", ""), F.regexp_extract(raw, r"^([^?#]*)", 1))), F.regexp_extract(raw, r"(?s)^[^?#]*(.*)$", 1))
    absolute = F.regexp_replace(raw, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)/{3,}", "$1//")
    return (
        F.when(raw.startswith("//"), F.concat(scheme(ref), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(root, raw))
        .when(raw.startswith("#") | (raw == ""), F.concat(bare, raw))
        .when(raw.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), raw))
        .when(raw.rlike(_SCHEME), F.when(raw.startswith("file:"), raw).otherwise(absolute))
        .otherwise(F.concat(root, relative))
    )


def resolve_file(raw: Column, ref: Column, root: str) -> Column:
    """[U2] Link in a local file, confined to ``root``; empty where it or its parent leaves it."""
    base = "file://" + (root if root.endswith("/") else root + "/")
    inner = F.concat(F.lit("/"), F.regexp_replace(F.substring(ref, len(base) + 1, 1 << 30), r"[^/]*$", ""))
    plain = F.regexp_replace(raw, r"\?[^#]*", "")
    own = F.when(plain.startswith("file:///"), F.when(plain.startswith(base), F.substring(plain, len(base), 1 << 30))).when(plain.startswith("/"), F.regexp_replace(plain, "^/+", "/")).otherwise(F.concat(inner, plain))
    good = ref.startswith(base) & own.isNotNull()
    return F.when(good, F.concat(F.lit(base), F.regexp_replace(fold_dots(F.regexp_extract(own, "^([^#]*)", 1)), "^/+", ""), fragment(own))).otherwise(F.lit(""))


def order_search(s: Column) -> Column:
    """[U5] Query with its keys sorted; values of a key in their order."""
    each = F.filter(F.split(F.regexp_replace(s, r"^\?", ""), "&", -1), lambda x: x != "")
    pair = F.transform(each, lambda x, i: F.struct(F.when(x.rlike("^[^=]+="), F.regexp_extract(x, "^([^=]*)=", 1)).otherwise(x).alias("k"), i.alias("i"), F.when(x.rlike("^[^=]+="), x).otherwise(F.concat(x, F.lit("="))).alias("v")))
    return F.when(F.size(each) > 0, F.concat(F.lit("?"), F.array_join(F.transform(F.array_sort(pair), lambda p: p["v"]), "&"))).otherwise(F.lit(""))


def short_hash(s: Column) -> Column:
    """[U6] SHA-256 in unpadded base64url."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(s, 256))), "+/", "-_"), F.lit("="))


def with_suffix(p: Column, suffix: Column) -> Column:
    """Puts ``suffix`` before the extension of the last segment, or at the end."""
    ext = F.regexp_extract(p, r"[^/](\.[^./]*)$", 1)
    return F.concat(F.substr(p, F.lit(1), F.length(p) - F.length(ext)), suffix, ext)


def save_path(u: Column, kind: Column, keep_search: bool = False, local_root: str | None = None) -> Column:
    """[U3] Path, below the output folder, that a URL is saved at."""
    p = path(u)
    if local_root:
        base = local_root.rstrip("/")
        p = F.when(scheme(u) == "file", F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)
    clean = escape_path(F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(?i)(?<=/)(?:\.|%2e){1,2}(?=/|$)", "_"))
    # each step uses the one before once, so that generated code stays small
    full = F.concat(F.when(scheme(u) == "file", F.lit("")).otherwise(F.concat(hostname(u), F.lit("/"))), F.regexp_replace(clean, "^/", ""))
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace(full, r"(^|/)\z", "$1index.html"), r"\.htm\z", ".html"), r"(?<!\.html)\z", ".html")
    out = F.when(kind == fixed.HTML, html).otherwise(full)
    if not keep_search:
        return out
    ordered = order_search(search(u))
    suffix = F.when(F.length(search(u)) > 43, F.concat(F.lit("_"), short_hash(ordered))).otherwise(escape_path(ordered))
    return F.when(F.length(search(u)) > 1, with_suffix(out, suffix)).otherwise(out)


def file_url(p: Column) -> Column:
    """[U7]"""
    return F.concat(F.lit("file:///"), F.replace(p, F.lit("\\"), F.lit("/")))


def relative_path(target: Column, base: Column, url: Column) -> Column:
    """[U8] Link from the file ``base`` to the file ``target``, with the URL's fragment."""
    rest = F.regexp_replace(F.concat(base, F.lit("\n"), target), r"^((?:[^/\n]*/)*)([^\n]*)\n\1(.*)$", "$2\n$3")
    ups = F.regexp_replace(F.regexp_replace(F.substring_index(rest, "\n", 1), r"[^/]+/", "../"), r"[^/]*$", "")
    return F.concat(F.when(target == base, F.lit("")).otherwise(F.concat(ups, F.substring_index(rest, "\n", -1))), fragment(url))


def download_link(u: Column) -> Column:
    """[U9]"""
    bare = F.regexp_replace(u, r"(?s)#.*$", "")
    return F.when(u.startswith("file:"), F.regexp_replace(bare, r"\?.*$", "")).otherwise(bare)


def stored_url(u: Column, keep_search: bool = False) -> Column:
    """[U10]"""
    return u if keep_search else F.regexp_replace(u, r"\?[^#]*", "")


def extension(u: Column) -> Column:
    """[U11] Lower-case extension of the last path portion."""
    bare = F.regexp_replace(F.regexp_replace(u, r"(?s)#[^#]*$", ""), r"\?[^?]*$", "")
    return F.lower(F.regexp_extract(F.substring_index(bare, "/", -1), r"\.([^.]*)$", 1))


def detect_type(u: Column, kind: Column) -> Column:
    """[U12]"""
    ext = extension(u)
    typed = F.when(ext.isin(fixed.BINARY_EXTENSIONS), fixed.BINARY).when(ext == "css", fixed.CSS).when(ext == "svg", fixed.SVG).otherwise(kind)
    return F.when(is_sitemap(u), fixed.SITEMAP).when(kind == fixed.HTML, typed).otherwise(kind).cast("int")


def refresh_target(content: str) -> tuple[int, int] | None:
    """[U13] Place of a refresh's target in the attribute: after the seconds and a semicolon, without url= and quotes."""
    seconds, semicolon, rest = content.partition(";")
    if not semicolon or not seconds.strip().isdigit():
        return None
    start, end = len(content) - len(rest.lstrip()), len(content.rstrip())
    if content[start : start + 3].lower() == "url" and content[start + 3 : end].lstrip().startswith("="):
        start = content.index("=", start) + 1
        start += len(content[start:end]) - len(content[start:end].lstrip())
    if end - start >= 2 and content[start] in "\"'" and content[end - 1] in "\"'":
        inner = content[start + 1 : end - 1]
        start, end = start + 1 + len(inner) - len(inner.lstrip()), end - 1 - (len(inner) - len(inner.rstrip()))
    return (start, end) if start < end else None


def meta_refresh(content: Column) -> Column:
    """[U13] Target of a refresh, null if there is none; the same steps as ``refresh_target``, native."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    semicolon = F.instr(content, ";")
    rest = F.regexp_replace(trimmed(F.substr(content, semicolon + 1)), r"(?i)^url\s*=\s*", "")
    bare = F.when(rest.rlike("^[\"'](?s:.*)[\"']$"), trimmed(F.substr(rest, F.lit(2), F.greatest(F.length(rest) - 2, F.lit(0))))).otherwise(rest)
    return F.when((semicolon > 0) & trimmed(F.substring_index(content, ";", 1)).rlike("^[0-9]+$"), F.nullif(bare, F.lit("")))


def dedupe_key(u: Column, strip_search: bool = True) -> Column:
    """[U14]"""
    return F.regexp_replace(u, r"(?s)[?#].*$" if strip_search else r"(?s)#.*$", "")


def to_text(body: Column, charset: str = "UTF-8") -> Column:
    """[U15]"""
    return F.decode(body, charset)


def raw_path(u: Column) -> Column:
    """[U18]"""
    p = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def unsafe_path(p: Column) -> Column:
    """[U17] Whether some segment fails to decode, is empty or a dot segment, or holds a separator, NUL or colon."""
    inner = F.split(F.regexp_replace(p, r"^/|/$", ""), "/", -1)
    decoded = F.transform(inner, lambda s: F.call_function("try_url_decode", F.replace(s, F.lit("+"), F.lit("%2B"))))
    return (F.regexp_replace(p, r"^/|/$", "") != "") & F.exists(decoded, lambda d: d.isNull() | d.isin("", ".", "..") | d.rlike(r"[/\\\x00:]"))


def content_type(p: Column, default: str = "application/octet-stream") -> Column:
    """[U19]"""
    table = F.create_map(*[F.lit(x) for kv in fixed.CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1))), F.lit(default))


def tidy_replacement(r: Column) -> Column:
    """[U20]"""
    return F.when(r.isin(".html", "/.html"), F.lit("")).otherwise(r)


def accepts_bytes(h: Column) -> Column:
    """[S5a]"""
    return F.array_contains(F.split(h, ","), "bytes")


def same_range_start(start: Column, content_range: Column) -> Column:
    """[S5b]"""
    return F.coalesce(F.regexp_extract(content_range, r"^\s*bytes\s+(\d+)\s*-", 1).try_cast("bigint") == start, F.lit(False))


def encode_uri(text: str) -> str:
    """[U16] Escapes undone but for reserved ones, then done again over the whole; a malformed text stays as it is."""
    from urllib.parse import quote, unquote_to_bytes

    try:
        # an escape of a reserved character keeps its percent sign, which is escaped in its turn
        kept = re.sub(r"%(?=(?:3B|2F|3F|3A|40|26|3D|2B|24|2C|23))", "%25", text, flags=re.I)
        if re.search(r"%(?![0-9A-Fa-f]{2})", text):
            return text
        return quote(unquote_to_bytes(kept).decode("utf-8"), safe=";,/?:@&=+$-_.!~*'()#")
    except UnicodeDecodeError:
        return text


@F.pandas_udf(StringType())
def normal_uri(links: pd.Series) -> pd.Series:
    """[U16] as a column."""
    return links.map(encode_uri, na_action="ignore")


def decoded(body: Column, own: Column, given: Column) -> Column:
    """[X13] A body's text by its own charset, else the given one, else UTF-8; unknown charsets count as UTF-8."""
    name = F.regexp_replace(F.lower(F.coalesce(own, given, F.lit("utf8"))), "[^a-z0-9]", "")
    text = F.decode(body, "UTF-8")
    for names, charset in ((("latin1", "iso88591", "binary"), "ISO-8859-1"), (("ascii", "usascii"), "US-ASCII"), (("utf16le", "ucs2"), "UTF-16LE"), (("utf16be",), "UTF-16BE"), (("utf16",), "UTF-16")):
        text = F.when(name.isin(*names), F.decode(body, charset)).otherwise(text)
    return text


def source_map_of(headers: Column, body: Column) -> Column:
    """[X10] The header's URL first, then those the body announces."""
    named = F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "sourcemap")), 0), F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "x-sourcemap")), 0))
    return F.array_distinct(F.concat(F.when(F.coalesce(named, F.lit("")) != "", F.array(named)).otherwise(F.array().cast("array<string>")), source_map_urls(body)))


def rewrite_source_map(body: Column, link: Column, new: Column, keep_length: bool = False) -> Column:
    """[W4] ``link`` where a body announces it becomes ``new``; with ``keep_length`` a shorter one is padded with blanks.

    A link that is missing, unchanged or a mere fragment leaves the body alone.
    """
    at = F.lit(0)
    for p in reversed(fixed.SOURCE_MAP_PREFIXES):
        here = F.instr(body, F.concat(F.lit(p), link))
        at = F.when(here > 0, here + len(p)).otherwise(at)
    put = F.rpad(new, F.greatest(F.length(link), F.length(new)), F.lit(" ")) if keep_length else new
    return F.when((at > 0) & (link != new) & (new != "") & ~link.startswith("#"), F.overlay(body, put, at, F.length(link))).otherwise(body)


def source_map_urls(body: Column) -> Column:
    """[X10] First URL after each of the three announcements."""
    found = [F.regexp_extract(body, "(?s)" + r"\Q" + p + r"\E" + f"([{fixed.URI_CHARS}]+)", 1) for p in fixed.SOURCE_MAP_PREFIXES]
    return F.filter(F.array(*found), lambda x: x != "")


def redirect_page(link: Column, charset: str = "utf8") -> Column:
    """[K3] Page that sends a visitor on to ``link``."""
    return F.concat(F.lit(f'<html lang="en">\n<head>\n<meta charset="{charset}">\n<meta http-equiv="refresh" content="0; url='), link, F.lit("\">\n<script>location.replace('"), F.replace(link, F.lit("'"), F.lit("\\'")), F.lit("' + location.hash);</script>\n<title>Redirecting</title>\n</head>\n</html>"))
