"""Links in HTML and SVG: one parse of a page gives all its link rows; rewriting splices at the same places."""

from __future__ import annotations

import functools
import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import css as _css
from spindle.functions import fixed, urls
from spindle.functions.urls import refresh_target

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SET = re.compile(r"\s*,*\s*(\S*[^\s,])(?:\s+([^,]*))?\s*(?:,|\Z)")
_ENTITY = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

@functools.lru_cache(maxsize=64)
def _by_tag(rules: tuple) -> dict:
    """Numbered rules by element; those of any element stand in each list."""
    tags = {r[0] for r in rules} | {"*"}
    return {t: [(i, r) for i, r in enumerate(rules) if r[0] in ("*", t)] for t in tags}


SCHEMA = "ordinal int, rule_id int, tag string, attr string, kind string, type int, raw_url string, start int, end int"


def srcset(value: str) -> list[tuple[str, int, int]]:
    """[X2] (url, start, end) of each candidate."""
    return [(m[1], m.start(1), m.end(1)) for m in _SET.finditer(value) if m[1]]


def unescaped(raw: str) -> tuple[str, list[int]]:
    """The text with its entities read, and for each of its characters and its end the place in the source."""
    out, places, at = [], [], 0
    for m in _ENTITY.finditer(raw):
        read = _html.unescape(m[0])
        if read != m[0]:
            out += [raw[at : m.start()], read]
            places += [*range(at, m.start()), *[m.start()] * len(read)]
            at = m.end()
    return "".join([*out, raw[at:]]), [*places, *range(at, len(raw) + 1)]


def links(page: str, rules=None, base: int = 0) -> list[tuple]:
    """[X1-X4, X9] Link rows (rule_id, tag, attr, kind, type, raw_url, start, end) in document order, the first rule that fits an attribute only.

    start and end are the link's place in the source text, so that entities and quotes around it stay.
    """
    rules = fixed.LINK_RULES if rules is None else rules
    by_tag = _by_tag(tuple(map(tuple, rules)))
    out: list[tuple] = []
    stack: list[str] = []
    at = 0
    while (m := _TAG.search(page, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            continue
        attrs = {}
        for a in _ATTR.finditer(m[3]):
            group = next((g for g in (2, 3, 4) if a[g] is not None), None)
            where = m.start(3) + (a.start(group) if group else a.end())
            attrs.setdefault(a[1].lower(), (a[group] if group else "", where))
        used = set()
        for rule, (_, ancestor, attr, condition, kind) in by_tag.get(tag, by_tag["*"]):
            if (ancestor and ancestor not in stack) or attr is None or attr not in attrs or attr in used:
                continue
            if condition:
                value = attrs.get(condition[0], ("", 0))[0]
                if not (value == condition[2] if condition[1] == "=" else condition[2] in value):
                    continue
            raw, where = attrs[attr]
            used.add(attr)
            if kind == fixed.CSS_INLINE:
                found = [(u, s, e, "style") for u, s, e in _css.positions(raw)]
            elif attr == "srcset":
                found = [(u, s, e, "srcset") for u, s, e in srcset(raw)]
            else:
                found = [(raw, 0, len(raw), "attr" if page[where - 1 : where] in ("\"", "'") else "bare")] if raw.strip() else []
            out += [(rule, tag, attr, k, fixed.BINARY if kind == fixed.CSS_INLINE else kind, _html.unescape(u), base + where + s, base + where + e) for u, s, e, k in found]
        if tag == "meta" and attrs.get("http-equiv", ("",))[0].lower() == "refresh" and "content" in attrs:
            raw, where = attrs["content"]
            r = refresh_target(raw)
            if r:
                out.append((len(rules), tag, "content", "refresh", fixed.HTML, _html.unescape(raw[r[0] : r[1]]), base + where + r[0], base + where + r[1]))
        if tag == "iframe" and attrs.get("srcdoc", ("",))[0]:
            raw, where = attrs["srcdoc"]
            inner, places = unescaped(raw)
            out += [(r, t, a, f"srcdoc {how}", k, u, base + where + places[s], base + where + places[e]) for r, t, a, how, k, u, s, e in links(inner, rules)]
        if tag in ("script", "style", "textarea", "title", "noscript", "xmp"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "style":
                rule = next((i for i, r in enumerate(rules) if r[0] == "style" and r[2] is None), None)
                if rule is not None:
                    out += [(rule, tag, None, "css", fixed.BINARY, u, base + at + s, base + at + e) for u, s, e in _css.positions(page[at:stop])]
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(tag)
    return out


SVG_RULES = [("*", None, "xlink:href", None, fixed.BINARY), ("*", None, "href", None, fixed.BINARY)]


def extract_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", svg: bool = False, rules=None) -> DataFrame:
    """[X1, X8] A row per link of each page: id, page url, then SCHEMA. Null bodies have no links; map-only."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, at = [], []
            for i, page in enumerate(batch.column(2)):
                for n, row in enumerate(links(page.as_py() or "", SVG_RULES if svg else rules)):
                    rows.append((n, *row))
                    at.append(i)
            columns = list(zip(*rows)) if rows else [()] * 9
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns, types)], names=[id_col, url_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    return pages.select(id_col, url_col, body_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, {SCHEMA}")


def escaped(new: str, kind: str) -> str:
    """A replacement as its place asks for: raw in a style element, escaped in an attribute, once more in a nested page."""
    once = lambda x: _html.escape(x, quote=True).replace("&#x27;", "'")
    nested, _, own = kind.partition(" ")
    if nested == "srcdoc":
        return once(escaped(new, own))
    return new if kind == "css" else f'"{once(new)}"' if kind == "bare" and re.search(r"[\s\"'=<>`]", new) else once(new)


def splice(page: str, edits: list[tuple[int, int, str, str]]) -> str:
    """[W1, W3] Replaces the places (start, end, new, kind) of a page; overlapping later edits are left out."""
    out, at = [], 0
    for start, end, new, kind in sorted(edits):
        if start >= at:
            out += [page[at:start], escaped(new, kind)]
            at = end
    return "".join([*out, page[at:]])


def rewrite_pages(pages: DataFrame, replacements: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """[W1, W2, W3, W5] ``pages`` with links replaced: ``replacements`` has id, start, end, kind, replace_path.

    For replacements that came through hooks of their own; ``rewrite_site`` needs no join of the bodies.
    """
    by_page = replacements.filter("replace_path <> ''").groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "replace_path", "kind")).alias("edits"))
    return _spliced(pages.join(by_page, id_col, "left").select(*pages.columns, "edits"), pages, body_col)


def _spliced(joined: DataFrame, pages: DataFrame, body_col: str) -> DataFrame:
    names = pages.columns
    at, n = names.index(body_col), len(names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            body = [None if b is None else splice(b, [(e["start"], e["end"], e["replace_path"], e["kind"]) for e in edits or []]) for b, edits in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(body, pa.string()) if i == at else batch.column(i) for i in range(n)], names=names)

    return joined.mapInArrow(run, pages.schema)


def rewrite_site(pages: DataFrame, url_col: str = "url", body_col: str = "html", keep_search: bool = False, rules=None) -> DataFrame:
    """[W1, W3, W5] ``pages`` with every link pointing at its saved copy: each body is read and written in its own partition.

    The links of a page travel beside its body as one array; its URL columns are native expressions on the array.
    """
    kind = "array<struct<kind:string,type:int,raw_url:string,start:int,end:int>>"
    names, at = pages.columns, pages.columns.index(body_col)

    def run(batches):
        import pyarrow as pa

        one = pa.struct([("kind", pa.string()), ("type", pa.int32()), ("raw_url", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = [[dict(zip(("kind", "type", "raw_url", "start", "end"), row[3:])) for row in links(page.as_py() or "", rules)] for page in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(one))], names=[*names, "_links"])

    rows = pages.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + f", _links {kind}")
    own = urls.save_path(F.col(url_col), F.lit(fixed.HTML), keep_search)

    def edit(link):
        raw = link["raw_url"]
        full = urls.resolve(raw, F.col(url_col))
        saved = urls.save_path(full, urls.detect_type(raw, link["type"]), keep_search)
        path = urls.tidy_replacement(urls.relative_path(saved, F.col("_own"), full))
        path = F.when((full == "") | urls.bad_protocol(full, F.col(url_col)) | ~urls.is_followed(raw), F.lit("")).otherwise(path)
        return F.struct(link["start"].alias("start"), link["end"].alias("end"), path.alias("replace_path"), link["kind"].alias("kind"))

    rows = rows.withColumn("_own", own).select(*names, F.filter(F.transform("_links", edit), lambda e: e["replace_path"] != "").alias("edits"))
    return _spliced(rows, pages, body_col)


def sitemap_urls(body):
    """[X7] Distinct trimmed loc texts of a urlset, in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"), F.lit(1))
    return F.when(body.rlike(r"(?i)<urlset[\s>]"), F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))).otherwise(F.array().cast("array<string>"))
