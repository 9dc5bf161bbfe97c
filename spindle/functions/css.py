"""URLs in style sheets: one small scanner gives them with their places, for extraction and rewriting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_BLANK = " \t\n\r\f\v"


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    return at


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _quoted(text: str, at: int, closes) -> tuple[int, int, int] | None:
    """(start, end, after) of a quoted URL at ``at`` that ``closes`` accepts what follows of."""
    if at < len(text) and text[at] in "\"'":
        end = text.find(text[at], at + 1, _line_end(text, at))
        while end >= 0:
            after = closes(text, end + 1)
            if after:
                return at + 1, end, after
            end = text.find(text[at], end + 1, _line_end(text, at))
    return None


def _bracket(text: str, at: int) -> int:
    at = _skip(text, at)
    return at + 1 if text[at : at + 1] == ")" else 0


def _separator(text: str, at: int) -> int:
    return at + 1 if at < len(text) and text[at] in _BLANK + ";" else 0


def _in_brackets(text: str, at: int) -> tuple[int, int, int] | None:
    at = _skip(text, at)
    found = _quoted(text, at, _bracket)
    if found:
        return found
    end = text.find(")", at)
    if end < 0 or "\n" in text[at:end].rstrip():
        return None
    return at, at + len(text[at:end].rstrip()), end + 1


def _bare(text: str, at: int) -> tuple[int, int, int] | None:
    end = at
    while end < len(text) and text[end] not in _BLANK + ";":
        end += 1
    return (at, end, end + 1) if end < len(text) else None


def positions(css: str) -> list[tuple[str, int, int]]:
    """[X5] (url, start, end) of url(...) and @import, with offsets in the text; without comments, empty and data: URLs."""
    text = _COMMENT.sub(lambda c: " " * len(c[0]), css)
    low, out, at = text.lower(), [], 0
    while True:
        places = [p for p in (low.find("url", at), low.find("@import", at)) if p >= 0]
        if not places:
            return out
        at, found = min(places), None
        if low.startswith("url", at):
            after = _skip(text, at + 3)
            found = _in_brackets(text, after + 1) if text[after : after + 1] == "(" else None
        else:
            after = _skip(text, at + 7)
            if after > at + 7 and not (low.startswith("url", after) and text[_skip(text, after + 3) :][:1] == "("):
                found = _quoted(text, after, _separator) or _bare(text, after)
        if found is None:
            at += 3
            continue
        start, end, at = found
        url = text[start:end]
        if url and not (url.strip().startswith("data:") and "," in url):
            out.append((url, start, end))


@F.pandas_udf(ArrayType(StringType()))
def _found(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [u for u, _, _ in positions(t or "")])


def css_urls(css: Column) -> Column:
    """[X5] URLs in order, duplicates kept; a null text has none."""
    return _found(css)


def css_urls_distinct(css: Column) -> Column:
    """[X5a] URLs in the order of their first places."""
    return F.array_distinct(_found(css))


def rewrite(css: str, links: dict[str, str]) -> str:
    """[W2] Replaces URLs at their places; empty or equal replacements leave the text alone."""
    out, at = [], 0
    for url, start, end in positions(css):
        new = links.get(url)
        if new and new != url:
            out += [css[at:start], new]
            at = end
    return "".join([*out, css[at:]])


def css_rewrite(css: Column, links: Column) -> Column:
    """[W2] ``links``: a map from URLs to their replacements."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite(t, dict(m) if m is not None else {}) for t, m in zip(texts, maps)])

    return run(css, links)
