"""Operator 7, HTML main text by consensus paths of a host."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea object canvas audio video select title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold an article's own text.
ASIDE = frozenset("nav footer header aside form button menu dialog search head".split())
#: An open paragraph ends where one of these starts.
ENDS_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: An open item ends where another of its kind starts, up to the list or table around it.
ENDS_ITEM = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
#: Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar aside header masthead footer foot colophon cookie cookies consent gdpr notice notices notification alert modal popup overlay newsletter subscribe signup login share sharing social comment comments discussion disqus respond replies reply related recommended recommendations widget widgets pagination pager toolbar copyright legal disclaimer toc skip search form contentinfo complementary".split()
)
#: Of these, words that mark furniture however much text it holds: readers' comments can be longer than the article.
FIRM = frozenset("ad ads advert adverts advertisement advertising nav navbar navigation menu menus footer cookie cookies consent comment comments discussion disqus respond replies reply related newsletter form".split())
#: Words that make a name tell about something else than the element's own content.
OTHER = frozenset("has have no non not with without none is in off hide category categories tag format status type template style theme layout page-template".split())
#: Words that mark the article itself.
ARTICLE = frozenset("article post entry content story main body text maincontent articlebody page hentry prose".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"[\s\x1c-\x1f]+")
DIGITS = re.compile(r"\d+")


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    out, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key in ("class", "id", "role"):
            out += value.split()
    return out, hidden


def _furniture(tag: str, names: list[str]) -> int:
    """0 for content, 1 if the names speak of furniture, 2 if the tag or a firm name does.

    A name counts as a whole: its first or last word must be one of furniture, and none may turn the sense.
    """
    if tag in ASIDE:
        return 2
    if tag in ("html", "body", "main", "article"):
        return 0
    level = 0
    for n in names:
        parts = [w.lower() for w in re.split(r"[^a-zA-Z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n)) if w]
        if not parts or OTHER & set(parts):
            continue
        ends = {parts[0], parts[-1]} if len(parts) < 4 else {parts[-1]}
        if ends & FURNITURE and not (parts[-1] in ARTICLE and parts[0] not in FIRM):
            level = max(level, 2 if ends & FIRM else 1)
    return level


class Block:
    """A text with its container (a node of the page's tree of paths) and the furniture elements around it."""

    __slots__ = ("text", "node", "linked", "marks", "furniture", "prose")

    def __init__(self, text: str, node: int, linked: int, marks: tuple):
        self.text, self.node, self.linked, self.marks, self.furniture = text, node, linked, marks, bool(marks)
        self.prose = max(0, len(text) - 2 * linked)


class Page:
    """Text blocks in page order and the tree of generalised tag-class paths, from the body down.

    A step of a path is the tag with its classes, digits replaced by 0; a node is known by its parent and step.
    Unclosed elements end where HTML ends them: paragraphs and items at the next of their kind, all else with its
    parent. An element that only its names call furniture is content after all if little prose is left without it.
    """

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.step, self.nodes = [-1], [""], {}
        self.names: list[int] = []  # level of each furniture element
        self.depth: list[int] = []  # node that each furniture element stands for
        self._read(page)
        self._reconsider()

    def _node(self, parent: int, step: str) -> int:
        found = self.nodes.get((parent, step))
        if found is None:
            found = self.nodes[parent, step] = len(self.step)
            self.parent.append(parent)
            self.step.append(step)
        return found

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, tuple]] = []  # tag, node, furniture elements around
        open_: dict[str, int] = {}
        run: list[str] = []
        linked = 0

        def flush():
            nonlocal linked
            if run:
                text = SPACE.sub(" ", _html.unescape("".join(run))).strip()
                if text:
                    self.blocks.append(Block(text, stack[-1][1] if stack else 0, linked, stack[-1][2] if stack else ()))
                run.clear()
            linked = 0

        def cut(k: int):
            if any(t in BLOCK for t, _, _ in stack[k:]):
                flush()
            for t, _, _ in stack[k:]:
                open_[t] -= 1
            del stack[k:]

        def close(tag: str):
            if open_.get(tag):
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            end = m.start() if m else n
            if end > at:
                run.append(page[at:end])
                linked += (end - at) if open_.get("a") else 0
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not open_.get("p") or tag == "br":
                    run.append(" ")
                close(tag)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else n
                run.append(" ") if tag not in ("script", "style", "template", "noscript") else None
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    run.append(" ")
                continue
            if tag in BLOCK:
                if tag in ENDS_P:
                    close("p")
                if tag in ENDS_ITEM:
                    kinds, stops = (x.split() for x in ENDS_ITEM[tag])
                    if any(open_.get(k) for k in kinds):
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in stops:
                                break
                            if stack[k][0] in kinds:
                                cut(k)
                                break
                flush()
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            names, hidden = _names(m[3]) if m[3] else ([], False)
            level = 2 if hidden else _furniture(tag, names)
            above, marks = (stack[-1][1], stack[-1][2]) if stack else (0, ())
            node = self._node(above, DIGITS.sub("0", ".".join([tag, *sorted(names)]))) if tag in BLOCK and tag not in ("html", "body") else above
            if level:
                # the outermost firm element settles all within; of others only a few can be nested in one another
                if not any(self.names[x] == 2 for x in marks):
                    marks = (*marks, len(self.names)) if level == 1 else (len(self.names),)
                self.names.append(level)
                self.depth.append(node)
            stack.append((tag, node, marks))
            open_[tag] = open_.get(tag, 0) + 1
        flush()

    def _reconsider(self) -> None:
        firm = {i for i, level in enumerate(self.names) if level == 2}
        soft = [b for b in self.blocks if b.marks and not firm & set(b.marks)]
        if not soft:
            return
        plain = sum(b.prose for b in self.blocks if not b.marks)
        held: dict[int, int] = {}
        for b in soft:
            for x in b.marks:
                held[x] = held.get(x, 0) + b.prose
        content = set()
        for x in sorted(held):  # outer elements come first
            if plain < 0.25 * held[x]:
                content.add(x)
                plain += sum(b.prose for b in soft if set(b.marks) <= content and x in b.marks)
        for b in soft:
            b.furniture = not set(b.marks) <= content

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.step[node])
            node = self.parent[node]
        return " ".join(reversed(out))

    def find(self, path: str) -> int | None:
        """The node of a path, if the page has it."""
        node = 0
        for step in path.split(" ") if path else []:
            node = self.nodes.get((node, step))
            if node is None:
                return None
        return node

    def under(self, node: int) -> list[bool]:
        """For each node whether it is the given one or lies within."""
        out = [False] * len(self.step)
        for k in range(len(out)):  # parents come before children
            out[k] = k == node or (k > 0 and out[self.parent[k]])
        return out


def containers(page: Page) -> dict[int, float]:
    """Score of each container of a page: text that reads like prose under it, less a share for depth lost above.

    A block gives its container all of its score and each further ancestor a falling share, so that the
    nearest container that holds most of the article wins. Link text, short lines and furniture score nothing.
    """
    scores: dict[int, float] = {}
    for b in page.blocks:
        if b.furniture or not b.node:
            continue
        prose, kind, node = float(b.prose), page.step[b.node].split(".")[0], b.node
        if kind in ("li", "td", "th", "dt", "dd", "figcaption") and len(b.text) < 80:
            prose *= 0.25
        if kind in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td"):
            node = page.parent[node]
        share = 1.0
        while node > 0 and share > 1e-4:  # what is left above is less than a thousandth of the score
            words = set(re.split(r"[^a-z]+", page.step[node].lower()))
            scores[node] = scores.get(node, 0.0) + prose * share * (1.3 if words & ARTICLE else 1.0)
            share *= 0.8
            node = page.parent[node]
    return scores


def _best(page: Page, most: int) -> list[tuple[str, float]]:
    return sorted(((page.path(k), s) for k, s in sorted(containers(page).items(), key=lambda x: -x[1])[: most + 2]), key=lambda x: (-x[1], x[0]))[:most]


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_votes(page: str | None) -> list[tuple[str, float]]:
    """The page's best container paths, the best three, with their share of the best one's score."""
    scores = _best(Page(page or ""), 3)
    return [(p, s / scores[0][1]) for p, s in scores if scores[0][1] > 0]


def extract(page: str | None, paths: list[str]) -> str:
    """Main text by the first of ``paths`` that holds prose in this page, else by the page's own best container.

    Where a consensus path itself leads through an element that its names call furniture, the vote counts, not the
    names. A container with less than a tenth of the prose of the page's own best one isn't the article.
    """
    read = Page(page or "")
    own = [p for p, _ in _best(read, 1)]
    least = 0
    for path in [*own, *paths, *own]:
        node = read.find(path)
        if node is None:
            continue
        inside, above = read.under(node), set()
        while node > 0:
            above.add(node)
            node = read.parent[node]
        found = [b for b in read.blocks if inside[b.node] and (not b.furniture or all(read.names[x] == 1 and read.depth[x] in above for x in b.marks))]
        prose = sum(b.prose for b in found)
        if not least:  # the first look only measures the page's own best
            least = max(1, prose // 10)
            continue
        if prose >= least or path in own and found:
            return "\n\n".join(b.text for b in found)
    return "\n\n".join(b.text for b in read.blocks if not b.furniture)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.2, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, url, text, n_chars: the article's blocks in page order, joined by blank lines.

    Each page votes for its best containers as tag-class paths with digits generalised; the votes of a host
    are summed in Spark, and paths that at least ``share`` of its pages vote for are its consensus, best first (a
    page has three votes, so there are 3 / ``share`` at most). Every page is then extracted again by the first consensus path it has; a page with none uses its
    own best container. Null html gives an empty text; a null or relative url belongs to the host ""; equal ids
    are separate pages; an empty table gives an empty one.

    Votes are summed before any shuffle. Hosts with their paths are joined to pages by host; that side has a
    row of a few paths for each host, and AQE splits a hot host on the page side.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "html")

    def vote(batches):
        import pyarrow as pa

        tally: dict[tuple[str, str], float] = {}
        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                host = host_of(url)
                for path, s in [*page_votes(page.as_py()), ("", 1.0)]:  # the page itself is counted at the empty path
                    tally[host, path] = tally.get((host, path), 0.0) + s
            if len(tally) > 50_000:
                yield _tally(pa, tally)
                tally.clear()
        yield _tally(pa, tally)

    def _tally(pa, tally):
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in tally], pa.string()), pa.array([p for _, p in tally], pa.string()), pa.array([round(v, 6) for v in tally.values()], pa.float64())], names=["host", "path", "votes"])

    votes = pages.select(url_col, html_col).mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(28,6)")).cast("double").alias("votes"))
    count = votes.filter("path = ''").select("host", F.col("votes").alias("pages"))
    chosen = votes.filter("path <> ''").join(count, "host").filter(F.col("votes") >= share * F.col("pages"))
    best = chosen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("votes", "path")), asc=False).alias("best"))
    best = scratch.save(best.select("host", F.transform("best", lambda b: b["path"]).alias("paths")), "paths")

    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host.alias("_host")).join(best.withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left").select(id_col, url_col, html_col, "paths")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = [extract(p.as_py(), paths or []) for p, paths in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
