"""Rewriting, scanners, outcomes and the job around a crawl, on small inputs."""

import pytest
from pyspark.sql import functions as F

from spindle.functions import css, fixed, urls
from spindle.operators import markup
from spindle.plans import crawl, events, pipeline, requests, stages
from spindle.sources import files, mounts


def _rewritten(page, new):
    return markup.splice(page, [(s, e, new[u], kind) for _, _, _, kind, _, u, s, e in markup.links(page) if u in new])


def test_nested_pages_keep_what_is_not_a_link():
    page = '<iframe srcdoc="<p>Tom &amp;amp; Ann</p><a href=one>1</a><a href=&quot;two?a=1&amp;amp;b=2&quot;>2</a>"></iframe>'
    assert [r[5] for r in markup.links(page)] == ["one", "two?a=1&b=2"]
    assert _rewritten(page, {"one": "n.html", "two?a=1&b=2": "x&y.html"}) == page.replace("one", "n.html").replace("two?a=1&amp;amp;b=2", "x&amp;amp;y.html")


def test_replacements_are_escaped_as_their_place_asks():
    assert _rewritten("<style>a{b:url(x.png)}</style>", {"x.png": "u?a=1&b=2"}) == "<style>a{b:url(u?a=1&b=2)}</style>"
    assert _rewritten('<a href="x">', {"x": 'a&"b'}) == '<a href="a&amp;&quot;b">'
    assert _rewritten("<a href=x>", {"x": "a b"}) == '<a href="a b">'


def test_css_scanner():
    found = lambda text: [u for u, _, _ in css.positions(text)]
    assert found("@import 'a.css'; @import url(b.css); @import c.css;") == ["a.css", "b.css", "c.css"]
    assert found("x{a:url( \"d e.png\" )}/* url(no) */y{b:URL('f)g.png')}z{c:url( h.png )}") == ["d e.png", "f)g.png", "h.png"]
    assert found("url() url(data:a,b) url(open @import 'x'") == []
    assert css.rewrite("/* a.png */url(a.png) url('a.png')", {"a.png": "b"}) == "/* a.png */url(b) url('b')"
    assert len(found("url(" * 20_000)) == 0


@pytest.mark.parametrize(("content", "target"), [("0; url=/a", "/a"), (" 5 ; URL = \"b.html\" ", "b.html"), ("7", None), ("3;c", "c"), ("x;url=d", None), ("1;url=''", None)])
def test_refresh_is_read_alike_in_both_ways(spark, content, target):
    place = urls.refresh_target(content)
    assert (content[slice(*place)] if place else None) == target
    assert spark.createDataFrame([(content,)], "c string").select(urls.meta_refresh(F.col("c"))).first()[0] == target


def test_encode_uri():
    assert urls.encode_uri("/é %20%2F%zz") == "/é %20%2F%zz"
    assert urls.encode_uri("/é %20%2f") == "/%C3%A9%20%20%252f"
    assert urls.encode_uri("/%FF") == "/%FF"


def test_crawl_follows_style_sheets_images_and_sitemaps(spark, tmp_path):
    site = {"http://h/": '<link rel="stylesheet" href="s.css"><a href="/i.svg">i</a><a href="/sitemaps/sitemap.xml">m</a>', "http://h/s.css": "a{b:url(font.woff)}", "http://h/i.svg": '<svg><image href="in.png"/></svg>', "http://h/sitemaps/sitemap.xml": "<urlset><url><loc>http://h/far.html</loc></url></urlset>", "http://h/far.html": "<p>far</p>"}
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(site.items())], "page_id long, url string, html string")
    out = crawl.crawl(spark, ["http://h/"], pages, stages.CrawlConfig(max_depth=2), str(tmp_path))
    got = {r["url"]: (r["depth"], r["page_id"] is not None) for r in out.collect()}
    assert got == {"http://h/": (0, True), "http://h/s.css": (1, True), "http://h/i.svg": (1, True), "http://h/sitemaps/sitemap.xml": (1, True), "http://h/font.woff": (2, False), "http://h/in.png": (2, False), "http://h/far.html": (2, True)}


def test_streams_end_at_their_sink(spark):
    df = spark.createDataFrame([("http://h/a", fixed.STREAMING, None), ("ftp://h/b", fixed.STREAMING, None), ("http://h/c", fixed.STREAMING, "own"), ("http://h/d", fixed.HTML, None)], "url string, type int, body string")
    taken = []
    rest = requests.streams(df, lambda x: taken.extend(r["url"] for r in x.collect()) or x)
    assert taken == ["http://h/a"] and [r["url"] for r in rest.collect()] == ["http://h/d"]


def test_chains(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, None, None)], "id int, x string, y string")
    assert {r["id"]: r["body"] for r in stages.first_bodies(df, "x", "y").collect()} == {1: "a", 2: "b"}
    left, told = files.save_chain(df, [(F.col("x").isNotNull(), lambda d: d.count()), (F.col("id") < 3, lambda d: d.count())])
    assert told == [1, 1] and left.count() == 1
    rows, kids = pipeline.after_chain(df, [lambda d: (d.filter("id < 3"), d.select("id")), lambda d: d])
    assert rows.count() == 2 and kids.count() == 3
    assert "id" not in pipeline.clone(df.withColumn("url", F.lit("u"))).columns


def test_seen_holds_where_pages_went(spark):
    level = spark.createDataFrame([("http://h/a", "http://h/b?x"), ("http://h/c", None)], "key string, redirected_url string")
    assert {r["key"] for r in requests.seen_keys(level, stages.CrawlConfig()).collect()} == {"http://h/a", "http://h/b", "http://h/c"}


def test_listeners_and_logs(spark, tmp_path):
    log = events.events(spark.createDataFrame([("skip", "debug", "a"), ("odd", "loud", "b")], "k string, l string, t string"), F.col("k"), F.col("l"), F.col("t"))
    assert sorted(map(tuple, log.collect())) == [("custom.odd", "info", "b"), ("skip", "debug", "a")]
    heard = []
    assert events.notify(log, [lambda _: 1 / 0, lambda x: heard.append(x.count())]) == ["ZeroDivisionError: division by zero"] and heard == [2]
    events.write_log(log, str(tmp_path / "log"))
    assert {p.name for p in (tmp_path / "log").glob("type=*")} == {"type=skip", "type=custom.odd"}


def test_job(spark):
    job = events.Job(spark, lambda: spark.range(10).count()).start()
    assert job.wait() == 10 and job.idle
    with pytest.raises(ZeroDivisionError):
        events.Job(spark, lambda: 1 / 0).start().wait()


def test_transformed_pages_are_handed_back_in_pieces(spark):
    class Made(str):
        live = 0

        def __new__(cls, text):
            Made.live += 1
            return str.__new__(cls, text)

        def __del__(self):
            Made.live -= 1

    pages = spark.range(0, 40, 1, 1).select("id", F.when(F.col("id") % 8 < 7, F.concat("id", F.repeat(F.lit("é"), 1 << 18))).alias("body"), F.when(F.col("id") == 3, fixed.CSS).otherwise(fixed.HTML).alias("type"))
    out = pipeline.html_transform(lambda page: Made(f"{Made.live} {page}"))(pages).collect()
    assert [r["id"] for r in out if r["body"] is None] == [7, 15, 23, 31, 39] and out[3]["body"].startswith("3é")
    made = [(r["id"], *r["body"].split(" ")) for r in out if r["body"] and r["id"] != 3]
    assert all(text == f"{i}" + "é" * (1 << 18) for i, _, text in made) and len(made) == 34
    assert max(int(live) for _, live, _ in made) < 6  # results that Python still held
    few = pipeline.html_transform(lambda page: None if "3" in page else "")(pages)
    assert [r["id"] for r in few.filter("body = ''").collect()] == [i for i in range(40) if i % 8 < 7 and "3" not in str(i)]
    assert few.filter("id < 0").count() == 0


def test_small_helpers():
    assert events.to_map(["a"]) == {"a": True} and events.to_map("ab", freeze=True) == {"a", "b"}
    assert events.import_default("json").dumps(1) == "1"
    assert events.has_own({"a": 1}, "a") and not events.has_own({}, "get")
    assert stages.weak_assign({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3}


def test_case_modes(spark):
    asked = spark.createDataFrame([(1, ["/r/A.html"])], "page_id int, candidates array<string>")
    held = spark.createDataFrame([("/r/a.html",)], "path string")
    found = {case: mounts.first_existing(asked, held, "page_id", case).first()["path"] for case in ("exact", "lowercase", "uppercase", "caseInsensitive")}
    assert found == {"exact": None, "lowercase": "/r/a.html", "uppercase": None, "caseInsensitive": "/r/a.html"}
