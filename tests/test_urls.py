"""Golden values of the URL algebra."""

import pytest
from pyspark.sql import functions as F

from spindle.functions import css, fixed, urls
from spindle.operators import markup
from spindle.plans import control, stages
from spindle.sources import files, mounts

H = "http://nodejs.cn"
# url, parent, type, keep search, save path, link from the parent
CASES = [
    (f"{H}/api/buffer.html#h", f"{H}/api/buffer/buffers_and_typedarrays.html", 2, False, "nodejs.cn/api/buffer.html", "../buffer.html#h"),
    (f"{H}/api/buffer#h", f"{H}/api/buffer/buffers_and_typedarrays.html", 2, False, "nodejs.cn/api/buffer.html", "../buffer.html#h"),
    (f"{H}/api/#h", f"{H}/api/buffer/", 2, False, "nodejs.cn/api/index.html", "../index.html#h"),
    (f"{H}/api/buffer.htm#h", f"{H}/api/buffer.htm", 2, False, "nodejs.cn/api/buffer.html", "#h"),
    ("http://nodejs.com/api/#h", f"{H}/api/", 2, False, "nodejs.com/api/index.html", "../../nodejs.com/api/index.html#h"),
    ("//nodejs.com/api/#h", "https://nodejs.cn/api/", 2, False, "nodejs.com/api/index.html", "../../nodejs.com/api/index.html#h"),
    ("/#h", "https://nodejs.com/api/", 2, False, "nodejs.com/index.html", "../index.html#h"),
    (f"{H}/api/buffer.html?page=1&a=b&page=2#aaa", f"{H}/api/buffer/buffers_and_typedarrays", 2, True, "nodejs.cn/api/buffer_a=b_page=1_page=2.html", "../buffer_a=b_page=1_page=2.html#aaa"),
    (f"{H}/api/api.css?page=1#aaa", f"{H}/api/buffer/buffers_and_typedarrays", 3, True, "nodejs.cn/api/api_page=1.css", "../api_page=1.css#aaa"),
    (f"{H}/api/?page=1" + "a" * 1000 + "#aaa", f"{H}/api/buffer/buffers_and_typedarrays", 2, True, "nodejs.cn/api/index_g6rVCvz2dtFaE2fbrIJTGyzhYtGRYC-6EJAwoGeLm-Q.html", None),
    ("http:///aaa", "https://nodejs.com/api/", 2, False, None, "../../aaa/index.html"),
    ("https://example.com/../../evil.txt", "https://example.com/", 1, False, "example.com/_/_/evil.txt", None),
    ("https://example.com/%2e%2E/evil.txt", "https://example.com/", 1, False, "example.com/_/evil.txt", None),
    ("../x/./y.png", "https://example.com/a/b/c.html", 1, False, "example.com/a/x/y.png", "../x/y.png"),
]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,ref,kind,keep,saved,link", CASES)
def test_resources(spark, raw, ref, kind, keep, saved, link):
    df = spark.createDataFrame([(raw, ref, kind, 1, 0)], "raw_url string, ref_url string, type int, depth int, ordinal int").withColumn("ref_save_path", urls.save_path(F.col("ref_url"), F.lit(2)))
    row = stages.create_resources(df, stages.CrawlConfig(keep_search=keep)).first()
    assert saved is None or row["save_path"] == saved
    assert link is None or row["replace_path"] == link


def test_bad_link_keeps_its_text(spark):
    df = spark.createDataFrame([("localhost:3000", "https://nodejs.com/api/", 2, "nodejs.com/api/index.html")], "raw_url string, ref_url string, type int, ref_save_path string")
    row = stages.create_resources(df, stages.CrawlConfig()).first()
    assert row["discard"] and row["replace_path"] == "localhost:3000"
    with pytest.raises(Exception, match="unsupported link"):
        stages.create_resources(df, stages.CrawlConfig(skip_bad_links=False)).collect()


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(urls.escape_path(F.lit('%3a*?"<>|&'))) == "_" * 8
    assert v(urls.order_search(F.lit("?q"))) == "?q=" and v(urls.order_search(F.lit("?=v"))) == "?=v="
    assert v(urls.resolve_file(F.lit("../../11"), F.lit("file:///tmp/1/1/1/1/22"), "/tmp/")) == "file:///tmp/1/1/11"
    for raw in ("11", "../../11", "/11", "//11"):
        assert v(urls.resolve_file(F.lit(raw), F.lit("file:///tmp/22"), "/tmp/")) == "file:///tmp/11"
    assert not any(v(urls.is_followed(F.lit(s + ":x"))) for s in fixed.SKIPPED_SCHEMES)
    assert all(v(urls.detect_type(F.lit(f"http://a/x.{e.upper()}?a.html#b"), F.lit(2))) == 1 for e in fixed.BINARY_EXTENSIONS)
    assert v(urls.accepts_bytes(F.lit("none,bytes"))) and not v(urls.accepts_bytes(F.lit("none, bytes")))
    assert v(urls.same_range_start(F.lit(5), F.lit("bytes 5-9/10"))) and not v(urls.same_range_start(F.lit(5), F.lit("bytes 6-9/10")))
    assert v(urls.content_type(F.lit("a/B.WOFF2"))) == "font/woff2"
    assert v(urls.unsafe_path(F.lit("/a/%2e%2e/b"))) and not v(urls.unsafe_path(F.lit("/a/b.c")))
    assert v(files.last_modified(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))) == 1445412480


def test_css():
    text = '/* url(no.png) */ @import "reset.css"; @import url(theme.css); a{background:url( \'/image.png\' )} b{src:url(data:a,b)} c{x:url(r)}'
    assert [u for u, _, _ in css.positions(text)] == ["reset.css", "theme.css", "/image.png", "r"]
    assert all(text[s:e] == u for u, s, e in css.positions(text))
    assert css.rewrite(text, {"r": "q", "theme.css": ""}) == text.replace("url(r)", "url(q)")


def test_markup():
    page = '<style>a{b:url(x.png)}</style><img srcset="a.png 1x, b.png 2x"><svg><a href="u"/></svg><a href="?a=1&amp;b=2">x</a><meta http-equiv="Refresh" content="1; url=z"><iframe srcdoc="<a href=q>"></iframe>'
    found = markup.links(page)
    assert [r[5] for r in found] == ["x.png", "a.png", "b.png", "u", "?a=1&b=2", "z", "q"]
    assert markup.splice(page, [(r[6], r[7], page[r[6] : r[7]], r[3]) for r in found if "&" not in page[r[6] : r[7]]]) == page
    assert len(fixed.LINK_RULES) == 35


def test_mounts_and_files(spark, tmp_path):
    dim = spark.createDataFrame([tuple(m.values()) for m in mounts.check_mounts([{"root": "/a", "url_prefix": "http://h/xxx/"}, {"root": "/b", "url_prefix": "http://h/", "priority": -1}])], "mount_id int, root string, origin string, prefix string, priority int")
    asked = spark.createDataFrame([(1, "http://h/xxx/a/"), (2, "http://h/xxx-other/a")], "page_id long, url string")
    assert {r["page_id"]: r["root"] for r in mounts.route(asked, dim).collect()} == {1: "/a", 2: "/b"}
    tried = value(spark, mounts.candidates(F.lit("docs/intro"), F.lit(2), F.lit("")))
    assert tried == ["docs/intro", "docs/intro/index.html", "docs/intro/index.htm", "docs/intro.html", "docs/intro.htm"]
    assert value(spark, mounts.candidates(F.lit("style.css"), F.lit(3), F.lit("_a=1"))) == ["style_a=1.css"]
    out = spark.createDataFrame([("a/b.html", "x", 1445412480), ("../../evil", "x", None)], "path string, content string, modified long")
    errors = {r["path"]: r["error"] for r in files.write_files(out, str(tmp_path)).collect()}
    assert errors["a/b.html"] is None and errors["../../evil"] and (tmp_path / "a/b.html").stat().st_mtime == 1445412480
    listed = files.local_files(spark, str(tmp_path)).select("path").collect()
    assert [r["path"] for r in listed] == ["a/b.html"]


def test_controller_matches_recurrence(spark):
    import random

    rng = random.Random(3)
    counts = [rng.randrange(0, 60) for _ in range(200)]
    rows = {r["period"]: r["concurrency"] for r in control.concurrency(spark.createDataFrame([(i, n, 1) for i, n in enumerate(counts)], "period long, n long, queued long")).collect()}
    first, current = None, 12
    for i, n in enumerate(counts):
        if first is None:
            first = n or None
        else:
            last = counts[i - 1]
            d = (8 if n < 2 else 4 if n < last >> 1 else 0) + (2 if n < first >> 2 else 0) - (4 if n > last << 2 else 2 if n > last << 1 or n > first else 0)
            current = max(4, current + d)
        assert rows[i] == current


def test_stream_keeps_each_key_once(spark, tmp_path):
    from spindle.streaming.frontier import stream_resources

    schema = "raw_url string, ref_url string, ref_save_path string, type int"
    rows = [("/a?x=1", "http://h/", "h/index.html", 2), ("/a?x=2", "http://h/", "h/index.html", 2), ("/b", "http://h/", "h/index.html", 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream_resources(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), stages.CrawlConfig()).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["key"] for r in spark.table("kept").collect()) == ["http://h/a", "http://h/b"]
