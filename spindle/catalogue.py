"""Queries over the engine's operators, and the SQL that gives the same rows.

Inputs that the tables don't hold (style sheets, sitemaps, request outcomes, ...) are derived from them by
projections that both engines evaluate alike; the SQL repeats the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import css, fixed, urls
from spindle.operators import markup
from spindle.plans import control, crawl, events, pipeline, requests, stages
from spindle.sources import files, mounts

c = F.col
CFG = stages.CrawlConfig()
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared SQL fragments -------------------------------------------------------------------------------------
ESC = """regexp_replace({0}, '(?i)%3A|%2A|%3F|%22|%3C|%3E|%7C|%26|[:*?"<>|&]', '_', 'g')"""
HOST = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)', 1))"
PATH = "CASE WHEN regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1) END"
FULL = f"({HOST} || {ESC.format('regexp_replace(' + PATH + ''', '/+', '/', 'g')''')})"
SAVE = f"(CASE WHEN {FULL} LIKE '%.html' THEN {FULL} WHEN {FULL} LIKE '%/' THEN {FULL} || 'index.html' WHEN {FULL} LIKE '%.htm' THEN {FULL} || 'l' ELSE {FULL} || '.html' END)"
ROOT = "regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
LINKS = r"""
x AS (SELECT page_id, url AS ref_url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ls FROM pages),
l AS (SELECT page_id, ref_url, (i - 1)::INT AS ordinal, ls[i] AS raw_url FROM x, unnest(range(1, len(ls) + 1)) AS t(i))"""
REL = """(CASE WHEN save_path = ref_save_path THEN '' ELSE repeat('../', (len(dirs) - shared)::INT) || array_to_string(down[shared + 1:], '/') END || regexp_extract(url_h, '(#.*)$', 1))"""
RELATIVE = """
r AS (SELECT *, string_split(ref_save_path, '/')[1:-2] AS dirs, string_split(save_path, '/') AS down FROM s),
q AS (SELECT *, coalesce(nullif(list_position(list_transform(dirs, lambda v, i: coalesce(v = down[i] AND i < len(down), false)), false), 0) - 1, len(dirs))::INT AS shared FROM r)"""


def page_links(spark, sf_dir):
    """Links of all pages with their page as parent."""
    pages = table(spark, sf_dir, "pages")
    found = markup.extract_links(pages)
    return found.withColumnRenamed("url", "ref_url").withColumn("ref_save_path", urls.save_path(c("ref_url"), F.lit(fixed.HTML))).withColumn("depth", F.lit(1))


@query(f"WITH {LINKS} SELECT page_id, ref_url, ordinal, raw_url, 'a' AS tag, 'href' AS attr, 2::INT AS type FROM l")
def links_extract(spark, sf_dir):
    return markup.extract_links(table(spark, sf_dir, "pages")).select("page_id", c("url").alias("ref_url"), "ordinal", "raw_url", "tag", "attr", "type")


@query(f"""WITH {LINKS}, s AS (SELECT *, {ROOT.format('ref_url')} || raw_url AS url_h, {SAVE.format('ref_url')} AS ref_save_path, {SAVE.format('(' + ROOT.format('ref_url') + ' || raw_url)')} AS save_path FROM l), {RELATIVE}
SELECT page_id, ordinal, raw_url, url_h AS url, 2::INT AS type, save_path, {REL} AS replace_path, regexp_replace(url_h, '[?#].*$', '') AS key FROM q""")
def site_links(spark, sf_dir):
    """Extract, filter, type, resolve, name, relate: the whole chain for every link."""
    rows = stages.create_resources(page_links(spark, sf_dir), CFG)
    return rows.select("page_id", "ordinal", "raw_url", "url", "type", "save_path", "replace_path", urls.dedupe_key(c("url")).alias("key"))


DERIVED_LINK = "CASE p_partkey % 8 WHEN 0 THEN concat('mailto:a', p_partkey) WHEN 1 THEN concat('#s', p_partkey) WHEN 2 THEN concat('https://h', p_partkey % 5, '.org/x.css?v=', p_partkey) WHEN 3 THEN concat('img/', p_partkey, '.PNG#t') WHEN 4 THEN concat('//cdn.org:81/a/', p_partkey, '.svg') WHEN 5 THEN concat('JavaScript:x', p_partkey) WHEN 6 THEN concat('http://a.org/sitemaps/', p_partkey, '/sitemap.xml') ELSE concat('/d/', p_partkey, '?q=1') END"


@query(f"SELECT p_partkey, {DERIVED_LINK} AS link, NOT (({DERIVED_LINK}) LIKE '#%') AND NOT regexp_matches({DERIVED_LINK}, '^(mailto|javascript|ftp|tel|data):') AS followed FROM part")
def links_skip(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{DERIVED_LINK} AS link").withColumn("followed", urls.is_followed(c("link")))


@query(f"""WITH l AS (SELECT p_partkey, {DERIVED_LINK} AS link FROM part), e AS (SELECT *, lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(link, '#[^#]*$', ''), '[?][^?]*$', ''), '([^/]*)$', 1), '[.]([^.]*)$', 1)) AS ext FROM l)
SELECT p_partkey, link, ext, (CASE WHEN link LIKE '%/sitemaps/%' AND (link LIKE '%sitemap.xml' OR link LIKE '%sitemap_other.xml') THEN 5 WHEN ext IN ({', '.join(f"'{x}'" for x in fixed.BINARY_EXTENSIONS)}) THEN 1 WHEN ext = 'css' THEN 3 WHEN ext = 'svg' THEN 6 ELSE 2 END)::INT AS type FROM e""")
def type_detect(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{DERIVED_LINK} AS link")
    return d.select("p_partkey", "link", urls.extension(c("link")).alias("ext"), urls.detect_type(c("link"), F.lit(fixed.HTML)).alias("type"))


RAW = "CASE page_id % 5 WHEN 0 THEN '/a/b?x=1#y' WHEN 1 THEN '//other.org/z' WHEN 2 THEN 'https://abs.org/p/' WHEN 3 THEN '#top' ELSE '?n=2' END"


@query(f"""WITH l AS (SELECT page_id, url AS ref_url, {RAW} AS raw_url FROM pages)
SELECT page_id, raw_url, CASE WHEN raw_url LIKE '//%' THEN regexp_extract(ref_url, '^([a-z]+:)', 1) || raw_url WHEN raw_url LIKE '/%' THEN {ROOT.format('ref_url')} || raw_url WHEN raw_url LIKE '#%' THEN regexp_replace(ref_url, '#.*$', '') || raw_url WHEN raw_url LIKE '?%' THEN regexp_replace(ref_url, '[?#].*$', '') || raw_url ELSE raw_url END AS url FROM l""")
def url_resolve(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url AS ref_url", f"{RAW} AS raw_url").select("page_id", "raw_url", urls.resolve(c("raw_url"), c("ref_url")).alias("url"))


@query(f"SELECT page_id, {SAVE.format('url')} AS save_path FROM pages")
def save_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.save_path(c("url"), F.lit(fixed.HTML)).alias("save_path"))


@query(f"""WITH a AS (SELECT page_id, {SAVE.format('url')} AS base, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS search FROM pages),
b AS (SELECT *, list_filter(string_split(search[2:], '&'), lambda v: v <> '') AS parts FROM a),
o AS (SELECT *, CASE WHEN len(parts) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform(parts, lambda v, i: struct_pack(k := CASE WHEN regexp_matches(v, '^[^=]+=') THEN regexp_extract(v, '^([^=]*)=', 1) ELSE v END, i := i, v := CASE WHEN regexp_matches(v, '^[^=]+=') THEN v ELSE v || '=' END))), lambda s: s.v), '&') ELSE '' END AS ordered FROM b),
h AS (SELECT *, CASE WHEN length(search) > 43 THEN '_' || rtrim(translate(to_base64(from_hex(sha256(ordered))), '+/', '-_'), '=') ELSE {ESC.format('ordered')} END AS suffix, regexp_extract(base, '[^/]([.][^./]*)$', 1) AS ext FROM o)
SELECT page_id, CASE WHEN length(search) > 1 THEN base[1:length(base) - length(ext)] || suffix || ext ELSE base END AS save_path FROM h""")
def save_path_keep_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.save_path(c("url"), F.lit(fixed.HTML), keep_search=True).alias("save_path"))


@query("SELECT regexp_replace(url, '[?#].*$', '') AS key, count(*)::BIGINT AS n, min(page_id)::BIGINT AS first_page FROM pages GROUP BY 1")
def frontier_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", urls.dedupe_key(c("url")).alias("key"))
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
e AS (SELECT (o_orderkey % n)::BIGINT AS src, (o_custkey * 7 % n)::BIGINT AS dst FROM orders, n),
b AS (SELECT 0::BIGINT AS key, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.key WHERE b.depth < 3)
SELECT key, min(depth)::INT AS depth FROM b GROUP BY key""")
def crawl_bfs(spark, sf_dir):
    """Least depth of each page over a link graph dealt from orders (links of the pages themselves rarely hit the corpus)."""
    n = table(spark, sf_dir, "pages").count()
    edges = table(spark, sf_dir, "orders").select((c("o_orderkey") % n).cast("bigint").alias("src"), (c("o_custkey") * 7 % n).cast("bigint").alias("dst")).distinct()
    save = crawl.saver(spark, crawl.shared_folder(spark))
    return crawl.bfs(save(edges.repartition("src")), spark.range(1).select(c("id").alias("key")), 3, save)


STYLE = """concat('@import "base', p_partkey % 3, '.css"; .p{background:url("/img/', p_partkey % 7, '.png")} .q{src:url(f', p_partkey, '.woff) , url(data:x,y)}')"""


@query("""SELECT p_partkey, concat('base', p_partkey % 3, '.css') AS u0, concat('/img/', p_partkey % 7, '.png') AS u1, concat('f', p_partkey, '.woff') AS u2, 3::INT AS n FROM part""")
def css_urls(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{STYLE} AS css").select("p_partkey", css.css_urls(c("css")).alias("u"))
    return d.select("p_partkey", *[F.get("u", i).alias(f"u{i}") for i in range(3)], F.size("u").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('/go/', p_partkey) WHEN 1 THEN 'b.html' END AS target FROM part")
def meta_refresh(spark, sf_dir):
    content = "CASE p_partkey % 3 WHEN 0 THEN concat('0; url=/go/', p_partkey) WHEN 1 THEN ' 5 ; URL=\"b.html\" ' ELSE '7' END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{content} AS content").select("p_partkey", urls.meta_refresh(c("content")).alias("target"))


@query("SELECT s_suppkey, concat('http://h/', s_suppkey + i) AS loc FROM supplier, unnest([0, 1]) AS t(i)")
def sitemap_urls(spark, sf_dir):
    xml = "concat('<urlset xmlns=\"x\"><url><loc> http://h/', s_suppkey, ' </loc></url><url><loc>http://h/', s_suppkey + 1, '</loc></url><url><loc>http://h/', s_suppkey, '</loc></url></urlset>')"
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{xml} AS xml").select("s_suppkey", F.explode(markup.sitemap_urls(c("xml"))).alias("loc"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN concat('m', s_suppkey, '.map') WHEN 1 THEN 'x.map' END AS map_url FROM supplier")
def source_map(spark, sf_dir):
    body = "CASE s_suppkey % 3 WHEN 0 THEN concat('var a;\n//# sourceMappingURL=m', s_suppkey, '.map\n') WHEN 1 THEN 'a{}/*# sourceMappingURL=x.map */' ELSE 'none' END"
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{body} AS body").select("s_suppkey", F.get(urls.source_map_urls(c("body")), 0).alias("map_url"))


@query("SELECT s_suppkey, concat('a', s_suppkey, '.png') AS raw_url, 1::INT AS type FROM supplier UNION ALL SELECT s_suppkey, 'b.png', 1 FROM supplier")
def srcset_links(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'http://h/' AS url", "concat('<img srcset=\"a', s_suppkey, '.png 1x, b.png 2x\">') AS html")
    return markup.extract_links(d, "s_suppkey").select("s_suppkey", "raw_url", "type")


@query("SELECT s_suppkey, concat('#g', s_suppkey) AS raw_url FROM supplier UNION ALL SELECT s_suppkey, 'i.png' FROM supplier")
def svg_links(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'http://h/' AS url", "concat('<svg><use xlink:href=\"#g', s_suppkey, '\"/><image href=\"i.png\"/></svg>') AS html")
    return markup.extract_links(d, "s_suppkey", svg=True).select("s_suppkey", "raw_url")


@query("SELECT s_suppkey, concat('n', s_suppkey, '.html') AS raw_url FROM supplier")
def iframe_srcdoc(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'http://h/' AS url", "concat('<iframe srcdoc=\"<a href=n', s_suppkey, '.html>x</a>\"></iframe>') AS html")
    return markup.extract_links(d, "s_suppkey").select("s_suppkey", "raw_url")


@query("SELECT page_id, NOT contains(html, '</html>') AS incomplete FROM pages")
def incomplete_html(spark, sf_dir):
    return stages.incomplete_html(table(spark, sf_dir, "pages")).select("page_id", "incomplete")


MOUNTS = [("/srv/a", "https://blog.tionble.example.com/", 0), ("/srv/b", "https://blog.tionble.example.com/en/", 0), ("/srv/c", "https://blog.tionble.example.com/fr/", 5), ("/srv/d", "https://blog.tionble.example.com/", 0)]
MOUNTS += [(f"/srv/{k}{i}", f"{s}://{h}/{p}", q) for k, (s, h) in enumerate((s, h) for s in ("http", "https") for h in ("blog.tionsh.example.net", "tionsh.example.net", "www.tionble.example.com", "tionble.example.com")) for i, (p, q) in enumerate((("", 1), ("en/", 1), ("es/", 0)))]
_M = ", ".join(f"({i}, '{r}', '{p.split('://')[0]}://{p.split('/')[2]}', '/{p.split('/', 3)[3]}', {q})" for i, (r, p, q) in enumerate(MOUNTS))


@query(f"""WITH m(mount_id, root, origin, prefix, priority) AS (VALUES {_M}), p AS (SELECT page_id, url, lower({ROOT.format('url')}) AS o, {PATH.format('url')} AS path FROM pages),
j AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, length(prefix) DESC, mount_id) AS rn FROM p JOIN m ON o = origin AND starts_with(path, prefix))
SELECT page_id, mount_id::INT AS mount_id, root, path[length(prefix) + 1:] AS rest FROM j WHERE rn = 1""")
def mount_route(spark, sf_dir):
    dim = spark.createDataFrame([tuple(m.values()) for m in mounts.check_mounts([{"root": r, "url_prefix": p, "priority": q} for r, p, q in MOUNTS])], "mount_id int, root string, origin string, prefix string, priority int")
    return mounts.route(table(spark, sf_dir, "pages").select("page_id", "url"), dim).select("page_id", "mount_id", "root", "rest")


@query(f"""WITH p AS (SELECT page_id, ltrim({PATH.format('url')}, '/') AS rest FROM pages), b AS (SELECT *, regexp_replace(rest, '/$', '') AS base FROM p)
SELECT page_id, array_to_string(list_concat(CASE WHEN rest LIKE '%/' OR rest = '' THEN [] ELSE [base] END, CASE WHEN rest LIKE '%/' OR rest = '' OR NOT regexp_matches(base, '[^/][.][^./]*$') THEN list_concat([base || CASE WHEN base = '' THEN '' ELSE '/' END || 'index.html', base || CASE WHEN base = '' THEN '' ELSE '/' END || 'index.htm'], CASE WHEN base = '' THEN [] ELSE [base || '.html', base || '.htm'] END) ELSE [] END), ' ') AS tried FROM b""")
def mount_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.ltrim(urls.raw_path(c("url")), F.lit("/")).alias("rest"))
    return d.select("page_id", F.array_join(mounts.candidates(c("rest"), F.lit(fixed.HTML), F.lit("")), " ").alias("tried"))


EXISTING = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'skipSave' WHEN 2 THEN 'overwrite' ELSE 'ifModifiedSince' END AS action",
    "CASE WHEN o_custkey % 2 = 0 THEN 'download' ELSE 'saveToDisk' END AS stage",
    "o_custkey % 5 <> 0 AS is_file",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS remote",
)


@query(f"""WITH e AS (SELECT o_orderkey, {', '.join(EXISTING)} FROM orders)
SELECT o_orderkey, CASE WHEN NOT is_file THEN true WHEN stage = 'download' THEN action <> 'skip' WHEN action IN ('skip', 'skipSave') THEN false WHEN action = 'ifModifiedSince' THEN coalesce(remote > TIMESTAMP '1995-06-01', true) ELSE true END AS proceed FROM e""")
def existing_policy(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *EXISTING)
    return d.select("o_orderkey", mounts.existing_decision(c("action"), c("stage"), c("is_file"), F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'"), c("remote")).alias("proceed"))


@query("""SELECT p_partkey, concat('<html lang="en">', chr(10), '<head>', chr(10), '<meta charset="utf8">', chr(10), '<meta http-equiv="refresh" content="0; url=../it''s/', p_partkey, '.html">', chr(10), '<script>location.replace(''../it\\''s/', p_partkey, '.html'' + location.hash);</script>', chr(10), '<title>Redirecting</title>', chr(10), '</head>', chr(10), '</html>') AS page FROM part""")
def redirect_placeholder(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.redirect_page(F.concat(F.lit("../it's/"), c("p_partkey"), F.lit(".html"))).alias("page"))




@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 6 + 1)::BIGINT AS attempt, CASE WHEN o_custkey % 4 = 0 THEN 429 WHEN o_custkey % 4 = 1 THEN 503 ELSE 404 END AS status, CASE WHEN o_custkey % 3 = 0 THEN '30' WHEN o_custkey % 3 = 1 THEN '90' END AS retry_after, (o_orderkey % 8) / 8.0::DOUBLE AS rand FROM orders),
b AS (SELECT *, 2000 * (attempt - 1) + rand * 200 + CASE WHEN attempt > 2 THEN 1000 ELSE 0 END AS b0 FROM r), k AS (SELECT *, CASE WHEN b0 > 5000 THEN 5000 + (rand - 0.5::DOUBLE) * 1000 ELSE b0 END AS base FROM b)
SELECT o_orderkey, (CASE WHEN attempt > 5 OR status = 404 THEN 0 WHEN status = 429 THEN CASE WHEN retry_after = '30' THEN 30000 ELSE floor(base + 3000 + rand * 3000) END ELSE floor(base) END)::BIGINT AS delay_ms FROM k""")
def retry_delay(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 6 + 1 AS attempt", "CASE WHEN o_custkey % 4 = 0 THEN 429 WHEN o_custkey % 4 = 1 THEN 503 ELSE 404 END AS status", "CASE WHEN o_custkey % 3 = 0 THEN '30' WHEN o_custkey % 3 = 1 THEN '90' END AS retry_after", "(o_orderkey % 8) / 8.0D AS rand")
    delay = control.retry_delay(c("attempt"), c("status"), F.lit("HTTPError"), F.lit(None).cast("string"), F.lit("GET"), c("retry_after"), c("rand"), F.lit("2024-01-01").cast("timestamp"), limit=5)
    return d.select("o_orderkey", delay.alias("delay_ms"))


@query("""WITH p AS (SELECT (epoch_us(ts) // 60000000)::BIGINT AS period, count(*)::BIGINT AS n FROM events GROUP BY 1),
q AS (SELECT *, lag(n) OVER (ORDER BY period) AS last, first_value(n) OVER (ORDER BY period) AS fst, row_number() OVER (ORDER BY period) AS i FROM p),
d AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE (CASE WHEN n < 2 THEN 8 WHEN n < last >> 1 THEN 4 ELSE 0 END) + (CASE WHEN n < fst >> 2 THEN 2 ELSE 0 END) - (CASE WHEN n > last * 4 THEN 4 WHEN n > last * 2 OR n > fst THEN 2 ELSE 0 END) END::BIGINT AS delta FROM q),
s AS (SELECT *, sum(delta) OVER (ORDER BY period)::BIGINT AS s FROM d)
SELECT period, n, delta, CASE WHEN i = 1 THEN 12 ELSE greatest(12 + s, 4 + s - min(CASE WHEN i > 1 THEN s END) OVER (ORDER BY period)) END::BIGINT AS concurrency FROM s""")
def concurrency_controller(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_micros(c("ts").cast("timestamp")) / 60_000_000).alias("period")).agg(F.count(F.lit(1)).alias("n")).withColumn("queued", F.lit(1))
    return control.concurrency(p).select("period", "n", "delta", "concurrency")


@query("""WITH w AS (SELECT c_nationkey::BIGINT AS pool, c_custkey AS worker, (c_custkey * 7 % 13)::BIGINT AS load FROM customer), t AS (SELECT pool, max(load) + 40 AS top FROM w GROUP BY pool),
s AS (SELECT w.*, unnest(range(load, top)) AS level FROM w JOIN t USING (pool)), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY level, load, worker) AS rn FROM s), k AS (SELECT pool, worker, count(*) AS n FROM r WHERE rn <= 40 GROUP BY ALL)
SELECT w.pool, w.worker, w.load, coalesce(k.n, 0)::BIGINT AS assigned FROM w LEFT JOIN k USING (pool, worker)""")
def water_fill(spark, sf_dir):
    w = table(spark, sf_dir, "customer").selectExpr("bigint(c_nationkey) AS pool", "c_custkey AS worker", "bigint(c_custkey * 7 % 13) AS load")
    return control.water_fill(w, 40).select("pool", "worker", "load", "assigned")


STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'download' WHEN 1 THEN 'saveToDisk' WHEN 2 THEN 'error' WHEN 3 THEN 'processAfterDownload' ELSE 'dispose' END"


@query(f"""WITH s AS (SELECT {STATUS} AS status, CASE WHEN o_custkey % 2 = 0 THEN 404 ELSE 500 END AS code FROM orders)
SELECT category, count(*)::BIGINT AS n FROM (SELECT CASE WHEN status = 'download' THEN 'skip.debug' WHEN status IN ('processAfterDownload', 'saveToDisk') THEN 'skip.warn' WHEN status = 'error' THEN CASE WHEN code = 404 THEN 'notFound.error' ELSE 'error.error' END END AS category FROM s) GROUP BY category""")
def status_counts(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr(f"{STATUS} AS status", "CASE WHEN o_custkey % 2 = 0 THEN 404 ELSE 500 END AS code")
    return d.select(control.status_category(c("status"), F.lit("HTTPError"), c("code"), F.lit("fetch")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINKS} SELECT {HOST.format('ref_url')} AS host, count(*)::BIGINT AS links, count(DISTINCT page_id)::BIGINT AS pages, count(DISTINCT raw_url)::BIGINT AS targets FROM l GROUP BY 1")
def host_summary(spark, sf_dir):
    d = markup.extract_links(table(spark, sf_dir, "pages")).withColumn("host", urls.hostname(c("url")))
    return d.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"), F.countDistinct("raw_url").alias("targets"))


@query(f"WITH {LINKS} SELECT {ROOT.format('ref_url')} || raw_url AS url, count(*)::BIGINT AS in_degree FROM l GROUP BY 1")
def link_graph_degree(spark, sf_dir):
    return stages.create_resources(page_links(spark, sf_dir), CFG).groupBy("url").agg(F.count(F.lit(1)).alias("in_degree"))


@query(f"""WITH {LINKS}, s AS (SELECT *, {ROOT.format('ref_url')} || raw_url AS url_h, {SAVE.format('ref_url')} AS ref_save_path, {SAVE.format('(' + ROOT.format('ref_url') + ' || raw_url)')} AS save_path FROM l), {RELATIVE},
n AS (SELECT page_id, list(CASE WHEN {REL} = '' THEN raw_url ELSE replace({REL}, '&', '&amp;') END ORDER BY ordinal) AS new FROM q GROUP BY page_id),
p AS (SELECT page_id, string_split_regex(html, '<a href="[^"]*"') AS cut FROM pages)
SELECT page_id, sha256(array_to_string(list_transform(range(1, len(cut) + 1), lambda i: cut[i] || CASE WHEN i < len(cut) THEN '<a href="' || new[i] || '"' ELSE '' END), '')) AS html_sha256 FROM p LEFT JOIN n USING (page_id)""")
def rewrite_html(spark, sf_dir):
    """Every page with its links pointing at saved copies."""
    return markup.rewrite_site(table(spark, sf_dir, "pages")).select("page_id", F.sha2(c("html"), 256).alias("html_sha256"))


KEY = "regexp_replace({0}, '[?#].*$', '')"


@query(f"""WITH {LINKS}, f AS (SELECT {KEY.format('url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
t AS (SELECT DISTINCT {KEY.format(ROOT.format('ref_url') + ' || raw_url')} AS key FROM l JOIN f USING (page_id)),
k AS (SELECT key, 0 AS depth FROM f UNION ALL SELECT key, 1 FROM t WHERE key NOT IN (SELECT key FROM f))
SELECT key, depth::INT AS depth, page_id::BIGINT AS page_id FROM k LEFT JOIN f USING (key)""")
def crawl_site(spark, sf_dir):
    """A crawl of one level from every page of the corpus: pages that share a key are asked for once."""
    pages = table(spark, sf_dir, "pages")
    return crawl.crawl(spark, pages.select("url"), pages, CFG, crawl.shared_folder(spark)).select("key", "depth", "page_id")


@query(f"SELECT {SAVE.format('url')} AS path, CASE WHEN page_id % 3 <> 0 THEN octet_length(encode(html))::BIGINT END AS size, 1445412480::BIGINT AS modified FROM pages UNION ALL SELECT concat('moved/', page_id, '.html'), octet_length(encode(html))::BIGINT, 1445412480 FROM pages WHERE page_id % 3 = 0")
def save_outputs(spark, sf_dir):
    """Files to write: a third of the pages were redirected and leave a page that sends visitors on (size null here)."""
    d = table(spark, sf_dir, "pages").select("page_id", urls.save_path(c("url"), F.lit(fixed.HTML)).alias("save_path"), F.lit(fixed.HTML).alias("type"), c("html").alias("body"), F.when(c("page_id") % 3 == 0, F.concat(F.lit("moved/"), c("page_id"), F.lit(".html"))).alias("redirected_save_path"), F.lit("Wed, 21 Oct 2015 07:28:00 GMT").alias("last_modified"))
    return files.outputs(d).select("path", F.when(~c("content").contains("<title>Redirecting</title>"), F.octet_length("content")).cast("bigint").alias("size"), "modified")


# --- one query for each operator that the ones above only use in part ---------------------------------------------------
@query(f"""WITH {LINKS}, s AS (SELECT *, {ROOT.format('ref_url')} || raw_url AS url_h, {SAVE.format('ref_url')} AS ref_save_path, {SAVE.format('(' + ROOT.format('ref_url') + ' || raw_url)')} AS save_path FROM l), {RELATIVE}
SELECT page_id, ordinal, {REL} AS replace_path FROM q""")
def replace_path(spark, sf_dir):
    d = page_links(spark, sf_dir).withColumn("full", urls.resolve(c("raw_url"), c("ref_url")))
    return d.select("page_id", "ordinal", urls.tidy_replacement(urls.relative_path(urls.save_path(c("full"), c("type")), c("ref_save_path"), c("full"))).alias("replace_path"))


@query(f"SELECT page_id, {KEY.format('url')} AS key, regexp_replace(url, '#.*$', '') AS with_search FROM pages")
def dedupe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.dedupe_key(c("url")).alias("key"), urls.dedupe_key(c("url"), False).alias("with_search"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS download_link FROM pages")
def download_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.download_link(c("url")).alias("download_link"))


@query("SELECT p_partkey, concat('@import \"new.css\"; /* url(a.png) */ .p{background:url(b', p_partkey, '.png)} .q{src:url( new.woff )} .r{x:url(a.png?v=1)}') AS css, concat('a.css b', p_partkey, '.png f.woff a.png?v=1') AS found FROM part")
def css_rewrite(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('@import \"a.css\"; /* url(a.png) */ .p{background:url(b', p_partkey, '.png)} .q{src:url( f.woff )} .r{x:url(a.png?v=1)}') AS text")
    new = F.create_map(*[F.lit(x) for x in ("a.css", "new.css", "f.woff", "new.woff", "a.png", "no", "a.png?v=1", "")])
    return d.select("p_partkey", css.css_rewrite(c("text"), new).alias("css"), F.array_join(css.css_urls_distinct(c("text")), " ").alias("found"))


@query("SELECT p_partkey, concat('/a%20b/', p_partkey, '%20c/%252F?q=%C3%A9&r=%25') AS link, concat('/x%', p_partkey % 10, 'z') AS bad FROM part")
def encode_uri(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('/a b/', p_partkey, '%20c/%2F?q=é&r=%25') AS l", "concat('/x%', p_partkey % 10, 'z') AS b")
    return d.select("p_partkey", urls.normal_uri(c("l")).alias("link"), urls.normal_uri(c("b")).alias("bad"))


@query("SELECT p_partkey, concat('é', p_partkey) AS text FROM part")
def decode_body(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN encode(concat('é', p_partkey), 'ISO-8859-1') WHEN 1 THEN encode(concat('é', p_partkey), 'UTF-16LE') ELSE encode(concat('é', p_partkey), 'UTF-8') END AS body", "CASE p_partkey % 4 WHEN 0 THEN 'latin1' WHEN 2 THEN 'utf8' END AS own", "CASE p_partkey % 4 WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'latin1' END AS given")
    return d.select("p_partkey", urls.decoded(c("body"), c("own"), c("given")).alias("text"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'h.map' WHEN 1 THEN concat('long', s_suppkey, '.map') WHEN 2 THEN '#x' END AS found,
CASE s_suppkey % 4 WHEN 1 THEN concat('var a;//# sourceMappingURL=', rpad('m.map', length(concat('long', s_suppkey, '.map'))::INT, ' '), ';') WHEN 2 THEN 'a//# sourceMappingURL=#x' ELSE 'var a;' END AS body FROM supplier""")
def source_map_rewrite(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN map('SourceMap', 'h.map') ELSE map('x', 'y') END AS headers", "CASE s_suppkey % 4 WHEN 1 THEN concat('var a;//# sourceMappingURL=long', s_suppkey, '.map ;') WHEN 2 THEN 'a//# sourceMappingURL=#x' ELSE 'var a;' END AS text")
    d = d.withColumn("found", F.get(urls.source_map_of(c("headers"), c("text")), 0))
    body = urls.rewrite_source_map(c("text"), F.coalesce("found", F.lit("none")), F.lit("m.map"), keep_length=True)
    return d.select("s_suppkey", "found", F.replace(body, F.lit(" ;"), F.lit(";")).alias("body"))


@query(f"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 304 ELSE 200 END AS code, CASE WHEN page_id % 3 = 0 THEN {ROOT.format('url')} || '/moved/' || page_id || '.html' ELSE url END AS went FROM pages)
SELECT page_id, CASE WHEN went <> url THEN went END AS redirected_url, CASE WHEN went <> url THEN {SAVE.format('went')} END AS redirected_save_path FROM p WHERE code <> 304""")
def redirects(spark, sf_dir):
    """Responses: unchanged pages are dropped; redirected ones go through the stages once more."""
    d = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{fixed.HTML} AS type", "CASE WHEN page_id % 5 = 0 THEN 304 ELSE 200 END AS status_code", "html AS body")
    d = d.withColumn("response_url", F.when(c("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/moved/"), c("page_id"), F.lit(".html"))).otherwise(c("url"))).withColumn("save_path", urls.save_path(c("url"), c("type")))
    return requests.follow_redirects(requests.respond(d, CFG), CFG, "page_id").select("page_id", "redirected_url", "redirected_save_path")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS warned, CASE WHEN o_custkey % 3 = 0 THEN 200 * (o_orderkey % 30) WHEN o_custkey % 3 = 1 AND o_custkey % 2 = 0 THEN 300 * (o_orderkey % 30) END::BIGINT * CASE WHEN o_orderkey % 30 <= 25 THEN 1 END AS wait_ms, CASE WHEN o_custkey % 2 = 0 THEN 'append' WHEN o_orderkey % 2 = 0 THEN 'restart' ELSE 'replace' END AS how FROM orders")
def request_outcomes(spark, sf_dir):
    """Non-HTML warnings, the outer retry loop, and how a broken download goes on."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CASE o_orderkey % 4 WHEN 0 THEN array('text/html; charset=utf-8') WHEN 1 THEN array('image/png', 'text/plain') WHEN 2 THEN array('image/png', 'application/xhtml+xml') ELSE array() END AS kinds")
    name = F.when(c("o_custkey") % 3 == 1, "RequestError").when(c("o_custkey") % 3 == 2, "HTTPError")
    wait = requests.manual_wait(c("o_orderkey") % 30, F.lit(0), name, F.lit(""), F.when(c("o_custkey") % 2 == 0, "ETIMEDOUT").otherwise("EOTHER"))
    how = requests.resume(F.lit(10), F.lit("bytes"), F.when(c("o_custkey") % 2 == 0, 206).when(c("o_orderkey") % 2 == 0, 416).otherwise(200), F.lit("bytes 10-99/100"))
    return d.select("o_orderkey", requests.not_html(c("kinds").cast("array<string>")).alias("warned"), wait.alias("wait_ms"), how.alias("how"))


@query(f"""WITH s AS (SELECT o_orderkey % 3 AS k, {STATUS} AS status, (o_orderkey % 4)::BIGINT AS attempt FROM orders)
SELECT type, level, count(*)::BIGINT AS n FROM (SELECT 'custom.' || status AS type, 'info' AS level FROM s WHERE status NOT IN ('error') UNION ALL SELECT 'error', 'error' FROM s WHERE status = 'error' UNION ALL SELECT 'retry', CASE WHEN attempt <= 1 THEN 'info' ELSE 'warn' END FROM s) GROUP BY 1, 2""")
def event_log(spark, sf_dir):
    """Records of statuses, errors and retries, counted by kind and level."""
    d = table(spark, sf_dir, "orders").selectExpr(f"{STATUS} AS status", "CAST(o_orderkey AS string) AS url", "o_orderkey % 4 AS attempt", "100 AS delay_ms", "'HTTPError' AS error")
    _, failed = events.handle_errors(d.filter("status = 'error'"), c("error"), c("status"))
    told = events.events(d.filter("status <> 'error'"), c("status"), F.lit("info"), c("url"))
    return events.shown(told.unionByName(failed).unionByName(events.retry_log(d))).groupBy("type", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINKS}, s AS (SELECT page_id, ordinal, raw_url, {ROOT.format('ref_url')} || raw_url AS url FROM l WHERE NOT contains(raw_url, 'a'))
SELECT page_id, ordinal, url, {HOST.format('url')} || '/own/' || ordinal AS save_path, contains(raw_url, 'e') AS discard FROM s""")
def hooks(spark, sf_dir):
    """Links with 'a' are skipped, those with 'e' aren't asked for, and all get paths of their own."""
    cfg = CFG.merged(link_redirect=(stages.skip_when(c("raw_url").contains("a")),), save_path=(pipeline.wrap_save_path(lambda d: F.concat(urls.hostname(d["_full"]), F.lit("/own/"), d["ordinal"])),), before_download=(stages.discard_when(c("raw_url").contains("e")),))
    return pipeline.Pipeline(cfg).create(page_links(spark, sf_dir)).select("page_id", "ordinal", "url", "save_path", "discard")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'hit' WHEN o_custkey % 3 = 0 THEN 'notFound' WHEN o_custkey % 3 = 1 THEN 'error' ELSE 'fallthrough' END AS status,
CASE WHEN o_custkey % 2 = 0 THEN 'skip' ELSE 'overwrite' END AS skip_existing, 'ifModifiedSince' AS prefer_newer FROM orders""")
def miss_policy(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    policy = F.when(c("o_custkey") % 3 == 0, "return404").when(c("o_custkey") % 3 == 1, "throw").otherwise("fallthrough")
    stage = F.when(c("o_custkey") % 2 == 0, "download").otherwise("saveToDisk")
    return d.select("o_orderkey", mounts.miss_status(F.when(c("o_orderkey") % 2 == 0, "x"), policy).alias("status"), mounts.preset("skipExisting", stage).alias("skip_existing"), mounts.preset("preferNewerRemote", stage).alias("prefer_newer"))


@query(f"""WITH m(mount_id, root, origin, prefix, priority) AS (VALUES {_M}), p AS (SELECT page_id, url, lower({ROOT.format('url')}) AS o, {PATH.format('url')} AS path FROM pages),
j AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, length(prefix) DESC, mount_id) AS rn FROM p JOIN m ON o = origin AND starts_with(path, prefix)),
r AS (SELECT *, path[length(prefix) + 1:] AS rest FROM j WHERE rn = 1)
SELECT page_id, CASE WHEN NOT (regexp_replace(rest, '/$', '') <> '' AND NOT contains(rest, '.') AND length(regexp_replace(rest, '/$', '')) % 2 = 0) THEN 'notFound' WHEN length(regexp_replace(rest, '/$', '')) % 4 = 0 THEN 'tooLarge' ELSE 'hit' END AS status, CASE WHEN regexp_replace(rest, '/$', '') <> '' AND NOT contains(rest, '.') AND length(regexp_replace(rest, '/$', '')) % 2 = 0 THEN root || '/' || regexp_replace(rest, '/$', '') || '.html' END AS path, CASE WHEN regexp_replace(rest, '/$', '') <> '' AND NOT contains(rest, '.') AND length(regexp_replace(rest, '/$', '')) % 2 = 0 THEN '1995-06-01T00:00:00.000Z' END AS modified FROM r""")
def mount_source(spark, sf_dir):
    """Requests answered from mounted folders: files are there for paths of even length without a dot, under their name with .html."""
    dim = spark.createDataFrame([tuple(m.values()) for m in mounts.check_mounts([{"root": r, "url_prefix": p, "priority": q} for r, p, q in MOUNTS])], "mount_id int, root string, origin string, prefix string, priority int")
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{fixed.HTML} AS type")
    have = mounts.route(pages, dim).withColumn("rest", F.regexp_replace("rest", "/$", "")).filter("rest <> '' AND NOT contains(rest, '.') AND length(rest) % 2 = 0")
    held = have.groupBy(F.concat(c("root"), F.lit("/"), c("rest"), F.lit(".html")).alias("path")).agg(F.min(F.when(F.length("rest") % 4 == 0, 1000).otherwise(10)).cast("bigint").alias("length")).selectExpr("path", "TIMESTAMP '1995-06-01 00:00:00' AS modified", "length", "CAST('x' AS binary) AS content")
    return mounts.mount_source(pages, dim, held, limit=100).select("page_id", "status", "path", c("headers")["last-modified"].alias("modified"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('d', p_partkey, '/index.html') WHEN 1 THEN concat('f', p_partkey, '.txt') END AS path, CASE p_partkey % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/plain; charset=utf-8' END AS kind FROM part")
def local_source(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    asked = d.selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('file:///srv/d', p_partkey, '/?q#h') WHEN 1 THEN concat('file:///srv/f', p_partkey, '.txt') ELSE concat('file:///srv/none', p_partkey) END AS url", f"CASE WHEN p_partkey % 3 = 0 THEN {fixed.HTML} ELSE {fixed.BINARY} END AS type")
    held = d.filter("p_partkey % 3 < 2").selectExpr("CASE p_partkey % 3 WHEN 0 THEN concat('d', p_partkey, '/index.html') ELSE concat('f', p_partkey, '.txt') END AS path", "TIMESTAMP '1995-06-01 00:00:00' AS modified", "7L AS length", "CAST('x' AS binary) AS content")
    return files.local_source(asked, held, "/srv", "p_partkey").select("p_partkey", "path", c("headers")["content-type"].alias("kind"))


@query("SELECT page_id, replace(html, '<p>', '<P>') AS body, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, 1000::BIGINT AS wait_ms, 2500::BIGINT AS download_ms FROM pages")
def user_transform(spark, sf_dir):
    """A caller's own page transform, and the columns that derive from a row."""
    d = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "html AS body", f"{fixed.HTML} AS type", "TIMESTAMP '2020-01-01 00:00:00' AS created", "TIMESTAMP '2020-01-01 00:00:01' AS begun", "TIMESTAMP '2020-01-01 00:00:03.5' AS done")
    upper = pipeline.html_transform(lambda page: page.replace("<p>", "<P>"))
    return pipeline.normalise(upper(d)).select("page_id", "body", "host", "wait_ms", "download_ms")


_RULED = [(i, *r) for i, r in enumerate(fixed.LINK_RULES) if r[2] is not None and r[2] not in ("srcset", "style") and r[0] != "*"]


@query("SELECT s_suppkey, rule_id::INT AS rule_id, concat('u', s_suppkey, '-', rule_id) AS raw_url, type::INT AS type FROM supplier, (VALUES " + ", ".join(f"({i}, {kind})" for i, _, _, _, _, kind in _RULED) + ") AS r(rule_id, type)")
def link_rules(spark, sf_dir):
    """A page for each supplier with one element for every rule that reads a plain attribute of a named element."""

    def element(i, tag, ancestor, attr, condition, kind):
        more = f' {condition[0]}="{condition[2]}"' if condition else ""
        inner = f'<{tag}{more} {attr}="u@-{i}">'
        return f"<{ancestor}>{inner}</{ancestor}>" if ancestor else inner + (f"</{tag}>" if tag in ("script", "iframe", "a", "video", "audio", "object") else "")

    page = "<html><body>" + "".join(element(*r) for r in _RULED) + "</body></html>"
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("http://h/").alias("url"), F.replace(F.lit(page), F.lit("@"), c("s_suppkey").cast("string")).alias("html"))
    return markup.extract_links(d, "s_suppkey").select("s_suppkey", "rule_id", "raw_url", "type")
