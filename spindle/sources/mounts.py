"""URL mounts and the existing-file policy as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import fixed, urls


def check_mounts(mounts: list[dict]) -> list[dict]:
    """[R3] Validates mounts (root, url_prefix, priority, ...) and fills defaults."""
    out = []
    for i, m in enumerate(mounts):
        prefix = m["url_prefix"]
        if not m["root"].startswith("/"):
            raise ValueError(f"mount root is not absolute: {m['root']}")
        if not prefix.startswith(("http://", "https://")) or "?" in prefix or "#" in prefix:
            raise ValueError(f"mount prefix must be http(s) without search and hash: {prefix}")
        rest = prefix.split("://", 1)[1]
        origin, _, path = rest.partition("/")
        out.append({"mount_id": i, "root": m["root"].rstrip("/") or "/", "origin": f"{prefix.split('://')[0]}://{origin}".lower(), "prefix": "/" + path, "priority": m.get("priority", 0)})
    return out


def route(requests: DataFrame, mounts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """[R2] The mount of each request: equal origin, prefix ending at a segment, then priority, longest prefix, first declared.

    The origin is the equi-key; the winner is one partial maximum per request, with no sort of its candidates.
    """
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), F.lower(urls.authority(F.col("url"))))
    r = requests.withColumn("_origin", origin).withColumn("_path", urls.raw_path(F.col("url")))
    p = F.col("prefix")
    fits = (F.col("_path") == F.regexp_replace(p, "/$", "")) | F.col("_path").startswith(F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))) | (F.col("_path") == p)
    joined = r.join(mounts, (F.col("_origin") == F.col("origin")) & fits)
    best = joined.groupBy(id_col, "url").agg(F.min_by(F.struct("mount_id", "root", "prefix", "_path"), F.struct(-F.col("priority"), -F.length("prefix"), F.col("mount_id"))).alias("m"))
    rest = F.regexp_replace(F.substr(F.col("m._path"), F.length("m.prefix") + 1, F.lit(1 << 30)), "^/", "")
    return best.select(id_col, "url", F.col("m.mount_id").alias("mount_id"), F.col("m.root").alias("root"), rest.alias("rest"))


def candidates(rest: Column, kind: Column, suffix: Column, names=("index.html", "index.htm"), fallbacks=(".html", ".htm")) -> Column:
    """[R4] Relative paths to try, in order and distinct: the path itself, index files, extension fallbacks."""
    slash = rest.endswith("/") | (rest == "")
    base = F.regexp_replace(rest, "/$", "")
    last = F.substring_index(base, "/", -1)
    html = (kind == fixed.HTML) & (slash | ~last.rlike(r"[^/]\.[^./]*$"))
    join = lambda name: F.when(base == "", F.lit(name)).otherwise(F.concat(base, F.lit("/" + name)))
    own = F.when(~slash, F.array(urls.with_suffix(base, suffix))).otherwise(F.array().cast("array<string>"))
    index = F.when(html, F.array(*[urls.with_suffix(join(n), suffix) for n in names])).otherwise(F.array().cast("array<string>"))
    more = F.when(html & (base != ""), F.array(*[urls.with_suffix(F.concat(base, F.lit(e)), suffix) for e in fallbacks])).otherwise(F.array().cast("array<string>"))
    return F.when(urls.unsafe_path(base), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(own, index, more)))


def first_existing(asked: DataFrame, files: DataFrame, id_col: str, case: str = "exact") -> DataFrame:
    """[R4-R6, S6] ``asked`` (id, candidates) with the first candidate among ``files`` (path), null if none."""
    fold = {"exact": lambda c: c, "lowercase": lambda c: c, "uppercase": lambda c: c, "caseInsensitive": F.lower}[case]
    want = {"lowercase": F.lower, "uppercase": F.upper}.get(case, fold)
    each = asked.select(id_col, F.posexplode("candidates").alias("_pos", "_c"))
    hits = each.join(files.select(fold(F.col("path")).alias("_f"), "path"), want(F.col("_c")) == F.col("_f")).groupBy(id_col).agg(F.min(F.struct("_pos", "path"))["path"].alias("path"))
    return asked.join(hits, id_col, "left")


def miss_status(path: Column, policy: Column) -> Column:
    """[R6]"""
    return F.when(path.isNotNull(), "hit").when(policy == "return404", "notFound").when(policy == "throw", "error").otherwise(policy)


def existing_decision(action: Column, stage: Column, is_file: Column, local_time: Column, remote_time: Column) -> Column:
    """[R8] Whether to proceed at stage 'download' or 'saveToDisk' when the target may exist."""
    exists = F.coalesce(is_file, F.lit(False))
    fresh = F.coalesce(remote_time > local_time, F.lit(True))
    return F.when(~exists, True).when(stage == "download", action != "skip").otherwise(F.when(action.isin("skip", "skipSave"), False).when(action == "ifModifiedSince", fresh).otherwise(True))


def http_date(t: Column) -> Column:
    """[R8] Value of an if-modified-since header."""
    return F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def preset(name: str, stage: Column) -> Column:
    """[R9] The action of a preset at a stage: existing files aren't asked for again, but what is asked for is written."""
    if name == "skipExisting":
        return F.when(stage == "download", F.lit("skip")).otherwise(F.lit("overwrite"))
    return F.lit({"preferNewerRemote": "ifModifiedSince", "alwaysOverwrite": "overwrite"}[name])


def mount_source(requests: DataFrame, mounts: DataFrame, files: DataFrame, id_col: str = "page_id", case: str = "exact", limit: int | None = None, policy: str = "return404") -> DataFrame:
    """[S7, R2-R7] Requests (id, url, type) answered from mounted folders.

    ``files``: (path, modified, length, content) with absolute paths. Adds status (hit, notFound, error, fall through as
    ``policy`` says, or tooLarge beyond ``limit`` bytes), path, headers and body; requests of no mount are left out.
    """
    routed = route(requests, mounts, id_col).join(requests.select(id_col, "type"), id_col)
    tried = F.transform(candidates(F.col("rest"), F.col("type"), F.lit("")), lambda x: F.concat(F.col("root"), F.lit("/"), x))
    hit = first_existing(routed.withColumn("candidates", tried), files, id_col, case).join(files.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left").drop("_p")
    large = F.col("length") > (F.lit(limit) if limit is not None else F.lit(1 << 62))
    status = F.when(large, "tooLarge").otherwise(miss_status(F.col("path"), F.lit(policy)))
    return hit.select(id_col, "url", "mount_id", "path", status.alias("status"), F.when(F.col("path").isNotNull(), hit_headers(F.col("path"), F.col("modified"), F.col("length"))).alias("headers"), F.when(status == "hit", F.col("content")).alias("body"))


def hit_headers(path: Column, modified: Column, length: Column) -> Column:
    """[S6, R7] The headers a file answers with."""
    return F.create_map(F.lit("last-modified"), F.concat(F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), F.lit("content-length"), length.cast("string"), F.lit("content-type"), urls.content_type(path))
