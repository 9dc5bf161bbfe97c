"""Local files as a source and a sink."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import fixed, urls


def local_files(spark: SparkSession, root: str) -> DataFrame:
    """[S6] (path below root, modified, length, content) of all files under ``root``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select(F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "").alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def local_source(requests: DataFrame, files: DataFrame, root: str, id_col: str) -> DataFrame:
    """[S6] Requests (id, url, type) of file: URLs below ``root``, from ``files`` (``local_files``).

    An HTML request for a folder takes its index.html or index.htm. Adds path, headers (as a server would send) and body.
    """
    from spindle.sources import mounts

    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^file://", ""), r"[?#].*$", ""), "^" + root.rstrip("/") + "/?", "")
    base = F.regexp_replace(rest, "/+$", "")
    index = F.transform(F.array(F.lit("index.html"), F.lit("index.htm")), lambda n: F.when(base == "", n).otherwise(F.concat(base, F.lit("/"), n)))
    tried = F.when(F.col("type") == fixed.HTML, F.concat(F.when(base == "", F.array().cast("array<string>")).otherwise(F.array(base)), index)).otherwise(F.array(base))
    asked = requests.filter(F.col("url").startswith("file:")).withColumn("candidates", tried)
    hit = mounts.first_existing(asked, files, id_col).join(files.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    return hit.select(id_col, "url", "path", F.when(F.col("path").isNotNull(), mounts.hit_headers(F.col("path"), F.col("modified"), F.col("length"))).alias("headers"), F.col("content").alias("body"))


def html_body(serialised: Column, body: Column) -> Column:
    """[K4] The page as rewritten, else as it came."""
    return F.coalesce(serialised, body)


def save_chain(resources: DataFrame, handlers) -> tuple[DataFrame, list[DataFrame]]:
    """[P10] Runs (rows it takes, sink) handlers in order: each row is saved by the first that takes it; returns what is left and what sinks returned."""
    told = []
    for takes, sink in handlers:
        mine = F.coalesce(takes, F.lit(False))
        told.append(sink(resources.filter(mine)))
        resources = resources.filter(~mine)
    return resources, told


def outputs(resources: DataFrame) -> DataFrame:
    """[K1-K3, P10] (path, content, modified): a file per resource, and on a redirect the body at its new path.

    HTML leaves a page at the old path that sends visitors on; any other body is written to both.
    """
    moved = F.col("redirected_save_path").isNotNull() & (F.col("redirected_save_path") != F.col("save_path"))
    link = urls.relative_path(F.col("redirected_save_path"), F.col("save_path"), F.lit(""))
    first = F.when(moved & (F.col("type") == fixed.HTML), urls.redirect_page(link)).otherwise(F.col("body"))
    files = F.when(moved, F.array(F.struct(F.col("save_path").alias("path"), first.alias("content")), F.struct(F.col("redirected_save_path").alias("path"), F.col("body").alias("content")))).otherwise(F.array(F.struct(F.col("save_path").alias("path"), F.col("body").alias("content"))))
    return resources.select(F.explode(files).alias("f"), last_modified(F.col("last_modified")).alias("modified")).select("f.path", "f.content", "modified")


def last_modified(header: Column) -> Column:
    """[K8] Seconds since the epoch of an HTTP date, null if it is none."""
    return F.unix_timestamp(F.call_function("try_to_timestamp", F.regexp_replace(header, "^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss z")))


def safe_join(root: str, path: str) -> str:
    """[K6]"""
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"path leaves the output folder: {path}")
    return full


def write_files(files: DataFrame, root: str) -> DataFrame:
    """[K5-K7] Writes rows (path, content, modified) below ``root``, which executors share; a manifest with errors comes back.

    A retried task writes the same files again. Run the manifest (an action) to write.
    """

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            errors = []
            for path, content, modified in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    full = safe_join(root, path)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as f:
                        f.write(content if isinstance(content, bytes) else (content or "").encode())
                    if modified:
                        os.utime(full, (modified, modified))
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["path", "error"])

    return files.select("path", "content", "modified").mapInArrow(run, "path string, error string")
