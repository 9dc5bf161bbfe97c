"""Retry delays, the concurrency controller, task water-fill and status routing as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import fixed


def retry_delay(attempt: Column, status: Column, name: Column, code: Column, method: Column, retry_after: Column, rand: Column, now: Column, limit: int = 25, max_retry_after: int | None = 60_000, methods=("GET", "PUT", "HEAD", "DELETE", "OPTIONS", "TRACE"), statuses=(408, 413, 429, 500, 502, 503, 504, 521, 522, 524)) -> Column:
    """[J1] Milliseconds until the next try, 0 for none; ``rand`` in [0, 1) and the clock are inputs."""
    eligible = method.isin(*methods) & (F.coalesce(code.isin(*fixed.RETRY_CODES), F.lit(False)) | F.coalesce(status.isin(*statuses), F.lit(False)) | F.coalesce(name.isin("ReadError", "TimeoutError"), F.lit(False)))
    base = 2000 * (attempt - 1) + rand * 200 + F.when(attempt > 2, 1000).otherwise(0)
    base = F.when(base > 5000, 5000 + (rand - 0.5) * 1000).otherwise(base)
    date = F.call_function("try_to_timestamp", F.regexp_replace(retry_after, "^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.coalesce(F.regexp_extract(retry_after, r"^\s*(-?\d+)", 1).try_cast("bigint") * 1000, F.unix_millis(date) - F.unix_millis(now))
    wait = F.when(wait < 0, F.lit(1)).otherwise(wait)
    usable = wait.isNotNull() & (F.lit(True) if not max_retry_after else wait <= max_retry_after)
    delay = F.when((name == "HTTPError") & (status == 429), F.when(usable, wait.cast("double")).otherwise(base + 3000 + rand * 3000)).otherwise(base)
    return F.when((attempt > limit) | ~eligible, F.lit(0)).otherwise(F.floor(delay)).cast("bigint")


def concurrency(periods: DataFrame, start: int = 12, least: int = 4) -> DataFrame:
    """[J3] ``periods`` (period, n, queued) with delta and concurrency after each.

    The clamped recurrence c = max(least, c + d) has the closed form max(start + S, least + S - min S over the steps so far).
    The first period with downloads only sets the standard.
    """
    w = Window.orderBy("period")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.min(F.when(F.col("n") > 0, F.col("period"))).over(run)
    df = periods.withColumn("_start", started).withColumn("_first", F.first(F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(run)).withColumn("_last", F.lag("n").over(w))
    n, first, last = F.col("n"), F.col("_first"), F.col("_last")
    delta = F.when(n < 2, 8).when(n < F.shiftright(last, 1), 4).otherwise(0) + F.when(n < F.shiftright(first, 2), 2).otherwise(0) - F.when(n > last * 4, 4).when((n > last * 2) | (n > first), 2).otherwise(0)
    active = F.col("_start").isNotNull() & (F.col("period") > F.col("_start")) & (F.col("queued") > 0)
    df = df.withColumn("delta", F.when(active, delta).otherwise(0).cast("bigint")).withColumn("_s", F.sum("delta").over(run))
    low = F.min(F.when(active, F.col("_s"))).over(run)
    return df.withColumn("concurrency", F.when(low.isNull(), F.lit(start)).otherwise(F.greatest(F.lit(start) + F.col("_s"), F.lit(least) + F.col("_s") - low)).cast("bigint")).drop("_start", "_first", "_last", "_s")


def water_fill(workers: DataFrame, pending: int, most: int = -1) -> DataFrame:
    """[J5] ``workers`` (pool, worker, load) with ``assigned``: the first ``pending`` free slots of each pool by (level, worker)."""
    top = F.lit(most) if most > 0 else F.max("load").over(Window.partitionBy("pool")) + pending
    slots = workers.withColumn("_top", top).withColumn("level", F.explode(F.when(F.col("load") < F.col("_top"), F.sequence("load", F.col("_top") - 1))))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("level", "load", "worker"))
    taken = slots.withColumn("_r", rank).filter(F.col("_r") <= pending).groupBy("pool", "worker").agg(F.count(F.lit(1)).alias("assigned"))
    return workers.join(taken, ["pool", "worker"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(0)))


def status_category(status: Column, name: Column, code: Column, cause: Column) -> Column:
    """[O2] 'category.level' of a status event; null where nothing is logged."""
    missing = name.isin("HTTPError", "LocalUrlMountNotFoundError") & (code == 404)
    return F.when(status == "download", "skip.debug").when(status.isin("processAfterDownload", "saveToDisk"), "skip.warn").when((status == "error") & (F.coalesce(cause, F.lit("")) != ""), F.when(F.coalesce(missing, F.lit(False)), "notFound.error").otherwise("error.error"))
