"""Events, errors and the job around a crawl as data."""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable
from threading import Thread

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of log records.
LOG_TYPES = ("systemInfo", "error", "retry", "request", "response", "response.error", "skip", "complete", "notFound", "mkdir")
LEVELS = ("trace", "debug", "info", "warn", "error")


def events(df: DataFrame, kind: Column, level: Column, *contents: Column) -> DataFrame:
    """[O4] A record (type, level, contents) for each row; kinds that are neither known nor custom.* become custom.*."""
    known = kind.isin(*LOG_TYPES) | kind.startswith("custom.")
    return df.select(F.when(known, kind).otherwise(F.concat(F.lit("custom."), kind)).alias("type"), F.when(level.isin(*LEVELS), level).otherwise("info").alias("level"), F.concat_ws(" ", *contents).alias("contents"))


def shown(log: DataFrame) -> DataFrame:
    """[O5] What a console shows: everything but traces."""
    return log.filter("level <> 'trace'")


def write_log(log: DataFrame, folder: str) -> None:
    """[O5] A folder for each kind of record."""
    log.write.mode("append").partitionBy("type").json(folder)


def notify(log: DataFrame, listeners) -> list[str]:
    """[O1] Every listener gets the records; what one raises is told and stops no other."""
    told = []
    for listen in listeners:
        try:
            listen(log)
        except Exception as e:  # noqa: BLE001  a listener is someone else's code
            told.append(f"{type(e).__name__}: {e}")
            logging.getLogger("spindle").warning("listener failed: %s", e)
    return told


def handle_errors(df: DataFrame, message: Column, cause: Column) -> tuple[DataFrame, DataFrame]:
    """[O3, J6a] Rows with error and error_cause as text, and the records of those that failed."""
    out = df.withColumn("error", message.cast("string")).withColumn("error_cause", cause.cast("string"))
    return out, events(out.filter("error IS NOT NULL"), F.lit("error"), F.lit("error"), F.col("error"), F.col("error_cause"))


def retry_log(df: DataFrame) -> DataFrame:
    """[J2] Records of tries (url, attempt, delay_ms, error): the first of a URL as information, later ones as warnings."""
    return events(df, F.lit("retry"), F.when(F.col("attempt") <= 1, "info").otherwise("warn"), F.col("url"), F.col("attempt").cast("string"), F.col("delay_ms").cast("string"), F.col("error"))


class Job:
    """[J6, J7] A crawl that runs beside the caller: start, stop, wait; workers, retries and lost tasks are Spark's.

    [J6b] ``group`` names its Spark jobs, so that other code can watch or cancel them.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], object], group: str = "spindle-crawl"):
        self.spark, self.work, self.group = spark, work, group
        self.result, self.error, self._thread = None, None, None

    def start(self) -> Job:
        def run():
            self.spark.sparkContext.setJobGroup(self.group, "crawl", interruptOnCancel=True)
            try:
                self.result = self.work()
            except Exception as e:  # noqa: BLE001  kept for the caller
                self.error = e

        self._thread = Thread(target=run, daemon=True)
        self._thread.start()
        return self

    @property
    def idle(self) -> bool:
        return self._thread is None or not self._thread.is_alive()

    def stop(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, seconds: float | None = None):
        """The result once idle; raises what the work raised."""
        if self._thread:
            self._thread.join(seconds)
        if self.error:
            raise self.error
        return self.result


def to_map(items, freeze: bool = False) -> dict | frozenset:
    """[C1] Membership of items, as a dictionary or frozen."""
    return frozenset(items) if freeze else dict.fromkeys(items, True)


def import_default(path: str):
    """[C3] What a module names as its ``default``, or the module."""
    module = importlib.import_module(path)
    return getattr(module, "default", module)


def pause(ms: float) -> None:
    """[C4]"""
    time.sleep(ms / 1000)


def has_own(value, name: str) -> bool:
    """[C4] Whether a dictionary or object itself has ``name``, not what it inherits."""
    return name in (value if isinstance(value, dict) else vars(value))
