"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from spindle.llm.kernel import tidy


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spindle-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet and reads them back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.shared: list = []
        self.paths: set[str] = set()

    def share(self, value):
        """A broadcast of a value of bounded size, until ``unshare``."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def unshare(self) -> None:
        """Removes all broadcasts, on the executors as well; nothing lazy may need them any more."""
        for b in self.shared:
            b.destroy()
        self.shared = []

    def _path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """``small``: packed harder, for tables with texts."""
        path = self._path(name)
        df.write.parquet(path, compression="zstd" if small else None)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spindle_path = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int, name: str, ordered: bool = False, dealt: bool = False) -> DataFrame:
        """Deals the rows by ``key`` once, sorted by it if ``ordered``; later joins on it move only the other side.

        ``dealt``: ``df`` comes from a ``groupBy`` of ``key`` and isn't dealt again.
        """
        path = self._path(name)
        table = f"spindle_{name}_{uuid.uuid4().hex[:12]}"
        df = df if dealt else df.repartition(buckets, key)
        writer = df.write.bucketBy(buckets, key)  # sortBy sorts within each bucket
        (writer.sortBy(key) if ordered else writer).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # resolved now: the files stay, and no name is left in the catalogue
        self.spark.sql(f"DROP TABLE {table}")
        out._spindle_path = path
        self.paths.add(path)
        self.release()
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result and removes all that it was made of."""
        out = self.save(df, "result", small=True)
        for path in self.paths - {out._spindle_path}:
            self._remove(path)
        self.unshare()
        self.release()
        return out

    def _remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.discard(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more; its listeners let go of the last one a little late."""
        for pause in (0.4, 0.2):
            gc.collect()
            tidy()  # the driver's own memory
            time.sleep(pause)
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        """Removes what ``save`` or ``bucketed`` wrote, once nothing lazy reads it any more."""
        for df in dfs:
            path = getattr(df, "_spindle_path", None)
            if path is None:
                continue
            self._remove(path)
        if len(dfs) > 1:
            self.release()


def parts(spark: SparkSession) -> int:
    """Partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
