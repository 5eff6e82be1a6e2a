"""Intermediate tables that survive the loss of executors.

``spark.checkpoint.dir`` names a folder that the driver and all executors share; intermediate
results are written there as Parquet and read back, which cuts the lineage and keeps the column
statistics that adaptive execution uses to choose joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. On a cluster it has to be configured; a temporary one is set only
    where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-corpusx-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by their bytes, unless they are bounded closer: a batch of long
    texts is held several times over on both sides. It changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in spark.conf.get(key) if c.isdigit())
    if not digits or int(digits) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables of one operator run. ``drop`` removes those that the result no longer needs; the others,
    which a lazy result may still read, go when the session's file systems are closed at its end."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        small_batches(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/corpusx-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """Write ``df`` and return the table read back with the same schema.

        batch: rows of an Arrow batch while it is written, for tables of wide rows.
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        try:
            if batch:
                self.spark.conf.set(key, batch)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, before)
        if self._n == 1:
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables returned by ``keep``."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
            self._kept = [k for k in self._kept if k is not df]

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete every table of this run except those given."""
        self.drop(*[k for k in self._kept if not any(k is t for t in tables)])


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
