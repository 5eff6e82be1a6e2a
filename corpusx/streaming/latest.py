"""The latest completed record per key, kept up to date by a stream as a table in buckets.

State per key is the best record so far; a micro-batch gives the keys whose record changed, and only their buckets are
written again, so the cost of a batch follows what it changes and files of other buckets stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64


def read_latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as it stands, without its buckets; no rows before the first batch."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(path).drop("bucket")


def keep_latest(log: DataFrame, path: str, checkpoint: str, key: str, order: list[str], values: list[str], done: str = "true", buckets: int = BUCKETS) -> None:
    """Drain a stream ``log`` into the table at ``path``: per ``key`` the ``values`` of the record with the greatest ``order`` among those that meet ``done``.

    A key without such a record isn't in the table, a null key is a key; of records equal in ``order`` the greatest values count. A batch that is
    run again after a failure writes the same rows. State holds one record a key and doesn't expire, as any key may get a later one.
    """
    best = log.where(done).groupBy(key).agg(F.max(F.struct(*order, *values)).alias("last"))
    changed = best.select(key, *[F.col(f"last.{c}").alias(c) for c in dict.fromkeys([*order, *values])])
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    schema = changed.schema

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", bucket).persist()
        try:
            touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # as many as there are buckets at most
            if not touched:
                return
            old = read_latest(spark, path, schema).withColumn("bucket", bucket)
            kept = old.where(F.col("bucket").isin(touched)).join(batch.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
            kept.unionByName(batch).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        finally:
            batch.unpersist()

    changed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
