"""Sources and sinks of corpora: JSON records, manifests of whole-file texts, verified exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("profiling", "calibration", "holdout")


def scan_json_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of one schema with the file each came from. Blank lines are skipped; a bad record
    fails the read (strict) or is returned in ``_corrupt_record``."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).withColumn("_file", F.col("_metadata.file_path"))


def scan_text_corpus(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Works of a manifest (work_id, path, text_hash, partition, ...) joined to the text of their
    files. A missing file, another hash or an unknown partition fails the query when it runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("__name"), F.col("content").alias("__content"))
    j = manifest.join(files, F.element_at(F.split("path", "/"), -1) == F.col("__name"), "left")
    fault = (F.when(F.col("__content").isNull(), F.concat(F.lit("file not found: "), "path")).when(F.sha2("__content", 256) != F.col("text_hash"), F.concat(F.lit("hash differs: "), "path"))
             .when(~F.col("partition").isin(*PARTITIONS), F.concat(F.lit("unknown partition: "), "partition")))
    text = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.decode("__content", "UTF-8"))
    return j.withColumn("text", text).drop("__name", "__content")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, path, bytes, sha256) of the data files of an export; dataset is the folder's key."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return found.select(F.regexp_extract("path", "dataset=([^/]+)/", 1).alias("dataset"), F.regexp_extract("path", "(dataset=.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_manifest(spark: SparkSession, datasets: dict[str, DataFrame], ids: list[str], root: str) -> DataFrame:
    """Write the named datasets below ``root`` and return their manifest; an unknown id is rejected."""
    if unknown := sorted(set(ids) - set(datasets)):
        raise ValueError(f"unknown datasets: {unknown}")
    for i in ids:
        datasets[i].write.parquet(f"{root}/dataset={i}")
    return file_hashes(spark, root)


def verify_manifest(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """(dataset, path, finding): ok, absent, undeclared, duplicate, size differs or hash differs."""
    m = manifest.groupBy("path").agg(F.first("dataset").alias("d"), F.first("bytes").alias("b"), F.first("sha256").alias("h"), F.count("*").alias("n"))
    s = scan.select(F.col("dataset").alias("ds"), F.col("path").alias("p"), F.col("bytes").alias("bs"), F.col("sha256").alias("hs"))
    finding = (F.when(F.col("p").isNull(), "absent").when(F.col("path").isNull(), "undeclared").when(F.col("n") > 1, "duplicate")
               .when(F.col("b") != F.col("bs"), "size differs").when(F.col("h") != F.col("hs"), "hash differs").otherwise("ok"))
    return m.join(s, F.col("path") == F.col("p"), "full_outer").select(F.coalesce("d", "ds").alias("dataset"), F.coalesce("path", "p").alias("path"), finding.alias("finding"))


def merge_corpus(base: DataFrame, imported: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, verdict): kept (only in base), inserted, identical, or conflict in a compared column."""
    i = imported.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in compared])
    b = base.select(F.col(key).alias("__b"), *compared)
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    v = F.when(F.col("__k").isNull(), "kept").when(F.col("__b").isNull(), "inserted").when(same, "identical").otherwise("conflict")
    return b.join(i, F.col("__b") == F.col("__k"), "full_outer").select(F.coalesce("__b", "__k").alias(key), v.alias("verdict"))
