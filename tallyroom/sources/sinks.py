"""Published outputs: partitioned tables, one document per filer, an index."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.compare import compare_sets
from tallyroom.operators.digests import record_digest, set_digest

COMMIT = "version bigint, folder string, records bigint, set_digest string"


def receipt_documents(receipts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each receipt with its JSON document and canonical digest."""
    return receipts.select(
        key, *fields, F.to_json(F.struct(key, *fields)).alias("document"), record_digest(key, *fields).alias("digest")
    )


def write_receipts(receipts: DataFrame, path: str, year: str = "fiscal_year") -> None:
    """Parquet by fiscal year. A filer is a sort key inside a file, not a
    partition: one small file per filer does not scale."""
    receipts.repartition(year, F.pmod(F.xxhash64(*receipts.columns), F.lit(64))).write.mode("overwrite").partitionBy(year).parquet(path)


def receipt_index(documents: DataFrame, key: str) -> DataFrame:
    return documents.drop("document").withColumn("path", F.concat(F.lit("by-code/"), F.col(key).cast("string"), F.lit(".json")))


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The published versions of a folder, one row each; none before the first."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def publish(documents: DataFrame, root: str, key: str) -> int:
    """Publish ``documents(key, document, digest)`` as the next version, whole or
    not at all, and return its number.

    Documents and the manifest of digests go to a folder of their own that no
    reader knows. Only when the manifest, reread from there, has as many keys as
    documents does a single row name the folder: that one file is the commit. A
    job that fails before it leaves the last version as it was, and the version
    before stays readable. One writer at a time; old folders are kept.
    """
    spark = documents.sparkSession
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    documents.write.parquet(f"{folder}/documents")
    stored = spark.read.schema(documents.schema).parquet(f"{folder}/documents")
    stored.select(key, "digest").write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(stored.select(key, "digest").schema).parquet(f"{folder}/manifest")
    counted = manifest.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).first()
    if counted["rows"] != counted["keys"]:
        raise ValueError(f"{counted['rows']} documents have {counted['keys']} keys: nothing is published")
    whole = set_digest(manifest.withColumn("_all", F.lit(1)), ["_all"], "digest").select("set_digest").first()
    version = (commits(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    row = (version, folder, counted["rows"], whole["set_digest"] if whole else "")
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def published(spark: SparkSession, root: str, part: str = "manifest", version: int | None = None) -> DataFrame:
    """``manifest`` or ``documents`` of a version, by default the newest."""
    every = commits(spark, root)
    chosen = every.filter(F.col("version") == version) if version else every.orderBy(F.desc("version")).limit(1)
    row = chosen.first()
    if row is None:
        raise LookupError(f"nothing is published in {root}" if version is None else f"no version {version} in {root}")
    return spark.read.parquet(f"{row['folder']}/{part}")


def freshness(rebuilt: DataFrame, root: str, key: str) -> DataFrame:
    """Rebuilt ``(key, digest)`` against the newest manifest: missing, stale,
    changed or fresh. The documents are not read."""
    manifest = published(rebuilt.sparkSession, root)
    return compare_sets(rebuilt, manifest, [key], ["digest"], ("missing", "stale", "changed", "fresh")).drop("differs")
