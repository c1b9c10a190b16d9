"""Release intake: landed files are digested, compared with the lock and taken
once. Late records without a lock row are appended; changed ones are set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.digests import record_digest


def judge(batch: DataFrame, lock: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``lock(key, digest)``: accepted when the digest matches, late without a
    lock row, quarantined otherwise."""
    rows = batch.withColumn("digest", record_digest(*fields))
    return rows.join(lock.select(key, F.col("digest").alias("_locked")), key, "left").withColumn(
        "status",
        F.when(F.col("_locked").isNull(), "late").when(F.col("_locked") == F.col("digest"), "accepted").otherwise("quarantined"),
    ).drop("_locked")


# A state store that keeps the keys on disk, not in the heap.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_intake(stream: DataFrame, lock: DataFrame, key: str, fields: list[str], folder: str) -> str:
    """Process everything that has landed and stop.

    Which records were taken is keyed state of the stream: one entry per (key,
    digest) in the state store, so a micro-batch reads what landed and looks its
    keys up, and nothing of earlier batches is read again. A record that lands
    again, in whatever file, adds nothing. Each micro-batch overwrites its own
    ``epoch`` folder, and state is kept by batch, so a batch that runs again after
    a failure leaves one copy.
    """
    spark = stream.sparkSession
    target = f"{folder}/rows"
    fresh = judge(stream, lock, key, fields).dropDuplicates([key, "digest"])

    def take(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = fresh.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return target


def taken(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
