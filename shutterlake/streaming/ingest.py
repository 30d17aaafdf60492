"""A catalogue that grows: analyses arrive as a stream and are kept by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shutterlake.operators.cache import still_valid
from shutterlake.operators.records import current_records


def ingest(stream: DataFrame, store: str, checkpoint: str, available_now: bool = True, most_sent: int = 200_000) -> StreamingQuery:
    """Append each batch's analyses (path, size, mtime, analyzed_at, ...) that the store doesn't hold yet.

    A row whose path is stored with the same size and mtime is skipped. Each
    batch writes its own folder and replaces it when run again, so a restarted
    query repeats nothing. Only what the store holds of the batch's paths is
    compared: the paths of a batch of up to ``most_sent`` rows, counted, are sent
    to the store's scan; those of a larger one meet the store by a shuffle.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = current_records(batch, "path", "analyzed_at", [c for c in batch.columns if c != "path"]).select(*batch.columns)
        old = _others(spark, store, number)
        if old is not None:
            paths = latest.select("path")
            known = old.join(F.broadcast(paths) if latest.count() <= most_sent else paths, "path", "left_semi")
            held = current_records(known, "path", "analyzed_at", ["size", "mtime"]).select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
            same = F.coalesce(still_valid(F.col("size"), F.col("mtime"), F.col("_size"), F.col("_mtime")), F.lit(False))
            latest = latest.join(held, "path", "left").where(~same).select(*batch.columns)
        latest.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _others(spark: SparkSession, store: str, number: int) -> DataFrame | None:
    """What batches other than this one wrote, or null at first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.parquet(store).where(F.col("batch") != number)
    return found.drop("batch")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The current analysis of every path."""
    rows = spark.read.parquet(store).drop("batch")
    return current_records(rows, "path", "analyzed_at", [c for c in rows.columns if c != "path"]).select(*rows.columns)


def first_copies(stream: DataFrame, digest: str, stamp: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each digest to arrive, however late it comes and however long after it the copies.

    Every digest seen stays in the query's state, so the state grows with the
    distinct digests; a store on disk (RocksDB) suits long streams. ``stamp``
    and ``late``, which bounded the state, have no effect any more.
    """
    return stream.where(F.col(digest).isNotNull()).dropDuplicates([digest])
