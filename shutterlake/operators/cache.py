"""The cache of analyses, keyed by path, and the log of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def still_valid(size: Column, mtime: Column, cached_size: Column, cached_mtime: Column) -> Column:
    """A cached analysis holds if the size is equal and the mtime within a thousandth of a second."""
    return (size == cached_size) & (F.abs(mtime - cached_mtime) <= 1e-3)


def lookup(scan: DataFrame, cache: DataFrame, restored: list[str], key: str = "path") -> DataFrame:
    """``scan`` (key, size, mtime) with ``hit`` and the cached columns where the cached row still holds."""
    kept = cache.select(F.col(key), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), *restored)
    valid = F.coalesce(still_valid(F.col("size"), F.col("mtime"), F.col("_size"), F.col("_mtime")), F.lit(False))
    joined = scan.select(key, "size", "mtime").join(kept, key, "left").withColumn("hit", valid)
    return joined.select(key, "size", "mtime", "hit", *[F.when(F.col("hit"), F.col(c)).alias(c) for c in restored])


def upsert(cache: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The cache with new rows in place of old ones of the same key; the rest unchanged."""
    return cache.join(new.select(key), key, "left_anti").select(*cache.columns).unionByName(new.select(*cache.columns))


def prune(cache: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """The cached rows whose key still exists."""
    return cache.join(existing.select(key).distinct(), key, "left_semi")


def pruned_count(cache: DataFrame, existing: DataFrame, key: str = "path") -> int:
    """How many cached rows :func:`prune` takes out."""
    return cache.join(existing.select(key).distinct(), key, "left_anti").count()


def clear(cache: DataFrame) -> DataFrame:
    """The cache with nothing in it."""
    return cache.limit(0)


def needs_work(files: DataFrame, done: str, kind: str | None = None) -> DataFrame:
    """The files (``done`` column, error, kind) that a step has still to do: its result is missing and nothing failed before."""
    left = files.where(F.col(done).isNull() & F.col("error").isNull())
    return left if kind is None else left.where(F.col("kind") == kind)


def append_operations(entries: DataFrame, store: str) -> None:
    """Add entries (path, action, result, detail, size) to the log of operations, stamped with the time at which they are written."""
    entries.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(store)


def recent(log: DataFrame, stamp: str, ident: str, limit: int = 500) -> DataFrame:
    """The newest operations; a top-k, never a full sort."""
    return log.orderBy(F.desc(stamp), F.desc(ident)).limit(limit)
