"""Numbering rows in order without bringing them to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.sources.tables import materialize


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``, 1, 2, ... in ``order``, which should leave no ties.

    Rows are sorted by ranges over all tasks and written once; only the number
    of rows of each part goes to the driver, and each row adds its place in
    its part to the rows of the parts before.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    if not before:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop("_at")
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "_part bigint, _before bigint"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``, 1, 2, ... in ``order`` within each of ``keys`` (not null); a hot key is sorted by many tasks."""
    rows = numbered(df, [*keys, *order], "_all")
    first = rows.groupBy(*keys).agg(F.min("_all").alias("_first"))
    return rows.join(first, keys).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")
