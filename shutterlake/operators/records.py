"""Current records: the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_records(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """One row for each ``key``: the row with the largest ``stamp``, with ``columns`` only.

    Null keys are no records. Rows that tie on the stamp are compared column by
    column and the greatest wins, so a repeated row counts once and the result
    never depends on the order of rows. A null stamp loses to any other.
    The aggregation combines on the map side, so a key with many rows stays cheap.
    """
    wanted = [c for c in columns if c not in (key, stamp)]
    latest = F.max(F.struct(F.col(stamp).alias("_stamp"), *[F.col(c) for c in wanted])).alias("_row")
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(latest)
    return found.select(key, *([F.col("_row._stamp").alias(stamp)] if stamp in columns else []), *[F.col(f"_row.{c}").alias(c) for c in wanted])
