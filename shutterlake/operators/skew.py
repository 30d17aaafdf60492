"""Equi-joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.sources.tables import materialize

#: Keys are first counted by the cell of their hash, so a count sends at most so many numbers.
CELLS = 1 << 16


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """(keys, rows) of every key with more than ``limit`` rows and more than twice the mean of a cell; null if there is none.

    Rows are counted by cell, combined in each task, which shuffles ``CELLS``
    numbers a task whatever the rows and leaves at most one row for the driver.
    Only keys of the few cells that exceed the bound are counted themselves.
    Null keys join nothing and are left out. Runs ``df`` once, or twice if a
    cell is hot; hand in a table, not a costly plan.
    """
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys)
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")
    per = known.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    seen = per.agg(F.sum("n").alias("all"), F.collect_list(F.when(F.col("n") > limit, F.struct("cell", "n"))).alias("full")).first()
    bound = max(limit, 2 * (seen["all"] or 0) // CELLS)
    full = [r["cell"] for r in seen["full"] if r["n"] > bound]
    if not full:
        return None
    exact = known.where(cell.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bound)
    exact = materialize(exact, "hot-keys")
    return None if exact.isEmpty() else exact


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_per_salt: int = 20_000, how: str = "inner", hot: DataFrame | None | str = "count") -> DataFrame:
    """Join in which a key with many right rows is split into salts; ``how`` is 'inner' or 'right' (a right row without a left one stays, its left columns null).

    Right rows of a hot key (see :func:`hot_keys`) are dealt over ``ceil(rows /
    rows_per_salt)`` salts and the key's left rows are copied to each of them,
    so no task holds more than about ``rows_per_salt`` right rows of one key.
    Without a hot key this is the plain join, with nothing added but the count;
    ``hot`` may be given where it is known already (keys and rows, or null for none).
    Nothing is dropped: the result equals the plain join. Null keys match
    nothing. Column names other than the keys must differ.
    """
    if isinstance(hot, str):
        hot = hot_keys(right, keys, rows_per_salt)
    if hot is None:
        return left.join(right, keys, how)
    salts = hot.select(*keys, F.ceil(F.col("rows") / rows_per_salt).cast("int").alias("_salts"))
    if hot.count() <= 100_000:
        salts = F.broadcast(salts)
    # the salt goes by the row before the join with the counts, so that equal rows share one
    other = [F.col(c) for c in right.columns if c not in keys]
    dealt = right.withColumn("_at", F.xxhash64(*other) if other else F.monotonically_increasing_id()).join(salts, keys, "left")
    dealt = dealt.withColumn("_salt", F.pmod("_at", F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts", "_at")
    copied = left.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return copied.join(dealt, [*keys, "_salt"], how).drop("_salt")

