"""Connected components of the groupings of the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.comparing import Stars
from shutterlake.sources.tables import discard, materialize

#: Links that one task takes at once, some 100 MB with what it makes of them.
ONE_TASK = 1 << 19


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): every end of ``edges`` (u, v) with the smallest node that it is linked to.

    Each round every node follows the neighbour of the least random priority
    (its own included), which contracts the graph by a constant factor; rounds
    run until at most ``one_task`` edges are left, which one task links at once,
    so chains of any length take logarithmic time. The names of each round are
    written before they are joined with those of the round before: no plan
    grows with the rounds, and a small graph needs none.
    """
    plain = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = materialize(plain(edges), "links")
    maps: list[DataFrame] = []
    while (count := left.count()) > one_task:
        turn = len(maps)
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("n"))  # noqa: B023, E731
        lead = both.groupBy("u").agg(F.least(F.min(key("v")), F.first(key("u"))).alias("b")).select(F.col("u").alias("node"), F.col("b.n").alias("root"))
        lead = materialize(lead, f"leads-{turn}")
        maps.append(lead)
        of = lambda end: lead.select(F.col("node").alias(end), F.col("root").alias(f"n{end}"))  # noqa: B023, E731
        smaller = materialize(plain(left.join(of("u"), "u").join(of("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))), f"links-{turn}")
        discard(left)
        left = smaller
    if not count and not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    final = materialize(left.coalesce(1).mapInArrow(_linked, "node bigint, root bigint"), "roots") if count else maps.pop()
    for lead in reversed(maps):
        later = final.select(F.col("node").alias("root"), F.col("root").alias("later"))
        named = materialize(lead.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "roots")
        discard(final)
        discard(lead)
        final = named
    names = final.groupBy("root").agg(F.min("node").alias("name"))
    return final.join(names, "root").select("node", F.col("name").alias("root"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) of a task."""
    links = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = (links[c].to_numpy() for c in ("u", "v"))
    ids = np.unique(np.concatenate([u, v]))
    stars = Stars(ids)
    stars.add(np.searchsorted(ids, u), np.searchsorted(ids, v), np.zeros(len(u)))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[stars.root])], names=["node", "root"])
