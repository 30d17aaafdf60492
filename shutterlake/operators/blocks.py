"""All pairs of a table's rows, compared block by block without shuffling a row.

Rows are written once to the shared folder; a task reads the two blocks that it
compares from there. Nothing is copied to the blocks it meets, so the disk taken
follows the rows, and only what a comparison gives leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.sources.tables import materialize

#: compare(left, right, one): what two blocks give; ``one`` if they are the same block, whose pairs count once.
Compare = Callable[[object, object, bool], Iterator[pa.RecordBatch]]


def read_block(files: list[str]) -> pa.Table:
    """The rows of some files of the shared folder."""
    parts = []
    for uri in files:
        system, path = FileSystem.from_uri(uri)
        parts.append(pq.read_table(path, filesystem=system, partitioning=None))
    return pa.concat_tables(parts)


def blocks_of(rows: DataFrame, label: str, block_rows: int, order: str | None = None) -> list[tuple[list[str], float, float]]:
    """(files, least, most of ``order``) of each block: files of the written rows, together about ``block_rows`` rows; none for an empty table.

    With ``order`` the blocks follow one another by that column, not null.
    """
    placed = rows if order is None else rows.orderBy(order, "file_id")
    written = materialize(placed, label, most_rows=block_rows)
    key = F.col(order).cast("double") if order else F.lit(0.0)
    found = written.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    blocks: list[tuple[list[str], float, float]] = []
    held = block_rows
    for r in sorted(found, key=lambda r: (r["low"], r["high"], r["file"])):
        if held + r["n"] > block_rows:
            blocks.append(([], r["low"], r["high"]))
            held = 0
        files, low, high = blocks.pop()
        blocks.append(([*files, r["file"]], low, max(high, r["high"])))
        held += r["n"]
    return blocks


def met(rows: DataFrame, label: str, load: Callable[[pa.Table], object], compare: Compare, schema: str, block_rows: int = 16384, order: str | None = None, within: float = 0.0) -> DataFrame:
    """What ``compare`` gives for each two blocks of ``rows`` (file_id and others), each two once; ``load`` prepares a block.

    With ``order`` only blocks of which some rows are at most ``within`` apart meet.
    A task holds two blocks, whatever the input; the comparisons grow with the square of the blocks that meet.
    """
    spark = rows.sparkSession
    blocks = blocks_of(rows, label, block_rows, order)
    n = len(blocks)
    turns = n // 2 + 1

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, object] = (-1, None)
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                # each block meets itself and the half of the others after it, in a ring
                i, d = divmod(unit, turns)
                j = (i + d) % n
                if 2 * d == n and i > j:
                    continue
                if order is not None and max(blocks[i][1], blocks[j][1]) - min(blocks[i][2], blocks[j][2]) > within:
                    continue
                if kept[0] != i:
                    kept = (i, load(read_block(blocks[i][0])))
                yield from compare(kept[1], kept[1] if i == j else load(read_block(blocks[j][0])), i == j)

    count = n * turns if n else 0
    return spark.range(0, count, 1, max(1, min(count, max(64, 4 * n)))).mapInArrow(units, schema)
