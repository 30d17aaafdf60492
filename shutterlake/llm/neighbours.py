"""The most similar vectors of every vector, by a permutation index.

A bounded sample of vectors serves as pivots. Each vector is represented by its
nearest pivots in order, and posted in the inverted files of the first few of
them; a query reads the files of its own nearest pivots, ranks what is posted
there by the footrule distance of the two orders, and reranks the best by
cosine. Files of very many vectors are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import hash64
from shutterlake.sources.tables import materialize

Decoder = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]


def vector_bytes(col: Column, size: int = 64) -> Column:
    """The bytes of a hex text of ``size`` half floats; null for any other text."""
    text = F.regexp_replace(col, r"^[\x00\s]+|[\x00\s]+$", "")
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{4 * size}}}$"), F.unhex(text))


def half_floats(column: pd.Series, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit rows) of little-endian half floats, ``size`` a row (see :func:`vector_bytes`); unusable unless all are finite and some isn't zero."""
    usable = column.notna().to_numpy()
    matrix = np.frombuffer(b"".join(column[usable]), "<f2").reshape(-1, size).astype(np.float32)
    norm = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    usable[np.flatnonzero(usable)[~good]] = False
    return usable, (matrix[good] / norm[good, None]).astype(np.float32)


def hash_signs(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit rows of +-) of 16-byte hashes; the cosine falls by 2/128 for each differing bit."""
    usable = column.notna().to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(column[usable]), np.uint8).reshape(-1, 16), axis=1)
    return usable, ((bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(128))).astype(np.float32)


def both_hashes(phash: str = "phash", dhash: str = "dhash"):
    """The bytes of two non-zero hashes, else null."""
    to_bytes = lambda c: F.unhex(F.lpad(F.hex(hash64(F.col(c))), 16, "0"))
    return F.concat(to_bytes(phash), to_bytes(dhash))


def pivot_count(rows: int) -> int:
    """About the square root of the rows, so that files grow no faster than it; at most 16,384 (4 MB), which bounds what tasks receive."""
    return int(min(16_384, max(32, round(rows**0.5))))


def nearest(vectors: DataFrame, k: int, decode: Decoder, prefix: int = 16, posted: int = 3, probed: int = 24, reranked: int = 400, rows_per_task: int = 20_000) -> DataFrame:
    """(query_id, id, similarity): the ``k`` most similar other vectors of each query.

    ``vectors`` has id, code (what ``decode`` reads) and asked (whether the row
    is a query too), each id once. Every row is indexed; rows that don't decode
    take part in nothing. Equal similarities go by id. ``prefix`` pivots make an
    order, a vector is posted under ``posted`` of them, a query reads ``probed``
    files and reranks ``reranked`` of each and all that tie with the last. The
    pivots come from a sample of some two rows a pivot, drawn by id.
    """
    source = vectors.where("id is not null and code is not null").select("id", "code", F.coalesce("asked", F.lit(False)).alias("asked"))
    rows = source.count()
    count = pivot_count(rows)
    every = max(1, rows // (2 * count))
    sample = source.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "code").limit(4 * count).toPandas().sort_values("id")
    _, drawn = decode(sample["code"].drop_duplicates())
    pivots = drawn[:count]
    empty = "query_id bigint, id bigint, similarity double"
    if not len(pivots):
        return source.sparkSession.createDataFrame([], empty)
    length, reach = min(prefix, len(pivots)), min(probed, len(pivots))
    deep = max(length, reach)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            step = max(1, 16_000_000 // len(pivots))
            for start in range(0, len(whole), step):
                frame = whole.iloc[start : start + step]
                usable, rows = decode(frame["code"])
                if not usable.any():
                    continue
                frame = frame[usable]
                sims = rows @ pivots.T
                best = np.argpartition(-sims, deep - 1, axis=1)[:, :deep] if deep < sims.shape[1] else np.tile(np.arange(deep), (len(rows), 1))
                order = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1).astype(np.int16)
                text = [o[:length].tobytes() for o in order]
                ids, codes, asked = frame["id"].to_numpy(), frame["code"].to_numpy(), frame["asked"].to_numpy(bool)
                for j in range(min(posted, deep)):
                    yield pd.DataFrame({"file": order[:, j].astype(np.int32), "query": False, "id": ids, "ranks": text, "code": codes})
                if asked.any():
                    for j in range(reach):
                        yield pd.DataFrame({"file": order[asked, j].astype(np.int32), "query": True, "id": ids[asked], "ranks": np.array(text, object)[asked], "code": codes[asked]})

    kind = dict(source.dtypes)["code"]
    postings = materialize(source.mapInPandas(post, f"file int, query boolean, id bigint, ranks binary, code {kind}"), "postings")
    sizes = postings.where("not query").groupBy("file").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("parts"))
    dealt = postings.join(F.broadcast(sizes), "file")
    part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    dealt = dealt.withColumn("part", F.explode(part)).drop("parts")

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["query"].to_numpy(bool)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.any() and not asked.all():
            rows, queries = frame[~asked], frame[asked]
            ids = rows["id"].to_numpy()
            _, matrix = decode(rows["code"])
            _, wanted = decode(queries["code"])
            orders = np.frombuffer(b"".join(rows["ranks"]), np.int16).reshape(-1, length)
            mine = np.frombuffer(b"".join(queries["ranks"]), np.int16).reshape(-1, length)
            place = np.arange(length, dtype=np.int16)
            for q, (me, order) in enumerate(zip(queries["id"].to_numpy(), mine)):
                seen = np.full(len(pivots), length, np.int16)
                seen[order] = place
                footrule = np.abs(seen[orders] - place).sum(1)
                keep = np.flatnonzero(footrule <= np.partition(footrule, reranked - 1)[reranked - 1]) if len(footrule) > reranked else np.arange(len(footrule))
                keep = keep[ids[keep] != me]
                sims = np.round(matrix[keep].astype(np.float64) @ wanted[q].astype(np.float64), 9)
                top = np.lexsort((ids[keep], -sims))[:k]
                out.append((np.full(len(top), me), ids[keep][top], sims[top]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([], float)]
        return pd.DataFrame(dict(zip(("query_id", "id", "similarity"), parts)))

    found = dealt.groupBy("file", "part").applyInPandas(rank, empty)
    best = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id"))), 1, k).alias("top"))
    return best.select("query_id", F.explode("top").alias("t")).select("query_id", "t.id", (-F.col("t.far")).alias("similarity"))
