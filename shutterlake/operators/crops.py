"""Pictures that are a part of others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import PROFILES, Profile
from shutterlake.functions.pixels import best_crop
from shutterlake.operators import comparing
from shutterlake.operators.blocks import met


def crop_candidates(files: DataFrame, profile: Profile = PROFILES["medium"], block_rows: int = 8192) -> DataFrame:
    """(a, b, score, color): pictures, a < b, of which one may be a crop of the other.

    Neither bytes nor pixels are equal, the palettes share 50 % or more, the
    score is 30 or more but below very similar, and either the aspects differ by
    5 % or more or the score is 10 below similar. Pictures without dimensions,
    phash or palette take no part. Pictures are compared and scored where their
    blocks meet (see :func:`blocks.met`), so all pairs are looked at, and only
    candidates leave a task.
    """
    usable = files.where("kind = 'image' and error is null and phash is not null and color is not null and width is not null and height is not null and file_id is not null")
    rows = usable.select("file_id", "phash", "dhash", "ahash", "bhash", "color", "width", "height", "sha", "pixels")

    def compare(left: comparing.Palettes, right: comparing.Palettes, one: bool) -> Iterator[pa.RecordBatch]:
        for x, y in comparing.sharing(left, right, one, 50.0):
            of = comparing.signals_of(left, right, x, y)
            score = comparing.score_of(profile, of)
            keep = (of["color"] >= 50) & (score >= 30) & (score < profile.bands.very_similar)
            yield comparing.batch(left, right, x[keep], y[keep], {"score": score[keep], "color": of["color"][keep]}, ("file_id", "width", "height", "sha", "pixels"))

    kinds = dict(rows.dtypes)
    shape = ", ".join([f"{s}_{c} {kinds[c]}" for s in "ab" for c in ("file_id", "width", "height", "sha", "pixels")] + ["score double", "color double"])
    rated = met(rows, "palettes", comparing.Palettes, compare, shape, block_rows)
    rated = rated.where(F.coalesce(F.col("a_sha") != F.col("b_sha"), F.lit(True)) & F.coalesce(F.col("a_pixels") != F.col("b_pixels"), F.lit(True)))
    wide = lambda s: F.col(f"{s}_width") / F.col(f"{s}_height")
    apart = F.abs(wide("a") - wide("b")) / F.greatest(wide("a"), wide("b")) >= 0.05
    return rated.where(apart | (F.col("score") < profile.bands.similar - 10)).select(F.col("a_file_id").alias("a"), F.col("b_file_id").alias("b"), "score", "color")


def crop_edges(candidates: DataFrame, grids: DataFrame, least: float = 0.82) -> DataFrame:
    """(small, big, score, region): of each pair (a, b) the smaller picture's best place in the bigger one, if it fits well enough.

    ``grids`` has file_id, width, height, grid (32 x 32 grey block means). The
    score is the correlation in percent, the region x0, y0, x1, y1 in parts of
    the bigger picture; see ``pixels.best_crop``. Pairs without grids are left out.
    """

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                swap = r.wa * r.ha < r.wb * r.hb
                small, big = (r.a, r.b) if swap else (r.b, r.a)
                g, h, aspect = (r.gb, r.ga, r.wa / r.ha) if swap else (r.ga, r.gb, r.wb / r.hb)
                found = best_crop(np.asarray(g, float).reshape(32, 32), np.asarray(h, float).reshape(32, 32), least, aspect)
                if found is not None:
                    score, x, y, w, t = found
                    out.append((small, big, round(100 * score, 1), [x / 32, y / 32, (x + w) / 32, (y + t) / 32]))
            yield pd.DataFrame(out, columns=["small", "big", "score", "region"])

    of = lambda s: grids.where("grid is not null and size(grid) = 1024 and width > 0 and height > 0").select(F.col("file_id").alias(s), F.col("width").alias(f"w{s}"), F.col("height").alias(f"h{s}"), F.col("grid").alias(f"g{s}"))
    both = candidates.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return both.mapInPandas(fit, "small bigint, big bigint, score double, region array<double>")


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each small picture: the highest score, then the smallest big picture."""
    best = edges.groupBy("small").agg(F.max(F.struct("score", (-F.col("big")).alias("big"), "region")).alias("r"))
    return best.select("small", (-F.col("r.big")).alias("big"), "r.score", "r.region")


def crop_groups(edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """(big, file_id, score, region): members of the groups of crops, one for each source picture, the source itself at 100.

    A small picture that another layer holds already (``grouped``: file_id) is left out. ``score`` and ``region`` of the source row are
    those of 100 and of the best crop.
    """
    kept = edges.join(grouped.select(F.col("file_id").alias("small")).distinct(), "small", "left_anti")
    best = kept.groupBy("big").agg(F.max(F.struct("score", (-F.col("small")).alias("small"), "region")).alias("r"))
    source = best.select("big", F.col("big").alias("file_id"), F.lit(100.0).alias("score"), F.col("r.region").alias("region"))
    return source.unionByName(kept.select("big", F.col("small").alias("file_id"), "score", "region"))
