"""Which file of each group to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import BAD_FOLDERS, COPY_HINTS, LOSSLESS, LOSSY, base_name, contains_any, folder, rounded
from shutterlake.operators.skew import salted_join
from shutterlake.sources.tables import materialize


def traits(files: DataFrame) -> DataFrame:
    """(file_id, pixels, bitrate, format_rank, metadata_points, copy_named, bad_folder, depth, path_length): what speaks for or against a file."""
    image, good = F.col("kind") == "image", F.col("error").isNull()
    form = F.upper(F.coalesce("img_format", F.lit("")))
    rank = F.when(image & good & form.isin(*LOSSLESS), 2).when(image & good & form.isin(*LOSSY), 1).otherwise(0)
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    points = F.when(image & good, has(F.col("has_exif") != 0) + has(filled(F.col("make")) | filled(F.col("model"))) + has(filled(F.col("date_taken")))).otherwise(0)
    return files.select(
        "file_id", F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("bigint") * F.col("height")).otherwise(0).alias("pixels"),
        F.coalesce("bitrate", F.lit(0)).alias("bitrate"), rank.alias("format_rank"), points.alias("metadata_points"),
        contains_any(F.lower(base_name(F.col("path"))), COPY_HINTS).alias("copy_named"), contains_any(F.lower(folder(F.col("path"))), BAD_FOLDERS).alias("bad_folder"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))).alias("depth"), F.length("path").alias("path_length"),
    )


def keep_scores(members: DataFrame, files: DataFrame) -> DataFrame:
    """(key, category, file_id, score, decisive): the points of each member of a group (key, category, file_id).

    Points are relative to the group: 30 for most pixels (not if all are the
    same file), 12 for the largest file if another is smaller, 5 a step of
    format, 10 for the best bitrate, 4 a kind of metadata, 9 for the oldest
    within 2 s, 6 or -14 by name, -10 for a bad folder, 3 for the least depth,
    2 for a path at most 4 longer than the shortest.
    """
    rows = materialize(members.join(files.select("file_id", "size", "mtime"), "file_id").join(traits(files), "file_id"), "traits")
    exact = F.col("category") == "file_identical"
    high, low = ("pixels", "size", "bitrate", "format_rank", "metadata_points"), ("pixels", "size", "bitrate", "format_rank", "metadata_points", "mtime", "depth", "path_length")
    ends = rows.groupBy("key", "category").agg(*[F.max(c).alias(f"top_{c}") for c in high], *[F.min(c).alias(f"low_{c}") for c in low])
    rows = salted_join(ends, rows, ["key", "category"])
    best = lambda c: (F.col(c) == F.col(f"top_{c}")) & (F.col(f"low_{c}") < F.col(f"top_{c}"))
    points: list[Column] = [
        F.when((F.col("top_pixels") > 0) & ~exact, F.lit(30.0) * F.col("pixels") / F.col("top_pixels")).otherwise(0.0),
        F.when(best("size"), 12.0).otherwise(0.0), F.col("format_rank") * 5.0, F.when(F.col("top_bitrate") > 0, F.lit(10.0) * F.col("bitrate") / F.col("top_bitrate")).otherwise(0.0),
        F.col("metadata_points") * 4.0, F.when(F.col("mtime") <= F.col("low_mtime") + 2.0, 9.0).otherwise(0.0), F.when(F.col("copy_named"), -14.0).otherwise(6.0),
        F.when(F.col("bad_folder"), -10.0).otherwise(0.0), F.when(F.col("depth") == F.col("low_depth"), 3.0).otherwise(0.0), F.when(F.col("path_length") <= F.col("low_path_length") + 4, 2.0).otherwise(0.0),
    ]
    total = points[0]
    for p in points[1:]:
        total = total + p
    lossless = (F.col("format_rank") == 2) & (F.col("low_format_rank") < 2) & ~exact
    decisive = F.col("copy_named") | F.col("bad_folder") | (best("pixels") & ~exact) | lossless | (best("metadata_points"))
    return rows.select("key", "category", "file_id", "mtime", total.alias("score"), decisive.alias("decisive"))


def recommendations(scores: DataFrame) -> DataFrame:
    """(key, category, keep, score, confidence): the best member of each group of two or more.

    Confidence is 52 plus 2.4 times the margin over the runner-up, within 35 and
    96, and at most 55 for identical files without a decisive reason. Ties go to the older, then the smaller file.
    """
    best = scores.groupBy("key", "category").agg(F.max(F.struct("score", (-F.col("mtime")).alias("mtime"), (-F.col("file_id")).alias("file_id"), "decisive")).alias("r"))
    best = best.select("key", "category", F.col("r.score").alias("best"), (-F.col("r.file_id")).alias("keep"), F.col("r.decisive").alias("sound"))
    others = salted_join(best, scores, ["key", "category"]).where("file_id <> keep")
    ranked = others.groupBy("key", "category", "keep").agg(F.max("best").alias("score"), F.max("score").alias("second"), F.first("sound").alias("decisive"))
    sure = F.floor(F.greatest(F.lit(35.0), F.least(F.lit(96.0), F.lit(52.0) + (F.col("score") - F.col("second")) * 2.4))).cast("int")
    capped = F.when((F.col("category") == "file_identical") & ~F.col("decisive"), F.least(sure, F.lit(55))).otherwise(sure)
    return ranked.select("key", "category", "keep", rounded(F.col("score")).alias("score"), capped.alias("confidence"))
