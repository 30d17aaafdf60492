"""Queries of the general problems over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.geo import is_position, with_iso6709
from shutterlake.operators.places import near_pairs, regions_of
from shutterlake.operators.records import current_records
from shutterlake.operators.timestamps import estimate_zones, normalise_timestamps, with_reading, count_to_ms
from shutterlake.sources.tables import materialize, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every date_taken, creation_time and mtime that denotes an instant."""
    files = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["library_id", "mtime", "date_taken"])
    zones = table(spark, d, "libraries").select(F.col("library_id").alias("source"), F.col("tz_name").alias("zone"))
    files = files.select(F.col("file_id").alias("key"), F.col("library_id").alias("source"), F.col("mtime").alias("stored"), "date_taken", "mtime")
    found = normalise_timestamps(files, zones, {"mtime": ("mtime", "count"), "date_taken": ("date_taken", "local")})
    probes = current_records(table(spark, d, "video_info"), "file_id", "probed_at", ["creation_time"])
    probes = probes.select(F.col("file_id").alias("key"), F.lit(None).cast("int").alias("source"), F.lit(None).cast("double").alias("stored"), "creation_time")
    found = found.unionByName(normalise_timestamps(probes, zones, {"creation_time": ("creation_time", "utc")}))
    return found.select("field_name", F.col("key").alias("file_id"), "utc_ms")


def _library_walls(spark: SparkSession, d: str) -> DataFrame:
    """(source, wall_ms, stored_ms) of every date without zone."""
    files = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["library_id", "mtime", "date_taken"])
    read = with_reading(files, "date_taken", "r").select(F.col("library_id").alias("source"), "r", count_to_ms(F.col("mtime")).alias("stored_ms"))
    return read.where("r.offset_ms is null and r.wall_ms is not null").select("source", "r.wall_ms", "stored_ms")


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """Each library's zone as its wall clocks and mtimes alone tell it (null if they don't), and whether every wall clock means the same instant in it as in the zone that is given."""
    libraries = table(spark, d, "libraries").select(F.col("library_id").alias("source"), "tz_name")
    walls = materialize(_library_walls(spark, d), "walls")
    guessed = libraries.join(estimate_zones(walls), "source", "left")
    both = walls.join(F.broadcast(guessed.select("source", "tz_name", "zone")), "source")
    instant = lambda z: F.to_utc_timestamp(F.timestamp_millis("wall_ms"), F.col(z))
    same = both.where("zone is not null").groupBy("source").agg(F.every(instant("zone") == instant("tz_name")).alias("agrees"))
    return guessed.join(same, "source", "left").select(F.col("source").alias("library_id"), "tz_name", F.col("zone").alias("estimated_zone"), F.coalesce("aligned", F.lit(0)).alias("aligned"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("rival", F.lit(0)).alias("rival"), "agrees")


def p4_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Every date_taken brought to an instant without looking at any library's zone: by the estimated ones."""
    files = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["library_id", "mtime", "date_taken"])
    files = files.select(F.col("file_id").alias("key"), F.col("library_id").alias("source"), F.col("mtime").alias("stored"), "date_taken")
    hidden = table(spark, d, "libraries").select(F.col("library_id").alias("source"), F.lit(None).cast("string").alias("zone"))
    found = normalise_timestamps(materialize(files, "dates"), hidden, {"date_taken": ("date_taken", "local")})
    return found.select("field_name", F.col("key").alias("file_id"), "utc_ms")


def located_files(spark: SparkSession, d: str) -> DataFrame:
    """(id, lat, lon) of every file with a real position: an image's coordinates, else a video's location."""
    images = current_records(table(spark, d, "geo_coords"), "file_id", "read_at", ["lat", "lon"]).where(is_position(F.col("lat"), F.col("lon")))
    videos = with_iso6709(current_records(table(spark, d, "video_info"), "file_id", "probed_at", ["location"]), "location")
    videos = videos.select("file_id", "lat", "lon").where(is_position(F.col("lat"), F.col("lon"))).join(images, "file_id", "left_anti")
    return images.unionByName(videos).select(F.col("file_id").alias("id"), "lat", "lon")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files at most 150 m apart, and the regions that contain each file."""
    points = materialize(located_files(spark, d), "located")
    near = near_pairs(points, 150.0).select(F.lit("near").alias("relation"), "left_id", "right_id")
    inside = regions_of(points, table(spark, d, "country_borders")).select(F.lit("in").alias("relation"), F.col("id").alias("left_id"), F.col("region_id").alias("right_id"))
    return near.unionByName(inside)
