"""The country of a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.places import regions_of


def countries_of(points: DataFrame, regions: DataFrame, snap_degrees: float = 0.1) -> DataFrame:
    """(id, country): the region that contains the point, the one of smallest bounding box if several do.

    A point that no region contains takes the region of the nearest edge, if
    that is nearer than ``snap_degrees`` (in degrees of lon and lat); others are
    absent. ``points`` has id, lat, lon; ``regions`` region_id, country, its bounding box and polys.
    """
    area = regions.select("region_id", "country", ((F.col("bbox_e") - F.col("bbox_w")) * (F.col("bbox_n") - F.col("bbox_s"))).alias("area"))
    inside = regions_of(points, regions).join(F.broadcast(area), "region_id").groupBy("id").agg(F.min_by("country", F.struct("area", "region_id")).alias("country"))
    outside = points.join(inside, "id", "left_anti")
    edges = regions.select("region_id", "country", "bbox_w", "bbox_e", F.explode("polys").alias("rings")).select("region_id", "country", F.explode("rings").alias("ring"))
    ends = F.arrays_zip(F.slice(F.col("ring"), F.lit(1), F.greatest(F.size("ring") - 1, F.lit(0))).alias("p"), F.slice(F.col("ring"), F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))).alias("q"))
    edge = edges.select("region_id", "country", F.explode(ends).alias("e")).select("region_id", "country", *[F.col(f"e.{k}")[i].alias(f"{'xy'[i]}{k}") for k in "pq" for i in (0, 1)])
    # an edge and a point within the tolerance share a cell of its latitude band, widened by one on both sides
    cell = lambda y: F.floor(y / snap_degrees).cast("bigint")
    edge = edge.withColumn("band", F.explode(F.sequence(cell(F.least("yp", "yq")) - 1, cell(F.greatest("yp", "yq")) + 1)))
    near = outside.withColumn("band", cell(F.col("lat"))).join(edge, "band").where(f"lon >= least(xp, xq) - {snap_degrees} and lon <= greatest(xp, xq) + {snap_degrees}")
    dx, dy = F.col("xq") - F.col("xp"), F.col("yq") - F.col("yp")
    length = dx * dx + dy * dy
    along = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("lon") - F.col("xp")) * dx + (F.col("lat") - F.col("yp")) * dy) / F.nullif(length, F.lit(0.0)))))
    away = F.pow(F.col("lon") - (F.col("xp") + along * dx), 2) + F.pow(F.col("lat") - (F.col("yp") + along * dy), 2)
    snapped = near.withColumn("away", away).where(F.col("away") < snap_degrees * snap_degrees).groupBy("id").agg(F.min_by("country", F.struct("away", "region_id")).alias("country"))
    return inside.unionByName(snapped)
