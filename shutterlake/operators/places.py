"""Points near other points, and the regions that contain points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.skew import salted_join
from shutterlake.sources.tables import materialize

EARTH_M = 6_371_008.8


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def arc_m(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Great-circle distance in metres."""
    a, b = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def split_space(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree over sampled unit vectors: nodes (axis, cut, low, high), where a child below 0 is leaf ``-child - 1``."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal count
        if parts <= 1 or len(points) < 2:
            count += 1
            return -count
        axis = int(np.argmax(points.max(0) - points.min(0)))
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] < cut
        if low.all() or not low.any():
            count += 1
            return -count
        nodes.append((axis, cut, 0, 0))
        me = len(nodes) - 1
        a, b = grow(points[low], parts // 2), grow(points[~low], parts - parts // 2)
        nodes[me] = (axis, cut, a, b)
        return me

    root = grow(sample, leaves)
    return nodes if root >= 0 else []


def route(points: np.ndarray, nodes: list[tuple[int, float, int, int]], chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, owned): each point's own leaf, and a halo copy for every leaf whose cell comes within ``chord``."""
    rows, leaves, owned = [], [], []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if node < 0:
            rows.append(at)
            leaves.append(np.full(len(at), -node - 1))
            owned.append(own)
            continue
        axis, cut, low, high = nodes[node]
        x = points[at, axis]
        below = x < cut
        for child, mine, near in ((low, below, x < cut + chord), (high, ~below, x >= cut - chord)):
            todo.append((child, at[near], (own & mine)[near]))
    if not rows:
        return np.array([], int), np.array([], int), np.array([], bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(owned)


def kd_pairs(points: np.ndarray, ids: np.ndarray, owned: np.ndarray, chord: float, leaf: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) within ``chord`` with ``a`` owned and ids[a] < ids[b], by descending a k-d tree of medians."""
    left, right = [], []
    todo = [(np.flatnonzero(owned), np.arange(len(points)))]
    while todo:
        own, near = todo.pop()
        if not len(own) or not len(near):
            continue
        if len(near) > leaf:
            cloud = points[near]
            axis = int(np.argmax(cloud.max(0) - cloud.min(0)))
            cut = float(np.median(cloud[:, axis]))
            x, y = points[own, axis], cloud[:, axis]
            halves = [(own[x < cut], near[y <= cut + chord]), (own[x >= cut], near[y >= cut - chord])]
            if max(len(n) for _, n in halves) < len(near):
                todo += halves
                continue
        for start in range(0, len(own), 1024):  # one dense spot: in blocks
            block = own[start : start + 1024]
            for s in range(0, len(near), 4096):
                other = near[s : s + 4096]
                d2 = ((points[block, None, :] - points[None, other, :]) ** 2).sum(-1)
                i, j = np.nonzero((d2 <= chord * chord) & (ids[block][:, None] < ids[other][None, :]))
                left.append(block[i])
                right.append(other[j])
    none = np.array([], int)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_pairs(points: DataFrame, radius_m: float, rows_per_leaf: int = 20_000, most_sampled: int = 262_144) -> DataFrame:
    """(left_id, right_id): each two ids, left_id < right_id, at most ``radius_m`` apart.

    ``points`` has id, lat, lon, each id once and only real positions. Equal
    positions are taken together first, so a spot with very many ids costs no
    more to search than any other; its pairs come from a salted join. The k-d
    splits are fitted on some 16 positions a leaf, drawn by hash, at most
    ``most_sampled``, which allows for some 16,000 leaves; every position is
    routed, with halo copies beside the cuts.
    """
    spark = points.sparkSession
    members = points.select("lat", "lon", "id")
    spots = materialize(members.groupBy("lat", "lon").agg(F.min("id").alias("spot"), F.count(F.lit(1)).alias("n")), "spots")
    count = spots.count()
    wanted = max(1, -(-count // rows_per_leaf))
    every = max(1, count // max(4096, min(most_sampled // 2, 16 * wanted)))
    sample = spots.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(every)) == 0).select("lat", "lon").limit(most_sampled).toPandas()
    leaves = max(1, min(len(sample) // 8, wanted))
    chord = 2 * np.sin(radius_m / EARTH_M / 2) * (1 + 1e-6) + 1e-12
    nodes = split_space(unit_vectors(sample["lat"].to_numpy(float), sample["lon"].to_numpy(float)), leaves)

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row, leaf, own = route(unit_vectors(frame["lat"].to_numpy(float), frame["lon"].to_numpy(float)), nodes, chord)
            yield frame.iloc[row].assign(leaf=leaf.astype("int32"), owned=own)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        lat, lon, ids = frame["lat"].to_numpy(float), frame["lon"].to_numpy(float), frame["spot"].to_numpy()
        a, b = kd_pairs(unit_vectors(lat, lon), ids, frame["owned"].to_numpy(bool), chord)
        keep = arc_m(lat[a], lon[a], lat[b], lon[b]) <= radius_m
        return pd.DataFrame({"spot_a": ids[a[keep]], "spot_b": ids[b[keep]]})

    parts = spots.select("spot", "lat", "lon").mapInPandas(routed, "spot bigint, lat double, lon double, leaf int, owned boolean")
    pairs = parts.groupBy("leaf").applyInPandas(joined, "spot_a bigint, spot_b bigint")
    pairs = pairs.unionByName(spots.where("n > 1").select(F.col("spot").alias("spot_a"), F.col("spot").alias("spot_b")))
    at = materialize(members.join(spots.select("lat", "lon", "spot"), ["lat", "lon"]).select("spot", "id"), "spot-members")
    one = salted_join(pairs, at.select(F.col("spot").alias("spot_a"), F.col("id").alias("a")), ["spot_a"])
    both = salted_join(one, at.select(F.col("spot").alias("spot_b"), F.col("id").alias("b")), ["spot_b"])
    both = both.where("spot_a <> spot_b or a < b")
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


class Sweep:
    """The edges of one polygon's rings by the latitudes between which they are active."""

    def __init__(self, rings: list[list[list[float]]]) -> None:
        edges = [(x1, y1, x2, y2) for ring in rings for (x1, y1), (x2, y2) in zip(ring, list(ring[1:]) + [ring[0]]) if y1 != y2]
        self.edges = np.array([(x1, y1, x2, y2) if y1 < y2 else (x2, y2, x1, y1) for x1, y1, x2, y2 in edges], float).reshape(-1, 4)
        self.levels = np.unique(self.edges[:, [1, 3]])
        # events in order of latitude: an edge comes in at its lower end and goes out at its upper one; between two levels the active edges don't change
        begin, end = (np.searchsorted(self.levels, self.edges[:, k]) for k in (1, 3))
        span = end - begin
        level = np.repeat(begin, span) + np.arange(span.sum()) - np.repeat(span.cumsum() - span, span)
        order = np.argsort(level, kind="stable")
        self.active, self.bounds = np.repeat(np.arange(len(self.edges)), span)[order], np.searchsorted(level[order], np.arange(len(self.levels) + 1))
        self.west, self.east = (self.edges[:, [0, 2]].min(), self.edges[:, [0, 2]].max()) if len(edges) else (0.0, 0.0)

    def contains(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Sweep upwards over points sorted by latitude; a point is inside if an odd number of active edges lies east of it. Holes count as edges."""
        inside = np.zeros(len(lat), bool)
        if len(self.levels) < 2:
            return inside
        for turn in (0, *([360] if self.east > 180 else []), *([-360] if self.west < -180 else [])):
            x = lon + turn
            stops = np.searchsorted(lat, self.levels)
            for k in range(len(self.levels) - 1):
                a, b = stops[k], stops[k + 1]
                if a == b:
                    continue
                e = self.edges[self.active[self.bounds[k] : self.bounds[k + 1]]]
                cross = e[:, 0] + (lat[a:b, None] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
                inside[a:b] |= (cross > x[a:b, None]).sum(1) % 2 == 1
        return inside


def regions_of(points: DataFrame, regions: DataFrame, most_vertices: int = 200_000) -> DataFrame:
    """(id, region_id): the regions with a polygon that contains the point; ``points`` has id, lat, lon.

    Polygons of the regions (region_id, polys) go to every task, at most
    ``most_vertices`` vertices at once, and are swept over the points of each
    batch; further ones are swept in further passes over the points. Only a
    polygon that by itself exceeds the bound is joined by latitude band
    (:func:`regions_by_band`) instead. Null ids and shapes contain nothing.
    """
    polys = regions.where("region_id is not null").select("region_id", F.explode("polys").alias("rings")).where("rings is not null")
    polys = polys.withColumn("n", F.aggregate("rings", F.lit(0), lambda n, r: n + F.coalesce(F.size(r), F.lit(0))))
    passes, held, huge = [[]], 0, False
    for r in polys.select("region_id", "rings", "n").orderBy("region_id", "n").toLocalIterator():
        if r["n"] > most_vertices:
            huge = True
            continue
        if held + r["n"] > most_vertices and passes[-1]:
            passes.append([])
            held = 0
        passes[-1].append((r["region_id"], Sweep([[list(map(float, p)) for p in ring] for ring in r["rings"] if ring])))
        held += r["n"]
    out = [_swept(points, kept) for kept in passes]
    if huge:
        out.append(regions_by_band(points, polys.where(F.col("n") > most_vertices).groupBy("region_id").agg(F.collect_list("rings").alias("polys"))))
    found = reduce(DataFrame.unionByName, out)
    return found.distinct() if len(out) > 1 else found


def _swept(points: DataFrame, kept: list[tuple[int, Sweep]]) -> DataFrame:
    def swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("lat", kind="stable")
            lat, lon, ids = frame["lat"].to_numpy(float), frame["lon"].to_numpy(float), frame["id"].to_numpy()
            found: dict[int, np.ndarray] = {}
            for region, sweep in kept:
                inside = sweep.contains(lon, lat)
                found[region] = found[region] | inside if region in found else inside
            for region, inside in found.items():
                if inside.any():
                    yield pd.DataFrame({"id": ids[inside], "region_id": region})

    return points.select("id", "lat", "lon").mapInPandas(swept, "id bigint, region_id bigint")


def regions_by_band(points: DataFrame, regions: DataFrame, per_degree: int = 4) -> DataFrame:
    """The same by a join of points with the edges of their latitude band; nothing is sent to every task."""
    rings = regions.select("region_id", F.posexplode("polys").alias("poly", "rings")).select("region_id", "poly", F.explode("rings").alias("ring"))
    ends = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)).alias("q"))
    edge = rings.select("region_id", "poly", F.explode(ends).alias("e")).select("region_id", "poly", *[F.col(f"e.{k}")[i].alias(f"{'xy'[i]}{k}") for k in "pq" for i in (0, 1)]).where("yp <> yq")
    edge = edge.withColumns({"y1": F.least("yp", "yq"), "y2": F.greatest("yp", "yq"), "x1": F.expr("if(yp < yq, xp, xq)"), "x2": F.expr("if(yp < yq, xq, xp)")}).select("region_id", "poly", "x1", "y1", "x2", "y2")
    edge = edge.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") * per_degree), F.floor(F.col("y2") * per_degree))))
    turned = points.select("id", "lat", F.explode(F.array(F.col("lon"), F.col("lon") + 360, F.col("lon") - 360)).alias("x")).withColumn("band", F.floor(F.col("lat") * per_degree))
    hits = salted_join(edge, turned, ["band"]).where("lat >= y1 and lat < y2 and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > x")
    odd = hits.groupBy("id", "x", "region_id", "poly").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    return odd.select("id", "region_id").distinct()
