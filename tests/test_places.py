"""Points near points and in regions, against brute force."""

import numpy as np
import pytest

from shutterlake.functions.geo import with_iso6709
from shutterlake.operators.geocode import countries_of
from shutterlake.operators.places import arc_m, near_pairs, regions_by_band, regions_of
from tests.helpers import rows

POINTS = "id bigint, lat double, lon double"


def brute(points, radius):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and arc_m(*(np.array([x]) for x in (a[1], a[2], b[1], b[2])))[0] <= radius}


@pytest.mark.parametrize("per_leaf", [10, 20_000])
def test_near_pairs(spark, per_leaf):
    rng = np.random.default_rng(3)
    centres = [(10, 20), (-89.9995, 0), (89.9999, 50), (0, 179.9999), (0, -179.9999), (45, 0)]
    points = [(k, float(np.clip(la + rng.normal(0, 0.002), -90, 90)), float(lo + rng.normal(0, 0.002))) for k, (la, lo) in enumerate(centres * 40)]
    points = [(k, la, lo - 360 if lo > 180 else lo + 360 if lo < -180 else lo) for k, la, lo in points]
    points += [(1000 + k, 45.0, 0.0) for k in range(30)]  # a shared spot
    got = near_pairs(spark.createDataFrame(points, POINTS), 150.0, rows_per_leaf=per_leaf).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute(points, 150.0)


def test_near_pairs_of_nothing(spark):
    assert near_pairs(spark.createDataFrame([], POINTS), 150.0).count() == 0
    assert near_pairs(spark.createDataFrame([(1, 2.0, 3.0)], POINTS), 150.0).count() == 0


SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
SHIFTED = [[175.0, -5.0], [185.0, -5.0], [185.0, 5.0], [175.0, 5.0], [175.0, -5.0]]
REGIONS = [(1, "Ring", 0.0, 0.0, 10.0, 10.0, [[SQUARE, HOLE]]), (2, "Pond", 4.0, 4.0, 6.0, 6.0, [[HOLE]]), (3, "Dateline", 175.0, -5.0, 185.0, 5.0, [[SHIFTED]]), (4, "None", None, None, None, None, None)]
SHAPE = "region_id bigint, country string, bbox_w double, bbox_s double, bbox_e double, bbox_n double, polys array<array<array<array<double>>>>"
SPOTS = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.0, 20.0), (4, 0.0, 179.0), (5, 0.0, -179.0), (6, 5.0, 10.05), (7, 5.0, 10.2)]


def test_regions_both_ways(spark):
    points, regions = spark.createDataFrame(SPOTS, POINTS), spark.createDataFrame(REGIONS, SHAPE)
    want = {(1, 1), (2, 2), (4, 3), (5, 3)}
    assert rows(regions_of(points, regions)) == want
    assert rows(regions_by_band(points, regions)) == want
    assert rows(regions_of(points, regions, most_vertices=1)) == want
    assert regions_of(points.limit(0), regions).count() == 0


def test_country_snaps_to_a_near_border(spark):
    points, regions = spark.createDataFrame(SPOTS, POINTS), spark.createDataFrame(REGIONS, SHAPE)
    assert rows(countries_of(points, regions)) == {(1, "Ring"), (2, "Pond"), (4, "Dateline"), (5, "Dateline"), (6, "Ring")}


def test_iso6709(spark):
    texts = {"+37.7857-122.4011+010.000/": (37.7857, -122.4011), " +2056.9894+07641.2711": (20.949823, 76.687852), "-544726.15+0172427.61": (-54.790597, 17.407669), "+00.0000+000.0000/": (0.0, 0.0), "+0160.0+00000.0/": None, "+12.5": None, "unknown": None, "": None, None: None, "+00.1088+042.1687+0124.500CRSWGS_84/": (0.1088, 42.1687)}
    got = with_iso6709(spark.createDataFrame([(t,) for t in texts], "location string"), "location").collect()
    for r in got:
        want = texts[r["location"]]
        assert (r["lat"], r["lon"]) == (want if want is None else pytest.approx(want, abs=1e-6)) if want else r["lat"] is None or r["lon"] is None
