"""Timestamps against Python's own time zones, and the edge cases one by one."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shutterlake.operators.timestamps import count_to_ms, estimate_zones, normalise_timestamps, with_reading
from tests.helpers import rows


def ms(*a, zone="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000)


LOCAL = [
    ("2020:06:15 12:00:00", "Europe/Madrid", None, ms(2020, 6, 15, 12, zone="Europe/Madrid")),
    (" 2020:06:15 12:00:00\x00", "Europe/Madrid", None, ms(2020, 6, 15, 12, zone="Europe/Madrid")),
    ("2020:06:15 12:00", "Asia/Kathmandu", None, ms(2020, 6, 15, 12, zone="Asia/Kathmandu")),
    ("05.03.2021 04:05:06", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6, zone="Asia/Tokyo")),
    ("20210305_040506", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6, zone="Asia/Tokyo")),
    ("05-Mar-2021 04:05:06", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6, zone="Asia/Tokyo")),
    ("Mar 5, 2021 12:05:06 AM", "Asia/Tokyo", None, ms(2021, 3, 5, 0, 5, 6, zone="Asia/Tokyo")),
    ("Mar 5, 2021 12:05:06 PM", "Asia/Tokyo", None, ms(2021, 3, 5, 12, 5, 6, zone="Asia/Tokyo")),
    ("Fri Mar 05 04:05:06 2021", "UTC", None, ms(2021, 3, 5, 4, 5, 6)),
    ("2021-03-05T04:05:06.789", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6, zone="Asia/Tokyo") + 789),
    ("2021-03-05T04:05:06.789+05:45", "Asia/Tokyo", None, ms(2021, 3, 4, 22, 20, 6) + 789),
    ("2021-03-05 04:05:06 -0430", "Asia/Tokyo", None, ms(2021, 3, 5, 8, 35, 6)),
    ("2021-03-05T04:05:06-05:00[America/New_York]", "Asia/Tokyo", None, ms(2021, 3, 5, 9, 5, 6)),
    ("2021-03-05T04:05:06Z", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6)),
    ("2021:03:05 04:05:06 GMT", "Asia/Tokyo", None, ms(2021, 3, 5, 4, 5, 6)),
    ("1614917106", "Asia/Tokyo", None, 1614917106000),
    ("1614917106123", "Asia/Tokyo", None, 1614917106123),
    # twice: the occurrence nearest to the mtime, the first without one
    ("2021:11:07 01:30:00", "America/New_York", ms(2021, 11, 7, 1, 31, zone="America/New_York", fold=1), ms(2021, 11, 7, 1, 30, zone="America/New_York", fold=1)),
    ("2021:11:07 01:30:00", "America/New_York", ms(2021, 11, 7, 1, 31, zone="America/New_York"), ms(2021, 11, 7, 1, 30, zone="America/New_York")),
    ("2021:11:07 01:30:00", "America/New_York", None, ms(2021, 11, 7, 1, 30, zone="America/New_York")),
    ("2021:04:04 02:15:00", "Australia/Lord_Howe", None, ms(2021, 4, 4, 2, 15, zone="Australia/Lord_Howe")),
    # never, impossible, placeholders, out of range, unknown zone
    ("2021:03:14 02:30:00", "America/New_York", None, None), ("2019:02:30 10:15:00", "UTC", None, None), ("2018:06:30 25:10:00", "UTC", None, None), ("2018:06:30 10:10:60", "UTC", None, None),
    ("0000:00:00 00:00:00", "UTC", None, None), ("    :  :     :  :  ", "UTC", None, None), ("", "UTC", None, None), ("unknown", "UTC", None, None), ("n/a", "UTC", None, None), (None, "UTC", None, None),
    ("2009:12:31 23:59:59", "UTC", None, None), ("2031:01:01 00:00:00", "UTC", None, None), ("2030:12:31 23:59:59", "UTC", None, ms(2030, 12, 31, 23, 59, 59)), ("2020:06:15 12:00:00", None, None, None),
]


def test_every_spelling(spark):
    data = [(k, k if z else None, (near or 0) / 1000.0, text) for k, (text, z, near, _) in enumerate(LOCAL)]
    zones = spark.createDataFrame([(k, z) for k, (_, z, _, _) in enumerate(LOCAL) if z], "source int, zone string")
    records = spark.createDataFrame(data, "key bigint, source int, stored double, text string")
    found = {r["key"]: r["utc_ms"] for r in normalise_timestamps(records, zones, {"t": ("text", "local")}).collect()}
    assert found == {k: want for k, (_, _, _, want) in enumerate(LOCAL) if want is not None}


def test_unknown_zone_is_estimated_not_an_error(spark):
    zones = spark.createDataFrame([(1, "Mars/Olympus"), (2, "Asia/Tokyo"), (3, "America/Bogota")], "source int, zone string")
    wall = [(1, ms(2020, m, 3, 5, zone="Asia/Tokyo") / 1000, f"2020:{m:02d}:03 05:00:00") for m in range(1, 10)]
    records = spark.createDataFrame([(k, s, m, t) for k, (s, m, t) in enumerate(wall)], "key bigint, source int, stored double, text string")
    found = normalise_timestamps(records, zones, {"t": ("text", "local")})
    assert rows(found.select("utc_ms")) == {(int(m * 1000),) for _, m, _ in wall}


@pytest.mark.parametrize("zone", ["Asia/Kathmandu", "America/New_York", "Australia/Sydney", "Europe/Madrid"])
def test_zone_estimation_recovers_a_hidden_zone(spark, zone):
    candidates = ["Asia/Kathmandu", "America/New_York", "Australia/Sydney", "Europe/Madrid", "America/Bogota"]
    data = []
    for k in range(400):
        instant = 1_577_836_800 + k * 86_400 * 2 + k * 977
        local = datetime.fromtimestamp(instant, timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=timezone.utc)
        late = 0 if k % 3 else 40 * 86_400  # a third is stored long after
        data.append(("a", int(local.timestamp() * 1000), (instant + late) * 1000))
    df = spark.createDataFrame(data, "source string, wall_ms bigint, stored_ms bigint")
    best = estimate_zones(df, list(candidates)).collect()
    assert [(r["zone"], r["violations"]) for r in best] == [(zone, 0)]


def test_counts_in_any_unit(spark):
    data = [(1614917106.5,), (1614917106500.0,), (1614917106500000.0,), (1.6149171065e18,), (0.0,), (-1.0,), (None,), (float("nan"),), (1.0,)]
    got = [r[0] for r in spark.createDataFrame(data, "x double").select(count_to_ms(F.col("x"))).collect()]
    assert got == [1614917106500] * 4 + [None] * 5


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "key bigint, source int, stored double, text string, zone string, utc_ms string")
    zones = spark.createDataFrame([], "source int, zone string")
    assert normalise_timestamps(empty, zones, {"t": ("text", "local")}).count() == 0
    assert with_reading(empty, "text", "r").count() == 0


def test_hidden_zones_of_the_libraries_are_found_or_reported_unknown(spark):
    """No library's zone is read wrongly; dates of those that can't be told are left out, all others equal those by the given zones."""
    from shutterlake.plans import found

    zones = found.p4_zones(spark, "/root/testdata/sf0.1").toPandas()
    assert zones["agrees"].dropna().all() and zones["estimated_zone"].notna().sum() >= 50
    d = "/root/testdata/sf0.001"
    given = {tuple(r) for r in found.p4_found(spark, d).where("field_name = 'date_taken'").collect()}
    hidden = {tuple(r) for r in found.p4_hidden(spark, d).collect()}
    assert 0 < len(hidden) <= len(given) and len(hidden - given) <= 0.01 * len(given)


def test_equally_likely_zones_are_unknown_unless_they_read_alike(spark):
    summer = [(s, ms(2021, 7, d, 12), ms(2021, 7, d, 16)) for s in ("a", "b") for d in range(1, 20)]
    winter = [("b", ms(2021, 1, d, 12), ms(2025, 1, d, 12)) for d in range(1, 5)]
    df = spark.createDataFrame([(s, int(w), int(i)) for s, w, i in summer + winter], "source string, wall_ms bigint, stored_ms bigint")
    got = {r["source"]: r["zone"] for r in estimate_zones(df).collect()}
    assert got["a"] is not None and got["b"] is None
