"""Timestamps written in many ways, brought to one instant in UTC.

Reading (:func:`with_reading`) gives the wall clock and, where the text has
one, the offset. A wall clock without offset takes the offset history of its
source: the one given, or the one that :func:`estimate_zones` finds by aligning
wall clocks with the instants at which the files were stored. Everything runs on
built-in functions and doesn't depend on the session's time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.barrier import sealed
from shutterlake.sources.tables import materialize

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
DAY_MS = 86_400_000
#: No real instant lies before the first or after the last of these years, unless others are given.
YEARS = (2010, 2030)
#: Year, month, day, hour, minute, second, fraction, half of the day, offset.
FULL = r"^(\d{4})[:/-](\d{1,2})[:/-](\d{1,2})[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?\s*([Zz]|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?(?:\[[A-Za-z0-9_+/-]+\])?$"
DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[T ]+"
COMPACT = r"^(\d{4})(\d{2})(\d{2})[_ T-]?(\d{2})(\d{2})(\d{2})(?!\d)"
DAY_NAME = r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ](\d{4})[T ]+(.*)$"
NAME_DAY = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4}) +(.*)$"
UNIX = r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\d{4})$"


def _plain(text: Column) -> Column:
    """Any known spelling as 'yyyy-MM-dd clock rest'; other text stays as it is."""

    def named(pattern: str, year: int, month: int, day: int, rest: int) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        at = F.position(F.initcap(part(month)), F.lit(MONTHS))
        number = F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
        return F.concat(part(year), F.lit("-"), number, F.lit("-"), part(day), F.lit(" "), part(rest))

    return (
        F.when(text.rlike(r"^\d{4}[:/-]"), text)
        .when(text.rlike(DOTTED), F.regexp_replace(text, DOTTED, "$3-$2-$1 "))
        .when(text.rlike(COMPACT), F.regexp_replace(text, COMPACT, "$1-$2-$3 $4:$5:$6"))
        .when(text.rlike(DAY_NAME), named(DAY_NAME, 3, 2, 1, 4))
        .when(text.rlike(NAME_DAY), named(NAME_DAY, 3, 1, 2, 4))
        .when(text.rlike(UNIX), named(UNIX, 4, 1, 2, 3))
    )


def in_range(ms: Column, years: tuple[int, int] = YEARS) -> Column:
    """``ms`` if it lies in one of ``years``, first to last, else null."""
    first, end = (datetime(y, 1, 1, tzinfo=timezone.utc).timestamp() * 1000 for y in (years[0], years[1] + 1))
    return F.when((ms >= F.lit(int(first))) & (ms < F.lit(int(end))), ms)


def count_to_ms(count: Column, years: tuple[int, int] = YEARS) -> Column:
    """A count since 1970 in seconds, milli-, micro- or nanoseconds as milliseconds; null for unset, unreal or NaN."""
    count = F.when(~F.isnan(count.cast("double")), count)
    ms = F.when(count < 1e11, F.round(count * 1000)).when(count < 1e14, F.round(count)).when(count < 1e17, F.round(count / 1000)).otherwise(F.round(count / 1_000_000))
    return in_range(F.when((count > 0) & (count < 1e20), ms).cast("bigint"), years)


def with_reading(df: DataFrame, column: str, out: str, years: tuple[int, int] = YEARS) -> DataFrame:
    """``df`` with ``out``, the struct (wall_ms, offset_ms, instant_ms) of a text column.

    ``wall_ms`` is the wall clock counted as if it were UTC, ``offset_ms`` the
    offset in the text, ``instant_ms`` a count of seconds or finer. All are null
    for placeholders and dates that don't exist. Missing seconds are 0, digits
    beyond milliseconds are cut, dotted dates put the day first. Each step is a
    projection of its own, so that no regular expression is evaluated twice.
    """
    keep = df.columns
    c = F.col
    step = df.withColumn("_text", F.trim(F.regexp_replace(c(column), r"[\s\p{Cntrl}\u00a0]+", " ")))
    step = step.withColumn("_plain", _plain(c("_text")))
    step = step.withColumn("_parts", F.when(c("_plain").rlike(FULL), F.split(F.regexp_replace("_plain", FULL, "$1|$2|$3|$4|$5|$6|$7|$8|$9|"), r"\|")))
    part = lambda k: F.get(c("_parts"), F.lit(k))
    step = step.select(
        *keep,
        "_text",
        F.try_to_timestamp(F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), F.lit("yyyy-MM-dd")).cast("date").alias("_day"),
        *[part(k).try_cast("int").alias(n) for k, n in ((3, "_hour"), (4, "_minute"))],
        F.when(part(5) == "", 0).otherwise(part(5).try_cast("int")).alias("_second"),
        F.when(part(6) == "", 0).otherwise(F.rpad(F.substring(part(6), 1, 3), 3, "0").try_cast("int")).alias("_milli"),
        F.lower(part(7)).alias("_half"),
        F.upper(part(8)).alias("_zone"),
        F.regexp_replace(part(8), "[+:-]", "").alias("_digits"),
    )
    hour = F.when(c("_half") == "", c("_hour")).when(c("_hour").between(1, 12), c("_hour") % 12 + F.when(c("_half") == "pm", 12).otherwise(0))
    step = step.withColumn("_hour", hour).withColumn("_away", (F.substring("_digits", 1, 2).try_cast("int") * 60 + F.coalesce(F.substring("_digits", 3, 2).try_cast("int"), F.lit(0))) * 60_000)
    clock = F.when(c("_hour").between(0, 23) & c("_minute").between(0, 59) & c("_second").between(0, 59), ((c("_hour") * 60 + c("_minute")) * 60 + c("_second")) * 1000 + c("_milli"))
    offset = F.when(c("_zone").isin("Z", "UTC", "GMT"), 0).when(c("_away") <= 18 * 3_600_000, F.when(c("_zone").startswith("-"), -c("_away")).otherwise(c("_away")))
    step = step.withColumn("_clock", clock).withColumn("_offset", offset.cast("bigint"))
    wall = F.when((c("_zone") == "") | c("_offset").isNotNull(), F.unix_date("_day").cast("bigint") * DAY_MS + c("_clock"))
    count = F.when(c("_text").rlike(r"^\d{9,10}$|^\d{12,13}$|^\d{15,16}$|^\d{18,19}$"), c("_text").try_cast("double"))
    step = step.withColumn("_count", count)
    return step.select(*keep, F.struct(sealed(wall).alias("wall_ms"), c("_offset").alias("offset_ms"), count_to_ms(c("_count"), years).alias("instant_ms")).alias(out))


def offset_at(instant_ms: Column, zone: Column) -> Column:
    """The zone's offset from UTC at an instant, in milliseconds."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(instant_ms), zone)) - instant_ms


def with_instant(df: DataFrame, reading: str, zone: Column, near: str, out: str, years: tuple[int, int] = YEARS) -> DataFrame:
    """``df`` with ``out``, the milliseconds in UTC of a reading: its count, else its offset, else its wall clock in ``zone``.

    A wall clock that occurs twice is the occurrence nearest to ``near`` (the
    first if that is null or as near); one that never occurs is null. The
    offsets a bit more than a day before and after are the only ones the wall
    clock can have.
    """
    keep = [x for x in df.columns if x != out]
    c = F.col
    wall = c(f"{reading}.wall_ms")
    step = df.withColumn("_zone", zone).withColumn("_wall", F.when(c(f"{reading}.offset_ms").isNull() & c(f"{reading}.instant_ms").isNull() & c("_zone").isNotNull() & (wall > 0), wall))
    aside = lambda sign: c("_wall") - offset_at(c("_wall") + F.lit(sign * 26 * 3_600_000), c("_zone"))
    step = step.withColumn("_first", aside(-1)).withColumn("_second", aside(1))
    holds = lambda i: F.when(c(i) + offset_at(c(i), c("_zone")) == c("_wall"), c(i))
    step = step.withColumn("_first", holds("_first")).withColumn("_second", holds("_second"))
    later = F.abs(c("_second") - c(near)) < F.abs(c("_first") - c(near))
    local = F.when(c("_first").isNull() | F.coalesce(later, F.lit(False)), c("_second")).otherwise(c("_first"))
    step = step.withColumn("_ms", F.coalesce(c(f"{reading}.instant_ms"), wall - c(f"{reading}.offset_ms"), local))
    return step.select(*keep, sealed(in_range(c("_ms"), years)).alias(out))


def known_zones(spark: SparkSession) -> DataFrame:
    """IANA names, some 500 and fixed, so that an unknown name is null rather than an error."""
    return spark.createDataFrame([(z,) for z in sorted(available_timezones()) if "/" in z or z == "UTC"], "zone string")


@lru_cache(maxsize=4)
def offset_histories(years: tuple[int, int] = YEARS) -> tuple[list[int], dict[str, list[int]], dict[str, int]]:
    """(starts, histories, sharers): the instants (ms) at which any zone changes its offset, and each zone's offset (ms) from each start on.

    Of zones that never differ in these years the first by name stands for all, ``sharers`` of them:
    some 150 histories of some hundreds of stretches, whatever the data.
    """
    first, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (years[0], years[1] + 1))
    changes: dict[str, list[tuple[int, int]]] = {}
    for name in sorted(z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "posix/", "right/", "SystemV/")) or z == "UTC"):
        zone = ZoneInfo(name)
        offset = lambda t: int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())  # noqa: B023, E731
        steps = [(first - 2 * 86400, offset(first - 2 * 86400))]
        for t in range(first - 2 * 86400, end + 2 * 86400, 7 * 86400):
            low, high = t, t + 7 * 86400
            if offset(high) != steps[-1][1]:
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if offset(mid) == steps[-1][1] else (low, mid)
                steps.append((high, offset(high)))
        changes[name] = steps
    starts = sorted({t for steps in changes.values() for t, _ in steps})
    out: dict[tuple[int, ...], str] = {}
    sharers: dict[str, int] = {}
    for name, steps in changes.items():
        at = np.searchsorted([t for t, _ in steps], starts, side="right") - 1
        first_name = out.setdefault(tuple(steps[k][1] * 1000 for k in at), name)
        sharers[first_name] = sharers.get(first_name, 0) + 1
    return [t * 1000 for t in starts], {name: list(h) for h, name in out.items()}, sharers


def estimate_zones(df: DataFrame, candidates: list[str] | None = None, source: str = "source", wall: str = "wall_ms", stored: str = "stored_ms", slack_ms: int = 300_000, least: int = 5, years: tuple[int, int] = YEARS) -> DataFrame:
    """The likeliest zone of each source with a reading: (source, zone, aligned, violations, rival).

    ``df`` has wall clocks without offset and the instants at which the files
    were stored. A row tells something if the two are at most 15 hours apart;
    it violates an offset history where the wall clock, read by it, isn't within
    ``slack_ms`` of the stored instant. The zone with the fewest violations
    wins (on ties the history that more zones share, then the name), of all zones there are unless ``candidates`` are given;
    zones with one history are one, named by the first of them (of the candidates, if given).
    ``zone`` is null, as nothing is sure then, if fewer than ``least`` rows
    align, or not more than don't, or if histories that align as well would
    read any of the source's wall clocks otherwise. ``rival`` is the best other
    history's aligned rows.
    Rows are counted by stretch of time and difference first, so what meets the
    histories doesn't grow with the rows.
    """
    starts, histories, sharers = offset_histories(years)
    if candidates is not None:
        named: dict[str, list[int]] = {}
        seen: set[tuple[int, ...]] = set()
        for name in sorted(set(candidates) & available_timezones()):
            zone = ZoneInfo(name)
            own = tuple(int(datetime.fromtimestamp(t / 1000, zone).utcoffset().total_seconds()) * 1000 for t in starts)
            if own not in seen:
                seen.add(own)
                named[name] = list(own)
        histories = named
    table = df.sparkSession.createDataFrame([(z, sharers.get(z, 1), k, o) for z, h in histories.items() for k, o in enumerate(h)], "zone string, _sharers int, _stretch int, _gap bigint")
    stretch = F.pandas_udf(lambda at: pd.Series(np.searchsorted(starts, at.to_numpy(), side="right").astype("int32") - 1), "int")
    gap, quarter = F.col(wall) - F.col(stored), 900_000
    near = df.where(F.col(source).isNotNull() & (F.abs(gap) <= 15 * 3_600_000)).select(source, (F.round(gap / quarter) * quarter).cast("bigint").alias("_gap"), gap.alias("_apart"), F.col(wall).alias("_wall"))
    near = near.withColumn("_exact", F.abs(F.col("_apart") - F.col("_gap")) <= slack_ms)
    counted = near.groupBy(source, stretch(F.col("_wall") - F.col("_gap")).alias("_stretch"), "_gap").agg(F.count_if("_exact").alias("_fit"), F.count(F.lit(1)).alias("_n"))
    counted = materialize(counted, "gaps")
    every = counted.groupBy(source).agg(F.sum("_n").alias("_all"))
    fits = counted.join(F.broadcast(table), ["_stretch", "_gap"]).groupBy(source, "zone").agg(F.sum("_fit").alias("aligned"), F.first("_sharers").alias("_sharers"))
    fits = materialize(fits, "aligned")
    # the two best histories of a source: at most as many rows a source as there are histories
    best = fits.groupBy(source).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("aligned")).alias("n"), (-F.col("_sharers")).alias("s"), "zone"))), 1, 2).alias("_b"))
    # those that align equally well, and whether they read all wall clocks of the source alike
    tied = fits.join(fits.groupBy(source).agg(F.max("aligned").alias("aligned")), [source, "aligned"], "left_semi").select(source, "zone")
    held = df.where(F.col(source).isNotNull() & F.col(wall).isNotNull()).groupBy(source, stretch(F.col(wall)).alias("_stretch")).agg(F.count(F.lit(1)).alias("_walls"))
    read = tied.join(held, source).join(F.broadcast(table.drop("_sharers")), ["zone", "_stretch"]).groupBy(source, "zone").agg(F.sum(F.shiftright(F.xxhash64("_stretch", "_gap"), 12)).alias("_read"))
    ways = read.groupBy(source).agg(F.count_distinct("_read").alias("_ways"))
    out = every.join(best, source, "left").join(ways, source, "left").withColumn("aligned", F.coalesce(-F.get("_b", F.lit(0))["n"], F.lit(0))).withColumn("violations", F.col("_all") - F.col("aligned"))
    sure = (F.col("aligned") >= least) & (F.col("aligned") > F.col("violations")) & (F.coalesce("_ways", F.lit(0)) == 1)
    return out.select(source, F.when(sure, F.get("_b", F.lit(0))["zone"]).alias("zone"), "aligned", "violations", F.coalesce(-F.get("_b", F.lit(1))["n"], F.lit(0)).alias("rival"))


def assign_zones(df: DataFrame, given: DataFrame, source: str = "source", wall: str = "wall_ms", stored: str = "stored_ms", years: tuple[int, int] = YEARS) -> DataFrame:
    """``df`` with a column zone: the source's given zone, else the estimated one, else null (its wall clocks then denote nothing).

    ``given`` has one row for each source (``source``, zone); a null or unknown
    name there, or no row, means that the zone is to be estimated among all zones.
    """
    names = known_zones(df.sparkSession)
    told = given.select(source, "zone").join(F.broadcast(names.withColumn("_ok", F.lit(True))), "zone", "left").select(source, F.when(F.col("_ok"), F.col("zone")).alias("_given"))
    told = told.where(F.col(source).isNotNull()).groupBy(source).agg(F.max("_given").alias("_given"))
    unknown = df.where(F.col(wall).isNotNull()).join(told.where("_given is not null"), source, "left_anti")
    guessed = estimate_zones(unknown, None, source, wall, stored, years=years).select(source, F.col("zone").alias("_guess"))
    return df.join(told, source, "left").join(guessed, source, "left").withColumn("zone", F.coalesce("_given", "_guess")).drop("_given", "_guess")


def normalise_timestamps(records: DataFrame, given: DataFrame, fields: dict[str, tuple[str, str]], years: tuple[int, int] = YEARS) -> DataFrame:
    """(field_name, key, utc_ms): one row for each value that denotes an instant, none outside ``years``.

    ``records`` has key, source, stored (a count since 1970 in any unit) and the
    columns of ``fields``: name -> (column, rule). The rule is 'count', 'utc'
    (a wall clock without zone is UTC) or 'local' (it is the source's).
    """
    stored = records.withColumn("_stored_ms", count_to_ms(F.col("stored"), years))
    out = []
    for name, (column, rule) in fields.items():
        part = stored.where(F.col(column).isNotNull()).select("key", "source", "_stored_ms", F.col(column).alias("_value"))
        if rule == "count":
            part = part.withColumn("utc_ms", sealed(count_to_ms(F.col("_value"), years)))
        else:
            part = with_reading(part, "_value", "_read", years)
            if rule == "local":
                part = part.withColumn("_wall_ms", F.when(F.col("_read.offset_ms").isNull(), F.col("_read.wall_ms")))
                part = assign_zones(part, given, "source", "_wall_ms", "_stored_ms", years)
            part = with_instant(part, "_read", F.col("zone") if rule == "local" else F.lit("UTC"), "_stored_ms", "utc_ms", years)
        out.append(part.where(F.col("utc_ms").isNotNull()).select(F.lit(name).alias("field_name"), "key", "utc_ms"))
    return reduce(DataFrame.unionByName, out)
