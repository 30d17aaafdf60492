"""Reading positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.barrier import sealed

ISO6709 = r"^([+-])(\d+)(\.\d+)?([+-])(\d+)(\.\d+)?(?:[+-][\d.]+)?(?:CRS[^/]*)?/?$"


def with_iso6709(df: DataFrame, column: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with the latitude and longitude of an ISO 6709 text in degrees, degrees and minutes, or with seconds; null if unusable.

    The digits before the point tell the form: 2, 4 or 6 of the latitude, 3, 5
    or 7 of the longitude. Minutes and seconds stay below 60. Altitude and
    reference system are ignored. Steps are projections of their own, so each
    expression is evaluated once.
    """
    keep = [x for x in df.columns if x not in (lat, lon)]
    text = F.regexp_replace(column, r"[\s\p{Cntrl}]+", "")
    step = df.withColumn("_parts", F.when(text.rlike(ISO6709), F.split(F.regexp_replace(text, ISO6709, "$1|$2|$3|$4|$5|$6|"), r"\|")))
    part = lambda k: F.get("_parts", F.lit(k))
    for name, k, width in (("_lat", 0, 2), ("_lon", 3, 3)):
        step = step.withColumns({f"{name}_sign": F.when(part(k) == "-", -1.0).otherwise(1.0), f"{name}_n": F.length(part(k + 1)) - width, f"{name}_rest": F.concat(F.lit("0"), part(k + 2)).try_cast("double")})
        step = step.withColumns({f"{name}_{unit}": F.substring(part(k + 1), start, n).try_cast("double") for unit, start, n in (("d", 1, width), ("m", width + 1, 2), ("s", width + 3, 2))})
    for name in ("_lat", "_lon"):
        of = lambda unit: F.col(f"{name}_{unit}")  # noqa: B023, E731
        n, rest = of("n"), of("rest")
        value = F.when(n == 0, of("d") + rest).when((n == 2) & (of("m") < 60), of("d") + (of("m") + rest) / 60)
        value = value.when((n == 4) & (of("m") < 60) & (of("s") < 60), of("d") + of("m") / 60 + (of("s") + rest) / 3600)
        step = step.withColumn(name, value * of("sign"))
    return step.select(*keep, sealed(F.col("_lat")).alias(lat), sealed(F.col("_lon")).alias(lon))


def is_position(lat: Column, lon: Column) -> Column:
    """Both within range, not NaN, and not the point zero."""
    real = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return real & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 1e-7) & (F.abs(lon) < 1e-7))
