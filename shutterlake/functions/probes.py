"""What probing tools say of a video, and what cameras write into a picture, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.media import rounded

#: The JSON of a probe, as far as it is used; numbers come as text.
PROBE = "format struct<duration:string,bit_rate:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:string,height:string,duration:string,bit_rate:string,avg_frame_rate:string,r_frame_rate:string>>"
# The tags that hold a position, in order of preference.
LOCATION_TAGS = ("location", "com.apple.quicktime.location.ISO6709", "location-eng")
#: Where in a video frames are sampled.
FRAME_POSITIONS = (0.05, 0.25, 0.50, 0.75, 0.95)


def number(text: Column) -> Column:
    """A number in text, 0 if it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def fraction(text: Column) -> Column:
    """'30000/1001' to three places, or a plain number; 0 for anything else, a zero below the line too."""
    parts = F.split(text, "/")
    over, below = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 2, F.when(below != 0, rounded(over / below, 3))).otherwise(text.try_cast("double")), F.lit(0.0))


def _either(*values: Column) -> Column:
    """The first number that isn't 0."""
    return F.coalesce(*[F.nullif(number(v), F.lit(0.0)) for v in values], F.lit(0.0))


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def probe_of_json(text: Column) -> Column:
    """(duration, width, height, video_codec, fps, bitrate, has_audio, audio_codec, creation_time, location, error) of a probe's JSON.

    ``error`` is 'unreadable' for text that is no JSON object, 'no video' if no
    stream is one, 'no duration' if it isn't above 0; fields are then null but
    for the last case. Null text gives null.
    """
    p = F.from_json(text, PROBE)
    of_kind = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a, tags = of_kind("video"), of_kind("audio"), p["format"]["tags"]
    duration = _either(p["format"]["duration"], v["duration"])
    location = F.coalesce(*[_text(F.try_element_at(tags, F.lit(t))) for t in LOCATION_TAGS])
    broken = F.try_parse_json(text).isNull() | (F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT") == F.lit(False))
    error = F.when(broken, "unreadable").when(v.isNull(), "no video").when(duration <= 0, "no duration")
    found = F.struct(
        duration.alias("duration"), number(v["width"]).cast("int").alias("width"), number(v["height"]).cast("int").alias("height"), F.coalesce(v["codec_name"], F.lit("")).alias("video_codec"),
        fraction(F.coalesce(_text(v["avg_frame_rate"]), v["r_frame_rate"])).alias("fps"), _either(p["format"]["bit_rate"], v["bit_rate"]).cast("bigint").alias("bitrate"), a.isNotNull().alias("has_audio"),
        F.coalesce(a["codec_name"], F.lit("")).alias("audio_codec"), F.try_element_at(tags, F.lit("creation_time")).alias("creation_time"), location.alias("location"),
    )
    names = ("duration", "width", "height", "video_codec", "fps", "bitrate", "has_audio", "audio_codec", "creation_time", "location")
    whole = ~broken & v.isNotNull()
    return F.when(text.isNotNull(), F.struct(*[F.when(whole, found[n]).alias(n) for n in names], error.alias("error")))


def probe_of_log(text: Column) -> Column:
    """The same struct from the lines that a player prints about its input; 'unreadable' if neither a size nor a duration is found."""
    got = lambda pattern, k=1: _text(F.regexp_extract(text, pattern, k))
    clock = [got(r"Duration:\s*(\d+):(\d+):(\d+\.\d+)", k).cast("double") for k in (1, 2, 3)]
    duration = F.coalesce(clock[0] * 3600 + clock[1] * 60 + clock[2], F.lit(0.0))
    stream = r"(?s)Stream #\d+:\d+.*?: Video:\s*(\w+).*?(\d{2,5})x(\d{2,5})"
    width = F.coalesce(got(stream, 2).cast("int"), F.lit(0))
    audio = got(r"(?s)Stream #\d+:\d+.*?: Audio:\s*(\w+)")
    rate = _text(F.regexp_extract(F.regexp_extract(text, r"(?m)^.*: Video:.*$", 0), r"([\d.]+)\s*fps", 1))
    error = F.when((width == 0) & (duration == 0), "unreadable").when(duration <= 0, "no duration")
    return F.when(
        text.isNotNull(),
        F.struct(
            duration.alias("duration"), width.alias("width"), F.coalesce(got(stream, 3).cast("int"), F.lit(0)).alias("height"), F.coalesce(got(stream), F.lit("")).alias("video_codec"), number(rate).alias("fps"),
            F.coalesce(got(r"bitrate:\s*(\d+)\s*kb/s").cast("bigint") * 1000, F.lit(0)).cast("bigint").alias("bitrate"), audio.isNotNull().alias("has_audio"), F.coalesce(audio, F.lit("")).alias("audio_codec"),
            got(r"creation_time\s*:\s*(\S+)").alias("creation_time"), got(r"\blocation(?:-eng)?\s*:\s*([+-][\d.]+[+-][\d.]+\S*)").alias("location"), error.alias("error"),
        ),
    )


def frame_times(duration: Column) -> Column:
    """The seconds at which frames are sampled: fixed parts of the duration, a tenth of a second before its end at most; null without duration."""
    last = F.greatest(F.lit(0.0), duration - 0.1)
    return F.when(duration > 0, F.array(*[F.greatest(F.lit(0.0), F.least(last, duration * p)) for p in FRAME_POSITIONS]))


def degrees(parts: Column, reference: Column, negative: str) -> Column:
    """Degrees, minutes and seconds (an array of three) as degrees to 7 places; below 0 where the reference starts with ``negative``."""
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60.0 + F.get(parts, F.lit(2)) / 3600.0
    return F.round(F.when(F.upper(F.trim(F.coalesce(reference, F.lit("")))).startswith(negative), -value).otherwise(value), 7)


def encoded_frames(hashes: Column) -> Column:
    """Frame hashes (array of bigint) as the text in which they are kept: 16 hex digits each, '-' for a missing one."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ",")


def cached_fields(error: Column, fields: dict[str, Column]) -> list[Column]:
    """What the cache keeps of an analysis: all fields of one that failed are null, and so are blank texts."""
    return [F.when(error.isNull(), F.when(v.cast("string") != "", v)).alias(n) for n, v in fields.items()]
