"""Queries on looking through groups and acting on them, and on reading media, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.media import kind_of
from shutterlake.functions.probes import cached_fields, degrees, encoded_frames, fraction, frame_times, probe_of_json, probe_of_log
from shutterlake.operators import placement, review
from shutterlake.operators.numbering import numbered, numbered_within
from shutterlake.operators.records import current_records
from shutterlake.plans import library, placing, sql
from shutterlake.sources.tables import materialize, table


def members(spark: SparkSession, d: str) -> DataFrame:
    """The older run's members with their last decision; one without a current file counts as deleted."""
    m = table(spark, d, "group_members").where("group_id is not null and file_id is not null")
    last = m.groupBy("group_id", "file_id").agg(F.max(F.struct("added_at", "decision", "reviewed", "category", F.when(~F.isnan("similarity"), F.col("similarity")).alias("similarity"))).alias("r"))
    f = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "size", "mtime"])
    held = last.select("group_id", "file_id", "r.decision", "r.reviewed", "r.category", "r.similarity").join(f, "file_id", "left")
    return held.withColumns({"kind": kind_of(F.col("path")), "deleted": F.col("path").isNull(), "ignored": F.lit(False)})


def group_flags(spark: SparkSession, d: str) -> DataFrame:
    """What each older group's members say together."""
    return review.group_flags(members(spark, d)).drop("likeness")


def browser_views(spark: SparkSession, d: str) -> DataFrame:
    """How many groups and bytes each view shows once some groups are acted on."""
    m = materialize(_acted(spark, d), "members")
    flags = materialize(review.group_flags(m), "flags")
    shown = [(flags.where(w) if v == "resolved" else flags.where("not resolved and files >= 2").where(w)).agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("potential"), F.lit(0)).alias("bytes")) for v, w in review.VIEWS.items()]
    out = shown[0]
    for one in shown[1:]:
        out = out.unionByName(one)
    return out


def browser_list(spark: SparkSession, d: str) -> DataFrame:
    """The places of groups with 'img' in a name or path under each of the six sorts."""
    m = materialize(members(spark, d), "members")
    out = None
    for sort in review.SORTS:
        kept, order = review.browse(m, "all", " IMG ", 2, sort)
        one = numbered(kept.select("group_id", *{review.SORTS[sort]}), order, "place").select(F.lit(sort).alias("sort"), "place", "group_id")
        out = one if out is None else out.unionByName(one)
    return out


def members_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Each group's members by age and by likeness."""
    m = materialize(members(spark, d).where("path is not null").select("group_id", "file_id", "mtime", "similarity", F.lower("path").alias("low"), "path"), "members")
    age = numbered_within(m, ["group_id"], ["mtime", "low", "path", "file_id"], "by_age").select("group_id", "file_id", "by_age")
    like = numbered_within(m, ["group_id"], [F.desc_nulls_last("similarity"), "mtime", "low", "path", "file_id"], "by_likeness").select("group_id", "file_id", "by_likeness")
    return age.join(like, ["group_id", "file_id"])


def _actions(m: DataFrame) -> DataFrame:
    """Something done with groups by category: one file chosen, all kept, ignored, cleared."""
    of = m.groupBy("group_id").agg(F.max("category").alias("category"), F.min(F.when(~F.col("deleted"), F.col("file_id"))).alias("first"))
    action = F.when(F.col("category") == "pixel_identical", "keep_selected").when(F.col("category") == "very_similar", "keep_all").when(F.col("category") == "similar", "ignore").when(F.col("category") == "resized_duplicate", "clear")
    return of.select("group_id", action.alias("action"), F.when(F.col("first").isNotNull(), F.array("first")).alias("selected")).where("action is not null")


def _acted(spark: SparkSession, d: str) -> DataFrame:
    m = materialize(members(spark, d), "before")
    return review.apply_actions(m, _actions(m))


def decide(spark: SparkSession, d: str) -> DataFrame:
    """Decisions after the actions."""
    return _acted(spark, d).select("group_id", "file_id", "decision", "reviewed", "ignored")


def drop_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Members left once deleted files and groups of one are gone."""
    return review.drop_deleted(members(spark, d)).select("group_id", "file_id")


def deletion_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Marked files and what a fresh scan (here each path's first analysis) says against deleting them."""
    disk = library._earlier(spark, d).select("path", "size", F.lit(False).alias("is_folder"), F.lit(False).alias("is_link"))
    marked = review.marked_files(_acted(spark, d)).select("group_id", "file_id", "path", "size")
    return review.preflight(marked, disk).select("group_id", "file_id", "warning")


def deletion_emptied(spark: SparkSession, d: str) -> DataFrame:
    """Groups that deletion would leave empty: by their marks, and by an explicit list of each group's oldest files."""
    m = materialize(_acted(spark, d), "members")
    chosen = m.where("not deleted").groupBy("group_id").agg(F.min(F.struct("mtime", "file_id")).alias("r")).select("group_id", "r.file_id")
    marks = review.emptied_groups(m).select(F.lit("marks").alias("by"), "group_id")
    return marks.unionByName(review.emptied_groups(m, chosen).select(F.lit("list").alias("by"), "group_id"))


def operation_log(spark: SparkSession, d: str) -> DataFrame:
    """Log entries of the finished imports."""
    p = materialize(library._plans(spark, d).where("status <> 'pending'").select("source_path", "dest_dir", "dest_name", "error", "size", "status"), "done")
    dest = F.when(~F.col("status").startswith("dup"), F.concat_ws("/", "dest_dir", "dest_name"))
    outcomes = p.select("source_path", dest.alias("dest_path"), F.col("error").isNull().alias("ok"), "error", "size")
    return review.operation_entries(p.select("source_path", F.lit(None).cast("string").alias("duplicate_of"), "size"), outcomes, "import")


def operation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Entries, failures and bytes of the log by action."""
    return operation_log(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("result") == "error").alias("failed"), F.sum(F.when(F.col("result") == "ok", F.col("size")).otherwise(0)).alias("bytes"))


def rename_steps(spark: SparkSession, d: str) -> DataFrame:
    """Renames by month, and which of them need a temporary name."""
    names = placing.rename_by_month(spark, d)
    f = library.files(spark, d).select("file_id", "path")
    folder_of = library.folder(F.col("path"))
    plans = f.join(names, "file_id").select("file_id", F.col("path").alias("old"), F.concat(folder_of, F.lit("/"), "new_name").alias("new"))
    return review.moves_in_two_steps(plans).select("file_id", "step")


def category_labels(spark: SparkSession, d: str) -> DataFrame:
    """The categories of the older run in two languages."""
    c = table(spark, d, "group_members").select("category").distinct()
    return c.select("category", review.label(F.col("category")).alias("english"), review.label(F.col("category"), "es").alias("spanish"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return current_records(table(spark, d, "video_info"), "file_id", "probed_at", ["duration", "width", "height", "video_codec", "fps", "bitrate", "has_audio", "audio_codec", "creation_time", "location", "error"])


def probe_json(spark: SparkSession, d: str) -> DataFrame:
    """Every current probe written as a tool's JSON and read back."""
    s = lambda c: F.col(c).cast("string")
    video = F.struct(F.lit("video").alias("codec_type"), F.col("video_codec").alias("codec_name"), s("width").alias("width"), s("height").alias("height"), F.concat(F.round(F.col("fps") * 1000).cast("bigint").cast("string"), F.lit("/1000")).alias("avg_frame_rate"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.col("audio_codec").alias("codec_name"), *[F.lit(None).cast("string").alias(n) for n in ("width", "height", "avg_frame_rate")])
    streams = F.filter(F.array(F.when(F.col("error").isNull(), video), F.when(F.col("has_audio"), audio)), lambda x: x.isNotNull())
    tags = F.struct("creation_time", F.col("location").alias("com.apple.quicktime.location.ISO6709"))
    text = F.to_json(F.struct(F.struct(s("duration").alias("duration"), s("bitrate").alias("bit_rate"), tags.alias("tags")).alias("format"), streams.alias("streams")))
    made = materialize(_probes(spark, d).select("file_id", text.alias("text")), "probe-texts")
    return made.select("file_id", probe_of_json(F.col("text")).alias("p")).select("file_id", "p.duration", "p.width", "p.height", "p.video_codec", "p.fps", "p.bitrate", "p.has_audio", "p.creation_time", "p.location", "p.error")


def probe_log(spark: SparkSession, d: str) -> DataFrame:
    """Every current probe written as a player's lines and read back."""
    whole = F.floor(F.coalesce("duration", F.lit(0.0)) * 100).cast("bigint")
    head = F.format_string("  Duration: %02d:%02d:%02d.%02d, start: 0.0, bitrate: %d kb/s\n", F.floor(whole / 360000), F.floor(whole / 6000) % 60, F.floor(whole / 100) % 60, whole % 100, F.floor(F.coalesce("bitrate", F.lit(0)) / 1000))
    video = F.format_string("    Stream #0:0(und): Video: %s (High), yuv420p, %dx%d, 25 tbr\n", "video_codec", "width", "height")
    text = F.concat(F.when(F.col("duration") > 0, head).otherwise(""), F.coalesce(F.when(F.col("width").between(10, 99999) & F.col("height").between(10, 99999), video), F.lit("")), F.when(F.col("has_audio") & F.col("audio_codec").isNotNull(), F.concat(F.lit("    Stream #0:1: Audio: "), "audio_codec", F.lit(" (LC)\n"))).otherwise(""))
    made = materialize(_probes(spark, d).where("duration is null or not isnan(duration)").select("file_id", text.alias("text")), "probe-texts")
    return made.select("file_id", probe_of_log(F.col("text")).alias("p")).select("file_id", F.round("p.duration", 2).alias("duration"), "p.width", "p.height", "p.has_audio", "p.bitrate", "p.error")


def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where frames of each video are sampled, in milliseconds."""
    f = library.files(spark, d).where("kind = 'video'").select("file_id", F.posexplode(frame_times(F.col("duration"))).alias("k", "at"))
    return f.select("file_id", "k", F.round(F.col("at") * 1000).cast("bigint").alias("at_ms"))


def frame_texts(spark: SparkSession, d: str) -> DataFrame:
    """Frame hashes read and written again in their normal form."""
    f = library.files(spark, d).where("frames is not null")
    return f.select("file_id", encoded_frames(F.col("frames")).alias("frame_hashes"))


def frame_rates(spark: SparkSession, d: str) -> DataFrame:
    """Frame rates as fractions read back."""
    p = _probes(spark, d).where("fps is not null and not isnan(fps)").select("file_id", F.concat(F.round(F.col("fps") * 1001).cast("bigint").cast("string"), F.lit("/1001")).alias("text"))
    return p.select("file_id", fraction(F.col("text")).alias("fps"))


def gps_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Positions split into degrees, minutes and seconds and put together again."""
    g = current_records(table(spark, d, "geo_coords"), "file_id", "read_at", ["lat", "lon"]).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")

    def parts(c: str):
        size = F.abs(F.col(c))
        minutes = (size - F.floor(size)) * 60
        return F.array(F.floor(size).cast("double"), F.floor(minutes).cast("double"), (minutes - F.floor(minutes)) * 60)

    back = {c: degrees(parts(c), F.when(F.col(c) < 0, far), near) for c, far, near in (("lat", " s", "S"), ("lon", "West", "W"))}
    same = lambda c: F.abs(back[c] - F.col(c)) <= 1e-7
    return g.select("file_id", same("lat").alias("lat_same"), same("lon").alias("lon_same"), (back["lat"] < 0).alias("south"), (back["lon"] < 0).alias("west"))


def cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the cache keeps of each current analysis."""
    f = library.files(spark, d)
    return f.select("file_id", *cached_fields(F.col("error"), {"width": F.col("width"), "height": F.col("height"), "img_format": F.col("img_format"), "camera_make": F.col("make"), "camera_model": F.col("model"), "date_taken": F.col("date_taken"), "has_exif": F.col("has_exif")}))


def cache_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cached paths, and what work is left by kind: digests, headers, pixels, signatures, embeddings, frames."""
    f = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "sha256", "pixel_digest", "phash", "embedding", "width", "decode_error", "video_duration", "frame_hashes"])
    kind, sound = kind_of(F.col("path")), F.col("decode_error").isNull()
    image, video = (kind == "image") & sound, (kind == "video") & sound
    return f.agg(
        F.count_distinct("path").alias("cached"), F.count_if(F.col("sha256").isNull() & sound).alias("to_hash"), F.count_if(image & F.col("width").isNull()).alias("to_read"), F.count_if(image & F.col("pixel_digest").isNull()).alias("to_decode"),
        F.count_if(image & F.col("phash").isNull()).alias("to_sign"), F.count_if(image & F.col("embedding").isNull()).alias("to_embed"), F.count_if(video & F.col("video_duration").isNull()).alias("to_probe"), F.count_if(video & F.col("frame_hashes").isNull()).alias("to_sample"),
    )


def same_names(spark: SparkSession, d: str) -> DataFrame:
    """Which files lie within their library's folder."""
    f = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "library_id"])
    held = f.join(F.broadcast(table(spark, d, "libraries").select("library_id", "root")), "library_id")
    return held.select("file_id", placement.is_within(F.col("path"), F.col("root")).alias("within"))


QUERIES = {
    f.__name__: f
    for f in (
        group_flags, browser_views, browser_list, members_ordered, decide, drop_deleted, deletion_warnings, deletion_emptied, operation_log, operation_totals, rename_steps, category_labels, probe_json, probe_log, frame_positions, frame_texts, frame_rates, gps_degrees,
        cache_rows, cache_counts, same_names,
    )
}

_MEMBERS = f"""
{sql.CURRENT},
members AS (
  SELECT m.group_id, m.file_id, m.decision, m.reviewed, m.category, CASE WHEN NOT isnan(m.similarity) THEN m.similarity END AS similarity, c.path, c.size, c.mtime, c.path IS NULL AS deleted, false AS ignored,
    CASE WHEN c.path IS NULL THEN NULL WHEN {sql.EXT} IN ({sql._list(sql.IMAGE_EXTENSIONS)}) THEN 'image' WHEN {sql.EXT} IN ({sql._list(sql.VIDEO_EXTENSIONS)}) THEN 'video' ELSE 'other' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY group_id, file_id ORDER BY added_at DESC, decision DESC, reviewed DESC) AS rn FROM group_members WHERE group_id IS NOT NULL AND file_id IS NOT NULL) m LEFT JOIN current c ON c.file_id = m.file_id WHERE m.rn = 1)
"""
_DONE = "CASE WHEN cat = 'pixel_identical' THEN 'keep_selected' WHEN cat = 'very_similar' THEN 'keep_all' WHEN cat = 'similar' THEN 'ignore' WHEN cat = 'resized_duplicate' THEN 'clear' END"
_ACTED = f"""
{_MEMBERS},
chosen AS (SELECT *, max(category) OVER (PARTITION BY group_id) AS cat, min(CASE WHEN NOT deleted THEN file_id END) OVER (PARTITION BY group_id) AS one FROM members),
acted AS (SELECT * REPLACE (
  CASE {_DONE} WHEN 'keep_selected' THEN (CASE WHEN one IS NULL THEN decision WHEN file_id = one THEN 'keep' ELSE 'delete' END) WHEN 'keep_all' THEN 'keep' WHEN 'clear' THEN 'undecided' ELSE decision END AS decision,
  reviewed OR coalesce({_DONE} = 'ignore', false) AS reviewed, coalesce({_DONE} = 'ignore', false) AS ignored) FROM chosen)
"""


def _flags(of: str) -> str:
    rank = sql._RANK.replace(" END", " ELSE -1 END")
    return f"""
flags AS (SELECT group_id, arg_max(category, ({rank}, coalesce(category, ''))) AS category, count(*) AS files, count_if(NOT deleted) AS active, sum(coalesce(size, 0))::BIGINT AS total_size, min(coalesce(size, 0)) AS unit_size,
  CASE WHEN count_if(NOT deleted) >= 2 THEN (sum(CASE WHEN NOT deleted THEN size END) - max(CASE WHEN NOT deleted THEN size END))::BIGINT ELSE 0 END AS potential, coalesce(sum(size) FILTER (decision = 'delete'), 0)::BIGINT AS reclaimable,
  count_if(coalesce(decision = 'delete', false) AND NOT deleted) AS marked, bool_and(coalesce(decision = 'delete', false)) AS unsafe, bool_or(ignored) AS ignored, bool_and(coalesce(kind = 'image', false)) AS pictures, bool_and(coalesce(kind = 'video', false)) AS videos,
  max(similarity) AS similarity, bool_or(ignored) OR count_if(NOT deleted) < 2 AS resolved, bool_or(ignored) OR bool_and(coalesce(reviewed, false)) OR bool_or(coalesce(decision, 'undecided') <> 'undecided') AS reviewed FROM {of} GROUP BY group_id),
full_flags AS (SELECT *, coalesce(category IN ('file_identical', 'pixel_identical'), false) AS exact, CASE WHEN category IN ('file_identical', 'pixel_identical') THEN 100 WHEN similarity IS NULL THEN 0 ELSE format('{{:.0f}}', least(100.0, greatest(0.0, similarity))::DOUBLE)::INT END AS confidence FROM flags)
"""


_SHOWN = " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS groups, coalesce(sum(potential), 0)::BIGINT AS bytes FROM full_flags WHERE {'' if v == 'resolved' else 'NOT resolved AND files >= 2 AND '}({w})" for v, w in review.VIEWS.items())
_SORTED = {"savings": "potential DESC", "count": "files DESC", "unit_size": "unit_size DESC", "similarity": "coalesce(nullif(similarity, 0), CASE WHEN exact THEN 100 ELSE 0 END) DESC", "name": "first_name NULLS FIRST", "path": "first_path NULLS FIRST"}
_PLACED = " UNION ALL ".join(f"SELECT '{s}' AS sort, row_number() OVER (ORDER BY {o}, group_id) AS place, group_id FROM listed" for s, o in _SORTED.items())
_PROBES = "probes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY probed_at DESC) AS rn FROM video_info WHERE file_id IS NOT NULL) WHERE rn = 1)"
_OUTCOMES = f"""{sql.PLANS}, done AS (SELECT source_path, CASE WHEN status NOT LIKE 'dup%' THEN concat_ws('/', dest_dir, dest_name) END AS dest_path, error, size FROM plans WHERE status <> 'pending'),
sizes AS (SELECT source_path, max(size) AS plan_size FROM done GROUP BY source_path),
log AS (SELECT coalesce(dest_path, d.source_path) AS path, CASE WHEN dest_path IS NULL AND error IS NULL THEN 'import-copy' ELSE 'import' END AS action, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS result,
  CASE WHEN error IS NOT NULL THEN error WHEN dest_path IS NULL THEN 'already there as ?' ELSE d.source_path || ' > ' || dest_path END AS detail, coalesce(nullif(size, 0), plan_size) AS size FROM done d LEFT JOIN sizes s ON s.source_path = d.source_path)"""
_RENAMES = placing.SQL["rename_by_month"].rsplit("\nSELECT file_id,", 1)
_V = "error IS NULL"
SQL = {
    "group_flags": f"WITH {_MEMBERS}, {_flags('members')} SELECT * FROM full_flags",
    "browser_views": f"WITH {_ACTED}, {_flags('acted')} {_SHOWN}",
    "browser_list": f"""WITH {_MEMBERS}, {_flags('members')},
firsts AS (SELECT group_id, arg_min(lower({sql.NAME}), (mtime, lower(path), path)) AS first_name, arg_min(lower(path), (mtime, lower(path), path)) AS first_path FROM members WHERE path IS NOT NULL GROUP BY group_id),
listed AS (SELECT f.*, first_name, first_path FROM full_flags f LEFT JOIN firsts USING (group_id) WHERE NOT resolved AND files >= 2 AND group_id IN (SELECT group_id FROM members WHERE contains(lower(path), 'img')))
{_PLACED}""",
    "members_ordered": f"WITH {_MEMBERS} SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY mtime NULLS FIRST, lower(path), path, file_id) AS by_age, row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC NULLS LAST, mtime NULLS FIRST, lower(path), path, file_id) AS by_likeness FROM members WHERE path IS NOT NULL",
    "decide": f"WITH {_ACTED} SELECT group_id, file_id, decision, reviewed, ignored FROM acted",
    "drop_deleted": f"WITH {_MEMBERS} SELECT group_id, file_id FROM members WHERE NOT deleted QUALIFY count(*) OVER (PARTITION BY group_id) >= 2",
    "deletion_warnings": f"""WITH {_ACTED}, {sql.CACHE} SELECT a.group_id, a.file_id, CASE WHEN e.path IS NULL THEN 'missing' WHEN e.size IS DISTINCT FROM a.size THEN 'size_changed' END AS warning
FROM acted a LEFT JOIN earlier e ON e.path = a.path WHERE a.decision = 'delete' AND NOT a.deleted AND NOT a.ignored""",
    "deletion_emptied": f"""WITH {_ACTED}, there AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY mtime NULLS FIRST, file_id) AS k FROM acted WHERE NOT deleted)
SELECT 'marks' AS by, group_id FROM acted GROUP BY group_id HAVING count_if(decision = 'delete' AND NOT deleted) > 0 AND count_if(coalesce(decision <> 'delete', true) AND NOT deleted) = 0 AND NOT bool_or(ignored)
UNION ALL SELECT 'list', group_id FROM there GROUP BY group_id HAVING count_if(coalesce(decision <> 'delete', true) AND k > 1) = 0""",
    "operation_log": f"WITH {_OUTCOMES} SELECT * FROM log",
    "operation_totals": f"WITH {_OUTCOMES} SELECT action, count(*) AS entries, count_if(result = 'error') AS failed, sum(CASE WHEN result = 'ok' THEN size ELSE 0 END)::BIGINT AS bytes FROM log GROUP BY action",
    "rename_steps": f"""{_RENAMES[0]}, names AS (SELECT file_id,{_RENAMES[1]}), moves AS (SELECT f.file_id, path AS old, {sql.FOLDER} || '/' || new_name AS new FROM files f JOIN names USING (file_id) WHERE path <> {sql.FOLDER} || '/' || new_name)
SELECT file_id, CASE WHEN lower(old) <> lower(new) AND lower(new) IN (SELECT lower(old) FROM moves) THEN 'aside' ELSE 'direct' END AS step FROM moves""",
    "category_labels": "SELECT DISTINCT category, " + ", ".join("CASE category " + " ".join(f"WHEN '{c}' THEN '{pair[k]}'" for c, pair in review.LABELS.items()) + f" ELSE category END AS {n}" for k, n in ((0, "english"), (1, "spanish"))) + " FROM group_members",
    "probe_json": f"""WITH {_PROBES} SELECT file_id, CASE WHEN {_V} THEN coalesce(duration, 0) END AS duration, CASE WHEN {_V} THEN coalesce(width, 0) END AS width, CASE WHEN {_V} THEN coalesce(height, 0) END AS height, CASE WHEN {_V} THEN coalesce(video_codec, '') END AS video_codec,
CASE WHEN {_V} THEN coalesce(round(fps * 1000) / 1000, 0) END AS fps, CASE WHEN {_V} THEN coalesce(bitrate, 0) END AS bitrate, CASE WHEN {_V} THEN coalesce(has_audio, false) END AS has_audio, CASE WHEN {_V} THEN creation_time END AS creation_time, CASE WHEN {_V} THEN nullif(location, '') END AS location,
CASE WHEN error IS NOT NULL THEN 'no video' WHEN coalesce(duration, 0) <= 0 THEN 'no duration' END AS error FROM probes""",
    "probe_log": f"""WITH {_PROBES}, p AS (SELECT *, floor(coalesce(duration, 0) * 100) / 100 AS whole, width BETWEEN 10 AND 99999 AND height BETWEEN 10 AND 99999 AND video_codec IS NOT NULL AS sized FROM probes WHERE duration IS NULL OR NOT isnan(duration))
SELECT file_id, CASE WHEN duration > 0 THEN whole ELSE 0 END AS duration, CASE WHEN sized THEN width ELSE 0 END AS width, CASE WHEN sized THEN height ELSE 0 END AS height, coalesce(has_audio AND audio_codec IS NOT NULL, false) AS has_audio,
CASE WHEN duration > 0 THEN coalesce(bitrate, 0) // 1000 * 1000 ELSE 0 END AS bitrate, CASE WHEN coalesce(duration > 0 AND whole > 0, false) THEN NULL WHEN coalesce(sized, false) THEN 'no duration' ELSE 'unreadable' END AS error FROM p""",
    "frame_positions": f"WITH {sql.FILES} SELECT file_id, k::INT AS k, round(greatest(0, least(greatest(0, duration - 0.1), duration * [0.05, 0.25, 0.5, 0.75, 0.95][k + 1])) * 1000)::BIGINT AS at_ms FROM files, range(5) t(k) WHERE kind = 'video' AND duration > 0",
    "frame_texts": f"WITH {sql.FILES} SELECT file_id, array_to_string(list_transform(frames, lambda h: CASE WHEN h IS NULL THEN '-' ELSE lower(lpad(to_hex(h), 16, '0')) END), ',') AS frame_hashes FROM files WHERE frames IS NOT NULL",
    "frame_rates": f"WITH {_PROBES} SELECT file_id, format('{{:.3f}}', round(fps * 1001)::BIGINT / 1001.0::DOUBLE)::DOUBLE AS fps FROM probes WHERE fps IS NOT NULL AND NOT isnan(fps)",
    "gps_degrees": "SELECT file_id, true AS lat_same, true AS lon_same, round(lat, 7) < 0 AS south, round(lon, 7) < 0 AS west FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY read_at DESC) AS rn FROM geo_coords WHERE file_id IS NOT NULL) WHERE rn = 1 AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)",
    "cache_rows": f"WITH {sql.FILES} SELECT file_id, " + ", ".join(f"CASE WHEN error IS NULL AND {c}::VARCHAR <> '' THEN {c} END AS {n}" for c, n in (("width", "width"), ("height", "height"), ("img_format", "img_format"), ("make", "camera_make"), ("model", "camera_model"), ("date_taken", "date_taken"), ("has_exif", "has_exif"))) + " FROM files",
    "cache_counts": f"WITH {sql.CURRENT}, c AS (SELECT *, CASE WHEN {sql.EXT} IN ({sql._list(sql.IMAGE_EXTENSIONS)}) THEN 'image' WHEN {sql.EXT} IN ({sql._list(sql.VIDEO_EXTENSIONS)}) THEN 'video' END AS kind FROM current) SELECT count(DISTINCT path) AS cached, count_if(sha256 IS NULL AND decode_error IS NULL) AS to_hash, " + ", ".join(f"count_if(kind = '{k}' AND decode_error IS NULL AND {c} IS NULL) AS {n}" for k, c, n in (("image", "width", "to_read"), ("image", "pixel_digest", "to_decode"), ("image", "phash", "to_sign"), ("image", "embedding", "to_embed"), ("video", "video_duration", "to_probe"), ("video", "frame_hashes", "to_sample"))) + " FROM c",
    "same_names": f"WITH {sql.CURRENT} SELECT file_id, path = root OR starts_with(path, root || '/') AS within FROM current JOIN libraries USING (library_id)",
}
