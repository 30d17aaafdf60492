"""Queries on where files belong: import, organise and rename plans as a whole, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.media import base_name, extension, folder
from shutterlake.operators import placement
from shutterlake.operators.geocode import countries_of
from shutterlake.operators.records import current_records
from shutterlake.plans import library, sql
from shutterlake.plans.found import located_files
from shutterlake.sources.tables import materialize, table

#: Other names for countries, as a user's settings have them.
ALIASES = (("Cenenax", "Cenenax y sus islas"), ("SEZOS", "Sézos Norte"), ("grizax", "  "))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, root): the folder of each current file's library."""
    held = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["library_id"])
    return held.join(F.broadcast(table(spark, d, "libraries").select("library_id", "root")), "library_id").select("file_id", "root")


def _movable(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, path, root, country, captured) of every dated file of a library."""
    country = countries_of(located_files(spark, d), table(spark, d, "country_borders")).withColumnRenamed("id", "file_id")
    dated = library._dated(spark, d).where("captured is not null")
    return dated.join(_roots(spark, d), "file_id").join(country, "file_id", "left").select("file_id", "path", "root", "country", "captured")


def _names(spark: SparkSession, d: str) -> DataFrame:
    held = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path"])
    return held.select(folder(F.col("path")).alias("dest_dir"), base_name(F.col("path")).alias("name"))


def organize_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each dated file's folder <country>/<year>/<year-month> and name by date, and whether it moves, moves with a suffix, or stays."""
    return placement.organized(_movable(spark, d), _names(spark, d), "%Y%m%d").select("file_id", "dest_dir", "dest_name", "status")


def organize_again(spark: SparkSession, d: str) -> DataFrame:
    """The plan made again once the first is carried out: nothing moves twice."""
    files = materialize(_movable(spark, d), "movable")
    first = materialize(placement.organized(files, _names(spark, d), "%Y%m%d_%H%M%S"), "first-plan")
    moved = files.drop("path").join(first.select("file_id", F.concat_ws("/", "dest_dir", "dest_name").alias("path")), "file_id")
    there = moved.select(folder(F.col("path")).alias("dest_dir"), base_name(F.col("path")).alias("name"))
    return placement.organized(moved, there, "%Y%m%d_%H%M%S").groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def _renamed(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    f = materialize(library._dated(spark, d), "dated")
    held = f.select("file_id", "captured", folder(F.col("path")).alias("directory"), base_name(F.col("path")).alias("old_name"), placement.tidy_extension(extension(F.col("path"))).alias("ext"))
    plans = held.where("captured is not null").select("file_id", "directory", "old_name", placement.formatted_name(F.col("captured"), pattern, "", F.col("ext")).alias("wanted"), F.col("captured").alias("stamp"))
    return placement.renamed(plans, held.select("directory", F.col("old_name").alias("name")))


def rename_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by capture time for every current file in its own folder."""
    return _renamed(spark, d, "%Y%m%d_%H%M%S")


def rename_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Names by month, which many files of a folder want at once."""
    return _renamed(spark, d, "%Y-%m")


def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of all incoming files: what each is, its country's folder, its destination and name by day."""
    plans = materialize(library._plans(spark, d).select("plan_id", "source_path", "plan_ts", "country", "library_id"), "plans")
    state = library.import_status(spark, d)
    aliases = spark.createDataFrame(list(ALIASES), "name string, alias string")
    folders = placement.reused_folders(plans.select(F.col("country").alias("name")), table(spark, d, "country_borders").select(F.col("country").alias("name")), aliases)
    roots = table(spark, d, "libraries").select("library_id", "root")
    known = plans.join(F.broadcast(roots), "library_id", "left").join(folders, F.col("country").eqNullSafe(F.col("name")), "left").join(state, "plan_id", "left")
    return placement.import_plan(known, _names(spark, d), "%Y%m%d")


def capture_order(spark: SparkSession, d: str) -> DataFrame:
    """A picture's date by three fields in order: here its own, a probe's of the same file, and its text with the zone cut."""
    probes = current_records(table(spark, d, "video_info"), "file_id", "probed_at", ["creation_time"])
    f = library.files(spark, d).select("file_id", "date_taken").join(probes, "file_id", "left")
    stamp, source = placement.best_capture(F.col("creation_time"), F.col("date_taken"), F.substring("date_taken", 1, 16))
    return f.select("file_id", stamp.alias("captured"), source.alias("date_source"))


QUERIES = {f.__name__: f for f in (organize_plan, organize_again, rename_names, rename_by_month, import_plan, capture_order)}

_FOLDER_OF = sql.FOLDER.replace("path", "{0}")
_NAME_OF = sql.NAME.replace("path", "{0}")
_TIDY = f"(CASE WHEN {sql.EXT} IN ('.jpeg', '.jpe', '.jfif') THEN '.jpg' ELSE {sql.EXT} END)"


def _rename(pattern: str) -> str:
    return f"""WITH {sql.DATED},
p AS (SELECT file_id, captured, {sql.FOLDER} AS directory, {sql.NAME} AS old_name, strftime(captured, '{pattern}') || {_TIDY} AS wanted FROM dated WHERE captured IS NOT NULL),
kept AS (SELECT DISTINCT {sql.FOLDER} AS directory, lower({sql.NAME}) AS key FROM dated EXCEPT SELECT directory, lower(old_name) FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY directory, lower(wanted) ORDER BY (old_name = wanted) DESC, captured, lower(old_name)) AS k, count(*) OVER (PARTITION BY directory, lower(wanted)) AS n, min(wanted) OVER (PARTITION BY directory, lower(wanted)) AS base FROM p),
slots AS (SELECT directory, base, unnest(range(1, n + 3 + (SELECT count(*) FROM kept x WHERE x.directory = g.directory))) AS i FROM (SELECT DISTINCT directory, base, n FROM n) g),
named AS (SELECT *, CASE WHEN i = 1 THEN base ELSE regexp_replace(base, '\\.[^.]*$', '') || '_' || i || regexp_extract(base, '\\.[^.]*$') END AS name FROM slots),
free AS (SELECT *, row_number() OVER (PARTITION BY directory, base ORDER BY i) AS k FROM named s WHERE NOT EXISTS (SELECT 1 FROM kept t WHERE t.directory = s.directory AND t.key = lower(s.name)))
SELECT file_id, CASE WHEN n.k = 1 AND old_name = wanted THEN wanted WHEN i = 1 THEN wanted ELSE name END AS new_name, CASE WHEN n.k = 1 AND old_name = wanted THEN 'unchanged' WHEN i = 1 THEN 'pending' ELSE 'suffixed' END AS status
FROM n LEFT JOIN free f ON f.directory = n.directory AND f.base = n.base AND f.k = n.k"""


def _unique(plans: str) -> str:
    """CTEs that name the rows of ``plans`` (seq, dest_dir, dest_name, stamp, source) as unique_names does: named (seq, dest_name, suffixed)."""
    return f"""
wanted AS (SELECT *, {sql._fold('dest_name')} AS key FROM {plans}),
there AS (SELECT DISTINCT {sql.FOLDER} AS dest_dir, {sql._fold(sql.NAME)} AS key FROM current EXCEPT SELECT dest_dir, {sql._fold(_NAME_OF.format('source'))} FROM wanted WHERE {_FOLDER_OF.format('source')} = dest_dir),
q AS (SELECT *, count(*) OVER w AS n, first(dest_name) OVER (w ORDER BY seq) AS base, row_number() OVER (w ORDER BY stamp, source) AS k, EXISTS (SELECT 1 FROM there t WHERE t.dest_dir = p.dest_dir AND t.key = p.key) AS there FROM wanted p WINDOW w AS (PARTITION BY dest_dir, key)),
slots AS (SELECT dest_dir, key, base, unnest(range(1, n + 3 + (SELECT count(*) FROM there x WHERE x.dest_dir = g.dest_dir))) AS i FROM (SELECT DISTINCT dest_dir, key, base, n FROM q WHERE n > 1 OR there) g),
spelled AS (SELECT *, regexp_replace(base, '\\.[^.]*$', '') || format('_{{:02d}}', i) || regexp_extract(base, '\\.[^.]*$') AS name FROM slots),
free AS (SELECT *, row_number() OVER (PARTITION BY dest_dir, key ORDER BY i) AS k FROM spelled s WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.dest_dir = s.dest_dir AND t.key = {sql._fold('s.name')})),
named AS (SELECT seq, dest_name, false AS suffixed FROM q WHERE n = 1 AND NOT there UNION ALL SELECT seq, f.name, true FROM q JOIN free f ON f.dest_dir = q.dest_dir AND f.key = q.key AND f.k = q.k WHERE n > 1 OR there)
"""


_ORGANIZED = f"""{sql.DATED}, {sql.GEOCODE},
movable AS (SELECT d.file_id, d.path, root || '/' || coalesce(country, 'Sin ubicación') || '/' || strftime(captured, '%Y') || '/' || strftime(captured, '%Y-%m') AS dest_dir, captured
  FROM dated d JOIN current c ON c.file_id = d.file_id JOIN libraries l ON l.library_id = c.library_id LEFT JOIN geo g ON g.file_id = d.file_id WHERE captured IS NOT NULL),
bare AS (SELECT *, strftime(captured, '%Y%m%d') || {_TIDY} AS dest_name FROM movable),
going AS (SELECT file_id AS seq, dest_dir, dest_name, captured AS stamp, path AS source FROM bare WHERE path <> dest_dir || '/' || dest_name),
{_unique('going')}"""
_FOLDERS = f"""
spelled_as AS (SELECT DISTINCT country AS name, CASE WHEN {sql._fold('country')} = 'cenenax' THEN 'Cenenax y sus islas' WHEN {sql._fold('country')} = 'sezos' THEN 'Sézos Norte' ELSE country END AS alias FROM import_plans),
cleaned AS (SELECT name, coalesce(nullif(trim(trim(regexp_replace(alias, '[<>:"|?*\\\\/]', '', 'g')), '.'), ''), 'Sin ubicación') AS clean FROM spelled_as),
borders AS (SELECT {sql._fold('country')} AS key, min(country) AS there FROM country_borders GROUP BY 1),
folders AS (SELECT name, coalesce(there, clean) AS folder FROM cleaned LEFT JOIN borders ON key = {sql._fold('clean')})
"""
_STATUS = sql.SQL["import_status"].removeprefix("WITH ").rsplit("SELECT plan_id, CASE", 1)
_SOURCE_EXT = sql.EXT.replace("path", "source_path")
SQL = {
    "organize_plan": f"""WITH {_ORGANIZED}
SELECT b.file_id, b.dest_dir, coalesce(n.dest_name, b.dest_name) AS dest_name, CASE WHEN n.seq IS NULL OR b.path = b.dest_dir || '/' || n.dest_name THEN 'unchanged' WHEN suffixed THEN 'move_suffixed' ELSE 'move' END AS status
FROM bare b LEFT JOIN named n ON n.seq = b.file_id""",
    "organize_again": f"""WITH {sql.DATED} SELECT 'unchanged' AS status, count(*) AS files FROM dated d JOIN current c ON c.file_id = d.file_id JOIN libraries l ON l.library_id = c.library_id WHERE captured IS NOT NULL""",
    "rename_names": _rename("%Y%m%d_%H%M%S"),
    "rename_by_month": _rename("%Y-%m"),
    "import_plan": f"""WITH {_STATUS[0]},
state AS (SELECT plan_id, CASE{_STATUS[1]}),
{_FOLDERS},
planned AS (SELECT p.plan_id, p.source_path, p.plan_ts, coalesce(s.status, 'error') AS status, s.duplicate_of, f.folder, root || '/' || f.folder || '/' || strftime(p.plan_ts, '%Y') || '/' || strftime(p.plan_ts, '%Y-%m') AS dest_dir,
  strftime(p.plan_ts, '%Y%m%d') || (CASE WHEN {_SOURCE_EXT} IN ('.jpeg', '.jpe', '.jfif') THEN '.jpg' ELSE {_SOURCE_EXT} END) AS dest_name
  FROM plans p LEFT JOIN state s USING (plan_id) LEFT JOIN libraries l ON l.library_id = p.library_id LEFT JOIN folders f ON f.name IS NOT DISTINCT FROM p.country),
fresh AS (SELECT plan_id AS seq, dest_dir, dest_name, plan_ts AS stamp, source_path AS source FROM planned WHERE status = 'new' AND dest_dir IS NOT NULL AND dest_name IS NOT NULL),
{_unique('fresh')}
SELECT plan_id, CASE WHEN status = 'new' AND dest_dir IS NULL THEN 'undated' WHEN suffixed THEN 'new_suffixed' ELSE status END AS status, duplicate_of, folder, CASE WHEN status <> 'error' THEN dest_dir END AS dest_dir,
  CASE WHEN status = 'error' OR dest_dir IS NULL THEN {_NAME_OF.format('source_path')} ELSE coalesce(n.dest_name, p.dest_name) END AS dest_name
FROM planned p LEFT JOIN named n ON n.seq = p.plan_id""",
    "capture_order": f"""WITH {sql.FILES},
probes AS (SELECT file_id, creation_time FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY probed_at DESC) AS rn FROM video_info) WHERE rn = 1),
read AS (SELECT f.file_id, {sql._capture('creation_time')} AS a, {sql._capture('date_taken')} AS b, {sql._capture('substr(date_taken, 1, 16)')} AS c FROM files f LEFT JOIN probes p ON p.file_id = f.file_id)
SELECT file_id, coalesce(a, b, c) AS captured, CASE WHEN a IS NOT NULL THEN 'exif_original' WHEN b IS NOT NULL THEN 'exif_digitized' WHEN c IS NOT NULL THEN 'exif_datetime' END AS date_source FROM read""",
}
