"""Where incoming files belong: capture dates, duplicates, destinations and names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import base_name, extension, folder
from shutterlake.operators.numbering import numbered_within
from shutterlake.sources.tables import materialize

#: A camera's spelling, or the ISO one, which may be compact and may end in 'Z' or an offset.
CAPTURE = r"^(\d{4})[:-]?(\d{1,2})[:-]?(\d{1,2})\s+(\d{1,2})(?::?(\d{1,2})(?::?(\d{1,2}))?)?(?:[Zz]|-\d{2}(?::?\d{2}(?::?\d{2})?)?)?$"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
INVALID = r'[<>:"|?*\\/\x00]'


def capture_datetime(text: Column) -> Column:
    """A camera's wall clock as timestamp_ntz; a fraction and a zone after the seconds are dropped; null for what is unreadable or starts with 0000."""
    core = F.trim(F.regexp_replace(F.replace(F.trim(F.regexp_replace(text, r"\x00", "")), F.lit("T"), F.lit(" ")), r"[.+].*$", ""))
    # one rewriting: what doesn't match stays as it is, and what then isn't a date and a time is null
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, CAPTURE, "@$1-$2-$3 $4:$5:$6"), "::$", ":00:00"), ":$", ":00")
    return F.when(whole.startswith("@") & ~whole.startswith("@0000"), F.substring(whole, 2, 40).try_cast("timestamp_ntz"))


def best_capture(original: Column, digitized: Column, plain: Column) -> tuple[Column, Column]:
    """(wall clock, source) of a picture's three date fields: as taken, as digitised, as last written."""
    read = [(capture_datetime(c), n) for c, n in ((original, "exif_original"), (digitized, "exif_digitized"), (plain, "exif_datetime"))]
    source = F.when(read[0][0].isNotNull(), read[0][1]).when(read[1][0].isNotNull(), read[1][1]).when(read[2][0].isNotNull(), read[2][1])
    return F.coalesce(*[c for c, _ in read]), source


def count_in_seconds(count: Column) -> Column:
    """A count since 1970 in seconds, milli-, micro- or nanoseconds as seconds; unlike ``count_to_ms`` it drops no year and no unset 0, only NaN and what no unit explains."""
    size = F.abs(count)
    return F.when(size < 1e11, count).when(size < 1e14, count / 1e3).when(size < 1e17, count / 1e6).when(size < 1e20, count / 1e9)


def capture_dates(files: DataFrame) -> DataFrame:
    """(file_id, captured, date_source): the date that the picture or video carries, else its mtime in UTC, whatever its unit; ``files`` has kind, date_taken, creation_time, mtime."""
    taken = F.when(F.col("kind") == "image", capture_datetime(F.col("date_taken")))
    made = F.when(F.col("kind") == "video", capture_datetime(F.col("creation_time")))
    seconds = F.floor(count_in_seconds(F.col("mtime"))).cast("decimal(18,6)")
    stored = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    source = F.when(taken.isNotNull(), "exif").when(made.isNotNull(), "video_creation").when(stored.isNotNull(), "file_mtime")
    return files.select("file_id", F.coalesce(taken, made, stored).alias("captured"), source.alias("date_source"))


def strftime(stamp: Column, pattern: str, fallback: str = "%Y%m%d_%H%M%S") -> Column:
    """A timestamp_ntz by a strftime pattern, whatever the session's time zone; slashes become '-', an unknown directive the fallback."""
    pattern = pattern.replace("/", "-").replace("\\", "-").strip() or fallback
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    name = lambda names, n, size: F.get(F.array(*[F.lit(x[:size]) for x in names]), n)
    made = {
        "%Y": F.lpad(F.year(stamp).cast("string"), 4, "0"), "%y": two(F.year(stamp) % 100), "%m": two(F.month(stamp)), "%d": two(F.dayofmonth(stamp)), "%H": two(F.hour(stamp)), "%M": two(F.minute(stamp)), "%S": two(F.second(stamp)),
        "%j": F.lpad(F.dayofyear(stamp).cast("string"), 3, "0"), "%I": two((F.hour(stamp) + 11) % 12 + 1), "%p": F.when(F.hour(stamp) < 12, "AM").otherwise("PM"), "%%": F.lit("%"),
        "%B": name(MONTHS, F.month(stamp) - 1, 9), "%b": name(MONTHS, F.month(stamp) - 1, 3), "%A": name(DAYS, F.weekday(stamp), 9), "%a": name(DAYS, F.weekday(stamp), 3),
    }
    parts = re.findall(r"%.?|[^%]+", pattern)
    if any(p[0] == "%" and p not in made for p in parts):
        return strftime(stamp, fallback)
    return F.concat(*[made.get(p, F.lit(p)) for p in parts])


def tidy_extension(ext: Column, lower: bool = True) -> Column:
    """Lower case, unless case is kept; all spellings of JPEG are '.jpg' ('.JPG' where case is kept)."""
    jpeg = F.lower(ext).isin(".jpeg", ".jpe", ".jfif") if lower else F.lower(ext).isin(".jpg", ".jpeg", ".jpe", ".jfif")
    return F.when(jpeg, ".jpg" if lower else ".JPG").otherwise(F.lower(ext) if lower else ext)


def formatted_name(captured: Column, pattern: str, prefix: str, ext: Column) -> Column:
    body = F.regexp_replace(strftime(captured, pattern), r'[<>:"|?*\x00]', "")
    return F.concat(F.lit(prefix), F.trim(body), ext)


def sanitized(name: Column, fallback: str = "Sin ubicación") -> Column:
    """A folder name without what file systems reject; a fallback for nothing."""
    clean = F.btrim(F.trim(F.regexp_replace(name, INVALID, "")), F.lit("."))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def is_within(path: Column, root: Column) -> Column:
    """Whether a path is a folder itself or lies below it; '/vol/ab' isn't below '/vol/a'. Redundant and closing slashes don't count."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"/(?:\.?/)+", "/"), "(?<=.)/$", "")
    at = tidy(root)
    return (tidy(path) == at) | F.startswith(tidy(path), F.when(at == "/", at).otherwise(F.concat(at, F.lit("/"))))


def _fold(text: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s and s.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()

    return text.map(one, na_action="ignore")


def folded(text: Column) -> Column:
    """Without case and diacritics, for names that mean the same folder or file."""
    return F.pandas_udf(_fold, "string")(text)


def reused_folders(wanted: DataFrame, existing: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, folder): each distinct wanted name, by its alias if it has one, sanitised, spelled as the existing folder that folds alike (the smallest such), else as it is.

    ``aliases`` has name and alias; names fold alike, blank aliases don't count, the smallest of several wins.
    """
    names = wanted.select("name").distinct()
    called = F.col("name")
    if aliases is not None:
        known = aliases.where("name is not null and trim(alias) <> ''").groupBy(folded(F.trim("name")).alias("_key")).agg(F.min(F.trim("alias")).alias("_alias"))
        names = names.withColumn("_key", folded(F.col("name"))).join(known, "_key", "left").drop("_key")
        called = F.coalesce("_alias", "name")
    names = names.select("name", sanitized(called).alias("clean"))
    there = existing.where("name is not null").groupBy(folded(F.col("name")).alias("key")).agg(F.min("name").alias("there"))
    return names.withColumn("key", folded(F.col("clean"))).join(there, "key", "left").select("name", F.coalesce("there", "clean").alias("folder"))


def import_status(batch: DataFrame, library: DataFrame) -> DataFrame:
    """(seq, status, duplicate_of): each incoming file against its batch and the library.

    ``batch`` has seq, name, kind, size, sha, pixels, width, height, error;
    ``library`` path, size, sha, pixels, width, height. An earlier file of the
    batch with the same digest comes first, then the library's file of equal
    size and digest, then (pictures that are new so far) an earlier such picture
    with the same pixels, then the library's picture of equal dimensions and pixels.
    """
    rows = batch.where("error is null")

    def earlier(df: DataFrame, key: str, out: str) -> DataFrame:
        """The name of the first row of the same key, for all rows but that one."""
        first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("seq", "name")).alias("_first"))
        return df.join(first, key, "left").withColumn(out, F.when(F.col("seq") > F.col("_first.seq"), F.col("_first.name"))).drop("_first")

    rows = earlier(rows, "sha", "same")
    exact = library.where("sha is not null").groupBy("size", "sha").agg(F.min("path").alias("exact"))
    rows = rows.join(exact, ["size", "sha"], "left")
    fresh = F.col("same").isNull() & F.col("exact").isNull() & (F.col("kind") == "image") & F.col("pixels").isNotNull()
    rows = earlier(rows.withColumn("fresh", fresh).withColumn("_look", F.when(fresh, F.col("pixels"))), "_look", "twin")
    pixel = library.where("pixels is not null").groupBy("width", "height", "pixels").agg(F.min("path").alias("pixel"))
    rows = rows.join(pixel, ["width", "height", "pixels"], "left").withColumn("pixel", F.when(F.col("fresh"), F.col("pixel")))
    status = F.when(F.col("same").isNotNull(), "duplicate_in_batch").when(F.col("exact").isNotNull(), "duplicate_exact").when(F.col("twin").isNotNull(), "duplicate_in_batch").when(F.col("pixel").isNotNull(), "duplicate_pixel").otherwise("new")
    return rows.select("seq", status.alias("status"), F.coalesce("same", "exact", "twin", "pixel").alias("duplicate_of"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)


def _free_number(k: Column, numbers: Column) -> Column:
    """The k-th number from 1 that isn't in the sorted ``numbers``: k plus the taken ones that come no later."""
    return F.aggregate(F.coalesce(numbers, F.array().cast("array<int>")), k.cast("int"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))


def _numbers(names: DataFrame, folder_column: str, pattern: str) -> DataFrame:
    """(folder, key, number): of names (folder, key) like stem_N.ext, the N under the key stem.ext."""
    return names.select(folder_column, F.regexp_replace("key", pattern, "$2").alias("_of"), F.regexp_extract("key", pattern, 1).try_cast("int").alias("number")).where("number > 0").withColumnRenamed("_of", "key")


def _sorted_numbers(numbers: DataFrame, folder_column: str) -> DataFrame:
    return numbers.groupBy(folder_column, "key").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def unique_names(plans: DataFrame, taken: DataFrame) -> DataFrame:
    """(seq, dest_dir, dest_name, suffixed): names made unique in their folder.

    ``plans`` has seq, dest_dir, dest_name, stamp, source; ``taken`` dest_dir
    and name of files already there. What a plan's own source leaves in the
    folder that it is bound for isn't taken: it moves with the plan. A lone free
    name stays bare; otherwise all that fold alike get _01, _02, ... by (stamp,
    source), skipping names taken or kept bare: the k-th gets the k-th free
    number. A stem's spelling is its first plan's.
    """
    keyed = materialize(plans.withColumn("key", folded(F.col("dest_name"))), "wanted-names")
    left = keyed.where(folder(F.col("source")) == F.col("dest_dir")).select("dest_dir", folded(base_name(F.col("source"))).alias("key")).distinct()
    there = taken.select("dest_dir", folded(F.col("name")).alias("key")).distinct().join(left, ["dest_dir", "key"], "left_anti")
    groups = keyed.groupBy("dest_dir", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("dest_name", "seq").alias("base"))
    groups = materialize(groups.join(there.withColumn("there", F.lit(True)), ["dest_dir", "key"], "left"), "name-groups")
    bare = groups.where("n = 1 and there is null").select("dest_dir", "key")
    many = groups.where("n > 1 or there").drop("n", "there")
    many = many.join(_sorted_numbers(_numbers(there.unionByName(bare), "dest_dir", r"_(\d{2}|[1-9]\d{2,})(\.[^.]*)?$"), "dest_dir"), ["dest_dir", "key"], "left")
    ranked = numbered_within(keyed.join(many.select("dest_dir", "key"), ["dest_dir", "key"], "left_semi"), ["dest_dir", "key"], ["stamp", "source", "seq"], "k")
    free = _free_number(F.col("k"), F.col("numbers"))
    name = F.concat(_stem(F.col("base")), F.lit("_"), F.when(free < 10, F.concat(F.lit("0"), free.cast("string"))).otherwise(free.cast("string")), _suffix(F.col("base")))
    named = ranked.join(many, ["dest_dir", "key"]).select("seq", "dest_dir", name.alias("dest_name"), F.lit(True).alias("suffixed"))
    return keyed.join(bare, ["dest_dir", "key"], "left_semi").select("seq", "dest_dir", "dest_name", F.lit(False).alias("suffixed")).unionByName(named)


def renamed(plans: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(file_id, new_name, status): names by date in place, made unique in their folder by _2, _3, ...

    ``plans`` has file_id, directory, old_name, wanted, stamp; ``taken``
    directory and name of the files in the folders. The plans' own old names
    aren't taken, as the renaming frees them; those of other files are. Those
    already named as wanted keep their name; the rest follow by (stamp, lower
    old name) and take the first free of wanted, _2, _3, ..., where names that
    other plans want bare aren't free.
    """
    key = plans.withColumns({"key": F.lower("wanted"), "stays": F.col("old_name") == F.col("wanted")})
    placed = numbered_within(key, ["directory", "key"], [F.desc("stays"), "stamp", F.lower("old_name"), "old_name", "file_id"], "k")
    # what blocks _N: the names that stay, and those that other plans want bare; the bare name is number 1
    pattern = r"_([2-9]|[1-9]\d+)(\.[^.]*)?$"
    numbers = _numbers(key.select("directory", "key").distinct(), "directory", pattern)
    if taken is not None:
        freed = plans.select("directory", F.lower("old_name").alias("key")).distinct()
        kept = taken.select("directory", F.lower("name").alias("key")).distinct().join(freed, ["directory", "key"], "left_anti")
        numbers = numbers.unionByName(_numbers(kept, "directory", pattern)).unionByName(kept.withColumn("number", F.lit(1)))
    numbers = _sorted_numbers(numbers, "directory")
    free = _free_number(F.col("k"), F.col("numbers"))
    out = placed.join(numbers, ["directory", "key"], "left").withColumn("free", F.when(F.col("stays") & (F.col("k") == 1), 1).otherwise(free))
    name = F.when(F.col("free") == 1, F.col("wanted")).otherwise(F.concat(_stem(F.col("wanted")), F.lit("_"), F.col("free").cast("string"), _suffix(F.col("wanted"))))
    status = F.when(F.col("stays") & (F.col("k") == 1), "unchanged").when(F.col("free") == 1, "pending").otherwise("suffixed")
    return out.select("file_id", name.alias("new_name"), status.alias("status"))


def organized(files: DataFrame, taken: DataFrame, pattern: str) -> DataFrame:
    """(file_id, dest_dir, dest_name, status): each file's folder <root>/<country>/<year>/<year-month> and name by date.

    ``files`` has file_id, path, root, country (null for none), captured;
    ``taken`` dest_dir and name of all files there are. A file that is where it
    belongs, before or after names are made unique, is 'unchanged'; others
    'move', or 'move_suffixed' where the name needs a number. Carrying the plan
    out and planning again changes nothing.
    """
    target = F.concat_ws("/", "root", sanitized(F.col("country")), strftime(F.col("captured"), "%Y"), strftime(F.col("captured"), "%Y-%m"))
    wanted = formatted_name(F.col("captured"), pattern, "", tidy_extension(extension(F.col("path"))))
    bound = materialize(files.select("file_id", "path", "captured", target.alias("dest_dir"), wanted.alias("bare")), "bound")
    at = lambda name: F.concat_ws("/", "dest_dir", name)
    going = bound.where(F.col("path") != at("bare")).select(F.col("file_id").alias("seq"), "dest_dir", F.col("bare").alias("dest_name"), F.col("captured").alias("stamp"), F.col("path").alias("source"))
    named = unique_names(going, taken).select(F.col("seq").alias("file_id"), "dest_name", "suffixed")
    out = bound.join(named, "file_id", "left").withColumn("dest_name", F.coalesce("dest_name", "bare"))
    status = F.when(F.col("path") == at("dest_name"), "unchanged").when(F.col("suffixed"), "move_suffixed").otherwise("move")
    return out.select("file_id", "dest_dir", "dest_name", status.alias("status"))


def import_plan(plans: DataFrame, taken: DataFrame, pattern: str) -> DataFrame:
    """(plan_id, status, duplicate_of, folder, dest_dir, dest_name): the whole plan of a batch.

    ``plans`` has plan_id, source_path, plan_ts, root, folder (the country's),
    and of :func:`import_status` status and duplicate_of (null for files that
    couldn't be read: 'error'). Only new files are given unique names; a new
    file without date or library is 'undated' and keeps its name.
    """
    state = F.coalesce(F.col("status"), F.lit("error"))
    target = F.when(F.col("plan_ts").isNotNull() & F.col("root").isNotNull(), F.concat_ws("/", "root", "folder", strftime(F.col("plan_ts"), "%Y"), strftime(F.col("plan_ts"), "%Y-%m")))
    bare = formatted_name(F.col("plan_ts"), pattern, "", tidy_extension(extension(F.col("source_path"))))
    bound = materialize(plans.select("plan_id", "source_path", "plan_ts", "folder", "duplicate_of", state.alias("status"), target.alias("dest_dir"), bare.alias("bare")), "bound")
    fresh = bound.where("status = 'new' and dest_dir is not null and bare is not null").select(F.col("plan_id").alias("seq"), "dest_dir", F.col("bare").alias("dest_name"), F.col("plan_ts").alias("stamp"), F.col("source_path").alias("source"))
    named = unique_names(fresh, taken).select(F.col("seq").alias("plan_id"), "dest_name", "suffixed")
    out = bound.join(named, "plan_id", "left")
    status = F.when((F.col("status") == "new") & F.col("dest_dir").isNull(), "undated").when(F.col("suffixed"), "new_suffixed").otherwise(F.col("status"))
    name = F.when((F.col("status") == "error") | F.col("dest_dir").isNull(), base_name(F.col("source_path"))).otherwise(F.coalesce("dest_name", "bare"))
    return out.select("plan_id", status.alias("status"), "duplicate_of", "folder", F.when(F.col("status") != "error", F.col("dest_dir")).alias("dest_dir"), name.alias("dest_name"))
