"""Queries over the catalogue's tables: scans, layers of duplicates, recommendations, placement, cache and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest, hash64
from shutterlake.functions.geo import with_iso6709
from shutterlake.functions.media import EXACT, base_name, category_rank, classify_threshold, color_bins, color_similarity, confidence, extension, folder, frame_values, human_duration, human_size, kind_of, megapixels, similarity_percent, wide_hash
from shutterlake.operators import cache, grouping, placement, recommend
from shutterlake.operators.geocode import countries_of
from shutterlake.operators.numbering import numbered
from shutterlake.operators.records import current_records
from shutterlake.operators.review import label
from shutterlake.operators.skew import salted_join
from shutterlake.plans.found import located_files
from shutterlake.sources.tables import materialize, table

def _decoded() -> dict[str, tuple[str, Column]]:
    """What a file has, by name: the stored column it comes from, and how it is read."""
    c = F.col
    known = {n: (n, c(n)) for n in ("path", "size", "mtime", "img_format", "orientation", "has_exif", "date_taken")}
    return {
        **known, "kind": ("path", kind_of(c("path"))), "sha": ("sha256", digest(c("sha256"))), "pixels": ("pixel_digest", digest(c("pixel_digest"))), **{h: (h, hash64(c(h))) for h in ("phash", "dhash", "ahash")},
        "bhash": ("bhash", wide_hash(c("bhash"))), "color": ("color_sig", color_bins(c("color_sig"))), "width": ("width", F.when(c("width") > 0, c("width"))), "height": ("height", F.when(c("height") > 0, c("height"))),
        "make": ("camera_make", c("camera_make")), "model": ("camera_model", c("camera_model")), "error": ("decode_error", c("decode_error")), "duration": ("video_duration", F.when(~F.isnan("video_duration"), c("video_duration"))),
        "bitrate": ("video_bitrate", c("video_bitrate")), "frames": ("frame_hashes", frame_values(c("frame_hashes"))),
    }


def files(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Every current file with its digests and signatures decoded: all of them, or file_id and the ``names`` alone, so that nothing else is read or shuffled."""
    known = _decoded()
    kept = {n: known[n] for n in (names or known) if n != "file_id"}
    rows = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", list(dict.fromkeys(raw for raw, _ in kept.values())))
    return rows.select("file_id", *[value.alias(n) for n, (_, value) in kept.items()])


def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes and folders of each kind."""
    f = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "size"])
    return f.groupBy(kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct(folder(F.col("path"))).alias("folders"))


def scan_selection(spark: SparkSession, d: str) -> DataFrame:
    """What a scan emits: images and videos of 64 KiB or more, outside folders named tmp, without PNG; by extension."""
    f = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "size"])
    kept = f.where((F.col("size") >= 65536) & ~folder(F.col("path")).rlike(r"(^|/)tmp(/|$)") & kind_of(F.col("path")).isin("image", "video") & ~extension(F.col("path")).isin(".png"))
    return kept.groupBy(kind_of(F.col("path")).alias("kind"), extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def _sharing(f: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once; the counting combines before its shuffle, so a hot key is no window."""
    known = f.where(" and ".join(f"{k} is not null" for k in keys))
    return known.join(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), keys, "left_semi")


def size_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files worth a digest: their size occurs more than once."""
    return _sharing(files(spark, d, "size"), ["size"]).select("file_id", "size")


def dimension_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Images worth decoding: their dimensions occur more than once."""
    return _sharing(files(spark, d, "kind", "error", "width", "height").where("kind = 'image' and error is null").select("file_id", "width", "height"), ["width", "height"]).select("file_id", "width", "height")


def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of byte-identical files, most reclaimable bytes first."""
    return grouping.exact_groups(files(spark, d, "path", "size", "sha"))


def _layers(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The files (path, size, digests and ``more``), written once, and the members of their exact groups."""
    f = materialize(files(spark, d, "path", "size", "kind", "sha", "pixels", *more), "files")
    return f, materialize(grouping.exact_layers(f.select("file_id", "sha", "pixels")), "layers")


def layered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pixel-identical and byte-identical groups, numbered."""
    f, members = _layers(spark, d)
    return grouping.numbered_groups(members, f).drop("key")


def layered_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of the numbered groups."""
    f, members = _layers(spark, d)
    return members.join(grouping.numbered_groups(members, f).select("key", "group_id"), "key").select("group_id", "file_id")


def rough_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many digests occur more than once, and how many files were hashed, decoded and described."""
    f = files(spark, d, "sha", "pixels", "phash", "frames")
    more = lambda k: f.where(f"{k} is not null").groupBy(k).count().where("count > 1").agg(F.count(F.lit(1)).alias(f"{k}_groups"))
    run = f.agg(F.count("sha").alias("hashed"), F.count("pixels").alias("decoded"), F.count("phash").alias("described"), F.count("frames").alias("sampled"))
    parts = run.unionByName(more("sha"), allowMissingColumns=True).unionByName(more("pixels"), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Groups, files, redundant copies and reclaimable bytes by category."""
    f, members = _layers(spark, d)
    g = grouping.numbered_groups(members, f)
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("groups"), F.sum("files").alias("files"), F.sum(F.col("files") - 1).alias("redundant"), F.sum("reclaimable").alias("reclaimable"))


def group_browser(spark: SparkSession, d: str) -> DataFrame:
    """Pictures' identical groups of three or more with 'img' in some name or path, by reclaimable bytes."""
    f, members = _layers(spark, d)
    held = members.join(f.select("file_id", "path", "kind", "size"), "file_id")
    g = held.groupBy("key", "category").agg(
        F.count(F.lit(1)).alias("files"), (F.sum("size") - F.max("size")).alias("reclaimable"), F.min("path").alias("first_path"),
        F.every(F.col("kind") == "image").alias("pictures"), F.some(F.contains(F.lower("path"), F.lit("img"))).alias("hit"),
    )
    kept = g.where("pictures and hit and files >= 3 and category = 'file_identical'")
    return numbered(kept, [F.desc("reclaimable"), "first_path"], "place").select("place", "files", "reclaimable", "first_path", F.format_string("%s (%d)", human_size(F.col("reclaimable")), F.col("files")).alias("label"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with different phashes at most 15 bits apart, a row a pair of distinct hashes, named by their smallest files; ``hamming_members`` has the others."""
    f = files(spark, d, "phash").where("phash is not null").groupBy("phash").agg(F.min("file_id").alias("file_id"))
    return grouping.close_pairs(f, 15)


def hamming_members(spark: SparkSession, d: str) -> DataFrame:
    """Every file with a phash, and the file that names its hash in ``hamming_pairs``; files of one representative are 0 bits apart."""
    rows = materialize(files(spark, d, "phash").where("phash is not null and file_id is not null").select("file_id", "phash"), "hashes")
    names = rows.groupBy("phash").agg(F.min("file_id").alias("representative"))
    return salted_join(names, rows, ["phash"]).select("file_id", "representative")


def _unassigned(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """All files, and the pictures that no exact layer holds; with all columns, or those of ``names`` (kind, error, sha and pixels among them)."""
    f = materialize(files(spark, d, *names), "files")
    members = grouping.exact_layers(f.select("file_id", "sha", "pixels"))
    return f, f.where("kind = 'image' and error is null").join(members.select("file_id"), "file_id", "left_anti")


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pictures alike by their combined score, outside the exact layers."""
    return grouping.similar_pairs(_unassigned(spark, d)[1])


def similar_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of alike pictures, scored against their anchor."""
    rest = materialize(_unassigned(spark, d)[1], "pictures")
    return grouping.similar_clusters(rest, materialize(grouping.similar_pairs(rest), "similar"))


def embedding_votes(spark: SparkSession, d: str) -> DataFrame:
    """Alike pictures after the vote of their embeddings."""
    e = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["embedding"])
    return grouping.voted_pairs(materialize(_unassigned(spark, d)[1], "pictures"), e)


def color_matches(spark: SparkSession, d: str) -> DataFrame:
    """Colour similarity of each member of an exact group with the group's first file."""
    f, members = _layers(spark, d, "color")
    rows = members.join(f.select("file_id", "color"), "file_id")
    first = rows.groupBy("key").agg(F.min("file_id").alias("first")).join(f.select(F.col("file_id").alias("first"), F.col("color").alias("first_color")), "first")
    return rows.join(first, "key").where("file_id <> first").select("file_id", "first", color_similarity(F.col("color"), F.col("first_color")).alias("similarity"))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, "kind", "sha", "duration", "frames").where("kind = 'video'").select("file_id", "sha", "duration", "frames")


def duration_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Videos with another of like duration, which are worth sampling."""
    return grouping.duration_candidates(_videos(spark, d))


def video_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Videos of like duration with like frames."""
    return grouping.video_pairs(_videos(spark, d))


def nearest_videos(spark: SparkSession, d: str) -> DataFrame:
    """The most alike video of each video."""
    return grouping.nearest_videos(_videos(spark, d))


def video_groups(spark: SparkSession, d: str) -> DataFrame:
    """Videos linked by bytes or frames."""
    v = materialize(_videos(spark, d), "videos")
    return grouping.video_groups(v, materialize(grouping.video_stars(v), "video-stars"))


def keep_scores(spark: SparkSession, d: str) -> DataFrame:
    """The points of every member of an exact group, in thousandths."""
    f, members = _layers(spark, d, "mtime", "error", "img_format", "has_exif", "make", "model", "date_taken", "width", "height", "bitrate")
    return recommend.keep_scores(members, f).select("file_id", F.round(F.col("score") * 1000).cast("bigint").alias("score_milli"), "decisive")


def keep_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """The file to keep of every exact group, and how sure that is."""
    f, members = _layers(spark, d, "mtime", "error", "img_format", "has_exif", "make", "model", "date_taken", "width", "height", "bitrate")
    return recommend.recommendations(materialize(recommend.keep_scores(members, f), "scores")).select("category", "keep", "confidence")


def file_traits(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for or against each file as the one to keep."""
    return recommend.traits(files(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and durations as people read them, and upright dimensions."""
    turned = F.coalesce(F.col("orientation").isin(5, 6, 7, 8), F.lit(False))
    upright = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return files(spark, d, "size", "duration", "orientation", "width", "height", "frames").select("file_id", human_size(F.col("size")).alias("size_label"), human_duration(F.col("duration")).alias("duration_label"), upright("width", "height").alias("upright_width"), upright("height", "width").alias("upright_height"), F.size("frames").alias("frame_count"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "import_plans").where("plan_id is not null").drop("duplicate_of")
    kept = [c for c in p.columns if c != "plan_id"]
    p = p.groupBy("plan_id").agg(F.max(F.struct(*kept)).alias("r")).select("plan_id", "r.*")
    return p.withColumns({"sha": digest(F.col("sha256")), "pixels": digest(F.col("pixel_digest"))})


def import_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether each incoming file is new, a copy of a library file, or of an earlier one of all batches together."""
    batch = _plans(spark, d).select(F.col("plan_id").alias("seq"), F.col("source_path").alias("name"), "kind", "size", "sha", "pixels", "width", "height", "error")
    return placement.import_status(batch, files(spark, d, "path", "size", "sha", "pixels", "width", "height")).withColumnRenamed("seq", "plan_id")


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Plans and bytes by status."""
    return _plans(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("plans"), F.sum("size").alias("bytes"), F.count_if("enabled").alias("enabled"))


def import_names(spark: SparkSession, d: str) -> DataFrame:
    """Destination names of all plans, made unique in their folders beside the files already there."""
    p = _plans(spark, d).where("dest_dir is not null and dest_name is not null")
    plans = p.select(F.col("plan_id").alias("seq"), "dest_dir", "dest_name", F.col("plan_ts").alias("stamp"), F.col("source_path").alias("source"))
    there = files(spark, d, "path").select(folder(F.col("path")).alias("dest_dir"), base_name(F.col("path")).alias("name"))
    return placement.unique_names(plans, there).select(F.col("seq").alias("plan_id"), "dest_name", "suffixed")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    probes = current_records(table(spark, d, "video_info"), "file_id", "probed_at", ["creation_time"])
    f = files(spark, d, "path", "kind", "mtime", "date_taken").join(probes, "file_id", "left")
    return f.select("file_id", "path").join(placement.capture_dates(f), "file_id")


def capture_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each file's capture date as its own text says it, and where it comes from."""
    return _dated(spark, d).select("file_id", "captured", "date_source")


def geocode(spark: SparkSession, d: str) -> DataFrame:
    """The country of each located file."""
    return countries_of(located_files(spark, d), table(spark, d, "country_borders")).withColumnRenamed("id", "file_id")


def folder_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of a country among the plans, and the folder it goes to."""
    wanted = table(spark, d, "import_plans").select(F.col("country").alias("name"))
    return placement.reused_folders(wanted, table(spark, d, "country_borders").select(F.col("country").alias("name")))


def iso6709(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct location text and its position."""
    return with_iso6709(table(spark, d, "video_info").select("location").distinct(), "location").select("location", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def _earlier(spark: SparkSession, d: str) -> DataFrame:
    """The cache as it was: each path's first analysis."""
    raw = table(spark, d, "file_cache").where("path is not null").select("path", "size", "mtime", "sha256", "analyzed_at")
    return raw.groupBy("path").agg(F.min(F.struct("analyzed_at", "size", "mtime", "sha256")).alias("r")).select("path", "r.size", "r.mtime", "r.sha256")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return current_records(table(spark, d, "file_cache"), "path", "analyzed_at", ["path", "size", "mtime", "sha256"]).select("path", "size", "mtime", "sha256")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Which current files the earlier cache still describes."""
    return cache.lookup(_latest(spark, d), _earlier(spark, d), ["sha256"]).select("path", "hit", "sha256")


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The earlier cache with the files that changed since put in."""
    old, now = _earlier(spark, d), cache.lookup(_latest(spark, d), _earlier(spark, d), ["sha256"])
    changed = now.where("not hit").select("path").join(_latest(spark, d), "path")
    return cache.upsert(old, changed)


def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    """The cached files that some group of the older run still names."""
    named = table(spark, d, "group_members").select("file_id").distinct()
    ids = current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path"])
    return cache.prune(_latest(spark, d), ids.join(named, "file_id", "left_semi").select("path")).select("path", "size")


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    """The 500 newest operations."""
    log = _plans(spark, d).where("status <> 'pending'").select("plan_id", "plan_ts", "source_path", "status", "size")
    return cache.recent(log, "plan_ts", "plan_id", 500)


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operations, failures and bytes by batch."""
    return _plans(spark, d).groupBy("batch_no").agg(F.count(F.lit(1)).alias("operations"), F.count("error").alias("failed"), F.sum(F.when(F.col("error").isNull(), F.col("size")).otherwise(0)).alias("bytes"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Members of the older run's groups with their last decision."""
    m = table(spark, d, "group_members").where("group_id is not null and file_id is not null")
    last = m.groupBy("group_id", "file_id").agg(F.max(F.struct("added_at", "decision", "reviewed", "category")).alias("r")).select("group_id", "file_id", "r.decision", "r.reviewed", "r.category")
    return last.join(current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", ["path", "size"]), "file_id", "left")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each group's flags: reviewed, resolved, unsafe (nothing would be left)."""
    m = _decided(spark, d)
    gone = F.col("decision") == "delete"
    return m.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(gone).alias("marked"), F.coalesce(F.every("reviewed"), F.lit(False)).alias("reviewed"),
        (F.count_if(F.coalesce(F.col("decision"), F.lit("undecided")) == "undecided") == 0).alias("resolved"), (F.count_if(~F.coalesce(gone, F.lit(False))) == 0).alias("unsafe"),
    )


def deletion_preview(spark: SparkSession, d: str) -> DataFrame:
    """What deleting the marked files would do: files, bytes, files that are gone, groups left empty."""
    m = _decided(spark, d).withColumn("gone", F.coalesce(F.col("decision") == "delete", F.lit(False)))
    marked = m.where("gone").groupBy("file_id").agg(F.max("size").alias("size"), F.max("path").alias("path"))
    items = marked.agg(F.count("path").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("path").isNull()).alias("missing"))
    empty = m.groupBy("group_id").agg(F.count_if(~F.col("gone")).alias("left")).agg(F.count_if(F.col("left") == 0).alias("emptied"))
    parts = items.unionByName(empty, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def category_review(spark: SparkSession, d: str) -> DataFrame:
    """The older run by category: members, mean similarity in hundredths, confidence of the mean, rank."""
    m = table(spark, d, "group_members").where("category is not null").select("group_id", "file_id", "category", "similarity").distinct()
    g = m.groupBy("category").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("group_id").alias("groups"), F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("best"))
    return g.select("category", "members", "groups", "best", confidence(F.col("category"), F.col("best")).alias("confidence"), category_rank(F.col("category")).alias("rank"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """One flat row for each member of each exact group, as a CSV export has it; decisions are those of the older run."""
    f, members = _layers(spark, d, "phash", "width", "height")
    g = grouping.numbered_groups(members, f).select("key", "group_id")
    made = table(spark, d, "group_members").where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("added_at", "decision")).alias("r")).select("file_id", "r.decision")
    rows = members.join(g, "key").join(f.select("file_id", "path", "size", "sha", "pixels", "phash", "width", "height"), "file_id").join(made, "file_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    return rows.select(
        "group_id", "category", label(F.col("category")).alias("category_label"), F.lit("").alias("similarity_percent"), F.coalesce("decision", F.lit("undecided")).alias("decision"), F.lit("no").alias("deleted"), base_name(F.col("path")).alias("name"),
        "path", "size", human_size(F.col("size")).alias("size_label"), blank(size).alias("resolution"), blank(F.col("sha")).alias("sha256"), blank(F.col("pixels")).alias("pixel_digest"),
        F.when(F.col("phash").isNull(), "").otherwise(F.lpad(F.lower(F.hex("phash")), 16, "0")).alias("phash"), F.col("category").isin(*EXACT).alias("exact"),
    )


def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """The head of a JSON export: what was scanned and what the exact groups hold."""
    f, members = _layers(spark, d)
    scanned = f.agg(F.count(F.lit(1)).alias("files_found"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_distinct(folder(F.col("path"))).alias("folders"), F.sum("size").alias("total_bytes"))
    g = grouping.numbered_groups(members, f)
    held = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("category") == "file_identical").alias("file_identical_groups"), F.count_if(F.col("category") == "pixel_identical").alias("pixel_identical_groups"), F.sum(F.col("files") - 1).alias("redundant_copies"), F.sum("reclaimable").alias("reclaimable_bytes"))
    parts = scanned.unionByName(held, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def threshold_categories(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the older comparison by one threshold of 85 %, and the pixels of their left file."""
    m = table(spark, d, "match_pairs").where("score is not null and not isnan(score)").select("left_path", "right_path", "score").distinct()
    f = files(spark, d, "path", "width", "height").select(F.col("path").alias("left_path"), megapixels(F.col("width"), F.col("height")).alias("megapixels"))
    return m.join(f, "left_path", "left").select("left_path", "right_path", "score", classify_threshold(F.col("score"), 85.0).alias("category"), "megapixels")


def export_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text for each exact group, files in order of path."""
    rows = export_rows(spark, d)
    files_of = F.array_sort(F.collect_list(F.struct("path", "size")))
    return rows.groupBy("group_id", "category").agg(F.to_json(F.struct(F.col("group_id"), F.col("category"), files_of.alias("files"))).alias("json")).select("group_id", "json")


def undo_plan(spark: SparkSession, d: str) -> DataFrame:
    """What would undo the finished imports: source and destination changed round."""
    done = _plans(spark, d).where("error is null and status <> 'pending' and dest_dir is not null and dest_name is not null")
    return done.select("plan_id", F.concat_ws("/", "dest_dir", "dest_name").alias("undo_source"), F.col("source_path").alias("undo_dest"))


def phash_compare(spark: SparkSession, d: str) -> DataFrame:
    """phash of every two successive members of an older group, compared."""
    m = table(spark, d, "group_members").where("group_id is not null").select("group_id", "file_id").distinct().join(files(spark, d, "phash").where("phash is not null"), "file_id")
    other = F.lead("phash").over(Window.partitionBy("group_id").orderBy("file_id"))
    apart = F.bit_count(F.col("phash").bitwiseXOR(F.col("other")))
    return m.withColumn("other", other).where("other is not null").select("group_id", "file_id", apart.cast("bigint").alias("distance"), similarity_percent(apart).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_stats, scan_selection, size_candidates, dimension_candidates, exact_groups, layered_groups, layered_members, rough_counters, dashboard, group_browser, hamming_pairs, hamming_members, similar_pairs, similar_clusters,
        embedding_votes, color_matches, duration_candidates, video_pairs, nearest_videos, video_groups, keep_scores, keep_recommendation, file_traits, labels, import_status, plan_summary, import_names, capture_dates, geocode,
        folder_reuse, iso6709, cache_lookup, cache_upsert, cache_prune, history_recent, history_summary, decisions, deletion_preview, category_review, export_rows, export_summary, export_json, threshold_categories, undo_plan, phash_compare,
    )
}
