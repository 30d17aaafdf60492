"""Queries on all layers of duplicates together: exact, similar, cropped, video; and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.media import PROFILES, frame_similarity
from shutterlake.functions.paths import same_path
from shutterlake.operators import crops, grouping
from shutterlake.plans import library, sql
from shutterlake.sources.tables import materialize, table

#: What links the videos of these tables, whose frames are never 84 % alike.
LOW = 55.0


def _rest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, exact members, pictures that no exact layer holds, and their similar pairs."""
    f, rest = library._unassigned(spark, d)
    rest = materialize(rest, "pictures")
    exact = materialize(grouping.exact_layers(f.select("file_id", "kind", "sha", "pixels"), skip_videos=True), "exact")
    return f, exact, rest, materialize(grouping.similar_pairs(rest, with_reasons=True), "similar")


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs with their reasons, from the columns that they depend on alone."""
    rest = library._unassigned(spark, d, "kind", "error", "sha", "pixels", "phash", "dhash", "ahash", "bhash", "color", "width", "height")[1]
    return materialize(grouping.similar_pairs(rest, with_reasons=True), "similar")


def similar_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs and why they are alike."""
    return _reasoned(spark, d).select("a", "b", "score", F.array_join("reasons", ", ").alias("reasons"))


def cluster_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Up to six reasons of each similar cluster."""
    pairs = _reasoned(spark, d)
    return grouping.cluster_reasons(pairs, materialize(grouping.linked(pairs), "linked")).select("root", F.array_join("reasons", ", ").alias("reasons"))


def similar_strict(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of the strict profile."""
    return grouping.similar_pairs(library._unassigned(spark, d)[1], PROFILES["low"])


def sampled_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sampled index finds at least nine tenths of the similar pairs that comparing all finds, and nothing else."""
    _, _, rest, pairs = _rest(spark, d)
    found = grouping.similar_pairs(rest, recall=0.95).select("a", "b")
    both = pairs.select("a", "b").join(found.withColumn("hit", F.lit(1)), ["a", "b"], "full").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return both.crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs"))).select("pairs", (F.col("n") == F.col("pairs")).alias("none_else"), (F.col("hits") >= 0.9 * F.col("pairs")).alias("found"))


def crop_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of which one may be a crop of the other."""
    return crops.crop_candidates(library.files(spark, d, "kind", "error", "sha", "pixels", "phash", "dhash", "ahash", "bhash", "color", "width", "height"))


def _crop_edges(spark: SparkSession, d: str, files: DataFrame) -> DataFrame:
    """(small, big, score, region): crops that an earlier comparison of pixels found (match_pairs); these tables hold no pixels."""
    m = table(spark, d, "match_pairs").where("evidence = 'crop' and verdict = 'match'").select(same_path(F.col("left_path")).alias("p"), same_path(F.col("right_path")).alias("q"), "score").distinct()
    of = lambda s, p: files.select(same_path(F.col("path")).alias(p), F.col("file_id").alias(s), (F.col("width").cast("bigint") * F.col("height")).alias(f"px_{s}"))
    both = m.join(of("a", "p"), "p").join(of("b", "q"), "q").where("a <> b and px_a is not null and px_b is not null and not isnan(score)")
    swap = (F.col("px_a") < F.col("px_b")) | ((F.col("px_a") == F.col("px_b")) & (F.col("a") > F.col("b")))
    edges = both.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("big"), "score", F.lit(None).cast("array<double>").alias("region"))
    return crops.best_edges(edges)


def crop_groups(spark: SparkSession, d: str) -> DataFrame:
    """Source pictures and their crops, of those that no exact layer holds."""
    f = materialize(library.files(spark, d), "files")
    exact = grouping.exact_layers(f.select("file_id", "kind", "sha", "pixels"), skip_videos=True)
    return crops.crop_groups(materialize(_crop_edges(spark, d, f), "crops"), exact).select("big", "file_id", F.round("score", 1).alias("score"))


def _all_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files, and (key, category, file_id) of every layer; a file that a layer holds isn't in a later one, but as a crop's source."""
    f, exact, rest, pairs = _rest(spark, d)
    member = materialize(grouping.linked(pairs), "linked")
    clusters = materialize(grouping.similar_clusters(rest, pairs, member=member), "clusters")
    similar = materialize(member.join(clusters.select("root", "category").where("category <> 'different'"), "root").select(F.concat(F.lit("c"), F.col("root").cast("string")).alias("key"), "category", F.col("node").alias("file_id")), "similar-members")
    held = exact.select("file_id").unionByName(similar.select("file_id"))
    cropped = crops.crop_groups(materialize(_crop_edges(spark, d, f), "crops"), held).select(F.concat(F.lit("r"), F.col("big").cast("string")).alias("key"), F.lit("cropped_similar").alias("category"), "file_id")
    v = materialize(f.where("kind = 'video'").select("file_id", "sha", "duration", "frames"), "videos")
    vpairs = materialize(grouping.video_stars(v, LOW), "video-stars")
    vlinks = materialize(grouping.video_links(v, vpairs), "video-links")
    vgroups = grouping.video_groups(v, vpairs, LOW, vlinks).where("category <> 'different'").select("root", "category")
    videos = vlinks.join(vgroups, "root").select(F.concat(F.lit("v"), F.col("root").cast("string")).alias("key"), "category", F.col("node").alias("file_id"))
    # each layer is a plan of its own: a plan of all is told to the driver again with each of its stages
    return f, exact.unionByName(similar).unionByName(materialize(cropped, "crop-members")).unionByName(materialize(videos, "video-members"))


def all_groups(spark: SparkSession, d: str) -> DataFrame:
    """All layers in one numbering: by rank of category, then reclaimable bytes, then path."""
    f, members = _all_members(spark, d)
    return grouping.numbered_groups(members, f).drop("key")


def all_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Groups, files, copies and bytes of all layers by category, and in all."""
    f, members = _all_members(spark, d)
    g = grouping.numbered_groups(members, f)
    return g.rollup("category").agg(F.count(F.lit(1)).alias("groups"), F.sum("files").alias("files"), F.sum(F.col("files") - 1).alias("redundant"), F.sum("reclaimable").alias("reclaimable")).select(F.coalesce("category", F.lit("all")).alias("category"), "groups", "files", "redundant", "reclaimable")


def video_pairs_low(spark: SparkSession, d: str) -> DataFrame:
    """Videos of like duration whose frames are 55 % alike."""
    return grouping.video_pairs(library._videos(spark, d), LOW)


def video_groups_low(spark: SparkSession, d: str) -> DataFrame:
    """Videos linked by bytes or by frames 55 % alike."""
    v = materialize(library._videos(spark, d), "videos")
    return grouping.video_groups(v, materialize(grouping.video_stars(v, LOW), "video-stars"), LOW)


def video_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each video of one second's length against the largest of that length, in percent."""
    f = materialize(library.files(spark, d).where("kind = 'video' and duration > 0 and frames is not null").select(F.floor("duration").alias("seconds"), "file_id", "size", "frames"), "lengths")
    anchor = f.groupBy("seconds").agg(F.max(F.struct("size", (-F.col("file_id")).alias("id"), "frames")).alias("r")).select("seconds", (-F.col("r.id")).alias("anchor"), F.col("r.frames").alias("anchor_frames"))
    return f.join(anchor, "seconds").select("seconds", "file_id", "anchor", F.when(F.col("file_id") == F.col("anchor"), 100.0).otherwise(frame_similarity(F.col("frames"), F.col("anchor_frames"))).alias("percent"))


QUERIES = {f.__name__: f for f in (similar_reasons, cluster_reasons, similar_strict, sampled_recall, crop_pairs, crop_groups, all_groups, all_dashboard, video_pairs_low, video_groups_low, video_compare)}

_CUTS = ", ".join(f"CASE WHEN s_{k} >= {cut} THEN '{k}' END" for k, cut in grouping.REASON_CUTS.items())
_WHY = f"""
why AS (SELECT s.a, s.b, p.score, CASE WHEN p.resized THEN ['resized', 'other_format'] ELSE list_filter([{_CUTS}, CASE WHEN abs(wa / ha - wb / hb) <= 0.04 * greatest(wa / ha, wb / hb) THEN 'same_aspect' WHEN wa IS NOT NULL AND ha IS NOT NULL AND wb IS NOT NULL AND hb IS NOT NULL THEN 'other_aspect' END,
  CASE WHEN s_color < 55 THEN 'other_colors' END], lambda r: r IS NOT NULL) END AS reasons FROM scored s JOIN pairs p ON p.a = s.a AND p.b = s.b)
"""
_CLUSTERS = sql.SQL["similar_clusters"].removeprefix("WITH RECURSIVE ").rsplit("\nSELECT root, anchor,", 1)
_LOW = sql.VIDEOS.replace("percent >= 84", "percent >= 55")
_VGROUPS = sql.SQL["video_groups"].removeprefix("WITH RECURSIVE ").replace("percent >= 84)", "percent >= 55)").replace("84.0", "55.0").replace("percent, 84)", "percent, 55)").replace(">= 92", ">= 77.5").replace(">= 84", ">= 55")
_VPARTS = _VGROUPS.rsplit("\nSELECT root, files,", 1)
_VOWN = _VPARTS[0].split("videos AS (", 1)[1]
_VCTE = "videos AS (" + _VOWN.replace("sym ", "vsym ").replace("reach ", "vreach ").replace("linked ", "vlinked ").replace("held ", "vheld ").replace("least AS", "vleast AS")
_VCTE = _VCTE.replace("FROM linked", "FROM vlinked").replace("JOIN linked", "JOIN vlinked").replace("FROM reach", "FROM vreach")
_CROPS = """
named AS (SELECT DISTINCT regexp_replace(nfc_normalize(left_path), '/(\\.?/)+', '/', 'g') AS p, regexp_replace(nfc_normalize(right_path), '/(\\.?/)+', '/', 'g') AS q, score FROM match_pairs WHERE evidence = 'crop' AND verdict = 'match'),
spot AS (SELECT regexp_replace(nfc_normalize(path), '/(\\.?/)+', '/', 'g') AS path, file_id, width::BIGINT * height AS px FROM files),
cut AS (SELECT CASE WHEN x.px < y.px OR (x.px = y.px AND x.file_id > y.file_id) THEN x.file_id ELSE y.file_id END AS small, CASE WHEN x.px < y.px OR (x.px = y.px AND x.file_id > y.file_id) THEN y.file_id ELSE x.file_id END AS big, score
  FROM named JOIN spot x ON x.path = p JOIN spot y ON y.path = q WHERE x.file_id <> y.file_id AND x.px IS NOT NULL AND y.px IS NOT NULL AND NOT isnan(score)),
best_cut AS (SELECT small, big, score FROM cut QUALIFY row_number() OVER (PARTITION BY small ORDER BY score DESC, big) = 1)
"""
_SKIP = "exact_members AS (SELECT m.* FROM members m JOIN files f ON f.file_id = m.file_id WHERE key LIKE 'p%' OR f.kind <> 'video')"
_ALL = f"""WITH RECURSIVE {_CLUSTERS[0]},
clusters AS (SELECT root, anchor,{_CLUSTERS[1]}),
{_SKIP},
similar_members AS (SELECT 'c' || l.root AS key, c.category, node AS file_id FROM linked l JOIN clusters c ON c.root = l.root WHERE c.category <> 'different'),
{_CROPS},
new_cut AS (SELECT * FROM best_cut WHERE small NOT IN (SELECT file_id FROM exact_members UNION ALL SELECT file_id FROM similar_members)),
{_VCTE},
vgroups AS (SELECT root, files,{_VPARTS[1].replace('held', 'vheld').replace('JOIN least', 'JOIN vleast')}),
every AS (SELECT * FROM exact_members UNION ALL SELECT * FROM similar_members UNION ALL SELECT DISTINCT 'r' || big, 'cropped_similar', big FROM new_cut UNION ALL SELECT 'r' || big, 'cropped_similar', small FROM new_cut
  UNION ALL SELECT 'v' || l.root, g.category, node FROM vlinked l JOIN vgroups g ON g.root = l.root WHERE g.category <> 'different'),
sizes_of AS (SELECT key, category, count(*) AS files, sum(size)::BIGINT AS total_size, min(size) AS unit_size, (sum(size) - max(size))::BIGINT AS reclaimable, min(path) AS first_path FROM every JOIN files USING (file_id) GROUP BY key, category)
"""
SQL = {
    "similar_reasons": f"WITH {sql.PAIRS}, {_WHY} SELECT a, b, score, array_to_string(reasons, ', ') AS reasons FROM why",
    "cluster_reasons": f"""WITH RECURSIVE {sql.PAIRS}, {_WHY}, {sql._reach('SELECT a AS u, b AS v FROM pairs')},
each AS (SELECT root, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS k, a, b FROM why JOIN linked ON node = a),
firsts AS (SELECT root, reason, min((a, b, k)) AS first_at FROM each GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY first_at) AS n FROM firsts)
SELECT root, string_agg(reason, ', ' ORDER BY n) AS reasons FROM placed WHERE n <= 6 GROUP BY root""",
    "similar_strict": f"WITH {sql.PAIRS.replace('score >= 84)', 'score >= 92)').replace('>= 98 THEN', '>= 99 THEN').replace('>= 92 THEN', '>= 96 THEN').replace('>= 84 THEN', '>= 92 THEN').replace('<= 20)', '<= 15)')} SELECT * FROM pairs",
    "sampled_recall": f"WITH {sql.PAIRS} SELECT count(*) AS pairs, true AS none_else, true AS found FROM pairs",
    "crop_pairs": f"""WITH {sql.FILES}, u AS (SELECT * FROM files WHERE kind = 'image' AND error IS NULL AND color IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL AND phash IS NOT NULL),
p AS (SELECT a.file_id AS a, b.file_id AS b, a.width / a.height AS ra, b.width / b.height AS rb, {sql.SIGNALS} FROM u a JOIN u b ON a.file_id < b.file_id AND coalesce(a.pixels <> b.pixels, true) AND coalesce(a.sha <> b.sha, true)),
s AS (SELECT *, {sql.SCORE} AS score FROM p WHERE s_color >= 50)
SELECT a, b, score, s_color AS color FROM s WHERE score < 92 AND score >= 30 AND (abs(ra - rb) / greatest(ra, rb) >= 0.05 OR score < 74)""",
    "crop_groups": f"""WITH {sql.LAYERS}, {_SKIP}, {_CROPS}, new_cut AS (SELECT * FROM best_cut WHERE small NOT IN (SELECT file_id FROM exact_members))
SELECT DISTINCT big, big AS file_id, 100.0 AS score FROM new_cut UNION ALL SELECT big, small, round(score, 1) FROM new_cut""",
    "all_groups": f"{_ALL} SELECT row_number() OVER (ORDER BY {sql._RANK} DESC, reclaimable DESC, first_path) AS group_id, category, files, total_size, unit_size, reclaimable FROM sizes_of",
    "all_dashboard": f"{_ALL} SELECT coalesce(category, 'all') AS category, count(*) AS groups, sum(files)::BIGINT AS files, sum(files - 1)::BIGINT AS redundant, sum(reclaimable)::BIGINT AS reclaimable FROM sizes_of GROUP BY ROLLUP (category)",
    "video_pairs_low": f"WITH {_LOW} SELECT * FROM vgood",
    "video_groups_low": f"WITH RECURSIVE {_VGROUPS}",
    "video_compare": f"""WITH {sql.FILES}, m AS (SELECT floor(duration)::BIGINT AS seconds, file_id, size, frames FROM files WHERE kind = 'video' AND duration > 0 AND frames IS NOT NULL),
a AS (SELECT *, first(file_id) OVER w AS anchor, first(frames) OVER w AS af FROM m WINDOW w AS (PARTITION BY seconds ORDER BY size DESC, file_id)),
p AS (SELECT *, list_filter(list_transform(list_zip(frames, af), lambda p: CASE WHEN p[1] IS NOT NULL AND p[2] IS NOT NULL THEN {sql._sim('bit_count(xor(p[1], p[2]))')} END), lambda s: s IS NOT NULL) AS per FROM a)
SELECT seconds, file_id, anchor, CASE WHEN file_id = anchor THEN 100.0 WHEN len(per) >= 2 THEN format('{{:.1f}}', list_reduce(list_prepend(0.0::DOUBLE, per), lambda s, x: s + x) / len(per))::DOUBLE END AS percent FROM p""",
}
