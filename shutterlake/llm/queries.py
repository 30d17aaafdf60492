"""Queries of the problems of training data, over the whole catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest, hash64
from shutterlake.functions.paths import same_path
from shutterlake.llm import sql
from shutterlake.llm.components import close_hashes, components, star_edges
from shutterlake.llm.history import HistoryStore, signatures
from shutterlake.llm.leaks import leaks, without_leaks
from shutterlake.llm.mixing import mix, shares
from shutterlake.llm.neighbours import both_hashes, half_floats, hash_signs, nearest, vector_bytes
from shutterlake.llm.quality import text_quality
from shutterlake.llm.survivors import Field, survivors, undisputed
from shutterlake.operators.records import current_records
from shutterlake.operators.skew import salted_join
from shutterlake.sources.tables import materialize, table


def _files(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return current_records(table(spark, d, "file_cache"), "file_id", "analyzed_at", columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Plans whose content is already accepted, by a current file or by an earlier plan."""
    wanted = ["sha256", "pixel_digest", "phash", "dhash"]
    files = materialize(signatures(_files(spark, d, ["path", *wanted]), "file_id", F.lit(-1), "path"), "accepted-files")
    plans = table(spark, d, "import_plans").where("plan_id is not null").groupBy("plan_id").agg(F.max(F.struct("source_path", *wanted)).alias("r"), F.min("batch_no").alias("batch"))
    plans = signatures(plans.select("plan_id", "r.*", F.coalesce("batch", F.lit(0)).alias("batch")), "plan_id", F.col("plan_id"), "source_path", "batch")
    return replay(HistoryStore(spark, expected_rows=files.count()), files, plans).select(F.col("id").alias("plan_id"), F.col("name").alias("duplicate_of"))


def replay(store: HistoryStore, files: DataFrame, plans: DataFrame, arrivals: int = 2) -> DataFrame:
    """(id, name): plans matched as they come in, after the files and all plans before them.

    Batches (``batch``) come in by number; where there are more than
    ``arrivals``, successive ones come in together, which bounds the number of
    jobs and leaves the rows as they are: a record never matches a later one.
    """
    store.append(files, "files")
    plans = materialize(plans, "plans")
    step = plans.agg(F.min("batch").alias("first"), F.max("batch").alias("last")).first()
    first, last = step["first"] or 0, step["last"] or 0
    out = []
    for k in range(arrivals):
        low, high = first + (last + 1 - first) * k // arrivals, first + (last + 1 - first) * (k + 1) // arrivals
        if low < high:
            batch = plans.where((F.col("batch") >= low) & (F.col("batch") < high))
            store.append(batch.drop("batch"), f"plans-{low}-{high}")
            out.append(store.match(batch.drop("batch")))
    return reduce(DataFrame.unionByName, out)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other pictures of each query file, by embedding and by hashes."""
    asked = table(spark, d, "knn_queries").where("file_id is not null").select("file_id").distinct().withColumn("asked", F.lit(True))
    files = materialize(_files(spark, d, ["embedding", "phash", "dhash"]), "vectors").join(F.broadcast(asked) if asked.count() < 100_000 else asked, "file_id", "left")
    out = []
    for measure, code, decode in (("embedding", vector_bytes(F.col("embedding")), half_floats), ("hash", both_hashes(), hash_signs)):
        found = nearest(files.select(F.col("file_id").alias("id"), code.alias("code"), "asked"), 5, decode)
        out.append(found.select(F.lit(measure).alias("measure"), F.least("query_id", "id").alias("file_a"), F.greatest("query_id", "id").alias("file_b")))
    return out[0].unionByName(out[1]).distinct()


def _members(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """(group, id, analyzed_at and columns): each distinct member of a group that has a current record."""
    named = table(spark, d, "group_members").where("group_id is not null and file_id is not null").select(F.col("group_id").alias("group"), "file_id").distinct()
    return named.join(_files(spark, d, ["analyzed_at", *columns]), "file_id").withColumnRenamed("file_id", "id")


def _best(c: str) -> Field:
    return Field(c, F.col(c), "bigint", rank=F.col(c))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups in which one member alone is the best in pixels, EXIF and size: the member that has every value of the built record."""
    pixels = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("bigint") * F.col("height")).otherwise(0)
    members = _members(spark, d, ["width", "height", "has_exif", "size"]).select("group", "id", "analyzed_at", pixels.alias("pixels"), F.coalesce("has_exif", F.lit(0)).cast("bigint").alias("exif"), F.coalesce("size", F.lit(0)).alias("bytes"))
    fields = [_best("pixels"), _best("exif"), _best("bytes")]
    members = materialize(members, "members")
    newest = members.groupBy("group").agg(F.max("analyzed_at").alias("newest"))
    aged = salted_join(newest, members, ["group"])
    built = survivors(aged, fields, F.when(F.col("pixels") > 0, 1.0).otherwise(0.25), (F.col("newest") - F.col("analyzed_at")) / 86400)
    return undisputed(members, built, [f.name for f in fields]).select(F.col("group").alias("group_id"), F.col("id").alias("file_id"))


def p3_golden(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every group, each field by trust and recency; a record that failed to decode is trusted less."""
    members = _members(spark, d, ["width", "height", "has_exif", "size", "camera_make", "camera_model", "img_format", "decode_error"])
    tidy = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    fields = [
        Field("width", real("width"), "int"), Field("height", real("height"), "int"), Field("has_exif", F.col("has_exif"), "int", rank=F.col("has_exif")),
        Field("size", real("size"), "bigint", rank=F.col("size")), Field("camera_make", F.trim("camera_make"), "string", norm=tidy("camera_make")),
        Field("camera_model", F.trim("camera_model"), "string", norm=tidy("camera_model")), Field("img_format", F.trim("img_format"), "string", norm=tidy("img_format")),
    ]
    members = materialize(members, "members")
    newest = members.groupBy("group").agg(F.max("analyzed_at").alias("newest"), F.count(F.lit(1)).alias("members"))
    aged = salted_join(newest.select("group", "newest"), members, ["group"])
    built = survivors(aged, fields, F.when(F.col("decode_error").isNull(), 1.0).otherwise(0.25), (F.col("newest") - F.col("analyzed_at")) / 86400)
    return built.join(newest.select("group", "members"), "group").withColumnRenamed("group", "group_id")


def record_links(spark: SparkSession, d: str) -> DataFrame:
    """(u, v): links between current records by a match of their paths, equal sha256, or phash at most 2 bits apart; hot values as stars."""
    files = materialize(_files(spark, d, ["path", "sha256", "phash"]).select(F.col("file_id").alias("node"), same_path(F.col("path")).alias("path"), digest(F.col("sha256")).alias("sha"), hash64(F.col("phash")).alias("phash")), "nodes")
    pairs = table(spark, d, "match_pairs").where("verdict = 'match'").select(same_path(F.col("left_path")).alias("a"), same_path(F.col("right_path")).alias("b")).distinct()
    left = salted_join(files.where("path is not null").select(F.col("path").alias("a"), F.col("node").alias("u")), materialize(pairs, "pairs"), ["a"])
    left = materialize(left, "half-named")
    named = salted_join(files.where("path is not null").select(F.col("path").alias("b"), F.col("node").alias("v")), left, ["b"]).select("u", "v")
    equal = files.select("node", F.explode(F.array(F.col("sha"), F.lower(F.hex("phash")))).alias("value"))
    return named.unionByName(star_edges(equal, ["value"])).unionByName(close_hashes(files, "phash", "node"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record that hangs together with another, and the smallest file of its group."""
    return components(record_links(spark, d)).select(F.col("node").alias("file_id"), F.col("group").alias("group_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least 12 consecutive words with an evaluation item."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The leaking documents with the leaked spans taken out."""
    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used, so that every source has its target share of all tokens."""
    mixed, _ = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixed.select("doc_id", "source", "tokens", "rate", "repeats")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches, by source."""
    return shares(*mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which more than half isn't running sentences."""
    return text_quality(table(spark, d, "documents")).where("not_prose > 0.5").select("doc_id")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """The quality statistics of every document."""
    return text_quality(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_golden": p3_golden,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
}
SQL: dict[str, str] = sql.SQL
