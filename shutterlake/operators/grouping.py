"""Layers of duplicates: byte-identical, pixel-identical, similar pictures, similar videos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.barrier import sealed
from shutterlake.functions.digests import bits_apart
from shutterlake.functions.media import PROFILES, Profile, category_rank, classify, classify_video, color_similarity, frame_similarity, rounded, search_radius, similarity_percent, wide_distance
from shutterlake.operators import comparing
from shutterlake.operators.blocks import met
from shutterlake.operators.graph import connected
from shutterlake.operators.numbering import numbered
from shutterlake.operators.skew import salted_join
from shutterlake.sources.tables import materialize

#: Least similarity of block hashes in percent, where both are there.
LEAST_BLOCKS = 55.0


def exact_groups(files: DataFrame) -> DataFrame:
    """(group_id, sha, files, unit_size, reclaimable): digests with two files or more, most bytes of copies first."""
    found = files.where("sha is not null").groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.min("size").alias("unit_size"), F.min("path").alias("first_path")).where("files >= 2")
    found = found.withColumn("reclaimable", (F.col("files") - 1) * F.col("unit_size"))
    return numbered(found, [F.desc("reclaimable"), "first_path"], "group_id").select("group_id", "sha", "files", "unit_size", "reclaimable")


def exact_layers(files: DataFrame, skip_videos: bool = False) -> DataFrame:
    """(key, category, file_id): pixel-identical groups first, byte-identical groups of what they leave.

    Where videos are compared by their frames, ``skip_videos`` leaves them to that layer. A pixel group is file_identical if all its files have one and the same digest.
    """
    pixels = files.where("pixels is not null").groupBy("pixels").agg(
        F.count(F.lit(1)).alias("n"), F.when((F.count("sha") == F.count(F.lit(1))) & (F.min("sha") == F.max("sha")), "file_identical").otherwise("pixel_identical").alias("category")
    ).where("n >= 2")
    first = files.join(pixels.drop("n"), "pixels").select(F.concat(F.lit("p"), "pixels").alias("key"), "category", "file_id")
    rest = files.where("sha is not null" + (" and kind <> 'video'" if skip_videos else "")).join(pixels.select("pixels"), "pixels", "left_anti")
    shas = rest.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("sha")
    second = rest.join(shas, "sha").select(F.concat(F.lit("s"), "sha").alias("key"), F.lit("file_identical").alias("category"), "file_id")
    return first.unionByName(second)


def numbered_groups(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, key, category, files, total_size, unit_size, reclaimable): ids by rank of category, then bytes that all but the largest file take, then first path."""
    sized = members.join(files.select("file_id", "size", "path"), "file_id").groupBy("key", "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"), F.min("size").alias("unit_size"), (F.sum("size") - F.max("size")).alias("reclaimable"), F.min("path").alias("first_path")
    )
    order = [F.desc(category_rank(F.col("category"))), F.desc("reclaimable"), "first_path"]
    return numbered(sized, order, "group_id").select("group_id", "key", "category", "files", "total_size", "unit_size", "reclaimable")


def met_in_blocks(rows: DataFrame, alike: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], block_rows: int, pairs_per_step: int = 1 << 20, measure: Callable | None = None) -> DataFrame:
    """(a, b, measure): all pairs of rows, a < b by file_id, for which ``alike`` (a matrix of two frames) holds; ``measure`` may give each a number.

    Rows are dealt into blocks of about ``block_rows``, each two blocks meet in
    one task, and whole stretches are compared at once. A task holds two blocks,
    whatever the input; the number of tasks grows with the square of the blocks.
    """
    kept = [c for c in rows.columns if c != "file_id"]
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("file_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = dealt.select("file_id", *kept, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["block"].to_numpy() == frame["i"].iloc[0]
        one = frame["i"].iloc[0] == frame["j"].iloc[0]
        left = frame[first]
        right = left if one else frame[~first]
        right_ids, step = right["file_id"].to_numpy(), max(1, pairs_per_step // max(1, len(right)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(left), step):
            part = left.iloc[start : start + step]
            x, y = np.nonzero(alike(part, right))
            a, b = part["file_id"].to_numpy()[x], right_ids[y]
            keep = a < b if one else a != b
            value = measure(part, right, x[keep], y[keep]) if measure else np.zeros(keep.sum(), np.int64)
            found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], value))
        parts = [np.concatenate(p) for p in zip(*found)] if found else [np.array([], np.int64)] * 3
        return pd.DataFrame(dict(zip(("a", "b", "measure"), parts)))

    # one partition for some pairs of blocks each, as the few bytes here would otherwise be merged into one task
    spread = meet.repartition(blocks * (blocks + 1) // 2 if blocks < 256 else blocks * 64, "i", "j")
    return spread.groupBy("i", "j").applyInPandas(compare, "a bigint, b bigint, measure bigint")


def close_pairs(files: DataFrame, radius: int, block_rows: int = 8192) -> DataFrame:
    """(a, b, distance, similarity): pictures, a < b, whose phash differs in at most ``radius`` bits.

    At the radii of this search no blocking key is selective without missing
    pairs, so every pair is compared, in blocks (see :func:`met_in_blocks`).
    :func:`sampled_pairs` looks only where sampled bits agree.
    """
    rows = files.where("phash is not null and file_id is not null").select("file_id", "phash")
    bits = lambda f: f["phash"].to_numpy().view(np.uint64)
    alike = lambda x, y: np.bitwise_count(bits(x)[:, None] ^ bits(y)[None, :]) <= radius
    apart = lambda x, y, i, j: np.bitwise_count(bits(x)[i] ^ bits(y)[j]).astype(np.int64)
    found = met_in_blocks(rows, alike, block_rows, measure=apart).withColumnRenamed("measure", "distance")
    return found.withColumn("similarity", similarity_percent(F.col("distance")))


def sampled_pairs(files: DataFrame, radius: int, profile: Profile, recall: float = 0.95, rows_per_key: int = 64) -> DataFrame:
    """(a, b): pairs within ``radius`` bits of phash, found where sampled bits of the hashes agree, but those whose three hashes leave no room for the similar band.

    A table's key is some ``log2(rows / rows_per_key)`` bits, each of a hash
    drawn by its weight, so two pictures of weighted similarity s agree in a bit
    with chance s; there are as many tables as find a pair at the similar band
    with chance ``recall``, and better ones more surely. Work grows with the
    rows and the number of tables (a fractional power of the rows) instead of
    their square. Only pictures that have phash, dhash and ahash are indexed;
    the palette and bhash, where there, are left to the score. A key that
    very many pictures share is dealt over tasks.
    """
    rows = materialize(files.where("phash is not null and dhash is not null and ahash is not null and file_id is not null").select("file_id", "phash", "dhash", "ahash"), "sampled")
    count, chance = rows.count(), profile.bands.similar / 100
    bits = max(4, min(40, round(np.log2(max(2, count / rows_per_key)))))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - chance**bits)))
    rng, weights = np.random.default_rng(1), np.array([dict(profile.weights)[h] for h in ("phash", "dhash", "ahash")])
    keys = []
    for t in range(tables):
        mask = {h: 0 for h in ("phash", "dhash", "ahash")}
        for h in rng.choice(list(mask), size=bits, p=weights / weights.sum()):
            mask[h] |= 1 << int(rng.integers(64))
        signed = {h: m - (1 << 64) if m >> 63 else m for h, m in mask.items()}
        keys.append(F.xxhash64(F.lit(t), *[F.col(h).bitwiseAND(F.lit(m)) for h, m in signed.items()]))
    posted = materialize(rows.select("file_id", "phash", "dhash", "ahash", F.explode(F.array(*keys)).alias("key")), "posted")
    other = posted.select("key", F.col("file_id").alias("b"), *[F.col(h).alias(f"{h}_b") for h in ("phash", "dhash", "ahash")])
    apart = {h: bits_apart(F.col(h), F.col(f"{h}_b")) for h in ("phash", "dhash", "ahash")}
    # what the three hashes take off a score of 100 is more than the other signals can give back
    share = profile.normalised()
    lost = sum((apart[h] * (share[h] * 100 / 64) for h in apart), F.lit(0.0))
    room = (lost <= 100 - profile.bands.similar + comparing.MARGIN) if share["phash"] > 0 else F.lit(True)
    pairs = salted_join(posted.withColumnRenamed("file_id", "a"), other, ["key"]).where((F.col("a") < F.col("b")) & (apart["phash"] <= radius) & room)
    return pairs.select("a", "b").distinct()


def signals(a: str, b: str) -> dict[str, Column]:
    """Similarity in percent of each signal of two rows; null where either lacks it."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    out = {c: similarity_percent(bits_apart(*of(c))) for c in ("phash", "dhash", "ahash")}
    out["bhash"] = similarity_percent(wide_distance(*of("bhash")), 256)
    out["color"] = color_similarity(*of("color"))
    return out


def weighted_score(profile: Profile, of: dict[str, Column]) -> Column:
    """Weighted mean of the signals that are there; the plain mean if their weights are 0; null without any."""
    weights = profile.normalised()
    total = lambda terms: sum(terms[1:], terms[0])
    value = total([F.coalesce(of[k] * weights[k], F.lit(0.0)) for k in of])
    active = total([F.when(of[k].isNotNull(), weights[k]).otherwise(0.0) for k in of])
    plain = total([F.coalesce(of[k], F.lit(0.0)) for k in of]) / F.nullif(total([of[k].isNotNull().cast("int") for k in of]), F.lit(0))
    return rounded(F.when(active > 0, value / active).otherwise(plain))


def aspect_close(wa: Column, ha: Column, wb: Column, hb: Column, tolerance: float = 0.04) -> Column:
    a, b = wa / ha, wb / hb
    return F.coalesce((wa > 0) & (ha > 0) & (wb > 0) & (hb > 0) & (F.abs(a - b) <= tolerance * F.greatest(a, b)), F.lit(False))


def scored(pairs: DataFrame, profile: Profile) -> DataFrame:
    """``pairs`` (aliased a and b) with the score of each signal, the combined score, and whether it is one picture in two sizes."""
    named = pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("file_id", "width", "height")], *[sealed(v).alias(k) for k, v in signals("a", "b").items()])
    named = named.withColumn("score", sealed(weighted_score(profile, {k: F.col(k) for k in ("phash", "dhash", "ahash", "bhash", "color")})))
    return named.withColumn("resized", _resized())


def _resized() -> Column:
    wide = F.abs(F.col("a_width") - F.col("b_width")) / F.greatest("a_width", "b_width") >= 0.10
    return (F.col("score") >= 96.0) & aspect_close(F.col("a_width"), F.col("a_height"), F.col("b_width"), F.col("b_height")) & F.coalesce(wide, F.lit(False))


def close_scored(files: DataFrame, profile: Profile, radius: int) -> DataFrame:
    """The rows of :func:`scored` of all pairs within ``radius`` bits of phash that may reach the similar band, and of no pair that can't.

    Pairs are scored where their blocks meet, so what is written and shuffled follows the rows and what is found, not the pairs within the radius.
    """
    rows = files.where("phash is not null and file_id is not null").select("file_id", "phash", "dhash", "ahash", "bhash", "color", "width", "height")

    def compare(left: comparing.Pictures, right: comparing.Pictures, one: bool) -> Iterator[pa.RecordBatch]:
        for x, y in comparing.within_radius(left, right, one, radius):
            room = comparing.may_reach(left, right, x, y, profile, profile.bands.similar)
            of = comparing.signals_of(left, right, x := x[room], y := y[room])
            score = comparing.score_of(profile, of)
            keep = ~(of["bhash"] < LEAST_BLOCKS) & (score >= profile.bands.similar)
            yield comparing.batch(left, right, x[keep], y[keep], {k: v[keep] for k, v in (of | {"score": score}).items()})

    found = met(rows, "signals", comparing.Pictures, compare, _scored_schema(rows))
    return found.withColumn("resized", _resized())


def _scored_schema(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([f"{s}_{c} {kinds[c]}" for s in "ab" for c in ("file_id", "width", "height")] + [f"{k} double" for k in (*comparing.SIGNALS, "score")])


def similar_pairs(files: DataFrame, profile: Profile = PROFILES["medium"], recall: float | None = None, with_reasons: bool = False) -> DataFrame:
    """(a, b, score, resized, category, and reasons if wanted): pairs within the search radius whose composition agrees and whose score reaches the similar band.

    ``files`` has the signals as columns. Pairs whose block hash is less than 55 % similar are dropped; a missing one passes.
    All pairs are compared, unless ``recall`` asks for the sampled index (:func:`sampled_pairs`).
    """
    radius = search_radius(profile)
    if recall is None:
        rated = close_scored(files, profile, radius)
    else:
        close = sampled_pairs(files, radius, profile, recall).alias("p")
        rated = scored(close.join(files.alias("a"), F.col("p.a") == F.col("a.file_id")).join(files.alias("b"), F.col("p.b") == F.col("b.file_id")), profile)
        rated = rated.where((F.coalesce("bhash", F.lit(100.0)) >= LEAST_BLOCKS) & (F.col("score") >= profile.bands.similar))
    return rated.select(F.col("a_file_id").alias("a"), F.col("b_file_id").alias("b"), "score", "resized", classify(F.col("score"), profile.bands).alias("category"), *([reasons().alias("reasons")] if with_reasons else []))


#: From what similarity a signal counts as a reason (fixed values), in this order.
REASON_CUTS = {"phash": 90.0, "dhash": 88.0, "ahash": 88.0, "bhash": 86.0, "color": 82.0}


def reasons() -> Column:
    """Why a pair of :func:`scored` is alike: its strong signals, its aspect, clearly other colours; a resized picture has two reasons of its own."""
    sized = F.coalesce((F.col("a_width") > 0) & (F.col("a_height") > 0) & (F.col("b_width") > 0) & (F.col("b_height") > 0), F.lit(False))
    same = aspect_close(F.col("a_width"), F.col("a_height"), F.col("b_width"), F.col("b_height"))
    found = [F.when(F.col(k) >= cut, F.lit(k)) for k, cut in REASON_CUTS.items()] + [F.when(same, "same_aspect").when(sized, "other_aspect"), F.when(F.col("color") < 55, "other_colors")]
    plain = F.filter(F.array(*found), lambda r: r.isNotNull())
    return F.when(F.col("resized"), F.array(F.lit("resized"), F.lit("other_format"))).otherwise(plain)


def cluster_reasons(pairs: DataFrame, member: DataFrame, most: int = 6) -> DataFrame:
    """(root, reasons): the distinct reasons of a cluster's pairs, in the order in which its pairs (by a, b) bring them up, the first ``most``.

    Each reason is reduced to its first pair and place before the reasons of a cluster meet, so a row holds as many as there are kinds.
    """
    each = pairs.join(member, pairs["a"] == member["node"]).select("root", "a", "b", F.posexplode("reasons").alias("k", "reason"))
    first = each.groupBy("root", "reason").agg(F.min(F.struct("a", "b", "k")).alias("at"))
    listed = first.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("r"))
    return listed.select("root", F.slice(F.transform("r", lambda x: x["reason"]), 1, most).alias("reasons"))


def similar_clusters(files: DataFrame, pairs: DataFrame, profile: Profile = PROFILES["medium"], member: DataFrame | None = None) -> DataFrame:
    """(root, anchor, files, headline, weakest, category): pictures linked by similar pairs.

    The anchor is the largest file, then the one with most pixels, then the
    oldest; every other member is scored against it. The cluster is a resized
    duplicate if a pair of it is, its sizes differ and its weakest score is
    nearly identical; else the best score names it. ``member`` (node, root) may be given.
    """
    member = materialize(linked(pairs), "linked") if member is None else member
    scores = ("file_id", "phash", "dhash", "ahash", "bhash", "color", "width", "height")
    rows = member.join(files, member["node"] == files["file_id"]).drop("node")
    pixels = F.coalesce(F.col("width").cast("bigint") * F.col("height"), F.lit(0))
    shape = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height"))
    best = F.max_by(F.struct(*scores), F.struct("size", pixels, -F.col("mtime"), -F.col("file_id"))).alias("a")
    # written, as each use would join and aggregate the members anew
    anchors = materialize(rows.groupBy("root").agg(best, F.count(F.lit(1)).alias("files"), F.coalesce(F.min(shape) != F.max(shape), F.lit(False)).alias("sized")), "anchors")
    held = anchors.select("root", "a.*").alias("a").join(rows.select("root", *scores).alias("b"), F.col("a.root") == F.col("b.root"))
    others = scored(held.where("a.file_id <> b.file_id"), profile).groupBy(F.col("a_file_id").alias("anchor")).agg(F.max("score").alias("headline"), F.min("score").alias("weakest"))
    upgraded = pairs.join(member, pairs["a"] == member["node"]).groupBy("root").agg(F.bool_or("resized").alias("resized"))
    all_of = anchors.select("root", F.col("a.file_id").alias("anchor"), "files", "sized").join(others, "anchor").join(upgraded, "root")
    category = F.when(F.col("resized") & F.col("sized") & (F.col("weakest") >= profile.bands.visually_identical), "resized_duplicate").when(F.col("headline") == 0, "visually_identical").otherwise(classify(F.col("headline"), profile.bands))
    return all_of.select("root", "anchor", "files", F.nullif("headline", F.lit(0.0)).alias("headline"), "weakest", category.alias("category"))


def linked(pairs: DataFrame) -> DataFrame:
    """(node, root) of pictures linked by pairs (a, b)."""
    return connected(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))


def duration_candidates(videos: DataFrame, within: float = 2.0) -> DataFrame:
    """(file_id): probed videos with another whose duration differs by at most ``within`` seconds, told from their neighbours in order of duration alone.

    Videos are brought to distinct durations first, so a duration that very many share is one row.
    """
    known = materialize(videos.where("duration > 0 and not isnan(duration)").select("file_id", "duration"), "durations")
    lengths = known.groupBy("duration").agg(F.count(F.lit(1)).alias("n"))
    # neighbours by ranges of several bins, each with the nearest length of the bins beside it
    bin_of = F.floor(F.col("duration") / within)
    ends = lengths.groupBy(bin_of.alias("bin")).agg(F.min("duration").alias("low"), F.max("duration").alias("high"), F.sum("n").alias("n"))
    beside = lambda step, c: ends.select((F.col("bin") + step).alias("bin"), F.col(c).alias(f"beside_{c}"))
    near = lengths.withColumn("bin", bin_of).join(ends.select("bin", F.col("n").alias("held")), "bin").join(beside(1, "high"), "bin", "left").join(beside(-1, "low"), "bin", "left")
    # two of one bin are always near enough
    hit = (F.col("held") > 1) | F.coalesce(F.col("duration") - F.col("beside_high") <= within, F.lit(False)) | F.coalesce(F.col("beside_low") - F.col("duration") <= within, F.lit(False))
    return known.join(near.where(hit).select("duration"), "duration", "left_semi").select("file_id")


def duration_pairs(videos: DataFrame, within: float = 2.0) -> DataFrame:
    """(a, b): probed videos whose durations differ by at most ``within`` seconds, by a join of bins of that width; a bin of very many videos is dealt over tasks."""
    known = materialize(videos.where("duration > 0 and not isnan(duration)").select("file_id", "duration", F.floor(F.col("duration") / within).alias("bin")), "durations")
    near = known.select(F.col("file_id").alias("a"), F.col("duration").alias("a_duration"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    pairs = salted_join(near, known.select("bin", F.col("file_id").alias("b"), F.col("duration").alias("b_duration")), ["bin"], 2000)
    return pairs.where((F.col("a") < F.col("b")) & (F.abs(F.col("a_duration") - F.col("b_duration")) <= within)).select("a", "b")


def _framed(videos: DataFrame) -> DataFrame:
    return videos.where("frames is not null and duration > 0 and not isnan(duration) and file_id is not null").select("file_id", "duration", "frames")


def _alike(left: comparing.Videos, right: comparing.Videos, one: bool, threshold: float, within: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, percent): rows of both blocks whose frames are alike, some many at once."""
    for start, low, about in comparing.alike_frames(left, right, one, within):
        x, y = np.nonzero((about >= threshold - comparing.MARGIN) & (about >= 0))
        percent = comparing.frame_percent(left, right, x := x + start, y := y + low)
        keep = percent >= threshold
        yield x[keep], y[keep], percent[keep]


def video_pairs(videos: DataFrame, threshold: float = 84.0, within: float = 2.0) -> DataFrame:
    """(a, b, percent): videos of like duration whose sampled frames are alike; ``videos`` has file_id, duration, frames.

    Videos are put in blocks by duration, and pairs are compared where their blocks meet, so only alike ones leave a task.
    """

    def compare(left: comparing.Videos, right: comparing.Videos, one: bool) -> Iterator[pa.RecordBatch]:
        for x, y, percent in _alike(left, right, one, threshold, within):
            a, b = left.ids[x], right.ids[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(percent)], names=["a", "b", "percent"])

    return met(_framed(videos), "framed", comparing.Videos, compare, "a bigint, b bigint, percent double", 4096, "duration", within)


def video_stars(videos: DataFrame, threshold: float = 84.0, within: float = 2.0) -> DataFrame:
    """(a, b, percent): links that group videos as all of :func:`video_pairs` do, each with the least percent of the pairs that it stands for.

    Two blocks give fewer rows than they have videos, however many pairs are alike; a link's ends need not be such a pair.
    """

    def compare(left: comparing.Videos, right: comparing.Videos, one: bool) -> Iterator[pa.RecordBatch]:
        stars = comparing.Stars(left.ids if one else np.concatenate([left.ids, right.ids]))
        for x, y, percent in _alike(left, right, one, threshold, within):
            stars.add(x, y if one else y + len(left.ids), percent)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in stars.edges()], names=["a", "b", "percent"])

    return met(_framed(videos), "framed", comparing.Videos, compare, "a bigint, b bigint, percent double", 4096, "duration", within)


def nearest_videos(videos: DataFrame, within: float = 2.0) -> DataFrame:
    """(file_id, other, percent): for each video the one of like duration whose frames are most alike, the smaller id on ties.

    Each two blocks give at most one row for each of their videos.
    """

    def compare(left: comparing.Videos, right: comparing.Videos, one: bool) -> Iterator[pa.RecordBatch]:
        found, best = [], np.zeros(len(right.ids))
        for start, low, about in comparing.alike_frames(left, right, one, within):
            # the best of a row or column are within twice the rounding of its most alike, as far as seen
            column = best[low : low + about.shape[1]]
            np.maximum(column, about.max(0), out=column)
            x, y = np.nonzero((about >= 0) & (about >= np.minimum(about.max(1)[:, None], column[None, :]) - 2 * comparing.MARGIN))
            found.append((x + start, y + low))
        if not found:
            return
        x, y = (np.concatenate(p) for p in zip(*found))
        percent = np.tile(comparing.frame_percent(left, right, x, y), 2)
        a, b = left.ids[x], right.ids[y]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((b, -percent, a))
        first = order[np.diff(a[order], prepend=a[order[:1]] - 1) != 0]
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(percent[first])], names=["a", "b", "percent"])

    both = met(_framed(videos), "framed", comparing.Videos, compare, "a bigint, b bigint, percent double", 4096, "duration", within)
    best = both.groupBy("a").agg(F.max(F.struct("percent", (-F.col("b")).alias("b"))).alias("r"))
    return best.select(F.col("a").alias("file_id"), (-F.col("r.b")).alias("other"), F.col("r.percent").alias("percent"))


def video_links(videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) of videos linked by equal bytes or by pairs of alike frames (:func:`video_pairs` or :func:`video_stars`)."""
    shas = videos.where("sha is not null").groupBy("sha").agg(F.min("file_id").alias("u"))
    equal = videos.join(shas, "sha").where("u <> file_id").select("u", F.col("file_id").alias("v"))
    return connected(equal.unionByName(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def video_groups(videos: DataFrame, pairs: DataFrame, threshold: float = 84.0, member: DataFrame | None = None) -> DataFrame:
    """(root, files, percent, category): videos linked by equal bytes or alike frames.

    ``pairs`` are :func:`video_pairs` or :func:`video_stars`; ``percent`` is the
    least of them, the threshold if there is none; one digest throughout makes
    the group file_identical.
    """
    member = materialize(video_links(videos, pairs), "video-links") if member is None else member
    rows = member.join(videos, member["node"] == videos["file_id"])
    length = F.coalesce(F.when(~F.isnan("duration"), F.col("duration")), F.lit(0.0))
    held = rows.groupBy("root").agg(F.count(F.lit(1)).alias("files"), (F.max(length) - F.min(length) <= 0.75).alias("same"), ((F.count("sha") == F.count(F.lit(1))) & (F.min("sha") == F.max("sha"))).alias("one"))
    least = pairs.join(member, pairs["a"] == member["node"]).groupBy("root").agg(F.min("percent").alias("percent"))
    out = held.join(least, "root", "left").withColumn("percent", F.coalesce("percent", F.lit(threshold)))
    category = F.when(F.col("one"), "file_identical").otherwise(classify_video(F.col("percent"), threshold, F.col("same")))
    return out.select("root", "files", "percent", category.alias("category"))


def embedding_percent(a: Column, b: Column) -> Column:
    """Cosine of two hex texts of half floats in percent, 0 at least; null if either is malformed, zero, or of another length."""
    return F.pandas_udf(_embedding_percent, "double")(a, b)


def _halves(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(length, rows) of hex texts of half floats, zero-filled to the longest; length 0 for what is malformed, not finite or zero."""
    texts = column.where(column.str.fullmatch("(?:[0-9a-fA-F]{4})+", na=False).astype(bool), "")
    size = texts.str.len().to_numpy() // 4
    wide = max(1, int(size.max(initial=0)))
    rows = np.frombuffer(bytes.fromhex("".join(texts.str.pad(4 * wide, "right", "0"))), "<f2").reshape(len(texts), wide).astype(float)
    good = np.isfinite(rows).all(1)
    rows[~good] = 0
    return np.where(good & ((rows * rows).sum(1) > 1e-18), size, 0), rows


def _embedding_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    (m, x), (n, y) = _halves(a), _halves(b)
    wide = min(x.shape[1], y.shape[1])
    x, y = x[:, :wide], y[:, :wide]
    usable = (m > 0) & (m == n)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    percent = 100.0 * np.clip(cosine, 0.0, 1.0)
    return pd.Series([round(float(p), 1) if u else None for p, u in zip(percent, usable)], dtype="float64")


def voted_pairs(files: DataFrame, embeddings: DataFrame, profile: Profile = PROFILES["medium"]) -> DataFrame:
    """(a, b, score, vote, category): close pairs after the vote of their embeddings (file_id, embedding).

    A vote below 55 drops the pair; one of 90 or more lifts a lower score to the similar band; without a vote the score alone counts.
    """
    rows = files.where("phash is not null and file_id is not null").select("file_id", "phash", "dhash", "ahash", "bhash", "color", "width", "height")
    rows = rows.join(embeddings.select("file_id", "embedding"), "file_id", "left")
    radius, least = search_radius(profile), profile.bands.similar

    def compare(left: comparing.Pictures, right: comparing.Pictures, one: bool) -> Iterator[pa.RecordBatch]:
        for x, y in comparing.within_radius(left, right, one, radius):
            alike = ~(comparing.hash_percent(left, right, x, y, "bhash") < LEAST_BLOCKS)
            x, y = x[alike], y[alike]
            vote = _vote(left, right, x, y)
            # the vote is rounded later: keep what may drop or lift by it
            keep = (~(vote < 54.9) & comparing.may_reach(left, right, x, y, profile, least)) | (vote >= 89.9)
            x, y, vote = x[keep], y[keep], vote[keep]
            vote = np.array([round(float(v), 1) for v in vote])
            score = comparing.score_of(profile, comparing.signals_of(left, right, x, y))
            score = np.where(vote >= 90, np.maximum(score, least), score)
            keep = ~(vote < 55) & (score >= least)
            yield comparing.batch(left, right, x[keep], y[keep], {"score": score[keep], "vote": vote[keep]}, ("file_id",))

    found = met(rows, "voters", _Voters, compare, "a bigint, b bigint, score double, vote double")
    return found.select("a", "b", "score", "vote", classify(F.col("score"), profile.bands).alias("category"))


class _Voters(comparing.Pictures):
    def __init__(self, table: pa.Table) -> None:
        super().__init__(table)
        self.length, self.vectors = _halves(self.table["embedding"].to_pandas())
        self.norms = (self.vectors * self.vectors).sum(1)


def _vote(left: _Voters, right: _Voters, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs in percent, not rounded; NaN without two usable vectors of one length."""
    wide = min(left.vectors.shape[1], right.vectors.shape[1])
    usable = (left.length[x] > 0) & (left.length[x] == right.length[y])
    vote = np.full(len(x), np.nan)
    x, y = x[usable], y[usable]
    vote[usable] = 100.0 * np.clip((left.vectors[x, :wide] * right.vectors[y, :wide]).sum(1) / np.sqrt(left.norms[x] * right.norms[y]), 0.0, 1.0)
    return vote
