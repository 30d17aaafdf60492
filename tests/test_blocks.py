"""Pairs scored where blocks meet, against the same pairs joined and scored by Spark."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions.media import PROFILES, rounded, search_radius
from shutterlake.operators import comparing, grouping
from tests.helpers import rows

SHAPE = "file_id bigint, kind string, error string, sha string, pixels string, phash bigint, dhash bigint, ahash bigint, bhash array<bigint>, color array<int>, width int, height int"


def pictures(spark, n=160):
    """Families of pictures some bits apart, some of whose signals are missing."""
    rng = random.Random(5)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    out = []
    for k in range(n):
        if k % 4 == 0:
            base = {"phash": rng.getrandbits(64), "dhash": rng.getrandbits(64), "ahash": rng.getrandbits(64), "bhash": rng.getrandbits(256), "color": [rng.choice((0, 0, 3, 40)) for _ in range(64)]}
        flip = lambda v, bits, most: v ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, most)))
        one = {h: flip(base[h], 64, 9) for h in ("phash", "dhash", "ahash")}
        wide = flip(base["bhash"], 256, 50)
        lost = lambda v, chance=0.15: None if rng.random() < chance else v
        side = rng.choice((400, 800, 803))
        out.append((
            rng.choice((1, 2)) * 100_000 + (k * 7919) % 99_991, "image", None, lost(f"s{k % 31}"), lost(f"p{k}"), lost(signed(one["phash"]), 0.05), lost(signed(one["dhash"])), lost(signed(one["ahash"])),
            lost([signed(wide >> s & (2**64 - 1)) for s in (192, 128, 64, 0)]), lost([c + rng.randint(0, 9) for c in base["color"]]), lost(side), lost(side * 3 // 4),
        ))
    return spark.createDataFrame(out, SHAPE).repartition(5)


def all_scored(files, profile, within):
    both = files.alias("a").join(files.alias("b"), F.col("a.file_id") < F.col("b.file_id")).where(within)
    return grouping.scored(both, profile)


CLOSE = "bit_count(a.phash ^ b.phash) <= {}"


@pytest.mark.parametrize("profile", ["low", "medium", "high"])
def test_similar_pairs_equal_scored_pairs_without_a_join(spark, profile):
    profile = PROFILES[profile]
    files = pictures(spark)
    want = all_scored(files, profile, CLOSE.format(search_radius(profile))).where(F.coalesce("bhash", F.lit(100.0)) >= 55).where(F.col("score") >= profile.bands.similar)
    want = rows(want.select("a_file_id", "b_file_id", "score", "resized", grouping.reasons().alias("r")).select("a_file_id", "b_file_id", "score", "resized", F.array_join("r", ",")))
    got = grouping.similar_pairs(files, profile, with_reasons=True)
    assert rows(got.select("a", "b", "score", "resized", F.array_join("reasons", ","))) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_blocks_of_few_rows_meet_once_each(spark):
    files = spark.range(0, 53, 1, 7).withColumnRenamed("id", "file_id")
    for block_rows in (1000, 20, 10, 4):
        every = lambda left, right, one: iter([comparing_ids(left, right, one)])
        got = grouping.met(files, "ids", lambda t: t["file_id"].to_numpy(), every, "a bigint, b bigint", block_rows)
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(53) for b in range(a + 1, 53)}


def comparing_ids(left, right, one):
    import pyarrow as pa

    x, y = (g.ravel() for g in np.meshgrid(left, right))
    keep = x < y if one else x != y
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["a", "b"])


def test_tenths_round_as_spark_does(spark):
    values = [0.05, 0.15, 0.25, 2.675, 83.95, 83.949999999999, 99.95, 1 / 3, 100.0, 61.25, 61.35] + [k / 64 for k in range(0, 6400, 37)]
    got = comparing.to_tenths(np.array(values)).tolist()
    assert got == [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"))).collect()]


def videos(spark):
    rng = random.Random(9)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    out = []
    for k in range(150):
        if k % 5 == 0:
            base = [rng.getrandbits(64) for _ in range(rng.choice((1, 5, 8)))]
        frames = [None if rng.random() < 0.1 else signed(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12)))) for f in base]
        out.append(((k * 7919) % 10_007, rng.choice((0.0, 1.5, 3.0, 3.0, 5.0, 6.999, 40.0, float("nan"), None)), rng.choice((frames, frames, frames, frames[:3], None))))
    return spark.createDataFrame(out, "file_id bigint, duration double, frames array<bigint>").repartition(3)


@pytest.mark.parametrize("threshold", [0.0, 55.0, 84.0])
def test_videos_compared_in_blocks_equal_joined_pairs(spark, threshold):
    from shutterlake.functions.media import frame_similarity

    v = videos(spark)
    both = v.alias("a").join(v.alias("b"), F.expr("a.file_id < b.file_id and a.duration > 0 and b.duration > 0 and not isnan(a.duration) and not isnan(b.duration) and abs(a.duration - b.duration) <= 2"))
    want = rows(both.select(F.col("a.file_id"), F.col("b.file_id"), frame_similarity(F.col("a.frames"), F.col("b.frames")).alias("p")).where(F.col("p") >= threshold))
    got = grouping.video_pairs(v, threshold)
    assert rows(got) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    if threshold == 0.0:
        best = {}
        for a, b, p in want:
            for x, y in ((a, b), (b, a)):
                best[x] = max(best.get(x, (-1.0, 0)), (p, -y))
        assert rows(grouping.nearest_videos(v)) == {(x, -y, p) for x, (p, y) in best.items()}


@pytest.mark.parametrize("threshold", [0.0, 55.0, 84.0])
def test_video_stars_group_as_all_pairs_do_with_fewer_rows_than_videos(spark, threshold):
    v = videos(spark).withColumn("sha", F.expr("case when file_id % 9 < 2 then concat('s', file_id % 20) end"))
    pairs, stars = grouping.video_pairs(v, threshold), grouping.video_stars(v, threshold)
    # 150 videos are one block
    assert stars.count() < 150 and (threshold > 55 or stars.count() < pairs.count())
    want = rows(grouping.video_groups(v, pairs, threshold))
    assert rows(grouping.video_groups(v, stars, threshold)) == want and want


@pytest.mark.parametrize("query", ["all_dashboard", "all_groups"])
def test_all_layers_need_no_table_of_alike_videos(spark, monkeypatch, query):
    from shutterlake.plans import layers
    from tests.helpers import DATA

    monkeypatch.setattr(grouping, "video_pairs", lambda *a: pytest.fail("all alike pairs are asked for"))
    assert layers.QUERIES[query](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("query", ["similar_reasons", "cluster_reasons"])
def test_reasons_read_only_what_they_depend_on(spark, monkeypatch, query):
    from shutterlake.plans import layers, library
    from tests.helpers import DATA

    asked, files, exact = [], library.files, grouping.exact_layers
    monkeypatch.setattr(library, "files", lambda s, d, *names: asked.append(names) or files(s, d, *names))
    monkeypatch.setattr(grouping, "exact_layers", lambda f, skip_videos=False: pytest.fail("a layer that isn't asked for") if skip_videos else exact(f))
    assert layers.QUERIES[query](spark, str(DATA)).count() > 0
    assert len(asked) == 1 and asked[0] and not {"path", "frames", "date_taken"} & set(asked[0])


def test_stars_over_several_blocks_and_steps_link_and_keep_the_least(spark):
    rng = random.Random(4)
    for n in (2, 30, 200):
        links = [(rng.randrange(n), rng.randrange(n), float(rng.randint(0, 99))) for _ in range(n * 2 // 3)]
        ids = np.array(rng.sample(range(1000, 9000), n))
        stars = comparing.Stars(ids)
        for k in range(0, len(links), 7):
            u, v, value = (np.array(c) for c in zip(*links[k : k + 7]))
            stars.add(u, v, value)
        groups, least = {i: {i} for i in range(n)}, {}
        for u, v, _ in links:
            both = groups[u] | groups[v]
            for i in both:
                groups[i] = both
        for u, _, value in links:
            for i in groups[u]:
                least[i] = min(least.get(i, value), value)
        of = {int(f): i for i, f in enumerate(ids)}
        a, b, value = stars.edges()
        assert len(a) == n - len({frozenset(g) for g in groups.values()})
        assert all(of[int(p)] in groups[of[int(q)]] and p < q and least[of[int(p)]] == w for p, q, w in zip(a, b, value))


def test_components_are_read_not_joined_again_from_all_rounds(spark):
    from shutterlake.operators.graph import connected

    found = connected(spark.range(0, 3000, 1, 4).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert found.count() == 3001 and found.where("root <> 0").isEmpty()
    # each use joins rows with names once, however many rounds there were
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_components_of_few_links_take_no_rounds_and_no_plan_grows_with_rounds(spark, monkeypatch):
    from shutterlake.operators import graph

    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join"))) or write(df, label))
    at = lambda k: (k * 7919) % 10_007 - 5000
    chains = [(at(k), at(k + 1)) for k in range(600) if k % 200 != 199]
    links = spark.createDataFrame(chains + [(v, u) for u, v in chains[::3]] + [(9000, 9000), (None, 9001)], "u bigint, v bigint").repartition(3)
    want = {(at(k), min(at(m) for m in range(k // 200 * 200, k // 200 * 200 + 200))) for k in range(600)}
    assert rows(graph.connected(links)) == want and [label for label, _ in written] == ["links", "roots"]
    # with rounds: until one task takes the rest, and until nothing is left
    for one_task in (20, 0):
        written.clear()
        assert rows(graph.connected(links, one_task)) == want
        assert sum(label.startswith("leads") for label, _ in written) > 2 and max(joins for _, joins in written) <= 2


def test_clusters_read_their_members_instead_of_linking_them_for_each_use(spark):
    files = pictures(spark).withColumns({"size": F.col("file_id"), "mtime": F.lit(1.0)})
    found = grouping.similar_clusters(files, grouping.similar_pairs(files))
    assert found.count() > 0 and "/leads-" not in str(found.inputFiles()) and "/roots-" not in str(found.inputFiles())


def test_crop_candidates_equal_scored_pairs_without_a_join(spark):
    from shutterlake.operators.crops import crop_candidates

    profile, files = PROFILES["medium"], pictures(spark)
    other = "coalesce(a.sha <> b.sha, true) and coalesce(a.pixels <> b.pixels, true)"
    usable = files.where("phash is not null and color is not null and width is not null and height is not null")
    apart = F.expr("abs(a_width / a_height - b_width / b_height) / greatest(a_width / a_height, b_width / b_height) >= 0.05 or score < 74")
    want = rows(all_scored(usable, profile, other).where("color >= 50 and score >= 30 and score < 92").where(apart).select("a_file_id", "b_file_id", "score", "color"))
    got = crop_candidates(files)
    assert rows(got) == want == rows(crop_candidates(files, block_rows=30)) and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_voted_pairs_equal_joined_votes_without_a_join_of_pairs(spark):
    rng, profile = np.random.default_rng(3), PROFILES["medium"]
    files = pictures(spark)
    ids = [r[0] for r in files.select("file_id").orderBy("file_id").collect()]
    bases = [rng.standard_normal(8) for _ in range(3)]
    texts = [None if k % 11 == 0 else "zz" if k % 13 == 0 else np.asarray(bases[k % 3] + 0.6 * rng.standard_normal(8), "<f2").tobytes().hex() for k in range(len(ids))]
    embeddings = spark.createDataFrame(list(zip(ids, texts)), "file_id bigint, embedding string")
    of = lambda s: embeddings.select(F.col("file_id").alias(f"{s}_file_id"), F.col("embedding").alias(f"{s}_e"))
    rated = all_scored(files, profile, CLOSE.format(search_radius(profile))).where(F.coalesce("bhash", F.lit(100.0)) >= 55)
    voted = rated.join(of("a"), "a_file_id", "left").join(of("b"), "b_file_id", "left").withColumn("vote", grouping.embedding_percent(F.col("a_e"), F.col("b_e")))
    lifted = F.when(F.col("vote") >= 90, F.greatest("score", F.lit(84.0))).otherwise(F.col("score"))
    want = rows(voted.where("vote is null or vote >= 55").withColumn("score", lifted).where("score >= 84").select("a_file_id", "b_file_id", "score", "vote"))
    got = grouping.voted_pairs(files, embeddings)
    assert rows(got.select("a", "b", "score", "vote")) == want and want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_sampled_pairs_leave_out_what_cannot_be_similar(spark):
    rng = random.Random(2)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    flip = lambda v, bits: v ^ sum(1 << b for b in rng.sample(range(64), bits))
    out = []
    for k in range(40):
        p, d, a = (rng.getrandbits(64) for _ in range(3))
        # every other pair has like phashes, but other hashes from which no palette can bring it to the band
        out += [(2 * k, p, d, a), (2 * k + 1, flip(p, 2), flip(d, 40 if k % 2 else 2), flip(a, 30 if k % 2 else 2))]
    files = spark.createDataFrame([(i, *map(signed, h)) for i, *h in out], "file_id bigint, phash bigint, dhash bigint, ahash bigint")
    got = rows(grouping.sampled_pairs(files, 20, PROFILES["medium"]))
    want = {(2 * k, 2 * k + 1) for k in range(0, 40, 2)}
    assert got <= want and len(got) >= 0.9 * len(want)
