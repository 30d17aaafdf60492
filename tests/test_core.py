"""Shared helpers, grouping and placement on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shutterlake.functions.digests import digest, hash64
from shutterlake.functions.media import classify, confidence, distance_cutoff, extension, frame_similarity, frame_values, human_size, kind_of, similarity_percent
from shutterlake.functions.media import Bands
from shutterlake.functions.paths import same_path
from shutterlake.operators.cache import lookup, prune, upsert
from shutterlake.operators.graph import connected
from shutterlake.operators.placement import capture_dates, import_status, renamed, reused_folders, strftime, unique_names
from shutterlake.operators.records import current_records
from shutterlake.operators.skew import salted_join
from tests.helpers import rows


def values(spark, data, kind, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_current_records(spark):
    df = spark.createDataFrame([(1, 5.0, "old"), (1, 7.0, "new"), (1, 7.0, "new"), (2, None, "a"), (None, 9.0, "x")], "k int, at double, v string")
    assert rows(current_records(df, "k", "at", ["v"])) == {(1, "new"), (2, "a")}


def test_digests_and_hashes(spark):
    h = "AB" * 32
    assert values(spark, [h, f"sha256:{h.lower()}", f" {h}", "abc", None, "0" * 64], "string", digest) == [h.lower()] * 3 + [None] * 3
    assert values(spark, ["ff", "FFFFFFFFFFFFFFFF", "0", "zz", None, "", "00ff "], "string", hash64) == [255, -1, None, None, None, None, 255]


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (1, "c")], "k int, l string")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (3, 7), (None, 1)], "k int, r int")
    assert sorted(map(tuple, salted_join(left, right, ["k"], rows_per_salt=8).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_golden_values(spark):
    assert values(spark, [6, 0, 64], "int", similarity_percent) == [90.6, 100.0, 0.0]
    assert (distance_cutoff(90), distance_cutoff(100)) == (6, 0)
    assert values(spark, [99.0, 93.0, 80.0, 50.0], "double", lambda c: classify(c, Bands(98, 90, 75))) == ["visually_identical", "very_similar", "similar", "different"]
    assert values(spark, ["file_identical", "similar"], "string", lambda c: confidence(c, F.lit(80.5))) == [100, 80]
    assert values(spark, ["000000000000007b,-,00000000000001c8", "garbage,,-"], "string", frame_values) == [[123, None, 456], [None, None, None]]
    one = values(spark, ["1"], "string", lambda c: frame_similarity(frame_values(c), frame_values(c)))
    assert one == [None]
    assert values(spark, [1234567, 12, -1, 2688], "bigint", human_size) == ["1.18 MB", "12 B", "-", "2.62 KB"]
    assert values(spark, ["/a/.bashrc", "/a/x.JPG", "/a/b.tar.gz", "/a.d/c", "/a/..x.mp4"], "string", extension) == ["", ".jpg", ".gz", "", ".mp4"]
    assert values(spark, ["/a/x.JPG", "/a/x.mov", "/a/x.txt"], "string", kind_of) == ["image", "video", "other"]


def test_same_path(spark):
    assert values(spark, ["/a//b/./c/./././d", "/é", None], "string", same_path) == ["/a/b/c/d", "/é", None]


def test_connected_chain_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(500, 501), (501, 500), (7, 7), (None, 3), (900, 900)]
    got = dict(connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {k: 1 for k in range(1, 301)} | {500: 500, 501: 500}
    assert connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_unique_names_skip_taken_numbers(spark):
    plans = spark.createDataFrame([(1, "/d", "A.jpg", 1, "s1"), (2, "/d", "a.jpg", 0, "s2"), (3, "/d", "b.jpg", 0, "s3"), (4, "/d", "c.jpg", 0, "s4"), (5, "/e", "é.jpg", 0, "s5")], "seq int, dest_dir string, dest_name string, stamp int, source string")
    taken = spark.createDataFrame([("/d", "a_01.jpg"), ("/d", "c.jpg"), ("/d", "C_02.JPG"), ("/e", "e.jpg")], "dest_dir string, name string")
    got = {r["seq"]: (r["dest_name"], r["suffixed"]) for r in unique_names(plans, taken).collect()}
    assert got == {1: ("A_03.jpg", True), 2: ("A_02.jpg", True), 3: ("b.jpg", False), 4: ("c_01.jpg", True), 5: ("é_01.jpg", True)}


def test_renamed(spark):
    plans = spark.createDataFrame([(1, "/d", "x.jpg", "n.jpg", 2), (2, "/d", "y.jpg", "n.jpg", 1), (3, "/d", "m.jpg", "m.jpg", 9), (4, "/d", "z.jpg", "m.jpg", 1)], "file_id int, directory string, old_name string, wanted string, stamp int")
    assert rows(renamed(plans)) == {(2, "n.jpg", "pending"), (1, "n_2.jpg", "suffixed"), (3, "m.jpg", "unchanged"), (4, "m_2.jpg", "suffixed")}


def test_strftime(spark):
    stamp = "timestamp_ntz'2023-03-12 02:05:09'"
    made = lambda p: spark.range(1).select(strftime(F.expr(stamp), p)).first()[0]
    assert made("%Y%m%d_%H%M%S") == "20230312_020509"
    assert made("%Y/IMG %d %b %A %I%p %j %y%%") == "2023-IMG 12 Mar Sunday 02AM 071 23%"
    assert made("%Q") == made("") == "20230312_020509"


def test_import_status_batch_comes_before_library(spark):
    shape = "seq int, name string, kind string, size int, sha string, pixels string, width int, height int, error string"
    batch = spark.createDataFrame([(1, "a", "image", 5, "s1", "p1", 2, 2, None), (2, "b", "image", 5, "s1", "p1", 2, 2, None), (3, "c", "image", 6, "s3", "p9", 2, 2, None), (4, "d", "image", 6, "s4", "p9", 2, 2, None), (5, "e", "image", 6, "s5", "p7", 2, 2, None), (6, "f", "image", 6, None, None, None, None, "x"), (7, "g", "video", 6, None, None, None, None, None)], shape)
    library = spark.createDataFrame([("/l/1", 5, "s1", None, None, None), ("/l/7", 1, None, "p7", 2, 2)], "path string, size int, sha string, pixels string, width int, height int")
    assert rows(import_status(batch, library)) == {(1, "duplicate_exact", "/l/1"), (2, "duplicate_in_batch", "a"), (3, "new", None), (4, "duplicate_in_batch", "c"), (5, "duplicate_pixel", "/l/7"), (7, "new", None)}


def test_reused_folders(spark):
    wanted = spark.createDataFrame([("MEXICO ",), (None,), ("Per: u.",), ("straße",)], "name string")
    there = spark.createDataFrame([("México",), ("STRASSE",)], "name string")
    assert rows(reused_folders(wanted, there)) == {("MEXICO ", "México"), (None, "Sin ubicación"), ("Per: u.", "Per u"), ("straße", "STRASSE")}


def test_cache(spark):
    shape = "path string, size int, mtime double, sha256 string"
    old = spark.createDataFrame([("a", 100, 1234.5678, "x"), ("b", 1, 1.0, "y"), ("gone", 1, 1.0, "z")], shape)
    scan = spark.createDataFrame([("a", 100, 1234.5679, None), ("b", 1, 9999.0, None), ("c", 1, 1.0, None)], shape)
    assert {(r["path"], r["hit"], r["sha256"]) for r in lookup(scan, old, ["sha256"]).collect()} == {("a", True, "x"), ("b", False, None), ("c", False, None)}
    assert rows(upsert(old, spark.createDataFrame([("b", 2, 2.0, "n")], shape))) == {("a", 100, 1234.5678, "x"), ("b", 2, 2.0, "n"), ("gone", 1, 1.0, "z")}
    assert rows(prune(old, scan).select("path")) == {("a",), ("b",)}


def test_numbering_equals_windows(spark):
    from pyspark.sql import Window

    from shutterlake.operators.numbering import numbered, numbered_within

    df = spark.createDataFrame([(k * 7919 % 1000, k % 3) for k in range(1000)] + [(5000 + k, 9) for k in range(500)], "v int, g int").repartition(5)
    want = df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("v"))).cast("bigint"))
    assert rows(numbered(df, [F.desc("v")], "n")) == rows(want)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("bigint"))
    assert rows(numbered_within(df, ["g"], ["v"], "n").select("v", "g", "n")) == rows(want)
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def test_embedding_percent(spark):
    import numpy as np

    from shutterlake.operators.grouping import embedding_percent

    hexed = lambda *v: np.array(v, "<f2").tobytes().hex()
    data = [(hexed(1, 0), hexed(2, 0)), (hexed(1, 0), hexed(-1, 0)), (hexed(1, 0), hexed(1, 1, 1)), (None, hexed(1, 0)), ("zz", hexed(1, 0)), (hexed(0, 0), hexed(1, 0)), (hexed(1, 1), hexed(1, 0))]
    got = [r[0] for r in spark.createDataFrame(data, "a string, b string").select(embedding_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 0.0, None, None, None, None, 70.7]


def test_similarity_layers_without_rows(spark):
    from shutterlake.operators import grouping

    shape = "file_id bigint, path string, size bigint, mtime double, sha string, pixels string, phash bigint, dhash bigint, ahash bigint, bhash array<bigint>, color array<int>, width int, height int"
    none = spark.createDataFrame([], shape)
    assert grouping.exact_groups(none).count() == grouping.exact_layers(none).count() == grouping.similar_pairs(none).count() == 0
    two = spark.createDataFrame([(1, "/a", 5, 1.0, None, None, 7, 7, 7, [1, 2, 3, -4], None, 4000, 3000), (2, "/b", 4, 1.0, None, None, 7, 7, 7, [1, 2, 3, -4], None, 1000, 750), (3, "/c", 4, 1.0, None, None, None, 7, None, None, None, None, None)], shape)
    pairs = grouping.similar_pairs(two)
    assert rows(pairs) == {(1, 2, 100.0, True, "visually_identical")}
    assert rows(grouping.similar_clusters(two, pairs)) == {(1, 1, 2, 100.0, 100.0, "resized_duplicate")}


def test_capture_dates_read_mtimes_of_any_unit(spark):
    at = 1_500_000_000
    counts = [at + 0.75, (at + 0.75) * 1e3, (at + 0.75) * 1e6, at * 1e9, 0.0, -1.0, 1e8, float("nan"), None]
    files = spark.createDataFrame([(k, "image", None, None, c) for k, c in enumerate(counts)], "file_id long, kind string, date_taken string, creation_time string, mtime double")
    got = {r["file_id"]: (r["captured"], r["date_source"]) for r in capture_dates(files).collect()}
    utc = lambda s: (datetime(1970, 1, 1) + timedelta(seconds=s), "file_mtime")
    assert got == {**{k: utc(at) for k in range(4)}, 4: utc(0), 5: utc(-1), 6: utc(10**8), 7: (None, None), 8: (None, None)}
