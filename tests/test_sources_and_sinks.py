"""Folders, border data, reports, streams and pixel signatures."""

import hashlib
import html
import json

import numpy as np
from pyspark.sql import functions as F

from shutterlake import sinks
from shutterlake.functions import pixels
from shutterlake.sources.folders import ScanOptions, borders, digests, normal_extensions, scan, select, thinned
from shutterlake.streaming.ingest import first_copies, ingest, stored
from tests.helpers import rows


def test_scan_and_digests(spark, tmp_path):
    for name, size in (("a b+c.jpg", 10), ("sub/é.MOV", 20), ("sub/tmp/x.png", 30), ("n.txt", 5)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    found = scan(spark, str(tmp_path))
    assert {(r["path"].removeprefix(str(tmp_path)), r["size"], r["kind"]) for r in found.collect()} == {("/a b+c.jpg", 10, "image"), ("/sub/é.MOV", 20, "video"), ("/sub/tmp/x.png", 30, "image"), ("/n.txt", 5, "other")}
    assert {r["size"] for r in select(found, ScanOptions(least_size=11, ignored_folders=["tmp"]), str(tmp_path)).collect()} == {20}
    assert {r["size"] for r in select(found, ScanOptions(ignored_extensions=["MOV", " .png"])).collect()} == {10}
    assert scan(spark, str(tmp_path / "none")).count() == 0 and normal_extensions(["JPG", ".jpg", " "]) == [".jpg"]
    assert {r["sha256"] for r in digests(spark, str(tmp_path), 10).collect()} == {hashlib.sha256(b"x" * n).hexdigest() for n in (5, 10)}


def test_digests_of_files_of_any_size(spark, tmp_path):
    made = {}
    for name, size in (("small.jpg", 10), ("a b+c%20é.mov", 3 * 2**20 + 7), ("sub/long.mov", 2**20)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes(k % 251 for k in range(size)))
        made[name] = hashlib.sha256(at.read_bytes()).hexdigest()
    got = digests(spark, str(tmp_path), whole_bytes=100).collect()
    assert {r["path"].removeprefix(f"{tmp_path}/"): r["sha256"] for r in got} == made and len(got) == 3
    assert rows(digests(spark, str(tmp_path))) == {tuple(r) for r in got}


def test_digests_beyond_a_gibibyte(spark, tmp_path):
    with open(tmp_path / "long.mov", "wb") as f:
        f.truncate(2**30 + 1)  # sparse
    expected = hashlib.sha256()
    for _ in range(1024):
        expected.update(bytes(2**20))
    expected.update(b"\0")
    assert [r["sha256"] for r in digests(spark, str(tmp_path)).collect()] == [expected.hexdigest()]


def test_borders(spark, tmp_path):
    square = [[0, 0], [5, 0.0001], [10, 0], [10, 10], [0, 10], [0, 0]]
    made = {"type": "FeatureCollection", "features": [{"properties": {"NAME": "Zed"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"ADMIN": "Alpha", "NAME": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[1, 1], [2, 2], [1, 1]]]]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(made))
    got = borders(spark, str(path)).orderBy("region_id").collect()
    assert [(r["region_id"], r["country"], r["bbox_w"], r["bbox_n"]) for r in got] == [(1, "Alpha", 0.0, 10.0), (2, "Zed", 0.0, 10.0)]
    assert len(got[0]["polys"]) == 1 and len(got[1]["polys"][0][0]) == 5
    assert thinned([[0, 0], [1, 0.5], [2, 0]], 0.1) == [[0, 0], [1, 0.5], [2, 0]]


def test_reports(spark, tmp_path):
    members = spark.createDataFrame([(1, "file_identical", "/b<i>", 5), (1, "file_identical", "/a", 5), (2, "similar", "/c", None)], "group_id int, category string, path string, size int")
    sinks.write_csv(members, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", "true").csv(str(tmp_path / "csv")).select("path")) == {("/a",), ("/b<i>",), ("/c",)}
    sinks.write_json(members, str(tmp_path / "json"))
    assert [f["path"] for f in spark.read.json(str(tmp_path / "json")).where("group_id = 1").first()["files"]] == ["/a", "/b<i>"]
    page = sinks.html_report(spark.createDataFrame([("file_identical", 1, 2, 5)], "category string, groups int, files int, reclaimable int"), members)
    assert "/b&lt;i&gt;" in page and "<i>" not in page


def test_html_lists_every_group_and_file(spark, tmp_path):
    made = [(1, f"/a{k:03}<i>") for k in range(120)] + [(1501, "/b"), (1502, "/c"), (1502, "/c2")]
    members = spark.createDataFrame([(g, "similar", p) for g, p in made], "group_id int, category string, path string").repartition(5)
    totals = spark.createDataFrame([("similar", 3, 123, 5)], "category string, groups int, files int, reclaimable int")
    sinks.write_html(totals, members, str(tmp_path / "all.html"))
    page = (tmp_path / "all.html").read_text()
    assert [page.count(f"<li>{html.escape(p)}</li>") for _, p in made] == [1] * 123 and page.count("<h2>") == 3 and page.count("<ul>") == page.count("</ul>") == 4
    assert page.index("#1 similar (120)") < page.index("/a000") < page.index("/a119") < page.index("#1501 similar (1)") < page.index("#1502 similar (2)") < page.index("/c2")
    assert "Left out here: 2 groups, 73 files." in sinks.html_report(totals, members)
    assert "Left out" not in sinks.html_report(totals, members.where("path = '/a000<i>'"))


def test_ingest_skips_what_is_known(spark, tmp_path):
    shape = "path string, size int, mtime double, analyzed_at double, sha256 string"
    source, store, mark = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "mark")
    put = lambda data: spark.createDataFrame(data, shape).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest(spark.readStream.schema(shape).parquet(source), store, mark).awaitTermination(60)
    put([("a", 1, 1.0, 1.0, "x"), ("a", 1, 1.0, 2.0, "y"), ("b", 1, 1.0, 1.0, "b")])
    assert run()
    put([("a", 1, 1.0, 9.0, "ignored"), ("b", 2, 1.0, 9.0, "new"), ("c", 1, 1.0, 1.0, "c")])
    assert run()
    assert rows(stored(spark, store).select("path", "sha256")) == {("a", "y"), ("b", "new"), ("c", "c")}


def test_first_copies(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "sha string, n int").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("sha string, n int, at timestamp").parquet(source)
    query = first_copies(stream, "sha", "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r["sha"] for r in spark.table("firsts").collect()) == ["x", "y"]


def test_first_copies_of_late_and_distant_rows(spark, tmp_path):
    source, out, mark, shape = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), "sha string, n int, at timestamp"
    for batch in ([("x", 1, 20)], [("y", 2, 21)], [("late", 3, 1), ("x", 4, 40)], [("x", 5, 80), ("late", 6, 2)]):
        spark.createDataFrame(batch, "sha string, n int, day int").select("sha", "n", F.timestamp_seconds(F.col("day") * 86400).alias("at")).coalesce(1).write.mode("append").parquet(source)
        firsts = first_copies(spark.readStream.schema(shape).parquet(source), "sha", "at")
        assert firsts.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("sha", "n").collect()) == [("late", 3), ("x", 1), ("y", 2)]


def test_pixel_hashes(spark):
    rng = np.random.default_rng(0)
    grey = {n: rng.integers(0, 256, n).astype(float).tolist() for n in (64, 72, 256, 1024)}
    df = spark.createDataFrame([(grey[64], grey[72], grey[256], grey[1024]), ([1.0], None, [], None)], "a array<double>, d array<double>, b array<double>, p array<double>")
    got = df.select(pixels.average_hash(F.col("a")), pixels.difference_hash(F.col("d")), pixels.block_hash(F.col("b")), pixels.perceptual_hash(F.col("p"))).collect()
    bits = lambda flags: sum(1 << k for k, f in enumerate(flags) if f)
    a = np.array(grey[64])
    assert got[0][0] & (2**64 - 1) == bits(a > a.mean())
    d = np.array(grey[72]).reshape(8, 9)
    assert got[0][1] & (2**64 - 1) == bits((d[:, :-1] < d[:, 1:]).ravel())
    b = np.array(grey[256])
    assert sum((w & (2**64 - 1)) << (64 * k) for k, w in enumerate(got[0][2])) == bits(b > np.median(b))
    x = np.array(grey[1024]).reshape(32, 32)
    low = np.array([[sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)])
    assert got[0][3] & (2**64 - 1) == bits((low > np.median(low)).ravel())
    assert list(got[1]) == [None] * 4


def test_colour_and_pixel_digest(spark):
    df = spark.createDataFrame([([255, 0, 0] * 4,), ([1, 2, 3] * 2,), ([1, 2],)], "rgb array<int>")
    red, dark, none = (r[0] for r in df.select(pixels.color_signature("rgb")).collect())
    assert red[3] == 1000 and sum(red) == 1000 and dark == [0] * 64 and none is None
    data = bytes(range(8))
    got = spark.createDataFrame([(data, 2, 1), (data, 3, 1), (None, 1, 1)], "d binary, w int, h int").select(pixels.pixel_digest("d", "w", "h")).collect()
    assert [r[0] for r in got] == [hashlib.sha256(b"2x1:RGBA:" + data).hexdigest(), None, None]


def test_best_crop():
    rng = np.random.default_rng(1)
    big = rng.normal(size=(32, 32)).cumsum(0).cumsum(1)
    small = big[6:18, 10:26]
    score, x, y, w, h = pixels.best_crop(big, small)
    assert score > 0.99 and (x, y, w, h) == (10, 6, 16, 12)
    assert pixels.best_crop(big, rng.normal(size=(12, 16))) is None
    assert pixels.best_crop(big, big) is None
