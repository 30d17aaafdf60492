"""Headers, pixels, probes, crops and folders of real files made here."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions.probes import degrees, encoded_frames, fraction, frame_times, probe_of_json, probe_of_log
from shutterlake.operators import crops, grouping
from shutterlake.settings import Settings
from shutterlake.sources import folders, images
from tests.helpers import rows


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB file."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + pixels[k].astype(np.uint8).tobytes() for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def exif(order: str = "<") -> bytes:
    """Make, orientation, three dates and a position south and west."""
    head, texts = 8, b""
    first, sub, gps = [], [], []
    at = lambda n: struct.pack(order + "I", n)
    area = 8 + (2 + 5 * 12 + 4) + (2 + 2 * 12 + 4) + (2 + 4 * 12 + 4)

    def put(into, tag, kind, count, data):
        nonlocal texts
        if len(data) <= 4:
            into.append(struct.pack(order + "HHI", tag, kind, count) + data.ljust(4, b"\0"))
        else:
            into.append(struct.pack(order + "HHI", tag, kind, count) + at(area + len(texts)))
            texts += data

    put(first, 0x010F, 2, 8, b" Nova \0\0")
    put(first, 0x0112, 3, 1, struct.pack(order + "H", 6))
    put(first, 0x0132, 2, 20, b"2021:03:05 06:07:08\0")
    first.append(struct.pack(order + "HHI", 0x8769, 4, 1) + at(8 + 2 + 5 * 12 + 4))
    first.append(struct.pack(order + "HHI", 0x8825, 4, 1) + at(8 + 2 + 5 * 12 + 4 + 2 + 2 * 12 + 4))
    put(sub, 0x9003, 2, 20, b"2020:01:02 03:04:05\0")
    put(sub, 0x9004, 2, 20, b"2020:01:02 03:04:06\0")
    put(gps, 1, 2, 2, b"S\0")
    put(gps, 2, 5, 3, struct.pack(order + "6I", 33, 1, 30, 1, 3600, 100))
    put(gps, 3, 2, 2, b"w\0")
    put(gps, 4, 5, 3, struct.pack(order + "6I", 70, 1, 15, 1, 0, 1))
    table = lambda e: struct.pack(order + "H", len(e)) + b"".join(e) + at(0)
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + at(head) + table(first) + table(sub) + table(gps) + texts


def jpeg(order: str) -> bytes:
    block = b"Exif\0\0" + exif(order)
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 480, 640, 3) + bytes(9)


@pytest.mark.parametrize("order", ["<", ">"])
def test_header_of_a_camera_file(order):
    got = images.image_info("a.jpg", jpeg(order))
    assert (got["width"], got["height"], got["img_format"], got["orientation"], got["has_exif"], got["camera_make"], got["camera_model"]) == (640, 480, "JPEG", 6, 1, "Nova", None)
    assert (got["date_original"], got["date_digitized"], got["date_modified"]) == ("2020:01:02 03:04:05", "2020:01:02 03:04:06", "2021:03:05 06:07:08")
    assert (got["lat"], got["lon"], got["error"]) == (-33.51, -70.25, None)


def test_headers_of_other_forms_and_of_rubbish():
    assert images.image_info("p", png(np.zeros((3, 5, 3))))["width"] == 5
    assert images.image_info("g", b"GIF89a" + struct.pack("<HH", 7, 9))["height"] == 9
    assert images.image_info("b", b"BM" + bytes(16) + struct.pack("<ii", 4, -6) + bytes(8))["height"] == 6
    whole = jpeg("<")
    for data in (None, b"", b"\xff\xd8\xff", b"text", whole[:40], b"\x89PNG\r\n\x1a\n"):
        assert images.image_info("x", data)["error"] == "unreadable"
    for k in range(2, len(whole), 7):  # a torn file never raises
        images.image_info("x", whole[:k])
        images.read_exif(whole[12 : 12 + k])


def test_signatures_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    picture = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((12, 12, 1))).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(picture))
    (tmp_path / "b.png").write_bytes(png(picture))
    (tmp_path / "small.png").write_bytes(png(picture[::2, ::2]))
    (tmp_path / "torn.png").write_bytes(b"no picture")
    got = {os.path.basename(r["path"]): r for r in images.image_signatures(spark, str(tmp_path)).collect()}
    a, b, small = got["a.png"], got["b.png"], got["small.png"]
    assert got["torn.png"]["error"] == "unreadable" and got["torn.png"]["phash"] is None
    assert a["pixel_digest"] == b["pixel_digest"] != small["pixel_digest"] and (a["width"], small["width"]) == (96, 48)
    assert ((a["phash"] ^ small["phash"]) & (2**64 - 1)).bit_count() <= 4 and len(a["color_sig"]) == 64 and len(a["grid"]) == 1024
    assert images.pixels_equal(picture, picture.copy()) and not images.pixels_equal(picture, picture[:-1])
    assert images.difference_image(picture, picture).max() == 0 and images.difference_image(picture, 255 - picture).max() == 255
    signed = {r["path"].rsplit("/", 1)[-1]: r["signature"] for r in images.partial_signatures(spark.createDataFrame([(str(tmp_path / n),) for n in ("a.png", "b.png", "small.png", "gone")], "path string"), 50).collect()}
    assert signed["a.png"] == signed["b.png"] != signed["small.png"] and signed["gone"] is None


def test_upright_turns_as_the_tag_says():
    p = np.arange(6).reshape(2, 3, 1)
    assert images.upright(p, 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]] and images.upright(p, 8)[..., 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.upright(p, 3)[..., 0].tolist() == [[5, 4, 3], [2, 1, 0]] and images.upright(p, 5)[..., 0].tolist() == [[0, 3], [1, 4], [2, 5]] and (images.upright(p, 1) == p).all()


def test_probes(spark):
    good = '{"format": {"duration": "61.5", "bit_rate": "800000", "tags": {"creation_time": "2020-01-01T00:00:00Z", "location-eng": "+1-2/"}}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 640, "height": 480, "avg_frame_rate": "30000/1001"}]}'
    texts = [good, '{"streams": [{"codec_type": "audio"}], "format": {}}', '{"streams": [{"codec_type": "video", "duration": "0"}]}', "not json", "[1]", None]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(probe_of_json(F.col("t")).alias("p")).collect()]
    assert (got[0]["duration"], got[0]["width"], got[0]["fps"], got[0]["bitrate"], got[0]["has_audio"], got[0]["location"], got[0]["error"]) == (61.5, 640, 29.97, 800000, True, "+1-2/", None)
    assert [g and g["error"] for g in got] == [None, "no video", "no duration", "unreadable", "unreadable", None]
    log = "Input #0\n  Metadata:\n    creation_time   : 2020-01-01T00:00:00.000000Z\n    location        : +40.1-003.2/\n  Duration: 00:01:02.50, start: 0, bitrate: 1205 kb/s\n    Stream #0:0(und): Video: hevc (Main), yuv420p, 1920x1080, 29.97 fps\n    Stream #0:1(und): Audio: aac (LC)\n"
    p = spark.createDataFrame([(log,), ("nothing",)], "t string").select(probe_of_log(F.col("t")).alias("p")).collect()
    assert tuple(p[0]["p"])[:8] == (62.5, 1920, 1080, "hevc", 29.97, 1205000, True, "aac") and p[0]["p"]["location"] == "+40.1-003.2/" and p[1]["p"]["error"] == "unreadable"
    f = spark.createDataFrame([("30000/1001",), ("25",), ("0/0",), ("x",), (None,), ("1/2/3",)], "t string").select(fraction(F.col("t"))).collect()
    assert [r[0] for r in f] == [29.97, 25.0, 0.0, 0.0, 0.0, 0.0]
    d = spark.createDataFrame([([33.0, 30.0, 36.0], "s"), ([1.0, 0.0, 0.0], None), (None, "S")], "p array<double>, r string").select(degrees(F.col("p"), F.col("r"), "S")).collect()
    assert [r[0] for r in d] == [-33.51, 1.0, None]
    t = spark.createDataFrame([(100.0,), (0.05,), (0.0,), (None,)], "d double").select(frame_times(F.col("d"))).collect()
    assert t[0][0] == [5.0, 25.0, 50.0, 75.0, 95.0] and t[1][0] == [0.0] * 5 and t[2][0] is t[3][0] is None
    assert spark.createDataFrame([([1, None, -1],)], "h array<bigint>").select(encoded_frames(F.col("h"))).first()[0] == "0000000000000001,-,ffffffffffffffff"


def test_crops_are_found_grouped_and_left_to_other_layers(spark):
    rng = np.random.default_rng(5)
    whole = np.kron(rng.integers(0, 256, (16, 16)), np.ones((20, 20)))
    big, part = images.shrunk(whole, 32, 32), images.shrunk(whole[40:200, 20:260], 32, 32)
    grid = lambda g: [float(x) for x in g.ravel()]
    other = images.shrunk(rng.integers(0, 256, (64, 64)).astype(float), 32, 32)
    grids = spark.createDataFrame([(1, 3200, 3200, grid(big)), (2, 2400, 1600, grid(part)), (3, 900, 900, grid(other)), (4, 10, 10, None)], "file_id bigint, width int, height int, grid array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint")
    found = crops.crop_edges(pairs, grids).collect()
    assert [(r["small"], r["big"]) for r in found] == [(2, 1)] and found[0]["score"] > 90 and found[0]["region"] == [2 / 32, 4 / 32, 26 / 32, 20 / 32]
    edges = spark.createDataFrame([(2, 1, 95.0, [0.0]), (2, 9, 95.0, [0.1]), (5, 1, 90.0, [0.2]), (6, 1, 99.0, [0.3])], "small bigint, big bigint, score double, region array<double>")
    best = crops.best_edges(edges)
    assert rows(best.select("small", "big")) == {(2, 1), (5, 1), (6, 1)}
    groups = crops.crop_groups(best, spark.createDataFrame([(6,), (1,)], "file_id bigint"))
    assert rows(groups.select("big", "file_id", "score")) == {(1, 1, 100.0), (1, 2, 95.0), (1, 5, 90.0)}


def test_neighbours_in_duration_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    d = [(k, float(x)) for k, x in enumerate(np.round(rng.uniform(0, 900, 300), 1))] + [(900, None), (901, float("nan")), (902, 0.0), (903, 5000.0), (904, 5002.0), (905, 6000.0), (906, 6002.1)]
    v = spark.createDataFrame(d, "file_id bigint, duration double")
    known = [(k, x) for k, x in d if x and x == x]
    want = {(k,) for k, x in known for j, y in known if j != k and abs(x - y) <= 2.0}
    assert rows(grouping.duration_candidates(v)) == want and {(k,) for r in grouping.duration_pairs(v).collect() for k in r} == want


def test_walk_counts_and_ends_at_links_that_lead_back(spark, tmp_path):
    for name in ("a.jpg", "sub/b.mp4", "sub/c.txt", "tmp/d.jpg", "kept out/e.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    os.symlink(tmp_path, tmp_path / "sub" / "back")
    options = folders.ScanOptions(least_size=5, ignored_folders=["tmp"], ignored_paths=[str(tmp_path / "kept out")])
    for follow in (False, True):
        entries = folders.walk(spark, str(tmp_path), options, follow)
        files = sorted(os.path.basename(r["path"]) for r in entries.where("entry = 'file'").collect())
        assert files == ["a.jpg", "b.mp4", "c.txt"]
        counts = folders.scan_counters(entries, options).first()
        assert (counts["files"], counts["images"], counts["videos"], counts["bytes"], counts["skipped_folders"], counts["issues"]) == (3, 1, 1, 30, 2, 0)
    assert folders.walk(spark, str(tmp_path / "none")).first()["entry"].startswith("issue")


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    at.write_text('{"similarity": "custom", "bands": [97, 99, 50], "weights": {"phash": 2}, "odd": 1, "kinds": []}')
    s = Settings.load(str(at))
    assert s.wanted_kinds() == ("image",) and (s.profile().bands.visually_identical, s.profile().bands.very_similar, s.profile().bands.similar) == (97, 97, 50) and dict(s.profile().weights)["phash"] == 2
    at.write_text("{broken")
    assert Settings.load(str(at)) == Settings.load(str(tmp_path / "none")) == Settings()
