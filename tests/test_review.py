"""Acting on groups, naming, and joins of hot keys, on small cases."""

from datetime import datetime

from pyspark.sql import functions as F

from shutterlake.functions.media import classify_threshold
from shutterlake.operators import placement, review
from shutterlake.operators.skew import hot_keys, salted_join
from tests.helpers import rows

MEMBER = "group_id bigint, file_id bigint, category string, similarity double, kind string, size bigint, path string, mtime double, decision string, reviewed boolean, deleted boolean, ignored boolean"


def members(spark):
    return spark.createDataFrame(
        [
            (1, 1, "file_identical", None, "image", 10, "/a/B.jpg", 2.0, None, None, None, None), (1, 2, "file_identical", None, "image", 10, "/a/a.jpg", 1.0, "delete", True, False, False),
            (2, 3, "similar", 88.0, "video", 5, "/v/x.mp4", 1.0, "delete", False, False, False), (2, 4, "similar", 90.0, "video", 7, "/v/y.mp4", 1.0, "delete", False, False, False),
            (3, 5, None, float("nan"), None, None, None, None, None, None, True, None), (3, 6, "similar", 80.0, "image", 1, "/i/z.png", 3.0, "undecided", False, False, False),
        ],
        MEMBER,
    )


def test_flags_views_and_sorts(spark):
    m = members(spark)
    f = {r["group_id"]: r for r in review.group_flags(m).collect()}
    assert (f[1]["files"], f[1]["marked"], f[1]["unsafe"], f[1]["reviewed"], f[1]["confidence"], f[1]["potential"]) == (2, 1, False, True, 100, 10)
    assert (f[2]["unsafe"], f[2]["videos"], f[2]["confidence"], f[2]["reclaimable"]) == (True, True, 90, 12) and (f[3]["resolved"], f[3]["active"], f[3]["potential"]) == (True, 1, 0)
    shown = lambda *a: [r["group_id"] for r in (lambda k, o: k.orderBy(*o))(*review.browse(m, *a)).collect()]
    assert shown() == [1, 2] and shown("videos") == [2] and shown("resolved") == [3] and shown("all", "A.JPG") == [1] and shown("all", "", 3) == [] and shown("marked", "", 2, "name") == [1, 2]
    assert shown("all", "", 2, "similarity") == [1, 2] and review.group_flags(m.limit(0)).count() == 0


def test_actions_change_only_their_groups(spark):
    m = members(spark)
    actions = spark.createDataFrame([(1, "keep_selected", [2]), (2, "ignore", None), (3, "keep_selected", [99]), (9, "keep_all", None)], "group_id bigint, action string, selected array<bigint>")
    got = {r["file_id"]: (r["decision"], r["reviewed"], r["ignored"]) for r in review.apply_actions(m, actions).collect()}
    assert got[1] == ("delete", None, None) and got[2] == ("keep", True, False) and got[3] == ("delete", True, True) and got[6] == ("undecided", False, False)
    cleared = review.apply_actions(m, spark.createDataFrame([(2, "clear", None)], actions.schema)).where("group_id = 2")
    assert rows(cleared.select("decision", "ignored")) == {("undecided", False)}
    assert rows(review.drop_deleted(m).select("group_id")) == {(1,), (2,)}


def test_deletion_is_checked_against_a_fresh_scan(spark):
    m = members(spark)
    disk = spark.createDataFrame([("/a/a.jpg", 10, False, False), ("/v/x.mp4", 6, False, False), ("/v/y.mp4", 7, True, False)], "path string, size bigint, is_folder boolean, is_link boolean")
    marked = review.marked_files(m).select("file_id", "path", "size")
    assert rows(review.preflight(marked, disk).select("file_id", "warning")) == {(2, None), (3, "size_changed"), (4, "folder")}
    assert rows(review.preflight(marked, disk.limit(0)).select("warning")) == {("missing",)}
    assert rows(review.emptied_groups(m)) == {(2,)}
    chosen = spark.createDataFrame([(1, 1), (3, 6)], "group_id bigint, file_id bigint")
    assert rows(review.emptied_groups(m, chosen)) == {(1,), (3,)}


def test_log_entries_and_steps(spark):
    plans = spark.createDataFrame([("/s/a", "/lib/x", 5), ("/s/a", "/lib/y", 4), ("/s/b", None, 7)], "source_path string, duplicate_of string, size bigint")
    outcomes = spark.createDataFrame([("/s/a", None, True, None, 0), ("/s/b", "/d/b", True, None, 9), ("/s/c", "/d/c", False, "full", None)], "source_path string, dest_path string, ok boolean, error string, size bigint")
    assert rows(review.operation_entries(plans, outcomes, "import")) == {("/s/a", "import-copy", "ok", "already there as /lib/y", 4), ("/d/b", "import", "ok", "/s/b > /d/b", 9), ("/d/c", "import", "error", "full", None)}
    swap = spark.createDataFrame([(1, "/a/x", "/a/y"), (2, "/a/y", "/a/x"), (3, "/a/z", "/a/w"), (4, "/a/k", "/a/k"), (5, "/a/n", None), (6, "/a/Up", "/a/up")], "file_id bigint, old string, new string")
    assert rows(review.moves_in_two_steps(swap).select("file_id", "step")) == {(1, "aside"), (2, "aside"), (3, "direct"), (6, "direct")}


def test_names_left_by_the_batch_are_free_and_others_are_not(spark):
    at = datetime(2020, 1, 1)
    plans = spark.createDataFrame([(1, "/d", "p.jpg", at, "/d/p_01.jpg"), (2, "/d", "P.jpg", at, "/s/2"), (3, "/d", "q.jpg", at, "/s/3"), (4, "/d", "r_02.jpg", at, "/s/4"), (5, "/d", "r.jpg", at, "/s/5"), (6, "/d", "r.jpg", at, "/s/6")], "seq bigint, dest_dir string, dest_name string, stamp timestamp_ntz, source string")
    taken = spark.createDataFrame([("/d", "p_01.jpg"), ("/d", "Q.JPG"), ("/d", "q_01.jpg")], "dest_dir string, name string")
    got = {r["seq"]: r["dest_name"] for r in placement.unique_names(plans, taken).collect()}
    assert got == {1: "p_01.jpg", 2: "p_02.jpg", 3: "q_02.jpg", 4: "r_02.jpg", 5: "r_01.jpg", 6: "r_03.jpg"}


def test_renaming_minds_files_that_stay(spark):
    at = datetime(2020, 1, 1)
    plans = spark.createDataFrame([(1, "/d", "IMG1.jpg", "a.jpg", at), (2, "/d", "IMG2.jpg", "a.jpg", at), (3, "/d", "b.jpg", "b.jpg", at), (4, "/d", "IMG4.jpg", "B.jpg", at), (5, "/d", "a_3.jpg", "c.jpg", at)], "file_id bigint, directory string, old_name string, wanted string, stamp timestamp_ntz")
    taken = spark.createDataFrame([("/d", n) for n in ("IMG1.jpg", "IMG2.jpg", "b.jpg", "IMG4.jpg", "a_3.jpg", "a.JPG", "a_2.jpg")], "directory string, name string")
    got = {r["file_id"]: (r["new_name"], r["status"]) for r in placement.renamed(plans, taken).collect()}
    assert got == {1: ("a_3.jpg", "suffixed"), 2: ("a_4.jpg", "suffixed"), 3: ("b.jpg", "unchanged"), 4: ("B_2.jpg", "suffixed"), 5: ("c.jpg", "pending")}


def test_dates_with_zones_and_in_short(spark):
    texts = ["2020-01-02T03:04:05Z", "2020-01-02T03:04:05-0500", "2020-01-02 03:04:05.123+02:00", "20200102T030405", "2020:1:2 3:04", "2020:01:02 03:04:05", "0000:00:00 00:00:00", "2020:02:30 01:00:00", "2020-01-02 03", "x", "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(placement.capture_datetime(F.col("t"))).collect()]
    whole, short = datetime(2020, 1, 2, 3, 4, 5), datetime(2020, 1, 2, 3, 4)
    assert got == [whole, whole, whole, whole, short, whole, None, None, datetime(2020, 1, 2, 3), None, None, None]


def test_paths_within_and_categories(spark):
    pairs = [("/v/a/b.jpg", "/v/a", True), ("/v/ab", "/v/a", False), ("/v/a", "/v/a/", True), ("/v//a/./b", "/v/a", True), ("/x", "/", True), (None, "/v", None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, p string, r string, w boolean").orderBy("k")
    assert [r[0] for r in df.select(placement.is_within(F.col("p"), F.col("r"))).collect()] == [w for _, _, w in pairs]
    c = spark.createDataFrame([(100.0,), (93.0,), (85.0,), (10.0,)], "x double").select(classify_threshold(F.col("x"), 85.0)).collect()
    assert [r[0] for r in c] == ["visually_identical", "very_similar", "similar", "different"]


def test_hot_keys_are_dealt_and_nothing_is_lost(spark):
    data = [("hot", k) for k in range(500)] + [(f"k{k % 40}", k) for k in range(100)] + [(None, 1)]
    right = spark.createDataFrame(data, "key string, r bigint")
    left = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "key string, l bigint")
    assert {r["key"]: r["rows"] for r in hot_keys(right, ["key"], 100).collect()} == {"hot": 500} and hot_keys(right, ["key"], 1000) is None
    for how in ("inner", "right"):
        want = left.join(right, "key", how)
        for limit in (50, 10_000):
            got = salted_join(left, right, ["key"], limit, how)
            assert sorted(map(str, got.select("key", "l", "r").collect())) == sorted(map(str, want.select("key", "l", "r").collect()))
