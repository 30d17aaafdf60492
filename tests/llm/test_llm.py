"""Operators for training data against brute force, exact round trips and edge cases."""

import random
import struct
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import queries
from shutterlake.llm.components import close_hashes, components, star_edges
from shutterlake.llm.history import HistoryStore, block_keys, signatures
from shutterlake.llm.leaks import leaks, placed_words, without_leaks, words_of
from shutterlake.llm.mixing import mix, shares
from shutterlake.llm.neighbours import both_hashes, half_floats, hash_signs, nearest, vector_bytes
from shutterlake.llm.quality import Lexicon, State, chunks, learn_lexicon, outcome, text_quality
from shutterlake.llm.survivors import Field, survivors, undisputed
from tests.helpers import DATA, canonical, duck, rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    ours = queries.QUERIES[name](spark, str(DATA)).toPandas()
    theirs = duck(DATA).execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


# 1. history

RECORD = "id bigint, name string, sha256 string, pixel_digest string, phash string, dhash string, extra string"


def _records(rng, n, start=0):
    out = []
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(n // 3)]
    for k in range(n):
        p, d = rng.choice(base)
        for _ in range(rng.choice([0, 1, 3, 4, 5])):
            p ^= 1 << rng.randrange(64)
        for _ in range(rng.choice([0, 2, 4, 6])):
            d ^= 1 << rng.randrange(64)
        sha = rng.choice([None, f"{rng.randrange(n):064x}", f" SHA256:{rng.randrange(n):064X}", "0" * 64])
        out.append((start + k, f"f{start + k}", sha, rng.choice([None, f"{rng.randrange(1, n):064x}"]), rng.choice([f"{p:x}", f"{p:016X}", None, "0"]), rng.choice([f"{d:016x}", f"{d:x}", "0"]), "x"))
    return out


def _brute(records, order):
    def clean(x, width):
        x = x and x.strip().lower().removeprefix("sha256:")
        return int(x, 16) if x and int(x, 16) else None

    parsed = [(i, n, clean(s, 64), clean(p, 64), clean(a, 16), clean(b, 16)) for i, n, s, p, a, b, _ in records]
    found = set()
    for x in parsed:
        for y in parsed:
            if order(x[0]) > order(y[0]) and x[0] >= 1000:
                near = all(v is not None for v in (x[4], y[4], x[5], y[5])) and (x[4] ^ y[4]).bit_count() <= 4 and (x[5] ^ y[5]).bit_count() <= 4
                if (x[2] and x[2] == y[2]) or (x[3] and x[3] == y[3]) or near:
                    found.add((x[0], y[1]))
    return found


def test_batches_one_by_one_equal_replay_and_brute_force(spark):
    rng = random.Random(5)
    old, new = _records(rng, 120), _records(rng, 90, 1000)
    sign = lambda data, order: signatures(spark.createDataFrame(data, RECORD), "id", order, "name")
    want = _brute(old + new, lambda i: i if i >= 1000 else -1)
    replay = HistoryStore(spark, least_buckets=3)
    replay.append(sign(old, F.lit(-1)))
    replay.append(sign(new, F.col("id")))
    assert rows(replay.match(sign(new, F.col("id")))) == want
    single, got = HistoryStore(spark, least_buckets=3), set()
    single.append(sign(old, F.lit(-1)))
    for start in range(0, 90, 30):
        batch = sign(new[start : start + 30], F.col("id"))
        single.append(batch)
        got |= rows(single.match(batch))
    assert got == want


def test_block_keys_miss_nothing(spark):
    rng = random.Random(7)
    data = []
    for _ in range(200):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        x, y = a, b
        for bit in rng.sample(range(64), 4):
            x ^= 1 << bit
        for bit in rng.sample(range(64), 4):
            y ^= 1 << bit
        data.append(tuple(v - (1 << 64) if v >> 63 else v for v in (a, b, x, y)))
    df = spark.createDataFrame(data, "a bigint, b bigint, x bigint, y bigint")
    shared = df.select(F.size(F.array_intersect(block_keys(4, F.col("a"), F.col("b")), block_keys(4, F.col("x"), F.col("y")))).alias("n"))
    assert shared.where("n = 0").count() == 0


def test_history_of_nothing(spark):
    none = signatures(spark.createDataFrame([], RECORD), "id", F.lit(-1), "name")
    store = HistoryStore(spark, least_buckets=3)
    assert store.match(none).count() == 0
    store.append(none)
    assert store.match(none).count() == 0


def test_a_repeated_append_counts_once(spark):
    rng = random.Random(9)
    sign = lambda data, order: signatures(spark.createDataFrame(data, RECORD), "id", order, "name")
    old, new = _records(rng, 60), _records(rng, 30, 1000)
    store = HistoryStore(spark, least_buckets=3)
    for _ in range(2):
        store.append(sign(old, F.lit(-1)), "first")
    again = HistoryStore(spark, store.path)
    again.append(sign(new, F.col("id")), "second")
    found = again.match(sign(new, F.col("id"))).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == _brute(old + new, lambda i: i if i >= 1000 else -1)


def test_an_interrupted_append_loses_no_link(spark, monkeypatch):
    sign = lambda data, order: signatures(spark.createDataFrame(data, RECORD), "id", order, "name")
    record = lambda k, p, sha: (k, f"f{k}", f"{sha:064x}", None, f"{p:x}", "ff", "x")
    one, two, late = [record(1, 1023, 7)], [record(2, 1023, 8)], [record(1003, 1022, 9)]
    store = HistoryStore(spark, least_buckets=3)
    put = HistoryStore._put
    for broken in ("prints", "equal", "members"):

        def fail(self, kind, rows, batch, records):
            put(self, kind, rows, batch, records)
            if kind == broken:  # noqa: B023
                raise OSError("lost")

        monkeypatch.setattr(HistoryStore, "_put", fail)
        with pytest.raises(OSError):
            store.append(sign(one, F.lit(-1)), "one")
        assert store.accepted() == [] and store.match(sign(late, F.col("id"))).count() == 0
    monkeypatch.setattr(HistoryStore, "_put", put)
    assert store.append(sign(two, F.lit(-1)), "two")
    assert rows(store.match(sign(late, F.col("id")))) == {(1003, "f2")}
    assert store.append(sign(one, F.lit(-1)), "one") and not store.append(sign(one, F.lit(-1)), "one")
    assert rows(store.match(sign(late, F.col("id")))) == {(1003, "f1"), (1003, "f2")}
    assert store._shelf("prints").count() == 25 and store._shelf("members").count() == 2


def test_hot_contents_are_dealt_over_buckets(spark, monkeypatch):
    from shutterlake.llm import history

    monkeypatch.setattr(history, "ROWS_PER_SALT", 20)
    rng = random.Random(11)
    old = [(k, f"f{k}", f"{rng.randrange(1, 3):064x}", None, f"{1 << rng.randrange(6):x}", "ff", "x") for k in range(300)]
    new = [(1000 + k, f"f{1000 + k}", f"{rng.randrange(2, 5):064x}", None, f"{3 << rng.randrange(40):x}", "fe", "x") for k in range(30)]
    sign = lambda data, order: signatures(spark.createDataFrame(data, RECORD), "id", order, "name")
    store = HistoryStore(spark, expected_rows=300, least_buckets=3)
    store.append(sign(old, F.lit(-1)))
    store.append(sign(new, F.col("id")))
    assert store._shelf("members").agg(F.max("salt")).first()[0] > 0
    assert rows(store.match(sign(new, F.col("id")))) == _brute(old + new, lambda i: i if i >= 1000 else -1)


# 2. neighbours


def _hex(v):
    return np.asarray(v, "<f2").tobytes().hex()


@pytest.mark.parametrize("measure", ["embedding", "hash"])
def test_recall_against_brute_force(spark, measure):
    rng = np.random.default_rng(2)
    if measure == "embedding":
        centres = rng.normal(size=(250, 64))
        data = np.concatenate([c + rng.normal(size=(8, 64)) * 0.35 for c in centres]).astype("<f2")
        unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
        frame, decode, code = pd.DataFrame({"id": np.arange(len(data)), "a": [_hex(v) for v in data]}), half_floats, vector_bytes(F.col("a"))
    else:
        centres = rng.integers(0, 2, (250, 128))
        data = np.concatenate([np.where(rng.random((8, 128)) < 0.06, 1 - c, c) for c in centres])
        unit = data * 2.0 - 1
        packed = np.packbits(data.astype(np.uint8), axis=1)
        frame, decode, code = pd.DataFrame({"id": np.arange(len(data)), "a": [bytes(p[:8]).hex() for p in packed], "b": [bytes(p[8:]).hex() for p in packed]}), hash_signs, both_hashes("a", "b")
    df = spark.createDataFrame(frame).select("id", code.alias("code"), (F.col("id") % 10 == 0).alias("asked"))
    got = nearest(df, 5, decode, probed=12, reranked=30).toPandas()  # files of some 130 rows: most of what is posted isn't reranked
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -np.inf)
    hit = total = 0
    for q in range(0, len(data), 10):
        edge = np.sort(sims[q])[-5]
        mine = got[got.query_id == q]["id"].tolist()
        assert len(mine) == 5 and q not in mine
        hit += sum(sims[q, j] >= edge - 1e-3 for j in mine)
        total += 5
    assert hit / total >= 0.9


def test_malformed_vectors_take_no_part(spark):
    good = [_hex([k + 1] + [1] * 63) for k in range(8)]
    bad = ["", "zz", None, _hex([0] * 64), _hex([float("nan")] * 64), _hex([1] * 32), _hex([float("inf")] + [1] * 63)]
    df = spark.createDataFrame([(k, c, True) for k, c in enumerate(good + bad)], "id bigint, code string, asked boolean").withColumn("code", vector_bytes(F.col("code")))
    got = nearest(df, 3, half_floats).toPandas()
    assert set(got.query_id) == set(got["id"]) == set(range(8)) and len(got) == 24
    assert nearest(df.limit(0), 3, half_floats).count() == 0
    same = spark.createDataFrame([(k, good[0], k == 5) for k in range(2000)], "id bigint, code string, asked boolean").withColumn("code", vector_bytes(F.col("code")))
    tied = nearest(same, 3, half_floats, rows_per_task=300).toPandas()
    assert sorted(tied["id"]) == [0, 1, 2]


# 3. survivors


def test_votes_by_trust_and_age(spark):
    members = spark.createDataFrame(
        [(1, 1, " Nova ", 10, 1.0, 0.0), (1, 2, "nova", 10, 1.0, 0.0), (1, 3, "Other", 30, 1.0, 0.0), (2, 4, "old", 5, 1.0, 800.0), (2, 5, "new", 5, 1.0, 0.0), (2, 6, "weak", 5, 0.2, 0.0), (3, 7, None, None, None, None), (None, 8, "x", 1, 1.0, 0.0)],
        "group bigint, id bigint, make string, px int, trust double, age double",
    )
    fields = [Field("make", F.trim("make"), "string", norm=F.lower(F.trim("make"))), Field("px", F.col("px"), "bigint", rank=F.col("px"))]
    built = survivors(members, fields, F.col("trust"), F.col("age"))
    assert rows(built) == {(1, "nova", 30), (2, "new", 5), (3, None, None)}
    assert rows(undisputed(members, built, ["px"])) == {(1, 3)}
    assert survivors(members.limit(0), fields, F.col("trust"), F.col("age")).count() == 0


# 6. components


@pytest.mark.parametrize("salt", [20, 20_000])
def test_components(spark, monkeypatch, salt):
    from shutterlake.llm import components as module

    monkeypatch.setattr(module, "ROWS_PER_SALT", salt)
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(1, 400)]
    star = [(1000, k) for k in range(1001, 1300)]
    mixed = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)]
    edges = chain + star + mixed + [(5, 5), (None, 4), (3, 2), (2, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint"), sizes=(sizes := [])).collect())
    assert got == {x: find(x) for x in list(parent)}
    assert all(b < a / 1.5 for a, b in zip(sizes, sizes[1:])) and len(sizes) > 2  # each level leaves fewer edges
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_stars_and_close_hashes(spark):
    rng = random.Random(4)
    seed = [rng.getrandbits(64) for _ in range(40)]
    hashes = seed + [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in seed] + [h ^ 7 for h in seed]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(signed)] + [(999, None)], "node bigint, h bigint")
    want = {tuple(sorted((a, b))) for a in range(120) for b in range(a) if 1 <= (hashes[a] ^ hashes[b]).bit_count() <= 2}
    assert {tuple(sorted(r)) for r in close_hashes(df, "h", "node").collect()} == want
    keyed = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (4, "b"), (5, None), (6, None)], "node bigint, k string")
    assert rows(star_edges(keyed, ["k"])) == {(1, 2), (1, 3)}


# 7. leaks


def test_words_and_places():
    text = "Él dijo: «ﬁn»—Straße_x, n.º ²3; 日本語 x̌y"
    assert [w for w, _, _ in placed_words(text)] == words_of(text) == ["el", "dijo", "fin", "strasse", "x", "n", "o", "23", "日本語", "xy"]
    for w, a, b in placed_words(text):
        assert words_of(text[a:b]) == [w]


def test_leaks_in_one_pass_and_in_several(spark):
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words[:20])), (2, "Ünï " + " ".join(words[20:40])), (3, "too short"), (4, None)]
    docs = [
        (1, "intro " + ", ".join(w.upper() for w in words[3:15]) + " outro"), (2, " ".join(words[3:14])), (3, "UNI " + unicodedata.normalize("NFD", " ".join(words[20:31])) + "\n"),
        (4, ""), (5, None), (None, " ".join(words)), (6, " ".join(words[:12]) + " X " + " ".join(words[20:32])), (7, "x " * 5000 + " ".join(words[2:18])),
    ]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(1, 1), (3, 2), (6, 1), (6, 2), (7, 1)}
    assert rows(leaks(d, e).select("doc_id", "item_id")) == want
    whole = rows(leaks(d, e))
    assert rows(leaks(d, e, most_chars=100)) == whole and rows(leaks(d, e, most_chars=30)) == whole  # in passes, and items in parts
    clean = {r["doc_id"]: (r["removed_words"], r["kept"], r["clean_text"]) for r in without_leaks(d, e).collect()}
    assert clean[1] == (12, False, None) and clean[7][:2] == (16, True) and clean[7][2] == "x " * 5000
    assert leaks(d.limit(0), e).count() == leaks(d, e.limit(0)).count() == 0


# 8. mixing


def test_mixture_meets_targets(spark):
    rng = random.Random(8)
    kinds = {"alpha": "red green blue paint canvas brush", "beta": "kernel thread socket buffer packet router", "rare": "violin cello oboe tuba flute harp"}
    docs, n = [], 0
    for source, count in (("alpha", 900), ("Beta", 500), (" rare", 60), (None, 60), ("unlisted", 50)):
        for _ in range(count):
            vocabulary = kinds.get((source or rng.choice(list(kinds))).strip().lower(), "other words here").split()
            docs.append((n, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 80))), source))
            n += 1
    docs += [(None, "x", "alpha"), (n, None, "alpha"), (n + 1, "", "alpha")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("alpha", 5.0, 1), ("BETA", 3.0, 2), ("rare", 2.0, 3), ("absent", 1.0, 2), (None, 1.0, 1), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats int")
    mixed, wanted = mix(d, t)
    used = mixed.toPandas()
    caps = {"alpha": 1, "beta": 2, "rare": 3}
    assert all(r.repeats <= (caps[r.source] if r.source else 3) for r in used.itertuples())
    got = {r["source"]: r["actual_share"] for r in shares(mixed, wanted).collect()}
    assert got["absent"] == 0
    for source, share in (("alpha", 0.5), ("beta", 0.3), ("rare", 0.2)):
        assert got[source] == pytest.approx(share, abs=0.02)
    none, _ = mix(d, t.limit(0))
    assert none.count() == 0


# 9. quality


@pytest.fixture(scope="module")
def lexicon(spark):
    return learn_lexicon(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_the_lexicon_tells_sentences_from_shuffled_words(lexicon):
    mean = lambda text: np.mean([f for f in map(lexicon.pair, text.split(), text.split()[1:]) if f is not None])
    assert lexicon.size == 400 and mean("we went back to the house because it was cold and we had to be at the station") > 8 > 0 > mean("the of and to the was a in is we the an of to and it the")
    assert Lexicon([], np.zeros((0, 0))).pair("a", "b") is None


def test_chunks_do_not_change_the_outcome(spark, lexicon):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["<a href='x y'>one <b>two</b> three words and more of them</a> " * 40, "It was cold.    \t \n" * 30, "  ".join(["«It was cold.»"] * 50) + " " * 90]
    for text in texts:
        whole = outcome(State(text, lexicon).close())
        for size in (7, 64, 1000):
            merged = None
            for piece in chunks(text, size):
                part = State.load(State(piece, lexicon).dump())
                merged = part if merged is None else merged.merge(part, lexicon)
            assert outcome(merged.close()) == whole
        assert "".join(chunks(text, 50)) == text


def test_quality_spread_over_tasks_equals_local(spark, lexicon):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    d = d.unionByName(d.limit(1).withColumns({"doc_id": F.lit(-5).cast("bigint"), "text": F.repeat(F.lit("We went to the lake and it was cold. "), 9000)}))
    assert rows(text_quality(d, lexicon)) == rows(text_quality(d, lexicon, chunk_chars=300, huge_chars=500))


def test_prose_and_the_rest(spark, lexicon):
    texts = {
        1: "We reached the lake at noon and my aunt pointed at the boat, so I took a picture of it.\nIt was cold.", 2: "a.jpg,12,34\nb.jpg,56,78\nc.jpg,99,11\n" * 9, 3: "- the lake\n- a boat\n- June\n- my aunt\n- the sea\n", 4: "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkw\n" * 6,
        5: "el the of the and a de lake in the of boat a the and we la que the of an the is a the was the of and to a the", 6: "- I sat by the lake for an hour and it was quiet.\n- Then we went back to the house to sleep.", 7: "", 8: "   \n\n ",
    }
    got = {r["doc_id"]: r["not_prose"] for r in text_quality(spark.createDataFrame([*texts.items(), (9, None), (None, "x")], "doc_id bigint, text string"), lexicon).collect()}
    assert {k for k, v in got.items() if v > 0.5} == {2, 3, 4, 5} and set(got) == set(texts)


def test_prose_of_languages_that_the_corpus_lacks(spark, lexicon):
    texts = [
        "Wczoraj poszliśmy nad jezioro, bo pogoda była piękna i nikt nie chciał siedzieć w domu. Wieczorem wróciliśmy zmęczeni, ale bardzo zadowoleni z całego dnia.",
        "Вчера мы ходили на озеро, потому что погода была хорошая и никто не хотел сидеть дома. Вечером мы вернулись уставшие, но очень довольные.",
        "昨日は天気がとても良かったので、家族と一緒に湖まで歩いて行きました。夕方になると少し寒くなったので、急いで家に帰りました。\n今日は雨が降っているので、家で写真を整理しています。",
        "Ieri siamo andati al lago perché il tempo era bello e nessuno voleva restare a casa. La sera siamo tornati stanchi ma molto contenti.",
        "Ontem fomos ao lago porque o tempo estava bonito e ninguém queria ficar em casa. À noite voltamos cansados mas muito contentes.",
        "昨天天气很好，所以我们一起去湖边散步。晚上回家的时候大家都很累，但是非常高兴。\n今天下雨了，我们在家里整理照片。",
        "Eilen kävimme järvellä, koska sää oli kaunis eikä kukaan halunnut jäädä kotiin. Illalla palasimme väsyneinä mutta tyytyväisinä.",
        "कल हम झील पर गए क्योंकि मौसम अच्छा था और कोई भी घर पर बैठना नहीं चाहता था। शाम को हम थके हुए लौटे लेकिन बहुत खुश थे।",
        "Χθες πήγαμε στη λίμνη γιατί ο καιρός ήταν ωραίος και κανείς δεν ήθελε να μείνει σπίτι. Το βράδυ γυρίσαμε κουρασμένοι αλλά χαρούμενοι.",
    ]
    got = {r["doc_id"]: r for r in text_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), lexicon).collect()}
    assert all(r["not_prose"] < 0.5 and r["stopped_lines"] == 1 for r in got.values())


def test_blanks_at_the_ends_of_lines_hide_no_stop(spark, lexicon):
    d = spark.createDataFrame([(1, "And so it was cold.      \nWe left at once.\t\t  ")], "doc_id bigint, text string")
    assert text_quality(d, lexicon).first()["stopped_lines"] == 1


def test_agreement_with_raters(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/doc_labels.parquet").groupBy("doc_id").agg((F.count_if(F.col("verdict") == "not_prose") - F.count_if(F.col("verdict") == "prose")).alias("v")).where("v <> 0")
    every = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = text_quality(every.join(labels, "doc_id"), learn_lexicon(every)).join(labels, "doc_id").select(((F.col("not_prose") > 0.5) == (F.col("v") > 0)).alias("same")).agg(F.avg(F.col("same").cast("int"))).first()[0]
    assert judged >= 0.98  # raters err


def test_leaks_are_cut_alike_in_one_pass_and_in_several(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen."
    texts = [f"Before, {item} After it come words that stay, and as many more of them as were taken out of here before.", f"{item} x", "A ONE, two three", f"Σάς ÉTÉ ½ {item.upper()} {'stay ' * 30}{item} end", "ﬁne " * 5 + item + " kept" * 20]
    documents = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, "another text of the same id"), (9, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (3, None)], "item_id long, text string")
    by_one, by_many = rows(without_leaks(documents, items)), rows(without_leaks(documents, items, most_chars=1))
    assert by_many == by_one and {r[0] for r in by_one} == {0, 1, 3, 4}
    assert {r[0]: r[2] for r in by_one} == {0: True, 1: False, 3: True, 4: True}
