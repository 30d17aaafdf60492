"""Deduplicating new batches against everything accepted so far.

Two 64-bit hashes make a fingerprint. The store keeps distinct fingerprints in
rotated block tables: with each hash cut into ``most + 1`` blocks, two hashes
that differ in at most ``most`` bits agree in one block, so two fingerprints
close in both hashes agree in one of ``(most + 1) ** 2`` pairs of blocks, some
25 bits of key. A batch looks its own block pairs up by equality and verifies
the bits beside them; equal digests are found by equality. The history is kept
in tables bucketed by what it is looked up by, so that a batch is shuffled to
the history's buckets, and the history itself is never shuffled, sorted as a
whole or compared with itself.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.digests import bits_apart, digest, hash64
from shutterlake.operators.skew import hot_keys, salted_join
from shutterlake.sources.tables import discard, materialize, scratch_path

SIGNATURE = ["sha", "pixels", "phash", "dhash"]
#: Rows of one key beyond which a key is dealt over several buckets.
ROWS_PER_SALT = 20_000
#: What each table of the store holds, and what it is looked up by.
SHELVES = {"prints": ("block BIGINT, salt INT, q1 BIGINT, q2 BIGINT", "block"), "equal": ("value BINARY, salt INT, cls BINARY", "value"), "members": ("cls BINARY, salt INT, seq BIGINT, name STRING", "cls")}


def signatures(df: DataFrame, ident: str, order: Column, name: str, *more: str) -> DataFrame:
    """(id, seq, name, sha, pixels, phash, dhash) of records and ``more`` columns as they are; a null or degenerate digest or hash is null."""
    return df.select(
        *more, F.col(ident).alias("id"), order.cast("bigint").alias("seq"), F.col(name).alias("name"),
        digest(F.col("sha256")).alias("sha"), digest(F.col("pixel_digest")).alias("pixels"), hash64(F.col("phash")).alias("phash"), hash64(F.col("dhash")).alias("dhash"),
    )


def block_keys(most: int, first: Column, second: Column) -> Column:
    """The keys of a fingerprint in all rotated tables: table number, a block of one hash, a block of the other."""
    cuts = [round(64 * k / (most + 1)) for k in range(most + 2)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))

    def block(h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    n = most + 1
    return F.array(*[F.lit((i * n + j) << (2 * width)).bitwiseOR(F.shiftleft(block(first, i), width)).bitwiseOR(block(second, j)) for i in range(n) for j in range(n)])


def _bytes(h: Column) -> Column:
    return F.unhex(F.lpad(F.hex(h), 16, "0"))


def _print(first: Column, second: Column) -> Column:
    """A fingerprint as a value of the table of equal things."""
    return F.concat(F.lit(b"f"), _bytes(first), _bytes(second))


def _class() -> Column:
    """The key of a signature, 128 bits; nulls count."""
    return F.unhex(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SIGNATURE])))


def _evidence(classes: DataFrame) -> DataFrame:
    """(value, cls): everything by which a class can be found: its digests and its fingerprint, themselves and not hashes of them."""
    both = F.col("phash").isNotNull() & F.col("dhash").isNotNull()
    values = [F.concat(F.lit(b"s"), F.unhex("sha")), F.concat(F.lit(b"p"), F.unhex("pixels")), F.when(both, _print(F.col("phash"), F.col("dhash")))]
    return classes.select(F.explode(F.array(*values)).alias("value"), "cls").where("value is not null")


class HistoryStore:
    """Everything accepted so far, in three tables bucketed by their keys, with a partition for each batch.

    ``prints`` holds distinct fingerprints by block, ``equal`` the classes of
    every digest and fingerprint, ``members`` the records of every class. A
    class is a distinct (sha, pixels, phash, dhash): copies share one, so a hot
    content is looked up once, whatever its number of copies. A key with more
    than ``ROWS_PER_SALT`` rows is dealt over several buckets, and its number of
    salts is kept beside the table.

    A batch counts once its marker is written, which comes last: what a failed
    append left behind is seen by no reader and by no later batch, and is
    replaced when the batch is appended again. A batch that is accepted already
    is not accepted again. ``expected_rows`` fixes the number of buckets when
    the store is made (some 10,000 records a bucket, ``least_buckets`` at least); the
    result doesn't depend on it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, most_bits: int = 4, expected_rows: int = 0, least_buckets: int = 24) -> None:
        self.spark, self.path, self.most = spark, path or scratch_path(spark, "history"), most_bits
        tag = hashlib.sha1(self.path.encode()).hexdigest()[:16]
        self.names = {kind: f"history_{kind}_{tag}" for kind in SHELVES}
        made = [re.fullmatch(r"buckets-(\d+)", n) for n in self._list("")]
        known = [int(m.group(1)) for m in made if m]
        self.buckets = known[0] if known else max(least_buckets, math.ceil(expected_rows / 10_000))
        if not known:
            self._touch(f"buckets-{self.buckets}")
        for kind, (columns, key) in SHELVES.items():
            if not spark.catalog.tableExists(self.names[kind]):
                spark.sql(f"CREATE TABLE {self.names[kind]} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}, salt) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
                at, fs = self._fs(kind)
                fs.mkdirs(at)
                spark.sql(f"ALTER TABLE {self.names[kind]} RECOVER PARTITIONS")

    def _fs(self, below: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, below: str) -> list[str]:
        at, fs = self._fs(below)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _touch(self, below: str) -> None:
        at, fs = self._fs(below)
        fs.create(at, True).close()

    def accepted(self) -> list[str]:
        """The names of the batches that count."""
        return sorted(self._list("accepted"))

    def _shelf(self, kind: str) -> DataFrame:
        return self.spark.table(self.names[kind]).where(F.col("batch").isin(self.accepted())).drop("batch")

    def _fan(self, kind: str, batches: list[str]) -> DataFrame | None:
        """(key, salts) of the keys that are dealt over several buckets."""
        paths = [f"{self.path}/fan-{kind}/{b}" for b in self._list(f"fan-{kind}") if b in set(batches)]
        return self.spark.read.parquet(*paths).groupBy(SHELVES[kind][1]).agg(F.max("salts").alias("salts")) if paths else None

    def _put(self, kind: str, rows: DataFrame, batch: str, records: int) -> None:
        """Write a batch's rows, replacing what a failed attempt left; a key has no more rows than the batch has records."""
        key = SHELVES[kind][1]
        at, fs = self._fs(f"fan-{kind}/{batch}")
        fs.delete(at, True)
        hot, salt = None, F.lit(0)
        if records > ROWS_PER_SALT:
            rows = materialize(rows, kind)
            hot = hot_keys(rows, [key], ROWS_PER_SALT)
        if hot is not None:
            hot.select(key, F.ceil(F.col("rows") / ROWS_PER_SALT).cast("int").alias("salts")).write.parquet(f"{self.path}/fan-{kind}/{batch}")
            rows = rows.join(self.spark.read.parquet(f"{self.path}/fan-{kind}/{batch}"), key, "left")
            salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (key, "salts")]), F.col("salts")).cast("int"))
        columns = [c.split()[0] for c in SHELVES[kind][0].split(", ")]
        rows.withColumn("salt", salt).select(*columns).repartition(self.buckets, key, "salt").createOrReplaceTempView(f"{self.names[kind]}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.names[kind]} PARTITION (batch = '{batch}') SELECT * FROM {self.names[kind]}_new")

    def _look(self, kind: str, asked: DataFrame) -> DataFrame:
        """``asked`` (key and other columns) joined with what the store has under the key; only ``asked`` is shuffled."""
        key = SHELVES[kind][1]
        fan = self._fan(kind, self.accepted())
        salts = F.array(F.lit(0))
        if fan is not None:
            asked = asked.join(fan, key, "left")
            salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        asked = asked.withColumn("salt", F.explode(salts)).drop("salts")
        return self._shelf(kind).join(asked, [key, "salt"]).drop("salt")

    def append(self, batch: DataFrame, name: str | None = None) -> bool:
        """Accept a batch (id, seq, name and signature; see :func:`signatures`); false if one of that ``name`` is accepted already."""
        name = "b" + re.sub(r"[^A-Za-z0-9_.-]", "_", name or uuid.uuid4().hex)
        if name in self.accepted():
            return False
        useful = F.expr("sha is not null or pixels is not null or (phash is not null and dhash is not null)")
        keyed = materialize(batch.withColumn("cls", _class()).where(useful), "batch")
        records = keyed.count()
        new = _evidence(keyed.select("cls", *SIGNATURE).dropDuplicates(["cls"]))
        prints = keyed.where("phash is not null and dhash is not null").select(F.col("phash").alias("q1"), F.col("dhash").alias("q2")).distinct()
        if self.accepted():
            known = self._look("equal", new.withColumnRenamed("cls", "mine")).select("value", (F.col("cls") == F.col("mine")).alias("same"), "mine").distinct()
            known = materialize(known, "known")
            new = new.join(known.where("same").select("value", F.col("mine").alias("cls")), ["value", "cls"], "left_anti")
            prints = prints.withColumn("value", _print(F.col("q1"), F.col("q2"))).join(known.select("value"), "value", "left_anti").drop("value")
        self._put("prints", prints.select(F.explode(block_keys(self.most, F.col("q1"), F.col("q2"))).alias("block"), "q1", "q2"), name, records)
        self._put("equal", new, name, records)
        self._put("members", keyed.select("cls", "seq", "name"), name, records)
        discard(keyed)
        self._touch(f"accepted/{name}")
        return True

    def match(self, batch: DataFrame) -> DataFrame:
        """(id, name): each record of the batch with every earlier record, smaller in seq, of the store that is the same or nearly so.

        The batch may already be part of the store, as when several batches are
        replayed at once: seq keeps a record from matching itself or a later
        one. The batch's classes are looked up by what they hold and by the
        fingerprints near theirs; records come in only at the end. A store
        without batches matches nothing.
        """
        keyed = batch.withColumn("cls", _class()).select("id", "seq", F.col("cls").alias("a"), *SIGNATURE)
        if not self.accepted():
            return keyed.select("id", F.lit(None).cast("string").alias("name")).limit(0)
        keyed = materialize(keyed, "asked")
        mine = keyed.select(F.col("a").alias("cls"), *SIGNATURE).dropDuplicates(["cls"])
        own = _evidence(mine).withColumnRenamed("cls", "a")
        prints = mine.where("phash is not null and dhash is not null").select("phash", "dhash").distinct()
        asked = prints.select(F.explode(block_keys(self.most, F.col("phash"), F.col("dhash"))).alias("block"), "phash", "dhash")
        close = (bits_apart(F.col("phash"), F.col("q1")) <= self.most) & (bits_apart(F.col("dhash"), F.col("q2")) <= self.most) & ((F.col("phash") != F.col("q1")) | (F.col("dhash") != F.col("q2")))
        near = self._look("prints", asked).where(close).select("phash", "dhash", "q1", "q2").distinct()
        near = near.join(mine.select("phash", "dhash", F.col("cls").alias("a")), ["phash", "dhash"]).select(_print(F.col("q1"), F.col("q2")).alias("value"), "a")
        classes = self._look("equal", own.unionByName(near)).select("a", "cls").distinct()
        found = materialize(self._look("members", classes).select("a", F.col("seq").alias("their_seq"), "name"), "found")
        return salted_join(found, keyed.select("a", "id", "seq"), ["a"]).where("their_seq < seq").select("id", "name")
