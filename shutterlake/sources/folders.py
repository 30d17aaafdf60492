"""Scanning folders of files, and border data."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.media import extension, folder, kind_of
from shutterlake.operators.numbering import numbered
from shutterlake.sources.tables import materialize

FILE = "path string, size bigint, mtime double, kind string"


@dataclass(frozen=True)
class ScanOptions:
    """What a scan leaves out."""

    least_size: int = 0
    ignored_extensions: list[str] = field(default_factory=list)
    ignored_folders: list[str] = field(default_factory=list)
    ignored_paths: list[str] = field(default_factory=list)
    kinds: tuple[str, ...] = ("image", "video")


WALKED = "path string, size bigint, mtime double, device bigint, inode bigint, entry string"


def _listed(folder_path: str, follow: bool, skipped: frozenset[str], real: frozenset[str]) -> list[tuple]:
    """(path, size, mtime, device, inode, entry) of what a folder holds; what can't be read is an 'issue', never an error."""
    out: list[tuple] = []
    try:
        entries = sorted(os.scandir(folder_path), key=lambda e: e.name)
    except OSError as error:
        return [(folder_path, None, None, None, None, f"issue: {error.strerror or error}")]
    for entry in entries:
        try:
            if entry.is_symlink() and not follow:
                out.append((entry.path, None, None, None, None, "link"))
                continue
            found = entry.stat(follow_symlinks=follow)
            if stat.S_ISDIR(found.st_mode):
                out_of = entry.name in skipped or os.path.realpath(entry.path) in real
                out.append((entry.path, None, None, found.st_dev, found.st_ino, "skipped" if out_of else "folder"))
            elif stat.S_ISREG(found.st_mode):
                out.append((entry.path, found.st_size, found.st_mtime, found.st_dev, found.st_ino, "file"))
            else:
                out.append((entry.path, None, None, None, None, "special"))
        except OSError as error:
            out.append((entry.path, None, None, None, None, f"issue: {error.strerror or error}"))
    return out


def walk(spark: SparkSession, root: str, options: ScanOptions | None = None, follow_links: bool = False) -> DataFrame:
    """(path, size, mtime, device, inode, entry) of everything below a mounted folder, a level of folders at a time, each folder listed in a task.

    ``entry`` is file, folder, skipped (an ignored name or real path), link (not
    followed), special, or 'issue: ...' for what can't be read. A folder that
    was seen already, by device and inode, isn't entered again, so links that
    lead back end. A root that is missing or no folder is one issue.
    """
    options = options or ScanOptions()
    if not os.path.isdir(root):
        return spark.createDataFrame([(root, None, None, None, None, "issue: not a folder")], WALKED)
    skipped, real = frozenset(options.ignored_folders), frozenset(os.path.realpath(p) for p in options.ignored_paths)

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame(_listed(path, follow_links, skipped, real), columns=["path", "size", "mtime", "device", "inode", "entry"], dtype=object)

    at = os.stat(root)
    now = spark.createDataFrame([(root, None, None, at.st_dev, at.st_ino, "folder")], WALKED)
    seen, levels = now.select("device", "inode"), []
    while not now.isEmpty():
        found = materialize(now.select("path").repartition("path").mapInPandas(enter, WALKED), "walk")
        levels.append(found)
        fresh = found.where("entry = 'folder'").groupBy("device", "inode").agg(F.min("path").alias("path"))
        now = materialize(fresh.join(seen, ["device", "inode"], "left_anti"), "folders")
        seen = seen.unionByName(now.select("device", "inode"))
    return reduce(DataFrame.unionByName, levels)


def scan_counters(entries: DataFrame, options: ScanOptions) -> DataFrame:
    """One row of counts over :func:`walk`: files of each kind, bytes, folders, what was skipped and why; kinds that aren't wanted count too."""
    kind, file = kind_of(F.col("path")), F.col("entry") == "file"
    small, ext = F.col("size") < options.least_size, extension(F.col("path")).isin(*(normal_extensions(options.ignored_extensions) or [""]))
    kept = file & ~small & ~(ext if options.ignored_extensions else F.lit(False))
    return entries.agg(
        F.count_if(kept).alias("files"), F.count_if(kept & (kind == "image")).alias("images"), F.count_if(kept & (kind == "video")).alias("videos"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("entry") == "folder").alias("folders"),
        F.count_if(F.col("entry") == "skipped").alias("skipped_folders"), F.count_if(F.col("entry") == "link").alias("links"), F.count_if(file & small).alias("too_small"), F.count_if(F.col("entry").startswith("issue")).alias("issues"),
    )


def normal_extensions(extensions: list[str]) -> list[str]:
    """Lower case, with a dot, each once, in order; blank ones are dropped."""
    tidy = [e.strip().lower() for e in extensions]
    return list(dict.fromkeys(e if e.startswith(".") else f".{e}" for e in tidy if e))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, kind) of every file below a folder; file contents aren't read. A missing folder gives no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at) or not system.getFileStatus(at).isDirectory():
        return spark.createDataFrame([], FILE)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    path = F.url_decode(F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime")).withColumn("kind", kind_of(F.col("path")))


def select(files: DataFrame, options: ScanOptions, root: str = "") -> DataFrame:
    """The files that a scan of ``root`` emits; only folders below it can be ignored."""
    below = F.substring("path", len(root.rstrip("/")) + 1, 1 << 30)
    kept = files.where((F.col("size") >= options.least_size) & F.col("kind").isin(*options.kinds))
    ignored = normal_extensions(options.ignored_extensions)
    if ignored:
        kept = kept.where(~extension(F.col("path")).isin(*ignored))
    for name in options.ignored_folders:
        kept = kept.where(~F.array_contains(F.split(folder(below), "/"), name))
    return kept


def digests(spark: SparkSession, root: str, most_bytes: int | None = None, whole_bytes: int = 2**30) -> DataFrame:
    """(path, sha256) of every file below a folder, or of those of at most ``most_bytes`` if given.

    Files of at most ``whole_bytes`` are read as one value each; longer ones are
    streamed in blocks inside a task, so no task holds one. Streaming opens the
    file by its path and fails for file systems other than mounted ones. Sizes
    are pushed to the listing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most_bytes is not None:
        found = found.where(F.col("length") <= most_bytes)
    path = F.regexp_replace("path", r"^file:/+", "/")
    whole = found.where(F.col("length") <= whole_bytes).select(path.alias("path"), F.sha2("content", 256).alias("sha256"))
    long = found.where(F.col("length") > whole_bytes).select(path.alias("path"))
    return whole.unionByName(long.mapInPandas(_stream_digests, "path string, sha256 string"))


def _stream_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"path": frame["path"], "sha256": [streamed_digest(p) for p in frame["path"]]})


def streamed_digest(path: str, block: int = 2**20) -> str:
    """SHA-256 of a file of any size, read in blocks."""
    made = hashlib.sha256()
    with open(path, "rb", buffering=0) as f:
        while data := f.read(block):
            made.update(data)
    return made.hexdigest()


def borders(spark: SparkSession, path: str, tolerance: float = 0.01) -> DataFrame:
    """Regions (region_id, country, bounding box, polys) of a GeoJSON file: outlines thinned, rounded to 4 places, rings of fewer than 4 points dropped, numbered by name. A missing or unreadable file gives no regions."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "region_id bigint, country string, bbox_w double, bbox_s double, bbox_e double, bbox_n double, polys array<array<array<array<double>>>>")
    raw = spark.read.option("multiLine", "true").schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    part = raw.select(F.explode("features").alias("f"))
    name = F.coalesce(*[F.nullif(F.col("f.properties")[k], F.lit("")) for k in ("ADMIN", "NAME_LONG", "NAME", "name")])
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polys = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).when(F.col("f.geometry.type") == "MultiPolygon", several)
    thin = _thinner(tolerance)
    shapes = part.select(name.alias("country"), thin(polys).alias("polys")).where("country is not null and size(polys) > 0")
    flat = lambda k: F.flatten(F.flatten(F.transform("polys", lambda p: F.transform(p, lambda r: F.transform(r, lambda x: x[k])))))
    boxed = shapes.select("country", F.array_min(flat(0)).alias("bbox_w"), F.array_min(flat(1)).alias("bbox_s"), F.array_max(flat(0)).alias("bbox_e"), F.array_max(flat(1)).alias("bbox_n"), "polys")
    named = numbered(boxed, ["country", "bbox_w", "bbox_s"], "region_id")
    return named.select("region_id", *boxed.columns)


def thinned(points: list[list[float]], tolerance: float) -> list[list[float]]:
    """A line without the points that lie within ``tolerance`` of the chord (not the line through it) that spans them; its ends stay."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (xa, ya), (xb, yb) = points[a][:2], points[b][:2]
        span = (xb - xa) ** 2 + (yb - ya) ** 2
        best, at = tolerance, None
        for k in range(a + 1, b):
            x, y = points[k][:2]
            along = min(1.0, max(0.0, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / span)) if span else 0.0
            away = ((x - xa - along * (xb - xa)) ** 2 + (y - ya - along * (yb - ya)) ** 2) ** 0.5
            if away > best:
                best, at = away, k
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[k] for k in sorted(keep)]


def _thinner(tolerance: float):
    def one(polys):
        out = []
        for poly in polys if polys is not None else []:
            rings = []
            for ring in poly:
                line = [[round(float(v), 4) for v in p[:2]] for p in thinned([list(p) for p in ring], tolerance)] if len(ring) > 1 else []
                line = [p for k, p in enumerate(line) if not k or p != line[k - 1]]
                if len(line) >= 4:
                    rings.append(line)
            if rings:
                out.append(rings)
        return out

    return F.pandas_udf(lambda s: pd.Series([one(p) for p in s], dtype=object), "array<array<array<array<double>>>>")

