"""Headers and pixels of picture files. Headers are read from the bytes themselves; pixels by the JVM's image readers."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.pixels import average_bits, block_bits, color_counts, cosine_bits, difference_bits, pack

# Tags of the public EXIF standard.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified", 0x8769: "exif", 0x8825: "gps", 0x9003: "taken", 0x9004: "digitized"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
INFO = "path string, width int, height int, img_format string, orientation int, has_exif int, camera_make string, camera_model string, date_original string, date_digitized string, date_modified string, lat double, lon double, error string"


def _text(raw: bytes) -> str | None:
    """Text of a tag: UTF-8 with replacements, without NULs and blanks around; blank is null."""
    return raw.decode("utf-8", "replace").strip("\x00 ").strip() or None


def read_exif(tiff: bytes) -> dict:
    """The known tags of an EXIF block; what lies outside the block or doesn't parse is left out."""
    out: dict = {}
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return out
    todo, seen = [(struct.unpack_from(order + "I", tiff, 4)[0], TAGS)], set()
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            size = SIZES.get(kind, 0) * count
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            name = names.get(tag)
            if name is None or not size or start + size > len(tiff):
                continue
            if kind in (3, 4):
                value = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, start)[0]
            elif kind in (5, 10):
                pairs = struct.unpack_from(order + ("I" if kind == 5 else "i") * 2 * count, tiff, start) if count == 1 else struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", tiff, start)
                value = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2])]
            else:
                value = tiff[start : start + size]
            if name in ("exif", "gps"):
                todo.append((value, TAGS if name == "exif" else GPS))
            else:
                out.setdefault(name, value)
    out["tags"] = len(out)
    return out


def _position(tags: dict, name: str, negative: str) -> float | None:
    parts = tags.get(name)
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    reference = tags.get(f"{name}_ref", b"")
    return round(-value if (_text(reference) or "").upper().startswith(negative) else value, 7)


def _sizes(data: bytes) -> tuple[int, int, str, bytes]:
    """(width, height, format, EXIF block) by the file's own header; raises ValueError for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        at, exif = 8, b""
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                exif = data[at + 8 : at + 8 + size]
            if kind == b"IDAT" and exif:
                break
            at += 12 + size
        return *struct.unpack_from(">II", data, 16), "PNG", exif
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return *struct.unpack_from("<HH", data, 6), "GIF", b""
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h), "BMP", b""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            w, h = 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            at = data.find(b"EXIF", 30)
            return w, h, "WEBP", data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]] if at >= 0 else b""
        if data[12:16] == b"VP8L":
            bits = struct.unpack_from("<I", data, 21)[0]
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP", b""
        w, h = struct.unpack_from("<HH", data, 26)
        return w & 0x3FFF, h & 0x3FFF, "WEBP", b""
    if data[:2] == b"\xff\xd8":
        at, exif = 2, b""
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                break
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
                exif = data[at + 10 : at + 2 + size]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h, "JPEG", exif
            at += 2 + size
    raise ValueError("unreadable")


def image_info(path: str, data: bytes | None) -> dict:
    """One row of ``INFO``; never raises: what can't be read gives an error and nulls."""
    empty = dict.fromkeys(n.split()[0] for n in INFO.split(", "))
    try:
        w, h, form, exif = _sizes(bytes(data))
        tags = read_exif(exif)
    except (ValueError, TypeError, struct.error):
        return {**empty, "path": path, "error": "unreadable"}
    texts = {column: _text(tags[tag]) if isinstance(tags.get(tag), bytes) else None for column, tag in (("camera_make", "make"), ("camera_model", "model"), ("date_original", "taken"), ("date_digitized", "digitized"), ("date_modified", "modified"))}
    return {**empty, **texts, "path": path, "width": w, "height": h, "img_format": form, "orientation": int(tags.get("orientation") or 1), "has_exif": int(tags.get("tags", 0) > 0), "lat": _position(tags, "lat", "S"), "lon": _position(tags, "lon", "W")}


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """``INFO`` of every file below a folder, read in the tasks that hold the bytes."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([image_info(p, c) for p, c in zip(frame["path"], frame["content"])], columns=[n.split()[0] for n in INFO.split(", ")], dtype=object)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content").mapInPandas(read, INFO)


def shrunk(picture: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of ``rows`` x ``columns`` blocks of a grey or colour picture; a picture smaller than that repeats its pixels."""
    ys, xs = np.linspace(0, picture.shape[0], rows + 1), np.linspace(0, picture.shape[1], columns + 1)
    total = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1, *picture.shape[2:]))
    total[1:, 1:] = picture.astype(float).cumsum(0).cumsum(1)
    y0, x0 = np.minimum(ys[:-1].astype(int), picture.shape[0] - 1), np.minimum(xs[:-1].astype(int), picture.shape[1] - 1)
    y1, x1 = np.maximum(ys[1:].astype(int), y0 + 1), np.maximum(xs[1:].astype(int), x0 + 1)
    area = ((y1 - y0)[:, None] * (x1 - x0)[None, :]).reshape(rows, columns, *[1] * (picture.ndim - 2))
    return (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / area


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luminance of RGB."""
    return rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


SIGNS = "phash bigint, dhash bigint, ahash bigint, bhash array<bigint>, color_sig array<int>, pixel_digest string, grid array<double>"


def all_signatures(rgba: np.ndarray) -> dict:
    """Every signature of one decoded picture, from one reading of its pixels; ``grid`` is what crops are searched in."""
    light = grey(rgba)
    sign = lambda bits, r, c: pack(bits(shrunk(light, r, c)[None]))[0].tolist()
    digest = hashlib.sha256(f"{rgba.shape[1]}x{rgba.shape[0]}:RGBA:".encode() + rgba.astype(np.uint8).tobytes()).hexdigest()
    return {
        "phash": sign(cosine_bits, 32, 32)[0], "dhash": sign(difference_bits, 8, 9)[0], "ahash": sign(average_bits, 8, 8)[0], "bhash": sign(block_bits, 16, 16),
        "color_sig": color_counts(shrunk(rgba[..., :3], 48, 48)), "pixel_digest": digest, "grid": shrunk(light, 32, 32).ravel().tolist(),
    }


def upright(rgba: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as its EXIF orientation (1 to 8) wants it seen."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: np.rot90(p, -1), 7: lambda p: p[::-1, ::-1].swapaxes(0, 1), 8: lambda p: np.rot90(p)}
    return np.ascontiguousarray(turned.get(orientation, lambda p: p)(rgba))


def _rgba(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    opaque = pixels[..., 3:4] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([pixels[..., 2::-1], opaque], axis=2)


def image_signatures(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, signatures, error) of every picture below a folder that the JVM can decode, set upright by its EXIF orientation; others have an error and nulls."""
    columns = ["path", "width", "height", *[n.split()[0] for n in SIGNS.split(", ")], "error"]

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, orientation, w, h, n, data in zip(frame["path"], frame["orientation"], frame["width"], frame["height"], frame["nChannels"], frame["data"]):
                if w <= 0 or h <= 0:
                    out.append({**dict.fromkeys(columns), "path": path, "error": "unreadable"})
                    continue
                picture = upright(_rgba(data, int(h), int(w), int(n)), int(orientation) if pd.notna(orientation) else 1)
                out.append({"error": None, "path": path, "width": picture.shape[1], "height": picture.shape[0], **all_signatures(picture)})
            yield pd.DataFrame(out, columns=columns, dtype=object)

    decoded = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    decoded = decoded.select(F.regexp_replace("image.origin", r"^file:/+", "/").alias("path"), "image.width", "image.height", "image.nChannels", "image.data")
    turned = image_headers(spark, root).select("path", "orientation")
    return decoded.join(turned, "path", "left").mapInPandas(sign, f"path string, width int, height int, {SIGNS}, error string")


def partial_signature(path: str, edge: int = 64 * 1024) -> str:
    """'size:digest' of a file's size and of at most ``edge`` bytes of each end, which don't overlap; files that differ in it aren't equal."""
    with open(path, "rb", buffering=0) as f:
        size = f.seek(0, 2)
        f.seek(0)
        made = hashlib.sha256(size.to_bytes(8, "little") + f.read(edge))
        if size > edge:
            f.seek(max(edge, size - edge))
            made.update(f.read(edge))
    return f"{size}:{made.hexdigest()}"


def partial_signatures(paths: DataFrame, edge: int = 64 * 1024) -> DataFrame:
    """(path, signature) of files (path); null for one that can't be opened."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    out.append(partial_signature(path, edge))
                except (OSError, TypeError):
                    out.append(None)
            yield pd.DataFrame({"path": frame["path"], "signature": pd.Series(out, dtype=object)})

    return paths.select("path").mapInPandas(read, "path string, signature string")


def pixels_equal(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two decoded pictures are equal in size and in every pixel."""
    return a.shape == b.shape and bool((a == b).all())


def difference_image(a: np.ndarray, b: np.ndarray, most: int = 1400) -> np.ndarray:
    """Absolute difference of two pictures at the first one's size (at most ``most`` either way), stretched to the full range."""
    scale = min(1.0, most / max(a.shape[:2]))
    rows, columns = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    apart = np.abs(shrunk(a[..., :3], rows, columns) - shrunk(b[..., :3], rows, columns))
    low, high = apart.min(axis=(0, 1), keepdims=True), apart.max(axis=(0, 1), keepdims=True)
    return np.rint(np.where(high > low, (apart - low) * 255 / np.where(high > low, high - low, 1), apart)).astype(np.uint8)
