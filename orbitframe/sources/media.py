"""Media files: listing, metadata, and frames of still images and raw video."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.functions import naming
from orbitframe.functions.raster import IMAGE
from orbitframe.sources import rawvideo
from orbitframe.sources.containers import container_tracks, isobmff_tracks  # noqa: F401
from orbitframe.sources.stores import Ranged

#: Names of images and of raw videos.
STILLS, VIDEOS = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[tT][iI][fF],[tT][iI][fF][fF]}", "*.[yY]4[mM]"
PNG = b"\x89PNG\r\n\x1a\n"


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, is_image) of the media files under a folder, by suffix, sorted by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    files = files.where(naming.is_media(F.col("path")))
    return files.withColumn("is_image", naming.is_image(F.col("path"))).orderBy("path")


def with_sidecars(media: DataFrame, files: DataFrame) -> DataFrame:
    """media with sidecar_path: the .gpx file of the same folder and stem, if there is one."""
    key = lambda p: F.lower(F.regexp_replace(p, r"\.[^./]*$", ""))
    g = files.where(naming.suffix(F.col("path")) == "gpx").groupBy(key(F.col("path")).alias("_k")).agg(F.min("path").alias("sidecar_path"))
    return media.withColumn("_k", key(F.col("path"))).join(g, "_k", "left").drop("_k")


def same_path(path: Column) -> Column:
    """Paths of mounted files in one form, whatever source they come from."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def still_frames(spark: SparkSession, folder: str, glob: str = STILLS) -> DataFrame:
    """(path, frame_idx, fps, image, error) of the JPEG, PNG and TIFF images under a folder, decoded by Spark's image source.

    Pixels are blue, green, red (and opacity, which the kernels leave out), or one channel; deeper ones are brought to 8 bits, palettes
    are looked up. A file that can't be read is a row with an error.
    """
    reader = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    if not _is_file(folder):
        reader = reader.option("pathGlobFilter", glob)
    i = reader.load(folder).select("image.*")
    path = same_path(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))
    good = F.col("height") > 0
    image = F.when(good, F.struct("height", "width", F.col("nChannels").alias("channels"), "data")).cast(IMAGE)
    return i.select(path.alias("path"), F.lit(0).cast("long").alias("frame_idx"), F.lit(0.0).alias("fps"), image.alias("image"), F.when(good, None).otherwise(F.lit("unreadable")).alias("error"))


def listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, length) of the files under a folder whose names fit; nothing is opened. A single file is listed whatever its name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not _is_file(folder):
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select(same_path(F.col("path")).alias("path"), "length")


def _is_file(folder: str) -> bool:
    return bool(re.search(r"\.[^./]+$", folder))


def unfiltered(raw: np.ndarray, channels: int) -> np.ndarray:
    """The bytes of a PNG's rows (height x 1 + width * channels) from their differences.

    Rows of the simple filters are sums; if there are others, diagonals go from the corner on: a place waits for those left of and above
    it alone, so each diagonal is worked out at once.
    """
    kinds, lines = raw[:, 0], raw[:, 1:]
    h, w = len(raw), lines.shape[1] // channels
    lines = lines.reshape(h, w, channels)
    if not (kinds > 2).any():
        out = np.zeros((h, w, channels), np.uint8)
        for y in range(h):
            line = lines[y]
            out[y] = np.cumsum(line, axis=0, dtype=np.uint8) if kinds[y] == 1 else line + out[y - 1] if kinds[y] == 2 and y else line
        return out
    out = np.zeros((h + 1, w + 1, channels), np.int16)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        k = kinds[y][:, None]
        guess = np.where(k == 4, nearest, np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
        out[y + 1, x + 1] = lines[y, x] + guess & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """Blue, green, red (or one channel) of an 8-bit PNG without interlacing or palette, from bytes at hand; None if it can't be read.

    For files of any kind see still_frames.
    """
    try:
        if data[:8] != PNG:
            return None
        at, body, head = 8, [], None
        while at + 8 <= len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body.append(part)
            at += 12 + n
        w, h, depth, color, _, _, interlace = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
        if depth != 8 or interlace:
            return None
        px = unfiltered(np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels), channels)
        return px[..., :1] if channels < 3 else px[..., 2::-1]
    except (KeyError, TypeError, ValueError, struct.error, zlib.error):
        return None


def encode_png(px: np.ndarray) -> bytes:
    """An 8-bit PNG of one channel, or of blue, green, red pixels."""
    px = px if px.ndim == 3 else px[..., None]
    h, w, channels = px.shape
    rows = np.ascontiguousarray(px[..., ::-1] if channels == 3 else px).reshape(h, -1)
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 3)) + chunk(b"IEND", b"")


def _jpeg_size(file: Ranged) -> tuple[int, int] | None:
    """Width and height out of the frame header, segment by segment."""
    at = 2
    while at + 9 <= file.size:
        mark, kind, n, _, h, w = struct.unpack(">BBHBHH", file.read(at, 9))
        if mark != 0xFF:
            return None
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return w, h
        else:
            at += 2 + n
    return None


def _tiff_size(file: Ranged) -> tuple[int, int] | None:
    """Width and height out of the first directory."""
    order = "<" if file.read(0, 2) == b"II" else ">"
    at = struct.unpack(order + "I", file.read(4, 4))[0]
    found = {}
    for k in range(struct.unpack(order + "H", file.read(at, 2))[0]):
        entry = file.read(at + 2 + 12 * k, 12)
        tag, kind = struct.unpack_from(order + "HH", entry)
        found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entry, 8)[0]
    return (found[256], found[257]) if 256 in found and 257 in found else None


def _size(file: Ranged) -> tuple[float, int, int, int] | None:
    """(frames a second, frames, width, height) of an image or raw video; None if it can't be read. Headers alone are read."""
    start = file.read(0, 24)
    try:
        if start.startswith(rawvideo.FILE):
            layout = rawvideo.Layout.of(file)
            if layout is None:
                return None
            return layout.head["fps"], layout.count if layout.even else sum(1 for _ in layout.walked(file)), layout.head["width"], layout.head["height"]
        if start[:8] == PNG and len(start) >= 24:
            return 0.0, 1, *struct.unpack_from(">II", start, 16)
        size = _jpeg_size(file) if start[:2] == b"\xff\xd8" else _tiff_size(file) if start[:4] in (b"II*\0", b"MM\0*") else None
    except struct.error:
        return None
    return None if size is None else (0.0, 1, *size)


def media_metadata(files: DataFrame) -> DataFrame:
    """(path, fps, frame_count, width, height) of files (path, content), or (path) alone; nulls where a file can't be read. Nothing is decoded.

    With paths alone only headers are read, so a file may be of any length.
    """
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32()]
    columns = ["path", "content"] if "content" in files.columns else ["path"]

    def sized(source: str | bytes) -> tuple:
        try:
            with Ranged(source) as file:
                return _size(file) or (None,) * 4
        except OSError:
            return (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *sized((b.column(1)[i].as_py() or b"") if len(columns) > 1 else path)) for i, path in enumerate(b.column(0).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "fps", "frame_count", "width", "height"])

    return files.select(*columns).mapInArrow(run, "path string, fps double, frame_count long, width int, height int")


def read_frames(files: DataFrame, step: int = 1, interval: tuple[float, str] | None = None, only: str | None = None) -> DataFrame:
    """(path, frame_idx, fps, image, error) of PNG images and raw .y4m videos in files (path, content), whose bytes are at hand.

    Of a video every ``step``-th frame is decoded; with ``interval`` (value, "seconds" or "frames") the
    step follows each file's frame rate; ``only`` "first" or "middle" decodes that frame alone (middle: count // 2
    where there are more than 60, else the first). A still image is one frame of 0 frames a second;
    a file that can't be read gives one row with an error. For files in folders see still_frames and rawvideo.
    """

    def rows(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
        if not data.startswith(rawvideo.FILE):
            px = decode_png(data)
            yield rawvideo.packed(path, 0, 0.0, px, None if px is not None else "unreadable")
            return
        found = rawvideo.all_places(data)
        if found is None:
            yield rawvideo.packed(path, 0, 0.0, None, "unreadable")
            return
        head, places = found
        for k in rawvideo.wanted(len(places), head["fps"], step, interval, only):
            yield rawvideo.packed(path, k, head["fps"], rawvideo.pixels(data[places[k] : places[k] + head["size"]], head), None)
        if not places:
            yield rawvideo.packed(path, 0, head["fps"], None, "no frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from rows(path, data.as_py() or b"")

    return files.select("path", "content").mapInArrow(run, rawvideo.FRAMES)
