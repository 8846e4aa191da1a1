"""Writing images, masks and their places, with a manifest of what was written."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from orbitframe.functions.raster import to_array
from orbitframe.session import bound_image_batches
from orbitframe.sources.jpeg import encode_jpeg
from orbitframe.sources.media import encode_png
from orbitframe.sources.stores import located

#: Fixed value: the entry that names the GPS directory. Folders of a run's attempts begin so.
GPS_TAG, ATTEMPTS = 0x8825, ".attempt-"


def _gps_entries(lat: float, lon: float, alt: float, at: int, order: str = "<") -> bytes:
    """A GPS directory at offset ``at`` of a file: references, degrees, minutes, seconds and altitude, then the values that don't fit in."""

    def triple(x: float) -> bytes:
        x = abs(x)
        d = int(x)
        m = int((x - d) * 60)
        return b"".join(struct.pack(order + "II", int(v * 1_000_000), 1_000_000) for v in (float(d), float(m), (x - d - m / 60) * 3600))

    text = lambda c: c.encode() + b"\0\0\0"
    values = [
        (1, 2, 2, text("N" if lat >= 0 else "S")), (2, 5, 3, triple(lat)), (3, 2, 2, text("E" if lon >= 0 else "W")), (4, 5, 3, triple(lon)),
        (5, 1, 1, bytes([0 if alt >= 0 else 1, 0, 0, 0])), (6, 5, 1, struct.pack(order + "II", int(abs(alt) * 1_000_000), 1_000_000)),
    ]
    data_at = at + 2 + 12 * len(values) + 4
    entries, data = b"", b""
    for tag, kind, count, raw in values:
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", tag, kind, count, data_at + len(data))
            data += raw
        else:
            entries += struct.pack(order + "HHI", tag, kind, count) + raw
    return struct.pack(order + "H", len(values)) + entries + struct.pack(order + "I", 0) + data


def gps_directory(lat: float, lon: float, alt: float = 0.0) -> bytes:
    """A TIFF structure (little-endian) with nothing but a GPS directory."""
    gps = 8 + 2 + 12 + 4
    root = struct.pack("<HHHII", 1, GPS_TAG, 4, 1, gps) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + root + _gps_entries(lat, lon, alt, gps)


def _tiff_with_gps(image: bytes, lat: float, lon: float, alt: float) -> bytes:
    """A TIFF file with its place: the GPS directory and a new first directory that names it are put at the end; what else offsets point to stays."""
    order = "<" if image[:2] == b"II" else ">"
    old = struct.unpack_from(order + "I", image, 4)[0]
    n = struct.unpack_from(order + "H", image, old)[0]
    entries = [image[old + 2 + 12 * k : old + 14 + 12 * k] for k in range(n)]
    following = image[old + 2 + 12 * n : old + 6 + 12 * n]
    if any(len(e) < 12 for e in entries) or len(following) < 4:
        return image
    entries = [e for e in entries if struct.unpack_from(order + "H", e)[0] != GPS_TAG]
    gps_at = len(image) + len(image) % 2
    gps = _gps_entries(lat, lon, alt, gps_at, order)
    entries.append(struct.pack(order + "HHII", GPS_TAG, 4, 1, gps_at))
    entries.sort(key=lambda e: struct.unpack_from(order + "H", e)[0])
    root = struct.pack(order + "H", len(entries)) + b"".join(entries) + following
    return image[:4] + struct.pack(order + "I", gps_at + len(gps)) + image[8:] + b"\0" * (len(image) % 2) + gps + root


def with_gps(image: bytes, lat: float, lon: float, alt: float = 0.0) -> bytes:
    """A JPEG, PNG or TIFF file with its place: an APP1 segment after the start, an eXIf chunk after the header, or a directory at the end.

    An EXIF segment or chunk, or a place, that the file has is replaced. Other formats, and broken TIFF files, come back as they are.
    """
    if image[:4] in (b"II*\0", b"MM\0*"):
        try:
            return _tiff_with_gps(image, lat, lon, alt)
        except struct.error:
            return image
    tiff = gps_directory(lat, lon, alt)
    if image[:2] == b"\xff\xd8":
        out, at = b"", 2
        while at + 4 <= len(image) and image[at] == 0xFF and image[at + 1] not in (0xDA, 0xD9):
            n = struct.unpack_from(">H", image, at + 2)[0]
            if not (image[at + 1] == 0xE1 and image[at + 4 : at + 10] == b"Exif\0\0"):
                out += image[at : at + 2 + n]
            at += 2 + n
        body = b"Exif\0\0" + tiff
        return image[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + out + image[at:]
    if image[:8] == b"\x89PNG\r\n\x1a\n":
        parts, at = [], 8
        while at + 12 <= len(image):
            n = struct.unpack_from(">I", image, at)[0]
            parts.append(image[at : at + 12 + n])
            at += 12 + n
        chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
        rest = [p for p in parts[1:] if p[4:8] != b"eXIf"]
        return image[:8] + parts[0] + chunk + b"".join(rest)
    return image


def read_place(file: bytes) -> tuple[float, float, float | None] | None:
    """(latitude, longitude, altitude) out of the GPS directory of a JPEG, PNG or TIFF file; None without one, or if it is broken."""
    tiff = file if file[:4] in (b"II*\0", b"MM\0*") else b""
    at = 2 if file[:2] == b"\xff\xd8" else 8
    while not tiff and at + 12 <= len(file):
        if file[:2] == b"\xff\xd8":
            if file[at] != 0xFF or file[at + 1] in (0xDA, 0xD9):
                return None
            tiff = file[at + 10 :] if file[at + 1] == 0xE1 and file[at + 4 : at + 10] == b"Exif\0\0" else b""
            at += 2 + struct.unpack_from(">H", file, at + 2)[0]
        else:
            n, kind = struct.unpack_from(">I4s", file, at)
            tiff = file[at + 8 : at + 8 + n] if kind == b"eXIf" else b""
            at += 12 + n
    try:
        order = "<" if tiff[:2] == b"II" else ">"

        def directory(at: int) -> dict[int, int]:
            n = struct.unpack_from(order + "H", tiff, at)[0]
            return {struct.unpack_from(order + "H", tiff, at + 2 + 12 * k)[0]: at + 10 + 12 * k for k in range(n)}

        offset = lambda at: struct.unpack_from(order + "I", tiff, at)[0]
        shares = lambda at, n: [a / b for a, b in struct.iter_unpack(order + "II", tiff[offset(at) : offset(at) + 8 * n])]
        gps = directory(offset(directory(offset(4))[GPS_TAG]))
        degrees = lambda tag: sum(v / 60**k for k, v in enumerate(shares(gps[tag], 3)))
        lat = degrees(2) * (-1 if tiff[gps[1] : gps[1] + 1] == b"S" else 1)
        lon = degrees(4) * (-1 if tiff[gps[3] : gps[3] + 1] == b"W" else 1)
        alt = shares(gps[6], 1)[0] * (-1 if tiff[gps[5]] == 1 else 1) if 6 in gps else None
        return lat, lon, alt
    except (IndexError, KeyError, ZeroDivisionError, struct.error):
        return None


def read_places(files: DataFrame) -> DataFrame:
    """(path, lat, lon, alt) of image files (path, content); nulls where a file has no place."""
    kinds = [pa.string(), *[pa.float64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *(read_place(data.as_py() or b"") or (None,) * 3)) for path, data in zip(b.column(0).to_pylist(), b.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "lat", "lon", "alt"])

    return files.select("path", "content").mapInArrow(run, "path string, lat double, lon double, alt double")


def encode_tiff(px: np.ndarray) -> bytes:
    """An uncompressed 8-bit TIFF (little-endian, one strip) of one channel, or of blue, green, red pixels."""
    px = px if px.ndim == 3 else px[..., None]
    h, w, channels = px.shape
    body = np.ascontiguousarray(px[..., ::-1] if channels == 3 else px).tobytes()
    body += b"\0" * (len(body) % 2)
    bits_at = 8 + len(body)  # three counts of bits don't fit into their entry
    directory = bits_at + (6 if channels == 3 else 0)
    bits = (258, 3, 3, bits_at) if channels == 3 else (258, 3, 1, 8)
    entries = [(256, 4, 1, w), (257, 4, 1, h), bits, (259, 3, 1, 1), (262, 3, 1, 2 if channels == 3 else 1), (273, 4, 1, 8), (277, 3, 1, channels), (278, 4, 1, h), (279, 4, 1, h * w * channels)]
    tail = (struct.pack("<HHH", 8, 8, 8) if channels == 3 else b"") + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", directory) + body + tail


def encoder(ext: str, quality: int = 95) -> Callable[[np.ndarray], bytes]:
    """The writer of jpg, png or tif files."""
    if ext in ("jpg", "jpeg"):
        return lambda px: encode_jpeg(px, quality)
    return encode_tiff if ext in ("tif", "tiff") else encode_png


def encoded(df: DataFrame, image: str = "view_image", out: str = "file", ext: str = "png", quality: int = 95, ext_col: str | None = None) -> DataFrame:
    """df with the image as the bytes of a JPEG, PNG or TIFF file, with its place where lat, lon and alt are given; null images stay null.

    The format is ``ext``, or that of the row in ``ext_col``.
    """
    bound_image_batches(df.sparkSession)
    columns, schema = df.columns, StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda c: b.column(columns.index(c)).to_pylist() if c in columns else [None] * b.num_rows
            files = []
            for img, kind, lat, lon, alt in zip(at(image), at(ext_col), at("lat"), at("lon"), at("alt")):
                data = None if img is None else encoder(kind or ext, quality)(to_array(img["height"], img["width"], img["channels"], img["data"]))
                files.append(data if data is None or lat is None or lon is None else with_gps(data, lat, lon, alt or 0.0))
            arrow = pa.schema([*zip(b.schema.names, b.schema.types), (out, pa.binary())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary())], schema=arrow)

    return df.mapInArrow(run, schema)


def staged(df: DataFrame, run_id: str, folder: str = "output_dir", name: str = "image_name", content: str = "file") -> DataFrame:
    """df without its bytes, but with (part, length, failed): a file for each row in a folder of the run, under a name of the task attempt.

    Nothing that is there already is touched: files become visible by ``published``, so a task that is killed or runs twice leaves neither
    partial nor doubled ones. Write the rows (a table) before going on: they are the manifest, and small. Null bytes aren't written (part null);
    a file that fails is reported and doesn't end the others. Folders are mounted ones, or of any store that pyarrow opens.
    """
    columns = [c for c in df.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), set()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else "0"
        count = 0
        for b in batches:
            done = []
            for place, data in zip(b.column(columns.index(folder)).to_pylist(), b.column(len(columns))):
                data = data.as_py()
                if data is None:
                    done.append((None, 0, None))
                    continue
                count += 1
                part = f"{place}/{ATTEMPTS}{run_id}/{attempt}-{count}"
                try:
                    store, path = located(part)
                    if place not in made:
                        store.create_dir(os.path.dirname(path), recursive=True)
                        made.add(place)
                    with store.open_output_stream(path) as f:
                        f.write(data)
                    done.append((part, len(data), None))
                except OSError as e:
                    done.append((None, 0, str(e)))
            kinds = [("part", pa.string()), ("length", pa.int64()), ("failed", pa.string())]
            rows = [pa.array(list(c), k) for c, (_, k) in zip(zip(*done), kinds)] if done else [pa.array([], k) for _, k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *rows], schema=pa.schema([*list(zip(b.schema.names, b.schema.types))[:-1], *kinds]))

    schema = StructType([*(df.schema[c] for c in columns), *StructType.fromDDL("part string, length long, failed string").fields])
    return df.select(*(F.col(f"`{c}`") for c in columns), content).mapInArrow(run, schema)


def published(manifest: DataFrame, folder: str = "output_dir", name: str = "image_name", part: str = "part", keep: str = "keep") -> DataFrame:
    """(path, length, ok, error) of the files of ``staged`` rows: those to keep get their names, with their place where lat and lon are given; others go.

    Rows that failed before (``error``) or on being staged are reported. A row that is published again finds its file in place, so tasks may
    run twice. Of rows with the same name the last one stays, as files do.
    """
    columns = [c for c in (folder, name, part, "length", keep, "failed", "error", "lat", "lon", "alt") if c in manifest.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for row in b.to_pylist():
                path = f"{row[folder].rstrip('/')}/{os.path.basename(row[name])}"
                why = row.get("error") or row["failed"]
                if row[part] is None:
                    if why or row[keep]:
                        done.append((path, 0, False, why or "no image"))
                    continue
                try:
                    store, from_ = located(row[part])
                    to = located(path)[1]
                    there = store.get_file_info(from_).type != fs.FileType.NotFound
                    if not row[keep]:
                        if there:
                            store.delete_file(from_)
                        continue
                    if there and row.get("lat") is not None and row.get("lon") is not None:
                        with store.open_input_file(from_) as f:
                            data = with_gps(f.readall(), row["lat"], row["lon"], row.get("alt") or 0.0)
                        with store.open_output_stream(f"{from_}.gps") as f:
                            f.write(data)
                        store.move(f"{from_}.gps", to)
                        store.delete_file(from_)
                    elif there:
                        store.move(from_, to)
                    info = store.get_file_info(to)
                    found = info.type == fs.FileType.File
                    done.append((path, info.size if found else 0, found, None if found else "lost"))
                except OSError as e:
                    done.append((path, 0, False, str(e)))
            if done:
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=["path", "length", "ok", "error"])

    return manifest.select(*columns).mapInArrow(run, "path string, length long, ok boolean, error string")


def cleared(manifest: DataFrame, run_id: str, folder: str = "output_dir") -> DataFrame:
    """(folder, error) of the run's own folders, removed with whatever attempts left there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place in b.column(0).to_pylist():
                error = None
                try:
                    store, path = located(f"{place}/{ATTEMPTS}{run_id}")
                    if store.get_file_info(path).type != fs.FileType.NotFound:
                        store.delete_dir(path)
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([error], pa.string())], names=["folder", "error"])

    return manifest.select(folder).distinct().mapInArrow(run, "folder string, error string")


def write_files(df: DataFrame, folder: str = "output_dir", name: str = "image_name", content: str = "file") -> DataFrame:
    """A manifest (path, length, ok, error) of files written by the executors, a row a file.

    Folders must be on a file system that all executors mount. A file that fails is reported and
    doesn't end the others; a task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for place, file, data in zip(*(c.to_pylist() for c in b.columns)):
                path = os.path.join(place, os.path.basename(file))
                try:
                    if data is None:
                        raise ValueError("no image")
                    os.makedirs(place, exist_ok=True)
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                    done.append((path, len(data), True, None))
                except (OSError, ValueError) as e:
                    done.append((path, 0, False, str(e)))
            if done:
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=["path", "length", "ok", "error"])

    return df.select(folder, name, content).mapInArrow(run, "path string, length long, ok boolean, error string")
