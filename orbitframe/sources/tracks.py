"""Telemetry tracks: text and binary formats to samples."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SAMPLES = "job_id long, seq long, ts double, lat double, lon double, alt double"
_NUMBER = r"([-0-9.]+)"
#: Places of a part's samples in a job's order.
PART = 1 << 32


def parse_srt(files: DataFrame, altitude_mode: str = "absolute", job: str = "job_id", content: str = "content", part: str | None = None) -> DataFrame:
    """Samples of subtitle files (job_id, content binary or string); SQL expressions only.

    Blocks are parted by blank lines; the second line has the start time. Positions are [latitude: x]
    and [longitude: x], else GPS(lat, lon, alt). In absolute mode the altitude is abs_alt, else
    altitude, else rel_alt; in relative mode rel_alt, altitude, abs_alt; else 0. A block with a number
    that can't be read is dropped.

    Blocks become structs inside the row, a step a level, so that each pattern runs once a block. A long file may come in parts of whole blocks, a row
    each, numbered from 0 in the column ``part``; seq is then the part times PART plus the block's place in it, so it still orders a job.
    """
    text = F.decode(F.col(content).cast("binary"), "UTF-8") if dict(files.dtypes)[content] == "binary" else F.col(content)
    text = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    triple = rf"(?i)GPS\s*\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"
    lines = F.transform(F.split(text, "\n\n"), lambda x, i: F.struct(i.alias("seq"), F.split(F.regexp_replace(x, r"^\n+|\n+$", ""), "\n").alias("lines")))
    parts = F.transform(
        F.filter(lines, lambda x: F.size(x.lines) >= 3),
        lambda x: F.struct(x.seq.alias("seq"), F.trim(F.regexp_extract(F.get(x.lines, F.lit(1)), r"^(.*?)-->", 1)).alias("time"), F.concat_ws(" ", F.slice(x.lines, 3, F.size(x.lines))).alias("body")),
    )
    bracket = lambda body, name: F.regexp_extract(body, rf"(?i)\[\s*{name}\s*:\s*{_NUMBER}\s*\]", 1)
    tag = lambda body, name: F.regexp_extract(body, rf"(?i)\b{name}\s*:\s*{_NUMBER}", 1)
    read = F.transform(
        parts,
        lambda x: F.struct(
            x.seq.alias("seq"), F.when(x.time.rlike("^[^:,]*:[^:,]*:[^:,]*,[^:,]*$"), F.split(x.time, "[:,]")).alias("time"), F.regexp_extract(x.body, triple, 0).alias("gps"),
            *(bracket(x.body, name).alias(c) for c, name in (("t_lat", "latitude"), ("t_lon", "longitude"), ("old", "altitude"))), tag(x.body, "abs_alt").alias("abs"), tag(x.body, "rel_alt").alias("rel"),
        ),
    )
    start = F.col(part).cast("long") * PART if part else F.lit(0).cast("long")
    b = files.select(F.col(job).cast("long").alias("job_id"), start.alias("start"), F.inline(read)).where("time is not null")
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    b = b.withColumn("g", F.split(F.regexp_replace("gps", r"^[^(]*\(|\)$", ""), ","))
    tagged = F.expr("t_lat <> '' and t_lon <> ''")
    unread = lambda c: (F.col(c) != "") & number(c).isNull()
    order = ("abs", "old", "rel") if altitude_mode == "absolute" else ("rel", "old", "abs")
    b = b.where(~(tagged & (unread("abs") | unread("rel") | unread("old")))).select(
        "job_id", (F.col("start") + F.col("seq")).alias("seq"), (number("time[0]") * 3600 + number("time[1]") * 60 + number("time[2]") + number("time[3]") / 1000).alias("ts"),
        F.when(tagged, number("t_lat")).otherwise(number("get(g, 0)")).alias("lat"),
        F.when(tagged, number("t_lon")).otherwise(number("get(g, 1)")).alias("lon"),
        F.when(tagged, F.coalesce(*map(number, order), F.lit(0.0))).otherwise(number("get(g, 2)")).alias("alt"),
    )
    return b.where("ts is not null and lat is not null and lon is not null and alt is not null")


def _gpx_points(data: bytes) -> Iterator[tuple[float, float, float, float]]:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        return
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return
    space = "{http://www.topografix.com/GPX/1/1}"
    points = root.findall(f".//{space}trkpt")
    space, points = (space, points) if points else ("", root.findall(".//trkpt"))
    first = None
    for p in points:
        try:
            when = p.findtext(f"{space}time")
            if when is None:
                continue
            t = datetime.fromisoformat(when.strip().replace("Z", "+00:00"))
            t = (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()
            first = t if first is None else first
            yield t - first, float(p.attrib["lat"]), float(p.attrib["lon"]), float(p.findtext(f"{space}ele") or 0)
        except (KeyError, ValueError):
            continue


def read_gpx(spark: SparkSession, folder: str, glob: str = "*.[gG][pP][xX]") -> DataFrame:
    """(path, seq, ts, lat, lon, alt): the samples of the GPX files under a folder, by Spark's XML scan.

    A file is streamed point by point, so it may be of any length. Points of any namespace are read; those without a time or with numbers that
    can't be read are skipped, a missing height is 0; times without a zone are UTC and count from the file's first point.
    """
    reader = spark.read.format("xml").option("rowTag", "trkpt").option("multiLine", True).option("ignoreNamespace", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    points = reader.schema("_lat string, _lon string, ele string, time string").load(folder)
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    zoned = F.when(F.col("time").rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)\s*$"), F.trim("time")).otherwise(F.concat(F.trim("time"), F.lit("Z")))
    p = points.select(
        F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/").alias("path"), F.monotonically_increasing_id().alias("at"),
        F.unix_micros(F.try_to_timestamp(zoned)).alias("micros"),
        number("_lat").alias("lat"), number("_lon").alias("lon"), F.coalesce(number("ele"), F.when(F.col("ele").isNull(), 0.0)).alias("alt"),
    )
    timed = p.where("micros is not null")
    # The first time counts even if its point's numbers can't be read. A file is one task's, so its places are in order.
    first = timed.groupBy("path").agg(F.min_by("micros", "at").alias("first"), F.min("at").alias("start")).withColumnRenamed("path", "of")
    rows = timed.where("lat is not null and lon is not null and alt is not null").join(first, F.col("path") == F.col("of"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1
    return rows.select("path", seq.cast("long").alias("seq"), ((F.col("micros") - F.col("first")) / 1e6).alias("ts"), "lat", "lon", "alt")


#: Value types of the container's format, big-endian.
_KINDS = {"b": ">i1", "B": ">u1", "s": ">i2", "S": ">u2", "l": ">i4", "L": ">u4", "f": ">f4", "d": ">f8", "J": ">u8"}


def _klv(data: bytes) -> Iterator[tuple[str, str, int, int, bytes]]:
    """(key, type, size, count, payload) of each entry of a level; a cut entry ends the level."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, count = data[at : at + 4].decode("latin-1"), chr(data[at + 4]), data[at + 5], struct.unpack_from(">H", data, at + 6)[0]
        n = size * count
        if at + 8 + n > len(data):
            return
        yield key, kind, size, count, data[at + 8 : at + 8 + n]
        at += 8 + n + (-n % 4)


def _numbers(kind: str, payload: bytes) -> list[float]:
    import numpy as np

    if kind not in _KINDS or len(payload) % int(_KINDS[kind][2:]):
        return []
    return np.frombuffer(payload, _KINDS[kind]).astype(float).tolist()


def _gpmf_points(data: bytes, rate: float = 18.0) -> Iterator[tuple[float, float, float, float]]:
    scale: list[float] = []
    ticks = 0

    def level(part: bytes) -> Iterator[tuple[float, float, float, float]]:
        nonlocal scale, ticks
        for key, kind, size, count, payload in _klv(part):
            if key in ("DEVC", "STRM"):
                yield from level(payload)
            elif key == "SCAL":
                scale = _numbers(kind, payload)
            elif key == "GPS5":
                values = _numbers(kind, payload)
                width = len(values) // count if count else 0
                if width < 5:
                    continue
                by = scale or [1e7, 1e7, 1e3]
                for i in range(count):
                    row = values[i * width : i * width + 3]
                    div = [by[k] if k < len(by) else 1.0 for k in range(3)]
                    if all(div):
                        yield (ticks / rate, *(v / d for v, d in zip(row, div)))
                        ticks += 1

    yield from level(data)


#: Payload bytes of the packet types.
_CAMM_SIZES = {0: 0, 1: 8, 2: 12, 3: 12, 6: 20}


def _camm_points(data: bytes, duration: float) -> Iterator[tuple[float, float, float, float]]:
    at, found = 0, []
    while at + 4 <= len(data):
        kind = struct.unpack_from("<H", data, at + 2)[0]
        if kind not in _CAMM_SIZES:
            # Search byte by byte for the next header: a zero and a known type other than 0.
            at = next((k for k in range(at + 1, len(data) - 4) if data[k : k + 2] == b"\0\0" and struct.unpack_from("<H", data, k + 2)[0] in (1, 2, 3, 6)), len(data))
            continue
        if at + 4 + _CAMM_SIZES[kind] > len(data):
            break
        if kind == 6:
            lat, lon, alt = struct.unpack_from("<ddf", data, at + 4)
            if -90 <= lat <= 90 and -180 <= lon <= 180 and (abs(lat) > 1e-4 or abs(lon) > 1e-4):
                found.append((lat, lon, alt))
        at += 4 + _CAMM_SIZES[kind]
    for i, p in enumerate(found):
        yield (i / len(found) * duration if duration > 0 else i * 0.2, *p)


def parse_tracks(files: DataFrame, kind: str, job: str = "job_id", content: str = "content", duration: str | None = None) -> DataFrame:
    """Samples of gpx, gpmf or camm payloads (job_id, content binary); one payload is parsed at a time.

    gpx: track points of the 1.1 namespace, else without one; points without a time or with bad numbers
    are skipped, times count from the first. gpmf: GPS5 rows of nested DEVC and STRM entries, divided by the
    last SCAL, at 18 a second. camm: packets of type 6 off the null island, spread over ``duration``
    (a column; 0: five a second). Broken payloads give the samples before the break.
    """
    parse = {"gpx": lambda d, _: _gpx_points(d), "gpmf": lambda d, _: _gpmf_points(d), "camm": _camm_points}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, data, length in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(j, k, *map(float, p)) for k, p in enumerate(parse(data or b"", length or 0.0))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["job_id", "seq", "ts", "lat", "lon", "alt"])

    length = F.col(duration).cast("double") if duration else F.lit(0.0)
    src = files.select(F.col(job).cast("long").alias("job_id"), F.col(content).cast("binary").alias("content"), length.alias("duration"))
    return src.mapInArrow(run, SAMPLES)


def parse_parts(parts: DataFrame, kind: str, job: str = "job_id", content: str = "payload", part: str = "part", duration: str | None = None) -> DataFrame:
    """parse_tracks of gpmf or camm payloads that come in parts of whole samples, a row each, numbered from 0 in the column ``part``.

    Parts are parsed apart, by any task; clocks run over a job's samples in a window, so no row and no task holds a whole payload. Every part of
    a gpmf payload has its own SCAL, as its samples do. seq counts a job's samples.
    """
    length = F.col(duration).cast("double") if duration else F.lit(0.0)
    src = parts.select(F.struct(F.col(job).cast("long").alias("job"), F.col(part).cast("long").alias("part"), length.alias("length")).alias("key"), F.col(content).cast("binary").alias("content"))
    parse = {"gpmf": lambda d: _gpmf_points(d), "camm": lambda d: _camm_points(d, 0.0)}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(key["job"], (key["part"] or 0) * PART + k, key["length"], *map(float, p[1:])) for k, p in enumerate(parse(data.as_py() or b""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["job_id", "at", "length", "lat", "lon", "alt"])

    found = src.select("key", "content").mapInArrow(run, "job_id long, at long, length double, lat double, lon double, alt double")
    by = Window.partitionBy("job_id")
    i = F.row_number().over(by.orderBy("at")) - 1
    ts = i / F.lit(18.0) if kind == "gpmf" else F.when(F.col("length") > 0, i / F.count("*").over(by) * F.col("length")).otherwise(i * 0.2)
    return found.select("job_id", i.cast("long").alias("seq"), ts.alias("ts"), "lat", "lon", "alt")


def container_samples(tracks: DataFrame, job: str = "job_id", altitude_mode: str = "absolute") -> DataFrame:
    """Samples of gpmd, camm and subtitle tracks (job_id, kind, tag, duration, part, payload), as sources.containers.container_tracks gives them; without part a row is a whole payload."""
    tracks = tracks if "part" in tracks.columns else tracks.withColumn("part", F.lit(0))
    tag = F.lower("tag")
    text = F.col("kind") == "subtitle"
    gpmf = parse_parts(tracks.where(~text & tag.contains("gpmd")), "gpmf", job)
    camm = parse_parts(tracks.where(~text & tag.contains("camm") & ~tag.contains("gpmd")), "camm", job, duration="duration")
    return gpmf.unionByName(camm).unionByName(parse_srt(tracks.where(text), altitude_mode, job, "payload", "part"))
