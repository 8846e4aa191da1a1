"""Tracks of MP4 and MOV files and their samples, plain or in fragments, read by ranges."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitframe.sources.stores import Ranged

#: Handler codes.
KINDS = {b"vide": "video", b"soun": "sound", b"sbtl": "subtitle", b"subt": "subtitle", b"text": "subtitle"}
#: Samples nearer to each other than so many bytes are read together, and bytes read at once.
GAP, TOGETHER = 1 << 16, 16 << 20
#: Bytes of a payload's row.
PAYLOAD = 4 << 20


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of each box of a level; a broken one ends the level."""
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = end - at if n == 0 else n
        if n < head or at + n > end:
            return
        yield kind, at + head, at + n
        at += n


def _numbers(data: bytes, lo: int, hi: int, kind: str, width: int = 1) -> np.ndarray:
    """The entries of a sample table, those before the break if it is cut."""
    n = struct.unpack_from(">I", data, lo + 4)[0] * width
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, min(n, (hi - lo - 8) // size), lo + 8).astype(np.int64)


def _track(data: bytes, at: int, end: int) -> dict:
    """Number, kind, sample entry's code, clock, seconds, and where the sample tables lie."""
    found = {"id": 0, "kind": "data", "tag": "", "scale": 0, "seconds": 0.0, "tables": {}, "parts": []}
    todo = [(at, end)]
    while todo:
        for name, lo, hi in boxes(data, *todo.pop()):
            if name in (b"mdia", b"minf", b"stbl"):
                todo.append((lo, hi))
            elif name == b"tkhd" and hi - lo >= 24:
                found["id"] = struct.unpack_from(">I", data, lo + (20 if data[lo] == 1 else 12))[0]
            elif name == b"mdhd" and hi - lo >= 24:
                scale, ticks = struct.unpack_from(">IQ", data, lo + 20) if data[lo] == 1 and hi - lo >= 32 else struct.unpack_from(">II", data, lo + 12)
                found["scale"], found["seconds"] = scale, ticks / scale if scale else 0.0
            elif name == b"hdlr" and hi - lo >= 12:
                found["kind"] = KINDS.get(data[lo + 8 : lo + 12], "data")
            elif name == b"stsd" and hi - lo >= 16:
                found["tag"] = data[lo + 12 : lo + 16].decode("latin-1")
            elif name in (b"stsz", b"stsc", b"stco", b"co64", b"stts") and hi - lo >= 8:
                found["tables"][name] = (lo, hi)
    return found


def _sample_tables(data: bytes, tables: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """(offset, size, time, duration) of the samples: chunks by offset, samples of a chunk by the runs of stsc, times by stts."""
    nothing = np.zeros((0, 4), np.int64)
    if not {b"stsz", b"stsc"} <= tables.keys() or not (b"stco" in tables or b"co64" in tables):
        return nothing
    lo, hi = tables[b"stsz"]
    runs = _numbers(data, *tables[b"stsc"], ">u4", 3)
    runs = runs[: len(runs) // 3 * 3].reshape(-1, 3)
    if hi - lo < 12 or not len(runs):
        return nothing
    one, n = struct.unpack_from(">II", data, lo + 4)
    chunks = _numbers(data, *tables[b"co64"], ">u8") if b"co64" in tables else _numbers(data, *tables[b"stco"], ">u4")
    each = runs[np.clip(np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 0, None), 1]
    n = min(n, int(each.sum()))
    sizes = np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", min(n, (hi - lo - 12) // 4), lo + 12).astype(np.int64)
    n = len(sizes)
    chunk = np.repeat(np.arange(len(chunks)), each)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, chunk, side="left")
    out = np.zeros((n, 4), np.int64)
    out[:, 0], out[:, 1] = chunks[chunk] + before - before[first], sizes
    if b"stts" in tables:
        steps = _numbers(data, *tables[b"stts"], ">u4", 2)
        steps = steps[: len(steps) // 2 * 2].reshape(-1, 2)
        deltas = np.repeat(steps[:, 1], np.minimum(steps[:, 0], n))[:n]
        out[: len(deltas), 3] = deltas
        out[:, 2] = np.cumsum(out[:, 3]) - out[:, 3]
    return out


def _fragment(data: bytes, start: int, tracks: dict[int, dict], defaults: dict[int, tuple[int, int]]) -> None:
    """Adds the samples of a moof box, which begins at ``start`` of the file, to their tracks."""
    after = start
    for name, lo, hi in boxes(data, 0, len(data)):
        if name != b"traf":
            continue
        inner = {}
        runs = []
        for kind, x, y in boxes(data, lo, hi):
            inner[kind] = (x, y)
            if kind == b"trun":
                runs.append((x, y))
        if b"tfhd" not in inner:
            continue
        x, y = inner[b"tfhd"]
        flags, number = struct.unpack_from(">II", data, x)
        at, track = x + 8, tracks.get(number)
        duration, size = defaults.get(number, (0, 0))
        base = start if flags & 0x20000 else after
        for flag, width in ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4)):
            if flags & flag:
                value = int.from_bytes(data[at : at + width], "big")
                at += width
                base = value if flag == 0x1 else base
                duration = value if flag == 0x8 else duration
                size = value if flag == 0x10 else size
        if track is None:
            continue
        time = sum(int(p[:, 3].sum()) for p in track["parts"])
        if b"tfdt" in inner:
            x = inner[b"tfdt"][0]
            time = int.from_bytes(data[x + 4 : x + (12 if data[x] == 1 else 8)], "big")
        place = base
        for x, y in runs:
            flags, n = struct.unpack_from(">II", data, x)
            flags, at = flags & 0xFFFFFF, x + 8
            if flags & 0x1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            at += 4 if flags & 0x4 else 0
            fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
            n = min(n, (y - at) // (4 * len(fields))) if fields else n
            rows = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
            out = np.zeros((n, 4), np.int64)
            out[:, 1] = rows[:, fields.index(0x200)] if 0x200 in fields else size
            out[:, 3] = rows[:, fields.index(0x100)] if 0x100 in fields else duration
            out[:, 0] = place + np.cumsum(out[:, 1]) - out[:, 1]
            out[:, 2] = time + np.cumsum(out[:, 3]) - out[:, 3]
            place, time = place + int(out[:, 1].sum()), time + int(out[:, 3].sum())
            track["parts"].append(out)
        after = place


def read_tracks(file: Ranged) -> list[dict]:
    """The tracks of a file with ``samples`` (offset, size, time, duration); only headers, moov and moof boxes are read.

    A broken file gives the tracks, and of them the samples, before the break.
    """
    tracks: list[dict] = []
    defaults: dict[int, tuple[int, int]] = {}
    at = 0
    while at + 8 <= file.size:
        head = file.read(at, 16)
        n, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if n == 1 and len(head) == 16:
            n, skip = struct.unpack_from(">Q", head, 8)[0], 16
        n = file.size - at if n == 0 else n
        if n < skip or (at + n > file.size and kind in (b"moov", b"moof")):
            break
        if kind == b"moov":
            body = file.read(at + skip, n - skip)
            tracks = []
            for name, lo, hi in boxes(body, 0, len(body)):
                if name == b"trak":
                    track = _track(body, lo, hi)
                    track["parts"] = [_sample_tables(body, track["tables"])]
                    tracks.append(track)
                elif name == b"mvex":
                    for inner, x, y in boxes(body, lo, hi):
                        if inner == b"trex" and y - x >= 20:
                            number, _, duration, size = struct.unpack_from(">4I", body, x + 4)
                            defaults[number] = (duration, size)
        elif kind == b"moof":
            try:
                _fragment(file.read(at + skip, n - skip), at, {t["id"]: t for t in tracks}, defaults)
            except (struct.error, ValueError):
                break
        at += n
    for t in tracks:
        s = np.concatenate(t["parts"])
        bad = np.flatnonzero(s[:, 0] + s[:, 1] > file.size)
        t["samples"] = s[: bad[0]] if len(bad) else s
        if not t["seconds"] and t["scale"] and len(s):
            t["seconds"] = int((s[:, 2] + s[:, 3]).max()) / t["scale"]
    return tracks


def sample_bytes(file: Ranged, samples: np.ndarray) -> Iterator[bytes]:
    """The bytes of each sample; neighbouring ones are read together."""
    k = 0
    while k < len(samples):
        start, end, to = int(samples[k, 0]), int(samples[k, 0] + samples[k, 1]), k + 1
        while to < len(samples) and 0 <= samples[to, 0] - end <= GAP and samples[to, 0] + samples[to, 1] - start <= TOGETHER:
            end, to = int(samples[to, 0] + samples[to, 1]), to + 1
        block = file.read(start, end - start)
        for at, n in samples[k:to, :2].tolist():
            yield block[at - start : at - start + n]
        k = to


def _text(sample: bytes, tag: str) -> str:
    """The text of a subtitle sample: two bytes of length before it, or boxes of cues."""
    if tag == "wvtt":
        cues = [sample[a:b] for kind, lo, hi in boxes(sample, 0, len(sample)) if kind == b"vttc" for name, a, b in boxes(sample, lo, hi) if name == b"payl"]
        return "\n".join(c.decode("utf-8", "replace") for c in cues)
    n = struct.unpack_from(">H", sample)[0] if len(sample) >= 2 else 0
    text = sample[2 : 2 + n]
    return text.decode("utf-16", "replace") if text[:2] in (b"\xfe\xff", b"\xff\xfe") else text.decode("utf-8", "replace")


def subtitle_file(file: Ranged, track: dict) -> bytes:
    """The track's samples with text as one subtitle file."""
    return b"".join(subtitle_blocks(file, track))


def subtitle_blocks(file: Ranged, track: dict) -> Iterator[bytes]:
    """The track's samples with text as blocks of a subtitle file: number, times, text."""
    scale, number = track["scale"] or 1, 0

    def clock(ticks: int) -> str:
        ms = max(0, round(ticks * 1000 / scale))
        return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"

    for (_, _, time, length), sample in zip(track["samples"].tolist(), sample_bytes(file, track["samples"])):
        text = re.sub(r"\s*\n\s*", "\n", _text(sample, track["tag"]).replace("\r", "\n")).strip()
        if text:
            number += 1
            yield f"{number}\n{clock(time)} --> {clock(time + length)}\n{text}\n\n".encode()


def isobmff_tracks(files: DataFrame) -> DataFrame:
    """(path, stream_index, kind, tag, duration) of the tracks of MP4 and MOV files.

    kind is video, sound, subtitle or data, tag the sample entry's code (such as gpmd or camm); a broken file gives the tracks
    before the break.
    """
    return container_tracks(files).drop("part", "payload")


def container_tracks(files: DataFrame, payloads: bool = False, most: int = PAYLOAD) -> DataFrame:
    """isobmff_tracks with the columns part and payload: if asked for, the samples of data tracks one after the other, subtitle tracks as SRT; null else.

    A payload comes in parts of whole samples and about ``most`` bytes, a row each, numbered from 0; a track without samples has one.
    files: (path, content), or (path) alone; then only headers and the samples asked for are read from the file, however long it is.
    A file that can't be opened gives no tracks.
    """
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.binary()]
    columns = ["path", "content"] if "content" in files.columns else ["path"]

    def parts(file: Ranged, t: dict) -> Iterator[bytes | None]:
        if not payloads or t["kind"] not in ("data", "subtitle"):
            yield None
            return
        held, size, any_ = [], 0, False
        for sample in subtitle_blocks(file, t) if t["kind"] == "subtitle" else sample_bytes(file, t["samples"]):
            held.append(sample)
            size += len(sample)
            if size >= most:
                yield b"".join(held)
                held, size, any_ = [], 0, True
        if held or not any_:
            yield b"".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                try:
                    with Ranged((b.column(1)[i].as_py() or b"") if len(columns) > 1 else path) as file:
                        for k, t in enumerate(read_tracks(file)):
                            for part, payload in enumerate(parts(file, t)):
                                row = (path, k, t["kind"], t["tag"], t["seconds"], part, payload)
                                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=["path", "stream_index", "kind", "tag", "duration", "part", "payload"])
                except OSError:
                    continue

    return files.select(*columns).mapInArrow(run, "path string, stream_index int, kind string, tag string, duration double, part int, payload binary")
