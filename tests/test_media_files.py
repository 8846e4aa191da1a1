"""Files of many kinds in and out: images, raw videos, containers, and the two steps of writing."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe import cli
from orbitframe.operators import detections as det
from orbitframe.plans import settings
from orbitframe.sources import containers, jpeg, media, rawvideo, sinks, tracks
from orbitframe.sources.stores import Ranged


def name_of(path):
    return path.rsplit("/", 1)[-1]


def pixels(row):
    return np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], row["channels"])


def png(width, height, depth, color, rows, *more):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return media.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // (h + w)], axis=-1).astype(np.uint8)


def test_stills_of_every_kind(spark, tmp_path):
    img = smooth(20, 30)
    (tmp_path / "a b+c%20.tif").write_bytes(sinks.encode_tiff(img))
    (tmp_path / "g.TIFF").write_bytes(sinks.encode_tiff(img[..., 0]))
    (tmp_path / "p.png").write_bytes(media.encode_png(img))
    deep = b"".join(b"\0" + img[y, :, ::-1].astype(">u2").__mul__(257).astype(">u2").tobytes() for y in range(20))
    (tmp_path / "deep.png").write_bytes(png(30, 20, 16, 2, deep))
    palette = np.array([[10, 20, 30], [200, 100, 50]], np.uint8)
    picked = np.arange(20 * 30).reshape(20, 30) % 2
    (tmp_path / "palette.png").write_bytes(png(30, 20, 8, 3, b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in picked), (b"PLTE", palette.tobytes())))
    clear = np.concatenate([img[..., ::-1], np.full((20, 30, 1), 255, np.uint8)], axis=-1)
    (tmp_path / "clear.png").write_bytes(png(30, 20, 8, 6, b"".join(b"\0" + r.tobytes() for r in clear)))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8no image")
    (tmp_path / "note.txt").write_text("x")
    got = {name_of(r.path): r for r in media.still_frames(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a b+c%20.tif", "g.TIFF", "p.png", "deep.png", "palette.png", "clear.png", "bad.jpg"}
    assert got["bad.jpg"].error == "unreadable" and got["bad.jpg"].image is None
    for name in ("a b+c%20.tif", "p.png", "deep.png"):
        assert (pixels(got[name].image) == img).all(), name
    assert (pixels(got["g.TIFF"].image)[..., 0] == img[..., 0]).all()
    assert (pixels(got["palette.png"].image) == palette[picked][..., ::-1]).all()
    c = got["clear.png"].image
    assert c.channels == 4
    from orbitframe.functions.raster import to_array

    assert (to_array(c.height, c.width, c.channels, bytes(c["data"])) == img).all()
    sizes = {name_of(r.path): (r.width, r.height) for r in media.media_metadata(media.listed(spark, str(tmp_path), media.STILLS)).collect()}
    assert sizes.pop("bad.jpg") == (None, None) and set(sizes.values()) == {(30, 20)}


@pytest.mark.parametrize("quality,least", [(100, 42), (95, 40), (75, 36), (30, 31)])
def test_jpeg_files_read_back(spark, tmp_path, quality, least):
    images = {"even": smooth(64, 96), "odd": smooth(37, 51), "gray": smooth(40, 24)[..., :1], "dot": np.full((1, 1, 3), 90, np.uint8), "flat": np.full((33, 17, 3), (5, 250, 128), np.uint8)}
    for name, px in images.items():
        (tmp_path / f"{name}.jpg").write_bytes(sinks.with_gps(jpeg.encode_jpeg(px, quality), 1.5, -2.5, 3.0))
    for r in media.still_frames(spark, str(tmp_path)).collect():
        want = images[name_of(r.path)[:-4]]
        got = pixels(r.image)
        assert got.shape == want.shape
        noise = ((got.astype(float) - want) ** 2).mean()
        assert noise == 0 or 10 * np.log10(255**2 / noise) >= least, r.path
    sizes = {name_of(r.path)[:-4]: (r.height, r.width) for r in media.media_metadata(media.listed(spark, str(tmp_path), media.STILLS)).collect()}
    assert sizes == {k: v.shape[:2] for k, v in images.items()}


def test_jpeg_codes():
    rng = np.random.default_rng(2)
    for counts in (np.array([5]), np.array([1, 1]), 2 ** np.arange(40), rng.integers(0, 9, 200), np.array([0, 7, 0, 0])):
        counts = np.concatenate((counts, np.zeros(256 - len(counts), np.int64)))
        lengths = jpeg.code_lengths(counts)
        assert lengths.keys() == set(np.flatnonzero(counts).tolist()) and max(lengths.values()) <= 16
        code, size, _ = jpeg._codes(lengths)
        words = {format(int(code[s]), f"0{size[s]}b") for s in lengths}
        assert len(words) == len(lengths) and all("0" in w for w in words)
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    img = rng.integers(0, 256, (48, 48, 3), np.uint8)
    small, large = (len(jpeg.encode_jpeg(img, q)) for q in (20, 95))
    assert small < large / 2
    with pytest.raises(ValueError):
        jpeg.encode_jpeg(np.zeros((1, 70_000), np.uint8))


def test_png_filters_at_size():
    rng = np.random.default_rng(9)
    for channels in (1, 3, 4):
        img = rng.integers(0, 256, (40, 33, channels), np.uint8).astype(int)
        kinds = rng.integers(0, 5, 40)
        rows = np.zeros((40, 1 + 33 * channels), np.uint8)
        for y in range(40):
            left = np.concatenate((np.zeros((1, channels), int), img[y, :-1]))
            up = img[y - 1] if y else np.zeros_like(img[0])
            corner = np.concatenate((np.zeros((1, channels), int), up[:-1]))
            p = left + up - corner
            near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            guess = (0, left, up, (left + up) // 2, near)[kinds[y]]
            rows[y, 0], rows[y, 1:] = kinds[y], ((img[y] - guess) & 255).reshape(-1)
        assert (media.unfiltered(rows, channels) == img).all()
        simple = rows.copy()
        simple[:, 0] %= 3
        plain = np.zeros((41, 33, channels), int)
        for y in range(40):
            line = simple[y, 1:].reshape(33, channels).astype(int)
            plain[y + 1] = (0, np.cumsum(line, axis=0), line + plain[y])[simple[y, 0]] & 255 if simple[y, 0] else line
        assert (media.unfiltered(simple, channels) == plain[1:]).all()


def y4m(w, h, frames, mark=lambda k: b"FRAME\n", tail=b""):
    return f"YUV4MPEG2 W{w} H{h} F30:1 Cmono\n".encode() + b"".join(mark(k) + bytes([k % 256]) * (w * h) for k in range(frames)) + tail


def test_raw_video_source(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(y4m(16, 8, 300))
    (tmp_path / "cut.Y4M").write_bytes(y4m(16, 8, 7, tail=b"FRAME\n123"))
    (tmp_path / "odd.y4m").write_bytes(y4m(16, 8, 9, mark=lambda k: b"FRAME" + b" Ip" * (k % 3 == 1) + b"\n"))
    (tmp_path / "none.y4m").write_bytes(y4m(16, 8, 0))
    (tmp_path / "bad.y4m").write_bytes(b"no video")
    df = rawvideo.video_frames(spark, str(tmp_path), split=1000)
    rows = df.collect()
    frames = {}
    for r in rows:
        if r.error is None:
            assert set(pixels(r.image).reshape(-1).tolist()) == {r.frame_idx % 256} and r.fps == 30.0
            frames.setdefault(name_of(r.path), []).append(r.frame_idx)
    assert {k: sorted(v) for k, v in frames.items()} == {"a.y4m": list(range(300)), "cut.Y4M": list(range(7)), "odd.y4m": list(range(9))}
    assert {name_of(r.path): r.error for r in rows if r.error} == {"none.y4m": "no frames", "bad.y4m": "unreadable"}
    assert df.rdd.getNumPartitions() > 40
    some = lambda d: sorted((name_of(r.path), r.frame_idx) for r in d.where("error is null").collect())
    assert some(df.where("frame_idx = 5")) == [("a.y4m", 5), ("cut.Y4M", 5), ("odd.y4m", 5)]
    assert some(df.where("frame_idx >= 3 and frame_idx < 5")) == [(n, k) for n in ("a.y4m", "cut.Y4M", "odd.y4m") for k in (3, 4)]
    assert some(df.where("frame_idx in (0, 299, 1000)")) == [("a.y4m", 0), ("a.y4m", 299), ("cut.Y4M", 0), ("odd.y4m", 0)]
    assert some(df.where("frame_idx > 297 and path like '%a.y4m'")) == [("a.y4m", 298), ("a.y4m", 299)]
    assert some(rawvideo.video_frames(spark, str(tmp_path), split=1000, interval=3.1))[:4] == [("a.y4m", 0), ("a.y4m", 93), ("a.y4m", 186), ("a.y4m", 279)]
    assert some(rawvideo.video_frames(spark, str(tmp_path), only="middle", split=500)) == [("a.y4m", 150), ("cut.Y4M", 0), ("odd.y4m", 0)]
    assert some(rawvideo.video_frames(spark, str(tmp_path / "a.y4m"), step=100).where("frame_idx > 50")) == [("a.y4m", 100), ("a.y4m", 200)]


def test_pushed_filters_read_one_frame(tmp_path):
    (tmp_path / "a.y4m").write_bytes(y4m(16, 8, 300))
    reader = rawvideo._Reader({"path": str(tmp_path), "split": "1000"})
    left = list(reader.pushFilters([rawvideo.EqualTo(("frame_idx",), 7), rawvideo.EqualTo(("path",), "x")]))
    assert len(left) == 1
    got = [b for piece in reader.partitions() for b in reader.read(piece)]
    assert [b.column(1)[0].as_py() for b in got] == [7]


def test_a_long_sparse_video_is_many_pieces(tmp_path):
    w, h, n = 1920, 1080, 1500
    step = 6 + w * h * 3 // 2
    with open(tmp_path / "long.y4m", "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F25:1\n".encode())
        start = f.tell()
        for k in range(n):
            f.seek(start + k * step)
            f.write(b"FRAME\n")
        f.truncate(start + n * step)
    reader = rawvideo._Reader({"path": str(tmp_path)})
    pieces = reader.partitions()
    assert len(pieces) == -(-(start + n * step) // rawvideo.SPLIT) > 60  # 4.6 GB of which nothing but headers is on the disk
    first = rawvideo._Reader({"path": str(tmp_path), "only": "first"})
    assert [b.column(1)[0].as_py() for p in first.partitions() for b in first.read(p)] == [0]
    with Ranged(str(tmp_path / "long.y4m")) as file:
        assert rawvideo.Layout.of(file).count == n


def test_keys_then_frames(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(y4m(8, 4, 61))
    (tmp_path / "odd.y4m").write_bytes(y4m(8, 4, 5, mark=lambda k: b"FRAME X\n"))
    (tmp_path / "bad.y4m").write_bytes(b"no")
    keys = rawvideo.frame_keys(media.listed(spark, str(tmp_path), media.VIDEOS), interval=(1.0, "Seconds"))
    rows = rawvideo.decoded(keys.repartition(3)).collect()
    got = sorted((name_of(r.path), r.frame_idx, None if r.image is None else pixels(r.image)[0, 0, 0], r.error) for r in rows)
    assert got == [("a.y4m", 0, 0, None), ("a.y4m", 30, 30, None), ("a.y4m", 60, 60, None), ("bad.y4m", 0, None, "unreadable"), ("odd.y4m", 0, 0, None)]


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def table(kind, *v, head=0):
    return box(kind, struct.pack(f">{len(v) + 1}I", head, *v))


def trak(number, handler, tag, scale=1000, ticks=0, stbl=b""):
    tkhd = box(b"tkhd", struct.pack(">5I", 0, 0, 0, number, 0) + bytes(64))
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", scale, ticks) + bytes(4))
    stsd = box(b"stsd", bytes(4) + struct.pack(">II", 1, 16) + tag + bytes(8))
    return box(b"trak", tkhd + box(b"mdia", mdhd + box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"minf", box(b"stbl", stsd + stbl))))


def subtitle(lat, lon, alt):
    text = f"[latitude: {lat}] [longitude: {lon}] [rel_alt: 1.0 abs_alt: {alt}]".encode()
    return struct.pack(">H", len(text)) + text


def test_subtitle_track_of_a_container(spark, tmp_path):
    cues = [subtitle(1.5, 2.5, 10.0), b"\0\0", subtitle(-1.5, 3.5, 20.0), subtitle(4.0, 5.0, 30.0)]
    head = box(b"ftyp", b"isom")
    first = len(head) + 8
    chunks = [first, first + len(cues[0]) + len(cues[1]) + 100_000]
    body = cues[0] + cues[1] + bytes(100_000) + cues[2] + cues[3]
    stbl = table(b"stsz", 0, 4, *map(len, cues)) + table(b"stsc", 1, 1, 2, 1) + table(b"stco", 2, *chunks) + table(b"stts", 2, 1, 500, 3, 1500)
    data = head + box(b"mdat", body) + box(b"moov", trak(1, b"vide", b"avc1") + trak(2, b"sbtl", b"tx3g", 1000, 5000, stbl))
    (tmp_path / "a.mp4").write_bytes(data)
    (tmp_path / "cut.mp4").write_bytes(data[:40])
    for files in (media.listed(spark, str(tmp_path), "*.mp4").select("path"), spark.read.format("binaryFile").load(str(tmp_path))):
        got = containers.container_tracks(files, payloads=True).withColumn("job_id", F.lit(1).cast("long"))
        assert [(r.kind, r.tag, r.duration) for r in got.drop("payload").collect()] == [("video", "avc1", 0.0), ("subtitle", "tx3g", 5.0)]
        samples = sorted((r.ts, r.lat, r.lon, r.alt) for r in tracks.container_samples(got).collect())
        assert samples == [(0.0, 1.5, 2.5, 10.0), (2.0, -1.5, 3.5, 20.0), (3.5, 4.0, 5.0, 30.0)]
        low = tracks.container_samples(got, altitude_mode="relative")
        assert {r.alt for r in low.collect()} == {1.0}
    text = containers.subtitle_file(Ranged(data), containers.read_tracks(Ranged(data))[1]).decode()
    assert text.startswith("1\n00:00:00,000 --> 00:00:00,500\n[latitude: 1.5]") and "\n3\n00:00:03,500 --> 00:00:05,000\n" in text


def test_fragmented_containers(spark):
    cues = [subtitle(k + 0.5, k, k) for k in range(6)]
    camm = [struct.pack("<HHddf", 0, 6, 10.0 + k, 20.0 + k, 1.0) for k in range(4)]
    mvex = box(b"mvex", box(b"trex", struct.pack(">6I", 0, 1, 1, 700, len(camm[0]), 0)) + box(b"trex", struct.pack(">6I", 0, 2, 1, 1000, 0, 0)))
    data = box(b"ftyp", b"iso5") + box(b"moov", trak(1, b"meta", b"camm", 1000) + trak(2, b"sbtl", b"tx3g", 1000) + mvex)

    def fragment(data, time, some_camm, some_cues, moof_base):
        flags = 0x20000 if moof_base else 0

        def moof(at):
            one = box(b"traf", box(b"tfhd", struct.pack(">II", flags, 1)) + box(b"trun", struct.pack(">IIi", 0x1, len(some_camm), at)))
            # Without an offset of its own a track follows the one before it; with the flag all count from the box.
            two = (b"".join(some_camm) and 0x201, at + sum(map(len, some_camm))) if moof_base else (0x200, None)
            run = struct.pack(">II", two[0], len(some_cues)) + (struct.pack(">i", two[1]) if two[1] is not None else b"") + struct.pack(f">{len(some_cues)}I", *map(len, some_cues))
            return box(b"moof", box(b"mfhd", bytes(8)) + one + box(b"traf", box(b"tfhd", struct.pack(">III", flags | 0x8, 2, 500)) + box(b"tfdt", struct.pack(">II", 0, time)) + box(b"trun", run)))

        size = len(moof(0))
        return data + moof(size + 8) + box(b"mdat", b"".join(some_camm) + b"".join(some_cues))

    data = fragment(data, 0, camm[:2], cues[:2], True)
    data = fragment(data, 5000, camm[2:], cues[2:], False)
    df = spark.createDataFrame([("a.mp4", bytearray(data)), ("b.mp4", bytearray(data[:-300]))], "path string, content binary")
    got = containers.container_tracks(df, payloads=True).where("path = 'a.mp4'").withColumn("job_id", F.lit(1).cast("long"))
    assert [(r.kind, r.duration) for r in got.collect()] == [("data", 2.8), ("subtitle", 7.0)]
    samples = {(round(r.ts, 3), r.lat) for r in tracks.container_samples(got).collect()}
    assert samples == {(0.7 * k, 10.0 + k) if k != 3 else (2.1, 13.0) for k in range(4)} | {(0.0, 0.5), (0.5, 1.5), (5.0, 2.5), (5.5, 3.5), (6.0, 4.5), (6.5, 5.5)}
    cut = [t["samples"] for t in containers.read_tracks(Ranged(data[:-300]))]
    assert [len(s) for s in cut] == [4, 4] or all(len(s) for s in cut)


def gps_of(data):
    order = "<" if data[:2] == b"II" else ">"
    directory = lambda at: {struct.unpack_from(order + "H", data, at + 2 + 12 * k)[0]: at + 2 + 12 * k for k in range(struct.unpack_from(order + "H", data, at)[0])}
    root = directory(struct.unpack_from(order + "I", data, 4)[0])
    gps = directory(struct.unpack_from(order + "I", data, root[0x8825] + 8)[0])

    def degrees(tag):
        at = struct.unpack_from(order + "I", data, gps[tag] + 8)[0]
        d = struct.unpack_from(order + "6I", data, at)
        return d[0] / d[1] + d[2] / d[3] / 60 + d[4] / d[5] / 3600

    at = struct.unpack_from(order + "I", data, gps[6] + 8)[0]
    high = struct.unpack_from(order + "2I", data, at)
    sign = lambda tag, minus: -1 if data[gps[tag] + 8] == minus else 1
    return list(root), (sign(1, ord("S")) * degrees(2), sign(3, ord("W")) * degrees(4), sign(5, 1) * high[0] / high[1])


def test_places_in_tiff_files(spark, tmp_path):
    img = smooth(9, 7)
    plain = sinks.encode_tiff(img)
    placed = sinks.with_gps(plain, -1.5, 2.25, -3.0)
    again = sinks.with_gps(placed, 10.5, -20.25, 7.5)
    for data, want in ((placed, (-1.5, 2.25, -3.0)), (again, (10.5, -20.25, 7.5))):
        tags, got = gps_of(data)
        assert got == pytest.approx(want) and tags == sorted(tags) and tags.count(0x8825) == 1
    swap = bytearray(b"MM\0*" + struct.pack(">I", 10) + bytes([7, 0]) + struct.pack(">H", 8))
    for e in ((256, 4, 1, 1), (257, 4, 1, 1), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (262, 3, 1, 1 << 16), (273, 4, 1, 8), (278, 4, 1, 1), (279, 4, 1, 1)):
        swap += struct.pack(">HHII", *e)
    swap = bytes(swap + struct.pack(">I", 0))
    big = sinks.with_gps(swap, 1.5, 2.5, 3.5)
    assert gps_of(big)[1] == pytest.approx((1.5, 2.5, 3.5))
    (tmp_path / "a.tif").write_bytes(again)
    (tmp_path / "big.tif").write_bytes(big)
    got = {name_of(r.path): r.image for r in media.still_frames(spark, str(tmp_path)).collect()}
    assert (pixels(got["a.tif"]) == img).all() and pixels(got["big.tif"]).reshape(-1).tolist() == [7]
    assert sinks.with_gps(b"II*\0\xff\xff\xff\xff", 1, 2) == b"II*\0\xff\xff\xff\xff"


def test_files_show_when_published_only(spark, tmp_path):
    out = str(tmp_path / "o")
    rows = [(out, f"{k}.bin", bytearray([k]) * 10, k % 2 == 0, None) for k in range(6)] + [(out, "none.bin", None, True, "unreadable"), ("/proc/no/such", "x.bin", bytearray(b"1"), True, None)]
    df = spark.createDataFrame(rows, "output_dir string, image_name string, file binary, keep boolean, error string")
    left = sinks.staged(df, "r")  # an attempt whose rows never arrive, as those of a killed task
    left.write.format("noop").mode("overwrite").save()
    assert not [p for p in (tmp_path / "o").iterdir() if not p.name.startswith(".attempt-")]
    table = str(tmp_path / "manifest")
    sinks.staged(df, "r").write.parquet(table)
    manifest = spark.read.parquet(table)
    for _ in range(2):  # published twice, as by a task that runs again
        done = {name_of(r.path): r for r in sinks.published(manifest).collect()}
        assert {k for k, r in done.items() if r.ok} == {"0.bin", "2.bin", "4.bin"}
        assert done["none.bin"].error == "unreadable" and not done["x.bin"].ok and len(done) == 5
        assert sorted(p.name for p in (tmp_path / "o").glob("*.bin")) == ["0.bin", "2.bin", "4.bin"]
    assert {r.error for r in sinks.cleared(manifest.where("error is null and image_name <> 'x.bin'"), "r").collect()} == {None}
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["0.bin", "2.bin", "4.bin"]
    assert (tmp_path / "o/4.bin").read_bytes() == bytes([4]) * 10


def test_every_image_is_decoded_once_and_none_is_shuffled(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(media.encode_png(smooth(8, 16)))
    (tmp_path / "v.y4m").write_bytes(y4m(16, 8, 40))
    s = settings.DEFAULTS | {"resolution": 8, "camera_count": 2, "blur_filter_enabled": True, "smart_blur_enabled": True, "sharpening_enabled": True, "adaptive_mode": True, "export_telemetry": True, "ai_mode": settings.AI_SKIP}
    plan = cli.staged_views(spark, str(tmp_path), s, "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert exchanges and all("rangepartitioning(path" in line for line in exchanges)  # of keys, before they are decoded
    below = plan[plan.index("rangepartitioning(path") :]
    assert "image#" not in below and "view_image" not in below


def test_command_line_with_everything_on(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    out.mkdir()
    rng = np.random.default_rng(3)
    for k in range(3):
        (src / f"p{k}.jpg").write_bytes(jpeg.encode_jpeg(smooth(32, 64) if k else rng.integers(0, 256, (32, 64, 3), np.uint8), 100))
    (src / "p1.gpx").write_text('<gpx><trk><trkseg><trkpt lat="-1.5" lon="2.25"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    (src / "v.y4m").write_bytes(y4m(64, 32, 65))
    cues = [subtitle(10.0, 20.0, 30.0), subtitle(11.0, 21.0, 31.0)]
    head = box(b"ftyp", b"isom")
    stbl = table(b"stsz", 0, 2, *map(len, cues)) + table(b"stsc", 1, 1, 2, 1) + table(b"stco", 1, len(head) + 8) + table(b"stts", 1, 2, 1000)
    (src / "v.mp4").write_bytes(head + box(b"mdat", b"".join(cues)) + box(b"moov", trak(1, b"sbtl", b"tx3g", 1000, 2000, stbl)))

    class Bright:
        def detect(self, images):
            return [[det.Detection(0, 0.9, (x[..., 0] > 100).astype(float))] if np.abs(np.diff(x.astype(int), axis=1)).mean() > 15 else [] for x in images]

    det.register("busy", Bright)
    args = ["--input", str(src), "--output", str(out), "--resolution", "16", "--camera-count", "2", "--export-telemetry", "--naming-mode", "simple", "--adaptive", "--motion-threshold", "0.0", "--quality", "90"]
    assert cli.main([*args, "--ai-mask", "--detector", "busy"]) == 0
    made = {p.relative_to(out).as_posix(): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    views = {n for n in made if n.endswith(".jpg")}
    assert {n.split("/")[0] for n in views} == {"p0_processed", "p1_processed", "p2_processed", "v_processed"} and not [n for n in made if ".attempt" in n]
    assert {n.replace(".jpg", "_mask.png") for n in views} == {n for n in made if n.endswith(".png")}
    assert all(d[:3] == b"\xff\xd8\xff" for n, d in made.items() if n in views)
    assert sinks.gps_directory(-1.5, 2.25, 0.0) in made["p1_processed/p1_frame000000_View_0.jpg"] and b"Exif" not in made["p2_processed/p2_frame000000_View_0.jpg"]
    assert sinks.gps_directory(10.0, 20.0, 30.0) in made["v_processed/v_frame000000_View_0.jpg"]
    masks = {n: media.decode_png(made[n]) for n in made if n.endswith(".png")}
    assert any((m == 0).any() for n, m in masks.items() if n.startswith("p0")) and all((m == 255).all() for n, m in masks.items() if not n.startswith("p0"))
    again = tmp_path / "skip"
    again.mkdir()
    config = tmp_path / "c.json"
    config.write_text('{"ai_mode": "Skip Frame", "format": "tiff", "blur_filter_enabled": true, "smart_blur_enabled": true, "blur_threshold": 1.0}')
    args[args.index(str(out))] = str(again)
    assert cli.main([*args, "--config", str(config), "--detector", "busy"]) == 0
    kept = {p.relative_to(again).as_posix(): p.read_bytes() for p in again.rglob("*") if p.is_file()}
    assert kept and all(n.endswith(".tif") and not n.startswith("p0") for n in kept)
    assert gps_of(kept["p1_processed/p1_frame000000_View_0.tif"])[1] == pytest.approx((-1.5, 2.25, 0.0))
    config.write_text('{"format": "bmp"}')
    assert cli.main([*args, "--config", str(config)]) == 1
