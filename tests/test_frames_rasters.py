import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.functions import geometry, raster
from orbitframe.operators import detections as det, frames as fr, telemetry
from orbitframe.sources import media, sinks


def test_layouts(spark):
    rows = geometry.generate_views(spark, 6).orderBy("view_idx").collect()
    assert [r.yaw for r in rows] == [0, 60, 120, 180, 240, 300]
    assert {r.name for r in geometry.generate_views(spark, 12, 0, "cube").collect()} == {"Front", "Right", "Back", "Left", "Up", "Down"}
    for n in (4, 8, 16):
        assert geometry.generate_views(spark, n, 0, "fibonacci").count() == n
    first = geometry.generate_views(spark, 8, 0, "fibonacci").first()
    assert first.yaw == pytest.approx(90.0) and first.pitch == pytest.approx(61.044976, abs=1e-5)
    assert geometry.parse_active("") is None and geometry.parse_active("0, 3") == [0, 3]


def test_map_rows_equal_the_worker_map(spark):
    v = geometry.generate_views(spark, 3, -20)
    rows = geometry.rectilinear_map(v, 64, 32, 6, 5, 75.0).collect()
    for r in rows:
        u, w = raster.view_map(32, 64, 5, 6, 75.0, r.yaw, r.pitch, 0.0)
        assert r.u == pytest.approx(float(u[r.py, r.px]), abs=1e-3) and r.v == pytest.approx(float(w[r.py, r.px]), abs=1e-3)
    u, w = raster.view_map(1080, 2160, 512, 512, 90.0, 0.0, 0.0, 0.0)
    assert u.shape == (512, 512) and u.dtype == np.float32 and (u[256, 256], w[256, 256]) == (1080, 540)


def test_blur_score():
    edge = np.zeros((100, 100), np.uint8)
    edge[:, 50:] = 255
    assert raster.blur_score(edge) == 1300.5
    assert raster.blur_score(np.full((100, 100), 128, np.uint8)) == 0 and raster.blur_score(None) == 0.0
    assert raster.blur_score(np.random.default_rng(1).integers(0, 255, (9, 9, 3), np.uint8)) > 0


def test_masks_and_sharpening():
    assert (raster.detection_mask(np.zeros((0, 4, 4)), 8, 6) == 255).all() and raster.detection_mask(np.zeros((0, 4, 4)), 8, 6, invert=False).max() == 0
    p = np.zeros((2, 4, 4))
    p[0, 1, 1] = 0.9
    hard = raster.detection_mask(p, 4, 4, invert=False)
    assert hard[:3, :3].min() == 255 and hard[3].max() == 0
    soft = raster.detection_mask(p, 4, 4, invert=True, feather=True)
    assert soft[1, 1] == 255 - int(0.9 * 255)
    img = np.tile(np.linspace(0, 255, 32).astype(np.uint8), (32, 1))
    assert (raster.sharpen(img, 0.0) == img).all() and raster.sharpen(np.full((16, 16), 77, np.uint8), 1.5).tolist() == [[77] * 16] * 16


def test_remap_wraps_and_keeps_pixels():
    img = np.random.default_rng(2).integers(0, 255, (6, 8, 3), np.uint8)
    x, y = np.meshgrid(np.arange(8, dtype=float), np.arange(6, dtype=float))
    for lanczos in (False, True):
        assert (raster.remap(img, x, y, lanczos) == img).all()
        assert (raster.remap(img, x + 8, y - 6, lanczos) == img).all()
    half = raster.remap(img.astype(float), x + 0.5, y)
    assert half[0, 7, 0] == pytest.approx((float(img[0, 7, 0]) + float(img[0, 0, 0])) / 2)


def test_motion_score():
    rng = np.random.default_rng(3)
    base = raster.gaussian_blur(rng.integers(0, 255, (144, 260)).astype(float), 3.0)
    a, b = (base[:, k : k + 256] * 3 % 255 for k in (0, 2))
    still, moved = raster.motion_score(a.astype(np.uint8), a.astype(np.uint8)), raster.motion_score(base[:, :256].astype(np.uint8), base[:, 2:258].astype(np.uint8))
    assert still < 0.05 < moved < 4 and raster.motion_score(None, b) == 0.0


def machine(start, xs):
    step = start()
    return [step(x) for x in xs]


def test_keyframes_compare_with_the_last_kept():
    near = lambda a, b: abs(a - b)
    assert machine(fr.keyframe_machine(1.0, near), [0, 0.5, 1.0, 1.5, 2.0, 2.6]) == [True, False, False, True, False, True]


def test_smart_blur_machine():
    run = lambda xs: machine(fr.smart_blur_machine(10.0), xs)
    assert run([5, 5, 5, 5, 5, 5, 5]) == [False] * 5 + [True, False]
    assert run([100, 60, 59.9, 40]) == [True, True, True, False]
    assert run([100, 59.9, None]) == [True, False, False]
    assert run([100] * 12 + [60.0, 57.7, 30]) == [True] * 14 + [False]


def test_order_is_kept_across_views_and_batches(spark):
    rng = random.Random(5)
    rows = [(j, f, v, rng.random() * 100) for j in range(5) for f in range(300) for v in range(2)]
    want = set()
    for j in range(5):
        mine = sorted(r for r in rows if r[0] == j)
        want |= {r[:3] for r, keep in zip(mine, machine(fr.smart_blur_machine(30.0), [r[3] for r in mine])) if keep}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id long, frame_idx int, view_idx int, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r.job_id, r.frame_idx, r.view_idx) for r in fr.smart_blur(df, 30.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_blur_summary(spark):
    df = spark.createDataFrame([(1, "b", 4.0), (0, "a", 2.0)], "view_idx int, name string, score double")
    r = fr.blur_summary(df).first()
    assert (r.average, r["min"], r["max"], r.recommended, [d.view for d in r.details]) == (3.0, 2.0, 4.0, 2.4000000000000004, ["a", "b"])
    assert fr.blur_summary(df.limit(0)).first().average == 0.0


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(4)
    for shape in ((5, 7, 3), (4, 4, 1)):
        img = rng.integers(0, 255, shape, np.uint8)
        assert (media.decode_png(media.encode_png(img)) == img).all()
    assert media.decode_png(b"\x89PNG\r\n\x1a\nxx") is None and media.decode_png(b"") is None
    img = rng.integers(0, 255, (6, 5, 1), np.uint8)[..., 0].astype(int)
    raw = b""
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        row = bytearray([kind])
        for x in range(5):
            a, b, c = (img[y, x - 1] if x else 0), (img[y - 1, x] if y else 0), (img[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[kind]
            row.append(int(img[y, x] - guess) & 255)
        raw += bytes(row)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode_png(data)[..., 0] == img).all()


def y4m(w, h, frames):
    return f"YUV4MPEG2 W{w} H{h} F30:1 Cmono\n".encode() + b"".join(b"FRAME\n" + bytes([k]) * (w * h) for k in range(frames))


def test_files_to_views_and_back(spark, tmp_path):
    src, out = tmp_path / "in" / "deep", tmp_path / "out"
    src.mkdir(parents=True)
    out.mkdir()
    img = np.random.default_rng(5).integers(0, 255, (16, 32, 3), np.uint8)
    (src / "pano.PNG").write_bytes(media.encode_png(img))
    (src / "clip.y4m").write_bytes(y4m(8, 4, 61))
    (src / "bad.png").write_bytes(b"no image")
    (src / "pano.gpx").write_text("x")
    (src / "note.txt").write_text("x")
    assert [(r.path.rsplit("/")[-1], r.is_image) for r in media.list_media(spark, str(src)).collect()] == [("bad.png", True), ("pano.PNG", True)]
    every = spark.read.format("binaryFile").load(str(src)).select("path")
    assert {r.path.rsplit("/")[-1]: r.sidecar_path is not None for r in media.with_sidecars(media.list_media(spark, str(src)), every).collect()} == {"bad.png": False, "pano.PNG": True}
    frames = media.read_frames(spark.read.format("binaryFile").load(str(src)))
    assert {(r.path.rsplit("/")[-1], r["n"], r.e) for r in frames.groupBy("path").agg(F.count("*").alias("n"), F.max("error").alias("e")).collect()} >= {("clip.y4m", 61, None), ("pano.PNG", 1, None), ("bad.png", 1, "unreadable")}

    from orbitframe.cli import main

    assert main(["--input", str(tmp_path / "in"), "--output", str(out), "--resolution", "8", "--camera-count", "4", "--active-cameras", "0,2", "--interval", "1", "--format", "png"]) == 2  # one input can't be read
    (src / "bad.png").unlink()
    made = sorted(p.relative_to(out).as_posix() for p in out.rglob("*.png"))
    assert made == sorted([f"clip_processed/clip_frame{k:06d}_View_{v}.png" for k in (0, 30, 60) for v in (0, 2)] + [f"pano_processed/pano_frame000000_View_{v}.png" for v in (0, 2)])
    seen = media.decode_png((out / "pano_processed/pano_frame000000_View_0.png").read_bytes())
    assert (seen == raster.remap(img, *raster.view_map(16, 32, 8, 8, 90.0, 0.0, 0.0, 0.0))).all()
    assert main(["--config", "/nonexistent.json"]) == 1 and main([]) == 1 and main(["--input", str(tmp_path / "none")]) == 1
    for refused in (["--format", "bmp"], ["--quality", "0"], ["--altitude-mode", "above"], ["--ai", "--detector", "none:here"]):
        assert main(["--input", str(src), "--output", str(out), *refused]) == 1

    (src / "pano.gpx").write_text('<gpx><trk><trkseg><trkpt lat="-1.5" lon="2.25"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    assert main(["--input", str(src), "--output", str(out), "--flat", "--adaptive", "--motion-threshold", "50", "--export-telemetry", "--naming-mode", "simple", "--format", "png"]) == 0
    flat = {p.name: p.read_bytes() for p in out.rglob("*_flat.png")}
    assert set(flat) == {"pano_frame000000_flat.png", "clip_frame000000_flat.png"}
    assert sinks.gps_directory(-1.5, 2.25, 0.0) in flat["pano_frame000000_flat.png"] and b"eXIf" not in flat["clip_frame000000_flat.png"]


def test_masks_and_tiff_and_subtitles_from_the_command_line(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    out.mkdir()
    img = np.random.default_rng(6).integers(0, 255, (8, 8, 3), np.uint8)
    for name in ("a", "b", "c"):
        (src / f"{name}.png").write_bytes(media.encode_png(img))
    (src / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\n[latitude: 1.5] [longitude: 2.5] [rel_alt: 3.5 abs_alt: 9]\n\n")
    soft = [float(k >= 32) for k in range(64)]
    rows = [(f"file:{src}/a.png", 0, "flat", 0, 0.9, 8, 8, soft), (f"file:{src}/b.png", 0, "flat", 0, 0.1, 8, 8, soft)]
    found = str(tmp_path / "found.parquet")
    spark.createDataFrame(rows, "path string, frame_idx long, name string, class_id int, conf double, height int, width int, prob array<double>").write.parquet(found)

    from orbitframe.cli import main

    args = ["--input", str(src), "--output", str(out), "--flat", "--naming-mode", "simple", "--format", "png"]
    assert main([*args, "--ai-mask", "--detections", found, "--export-telemetry", "--altitude-mode", "relative"]) == 0
    files = {p.name: p.read_bytes() for p in out.rglob("*") if p.is_file()}
    masks = {n: media.decode_png(d)[..., 0] for n, d in files.items() if "mask" in n}
    assert len(masks) == 3 and sum((m == 255).all() for m in masks.values()) == 2
    (hit,) = [m for m in masks.values() if not (m == 255).all()]
    assert (hit[4:] == 0).all() and (hit[:3] == 255).all()
    assert sinks.gps_directory(1.5, 2.5, 3.5) in files["a_frame000000_flat.png"]
    again = tmp_path / "skip"
    again.mkdir()
    assert main(["--input", str(src), "--output", str(again), "--flat", "--ai-skip", "--detections", found, "--format", "tiff"]) == 0
    made = {p.name: p.read_bytes() for p in again.rglob("*.tif")}
    assert len(made) == 2 and all(d[:4] == b"II*\0" and img[..., ::-1].tobytes() in d for d in made.values())


def test_detectors(spark):
    dim, lit = np.zeros((4, 6), np.uint8), np.full((4, 6), 250, np.uint8)

    class Bright:
        def detect(self, images):
            return [[det.Detection(0, float(x.mean()) / 255, (x[..., 0] if x.ndim == 3 else x) / 255.0)] if x.mean() > 10 else [] for x in images]

    def broken():
        raise OSError("no weights")

    assert det.process_image(None, lit, "skip_frame", 0.5, None) == ("pass", None)
    assert det.process_image(Bright(), lit, "skip_frame", 0.5, [0])[0] == "drop" and det.process_image(Bright(), lit, "skip_frame", 0.5, [1])[0] == "keep"
    act, mask = det.process_image(Bright(), dim, "generate_mask", 0.5, None)
    assert act == "empty_mask" and (mask == 255).all() and mask.shape == (4, 6)
    act, mask = det.process_image(Bright(), lit, "generate_mask", 0.5, None, invert=False)
    assert act == "mask" and (mask == 255).all()
    rows = [(k, None if x is None else (4, 6, 1, bytearray(x.tobytes())), k != 3) for k, x in enumerate((dim, lit, None, lit))]
    views = spark.createDataFrame(rows, "k int, view_image struct<height:int,width:int,channels:int,data:binary>, inside boolean")
    got = lambda make: [r.ai_action for r in det.with_detector(views, make, "skip_frame", 0.5, None, scope="inside").orderBy("k").collect()]
    assert got(Bright) == ["keep", "drop", "pass", "pass"] and got(broken) == got(None) == ["pass"] * 4
    det.register("bright", Bright)
    assert got("bright") == got(Bright)


def test_seeks_metadata_and_small_pictures(spark, tmp_path):
    (tmp_path / "clip.y4m").write_bytes(y4m(8, 4, 61))
    (tmp_path / "short.y4m").write_bytes(y4m(8, 4, 60))
    (tmp_path / "p.png").write_bytes(media.encode_png(np.zeros((3, 5), np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/")[-1]: tuple(r)[1:] for r in media.media_metadata(files).collect()}
    assert got == {"clip.y4m": (30.0, 61, 8, 4), "short.y4m": (30.0, 60, 8, 4), "p.png": (0.0, 1, 5, 3), "bad.png": (None,) * 4}
    at = lambda only: {r.path.rsplit("/")[-1]: r.frame_idx for r in media.read_frames(files, only=only).where("error is null").collect()}
    assert at("middle") == {"clip.y4m": 30, "short.y4m": 0, "p.png": 0} and set(at("first").values()) == {0}
    frames = spark.createDataFrame([(j, k) for j, n in (("a", 61), ("b", 60)) for k in range(n)], "job_id string, frame_idx int")
    assert {tuple(r) for r in fr.middle_frame(frames).collect()} == {("a", 30), ("b", 0)} and fr.first_frame(frames).count() == 2
    img = np.random.default_rng(1).integers(0, 255, (20, 50, 3), np.uint8)
    assert raster.thumbnail(img, 10).shape == (10, 10, 3) and (raster.thumbnail(np.full((4, 9), 7, np.uint8), 3) == 7).all()
    assert (raster.area_resize(img, 50, 20) == img).all() and raster.area_resize(img, 25, 10)[0, 0, 0] == round(float(img[:2, :2, 0].mean()))
    look = raster.preview(img, 0.0, 0.0, 0.0, 90.0, size=16, widest=25)
    assert look.shape == (16, 16, 3) and raster.preview(None, 0, 0, 0, 90) is None
    edge = raster.remap(np.full((4, 4), 200, np.uint8), np.array([[3.5, 1.0]]), np.array([[1.0, 1.0]]), wrap=False)
    assert edge.tolist() == [[100, 200]]


def test_places_in_files():
    png = media.encode_png(np.zeros((2, 2), np.uint8))
    once = sinks.with_gps(png, -1.5, 2.25, -3.0)
    assert once.count(b"eXIf") == 1 and sinks.with_gps(once, 1, 1).count(b"eXIf") == 1
    assert media.decode_png(once).shape == (2, 2, 1)
    tiff = sinks.gps_directory(-1.5, 2.25, -3.0)
    gps = struct.unpack_from("<I", tiff, 8 + 2 + 8)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", tiff, gps)[0]):
        tag, kind, count, at = struct.unpack_from("<HHII", tiff, gps + 2 + 12 * k)
        tags[tag] = [n / d for n, d in struct.iter_unpack("<II", tiff[at : at + 8 * count])] if kind == 5 else tiff[gps + 2 + 12 * k + 8 : gps + 14 + 12 * k]
    assert tags[1][:1] == b"S" and tags[3][:1] == b"E" and tags[5][0] == 1
    assert tags[2] == [1, 30, 0] and tags[4] == [2, 15, 0] and tags[6] == [3]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x0aExif\0\0xx\xff\xda\x00\x02data\xff\xd9"
    placed = sinks.with_gps(jpeg, 1, 2, 3)
    assert placed[:4] == b"\xff\xd8\xff\xe1" and placed.count(b"Exif\0\0") == 1 and placed.endswith(b"\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9")
    assert sinks.with_gps(b"other", 1, 2) == b"other"


def test_failed_writes_are_reported(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    df = spark.createDataFrame([(str(tmp_path / "a"), "../x.png", bytearray(b"1")), (str(tmp_path / "file/b"), "y.png", bytearray(b"1")), (str(tmp_path), "z.png", None)], "output_dir string, image_name string, file binary")
    got = {r.path.rsplit("/")[-1]: r.ok for r in sinks.write_files(df).collect()}
    assert got == {"x.png": True, "y.png": False, "z.png": False} and (tmp_path / "a/x.png").exists()


def test_tracks_of_a_container(spark):
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    hdlr = lambda h: box(b"hdlr", bytes(8) + h + bytes(12))
    stsd = lambda t: box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">I", 1) + struct.pack(">I", 16) + t + bytes(8)))
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", 1000, 2500) + bytes(4))
    trak = lambda h, t: box(b"trak", box(b"mdia", mdhd + hdlr(h) + box(b"minf", stsd(t))))
    data = box(b"ftyp", b"isom") + box(b"moov", trak(b"vide", b"avc1") + trak(b"meta", b"gpmd") + trak(b"sbtl", b"tx3g"))
    df = spark.createDataFrame([("a.mp4", bytearray(data)), ("b.mp4", bytearray(b"\0\0"))], "path string, content binary")
    assert [(r.stream_index, r.kind, r.tag, r.duration) for r in media.isobmff_tracks(df).collect()] == [(0, "video", "avc1", 2.5), (1, "data", "gpmd", 2.5), (2, "subtitle", "tx3g", 2.5)]


def test_samples_out_of_a_container(spark):
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    row = lambda *v: struct.pack(">5l", *v)
    klv = lambda key, kind, size, count, body: key + bytes([ord(kind) if kind else 0, size]) + struct.pack(">H", count) + body + bytes(-len(body) % 4)
    devc = lambda *rows: (lambda s: klv(b"DEVC", "", 4, len(s) // 4, s))((lambda s: klv(b"STRM", "", 4, len(s) // 4, s))(klv(b"SCAL", "l", 4, 5, row(10, 10, 1, 1, 1)) + klv(b"GPS5", "l", 20, len(rows), b"".join(row(*r) for r in rows))))
    camm = lambda lat, lon: struct.pack("<HHddf", 0, 6, lat, lon, 1.0)
    parts = [devc((100, 200, 5, 0, 0), (110, 210, 6, 0, 0)), camm(3.0, 4.0), devc((120, 220, 7, 0, 0)), camm(5.0, 6.0), b"tail"]
    head = box(b"ftyp", b"isom")
    body, at, places = b"", len(head) + 8, []
    for p in parts:
        places.append(at + len(body))
        body += p
    table = lambda kind, *v: box(kind, struct.pack(f">{len(v) + 1}I", 0, *v))

    def trak(tag, sizes, chunks, runs, wide):
        offsets = box(b"co64", struct.pack(f">II{len(chunks)}Q", 0, len(chunks), *chunks)) if wide else table(b"stco", len(chunks), *chunks)
        stbl = box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">II", 1, 16) + tag + bytes(8)) + table(b"stsz", 0, len(sizes), *sizes) + table(b"stsc", len(runs) // 3, *runs) + offsets)
        mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", 1000, 4000) + bytes(4))
        return box(b"trak", box(b"mdia", mdhd + box(b"hdlr", bytes(8) + b"meta" + bytes(12)) + box(b"minf", stbl)))

    moov = box(b"moov", trak(b"gpmd", [len(parts[0]), len(parts[2])], [places[0], places[2]], [1, 1, 1], False) + trak(b"camm", [len(parts[1]), len(parts[3])], [places[1], places[3]], [1, 1, 1], True))
    data = head + box(b"mdat", body) + moov
    df = spark.createDataFrame([(1, "a.mp4", bytearray(data)), (2, "b.mp4", bytearray(data[:200]))], "job_id long, path string, content binary")
    got = media.container_tracks(df, payloads=True).collect()
    assert [(r.tag, bytes(r.payload)) for r in got] == [("gpmd", parts[0] + parts[2]), ("camm", parts[1] + parts[3])]
    from orbitframe.sources import tracks

    boxes = media.container_tracks(df, payloads=True).withColumn("job_id", F.lit(1).cast("long"))
    samples = {(r.lat, r.lon, r.alt, round(r.ts, 6)) for r in tracks.container_samples(boxes).collect()}
    assert samples == {(10.0, 20.0, 5.0, 0.0), (11.0, 21.0, 6.0, round(1 / 18, 6)), (12.0, 22.0, 7.0, round(2 / 18, 6)), (3.0, 4.0, 1.0, 0.0), (5.0, 6.0, 1.0, 2.0)}
    first = telemetry.chosen_tracks(boxes.select(F.lit(1).alias("media_id"), "kind", "tag", "stream_index", F.lit(0).alias("samples"), "payload", "duration", "job_id"))
    assert first.count() == 1 and tracks.container_samples(first).count() == 3


def test_interval_steps(spark):
    df = spark.createDataFrame([(0.5, "Seconds", 29.97), (1.0, "Seconds", 29.97), (2.9, "Frames", 0.0), (0.1, "Frames", 30.0), (3.0, "Seconds", 0.0)], "v double, u string, fps double")
    assert [r[0] for r in df.select(fr.interval_step(F.col("v"), F.col("u"), F.col("fps"))).collect()] == [14, 29, 2, 1, 1]
    assert math.isclose(spark.range(1).select(fr.frame_time(F.lit(30), F.lit(29.97))).first()[0], 30 / 29.97)
