import bisect
import random
import struct

import pytest

from orbitframe.operators.telemetry import interpolated, sanitized
from orbitframe.sources.tracks import parse_srt, parse_tracks


def samples(spark, kind, *payloads, **options):
    df = spark.createDataFrame([(i, bytearray(p), options.get("duration", 0.0)) for i, p in enumerate(payloads)], "job_id long, content binary, duration double")
    rows = parse_tracks(df, kind, duration="duration" if "duration" in options else None).orderBy("job_id", "seq").collect()
    return [[(r.ts, r.lat, r.lon, r.alt) for r in rows if r.job_id == i] for i in range(len(payloads))]


def srt(spark, text, mode="absolute"):
    df = spark.createDataFrame([(1, bytearray(text.encode()))], "job_id long, content binary")
    return [(r.ts, r.lat, r.lon, r.alt) for r in parse_srt(df, mode).orderBy("seq").collect()]


def block(n, body, time="00:00:0{n},000"):
    return f"{n + 1}\n{time.format(n=n)} --> 00:00:09,000\n{body}"


def test_srt_brackets_and_crlf(spark):
    text = "\r\n\r\n".join(block(n, f"x\r\n[latitude: 4{n}.5] [longitude : -2.25] [altitude: 35.0]").replace("\n", "\r\n").replace("\r\r", "\r") for n in (0, 1))
    assert srt(spark, text) == [(0.0, 40.5, -2.25, 35.0), (1.0, 41.5, -2.25, 35.0)]


def test_srt_altitudes(spark):
    both = block(0, "[latitude: 1] [longitude: 2] [rel_alt: 1.300 abs_alt: 425.971]")
    assert srt(spark, both)[0][3] == 425.971
    assert srt(spark, both, "relative")[0][3] == 1.3
    only = block(0, "[latitude: 1] [longitude: 2] [abs_alt: 9.5]")
    assert srt(spark, only, "relative")[0][3] == 9.5
    old = block(0, "[latitude: 1] [longitude: 2] [rel_alt: 1 ] [altitude: 7]")
    assert srt(spark, old)[0][3] == 7.0 and srt(spark, block(0, "[latitude: 1] [longitude: 2]"))[0][3] == 0.0


def test_srt_tuple_and_quirks(spark):
    assert srt(spark, block(2, "GPS(40.7128, -74.0060, 10.0)", "00:01:0{n},500")) == [(62.5, 40.7128, -74.006, 10.0)]
    for bad in ("GPS(1, 2)", "[latitude: 1]", "[latitude: 1.2.3] [longitude: 2]", "[latitude: 1] [longitude: 2] [abs_alt: -]", "nothing"):
        assert srt(spark, block(0, bad)) == []
    good = "[latitude: 1] [longitude: 2]"
    assert srt(spark, block(0, good, "00:00:0{n}.000")) == [] and srt(spark, "garbage") == [] and srt(spark, "") == []
    assert len(srt(spark, block(0, good) + "\n\n" + block(1, good))) == 2


GPX = '<gpx xmlns="{ns}"><trk><trkseg>{points}</trkseg></trk></gpx>'
POINT = '<trkpt lat="{lat}" lon="2.3522"><ele>35.0</ele><time>2024-01-01T00:00:0{s}Z</time></trkpt>'


def test_gpx(spark):
    one = "http://www.topografix.com/GPX/1/1"
    good = GPX.format(ns=one, points=POINT.format(lat=48.8566, s=0) + POINT.format(lat=48.9, s=1))
    bare = good.replace(f' xmlns="{one}"', "")
    old = GPX.format(ns="http://www.topografix.com/GPX/1/0", points=POINT.format(lat=1, s=0))
    partly = GPX.format(ns=one, points='<trkpt lat="x" lon="1"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1" lon="1"/>' + POINT.format(lat=5, s=3).replace("<ele>35.0</ele>", ""))
    got = samples(spark, "gpx", *(x.encode() for x in (good, bare, old, partly, GPX.format(ns=one, points=""), "<broken", "<!DOCTYPE x>" + good)))
    assert got[0] == [(0.0, 48.8566, 2.3522, 35.0), (1.0, 48.9, 2.3522, 35.0)] == got[1]
    assert got[2] == got[4] == got[5] == got[6] == []
    assert [p[1:] for p in got[3]] == [(5.0, 2.3522, 0.0)]


def klv(key, kind, size, count, body):
    return key.encode() + kind.encode() + bytes([size]) + struct.pack(">H", count) + body + b"\0" * (-len(body) % 4)


def nest(key, body):
    return klv(key, "\0", 1, len(body), body)


def test_gpmf(spark):
    scal = klv("SCAL", "l", 4, 5, struct.pack(">5i", 100, 100, 10, 10, 10))
    gps = klv("GPS5", "l", 20, 2, struct.pack(">10i", 4000, 2000, 500, 10, 10, 4100, 2000, 500, 10, 10))
    whole = nest("DEVC", nest("STRM", scal + gps))
    plain = nest("DEVC", nest("STRM", gps))
    zero = nest("DEVC", nest("STRM", klv("SCAL", "s", 2, 1, struct.pack(">h", 0)) + gps))
    flat = nest("DEVC", nest("STRM", scal + klv("GPS5", "l", 4, 10, struct.pack(">10i", *range(10)))))
    cut = nest("DEVC", nest("STRM", scal + gps)[:-8])
    byte = nest("DEVC", nest("STRM", klv("SCAL", "b", 1, 5, struct.pack(">5b", 100, 100, 10, 10, 10)) + gps))
    got = samples(spark, "gpmf", whole, plain, zero, flat, cut, byte, b"")
    assert got[0] == [(0.0, 40.0, 20.0, 50.0), (1 / 18, 41.0, 20.0, 50.0)] == got[5]
    assert got[1][0] == pytest.approx((0.0, 4e-4, 2e-4, 0.5))
    assert got[2] == got[3] == got[4] == got[6] == []


def packet(kind, body=b""):
    return struct.pack("<HH", 0, kind) + body


def gps(lat, lon, alt=5.0):
    return packet(6, struct.pack("<ddf", lat, lon, alt))


def test_camm(spark):
    two = gps(1.0, 2.0) + packet(2, bytes(12)) + packet(0) + gps(3.0, 4.0)
    lost = gps(1.0, 2.0) + packet(77, b"\x01\x02\x03") + gps(3.0, 4.0)
    got = samples(spark, "camm", two, gps(0, 0) + gps(1.0, 2.0), lost, gps(1.0, 2.0) + gps(3.0, 4.0)[:-3], b"", gps(95.0, 0), duration=2.0)
    assert got[0] == [(0.0, 1.0, 2.0, 5.0), (1.0, 3.0, 4.0, 5.0)] == got[2]
    assert got[1] == [(0.0, 1.0, 2.0, 5.0)] == got[3] and got[4] == got[5] == []
    assert [p[0] for p in samples(spark, "camm", two)[0]] == [0.0, 0.2]


def test_sanitized(spark):
    rows = [(1, 0, "1", "10", "20", "5"), (1, 1, None, "10", "20", None), (1, 2, "2", None, "20", "5"), (1, 3, "2", "x", "20", "5"), (1, 4, "2", "91", "20", "5"), (1, 5, "2", "NaN", "20", "5"), (1, 6, "2", "1", "180", "Infinity"), (1, 7, "2", "-90", "-180", "0"), (1, 8, "q", "1", "1", "0")]
    got = sanitized(spark.createDataFrame(rows, "job_id long, seq long, ts string, lat string, lon string, alt string")).orderBy("seq").collect()
    assert [(r.seq, r.ts, r.alt) for r in got] == [(0, 1.0, 5.0), (1, 0.0, 0.0), (7, 2.0, 0.0)]


def test_interpolated_by_bisection(spark):
    rng = random.Random(6)
    tracks = {j: sorted((rng.randrange(0, 12) / 2, k, rng.random(), rng.random(), rng.random()) for k in range(n)) for j, n in ((1, 15), (2, 1), (3, 0), (4, 6))}
    queries = [(j, rng.randrange(-2, 28) / 4, k) for j in tracks for k in range(40)]
    s = spark.createDataFrame([(j, *p) for j, ps in tracks.items() for p in ps], "job_id long, ts double, seq long, lat double, lon double, alt double")
    got = {(r.job_id, r.k): (r.lat, r.lon, r.alt) for r in interpolated(spark.createDataFrame(queries, "job_id long, t double, k long"), s).collect()}
    for j, t, k in queries:
        ps = tracks[j]
        if not ps:
            want = (None,) * 3
        else:
            i = bisect.bisect_left([p[0] for p in ps], t)
            a, b = ps[max(0, i - 1)], ps[min(len(ps) - 1, i)]
            f = 0 if i in (0, len(ps)) else (t - a[0]) / (b[0] - a[0])
            a = ps[0] if i == 0 else a
            want = tuple(x + (y - x) * f for x, y in zip(a[2:], b[2:])) if i < len(ps) else ps[-1][2:]
        assert got[j, k] == (pytest.approx(want) if want[0] is not None else want)


def test_gpmf_query_gives_every_sample_of_a_long_job(spark, tmp_path):
    import duckdb

    from orbitframe.plans.queries import _WRITTEN, parse_gpmf

    duckdb.sql(f"""copy (select i as event_id, timestamp '2024-01-01' + interval (i) second as ts, i % 40 // 39 as user_id, 'view' as event_type, i % 400 + 0.5 as value, '{{}}' as props
        from range(8000) r(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    duckdb.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    want = duckdb.sql(f"with {_WRITTEN} select job_id, n, round(n / 18.0::double, 6), lat, lon, alt from w").fetchall()
    got = [(r.job_id, r.seq, r.ts, r.lat, r.lon, r.alt) for r in parse_gpmf(spark, str(tmp_path)).collect()]
    assert max(n for _, n, *_ in want) > 6000
    assert sorted(tuple(round(float(v), 5) for v in r) for r in got) == sorted(tuple(round(float(v), 5) for v in r) for r in want)
