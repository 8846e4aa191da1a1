"""Batches that are stopped, streams out of order, GPX files, and interpolation in pieces."""

import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import telemetry
from orbitframe.plans import jobs
from orbitframe.sources import tracks
from orbitframe.streaming import keyframes


def slow(spark):
    nap = F.udf(lambda x: time.sleep(0.05) or x, "long")
    return lambda: spark.range(100_000, numPartitions=8).select(nap("id")).write.format("noop").mode("overwrite").save()


def stopped_soon(spark, stop, tag):
    def wait():
        tracker = spark.sparkContext.statusTracker()
        while not tracker.getActiveJobsIds():
            time.sleep(0.05)
        time.sleep(0.5)
        stop()

    t = threading.Thread(target=wait)
    t.start()
    return t


def states(df):
    return {r.job: r.status for r in df.collect()}


def test_one_job_of_three_is_stopped(spark):
    quick = lambda: spark.range(10).count()
    t = stopped_soon(spark, lambda: jobs.stop_job(spark, "b1", "two"), "b1")
    done = jobs.run_batch(spark, {"two": slow(spark), "three": quick, "bad": lambda: 1 / 0}, "b1")
    t.join()
    assert states(done) == {"two": "Cancelled", "three": "Done", "bad": "Error"}
    assert {r.job: r.error for r in done.collect()}["bad"] == "division by zero"
    r = jobs.outcome(done).first()
    assert (r.n_jobs, r.n_errors, r.n_pending, r.outcome) == (3, 1, 0, "errors")
    assert spark.range(3).count() == 3


def test_a_batch_is_stopped(spark):
    t = stopped_soon(spark, lambda: jobs.stop_batch(spark, "b2"), "b2")
    done = jobs.run_batch(spark, {"first": lambda: None, "long": slow(spark), "next": lambda: 1 / 0, "last": lambda: None}, "b2")
    t.join()
    assert states(done) == {"first": "Done", "long": "Cancelled", "next": "Pending", "last": "Pending"}
    assert jobs.outcome(done).first().outcome == "cancelled"


def test_keyframes_of_late_rows(spark, tmp_path):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(j, 1000 * j + k, start + timedelta(seconds=10 * k, microseconds=rng.randrange(10**6)), rng.random() * 100) for j in range(4) for k in range(200)]
    want = set()
    for j in range(4):
        last = None
        for r in sorted((r for r in rows if r[0] == j), key=lambda r: (r[2], r[1])):
            if last is None or abs(r[3] - last) > 30:
                want.add(r[:2])
                last = r[3]
    # Three micro-batches; rows come up to five minutes late.
    by_arrival = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.random() * 300))
    schema = "job_id long, event_id long, ts timestamp, score double"
    more = [(None, 1, start, 5.0), (1, None, start, 5.0), (1, 7, start, None)]
    for k in range(3):
        part = by_arrival[k * len(rows) // 3 : (k + 1) * len(rows) // 3] + (more if k == 0 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = keyframes.run_to_end(spark, stream, 30.0)
    assert {(r.job_id, r.event_id) for r in got.collect()} == want


def test_gpx_scan_equals_the_parser(spark, tmp_path):
    point = lambda lat, lon, more: f'<trkpt lat="{lat}" lon="{lon}">{more}</trkpt>'
    t = lambda s: f"<time>2024-01-01T00:00:{s}</time>"
    files = {
        "plain": "<gpx><trk><trkseg>" + point(1, 2, t("05Z") + "<ele>3.5</ele>") + point("x", 2, t("01Z")) + point(4, 5, t("07.5Z")) + point(6, 7, "") + point(8, 9, "<ele>x</ele>" + t("09Z")) + "</trkseg></trk></gpx>",
        "named": '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>' + point(-1.5, 2, t("05+01:00")) + "\n" + point(4, 5, "<time>2023-12-31T23:00:09</time>") + "</trkseg></trk></gpx>",
        "late": "<gpx>" + point("x", 1, t("10Z")) + point(1, 1, t("12Z")) + point(2, 2, "<time>never</time>") + "</gpx>",
        "none": "<gpx></gpx>",
        "a b+c%20": "<gpx>" + point(1, 1, t("12Z")) + "</gpx>",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.gpx").write_text(text)
    (tmp_path / "x.srt").write_text("1")
    got = {}
    for r in tracks.read_gpx(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1][:-4], set()).add((r.seq, round(r.ts, 6), r.lat, r.lon, r.alt))
    assert got["plain"] == {(0, 0.0, 1.0, 2.0, 3.5), (1, 2.5, 4.0, 5.0, 0.0)}
    assert got["named"] == {(0, 0.0, -1.5, 2.0, 0.0), (1, 4.0, 4.0, 5.0, 0.0)}
    assert got["late"] == {(0, 2.0, 1.0, 1.0, 0.0)} and "none" not in got and got["a b+c%20"] == {(0, 0.0, 1.0, 1.0, 0.0)}
    df = spark.createDataFrame([(k, bytearray(text.encode())) for k, text in enumerate(files.values())], "job_id long, content binary")
    names = list(files)
    parsed = {}
    for r in tracks.parse_tracks(df, "gpx").collect():
        parsed.setdefault(names[r.job_id], set()).add((round(r.ts, 6), r.lat, r.lon, r.alt))
    assert parsed == {k: {x[1:] for x in v} for k, v in got.items()}


@pytest.mark.parametrize("most", [2, 7, 50, 10**6])
def test_interpolation_in_pieces(spark, most):
    rng = random.Random(most)
    q = [(j, float(rng.randrange(60)), k) for k in range(300) for j in (1, 2, 3)] + [(1, None, 900), (None, 4.0, 901), (4, 1.0, 902)]
    s = [(j, k, float(rng.randrange(10, 50)), rng.random(), rng.random(), rng.random()) for j, n in ((1, 200), (2, 3), (None, 5)) for k in range(n)]
    queries = spark.createDataFrame(q, "job_id long, t double, k long")
    samples = spark.createDataFrame(s, "job_id long, seq long, ts double, lat double, lon double, alt double")
    rows = lambda d: sorted(map(tuple, d.select("job_id", "t", "k", "lat", "lon", "alt").collect()), key=repr)
    plain = telemetry.interpolated(queries, samples)
    got = telemetry.interpolated_long(queries, samples, most)
    assert got.columns == plain.columns and rows(got) == rows(plain)
