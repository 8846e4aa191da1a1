"""Telemetry: cleaning, choice of source, clocks, and interpolation at frame times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe.session import cut_lineage


def sanitized(samples: DataFrame) -> DataFrame:
    """Valid samples (job_id, seq, ts, lat, lon, alt as double), from numbers or text.

    Missing or non-numeric positions, non-finite values and positions out of range go; missing time
    and altitude count as 0.
    """
    num = lambda c: F.expr(f"try_cast({c} as double)")
    s = samples.withColumns({"lat": num("lat"), "lon": num("lon"), "_a": num("alt"), "_t": num("ts")})
    # A value that is given but isn't a number drops the sample, a missing one counts as 0.
    bad = (F.col("alt").isNotNull() & F.col("_a").isNull()) | (F.col("ts").isNotNull() & F.col("_t").isNull())
    s = s.where(~bad).withColumns({"alt": F.coalesce("_a", F.lit(0.0)), "ts": F.coalesce("_t", F.lit(0.0))}).drop("_a", "_t")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return s.where(finite("alt") & finite("ts") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def interpolated(queries: DataFrame, samples: DataFrame) -> DataFrame:
    """queries (job_id, t, ...) with lat, lon, alt at t; null where the job has no samples.

    Linear between the last sample before t and the first at or after it; outside the samples the nearest.
    Samples and queries go through two running windows in one sort order and its reverse, so nothing is
    joined by range. Equal times are in the order of seq.
    """
    s = samples.select("job_id", F.col("ts").alias("_t"), F.lit(1).alias("_k"), F.col("seq").alias("_seq"), F.struct("ts", "lat", "lon", "alt").alias("_s"))
    keep = [c for c in queries.columns if c != "job_id"]
    q = queries.select("job_id", F.col("t").cast("double").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_seq"), F.struct(*keep).alias("_q"))
    both = q.unionByName(s, allowMissingColumns=True)
    # At equal times a query comes before the samples, so they follow it.
    up = Window.partitionBy("job_id").orderBy(F.col("_t"), F.col("_k"), F.col("_seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("job_id").orderBy(F.col("_t").desc(), F.col("_k").desc(), F.col("_seq").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_prev", F.last("_s", ignorenulls=True).over(up)).withColumn("_next", F.last("_s", ignorenulls=True).over(down))
    r = both.where("_k = 0")
    a, b = F.coalesce("_prev", "_next"), F.coalesce("_next", "_prev")
    part = F.when(b.ts > a.ts, (F.col("_t") - a.ts) / (b.ts - a.ts)).otherwise(F.lit(0.0))
    at = lambda c: (a[c] + (b[c] - a[c]) * part).alias(c)
    return r.select("job_id", "_q.*", at("lat"), at("lon"), at("alt"))


def interpolated_long(queries: DataFrame, samples: DataFrame, most: int = 1_000_000) -> DataFrame:
    """interpolated for jobs of any length: no task has more than about ``most`` rows of a job, but for those of one time.

    Jobs longer than that are cut at quantiles of their times. A piece is then a job of its own, which the last sample before it and the first one
    after it are added to; with those each query has the same neighbours as in the whole job. Rows of null jobs or times are
    placed as by interpolated.
    """
    time = lambda d, t, seq: d.select("job_id", F.col(t).cast("double").alias("_t"), seq.cast("long").alias("_seq"))
    every = time(queries, "t", F.lit(None)).unionByName(time(samples, "ts", F.col("seq")))
    sizes = every.groupBy("job_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    sizes = cut_lineage(sizes)
    if sizes.isEmpty():
        return interpolated(queries, samples)
    widest = sizes.agg(F.max("_n")).first()[0]
    parts = -(-widest // most)
    # Borders at shares of the longest job's pieces: shorter ones are cut more finely than they have to be, but not below most / 2.
    wanted = lambda n: F.transform(F.sequence(F.lit(1), F.ceil(n / most).cast("int") - 1), lambda k: F.round(k / F.ceil(n / most) * parts * 2).cast("int") - 1)
    shares = [k / (2 * parts) for k in range(1, 2 * parts)]
    cuts = every.join(F.broadcast(sizes), "job_id").groupBy("job_id").agg(F.first("_n").alias("_n"), F.percentile_approx("_t", F.array(*map(F.lit, shares)), 10_000).alias("_all"))
    cuts = cut_lineage(cuts.where("_all is not null").select(F.col("job_id").alias("_job"), F.array_distinct(F.transform(wanted(F.col("_n")), lambda k: F.get("_all", k))).alias("_cuts")))

    def pieced(d: DataFrame, t: str) -> DataFrame:
        d = d.join(F.broadcast(cuts), F.col("job_id") == F.col("_job"), "left")
        at = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(t).cast("double"))), F.lit(0))
        return d.withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(at)).drop("_job", "_cuts")

    s, q = pieced(samples.select("job_id", "seq", "ts", "lat", "lon", "alt"), "ts"), pieced(queries, "t")
    # A row a piece: its first and last sample, handed on to the pieces that follow or go before.
    ends = s.groupBy("job_id", "_piece").agg(
        F.min(F.struct("ts", "seq", "lat", "lon", "alt")).alias("_first"), F.max(F.struct("ts", "seq", "lat", "lon", "alt")).alias("_last")
    )
    pieces = q.select("job_id", "_piece").distinct().join(ends, ["job_id", "_piece"], "full")
    by = Window.partitionBy("job_id").orderBy("_piece")
    down = Window.partitionBy("job_id").orderBy(F.col("_piece").desc())
    before, after = (F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c, w in (("_last", by), ("_first", down)))
    handed = pieces.withColumns({"_before": before, "_after": after})
    handed = handed.select("job_id", "_piece", F.explode(F.array("_before", "_after")).alias("x")).where("x is not null").select("job_id", "_piece", "x.*")
    key = F.xxhash64("job_id", "_piece").alias("job_id")
    piece_samples = s.unionByName(handed).select(key, "seq", "ts", "lat", "lon", "alt")
    out = interpolated(q.withColumnRenamed("job_id", "_whole").select(F.xxhash64("_whole", "_piece").alias("job_id"), *(c for c in ("_whole", *queries.columns) if c != "job_id")), piece_samples)
    return out.withColumn("job_id", F.col("_whole")).drop("_whole")


def chosen_tracks(streams: DataFrame) -> DataFrame:
    """The one track of each media file that telemetry is taken from, with all its parts where streams have a column part (and the first one else).

    streams: (media_id, kind, tag, stream_index, samples); kind is sidecar, data or subtitle. A sidecar
    with samples wins; else the first data stream tagged gpmd or camm, even if it has none; else the first
    subtitle stream.
    """
    rank = (
        F.when((F.col("kind") == "sidecar") & (F.col("samples") > 0), 0)
        .when((F.col("kind") == "data") & F.lower("tag").rlike("gpmd|camm"), 1)
        .when(F.col("kind") == "subtitle", 2)
    )
    first = Window.partitionBy("media_id").orderBy("rank", "stream_index", "kind", "tag")
    return streams.withColumn("rank", rank).where("rank is not null").withColumn("n", (F.rank() if "part" in streams.columns else F.row_number()).over(first)).where("n = 1").drop("n", "rank")


def even_timestamps(samples: DataFrame, duration: Column, job: str = "job_id") -> DataFrame:
    """ts of the i-th of n samples by seq: i / n of the duration, or 0.2 i without one."""
    by = Window.partitionBy(job)
    i = F.row_number().over(by.orderBy("seq")) - 1
    n = F.count("*").over(by)
    return samples.withColumn("ts", F.when(duration > 0, i / n * duration).otherwise(i * 0.2))


def clock_timestamps(samples: DataFrame, rate: float = 18.0, job: str = "job_id") -> DataFrame:
    return samples.withColumn("ts", (F.row_number().over(Window.partitionBy(job).orderBy("seq")) - 1) / F.lit(rate))


def relative_to_first(samples: DataFrame, micros: str, job: str = "job_id") -> DataFrame:
    """ts in seconds from the first timed sample by seq."""
    first = F.first(micros).over(Window.partitionBy(job).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return samples.withColumn("ts", (F.col(micros) - first) / 1e6)
