"""Queries that run as streams over stored logs, and give what their batch forms give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle import K, f
from ..plans import star
from ..sources import scratch
from ..streaming import twins

GAP_S, LATE_S = 1800, 3600


def _streamed(spark, rows, through, mode="append", files=2):
    """What a stream leaves that reads rows from a folder, some files at a time."""
    base = scratch.place(spark, "stream")
    rows.write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = through(source)
    twins.run_once(out, lambda df, k: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out"), f"{base}/checkpoint", mode)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_fold(spark, d):
    """Copies left of each fact after a log of stores and forgets; each micro-batch gives what it has changed, the last word counts."""
    log = star.facts(spark, d, "O")
    key = F.pmod("seq", F.lit(star.STEP))
    more = log.where(key % 7 == 0).select((F.col("seq") + 10 * star.STEP).alias("seq"), F.lit("forget").alias("op"), "s", "r", "o")
    rows = log.select("seq", F.lit("store").alias("op"), "s", "r", "o").union(more)
    base = scratch.place(spark, "stream")
    rows.repartitionByRange(4, "seq").write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    twins.run_once(twins.fold_stream(source), lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint", "update")
    out = spark.read.schema("s string, r string, o string, n long, batch int").parquet(f"{base}/out")
    return out.groupBy("s", "r", "o").agg(F.max_by("n", "batch").alias("n")).where("n > 0")


def stream_reinforced(spark, d):
    """Running records of what users did."""
    e = star.table(spark, d, "events")
    sights = e.select(F.concat(F.lit("user#"), F.col("user_id").cast("string")).alias("s"), F.lit("did").alias("r"), F.col("event_type").alias("o"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("external").alias("source"), (F.col("value") / 1000).alias("confidence"), F.col("event_id").alias("ts"))
    out = _streamed(spark, sights, twins.reinforce_stream, "complete")
    return out.withColumn("confidence", F.round("confidence", 6))


def _events(spark, d):
    return star.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user#"), F.col("user_id").cast("string")).alias("subject"), F.col("ts").cast("timestamp").alias("ts"))


def stream_sessions(spark, d):
    """Sessions of users that the watermark has closed; all events in one micro-batch, so that none is late."""
    out = _streamed(spark, _events(spark, d), lambda x: twins.session_stream(x, f"{GAP_S} seconds", f"{LATE_S} seconds"), files=10_000)
    return out.select("subject", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("begin", "end")], "n")


def stream_distinct(spark, d):
    """Events of which a third arrive twice, each given once, by day."""
    e = _events(spark, d)
    out = _streamed(spark, e.union(e.where("id % 3 = 0")), lambda x: twins.distinct_stream(x, late="3650 days"))
    return out.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


QUERIES = {x.__name__: x for x in (stream_fold, stream_reinforced, stream_sessions, stream_distinct)}


def sql() -> dict[str, str]:
    src = "(SELECT event_id AS id, 'user#' || user_id AS subject, ts FROM events)"
    return {
        "stream_fold": f"SELECT s, r, o, CAST(count(*) FILTER (seq % {K} % 7 <> 0) AS BIGINT) AS n FROM {f('O')} GROUP BY s, r, o HAVING count(*) FILTER (seq % {K} % 7 <> 0) > 0",
        "stream_reinforced": "SELECT 'user#' || user_id AS s, 'did' AS r, event_type AS o, CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'multi' WHEN min(event_id % 2) = 0 THEN 'user' ELSE 'external' END AS source, round(1 - (1 - arg_min(value, event_id) / 1000) * pow(0.9, count(*) - 1), 6) AS confidence, count(*) AS count, max(event_id) AS last_seen FROM events GROUP BY user_id, event_type",
        "stream_sessions": (
            f"WITH g AS (SELECT *, sum(CASE WHEN ts < was + INTERVAL {GAP_S} SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY ts, id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY subject ORDER BY ts, id) AS was FROM {src})) "
            f"SELECT subject, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begin, strftime(max(ts) + INTERVAL {GAP_S} SECOND, '%Y-%m-%d %H:%M:%S.%f') AS \"end\", count(*) AS n FROM g GROUP BY subject, k HAVING max(ts) + INTERVAL {GAP_S} SECOND <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL {LATE_S} SECOND"
        ),
        "stream_distinct": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    }
