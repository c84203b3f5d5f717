"""Crawl progress and liveness, as batch views and as streams with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock

HEARTBEATS = "crawl_job_id string, ts timestamp_ntz, received_at timestamp_ntz, phase string, processed bigint"
EVERY = 3
LATE = "2 days"
#: A job that sends nothing for so long is over.
QUIET_MS = 2 * 24 * 3600 * 1000


def progress(beats: DataFrame) -> DataFrame:
    """Per job: first and last report, pages processed, last known phase, distinct reports.

    Reports delivered twice count once; everything merges map-side, so one busy job is no bottleneck.
    """
    b = beats.select("crawl_job_id", "ts", "phase", "processed").distinct()
    return b.groupBy("crawl_job_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("processed").alias("processed"), F.max_by("phase", F.when(F.col("phase").isNotNull(), F.struct("ts", "phase"))).alias("phase"), F.count("*").alias("reports")
    )


def job_health(beats: DataFrame, now: str) -> DataFrame:
    """Per job: seconds since its last report, and its health by them; a job whose reports have no time is taken as healthy."""
    last = beats.groupBy("crawl_job_id").agg(F.max("ts").alias("last_ts"))
    age = clock.seconds_since(F.col("last_ts"), clock.at(now))
    return last.select("crawl_job_id", age.alias("age_s"), clock.health_at(age).alias("health"))


def stalled(jobs: DataFrame, beats: DataFrame, now: str) -> DataFrame:
    """Running jobs without a report for STALLED_S seconds, with the message they end with."""
    last = progress(beats).select("crawl_job_id", "last_ts", "phase")
    j = jobs.where("status = 'running'").select(F.col("id").alias("crawl_job_id")).join(last, "crawl_job_id", "left")
    old = F.col("last_ts").isNull() | (clock.seconds_since(F.col("last_ts"), clock.at(now)) > clock.STALLED_S)
    return j.where(old).select("crawl_job_id", F.concat(F.lit("Job stalled in phase "), F.coalesce("phase", F.lit("unknown"))).alias("error_message"))


def notifications(beats: DataFrame) -> DataFrame:
    """The reports that are passed on: a job's first, then every third, in time order."""
    w = Window.partitionBy("crawl_job_id").orderBy("ts", F.asc_nulls_first("processed"), F.asc_nulls_first("phase"))
    d = beats.select("crawl_job_id", "ts", "phase", "processed").distinct()
    return d.withColumn("no", F.row_number().over(w)).where((F.col("no") - 1) % EVERY == 0).select("crawl_job_id", "ts", "processed", "no")


def activity(beats: DataFrame, width: str = "1 hour") -> DataFrame:
    """Reports per job and window of event time."""
    d = beats.select("crawl_job_id", "ts", "phase", "processed").distinct()
    return d.groupBy("crawl_job_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("reports")).select("crawl_job_id", F.col("w.start").alias("window_start"), "reports")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(HEARTBEATS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def throttle_stream(beats: DataFrame) -> DataFrame:
    """Notifications of a stream: per job a counter is kept; the first report and every third are emitted.

    Reports of one micro-batch are taken in the order of the batch view, repeats among them once; reports that
    come in a later micro-batch count when they come, so a stream read in one micro-batch gives the batch's
    rows. A job's counter is dropped once nothing came for QUIET_MS.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame([], columns=["crawl_job_id", "ts", "processed", "no"]).astype({"processed": "Int64"})
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        n = state.get[0] if state.exists else 0
        # a job's reports of one trigger; the source bounds them by files per trigger
        pdf = pd.concat([b[["ts", "processed", "phase"]] for b in batches]).drop_duplicates()
        pdf = pdf.sort_values(["ts", "processed", "phase"], na_position="first")
        out = [(key[0], ts, processed, n + i + 1) for i, (ts, processed) in enumerate(pdf[["ts", "processed"]].itertuples(index=False)) if (n + i) % EVERY == 0]
        state.update((n + len(pdf),))
        state.setTimeoutDuration(QUIET_MS)
        yield pd.DataFrame(out, columns=none.columns).astype({"processed": "Int64"}) if out else none

    return beats.groupBy("crawl_job_id").applyInPandasWithState(step, "crawl_job_id string, ts timestamp_ntz, processed long, no long", "n long", "append", "ProcessingTimeTimeout")


def activity_stream(beats: DataFrame, width: str = "1 hour") -> DataFrame:
    """Windowed report counts; repeats are dropped and state is evicted once the watermark passed."""
    d = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["crawl_job_id", "ts", "phase", "processed"])
    return d.groupBy("crawl_job_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("reports")).select("crawl_job_id", F.col("w.start").alias("window_start"), "reports")


def ingest_stream(pages: DataFrame, handle, checkpoint: str):
    """Run ``handle(batch, batch_id)`` on every micro-batch of pages until the source is drained."""
    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completions(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """One event per ended job: (crawl_job_id, event, processed, snippets_extracted, seconds, error_message)."""
    last = progress(beats).select(F.col("crawl_job_id").alias("id"), F.col("processed").alias("reported"))
    ended = jobs.where("status in ('completed', 'failed', 'cancelled')").join(last, "id", "left")
    event = F.when((F.col("status") == "completed") & F.col("error_message").isNull(), "completed").otherwise("failed")
    seconds = F.expr("cast(timestampdiff(SECOND, started_at, completed_at) as long)")
    return ended.select(F.col("id").alias("crawl_job_id"), event.alias("event"), F.greatest(F.coalesce("processed_pages", F.lit(0)).cast("long"), F.coalesce("reported", F.lit(0))).alias("processed"), F.col("snippets_extracted").cast("long").alias("snippets_extracted"), seconds.alias("seconds"), "error_message")


def for_subscribers(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client, ...): events of the jobs that clients follow; ``subscriptions`` has (client, crawl_job_id), a null job follows all."""
    own = subscriptions.where("crawl_job_id is not null").select("client", "crawl_job_id").distinct()
    every = subscriptions.where("crawl_job_id is null").select("client").distinct()
    some = events.join(own, "crawl_job_id").select("client", *events.columns)
    # clients that follow everything get every event, by definition; they are connections of one server
    return some.unionByName(events.crossJoin(every.join(own.select("client").distinct(), "client", "left_anti")).select("client", *events.columns))


def active(jobs: DataFrame) -> DataFrame:
    """(id, active): whether a job is under way."""
    return jobs.select("id", F.coalesce(F.col("status").isin("running", "pending"), F.lit(False)).alias("active"))
