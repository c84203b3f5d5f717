import datetime as dt

from conftest import SMALL, agree
from pyspark.sql import functions as F

from snipquarry.engine import tables
from snipquarry.plans.queries import LIVE
from snipquarry.plans.registry import ORACLE
from snipquarry.sources import files, web
from snipquarry.streaming import progress


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "docs/a.md").write_text("# Title\ntext")
    (tmp_path / "docs/b.rst").write_bytes(b"\xff\xfe bad")
    (tmp_path / "docs/c.txt").write_bytes(b"x\x00y")
    (tmp_path / "docs/d.py").write_text("no")
    (tmp_path / "node_modules/e.md").write_text("no")
    f = files.read_files(spark, str(tmp_path), root=str(tmp_path))
    assert {r.rel: r.problem for r in f.collect()} == {"docs/a.md": None, "docs/b.rst": "not_utf8", "docs/c.txt": "binary"}
    assert [(r.url, r.title, r.content_type) for r in files.as_uploads(f, "s").collect()] == [("upload://s/a.md", "Title", "markdown")]
    assert files.as_repository(f, "https://github.com/o/n").first()["url"] == "https://github.com/o/n/blob/main/docs/a.md"
    assert files.read_files(spark, str(tmp_path), max_bytes=2).where("problem = 'too_large'").count() == 3
    assert files.read_files(spark, str(tmp_path), include=["docs/*.md"], root=str(tmp_path)).count() == 1
    files.write_version(f.select("rel"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert '"rel":"docs/a.md"' in files.as_json(f.where("problem is null").select("rel", "problem")).first()["json"]


def test_web(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>hi</p>")
    web.register(spark)
    good, bad = f"file://{tmp_path}/p.html", f"file://{tmp_path}/none"
    got = {r.url: r for r in spark.read.format("page").option("urls", f"{good}\n{bad}").option("per_task", "1").load().collect()}
    assert got[good].content == "<p>hi</p>" and got[bad].content is None and got[bad].error


def test_stream_agrees_with_batch(spark, tmp_path):
    b = tables(spark, SMALL).heartbeats
    clean = b.select("crawl_job_id", "ts", "received_at", "phase", "processed")  # with its repeats
    clean.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = progress.throttle_stream(progress.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("thr").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(repr(tuple(r)) for r in spark.table("thr").collect()) == sorted(repr(tuple(r)) for r in progress.notifications(b).collect()) and spark.table("thr").count() > 9
    seen = []
    q = progress.ingest_stream(progress.read_stream(spark, str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sum(seen) == clean.count()


def test_activity_stream_drops_repeats(spark, tmp_path):
    ts = dt.datetime(2025, 1, 1, 0, 10)
    r = [("j", ts, ts, "crawling", 1)] * 2 + [("j", ts + dt.timedelta(days=9), ts, "crawling", 2)]
    spark.createDataFrame(r, progress.HEARTBEATS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = progress.activity_stream(progress.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("act").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("act").where(F.col("reports") == 1).count() >= 1


def test_stalled(spark):
    t0 = dt.datetime(2025, 1, 1)
    b = spark.createDataFrame([("a", t0, t0, "crawling", 1), ("b", t0 + dt.timedelta(seconds=50), t0, None, None)], progress.HEARTBEATS)
    j = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "running"), ("d", "completed")], "id string, status string")
    got = dict(tuple(r) for r in progress.stalled(j, b, "2025-01-01 00:01:01").collect())
    assert got == {"a": "Job stalled in phase crawling", "c": "Job stalled in phase unknown"}


def test_job_health_agrees_with_sql_around_now(spark, tmp_path):
    import duckdb

    now = dt.datetime.fromisoformat(LIVE)
    ages = {"ahead": -0.25, "just": 0.25, "hours ahead": -7730.338211, "whole ahead": -60.0, "30": 30.999999, "31": 31.0, "60": 60.999999, "61": 61.0, "old": 9e9}
    beats = [(k, now - dt.timedelta(seconds=v), now, "crawling", 1) for k, v in ages.items()] + [("none", None, now, None, None), (None, now, now, None, None), ("mixed", None, now, None, None), ("mixed", now, now, None, None)]
    b = spark.createDataFrame(beats, progress.HEARTBEATS)
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    c = duckdb.connect()
    c.sql(f"create view crawl_heartbeats as select * from '{tmp_path}/b/*.parquet'")
    agree(progress.job_health(b, LIVE), c, ORACLE["job_health"])
    got = {r.crawl_job_id: (r.age_s, r.health) for r in progress.job_health(b, LIVE).collect()}
    assert got["ahead"] == (-1, "healthy") and got["hours ahead"] == (-7731, "healthy") and got["none"] == (None, "healthy") and got["61"] == (61, "stalled")
