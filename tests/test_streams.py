"""Streams against the same work in batch, over several files and several runs."""

from __future__ import annotations

from datetime import timedelta

from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.operators import features
from meterwise.sources.driver_tables import CLOCK, knowledge_docs, load
from meterwise.streaming import common, documents, runs, utilization
from meterwise.streaming.common import file_stream

FOLDER = "/root/testdata/sf0.001"


def test_hours_are_whole_in_any_order_of_files(spark, tmp_path):
    nodes = load(spark, FOLDER).node_timeline.withColumn("day", F.dayofmonth("start_time"))
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(rows):
        rows.drop("day").coalesce(1).write.mode("append").parquet(inbox)
        utilization.refresh(file_stream(spark, inbox, files_per_trigger=1), out, progress)

    def numbers(df):
        return rows_of(
            df, "cluster_id", "workspace_id", "hour_window", F.round("avg_cpu_pct", 6), "peak_cpu_pct",
            F.round("avg_mem_pct", 6), "peak_mem_pct", "node_count", "node_type_count",
        )

    def batch(upto):
        return features.merge_node_hours(features.node_hours(upto, F.date_trunc("hour", "start_time")))

    arrive(nodes.where("day > 10"))
    assert numbers(utilization.hourly_from(spark, out)) == numbers(batch(nodes.where("day > 10")))
    arrive(nodes.where("day <= 10"))  # earlier days come later
    assert numbers(utilization.hourly_from(spark, out)) == numbers(batch(nodes))
    # A late sample changes the hour that it belongs to.
    late = nodes.where("day = 1").orderBy("start_time", "instance_id").limit(1).withColumn("cpu_user_percent", F.lit(100.0))
    arrive(late)
    assert numbers(utilization.hourly_from(spark, out)) == numbers(batch(nodes.unionByName(late)))
    # The late sample's batch wrote its own hour only, and each hour is read from one folder.
    hour = late.first()["start_time"].replace(minute=0, second=0, microsecond=0)
    written = common.parts(spark, out, "hour")
    last = max(b for batches in written.values() for b in batches)
    assert [h for h, batches in written.items() if last in batches] == [f"{hour:%Y-%m-%d-%H}"]
    read = utilization.hourly_from(spark, out).inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in read}) == nodes.select(F.date_trunc("hour", "start_time")).distinct().count()
    # A window reads its own hours; bounds within an hour count whole hours that begin inside.
    for since, until in ((hour, hour + timedelta(hours=2)), (hour - timedelta(minutes=30), hour + timedelta(minutes=90))):
        window = utilization.hourly_from(spark, out, since, until)
        assert numbers(window) == numbers(batch(nodes.unionByName(late)).where(F.col("hour_window").between(hour, hour + timedelta(hours=1))))
        assert len({f.rsplit("/", 1)[0] for f in window.inputFiles()}) <= 2


def test_superseded_parts_go_and_incomplete_batches_do_not_count(spark, tmp_path):
    path = str(tmp_path / "state")
    summed = lambda before, new: before.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    part = F.pmod("k", F.lit(3)).cast("string")
    for batch_id in (0, 1, 2, 3, 3, 4):  # batch 3 comes twice
        keys = spark.range(6 if batch_id == 0 else 1).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
        common.merge_batch(keys, path, batch_id, "part", part, summed)
    schema = "k long, n long"
    kept = common.parts(spark, path, "part")
    assert kept == {"0": [2, 3, 4], "1": [0], "2": [0]}
    assert rows_of(common.newest(spark, path, schema, "part")) == [(0, 5), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)]
    assert rows_of(common.newest(spark, path, schema, "part", before=4, only=["0"])) == [(0, 4), (3, 1)]
    (tmp_path / "state" / "batch_id=4" / "_SUCCESS").unlink()
    assert common.parts(spark, path, "part")["0"] == [2, 3]
    common.merge_batch(spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("n")), path, 5, "part", part, summed)
    assert rows_of(common.newest(spark, path, schema, "part"))[0] == (0, 4)
    assert common.newest(spark, str(tmp_path / "none"), schema, "part").count() == 0


def test_runs_split_over_batches_are_whole(spark, tmp_path):
    periods = load(spark, FOLDER).job_run_timeline
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    half = F.pmod(F.xxhash64("run_id", "period_start_time"), F.lit(2))
    for part in (0, 1):
        periods.where(half == part).coalesce(1).write.mode("append").parquet(inbox)
        runs.refresh(file_stream(spark, inbox), out, progress)
    assert rows_of(runs.collapsed_from(spark, out)) == rows_of(features.collapse_periods(periods))
    # Nothing new: nothing changes.
    runs.refresh(file_stream(spark, inbox), out, progress)
    assert rows_of(runs.collapsed_from(spark, out)) == rows_of(features.collapse_periods(periods))


def test_runs_of_many_batches_are_whole_and_batches_write_their_own_days(spark, tmp_path):
    periods = load(spark, FOLDER).job_run_timeline
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    part = F.pmod(F.xxhash64("run_id", "period_start_time"), F.lit(5))

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        runs.refresh(file_stream(spark, inbox), out, progress)

    for n in range(5):
        arrive(periods.where(part == n))
        assert rows_of(runs.collapsed_from(spark, out)) == rows_of(features.collapse_periods(periods.where(part <= n)))
    late = periods.where("to_date(period_start_time) = '2024-01-10'").withColumn("result_state", F.lit("TIMEDOUT"))
    arrive(late)
    assert rows_of(runs.collapsed_from(spark, out)) == rows_of(features.collapse_periods(periods.unionByName(late)))
    assert [d for d, batches in common.parts(spark, out, "day").items() if 5 in batches] == ["2024-01-10"]


def test_only_changed_documents_are_fed(spark, tmp_path):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inbox, feed, state, progress = (str(tmp_path / n) for n in ("in", "feed", "state", "progress"))
    edited = F.col("lang") == "fr"

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        documents.refresh(knowledge_docs(file_stream(spark, inbox)), feed, state, progress)

    arrive(raw)
    arrive(raw.withColumn("text", F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    arrive(raw)  # the edited ones go back
    counts = {r["batch_id"]: r["count"] for r in documents.feed_from(spark, feed).groupBy("batch_id").count().collect()}
    french = raw.where(edited).count()
    assert 0 < french < raw.count()
    assert counts == {0: raw.count(), 1: french, 2: french}
    few = raw.orderBy("doc_id").limit(3).withColumn("text", F.concat("text", F.lit("?")))
    arrive(few)
    buckets = {r[0] for r in few.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(documents.BUCKETS)).cast("string")).collect()}
    assert {b for b, batches in common.parts(spark, state, "bucket").items() if 3 in batches} == buckets
    assert documents.feed_from(spark, feed).where("batch_id = 3").count() == 3


def test_the_newest_version_of_a_batch_is_fed(spark, frame, tmp_path):
    inbox, feed, state, progress = (str(tmp_path / n) for n in ("in", "feed", "state", "progress"))
    schema = "doc_id string, title string, content string, source string, tags string, updated_at timestamp"

    def arrive(*versions):
        rows = [("1", "t", text, "s", "a", f"2024-01-0{day} 00:00:00") for text, day in versions]
        frame([*rows, ("2", "t", "same", "s", "a", "2024-01-01 00:00:00")], schema).coalesce(1).write.mode("append").parquet(inbox)
        documents.refresh(file_stream(spark, inbox), feed, state, progress)

    arrive(("v2", 2), ("v1", 1))
    arrive(("v1", 3))
    arrive(("v2", 4))
    arrive(("v2", 5))
    arrive(("v1", 6))
    fed = documents.feed_from(spark, feed).where("doc_id = '1'")
    assert rows_of(fed, "batch_id", "content") == [(0, "v2"), (1, "v1"), (2, "v2"), (4, "v1")]
    assert documents.feed_from(spark, feed).where("doc_id = '2'").count() == 1
