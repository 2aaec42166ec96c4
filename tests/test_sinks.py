from __future__ import annotations

from types import SimpleNamespace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import schemas, session
from meterwise.operators.knowledge import upsert_documents
from meterwise.plans import catalogue, refresh
from meterwise.plans.features import StoredFeatures
from meterwise.session import CHECKPOINT_DIR, scratch_cleared, settle, settle_once, shared_dir
from meterwise.sinks import tables as sink
from meterwise.sources.driver_tables import CLOCK, CONFIG, load
from meterwise.sources.platform import from_catalog, from_parquet, from_rows


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sink_tests")
    return "sink_tests"


def test_settle_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("half", F.col("id") / 2)
    again = settle(df, "numbers")
    assert again.schema.simpleString() == df.schema.simpleString()
    assert rows_of(again) == rows_of(df)


def test_scratch_is_deleted_at_the_end_and_shared_copies_are_made_anew(spark, tmp_path, monkeypatch):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    monkeypatch.setattr(session, "_application_dir", lambda spark: str(tmp_path / "scratch"))
    for _ in range(2):
        with scratch_cleared(spark):
            assert [settle_once(spark, "n", "source", make).count() for _ in range(2)] == [3, 3]
            assert list(tmp_path.rglob("*.parquet"))
        assert not (tmp_path / "scratch").exists()
    assert len(made) == 2


def session_double(master, folder=None):
    settings = {CHECKPOINT_DIR: folder} if folder else {}
    get = lambda name, default=None: settings.get(name, default)
    context = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: SimpleNamespace(get=get))
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)


def test_shared_folder_is_the_configured_one_and_local_only_in_tests():
    assert shared_dir(session_double("yarn", "hdfs://store/shared/")) == "hdfs://store/shared"
    local = session_double("local[2]")
    assert shared_dir(local) == shared_dir(local) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session_double("yarn"))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows_of(sink.upsert_rows(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]


def test_published_version_can_read_the_one_before(spark, database):
    name = f"{database}.corpus"
    first = sink.publish_version(spark.createDataFrame([(1, "a")], "k int, v string"), name)
    merged = sink.upsert_rows(spark.table(name), spark.createDataFrame([(1, "b")], "k int, v string"), ["k"])
    second = sink.publish_version(merged, name)
    assert first != second
    assert rows_of(spark.table(name)) == [(1, "b")]
    third = sink.publish_version(spark.table(name), name)
    assert sink.versions_of(spark, name) == [second, third]


def test_create_if_missing_leaves_rows(spark, database):
    table = f"{database}.docs"
    sink.create_table_if_missing(spark, table, schemas.KNOWLEDGE_DOCS)
    row = spark.createDataFrame([("1", "t", "c", "s", "a")], "doc_id string, title string, content string, source string, tags string")
    sink.append_rows(row.withColumn("updated_at", CLOCK.now), table, schemas.KNOWLEDGE_DOCS)
    sink.create_table_if_missing(spark, table, schemas.KNOWLEDGE_DOCS)
    assert spark.table(table).count() == 1


def test_append_checks_the_schema(spark, database):
    with pytest.raises(ValueError, match="missing"):
        sink.append_rows(spark.range(1), f"{database}.docs", schemas.KNOWLEDGE_DOCS)


def test_a_repeated_batch_replaces_its_own_rows_only(spark, database):
    schema = T.StructType().add("k", "long").add("v", "string")
    table = f"{database}.batches"
    sink.create_table_if_missing(spark, table, schema, batched=True)
    rows = lambda n, v: spark.range(n).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    for batch, given in (("a", rows(3, "old")), ("b", rows(2, "b")), ("a", rows(1, "new")), ("b", rows(2, "b"))):
        sink.replace_batch(given, table, schema, batch)
    assert rows_of(sink.batched_rows(spark, table)) == [(0, "b"), (0, "new"), (1, "b")]
    assert rows_of(sink.batched_rows(spark, table, but="b")) == [(0, "new")]
    sink.replace_batch(rows(0, "x"), table, schema, "a")  # what is gone goes
    assert rows_of(sink.batched_rows(spark, table)) == [(0, "b"), (1, "b")]
    with pytest.raises(ValueError, match="name for a batch"):
        sink.replace_batch(rows(1, "x"), table, schema, "a' OR")


def test_findings_at_the_size_of_the_correctness_run(spark):
    """At this size a job's waste is on two clusters: two rows of one target."""
    folder = "/root/testdata/sf0.01"
    stored, found = (catalogue.queries()[name](spark, folder) for name in ("stored_findings", "all_actions"))
    ids = [r["action_id"] for r in found.select("action_id").collect()]
    assert len(ids) == len(set(ids)) and rows_of(stored) == rows_of(found)


def test_overwrite_replaces_rows_and_can_partition(spark, database):
    table = f"{database}.trend"
    day = F.lit("2024-01-01").cast("date")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schemas.JOB_COST_TREND if f.name != "usage_date"}
    for n in (3, 2):
        rows = spark.range(n).withColumns({**empty, "usage_date": F.date_add(day, F.col("id").cast("int"))}).drop("id")
        sink.overwrite_table(rows, table, schemas.JOB_COST_TREND, partition_by="usage_date")
    assert spark.table(table).count() == 2


def test_refresh_writes_features_checks_findings_and_views(spark, database):
    tables = load(spark, "/root/testdata/sf0.001")
    stored = refresh.refresh_features(tables, database, CLOCK, CONFIG)
    assert isinstance(stored, StoredFeatures)
    assert stored.trend.schema.fieldNames() == schemas.JOB_COST_TREND.fieldNames()
    checks = refresh.log_reconciliation(stored, tables, database, CLOCK, CONFIG)
    log = spark.table(f"{database}.reconciliation_log")
    assert log.count() == checks.count() == 12
    assert log.where("mode = 'fast' AND detail LIKE concat(summary, ': %') AND checked_at IS NOT NULL").count() == 12
    refresh.log_findings(stored, tables, database, CLOCK, CONFIG)
    log = spark.table(f"{database}.agent_action_log")
    assert {"cost_spike_alert", "wasteful_compute_detector"} <= {r[0] for r in log.select("skill_name").distinct().collect()}
    names = refresh.publish_reports(stored, tables, database, CLOCK, CONFIG)
    assert len(names) == 18
    for name in names:
        assert spark.table(f"{database}.{name}").count() >= 0
    # A rebuild replaces; it does not add.
    before = stored.health.count()
    assert refresh.refresh_features(tables, database, CLOCK, CONFIG).health.count() == before


def test_catalog_source_reads_named_tables(spark, database):
    spark.createDataFrame([("w", "1", "n")], "workspace_id string, job_id string, name string").write.mode(
        "overwrite"
    ).saveAsTable(f"{database}.jobs")
    tables = from_catalog(spark, {"jobs": f"{database}.jobs"})
    assert tables.jobs.count() == 1
    with pytest.raises(AttributeError):
        tables.unknown


def test_parquet_source_and_rows(spark, tmp_path):
    row = ("c", "s", "2024-01-01", None, (0.5,))
    prices = from_rows(
        spark, [row],
        "cloud string, sku_name string, price_start_time string, price_end_time string, pricing struct<default:double>",
    )
    prices.write.parquet(str(tmp_path / "prices"))
    tables = from_parquet(spark, {"list_prices": str(tmp_path / "prices")})
    assert tables.list_prices.first()["unit_price"] == 0.5
    assert tables.list_prices is tables.list_prices


CORPUS = T.StructType().add("k", "string").add("v", "string").add("updated_at", "timestamp")


def corpus_rows(spark, pairs):
    rows = spark.createDataFrame(pairs, "k string, v string")
    return rows.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))


def replaced(before, batch):
    return upsert_documents(before, batch, "k")


def files_by_bucket(spark, name):
    version = spark.table(sink.versions_of(spark, name)[-1])
    rows = version.select("bucket", F.input_file_name()).distinct().collect()
    return {b: sorted(f for x, f in rows if x == b) for b, _ in rows}


def test_an_upsert_writes_the_buckets_of_its_keys_and_leaves_all_other_files(spark, database):
    name = f"{database}.bucketed"
    sink.create_buckets_if_missing(spark, name, CORPUS, buckets=8)
    assert spark.table(name).columns == ["k", "v", "updated_at"] and spark.table(name).isEmpty()
    expected = {str(i): "old" for i in range(100)}
    sink.upsert_buckets(corpus_rows(spark, list(expected.items())), name, CORPUS, "k", replaced)
    held, first = spark.table(sink.versions_of(spark, name)[-1]), files_by_bucket(spark, name)
    assert len(first) == 8
    for round_, keys in enumerate((["3", "new"], ["3"], ["50", "51"])):
        before, batch = files_by_bucket(spark, name), [(k, f"round {round_}") for k in keys]
        sink.upsert_buckets(corpus_rows(spark, batch), name, CORPUS, "k", replaced)
        expected |= dict(batch)
        assert rows_of(spark.table(name), "k", "v") == sorted(expected.items(), key=repr)
        touched = {r[0] for r in corpus_rows(spark, batch).select(sink.bucket_of("k", 8)).collect()}
        after = files_by_bucket(spark, name)
        assert {b for b in after if after[b] != before[b]} == touched
        if round_ == 0:  # a reader of the version before still has its files
            assert rows_of(held, "k", "v") == rows_of(corpus_rows(spark, [(str(i), "old") for i in range(100)]), "k", "v")
    sink.create_buckets_if_missing(spark, name, CORPUS, buckets=8)
    assert spark.table(name).count() == 101 and len(sink.versions_of(spark, name)) == 2
    sink.upsert_buckets(corpus_rows(spark, []), name, CORPUS, "k", replaced)
    assert rows_of(spark.table(name), "k", "v") == sorted(expected.items(), key=repr)


def test_a_batch_that_was_not_published_counts_for_nothing(spark, database, monkeypatch):
    name = f"{database}.interrupted"
    sink.create_buckets_if_missing(spark, name, CORPUS, buckets=4)
    sink.upsert_buckets(corpus_rows(spark, [(str(i), "old") for i in range(20)]), name, CORPUS, "k", replaced)
    before = rows_of(spark.table(name))

    def lost(*_):
        raise RuntimeError("driver lost")

    for value in ("a", "b", "c"):  # more often than superseded folders are kept
        with monkeypatch.context() as patched, pytest.raises(RuntimeError, match="driver lost"):
            patched.setattr(sink, "_publish_buckets", lost)
            sink.upsert_buckets(corpus_rows(spark, [("1", value), (value, value)]), name, CORPUS, "k", replaced)
        assert rows_of(spark.table(name)) == before
    sink.upsert_buckets(corpus_rows(spark, [("1", "new"), ("1", "newer")]), name, CORPUS, "k", replaced)
    assert rows_of(spark.table(name).where("v <> 'old'"), "k", "v") == [("1", "newer")]
    assert spark.table(name).count() == 20
    with pytest.raises(Exception, match="cannot be upserted"):
        sink.upsert_buckets(corpus_rows(spark, [(None, "x")]), name, CORPUS, "k", replaced)
    assert spark.table(name).count() == 20
