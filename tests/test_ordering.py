"""Order-dependent helpers against a plain loop, with one key that holds most rows."""

from __future__ import annotations

import random

from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.functions.ordering import numbered, previous_value
from meterwise.operators import memory, questions

CLUSTERS = (
    "cluster_id string, workspace_id string, cluster_name string, cluster_source string, worker_node_type string, "
    "min_workers int, max_workers int, change_time timestamp, delete_time timestamp"
)


def hot_rows(n=600):
    draw = random.Random(3)
    return [("hot" if draw.random() < 0.7 else draw.choice(["a", "b", None]), i * 3, draw.randrange(5)) for i in range(n)]


def test_numbering_runs_on_across_buckets(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    result = numbered(df, ["k"], ["seq"], F.floor(F.col("seq") / 50), "n")
    seen: dict = {}
    expected = []
    for k, seq, _ in sorted(rows, key=lambda r: r[1]):
        expected.append((k, seq, seen.setdefault(k, 0)))
        seen[k] += 1
    assert rows_of(result, "k", "seq", "n") == sorted(expected, key=repr)


def test_previous_value_crosses_empty_buckets(spark):
    rows = [r for r in hot_rows() if not 300 < r[1] < 900]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    result = previous_value(df, ["k"], ["seq"], F.floor(F.col("seq") / 50), ["v"], "p")
    last: dict = {}
    expected = []
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        expected.append((k, seq, last.get(k)))
        last[k] = v
    assert rows_of(result, "k", "seq", "p.v") == sorted(expected, key=repr)


def test_no_window_spans_a_whole_key_of_rows(spark):
    df = spark.createDataFrame(hot_rows(), "k string, seq long, v int")
    plan = numbered(df, ["k"], ["seq"], F.floor(F.col("seq") / 50), "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(k#" in plan and ", _bucket#" in plan


def test_resizes_compare_with_the_version_before(frame, clock):
    def version(low, high, changed, cluster_id="1"):
        return (cluster_id, "w", "c", "JOB", "n", low, high, changed, None)

    clusters = frame(
        [
            version(1, 2, "2023-06-01 00:00:00"),
            version(1, 4, "2024-01-01 00:00:00"),  # the size before the week
            version(1, 4, "2024-01-25 00:00:00"),  # changed, not resized
            version(1, 8, "2024-01-25 00:30:00"),
            version(1, None, "2024-01-29 00:00:00"),
            version(2, 2, "2024-01-28 00:00:00", "new"),  # no version before
        ],
        CLUSTERS,
    )
    found = questions.cluster_resizes(clusters, clock)
    assert rows_of(found, "cluster_id", "old_max", "new_max") == [("1", 4, 8), ("1", 8, None)]


CONVERSATION = "session_id string, turn int, role string, content string"
NEW = "session_id string, seq long, role string, content string"


def test_turns_go_on_from_the_last(frame):
    old = frame([("s", 0, "user", "a"), ("s", 4, "user", "b")], CONVERSATION)
    new = frame([("s", 20_000, "user", "d"), ("s", 7, "user", "c"), ("fresh", 1, "user", "x")], NEW)
    assert rows_of(memory.assign_turns(old, new), "session_id", "turn", "content") == [
        ("fresh", 0, "x"), ("s", 5, "c"), ("s", 6, "d"),
    ]


def test_conversation_rows_store_json_and_empty_content(frame, clock, spark):
    turns = spark.sql(
        "SELECT 's' AS session_id, 0 AS turn, 'tool' AS role, CAST(NULL AS STRING) AS content, 'search' AS tool_name, "
        "named_struct('k', 4) AS tool_args, array(1, 2) AS tool_result"
    )
    row = memory.conversation_rows(turns, clock).first()
    assert (row["content"], row["tool_args"], row["tool_result"], row["user_id"]) == ("", '{"k":4}', "[1,2]", None)


def test_recent_turns_of_one_session_are_oldest_first(frame):
    rows = frame([("s", t, "user", str(t)) for t in range(30)] + [("o", 1, "user", "o")], CONVERSATION)
    assert [r["turn"] for r in memory.recent_turns(rows, session_id="s").collect()] == list(range(10, 30))
    assert memory.recent_turns(rows, limit=2).count() == 3


def test_recent_actions_filter_by_target_and_skill(frame):
    log = frame(
        [("1", "2024-01-01 00:00:00", "a", "x"), ("2", "2024-01-02 00:00:00", "a", "y"), ("3", "2024-01-02 00:00:00", "b", "x")],
        "action_id string, action_timestamp timestamp, skill_name string, target_id string",
    )
    newest = memory.recent_actions_filtered(log)
    assert [r["action_id"] for r in newest.collect()] == ["2", "3", "1"]
    assert rows_of(memory.recent_actions_filtered(log, "x", "a"), "action_id") == [("1",)]
