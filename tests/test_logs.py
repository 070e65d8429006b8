"""The interaction log: exactly once, broken batches, sessions, odd records."""

import pytest

from spanwright.streaming.interaction_log import InteractionLog


@pytest.fixture
def log(spark, tmp_path):
    frame = spark.createDataFrame([], "question string, k int, session string, flags array<string>".replace("session", "topic"))
    return InteractionLog(spark, f"file://{tmp_path}/log", frame.schema)


def rows(spark, log, *records):
    return spark.createDataFrame([*records], log.schema)


def test_an_empty_log_has_no_records(log):
    assert log.records().count() == 0 and log.manifest().count() == 0 and log.broken().count() == 0


def test_replays_add_nothing_and_sessions_are_apart(spark, log):
    first = rows(spark, log, ("apa kabar é", 3, None, ["x"]), (None, None, None, None), ("same", 1, "t", []), ("same", 1, "t", []))
    assert log.write_batch(first, "a", 0) == 4
    assert log.write_batch(first, "a", 0) == 0
    assert log.write_batch(first, "b", 0) == 4
    assert log.write_batch(first.filter("false"), "a", 1) == 0
    got = log.records().filter("session = 'a'").collect()
    assert sorted((r.question or "", r.k or 0) for r in got) == [("", 0), ("apa kabar é", 3), ("same", 1), ("same", 1)]
    assert len({r.interaction_id for r in got}) == 3 and all(len(r.interaction_id) == 12 for r in got)
    assert log.broken().count() == 0 and log.manifest().count() == 3


def test_lines_are_plain_text_with_nulls(spark, log, tmp_path):
    log.write_batch(rows(spark, log, ("naïve", None, None, None)), "a", 0)
    text = "".join(p.read_text() for p in (tmp_path / "log/data/session=a/batch=0").glob("part-*"))
    assert "naïve" in text and '"k":null' in text and text.count("\n") == 1


def test_a_batch_that_broke_off_is_not_read_and_is_written_over(spark, log):
    log.write_batch(rows(spark, log, ("one", 1, None, None)), "a", 0)
    rows(spark, log, ("half", 1, None, None)).write.json(f"{log.path}/data/session=a/batch=1")  # no entry: the run died here
    assert [r.question for r in log.records().collect()] == ["one"]
    assert log.write_batch(rows(spark, log, ("whole", 2, None, None)), "a", 1) == 1
    assert sorted(r.question for r in log.records().collect()) == ["one", "whole"]


def test_lost_records_are_found(spark, log):
    log.write_batch(rows(spark, log, ("one", 1, None, None), ("two", 1, None, None)), "a", 0)
    rows(spark, log, ("one", 1, None, None)).write.mode("overwrite").json(f"{log.path}/data/session=a/batch=0")
    assert [(r.batch, r.records, r.n) for r in log.broken().collect()] == [(0, 2, 1)]


def test_two_runs_over_one_checkpoint(spark, log, tmp_path):
    inbox = f"file://{tmp_path}/inbox"
    for k in range(2):
        rows(spark, log, (f"q{k}", k, None, None)).write.mode("append").json(inbox)
        for _ in range(2):  # the second run of each finds nothing new
            log.append(spark.readStream.schema(log.schema).json(inbox), "a", f"file://{tmp_path}/state").awaitTermination()
    assert sorted(r.question for r in log.records().collect()) == ["q0", "q1"]
