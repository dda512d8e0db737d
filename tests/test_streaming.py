"""Jobs with a state: queues, discovery, snapshots and sessions, over several runs, triggers and replays."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.plans.state import situations, turn_facts
from quillspark.sources.sinks import fresh_folder, shared_folder
from quillspark.sources.snapshots import Snapshots, progress
from quillspark.streaming import jobs
from tests.compare import DATA, query_rows

CLOCK = "2024-01-31 12:00:00"


def at(text):
    return datetime.datetime.fromisoformat(text)


def state_of(queue):
    return {r["event_id"]: (r["status"], r["attempts"]) for r in queue.rows().collect()}


def test_a_replayed_step_changes_nothing(spark):
    queue = jobs.Queue(spark, fresh_folder(spark, "queue"))
    rows = spark.createDataFrame([(3, at("2024-01-03")), (1, at("2024-01-02")), (2, None), (4, at("2024-01-02"))], "event_id bigint, queued_at timestamp_ntz")
    for _ in range(2):
        queue.submit(rows, "b0-submit")
        assert [r[0] for r in queue.claim(2, CLOCK, "b0-claim").orderBy("event_id").collect()] == [1, 4]
    queue.complete(spark.createDataFrame([(1, "completed"), (2, "completed")], "event_id bigint, outcome string"), "b0-end")
    want = {1: ("completed", 1), 2: ("queued", 0), 3: ("queued", 0), 4: ("processing", 1)}
    assert state_of(queue) == want
    versions = len(queue.store.pointers())
    queue.submit(rows, "b0-submit")
    queue.claim(2, CLOCK, "b0-claim")
    queue.complete(spark.createDataFrame([(4, "failed")], "event_id bigint, outcome string"), "b0-end")
    assert state_of(queue) == want and len(queue.store.pointers()) == versions


def test_what_is_stale_is_worked_on_again(spark):
    queue = jobs.Queue(spark, fresh_folder(spark, "queue"))
    queue.submit(spark.createDataFrame([(1, at("2024-01-01")), (2, at("2024-01-02"))], "event_id bigint, queued_at timestamp_ntz"), "s")
    queue.claim(1, "2024-01-31 11:00:00", "c1")
    queue.claim(1, "2024-01-31 11:45:00", "c2")
    queue.recover(CLOCK, "r")
    assert state_of(queue) == {1: ("queued", 1), 2: ("processing", 1)}
    assert [r[0] for r in queue.claim(None, CLOCK, "c3").collect()] == [1]
    assert state_of(queue)[1] == ("processing", 2)


def test_drain_over_several_files_and_runs(spark):
    """Files are batches of their own; a second run over the same folder works on new files only."""
    source, folder, worked = fresh_folder(spark, "events"), fresh_folder(spark, "queue"), []
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    put = lambda ids: spark.createDataFrame([(k, at("2024-01-01"), "error" if k % 2 else "view") for k in ids], schema).coalesce(1).write.mode("append").parquet(source)

    def work(claimed):
        worked.append(sorted(r[0] for r in claimed.collect()))
        return claimed.select("event_id", F.lit("completed").alias("outcome"))

    put(range(4)), put(range(2, 8))
    drain = lambda: jobs.drain(spark, source, spark.read.parquet(source).schema, work, folder, CLOCK, "event_type = 'error'", files_a_batch=1)
    assert {r["event_id"]: (r["status"], r["attempts"]) for r in drain().collect()} == {k: ("completed", 1) for k in (1, 3, 5, 7)}
    assert len(worked) == 2 and sorted(worked[0] + worked[1]) == [1, 3, 5, 7]
    put([9, 10])
    assert {r["event_id"] for r in drain().collect()} == {1, 3, 5, 7, 9} and worked[2:] == [[9]]


def test_discovery_admits_new_files_only(spark):
    source, state = fresh_folder(spark, "pages"), fresh_folder(spark, "seen")
    put = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(source)
    put(0, 5)
    new = lambda: sorted(r[0] for r in jobs.admit_new(spark, source, spark.range(1).schema, state).collect())
    assert new() == [0, 1, 2, 3, 4] and new() == []
    put(5, 7)
    assert new() == [5, 6] and new() == []


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    folder = tmp_path / "pages.parquet"
    spark.range(6).repartition(3).write.parquet(f"file://{folder}")
    part = next(folder.glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    new = lambda path: sorted(r[0] for r in jobs.admit_new(spark, f"file://{path}", spark.range(1).schema, fresh_folder(spark, "seen")).collect())
    assert new(folder) == list(range(6))
    assert new(tmp_path / "one.parquet") == sorted(r[0] for r in spark.read.parquet(f"file://{part}").collect())


def test_a_broken_write_leaves_the_old_version(spark, monkeypatch):
    store = Snapshots(spark, fresh_folder(spark, "snapshots"), "x int")
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    held = lambda: sorted(r[0] for r in store.current().collect())
    assert held() == [] and store.write(rows(1), "a") and store.write(rows(1, 2), "b") and not store.write(rows(9), "a")
    with pytest.raises(Exception):
        store.write(rows(7).withColumn("x", F.raise_error(F.lit("broken")).cast("int")), "c")
    assert held() == [1, 2]
    with monkeypatch.context() as broken:
        broken.setattr(store, "point", lambda *x: (_ for _ in ()).throw(OSError("no pointer")))
        with pytest.raises(OSError):
            store.write(rows(8), "c")
    assert held() == [1, 2] and sorted(r[0] for r in store.version(0).collect()) == [1] and store.version(5).count() == 0
    assert store.write(rows(3), "c") and held() == [3]
    with pytest.raises(RuntimeError):
        store.point(1, "x", "y")
    with pytest.raises(ValueError):
        store.write(rows(1), "a~b")


def test_progress_over_three_runs(spark):
    store = Snapshots(spark, fresh_folder(spark, "progress"), "town string, synced bigint, pending bigint, before bigint, delta bigint, stalled boolean")
    run = lambda *rows: sorted(map(tuple, progress(store, spark.createDataFrame(rows, "town string, synced bigint, pending bigint"), ["town"]).collect()))
    assert run(("a", 5, 3), ("b", 0, 0)) == [("a", 5, 3, None, None, False), ("b", 0, 0, None, None, False)]
    assert run(("a", 5, 3), ("b", 0, 0), ("c", 1, 9)) == [("a", 5, 3, 5, 0, True), ("b", 0, 0, 0, 0, False), ("c", 1, 9, None, None, False)]
    assert run(("a", 8, 0), ("c", 0, 9)) == [("a", 8, 0, 5, 3, False), ("c", 0, 9, 1, -1, True)]


def test_sessions_streamed_equal_the_batch(spark):
    queries = registry.queries()
    assert query_rows(queries["conversation_state_stream"](spark, str(DATA / "sf0.001"))) == query_rows(queries["conversation_state"](spark, str(DATA / "sf0.001")))


def test_sessions_fed_turn_by_turn(spark):
    """Each trigger brings one turn; the state goes on from there.  Golden turns: a vote on a boardwalk."""
    source, state = fresh_folder(spark, "turns"), fresh_folder(spark, "state")
    schema = "session_id bigint, pos bigint, role string, content string"
    said = [
        (1, 0, "user", "I have a question about the Constitution Park boardwalk vote by the Select Board on January 6, 2026 regarding ADA compliance."),
        (1, 1, "assistant", "The Planning Board and the Budget Committee met on the Brown property case."),
        (1, 2, "user", "What actions led to liability?"),
        (1, 3, "user", "How does this work statewide?"),
        (1, 4, "user", "There was a Planning Board meeting about the new subdivision vote by the Budget Committee on February 15."),
        (2, 0, "user", "Hello"),
    ]
    seen = {}
    for pos in range(5):
        spark.createDataFrame([r for r in said if r[1] == pos], schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        rows = situations(jobs.fold_situations(turn_facts(stream), state)).collect()
        seen = {(r["session_id"], r["pos"]): (r["title"], r["entities"]) for r in rows}
        assert len(rows) == sum(r[1] <= pos for r in said)
    first = seen[1, 0]
    assert first[0] and first[1] >= 2 and seen[2, 0] == (None, 0)
    assert seen[1, 1] == seen[1, 2] == seen[1, 3] == first
    assert seen[1, 4][1] > first[1]


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_folder(Session())
