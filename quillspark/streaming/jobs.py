"""Structured Streaming jobs that end when their input does: a drained queue, windowed limits, new files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillspark.sources.sinks import shared_folder
from quillspark.sources.snapshots import Snapshots


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all input there is, into Parquet of the shared folder; return the rows."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    job = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def read_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """A file stream over a Parquet table, which may be one file or a folder of them.

    A stream takes a single file only by a pattern; ``[t]`` makes the name one that fits itself alone,
    and where it is a folder all files below are read.
    """
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[t]" if path.endswith(".parquet") else path)


def admit_new(spark: SparkSession, path: str, schema: StructType, state: str) -> DataFrame:
    """Rows of the files that no earlier run with the same ``state`` folder has seen, whatever became of them.

    The stream's checkpoint is the set of seen files: a second run over an unchanged folder admits
    nothing, and a file that is written again under its old name is not looked at again.  All rows that
    any run admitted stay in ``state``; what this run admitted is returned.
    """
    seen = f"{state}/rows"
    run = uuid.uuid4().hex
    stream = read_stream(spark, path, schema).withColumn("run", F.lit(run))
    job = stream.writeStream.format("parquet").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start(seen)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(seen).filter(F.col("run") == run).drop("run")


STALE = "INTERVAL 30 MINUTES"
QUEUE = "event_id bigint, status string, queued_at timestamp_ntz, claimed_at timestamp_ntz, attempts int"


class Queue:
    """A work queue kept as numbered snapshots of QUEUE.

    A step reads the current snapshot and writes the next one; the pointer moves when the step's rows are
    all written.  A step that carries a batch id which a snapshot already holds changes nothing, so a
    batch that is replayed after a crash is counted once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Snapshots(spark, folder, QUEUE)

    def rows(self) -> DataFrame:
        return self.store.current()

    def submit(self, ids: DataFrame, batch: str) -> None:
        """Queue the rows (event_id, queued_at) whose id is not in the queue, once each."""
        now = self.rows()
        fresh = ids.groupBy("event_id").agg(F.min("queued_at").alias("queued_at")).join(now.select("event_id"), "event_id", "left_anti")
        added = fresh.select("event_id", F.lit("queued").alias("status"), "queued_at", F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(0).alias("attempts"))
        self.store.write(now.unionByName(added), batch)

    def recover(self, clock: str, batch: str) -> None:
        """What has been processing since over 30 minutes before ``clock`` is queued again."""
        stale = (F.col("status") == "processing") & (F.col("claimed_at") < F.expr(f"TIMESTAMP_NTZ '{clock}' - {STALE}"))
        self.store.write(self.rows().select("event_id", F.when(stale, "queued").otherwise(F.col("status")).alias("status"), "queued_at", F.when(~stale, F.col("claimed_at")).alias("claimed_at"), "attempts"), batch)

    def claim(self, most: int | None, clock: str, batch: str) -> DataFrame:
        """The ids of the ``most`` rows that are queued longest (None: of all), which are processing from ``clock`` on.

        Rows without a time come last; ties go to the smaller id.  A replayed batch gets the ids that it had.
        """
        now = self.rows()
        taken, marked = F.col("status") == "queued", now
        if most is not None:
            chosen = now.filter(taken).orderBy(F.asc_nulls_last("queued_at"), "event_id").limit(most).select("event_id", F.lit(True).alias("chosen"))
            taken, marked = F.coalesce("chosen", F.lit(False)), now.join(chosen, "event_id", "left")
        marked = marked.select(
            "event_id",
            F.when(taken, "processing").otherwise(F.col("status")).alias("status"),
            "queued_at",
            F.when(taken, F.expr(f"TIMESTAMP_NTZ '{clock}'")).otherwise(F.col("claimed_at")).alias("claimed_at"),
            F.when(taken, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        )
        self.store.write(marked, batch)
        return self.rows().filter((F.col("status") == "processing") & (F.col("claimed_at") == F.expr(f"TIMESTAMP_NTZ '{clock}'"))).select("event_id")

    def complete(self, outcome: DataFrame, batch: str) -> None:
        """``outcome`` (event_id, outcome) ends rows that are processing; other rows are not touched."""
        ends = outcome.groupBy("event_id").agg(F.max("outcome").alias("outcome"))
        done = (F.col("status") == "processing") & F.col("outcome").isNotNull()
        self.store.write(self.rows().join(ends, "event_id", "left").select("event_id", F.when(done, F.col("outcome")).otherwise(F.col("status")).alias("status"), "queued_at", "claimed_at", "attempts"), batch)


def drain(spark: SparkSession, path: str, schema: StructType, work, folder: str, clock: str, only: str = "true", files_a_batch: int | None = None) -> DataFrame:
    """The queue after a file stream of submitted rows (event_id, ts) has been worked off, batch by batch.

    Each batch of the stream queues its rows that are ``only``, recovers what is stale, claims all that is queued,
    and ends it as ``work(claimed)`` says, which returns (event_id, outcome).  Every step carries the
    batch's number, so a batch that Spark hands over again changes nothing.
    """
    queue = Queue(spark, folder)

    def handle(rows: DataFrame, number: int) -> None:
        queue.submit(rows.filter(only).select("event_id", F.col("ts").cast("timestamp_ntz").alias("queued_at")), f"{number}-submit")
        queue.recover(clock, f"{number}-recover")
        claimed = queue.claim(None, clock, f"{number}-claim")
        queue.complete(work(claimed), f"{number}-complete")

    stream = read_stream(spark, path, schema, files_a_batch)
    job = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    job.awaitTermination()
    return queue.rows()


def rate_limits(spark: SparkSession, path: str, schema: StructType, limit: int = 2, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests a key and window, once the watermark has passed the window's end."""
    seen = read_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = seen.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(counted.select(F.col("w.start").alias("start"), "user_id", "n", (F.col("n") > limit).alias("limited")), "limits")


SAID = "session_id bigint, pos bigint, entities array<string>"
IDLE_MS = 24 * 3600 * 1000


class Situation(StatefulProcessor):
    """Folds the entities of a session's turns into what the session is about, and forgets idle sessions.

    Rows are (session_id, pos, role, x, found, lowered, moves, event): the entities found in the turn, as they
    are and in lower case, whether its role and words may move a situation, and whether it names an event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entities string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["pos", "role", "x"], kind="stable")
        held = json.loads(self.held.get()[0]) if self.held.exists() else None
        out = []
        for turn in turns.itertuples():
            found = list(zip(turn.found, turn.lowered))
            known = {low for _, low in held or ()}
            fresh = sum(low not in known for _, low in found)
            if turn.moves and held is None and len(found) >= 2:
                held = found
            elif turn.moves and held is not None and fresh >= 2 and turn.event:
                have = {e for e, _ in held}
                held = [*held, *(p for p in found if p[0] not in have)]
            out.append((key[0], turn.pos, None if held is None else [e for e, _ in held]))
        if held is not None:
            self.held.update((json.dumps(held),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        yield pd.DataFrame(out, columns=["session_id", "pos", "entities"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def fold_situations(turns: DataFrame, state: str) -> DataFrame:
    """The entities of each turn's situation, from a stream of rows that ``Situation`` reads.

    Turns of a session that one trigger brings are taken in order; those of later triggers go on from the
    state.  ``state`` keeps checkpoint and rows: a further run reads what is new and returns all rows.
    """
    spark = turns.sparkSession
    # A batch without data would only look for timers, and a run that ends with its input would wait for them.
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        folded = turns.groupBy("session_id").transformWithStateInPandas(Situation(), outputStructType=SAID, outputMode="append", timeMode="processingTime")
        job = folded.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start(f"{state}/rows")
        job.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(SAID).parquet(f"{state}/rows")
