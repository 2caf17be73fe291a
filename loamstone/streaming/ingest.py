"""Structured Streaming: saving calls, guards that expire, and the hand-off of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamstone.config import EngineConfig
from loamstone.functions import text as T
from loamstone.operators import ingest
from loamstone.operators.store import live


def first_per_guard(stream: DataFrame, at: str, ttl_seconds: int, key: str = "guard_key") -> DataFrame:
    """The first row of each guard; a guard is forgotten once the watermark is its time to live past it."""
    return stream.withWatermark(at, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


def guarded(stream: DataFrame) -> DataFrame:
    """Calls with their guard key, from role, content and turn_id."""
    body = T.purify(T.strip(F.coalesce("content", F.lit(""))))
    stored = T.prefixed(F.when(F.col("role").isin("user", "claude"), F.col("role")), body)
    rows = stream.withColumn("stored", stored).withColumn("_normal", T.nfkc(F.col("stored")))
    return rows.withColumn("guard_key", T.guard_key(F.col("stored"), F.col("_normal"), F.col("turn_id"), F.lit(False))).drop("_normal")


COMPACT_EVERY = 16


def _known_guards(spark: SparkSession, store_dir: str, number: int) -> DataFrame:
    """The guards that earlier batches stored: those of the latest compaction, and of the batches since."""
    schema = "guard_key string, record_id string, expires_at double"
    empty = spark.createDataFrame([], schema)

    def part(folder: str, batches: list[int]) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{store_dir}/{folder}/batch={k}" for k in batches)) if batches else empty

    compacted = [k for k in _batches(spark, f"{store_dir}/guards_compacted") if k < number][-1:]
    since = [k for k in _batches(spark, f"{store_dir}/guards") if k < number and (not compacted or k > compacted[0])]
    return part("guards_compacted", compacted).unionByName(part("guards", since))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose write under ``folder`` was completed, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = [x.getPath() for x in system.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("batch=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def save_batches(stream: DataFrame, store_dir: str, cfg: EngineConfig, clock, checkpoint: str):
    """Save a stream of calls into ``store_dir``/{records, documents, guards, statuses}.

    Each micro-batch is judged against the live guards of earlier ones and writes to a folder of its
    own number, overwriting what an interrupted attempt left: a repeated batch changes nothing. Every
    sixteenth batch writes the guards that are still live together, so that a batch reads those and
    at most fifteen more, however long the stream runs. The checkpoint admits one writer at a time.
    ``clock`` gives the time of a batch from its number.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _known_guards(spark, store_dir, number).where(live(F.col("expires_at"), clock(number)))
        held = batch.persist()
        try:
            made = ingest.ingest(held, known, cfg, clock(number))
            for name in ("records", "documents", "statuses", "guards"):  # guards last: they make the rest count
                getattr(made, name).write.mode("overwrite").parquet(f"{store_dir}/{name}/batch={number}")
        finally:
            held.unpersist()
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            together = _known_guards(spark, store_dir, number + 1).where(live(F.col("expires_at"), clock(number)))
            together.write.mode("overwrite").parquet(f"{store_dir}/guards_compacted/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _hand_off(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The turn of a session's latest prompt is kept until it times out; replies take it over.

    A session's events of one micro-batch come in several Arrow batches in any order, so they are put
    together first: four narrow values an event, as many as the source admits to a micro-batch.
    """
    if state.hasTimedOut:
        state.remove()
        return
    turn = state.get[0] if state.exists else None
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["at", "event_id"])
    told = []
    for event, role, own in zip(pdf["event_id"], pdf["role"], pdf["turn_id"]):
        if role == "user":
            turn = own if own else f"turn-{event}"
        elif turn is None:
            turn = f"turn-{event}"
        told.append(turn)
    yield pd.DataFrame({"session_id": key[0], "event_id": pdf["event_id"].to_numpy(), "role": pdf["role"].to_numpy(), "turn_id": told})
    if turn is not None:
        state.update((turn,))
        latest = pdf["at"].max().value // 1_000_000
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 604800 * 1000)


def turns(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """session_id, event_id, role, turn_id of message events (session_id, event_id, role, turn_id, at).

    ``at`` is in seconds. A session's turn is forgotten once the watermark, ``late`` behind the latest
    event, is seven days past its last event. An event that comes later than that has no turn to take
    over and isn't told.
    """
    timed = stream.withColumn("at", F.timestamp_seconds("at")).withWatermark("at", late)
    return timed.groupBy("session_id").applyInPandasWithState(
        _hand_off, "session_id string, event_id bigint, role string, turn_id string", "turn string", "append", GroupStateTimeout.EventTimeTimeout
    )
