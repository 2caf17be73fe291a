"""Listing, thread recall and the previous reply of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import text as T
from loamstone.operators.store import living
from loamstone.scale import latest_before, materialize


def list_newest(records: DataFrame, documents: DataFrame, limit: int | None, cfg: EngineConfig, now: float | None = None) -> DataFrame:
    """The newest standalone records and documents of the owner that are live at ``now``, by their ISO time.

    No limit or 0 means 20, a negative one means 1. Both sides are cut before they meet. Without a
    ``now`` the rows are taken as live.
    """
    n = max(1, limit or 20)
    records, documents = living(records, now), living(documents, now)
    singles = records.where((F.col("owner_id") == cfg.owner) & (F.col("parent_id") == ""))
    singles = singles.orderBy(F.desc_nulls_last("timestamp_epoch"), F.desc("id")).limit(n)
    whole = documents.where((F.col("owner_id") == cfg.owner) & F.col("content").isNotNull()).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    both = singles.select("id", "content", "timestamp", F.lit(0).alias("chunk_count"), F.lit(False).alias("is_doc")).unionByName(
        whole.select("id", "content", "timestamp", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(True).alias("is_doc"))
    )
    return both.orderBy(F.desc(F.coalesce("timestamp", F.lit(""))), "is_doc", F.desc("id")).limit(n)


def preview(listed: DataFrame) -> DataFrame:
    """Listed rows with their text as shown: fences omitted, documents cut to 200 characters."""
    body = T.purify(F.coalesce("content", F.lit("")))
    shown = F.when(F.col("is_doc") & (F.length(body) > 200), F.concat(F.substring(body, 1, 200), F.lit("…"))).otherwise(body)
    return listed.select("id", "is_doc", "chunk_count", F.substring(F.coalesce("timestamp", F.lit("")), 1, 19).alias("saved"), shown.alias("shown"))


def recall_rows(records: DataFrame, documents: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The owner's documents, and its records that are no piece of one of them."""
    docs = documents.where((F.col("owner_id") == cfg.owner) & F.col("content").isNotNull())
    own = records.where((F.col("owner_id") == cfg.owner) & F.col("content").isNotNull())
    free = own.join(docs.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    columns = ["id", "content", "turn_id", "timestamp_epoch"]
    return docs.select(*columns, F.lit(True).alias("is_doc")).unionByName(free.select(*columns, F.lit(False).alias("is_doc")))


def recall_thread(
    records: DataFrame, documents: DataFrame, turn_id: str, before: int = 2, after: int = 2, cfg: EngineConfig = EngineConfig(), now: float | None = None
) -> DataFrame:
    """The live rows from ``before`` ones ahead of a turn's first row to ``after`` ones behind its last, in time order.

    Rows between them that belong to other turns are part of the slice. Two bounded top-k scans find
    its ends, so nothing is numbered over the whole store, which is read once for narrow rows.
    """
    at = F.coalesce("timestamp_epoch", F.lit(0.0))
    rows = recall_rows(living(records, now), living(documents, now), cfg)
    rows = materialize(rows.select("id", "turn_id", "timestamp_epoch", "is_doc", at.alias("_at")), "thread")
    hits = rows.where(F.col("turn_id") == turn_id)
    edge = hits.agg(F.min(F.struct("_at", "id")).alias("a"), F.max(F.struct("_at", "id")).alias("b"))
    placed = rows.join(F.broadcast(edge), F.lit(True)).where("a is not null")  # one row
    key = F.struct("_at", "id")
    lead = placed.where(key < F.col("a")).orderBy(F.desc("_at"), F.desc("id")).limit(max(0, before))
    inner = placed.where((key >= F.col("a")) & (key <= F.col("b")))
    trail = placed.where(key > F.col("b")).orderBy("_at", "id").limit(max(0, after))
    return lead.unionByName(inner).unionByName(trail).select("id", "turn_id", "timestamp_epoch", "is_doc", (F.coalesce(F.col("turn_id") == turn_id, F.lit(False))).alias("is_hit"))


def _messages(records: DataFrame, *columns: str) -> DataFrame:
    rows = records.where((F.coalesce("session_id", F.lit("")) != "") & F.col("content").rlike(T.MESSAGE_PREFIX))
    return rows.select(*columns, F.regexp_extract("content", T.MESSAGE_PREFIX, 1).alias("role"))


def previous_replies(records: DataFrame) -> DataFrame:
    """For each user message the reply before it in its session: id, session_id, reply_id."""
    rows = _messages(records, "id", "session_id", "timestamp_epoch")
    told = latest_before(rows, "session_id", ["timestamp_epoch", "id"], F.when(F.col("role") == "claude", F.col("id")), "reply_id")
    return told.where("role = 'user'").select("id", "session_id", "reply_id")


def turn_handoff(records: DataFrame) -> DataFrame:
    """For each reply the turn of the latest prompt before it in its session: id, own_turn, prompt_turn."""
    rows = _messages(records, "id", "session_id", "turn_id", "timestamp_epoch")
    told = latest_before(rows, "session_id", ["timestamp_epoch", "id"], F.when(F.col("role") == "user", F.col("turn_id")), "prompt_turn")
    return told.where("role = 'claude'").select("id", F.col("turn_id").alias("own_turn"), "prompt_turn")
