"""Saving batches of calls: validation, exact duplicates, chunking and the rows to append.

A batch is judged in arrival order: of the calls with one guard the first not refused is saved, the
others are duplicates of it, and all are duplicates where a live guard is stored already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import chunk as C
from loamstone.functions import text as T
from loamstone.operators.store import live


@dataclass(frozen=True)
class Batch:
    """What a batch adds, and what became of each call."""

    statuses: DataFrame
    records: DataFrame
    documents: DataFrame
    guards: DataFrame


def judged(incoming: DataFrame, cfg: EngineConfig, now: float) -> DataFrame:
    """Each call with its cleaned body, stored text, guard key and the status it has by itself.

    The order of the checks is fixed: importance, owner, empty, invisible, code.
    """
    content = T.strip(F.coalesce("content", F.lit("")))
    importance = F.when(F.col("importance").isNull(), F.lit(1.0)).otherwise(T.importance(F.col("importance")))
    role = F.when(F.col("role").isin("user", "claude"), F.col("role"))
    session = F.when(F.coalesce(T.strip(F.col("session_id")), F.lit("")) != "", F.col("session_id")).otherwise(F.lit(cfg.default_session))
    rows = incoming.select(
        "arrival", content.alias("_content"), importance.alias("importance"), F.coalesce("owner_id", F.lit("")).alias("_owner"), role.alias("role"),
        F.coalesce("agent_name", F.lit("")).alias("agent_name"), session.alias("session_id"), F.coalesce("turn_id", F.lit("")).alias("turn_id"),
    )
    status = (
        F.when(F.col("importance").isNull(), F.lit("error: importance"))
        .when((F.col("_owner") != "") & (F.col("_owner") != cfg.owner), F.lit("error: owner"))
        .when(F.col("_content") == "", F.lit("error: empty"))
        .when(~T.has_visible(F.col("_content")), F.lit("error: invisible"))
    )
    if cfg.skip_code_blocks:
        status = status.when(F.col("_content").contains("```"), F.lit("skipped_code"))
    rows = rows.withColumn("status", status).withColumn("body", T.purify(F.col("_content")))
    rows = rows.withColumn("stored", T.prefixed(F.col("role"), F.col("body"))).withColumn("is_doc", F.length("body") > cfg.chunk_threshold)
    rows = rows.withColumn("_normal", T.nfkc(F.col("stored")))
    turn = F.when(F.col("role").isNotNull(), F.col("turn_id")).otherwise(F.lit(""))
    # Without a role the guard is never scoped to a turn, whatever the text starts with.
    key = F.when(F.col("status").isNull(), T.guard_key(F.col("stored"), F.col("_normal"), turn, F.col("is_doc")))
    return rows.withColumn("guard_key", key).drop("_content", "_owner", "_normal")


def resolved(calls: DataFrame, guards: DataFrame, now: float) -> DataFrame:
    """``judged`` calls with their final status and the first arrival of their guard.

    The first arrival comes from an aggregate by guard, so calls repeated without end combine on the
    map side and are never sorted together.
    """
    first = calls.where(F.col("guard_key").isNotNull()).groupBy("guard_key").agg(F.min("arrival").alias("_first"))
    held = guards.where(live(F.col("expires_at"), now)).select("guard_key", F.col("record_id").alias("existing_id"))
    known = first.join(held, "guard_key", "left")
    joined = calls.join(known, "guard_key", "left")
    status = F.coalesce("status", F.when(F.col("existing_id").isNotNull() | (F.col("arrival") > F.col("_first")), F.lit("duplicate")).otherwise(F.lit("saved")))
    return joined.withColumn("status", status)


def new_id() -> Column:
    """An id that follows from the arrival and text, so that a repeated batch writes the same rows."""
    return F.concat(F.lpad(F.hex("arrival"), 12, "0"), F.lit("-"), F.substring(F.sha1(F.encode("stored", "UTF-8")), 1, 12))


def ingest(incoming: DataFrame, guards: DataFrame, cfg: EngineConfig, now: float, embed=None) -> Batch:
    """Judge a batch and make the rows to append; ``embed`` maps a text column to vectors, None saves without."""
    calls = resolved(judged(incoming, cfg, now), guards, now)
    saved = calls.where("status = 'saved'").withColumn("id", new_id())
    expires = F.lit(float(now + cfg.ttl_seconds))
    common = [
        F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"), F.lit(float(now)).alias("timestamp_epoch"),
        F.lit(cfg.owner).alias("owner_id"), F.lit("").alias("local_id"), "agent_name", "session_id", "turn_id",
    ]
    pieces = saved.where("is_doc").withColumn("_pieces", C.chunks(F.col("body"), cfg.chunk_threshold, cfg.chunk_overlap))
    piece_id = lambda i: F.concat(F.col("id"), F.lit("-"), F.lpad((i + 1).cast("string"), 5, "0"))
    documents = pieces.select(
        "id", F.col("stored").alias("content"), *common, F.size("_pieces").alias("chunk_count"), F.transform("_pieces", lambda p: piece_id(p["no"])).alias("chunk_ids"), expires.alias("expires_at")
    )
    each = pieces.withColumn("_n", F.size("_pieces")).select("*", F.explode("_pieces").alias("_p"))
    label = F.when(F.col("_n") > 1, F.concat(F.lit("["), F.col("role"), F.lit(" "), (F.col("_p.no") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit("] "))).otherwise(F.concat(F.lit("["), F.col("role"), F.lit("] ")))
    text = F.when(F.col("role").isNotNull(), F.concat(label, F.col("_p.text"))).otherwise(F.col("_p.text"))
    tail = [F.col("importance"), F.lit(0).cast("bigint").alias("access_count")]
    chunk_rows = each.select(piece_id(F.col("_p.no")).alias("id"), text.alias("content"), *common, *tail, F.col("id").alias("parent_id"), expires.alias("expires_at"))
    short = saved.where(~F.col("is_doc")).select("id", F.col("stored").alias("content"), *common, *tail, F.lit("").alias("parent_id"), expires.alias("expires_at"))
    records = short.unionByName(chunk_rows)
    records = records.withColumn("embedding", embed(F.col("content")) if embed else F.lit(None).cast("array<float>"))
    return Batch(
        calls.select("arrival", "status", F.when(F.col("status") == "duplicate", F.col("existing_id")).alias("existing_id"), "is_doc", "guard_key"),
        records,
        documents,
        saved.select("guard_key", F.col("id").alias("record_id"), expires.alias("expires_at")),
    )
