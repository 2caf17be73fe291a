"""Changes of the store, each from one snapshot to the next.

There is no update in place: an operation returns the rows that remain or change, and a writer
replaces the snapshot. Each operation is keyed joins over the snapshot, without a driver-side loop.
Given the time, an operation sees and leaves live rows only: what has expired is gone, not revived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import text as T
from loamstone.operators.search import search
from loamstone.operators.store import living
from loamstone.scale import materialize


@dataclass(frozen=True)
class Snapshot:
    records: DataFrame
    documents: DataFrame
    guards: DataFrame


def expire(store: Snapshot, now: float | None) -> Snapshot:
    """Without the rows whose time to live has elapsed; all rows where no time is given."""
    return Snapshot(*(living(t, now) for t in (store.records, store.documents, store.guards)))


def stored_guards(rows: DataFrame, is_doc: bool) -> DataFrame:
    """id, guard_key of stored texts (turn-scoped by the text's own prefix)."""
    normal = rows.withColumn("_normal", T.nfkc(F.col("content")))
    return normal.select("id", T.guard_key(F.col("content"), F.col("_normal"), F.col("turn_id"), F.lit(is_doc)).alias("guard_key"))


def refresh(store: Snapshot, hits: DataFrame, cfg: EngineConfig, now: float) -> Snapshot:
    """Extend the hits' life by the full time to live and count the access.

    ``hits``: id, is_doc, chunk_id of results. Where they have ``weak`` or ``rank`` (as a search
    returns them), weak rows and those below the first ``ttl_refresh_top_k`` of a search are left as
    they are. A document takes its pieces and the piece that hit along; only the hit itself counts;
    its guard, and that of a standalone record, is set again. Rows that have expired stay away.
    """
    store = expire(store, now)
    if "weak" in hits.columns:
        hits = hits.where(~F.col("weak"))
    if "rank" in hits.columns:
        hits = hits.where(F.col("rank") <= cfg.ttl_refresh_top_k)
    top = hits.select("id", "is_doc", "chunk_id").distinct()
    docs_hit = store.documents.join(top.where("is_doc").select("id").distinct(), "id", "left_semi")
    singles = store.records.join(top.where(~F.col("is_doc")).select("id").distinct(), "id", "left_semi")
    keys = (
        top.where(~F.col("is_doc")).select("id")
        .unionByName(top.where("is_doc").select(F.col("chunk_id").alias("id")))
        .unionByName(docs_hit.select(F.explode("chunk_ids").alias("id")))
        .distinct()
    )
    counted = hits.select(F.coalesce("chunk_id", "id").alias("id")).groupBy("id").agg(F.count("*").alias("_hits"))
    until = F.lit(float(now + cfg.ttl_seconds))
    records = store.records.join(keys.withColumn("_hit", F.lit(True)), "id", "left").join(counted, "id", "left")
    records = records.withColumn("expires_at", F.when(F.col("_hit"), until).otherwise(F.col("expires_at")))
    records = records.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).select(*store.records.columns)
    documents = store.documents.join(docs_hit.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    documents = documents.withColumn("expires_at", F.when(F.col("_hit"), until).otherwise(F.col("expires_at"))).select(*store.documents.columns)
    renewed = stored_guards(docs_hit, True).unionByName(stored_guards(singles.where("parent_id = ''"), False))
    renewed = renewed.groupBy("guard_key").agg(F.min("id").alias("record_id")).withColumn("expires_at", until)
    guards = store.guards.join(renewed.select("guard_key"), "guard_key", "left_anti").unionByName(renewed)
    return Snapshot(records, documents, guards)


def search_then_refresh(store: Snapshot, asked: DataFrame, cfg: EngineConfig, now: float) -> tuple[DataFrame, Snapshot]:
    """The results of a batch of searches, and the snapshot in which their first normal rows live on."""
    found = materialize(search(store.records, store.documents, asked, cfg), "results")
    return found, refresh(store, found, cfg, now) if cfg.ttl_refresh_on_search else store


def _without_guards(guards: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the guards of deleted rows (id, guard_key) that name that row or none."""
    dead = gone.select("guard_key", F.col("id").alias("_gone"))
    owned = guards.join(dead, "guard_key").where((F.coalesce("record_id", F.lit("")) == "") | (F.col("record_id") == F.col("_gone"))).select("guard_key").distinct()
    return guards.join(owned, "guard_key", "left_anti")


def delete(store: Snapshot, ids: DataFrame, cfg: EngineConfig, now: float | None = None) -> tuple[Snapshot, DataFrame]:
    """Delete records and documents (with all their pieces) by id; also status and pieces per id.

    ``ids``: id, where a leading ``doc:`` or ``mem:`` is dropped. Another owner's rows are not found.
    """
    store = expire(store, now)
    asked = ids.select(F.regexp_replace(F.trim("id"), "^(doc|mem):", "").alias("id")).distinct()
    docs = store.documents.join(asked, "id", "left_semi").where(F.col("owner_id") == cfg.owner)
    named = docs.where(F.size("chunk_ids") > 0).select(F.col("id").alias("doc"), F.explode("chunk_ids").alias("id"))
    linked = store.records.join(docs.where(F.size("chunk_ids") <= 0).select(F.col("id").alias("parent_id")), "parent_id").select(F.col("parent_id").alias("doc"), "id")
    pieces = named.unionByName(linked).distinct()
    taken = store.documents.select("id")
    singles = store.records.join(asked, "id", "left_semi").join(taken, "id", "left_anti").where(F.col("owner_id") == cfg.owner)
    gone = pieces.select("id").unionByName(singles.select("id")).distinct()
    held = pieces.join(store.records.select("id"), "id", "left_semi").groupBy("doc").agg(F.count("*").alias("chunks"))
    found = docs.select("id").withColumn("status", F.lit("deleted")).join(held.withColumnRenamed("doc", "id"), "id", "left")
    found = found.unionByName(singles.select("id").withColumn("status", F.lit("deleted")).withColumn("chunks", F.lit(None).cast("bigint")))
    report = asked.join(found, "id", "left").select("id", F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    dead = stored_guards(docs, True).unionByName(stored_guards(singles.where("parent_id = ''"), False))
    after = Snapshot(
        store.records.join(gone, "id", "left_anti"), store.documents.join(docs.select("id"), "id", "left_anti"), _without_guards(store.guards, dead)
    )
    return after, report


def delete_session(store: Snapshot, sessions: DataFrame, cfg: EngineConfig, now: float | None = None) -> tuple[Snapshot, DataFrame]:
    """Delete everything labelled with the sessions; also the four counts per session.

    A document goes with all its pieces, whatever their label. A piece labelled with the session
    whose document stays is left alone; an orphan piece counts as a piece.
    """
    store = expire(store, now)
    asked = sessions.select("session_id").where(T.strip(F.col("session_id")) != "").distinct()
    own = store.records.where(F.col("owner_id") == cfg.owner)
    docs = store.documents.where(F.col("owner_id") == cfg.owner).join(asked, "session_id", "left_semi")
    named = docs.select("session_id", F.explode("chunk_ids").alias("id"))
    linked = own.select("id", "parent_id").join(docs.select("session_id", F.col("id").alias("parent_id")), "parent_id").select("session_id", "id")
    pieces = named.unionByName(linked).distinct().join(store.records.select("id"), "id", "left_semi")
    pieces = pieces.groupBy("id").agg(F.min("session_id").alias("session_id"))
    labelled = own.join(asked, "session_id", "left_semi")
    orphans = labelled.where("parent_id <> ''").join(store.documents.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    orphans = orphans.select("session_id", "id").join(pieces.select("id"), "id", "left_anti")
    singles = labelled.where("parent_id = ''").join(pieces.select("id"), "id", "left_anti")
    counted = (
        docs.select("session_id", F.lit("document").alias("_kind"))
        .unionByName(pieces.select("session_id", F.lit("chunk").alias("_kind")))
        .unionByName(orphans.select("session_id", F.lit("chunk").alias("_kind")))
        .unionByName(singles.select("session_id", F.lit("single").alias("_kind")))
    )
    counts = counted.groupBy("session_id").agg(
        F.count_if(F.col("_kind") == "document").alias("documents_deleted"),
        F.count_if(F.col("_kind") == "chunk").alias("chunks_deleted"),
        F.count_if(F.col("_kind") == "single").alias("singles_deleted"),
        F.count("*").alias("deleted"),
    )
    report = asked.join(counts, "session_id", "left").fillna(0)
    gone = pieces.select("id").unionByName(orphans.select("id")).unionByName(singles.select("id")).distinct()
    dead = stored_guards(docs, True).unionByName(stored_guards(singles, False))
    after = Snapshot(
        store.records.join(gone, "id", "left_anti"), store.documents.join(docs.select("id"), "id", "left_anti"), _without_guards(store.guards, dead)
    )
    return after, report


def missing_vectors(records: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The owner's records without a vector."""
    return records.where((F.col("owner_id") == cfg.owner) & F.col("embedding").isNull() & F.col("content").isNotNull())


def repair(store: Snapshot, embed, cfg: EngineConfig, now: float | None = None) -> tuple[Snapshot, DataFrame]:
    """Embed up to a batch of the records that lack a vector, oldest ids first; also reembedded and remaining."""
    store = expire(store, now)
    lacking = missing_vectors(store.records, cfg)
    chosen = lacking.select("id").orderBy("id").limit(cfg.repair_batch if embed else 0)
    done = store.records.join(chosen, "id", "left_semi").select("id", (embed(F.col("content")) if embed else F.lit(None).cast("array<float>")).alias("_new"))
    records = store.records.join(done, "id", "left").withColumn("embedding", F.coalesce("embedding", F.col("_new").cast("array<float>"))).drop("_new")
    report = lacking.agg(F.count("*").alias("_all")).select(
        F.least(F.col("_all"), F.lit(cfg.repair_batch if embed else 0)).cast("bigint").alias("reembedded"),
        F.greatest(F.col("_all") - (cfg.repair_batch if embed else 0), F.lit(0)).cast("bigint").alias("remaining"),
    )
    return Snapshot(records, store.documents, store.guards), report
