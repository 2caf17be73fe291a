"""Hybrid search: fuse both legs, score, resolve documents, rerank, floor, order versions, cut, fill up.

Everything after the legs works on at most 200 candidates a search, so every window is partitioned
by search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import rank as R
from loamstone.functions import text as T
from loamstone.operators import scan, store
from loamstone.scale import materialize

RECORD_COLUMNS = ("id", "content", "timestamp_epoch", "owner_id", "session_id", "turn_id", "importance", "access_count", "parent_id", "expires_at", "embedding")


def fuse(nearest: DataFrame, matched: DataFrame) -> DataFrame:
    """query_id, id, real_cos, bm25, place: both legs' rows once, nearest first, then matches only."""
    a = nearest.select("query_id", "id", F.col("score").alias("_cos"), F.col("leg_rank").alias("_near"))
    b = matched.select("query_id", "id", F.col("score").alias("bm25"), F.col("leg_rank").alias("_match"))
    both = a.join(b, ["query_id", "id"], "full")
    return both.select(
        "query_id", "id", F.when(F.col("_near").isNotNull(), R.cos_from_distance(1.0 - F.col("_cos"))).alias("real_cos"), "bm25", F.coalesce("_near", F.col("_match") + 100000).alias("place")
    )


def candidates(fused: DataFrame, stored: DataFrame, asked: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Fused rows of the engine's owner with their record, search and keyword relevance.

    The owner is checked here, after each leg's top k: other owners' rows use up the budget. Records
    are read for the ids that were found, so only those are shuffled.
    """
    fused = materialize(fused, "fused")
    held = store.named(stored, fused, "arrived_at").select("id", "content", "timestamp_epoch", "owner_id", "session_id", "turn_id", "importance", "access_count", "parent_id")
    rows = fused.join(held, "id").where(F.col("owner_id") == cfg.owner)
    rows = rows.join(asked.select("query_id", "session", "now_epoch", "limit", F.col("asked"), F.col("normal").alias("_q"), F.col("tokens").alias("_qt")), "query_id")
    greatest = F.coalesce(F.max(F.abs("bm25")).over(W.partitionBy("query_id")), F.lit(0.0))
    relevance = F.when(F.col("bm25").isNull(), F.lit(0.0)).otherwise(R.keyword_relevance(F.col("bm25"), greatest, cfg.bm25_min_threshold))
    return rows.withColumn("kw", relevance)


def scored(rows: DataFrame, cos: Column, cfg: EngineConfig) -> DataFrame:
    base = R.base_score(cos, F.col("kw"))
    local = R.local_boost(F.col("importance"), F.col("access_count"), cfg)
    decay = R.time_decay(F.col("timestamp_epoch"), F.col("now_epoch"), cfg.half_life_days)
    return rows.withColumn("filter_score", base * local).withColumn(
        "score", base * decay * local * R.session_boost(F.col("session_id"), F.col("session"), cfg)
    )


def resolve(rows: DataFrame, docs: DataFrame, order: list[Column], cfg: EngineConfig) -> DataFrame:
    """Pieces of a stored document become that document, once: the first of each by ``order``.

    A document of another owner goes with all its pieces; a piece without a document stays.
    """
    parents = rows.where("parent_id <> ''").select(F.col("parent_id").alias("id"))
    held = store.named(docs, parents, "timestamp_epoch").select(
        F.col("id").alias("_doc_id"), F.col("content").alias("_doc_content"), F.col("owner_id").alias("_doc_owner"), F.col("turn_id").alias("_doc_turn"),
        F.col("timestamp_epoch").alias("_doc_at"), F.col("chunk_count").alias("_doc_count"), F.col("chunk_ids").alias("_doc_chunks"),
    ).where(F.col("_doc_content").isNotNull())
    joined = rows.join(held, (F.col("parent_id") != "") & (F.col("parent_id") == F.col("_doc_id")), "left")
    is_doc = F.col("_doc_id").isNotNull()
    first = F.row_number().over(W.partitionBy("query_id", F.coalesce("_doc_id", F.concat(F.lit("-"), F.col("id")))).orderBy(*order))
    kept = joined.withColumn("_first", first).where((F.col("_first") == 1) & (~is_doc | (F.col("_doc_owner") == cfg.owner)))
    return kept.select(
        *[c for c in rows.columns if c not in ("id", "content", "turn_id", "timestamp_epoch", "is_doc")],
        F.when(is_doc, F.col("id")).alias("chunk_id"),
        F.when(is_doc, F.col("_doc_id")).otherwise(F.col("id")).alias("id"),
        F.when(is_doc, F.col("_doc_content")).otherwise(F.col("content")).alias("content"),
        F.when(is_doc, F.col("_doc_turn")).otherwise(F.col("turn_id")).alias("turn_id"),
        F.when(is_doc, F.coalesce("_doc_at", "timestamp_epoch")).otherwise(F.col("timestamp_epoch")).alias("timestamp_epoch"),
        is_doc.alias("is_doc"),
        F.when(is_doc, F.coalesce("_doc_count", F.lit(0))).alias("chunk_count"),
        F.when(is_doc, F.col("_doc_chunks")).alias("chunk_ids"),
    )


def reranked(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Both scores with the lexical bonus of the whole (resolved) content."""
    if not cfg.lexical_rerank_enabled:
        return rows
    held = rows.withColumn("_n", T.nfkc(F.coalesce("content", F.lit(""))))
    held = held.withColumn("_ct", T.coverage_tokens(T.tokens(F.col("_n"))))
    bonus = R.rerank_bonus(F.col("_qt"), F.lower(T.strip(F.col("_q"))), F.col("_ct"), F.lower("_n"), cfg)
    return held.withColumn("_bonus", bonus).withColumn("score", F.col("score") + F.col("_bonus")).withColumn("filter_score", F.col("filter_score") + F.col("_bonus")).drop("_n", "_ct", "_bonus")


def _closure(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Groups of one search's rows (at most 200) whose vectors reach the threshold, numbered by least position."""
        pdf = pdf.sort_values("pos")
        vectors = np.array(pdf["vector"].to_list(), dtype=float)
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)
        close = np.round(vectors @ vectors.T / np.outer(norms, norms), 9) >= threshold
        label = np.arange(len(pdf))
        while True:
            least = np.where(close, label[None, :], len(pdf)).min(axis=1)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        sizes = np.bincount(label, minlength=len(pdf))
        number = {x: k + 1 for k, x in enumerate(sorted(x for x in set(label.tolist()) if sizes[x] > 1))}
        keep = sizes[label] > 1
        return pd.DataFrame({"query_id": pdf["query_id"][keep], "pos": pdf["pos"][keep], "version_group": [number[x] for x in label[keep]]})

    return run


def version_members(kept: DataFrame, stored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """query_id, pos, version_group: rows of a search that are versions of one content.

    A document is represented by its first piece; rows without a vector or with a short text take no part.
    """
    rep = F.when(F.col("is_doc"), F.get("chunk_ids", F.lit(0))).otherwise(F.col("id"))
    reps = kept.select("query_id", "pos", rep.alias("id"))
    vectors = stored.where(F.col("embedding").isNotNull() & (F.length("content") >= cfg.version_min_chars))
    order = [c for c in ("arrived_at",) if c in stored.columns]
    vectors = store.named(vectors.select("id", F.col("embedding").alias("vector"), *order), reps, *order)
    eligible = reps.join(vectors.select("id", "vector"), "id").select("query_id", "pos", "vector")
    return eligible.groupBy("query_id").applyInPandas(_closure(cfg.version_sim_threshold), "query_id string, pos int, version_group int")


def version_ordered(kept: DataFrame, stored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows of one version group exchange places so that the newest comes first; places keep their scores."""
    if not cfg.version_order_enabled:
        return kept.withColumn("version_group", F.lit(None).cast("int"))
    marked = kept.join(version_members(kept, stored, cfg), ["query_id", "pos"], "left")
    group = W.partitionBy("query_id", "version_group")
    marked = marked.withColumn("_slot", F.row_number().over(group.orderBy("pos")))
    marked = marked.withColumn("_age", F.row_number().over(group.orderBy(F.desc("timestamp_epoch"), F.desc("id"))))
    slots = marked.where(F.col("version_group").isNotNull()).select(
        "query_id", "version_group", F.col("_slot").alias("_age"), F.col("pos").alias("_p"), F.col("score").alias("_s"), F.col("filter_score").alias("_f")
    )
    moved = marked.join(slots, ["query_id", "version_group", "_age"], "left")
    return (
        moved.withColumn("pos", F.coalesce("_p", "pos"))
        .withColumn("score", F.coalesce("_s", "score"))
        .withColumn("filter_score", F.coalesce("_f", "filter_score"))
        .drop("_slot", "_age", "_p", "_s", "_f")
    )


def _final_order() -> list[Column]:
    return [F.desc("score"), F.desc("timestamp_epoch"), F.desc("id")]


def main_rows(cands: DataFrame, stored: DataFrame, docs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The kept rows of each search in final order (pos), before the relative cut and the limit."""
    near = F.coalesce(F.col("real_cos") >= cfg.vector_min_cos, F.lit(False))
    main = cands.where(near | F.col("bm25").isNotNull())
    main = scored(main, F.when(near, F.col("real_cos")).otherwise(F.lit(0.0)), cfg)
    main = reranked(resolve(main, docs, [F.desc("score"), F.asc("place")], cfg), cfg)
    kept = main.where(F.col("filter_score") >= cfg.min_score)
    kept = materialize(kept.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*_final_order()))), "kept")
    return version_ordered(kept, stored, cfg)


def cut(kept: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows near enough to the best of their search (versions always), within the search's limit."""
    if cfg.relative_min_score_ratio > 0:
        top = F.max("filter_score").over(W.partitionBy("query_id"))
        kept = kept.withColumn("_top", top).where(F.col("version_group").isNotNull() | (F.col("filter_score") >= F.col("_top") * cfg.relative_min_score_ratio)).drop("_top")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).where("rank <= limit")


def weak_rows(cands: DataFrame, docs: DataFrame, normal: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Weak matches that fill a search up to min_results rows, ranked on from its normal rows."""
    pool = scored(cands, F.coalesce("real_cos", F.lit(0.0)), cfg)
    order = [F.desc("filter_score"), F.desc("timestamp_epoch"), F.desc("id")]
    pool = reranked(resolve(pool, docs, order, cfg), cfg)
    counts = normal.groupBy("query_id").agg(F.count("*").cast("int").alias("_normal"))
    pool = pool.join(counts, "query_id", "left").withColumn("_normal", F.coalesce("_normal", F.lit(0)))
    pool = pool.where((F.col("filter_score") >= 1e-6) & (T.strip(F.col("asked")) != "")).join(normal.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    need = F.least(F.lit(cfg.min_results), F.col("limit")) - F.col("_normal")
    return pool.withColumn("_w", place).where(F.col("_w") <= need).withColumn("rank", (F.col("_w") + F.col("_normal")).cast("int")).drop("_w", "_normal")


RESULT = ("query_id", "rank", "weak", "id", "chunk_id", "is_doc", "chunk_count", "score", "filter_score", "version_group", "turn_id", "timestamp_epoch", "content")


def legs(stored: DataFrame, asked: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    return scan.knn(stored, asked), scan.bm25(stored, asked, cfg)


def search(stored: DataFrame, docs: DataFrame, asked: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Results of every search: normal rows first, then weak ones.

    ``stored`` and ``docs`` are rows as they lie (``store.deliveries``) or views of ``store``; ``asked``
    is ``store.searches``. Each leg scans the records once; what follows reads the ids it needs.
    """
    asked = materialize(asked, "searches")
    nearest, matched = legs(stored, asked, cfg)
    # Both legs are scanned once: the candidates (at most 200 a search) feed normal and weak rows alike.
    cands = materialize(candidates(fuse(nearest, matched), stored, asked, cfg), "candidates")
    normal = cut(main_rows(cands, stored, docs, cfg), cfg).withColumn("weak", F.lit(False))
    if cfg.min_results <= 0:
        return normal.select(*RESULT)
    normal = materialize(normal, "normal-rows")
    weak = weak_rows(cands, docs, normal, cfg).withColumn("weak", F.lit(True)).withColumn("version_group", F.lit(None).cast("int"))
    return normal.select(*RESULT).unionByName(weak.select(*RESULT))
