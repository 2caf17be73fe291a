"""Views of the stored tables as the engine reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import text as T


def once(rows: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """One row per key, the first by ``order``: rows delivered twice are one record."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*(order or (key,))))
    return rows.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")


def deliveries(mem: DataFrame) -> DataFrame:
    """The rows of records as they lie, where one delivered twice is two rows: what a search scans."""
    return mem.where(F.col("id").isNotNull()).withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def named(rows: DataFrame, ids: DataFrame, *order: str) -> DataFrame:
    """The rows of ``ids`` (id), once each: only they are shuffled, the others stay where they lie."""
    few = rows.join(ids.select("id").where(F.col("id").isNotNull()).distinct(), "id", "left_semi")
    return once(few, "id", *(c for c in order if c in rows.columns))


def records(mem: DataFrame) -> DataFrame:
    return once(mem, "id", "arrived_at").withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def documents(docs: DataFrame) -> DataFrame:
    return once(docs, "id", "timestamp_epoch").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def live(expires: Column, now: Column | float) -> Column:
    """Whether a row's time to live has not elapsed; no expiry means it hasn't."""
    return F.coalesce(expires > now, F.lit(True))


def living(rows: DataFrame, now: float | None) -> DataFrame:
    """The rows that are live at ``now``; all where no time is given."""
    return rows if now is None else rows.where(live(F.col("expires_at"), now))


def indexed(stored: DataFrame) -> DataFrame:
    """Records with the tokens of both text fields, lower-cased."""
    held = stored.withColumn("_normal", T.nfkc(F.col("content")))
    held = held.withColumn("_folded", T.folded(F.col("_normal")))
    clean = T.signs_to_space(F.regexp_replace("_normal", r"[\x00-\x1f\x7f]", " "))
    words = F.regexp_extract_all(clean, F.lit(f"([^{T.SPACES}]+)"), F.lit(1))
    return held.select(
        "*",
        F.transform(words, F.lower).alias("content_tokens"),
        F.transform(T.ngrams(F.col("_normal"), F.col("_folded")), F.lower).alias("ngram_tokens"),
    ).drop("_normal", "_folded")


def searches(asked: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Searches with what both legs need.

    query_id, text (cut to the limit), normal, limit, k, session, since_epoch, until_epoch,
    now_epoch, tokens (lower-cased set), terms (for BM25), qvec.
    """
    limit = F.greatest(F.lit(1), F.coalesce("result_limit", F.lit(cfg.search_result_limit)))
    session = F.when(F.coalesce(T.strip(F.col("session_id")), F.lit("")) != "", F.col("session_id")).otherwise(F.lit(cfg.default_session))
    text = F.substring(F.coalesce("text", F.lit("")), 1, cfg.search_query_max_chars)
    base = asked.select(
        "query_id", F.coalesce("text", F.lit("")).alias("asked"), text.alias("text"), limit.alias("limit"), F.least(limit * 5, F.lit(100)).alias("k"), session.alias("session"), "since_epoch", "until_epoch", "now_epoch"
    )
    base = base.withColumn("normal", T.nfkc(F.col("text")))
    base = base.withColumn("_tokens", T.tokens(F.col("normal")))
    return base.select(
        "*",
        T.coverage_tokens(F.col("_tokens")).alias("tokens"),
        F.array_distinct(F.transform(T.query_terms(F.col("_tokens")), F.lower)).alias("terms"),
        T.hashed_vector(F.col("normal"), cfg.embedding_dim).alias("qvec"),
    ).drop("_tokens")
