"""Ranking functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.config import EngineConfig


def cos_from_distance(distance: Column) -> Column:
    """1 - distance within 0 .. 1; 0 where the distance is missing or NaN."""
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors within 0 .. 1; 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))


def keyword_relevance(score: Column, greatest: Column, threshold: float) -> Column:
    size = F.abs(F.coalesce(score, F.lit(0.0)))
    return F.when(size < threshold, F.lit(0.0)).otherwise(F.least(F.lit(1.0), size / F.greatest(F.lit(1.0), F.abs(F.coalesce(greatest, F.lit(0.0))))))


def _finite(x: Column) -> Column:
    """Whether a number is one: neither missing, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def time_decay(at: Column, now: Column, half_life_days: float) -> Column:
    days = F.greatest(F.lit(0.0), (now - at) / 86400.0)
    return F.when(_finite(at), F.pow(F.lit(2.0), -days / half_life_days)).otherwise(F.lit(1.0))


def local_boost(importance: Column, accesses: Column, cfg: EngineConfig) -> Column:
    own = F.when(_finite(importance), importance).otherwise(F.lit(1.0))
    if cfg.access_count_enabled:
        own = own + F.least(F.lit(cfg.access_count_max_boost), F.coalesce(accesses, F.lit(0)) * cfg.access_count_weight)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), own))


def session_boost(session: Column, effective: Column, cfg: EngineConfig) -> Column:
    same = (F.coalesce(effective, F.lit("")) != "") & (session == effective)
    return F.when(F.coalesce(same, F.lit(False)), F.lit(cfg.b_session_match)).otherwise(F.lit(cfg.b_session_mismatch))


def base_score(cos: Column, keyword: Column) -> Column:
    return cos * 0.7 + keyword * 0.3


def rerank_bonus(query_tokens: Column, query_text: Column, content_tokens: Column, content_text: Column, cfg: EngineConfig) -> Column:
    """Share of the query's tokens found, plus a bonus where the query itself occurs; short contents count less.

    ``query_text`` and ``content_text`` are normalized and lower-cased, ``query_text`` also stripped.
    """
    covered = F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, content_tokens)) / F.size(query_tokens)).otherwise(F.lit(0.0))
    phrase = F.when((query_text != "") & content_text.contains(query_text), F.lit(cfg.rerank_phrase_weight)).otherwise(F.lit(0.0))
    length = F.length(content_text)
    return (covered * cfg.rerank_weight + phrase) * F.when(length < 50, length / 50.0).otherwise(F.lit(1.0))
