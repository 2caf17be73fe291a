"""Registered queries of the data-preparation operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import canon, copies, cutoff, fill, mix, near, split, tokens, turns
from loamstone.sources.tables import table

RECORD = ("id", "content", "parent_id")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Bodies above the limit whose stored pieces are no valid split: those that the operator had to split anew."""
    docs = table(spark, root, "doc_records", "id", "content", "chunk_count", "chunk_ids")
    return split.resplit(docs, table(spark, root, "mem_records", *RECORD)).where("origin = 'new'").select("id")


def p1_split(spark: SparkSession, root: str) -> DataFrame:
    return split.split_all(table(spark, root, "doc_records", "id", "content", "chunk_count", "chunk_ids"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "mem_records", *RECORD, "owner_id")
    members = copies.copy_members(records)
    return members.where("id <> representative").select(F.col("representative").alias("id_a"), F.col("id").alias("id_b"))


def p2_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return copies.collapsed(table(spark, root, "mem_records", *RECORD, "owner_id"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return canon.same_look_pairs(table(spark, root, "incoming", "arrival", "content"), "arrival")


def p3_incoming(spark: SparkSession, root: str) -> DataFrame:
    return canon.with_canonical(table(spark, root, "incoming", "arrival", "content")).select("arrival", "canonical")


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    return canon.with_canonical(table(spark, root, "mem_records", "id", "content").where("id IS NOT NULL").dropDuplicates(["id"])).select("id", "canonical")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return near.near_pairs(table(spark, root, "mem_records", *RECORD, "timestamp_epoch"))


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    return near.near_groups(table(spark, root, "mem_records", *RECORD, "timestamp_epoch"))


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "mem_records", *RECORD, "session_id", "turn_id", "timestamp_epoch")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return turns.session_verdicts(_messages(spark, root)).where("not kept").select("session_id")


def p5_conversations(spark: SparkSession, root: str) -> DataFrame:
    return turns.conversations(_messages(spark, root))


def _token_counts(spark: SparkSession, root: str) -> DataFrame:
    return tokens.with_tokens(table(spark, root, "documents", "doc_id", "source", "text"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return fill.fill_all(_token_counts(spark, root), "doc_id", table(spark, root, "container_sizes"))


def p6_strict(spark: SparkSession, root: str) -> DataFrame:
    """The containers where a batch never leaves its bucket."""
    return fill.fill_all(_token_counts(spark, root), "doc_id", table(spark, root, "container_sizes"), fill.FillRules(top_up=False))


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return fill.fill_report(p6_containers(spark, root))


def _mix(spark: SparkSession, root: str) -> DataFrame:
    items = _token_counts(spark, root).select(F.col("doc_id").alias("key"), "source", "tokens", F.unhex(F.md5("text")).alias("look"))
    return mix.mixed(items, table(spark, root, "mix_targets"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix.shares(_mix(spark, root), table(spark, root, "mix_targets"))


def _cut(spark: SparkSession, root: str) -> DataFrame:
    return cutoff.scored(table(spark, root, "documents", "doc_id", "text", "layout", "source"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _cut(spark, root).where("cut").select("doc_id")


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return cutoff.rates(_cut(spark, root))


def queries() -> dict:
    own = (
        p1_found, p1_split, p2_found, p2_collapsed, p3_found, p3_incoming, p3_records, p4_found, p4_groups, p5_found,
        p5_conversations, p6_containers, p6_strict, p6_report, p7_mix, p7_shares, p8_found, p8_rates,
    )
    return {f.__name__: f for f in own}
