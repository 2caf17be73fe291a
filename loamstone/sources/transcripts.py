"""Conversation transcripts: JSON lines, newest last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Prompts that no person wrote.
SYSTEM_STARTS = ("[Request interrupted by user", "<command-", "<local-command-", "<task-notification>", "<agent-message from=", "<system-reminder>")
LINE = "struct<type:string,isMeta:boolean,isSidechain:boolean,message:struct<content:string>>"
PARTS = "array<struct<type:string,text:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of every transcript under ``path``.

    Files are split and read line by line; a line's number is its place in the file (block, then line),
    which grows along the file without being counted from its start.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_row"))
    return lines.where(F.trim("line") != "").select("path", F.struct("_block", "_row").alias("line_no"), "line")


def last_replies(lines: DataFrame, current_prompt: str | None = None) -> DataFrame:
    """path, reply: the text of the newest assistant line that no older real prompt hides.

    Lines that are no JSON, side chains, meta lines and system prompts are skipped. The current
    prompt is skipped only where it is the newest message. A real prompt stops the search: only
    replies after the last one count.
    """
    row = F.from_json("line", LINE)
    parsed = lines.select("path", "line_no", row.alias("r")).where(F.col("r.type").isin("user", "assistant") & ~F.coalesce("r.isSidechain", F.lit(False)))
    content = F.col("r.message.content")
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    is_list = F.ltrim(content).startswith("[") & parts.isNotNull()
    user_text = F.when(is_list, F.when(F.size(texts) > 0, F.array_join(texts, "\n"))).otherwise(content)
    shown = F.filter(texts, lambda t: F.trim(t) != "")
    reply = F.when(is_list, F.when(F.size(shown) > 0, F.element_at(shown, -1))).when(F.trim(content) != "", content)
    rows = parsed.select("path", "line_no", F.col("r.type").alias("type"), F.coalesce("r.isMeta", F.lit(False)).alias("meta"), user_text.alias("user_text"), reply.alias("reply"))
    system = F.lit(False)
    for start in SYSTEM_STARTS:
        system = system | F.col("user_text").startswith(start)
    is_prompt = (F.col("type") == "user") & ~F.col("meta") & F.col("user_text").isNotNull() & ~F.coalesce(system, F.lit(False))
    rows = rows.withColumn("prompt", F.coalesce(is_prompt, F.lit(False))).where((F.col("type") == "assistant") | F.col("prompt"))
    if current_prompt is not None:
        newest = rows.groupBy("path").agg(F.max("line_no").alias("_newest"))  # combined where the lines lie
        rows = rows.join(newest, "path").where(~(F.col("prompt") & (F.col("line_no") == F.col("_newest")) & (F.trim("user_text") == F.lit(current_prompt.strip()))))
    per = rows.groupBy("path").agg(
        F.max(F.when(F.col("prompt"), F.col("line_no"))).alias("stop"), F.max(F.when(F.col("reply").isNotNull() & ~F.col("prompt"), F.struct("line_no", "reply"))).alias("best")
    )
    return per.select("path", F.when(F.col("stop").isNull() | (F.col("best.line_no") > F.col("stop")), F.col("best.reply")).alias("reply"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON lines log."""
    rows.write.mode("append").json(path)
