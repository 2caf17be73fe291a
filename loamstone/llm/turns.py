"""Rebuilding conversations from message rows.

Message rows are combined into messages (pieces with one parent are one message, an equal text in
the same turn and role counts once), sorted by session, turn and time across the cluster, and read
in that order by a finite-state automaton. The automaton's step is a function on its few states, so
the steps of one turn compose; a range-sorted partition reduces each turn it sees to one composed
function, and a turn that spans partitions is composed from its parts. A session with a third of
all rows is thus spread over as many partitions as its rows fill.

Defined results: rows without a session or role prefix are no messages; a NULL turn, a turn that is
not exactly one user and one later claude message, a message without visible text and a message
with a missing piece break the session; rows of one id count once; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.scale import materialize, numbered

PREFIX = r"^\[(user|claude)(?: ([0-9]+)/([0-9]+))?\] "
VISIBLE = (
    r"[^\s\p{Cc}\p{Cf}\p{Zs}\p{Zl}\p{Zp}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]"
)

# States of the automaton over one turn, and the class of each message.
START, ASKED, ANSWERED, BROKEN = range(4)
USER, CLAUDE, BAD = range(3)
STEP = {
    USER: (ASKED, BROKEN, BROKEN, BROKEN),
    CLAUDE: (BROKEN, ANSWERED, BROKEN, BROKEN),
    BAD: (BROKEN, BROKEN, BROKEN, BROKEN),
}
IDENTITY = (START, ASKED, ANSWERED, BROKEN)


def compose(first: tuple[int, ...], then: tuple[int, ...]) -> tuple[int, ...]:
    """The state function of reading ``first``'s messages and then ``then``'s."""
    return tuple(then[state] for state in first)


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def pieces(records: DataFrame) -> DataFrame:
    """Each message row once: session_id, turn_id, role, message, part, parts, body, at."""
    rows = records.where(~_blank("session_id") & F.col("content").rlike(PREFIX)).select(
        "id", "session_id", F.when(_blank("turn_id"), None).otherwise(F.col("turn_id")).alias("turn_id"), "parent_id", "timestamp_epoch", "content"
    )
    part = F.regexp_extract("content", PREFIX, 2)
    split = part != ""
    body = F.regexp_replace("content", PREFIX, "")
    return rows.select(
        "id",
        "session_id",
        "turn_id",
        F.regexp_extract("content", PREFIX, 1).alias("role"),
        F.when(~_blank("parent_id"), F.concat(F.lit("p"), F.col("parent_id"))).when(split, F.concat(F.lit("i"), F.coalesce("id", F.lit("")))).otherwise(F.concat(F.lit("t"), F.md5(body))).alias("message"),
        F.when(split, part.try_cast("int")).otherwise(F.lit(1)).alias("part"),
        F.when(split, F.regexp_extract("content", PREFIX, 3).try_cast("int")).otherwise(F.lit(1)).alias("parts"),
        body.alias("body"),
        F.col("timestamp_epoch").alias("at"),
    )


def messages(records: DataFrame) -> DataFrame:
    """One row per message with what the automaton needs: its time, whether it shows, whether it is whole.

    All steps aggregate: rows to parts, parts to stored messages, equal texts of one turn and role to one.
    """
    key = ["session_id", "turn_id", "role", "message"]
    parts = pieces(records).groupBy(*key, "part", "parts").agg(
        F.min("at").alias("at"), F.max(F.col("body").rlike(VISIBLE)).alias("shows"), F.min(F.xxhash64("part", "body")).cast("decimal(38,0)").alias("mark"), F.min(F.xxhash64(F.lit("check"), "body", "part")).cast("decimal(38,0)").alias("check")
    )
    whole = parts.groupBy(*key).agg(
        F.min("at").alias("at"),
        F.max("shows").alias("shows"),
        F.min("parts").alias("least"),
        F.max("parts").alias("most"),
        F.countDistinct("part").alias("held"),
        F.min("part").alias("first"),
        F.max("part").alias("last"),
        F.concat_ws(" ", F.sum("mark").cast("string"), F.sum("check").cast("string")).alias("text"),  # two independent hashes
    )
    complete = (F.col("least") == F.col("most")) & (F.col("held") == F.col("most")) & (F.col("first") == 1) & (F.col("last") == F.col("most"))
    told = whole.select("session_id", "turn_id", "role", "text", "at", (F.col("shows") & F.coalesce(complete, F.lit(False))).alias("good"))
    return told.groupBy("session_id", "turn_id", "role", "text").agg(F.min("at").alias("at"), F.min("good").alias("good")).withColumnRenamed("text", "message")


def _scan(batches):
    """Reduce each turn of a sorted partition to one composed state function."""
    now, function, first = None, IDENTITY, None
    out: list[tuple] = []
    for pdf in batches:
        turns = pdf["turn_id"].where(pdf["turn_id"].notna(), None)
        for session, turn, role, good, at, place in zip(pdf["session_id"], turns, pdf["role"], pdf["good"], pdf["at"], pdf["place"]):
            if (session, turn) != now:
                if now is not None:
                    out.append((*now, first, *function))
                now, function, first = (session, turn), IDENTITY, place
            kind = BAD if turn is None or not good or pd.isna(at) else USER if role == "user" else CLAUDE
            function = compose(function, STEP[kind])
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "place", "f0", "f1", "f2", "f3"])
        out = []
    if now is not None:
        out.append((*now, first, *function))
    yield pd.DataFrame(out, columns=["session_id", "turn_id", "place", "f0", "f1", "f2", "f3"])


def turn_verdicts(records: DataFrame) -> DataFrame:
    """session_id, turn_id, whole: whether the automaton ends the turn in ANSWERED.

    A turn's parts meet again by place, the order of the range partitions; there is one part for
    each partition that the turn touches.
    """
    sorted_rows = (
        messages(records)
        .withColumn("_last", F.col("role") == "user")
        .repartitionByRange("session_id", "turn_id", "at", "_last", "message")
        .sortWithinPartitions("session_id", "turn_id", "at", "_last", "message")
        .select("session_id", "turn_id", "role", "good", "at", F.monotonically_increasing_id().alias("place"))
    )
    scanned = sorted_rows.mapInPandas(_scan, "session_id string, turn_id string, place bigint, f0 int, f1 int, f2 int, f3 int")
    functions = F.array_sort(F.collect_list(F.struct("place", F.array("f0", "f1", "f2", "f3").alias("f"))))
    final = F.aggregate(functions, F.lit(START), lambda state, x: F.get(x["f"], state))
    return scanned.groupBy("session_id", "turn_id").agg(final.alias("state")).select("session_id", "turn_id", (F.col("state") == ANSWERED).alias("whole"))


def session_verdicts(records: DataFrame) -> DataFrame:
    """session_id, turns, kept for every session with messages."""
    return turn_verdicts(records).groupBy("session_id").agg(F.count("*").alias("turns"), F.min("whole").alias("kept"))


def _stitch(parts: pd.Series) -> pd.Series:
    """Join ordered pieces, each without what it repeats of the text so far (at most 100 characters)."""

    def one(rows) -> str:
        text = ""
        for row in rows:
            piece = row["body"]
            repeat = next((k for k in range(min(100, len(text), len(piece)), 0, -1) if text.endswith(piece[:k])), 0)
            text += piece[repeat:]
        return text

    return parts.map(one)


def conversations(records: DataFrame) -> DataFrame:
    """The kept sessions, one row per message: session_id, turn_no, turn_id, speaker, content, at.

    Turns are numbered by their prompt's time. Kept turns hold two messages, and what is gathered in
    one place are the pieces of one message; a session's turns are numbered by range.
    """
    stitch = F.pandas_udf(_stitch, "string")
    kept = session_verdicts(records).where("kept").select("session_id")
    held = materialize(pieces(records).join(kept, "session_id", "left_semi"), "kept-messages")
    parts = held.groupBy("session_id", "turn_id", "role", "message", "part").agg(F.min("at").alias("at"), F.min("body").alias("body"))
    whole = parts.groupBy("session_id", "turn_id", "role", "message").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("part", "body"))).alias("_parts")
    )
    text = F.when(F.size("_parts") == 1, F.col("_parts")[0]["body"]).otherwise(stitch("_parts"))
    done = whole.select("session_id", "turn_id", "role", "at", text.alias("content"))
    turns = done.where("role = 'user'").select("session_id", "turn_id", "at")
    turns = numbered(turns, ["session_id"], ["at", "turn_id"], "turn_no").drop("at")
    return done.join(turns, ["session_id", "turn_id"]).select(
        "session_id", "turn_no", "turn_id", F.col("role").alias("speaker"), "content", F.col("at").alias("timestamp_epoch")
    )
