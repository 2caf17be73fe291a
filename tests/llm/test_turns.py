"""Conversations from message rows."""

import random

from loamstone.llm.turns import ANSWERED, BAD, CLAUDE, IDENTITY, START, STEP, USER, compose, conversations, session_verdicts

REC = "id string, content string, parent_id string, session_id string, turn_id string, timestamp_epoch double, speaker string"


def frame(spark, rows):
    return spark.createDataFrame([(f"i{k}", *r, None) for k, r in enumerate(rows)], REC)


def kept(spark, rows):
    return {r["session_id"]: r["kept"] for r in session_verdicts(frame(spark, rows)).collect()}


def test_automaton_parts_compose():
    draw = random.Random(1)
    for _ in range(200):
        kinds = [draw.choice((USER, CLAUDE, BAD)) for _ in range(draw.randrange(6))]
        state = START
        for k in kinds:
            state = STEP[k][state]
        cut = draw.randrange(len(kinds) + 1)
        parts = []
        for some in (kinds[:cut], kinds[cut:]):
            f = IDENTITY
            for k in some:
                f = compose(f, STEP[k])
            parts.append(f)
        assert compose(*parts)[START] == state
        assert (state == ANSWERED) == (kinds == [USER, CLAUDE])


def test_cases(spark):
    u, c = "[user] hi", "[claude] yes"
    rows = [
        (u, None, "ok", "t", 1.0), (c, None, "ok", "t", 2.0), (c, "", "ok", "t", 3.0),
        (u, None, "noreply", "t", 1.0),
        (u, None, "order", "t", 2.0), (c, None, "order", "t", 1.0),
        (u, None, "tie", "t", 1.0), (c, None, "tie", "t", 1.0),
        (u, None, "turnless", None, 1.0), (c, None, "turnless", "t", 2.0),
        ("[user] ​ ", None, "empty", "t", 1.0), (c, None, "empty", "t", 2.0),
        (u, None, "two", "t", 1.0), ("[user] other", None, "two", "t", 1.5), (c, None, "two", "t", 2.0),
        (u, None, "parts", "t", 1.0), ("[claude 1/2] a b", "d1", "parts", "t", 2.0), ("[claude 2/2] b c", "d1", "parts", "t", 2.0),
        (u, None, "gap", "t", 1.0), ("[claude 1/3] a", "d2", "gap", "t", 2.0), ("[claude 3/3] c", "d2", "gap", "t", 2.0),
        ("fact", None, "facts", "t", 1.0), (None, None, "null", "t", 1.0), (u, None, "", "t", 1.0), (u, None, None, "t", 1.0),
        (u, None, "late", "t", None), (c, None, "late", "t", 2.0),
    ]
    want = {"ok": True, "noreply": False, "order": False, "tie": False, "turnless": False, "empty": False, "two": False, "parts": True, "gap": False, "late": False}
    assert kept(spark, rows) == want
    told = {(r["session_id"], r["speaker"]): r for r in conversations(frame(spark, rows)).collect()}
    assert set(told) == {("ok", "user"), ("ok", "claude"), ("parts", "user"), ("parts", "claude")}
    assert told["parts", "claude"]["content"] == "a b c"
    assert session_verdicts(frame(spark, rows).limit(0)).count() == 0 and conversations(frame(spark, rows).limit(0)).count() == 0


def test_hot_session_spans_partitions(spark):
    rows = []
    for t in range(1500):
        rows += [(f"[user] q{t}", None, "hot", f"t{t:05d}", 2.0 * t), (f"[claude] a{t}", None, "hot", f"t{t:05d}", 2.0 * t + 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert kept(spark, rows) == {"hot": True}
        assert kept(spark, [*rows, ("[user] again", None, "hot", "t00700", 9e9)]) == {"hot": False}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    turns = conversations(frame(spark, rows)).where("speaker = 'user'").orderBy("turn_no").collect()
    assert [r["turn_id"] for r in turns] == [f"t{t:05d}" for t in range(1500)]
