"""Splitting oversized items."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm.split import SplitRules, best_split, boundaries, piece_starts, resplit, split_all, stored_split

DOC = "id string, content string, chunk_count int, chunk_ids array<string>, owner string"
REC = "id string, content string, parent_id string, chunk_count int"


def check(body, spans, rules):
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - rules.overlap <= c <= b < d
    for k, (a, b) in enumerate(spans):
        assert 0 < b - a <= rules.max_chars
        if k < len(spans) - 1 and body[b - 1].isalnum() and body[b].isalnum():
            assert not any(ch.isspace() for ch in body[max(a, b - 100) : b])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n.。é漢😀", min_size=1, max_size=1500))
def test_pieces_hold_the_body(body):
    rules = SplitRules()
    spans, _ = best_split(body, rules)
    check(body, spans, rules)
    assert stored_split(body, [body[a:b] for a, b in spans], rules) is not None


def test_least_cost_against_brute_force():
    rules = SplitRules(max_chars=14, overlap=4)
    draw = random.Random(3)
    for _ in range(20):
        body = "".join(draw.choice("ab  .\n") for _ in range(24))
        ends, penalty, natural = boundaries(body, rules)
        starts = piece_starts(ends, natural, rules.overlap)
        count = -(-(len(body) - rules.overlap) // (rules.max_chars - rules.overlap))
        target = min(rules.max_chars, (len(body) + (count - 1) * rules.overlap) / count)

        def least(i):
            if i == len(ends) - 1:
                return 0.0
            costs = [
                least(j) + penalty[j] + rules.per_piece + rules.imbalance * ((ends[j] - starts[i] - target) / target) ** 2
                for j in range(i + 1, len(ends))
                if ends[j] - starts[i] <= rules.max_chars
            ]
            return min(costs, default=float("inf"))

        assert best_split(body, rules)[1] == pytest.approx(least(0))


def test_natural_boundaries_come_first():
    body = ("word " * 60).strip() + ".\n\n" + ("more " * 60).strip() + "."
    spans, _ = best_split(body, SplitRules())
    assert body[: spans[0][1]].endswith("\n\n")


def test_stored_split_rules():
    rules = SplitRules()
    body = "one two " * 100
    good = [body[:400], body[304:700], body[600:]]
    assert stored_split(body, good, rules) is not None
    assert stored_split(body, good[:2], rules) is None
    assert stored_split(body, [body[:400], body[410:]], rules) is None
    assert stored_split(body, [body[:398], body[398:700], body[700:]], rules) is None  # inside a word
    assert stored_split("a" * 500, ["a" * 400, "a" * 100], rules) is not None
    assert stored_split("a" * 500, ["a" * 400, "a" * 350], rules) is None  # repeats too much


def test_rows(spark):
    body = "alpha beta. " * 60
    spans, _ = best_split(body, SplitRules())
    pieces = [body[a:b] for a, b in spans]
    n = len(pieces)
    ids = [f"p{k}" for k in range(n)]
    docs = spark.createDataFrame(
        [
            ("d1", "[user] " + body, n, ids, "x"),
            ("d1", "[user] " + body, n, ids, "x"),
            ("d2", body, n, ids, "x"),
            ("d3", body, None, None, None),
            ("d4", body, 0, [], None),
            ("d5", "short", 1, ["q"], None),
            ("d6", None, 1, ["q"], None),
            (None, body, 1, ["q"], None),
            ("d7", "漢" * 50000, 1, [None], None),
        ],
        DOC,
    )
    recs = spark.createDataFrame([(i, f"[user {k + 1}/{n}] {t}", "d1", 1) for k, (i, t) in enumerate(zip(ids, pieces))] * 2 + [(None, None, None, None)], REC)
    got = {r["id"]: r for r in resplit(docs, recs).collect()}
    assert {k: r["origin"] for k, r in got.items()} == {"d1": "stored", "d2": "new", "d3": "new", "d4": "new", "d7": "new"}
    for r in got.values():
        assert max(p["end"] - p["start"] for p in r["pieces"]) <= 400
    assert split_all(docs).where("id = 'd1'").count() == n
    assert split_all(docs.limit(0)).count() == 0 and resplit(docs.limit(0), recs.limit(0)).count() == 0


def test_bad_rules():
    with pytest.raises(ValueError):
        SplitRules(max_chars=10, overlap=10)
