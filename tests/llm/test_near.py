"""Near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from loamstone.llm import near
from loamstone.llm.near import NearRules, near_groups, near_pairs, search_forest

REC = "id string, content string, parent_id string, timestamp_epoch double, cls string"


def brute(rows, rules):
    held = {}
    for i, text, parent, at, _ in rows:
        if i is not None and text is not None and at is not None and not parent and len(text) >= rules.min_chars:
            held[i] = (set(re.findall(r"[^\W_]+", text.lower())), at)
    out = set()
    ids = sorted(held)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, s), (y, t) = held[a], held[b]
            if x and y and abs(s - t) <= rules.window_seconds and len(x & y) >= rules.threshold * len(x | y) - 1e-9:
                out.add((a, b))
    return out


def made(seed, n, vocabulary=60):
    draw = random.Random(seed)
    words = [f"word{k}" for k in range(vocabulary)]
    base = [[draw.choice(words) for _ in range(draw.randint(14, 40))] for _ in range(12)]
    rows = []
    for k in range(n):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = draw.choice([*words, f"rare{draw.randrange(1000)}"])
        draw.shuffle(text)
        rows.append((f"r{k:04d}", " ".join(text), "", draw.random() * 2e6, "x"))
    return rows


@pytest.mark.parametrize("rules", [NearRules(), NearRules(rare=2, rare_share=1e-9), NearRules(rare=10**9), NearRules(block_rows=16, members_per_salt=3, rare=8), NearRules(block_rows=40, rare=8, max_keys=40)])
def test_pairs_equal_brute_force(spark, rules):
    rows = made(1, 220)
    rows += [("c1", rows[0][1], None, 5.0, None), ("c2", rows[0][1], None, 6.0, None), ("c2", rows[0][1], None, 6.0, None)]
    rows += [("n1", None, None, 1.0, None), ("n2", "x" * 50, None, 1.0, None), ("n3", rows[0][1], "d", 1.0, None), ("n4", rows[0][1], None, None, None), (None, rows[0][1], None, 1.0, None), ("n5", "." * 200, None, 1.0, None), ("n6", "", None, 1.0, None)]
    df = spark.createDataFrame(rows, REC)
    got = near_pairs(df, rules).collect()
    want = brute(rows, rules)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_keys_are_bounded_and_do_not_grow_with_the_collection():
    """Shares of a vocabulary stay as they are when all counts grow, and so do a set's keys."""
    draw = random.Random(3)
    rules = NearRules()
    for n, most in ((30, 512), (48, 1024), (60, 1024), (120, 512), (400, 81)):
        words = np.array(sorted(draw.sample(range(2**62), n)), dtype=np.uint64)
        for share in (1e-6, 1e-3, 1e-2, 0.3):
            shares = np.full(n, share)
            small, large = (len(near.shard_keys(words, shares, max(rules.rare / total, rules.rare_share), rules)) for total in (1e6, 1e8))
            assert small == large <= most


def test_partners_share_a_key_whatever_their_sizes():
    draw = random.Random(4)
    for max_keys in (20, 200, 512):
        rules = NearRules(max_keys=max_keys)
        for n in (5, 9, 21, 39, 40, 50, 64, 65, 90, 155, 170):
            words = draw.sample(range(2**62), n)
            share = {w: draw.choice((1e-5, 0.01, 0.2, 0.5)) for w in words}
            lost = draw.sample(words, n // 5)
            both = [np.array(sorted(x), dtype=np.uint64) for x in (words, set(words) - set(lost))]
            keys = [set(near.shard_keys(w, np.array([share[int(x)] for x in w]), rules.rare_share, rules)) for w in both]
            assert keys[0] & keys[1]


def test_groups_are_the_components(spark):
    rules = NearRules()
    rows = made(2, 150)
    df = spark.createDataFrame(rows, REC)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = brute(rows, rules)
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for x in {i for p in pairs for i in p}}
    got = {r["id"]: r for r in near_groups(df, rules).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == want
    at = {r[0]: r[3] for r in rows}
    for r in got.values():
        own = [i for i, g in want.items() if g == r["group_id"]]
        assert r["newest_id"] == max(own, key=lambda i: (at[i], i)) and r["members"] == len(own)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], REC)
    assert near_pairs(df).count() == 0 and near_groups(df).count() == 0
    text = " ".join(f"w{k}" for k in range(20000))
    df = spark.createDataFrame([("a", text, None, 1.0, None), ("b", text + " end", None, 2.0, None)], REC)
    assert [tuple(r) for r in near_pairs(df).collect()] == [("a", "b")]


def test_forest_drops_no_pair():
    rules = NearRules()
    draw = np.random.default_rng(5)
    words = [np.unique(draw.integers(0, 2**63, 30).astype(np.uint64)) for _ in range(8)]
    sets = []
    for _ in range(400):
        w = words[draw.integers(0, 8)].copy()
        w[draw.integers(0, len(w), 3)] = draw.integers(0, 2**63, 3).astype(np.uint64)
        sets.append(np.unique(w))
    sizes = np.array([len(s) for s in sets])
    at = draw.random(400) * 1e6
    segment = np.sort(draw.integers(0, 3, 400))
    maps = np.array([near.bitmap(s) for s in sets])
    got = set()
    for i, j in search_forest(segment, maps, sizes, at, at, rules):
        got |= set(zip(i.tolist(), j.tolist()))
    for i in range(400):
        for j in range(i + 1, 400):
            n = len(np.intersect1d(sets[i], sets[j]))
            if segment[i] == segment[j] and abs(at[i] - at[j]) <= rules.window_seconds and n >= 0.8 * (sizes[i] + sizes[j] - n):
                assert (i, j) in got
