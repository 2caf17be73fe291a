"""Containers, mixes and cut texts."""

import itertools
import os
import random

import numpy as np
import pytest

from loamstone.llm import cutoff, fill, mix, tokens

NO_VOCABULARY = not os.path.exists(tokens.DEFAULT_VOCABULARY)


def test_bounds_are_optimal():
    draw = random.Random(1)
    for _ in range(10):
        histogram = np.zeros(13, dtype=np.int64)
        for _ in range(30):
            histogram[draw.randint(1, 12)] += 1
        sizes = np.flatnonzero(histogram)

        def padding(bounds):
            at = np.searchsorted(bounds, sizes)
            return sum(int(histogram[s]) * int(bounds[a] - s) for s, a in zip(sizes, at))

        got = fill.bucket_bounds(histogram, 4)
        best = min(padding(np.array([*some, sizes[-1]])) for some in itertools.combinations(sizes[:-1], min(3, len(sizes) - 1)))
        assert got[-1] == sizes[-1] and len(got) <= 4 and padding(got) == best


def test_bounds_of_a_long_histogram():
    """Against the plain program over all pairs of sizes."""
    draw = np.random.default_rng(3)
    histogram = draw.integers(0, 50, 400)
    sizes = np.flatnonzero(histogram)
    count = histogram[sizes]
    c, w = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * sizes)))
    best = np.array([sizes[j] * c[j + 1] - w[j + 1] for j in range(len(sizes))])
    for _ in range(24):
        best = np.array([min([best[j], *(best[i - 1] + sizes[j] * (c[j + 1] - c[i]) - (w[j + 1] - w[i]) for i in range(1, j + 1))]) for j in range(len(sizes))])
    bounds = fill.bucket_bounds(histogram, 25)
    at = np.searchsorted(bounds, sizes)
    assert len(bounds) <= 25 and int((count * (bounds[at] - sizes)).sum()) == best[-1]


def test_strict_batches_stay_in_their_bucket(spark):
    items = spark.createDataFrame([(k, 1 + k % 60) for k in range(600)], "doc_id bigint, tokens bigint")
    rules = fill.FillRules(buckets=5, top_up=False)
    got = fill.fill(items, "doc_id", 64, rules).toPandas()
    histogram = np.bincount(got["size"])
    bucket = np.searchsorted(fill.bucket_bounds(histogram, 5), got["size"])
    assert got.assign(bucket=bucket).groupby("container")["bucket"].nunique().max() == 1 and got.groupby("container")["size"].sum().max() <= 64


def test_fill(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice((0, 3, 40, 64, 65, 130, 7, 33, 50)), "x") for k in range(3000)] + [(9999, None, None), (5, 10, None), (5, 10, None)]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container string")
    got = fill.fill(items, "doc_id", 64).toPandas()
    assert got.groupby("container")["size"].sum().max() <= 64
    assert got["size"].sum() == sum(t or 0 for _, t, _ in rows)
    for k, t, _ in rows[:3000]:
        if k != 5 and t:
            own = got[got["doc_id"] == k].sort_values("part")
            assert own["size"].sum() == t and len(own) == -(-t // 64) and own["from_token"].iloc[0] == 0 and own["to_token"].iloc[-1] == t
    least = max(-(-got["size"].sum() // 64), (got["size"] > 32).sum())  # parts above half the capacity never share
    assert got["container"].nunique() <= 1.005 * least
    assert sorted(got["container"].unique()) == list(range(got["container"].nunique()))
    assert fill.fill(items.limit(0), "doc_id", 64).count() == 0
    with pytest.raises(ValueError):
        fill.fill(items, "doc_id", 0)


def test_fill_all_and_report(spark):
    items = spark.createDataFrame([(k, 1 + k % 30) for k in range(200)], "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("s", 16), ("l", 64)], "container_kind string, capacity_tokens int")
    report = {r["container_kind"]: r for r in fill.fill_report(fill.fill_all(items, "doc_id", kinds)).collect()}
    assert report["s"]["tokens"] == report["l"]["tokens"] == sum(1 + k % 30 for k in range(200)) and report["l"]["fullest"] <= 64


@pytest.mark.skipif(NO_VOCABULARY, reason="no vocabulary file")
def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",), ("x" * 20000,)], "text string")
    got = [r["tokens"] for r in tokens.with_tokens(df).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[4] > 1
    own = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    for text in ("a  b\n\n c ", "été 漢字 \t\n", "it's 12 o'clock…   "):
        assert own.decode(own.encode_ordinary(text)) == text


def test_mix(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice(("a", "a", "a", "b", "c", "z")), draw.randint(0, 300), k % 400, "x") for k in range(4000)]
    rows += [(4000, "b", None, 1, None), (4001, None, 5, 1, None), (1, rows[1][1], rows[1][2], 1, None)]
    items = spark.createDataFrame(rows, "key bigint, source string, tokens bigint, look bigint, mix_name string")
    targets = spark.createDataFrame(
        [("m", "a", 0.5, 1), ("m", "b", 0.3, 3), ("m", "c", 0.2, 2), ("n", "b", 0.6, 4), ("n", "gone", 0.4, 2), ("o", "c", 1.0, 0)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    got = mix.mixed(items, targets)
    pdf = got.toPandas()
    caps = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 2, ("n", "b"): 4}
    assert all(r.copies <= caps[r.mix_name, r.source] for r in pdf.itertuples()) and not pdf.duplicated(["mix_name", "key"]).any()
    told = {(r["mix_name"], r["source"]): r for r in mix.shares(got, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert told["m", source]["actual_share"] == pytest.approx(share, abs=0.003)
    assert told["n", "b"]["actual_share"] == 1.0 and told["n", "gone"]["actual_share"] == 0.0 and told["o", "c"]["records"] == 0
    again = mix.mixed(items.repartition(7), targets).toPandas()
    assert set(map(tuple, again.to_numpy())) == set(map(tuple, pdf.to_numpy()))
    assert mix.mixed(items.limit(0), targets).count() == 0


def test_copies_share_their_odds():
    factor = mix.inclusion_factor(np.array([1.0, 0.5]), np.array([100, 100]), 90.0)
    assert sum(t * min(1, factor * w) for w, t in ((1.0, 100), (0.5, 100))) == pytest.approx(90)
    factor = mix.inclusion_factor(np.array([1.0, 0.25]), np.array([10, 100]), 60.0)
    assert factor > 1 and 10 + 100 * factor * 0.25 == pytest.approx(60)


def notebook(draw):
    """Cells of sentences and code; names vary, so lengths have no peak."""
    cells = []
    for _ in range(draw.randint(3, 8)):
        name = "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 12)))
        nouns = [draw.choice("yard gate valve beacon harbor needle clause ferry".split()) for _ in range(3)]
        told = [f"The {nouns[0]} of {name.capitalize()} opens every pale {nouns[1]} before the {nouns[2]} closes.", f"Keep the {nouns[0]} behind room {draw.randint(1, 999)} until the {nouns[1]} turns."]
        text = " ".join(draw.choice(told) for _ in range(draw.randint(1, 4)))
        cells.append(draw.choice((f"# %% [markdown]\n# {text}", f"# %% [{draw.randint(1, 99)}]\n{name} = {name}.dropna()\nlen({name})")))
    return "\n\n".join(cells)


def test_cut_texts(spark):
    draw = random.Random(4)
    rows, cut = [], set()
    for k in range(900):
        text = notebook(draw)
        if k % 30 == 0:
            cut.add(k)
            inner = [p for p in range(len(text) // 2, len(text)) if text[p - 1].isalpha() and text[p].isalpha()]
            text = text[: draw.choice(inner)]  # inside a word
        rows.append((k, text, "percent", "s"))
    rows += [(1000, None, "percent", "s"), (1001, "  ", None, None), (1002, "x" * 10, None, "s"), (1003, '{"cells": [', "json", "s"), (1004, '{"cells": []}', "JSON", "s"), (1005, "word " * 50000, "inout", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, layout string, source string")
    got = cutoff.scored(df)
    told = {r["doc_id"]: r["cut"] for r in got.collect()}
    assert len(told) == len(rows) and not told[1000] and not told[1001]
    found = {k for k in range(900) if told[k]}
    assert len(found & cut) >= 0.85 * len(cut) and len(found - cut) <= 10
    rate = {r["source"]: r for r in cutoff.rates(got).collect()}
    assert rate["s"]["texts"] == len(rows) - 1
    assert cutoff.scored(df.limit(0)).count() == 0


def test_limits(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abc ") for _ in range(draw.randint(100, 900))) for _ in range(800)]
    rows = [(k, t[:500], "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = cutoff.source_limits(df)
    found = {(r["source"], r["unit"], r["size"]) for r in limits.collect()}
    assert {x for x in found if x[1] == "c"} == {("s", "c", 500)}
    told = {r["doc_id"]: r for r in cutoff.with_limits(df, limits).collect()}
    for k, text in enumerate(t[:500] for t in texts):
        want = cutoff.limit_gap(len(text), len(text), {"c": {500}, "b": {500}})
        assert told[k]["gap"] == want and (want == "none") == (told[k]["chance"] == 1.0)
    assert cutoff.limit_gap(499, 499, {"c": {500}, "b": {500}}) == "b1" and told[0]["text"] == rows[0][1]
    assert cutoff.source_limits(df.limit(0)).count() == 0


def test_blocks_are_found_in_the_whole_text():
    """A mark counts however far before the end it lies."""
    long = "x" * 50_000
    assert cutoff.block_kind(f"# %% [1]\na = 1\n# --> 1\n{long}", "percent")[0] == "out"
    assert cutoff.block_kind(f"# %% [markdown]\n{long}", "percent")[0] == "prose" and cutoff.block_kind(f"a\n# %% [2]\n{long}\n", "percent")[0] == "code"
    assert cutoff.block_kind(f"In [1]:\na\n\nOut[1]:\n{long}\n{long}", "inout")[0] == "Out0" and cutoff.block_kind(f"In [1]:\na\n\n{long}", "inout")[0] == "In1"
    assert cutoff.block_kind(f"Inside\n{long}\nIn [x", "inout") == ("far", 0)
    assert cutoff.block_kind(f"a\n```python\n{long}", "fenced")[0] == "openpython" and cutoff.block_kind(f"```\n{long}\n```", "fenced")[0] == "closed"
    short, far = (cutoff.features(f"In [1]:\nf(\n{'y' * n}\n", "inout", "none") for n in (160, 8420))
    assert [x for x in short if x[:2] in ("g ", "o ")] == [x for x in far if x[:2] in ("g ", "o ")]


def test_an_empty_text_of_marks_only():
    for text in ("# %%", "In [1]:", "```", "#", "In", "."):
        for layout in ("percent", "inout", "fenced", "json", None):
            assert cutoff.features(text, layout, "none")
