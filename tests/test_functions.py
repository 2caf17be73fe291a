"""Text, ranking, chunking and configuration functions on literal cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone import config
from loamstone.config import EngineConfig
from loamstone.functions import chunk, fields
from loamstone.functions import rank as R
from loamstone.functions import text as T
from loamstone.operators import render, store

CFG = EngineConfig()


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in columns.items()))
    return df.select(expression.alias("x")).first()["x"]


def on(spark, f, value):
    return one(spark, f(F.col("t")), t=value)


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("「記憶装置」は？", ["記憶", "憶装", "装置", "は"]),
        ("アルファ9", ["アル", "ルフ", "ファ", "9"]),
        ("Hello, world_x _ 1", ["Hello", "world_x", "1"]),
        ("", []),
        ("...", []),
        ("ｆｕｌｌ　width", ["full", "width"]),
    ],
)
def test_tokens(spark, text, tokens):
    assert on(spark, lambda t: T.tokens(T.nfkc(t)), text) == tokens


def test_query_terms(spark):
    terms = lambda t: T.query_terms(T.tokens(T.nfkc(t)))
    assert on(spark, terms, "記憶装置 は") == ["記憶", "憶装", "装置"]
    assert on(spark, terms, "は") == ["は"]
    assert on(spark, terms, "検索 して") == ["検索"]
    assert on(spark, terms, "して") == ["して"]


def test_ngrams(spark):
    df = spark.createDataFrame([("café 記憶装 naive",), ("",)], "t string").withColumn("n", T.nfkc(F.col("t"))).withColumn("f", T.folded(F.col("n")))
    got = [r["x"] for r in df.select(T.ngrams(F.col("n"), F.col("f")).alias("x")).collect()]
    assert got == [["café", "cafe", "記憶", "憶装", "naive"], []]


def test_fields_in_one_pass_are_those_of_the_columns(spark, data):
    """The scan's terms against the column functions, on every text of the smallest table and some rare characters."""
    texts = spark.read.parquet(f"{data}/mem_records.parquet").select("content").union(spark.createDataFrame([("Ünï-cödé x_y \u00ad記憶\u3000é\x1f装",), ("",), (None,), ("e\u0301\u0301 ばば",)], "content string"))
    rows = store.indexed(texts).collect()
    vocabulary = sorted({t for r in rows for t in [*(r["content_tokens"] or []), *(r["ngram_tokens"] or [])]})
    terms = fields.Terms(vocabulary)
    for r in rows:
        whole, parts = terms.of(r["content"])
        assert [vocabulary[k] for k in whole] == (r["content_tokens"] or []) and [vocabulary[k] for k in parts] == (r["ngram_tokens"] or [])


def test_purify_and_visibility(spark):
    assert on(spark, T.purify, "see ```py\nx=1\n``` here") == "see [code omitted] here"
    assert on(spark, T.purify, "open ```x") == "open [code omitted]"
    assert on(spark, T.has_visible, "\x00​") is False and on(spark, T.has_visible, " x") is True
    assert on(spark, T.has_visible, None) is False and on(spark, T.has_visible, "") is False
    assert on(spark, T.strip, "　 a b \x1f\n") == "a b"


def test_sizes(spark):
    assert on(spark, T.context_size, "😀") == 2 and on(spark, T.context_size, "a\nb") == 4
    assert int(render.sizes("😀a\nb").sum()) == 6
    assert on(spark, T.safe_session, "a b/ä" + "x" * 80) == "a_b__" + "x" * 59


@pytest.mark.parametrize("value, want", [("1.5", 1.5), (" 9 ", 2.0), ("-1", 0.5), ("x", None), ("nan", None), ("inf", None), ("", None), (None, None)])
def test_importance(spark, value, want):
    assert on(spark, T.importance, value) == want


def test_saved_time(spark):
    assert one(spark, T.fmt_saved(F.col("t")), t=1767265907.9) == "2026-01-01 11:11 (UTC+0000)"
    assert one(spark, T.fmt_saved(F.col("t")), t=float("nan")) == "unknown"


def test_text_parts(spark):
    assert on(spark, T.text_parts, '[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]') == "a\nb"
    assert on(spark, T.text_parts, "[not json") == "[not json"
    assert on(spark, T.text_parts, '[{"text":"a"}]') == '[{"text":"a"}]'
    assert on(spark, T.text_parts, "plain") == "plain"


def test_ranking(spark):
    lit = lambda e: one(spark, e, t="x")
    assert lit(R.time_decay(F.lit(0.0), F.lit(3 * 86400.0), 3.0)) == pytest.approx(0.5)
    assert lit(R.time_decay(F.lit(9e9), F.lit(0.0), 3.0)) == 1.0
    assert lit(R.keyword_relevance(F.lit(0.05), F.lit(10.0), 0.1)) == 0.0
    assert lit(R.keyword_relevance(F.lit(5.0), F.lit(10.0), 0.1)) == 0.5
    assert lit(R.keyword_relevance(F.lit(0.5), F.lit(0.5), 0.1)) == 0.5
    assert lit(R.cos_from_distance(F.lit(float("nan")))) == 0.0
    assert lit(R.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    counted = CFG.with_(access_count_enabled=True)
    assert lit(R.local_boost(F.lit(1.0), F.lit(10), counted)) == pytest.approx(1.2)
    assert lit(R.local_boost(F.lit(1.9), F.lit(99), counted)) == 2.0
    assert lit(R.local_boost(F.lit(1.0), F.lit(10), CFG)) == 1.0
    assert lit(R.session_boost(F.lit("a"), F.lit("a"), CFG)) == 1.0 and lit(R.session_boost(F.lit("a"), F.lit(""), CFG)) == 0.6
    words = F.array(F.lit("alpha"), F.lit("beta"))
    got = lit(R.rerank_bonus(words, F.lit("alpha"), F.array(F.lit("alpha")), F.lit("alpha gamma " * 10), CFG))
    assert got == pytest.approx(0.5 * 0.3 + 0.2)


def test_chunks():
    assert chunk.chunk_spans("x" * 400) == [(0, 400)] and chunk.chunk_spans("") == [(0, 0)]
    assert chunk.chunk_spans("x" * 500) == [(0, 400), (300, 500)]
    text = "a" * 350 + ". " + "b" * 300
    assert chunk.chunk_spans(text)[0] == (0, 352) and chunk.chunk_spans(text)[1][0] == 352
    tail = "a" * 390 + "\n" + "b" * 15
    assert chunk.chunk_spans(tail) == [(0, 406)]
    assert chunk.chunk_spans("y" * 150, 100, 100) == [(0, 100), (75, 150)]


def test_hashed_vector(spark):
    got = on(spark, lambda t: T.hashed_vector(t), "alpha beta alpha")
    assert len(got) == 16 and sum(x * x for x in got) == pytest.approx(1.0)
    assert on(spark, lambda t: T.hashed_vector(t), " ") is None


@pytest.mark.parametrize("dim", [1, 16, 17, 96, 768])
def test_hashed_vector_fills_every_dimension(spark, dim):
    want = np.zeros(dim)
    for word in ("alpha", "beta", "alpha", "ギター"):
        h = int(hashlib.md5(word.encode()).hexdigest(), 16)
        want[h % dim] += 1.0
        want[(h >> 16) % dim] += 0.5
    assert on(spark, lambda t: T.hashed_vector(t, dim), "alpha beta\nALPHA ギター") == pytest.approx(list(want / np.linalg.norm(want)))


def test_config(tmp_path):
    got, notes = config.from_mapping({"min_score": 0.5, "ttl_seconds": "1", "half_life_days": 0, "version_order_enabled": 1, "chunk_threshold": 80, "unknown": 1})
    assert got.min_score == 0.5 and got.ttl_seconds == 604800 and got.half_life_days == 3.0 and got.version_order_enabled is True
    assert got.chunk_overlap == 20 and len(notes) == 4
    path = tmp_path / "c.json"
    path.write_text('{"min_results": 5}')
    assert config.load(str(path))[0].min_results == 5 and config.load(str(tmp_path / "none"))[1]


def test_block():
    rows = [f"### [id{i}] score=0.5 saved=x\n" + "記" * 600 for i in range(12)]
    full = render.block(rows, [])
    assert full.startswith(render.VERSION_LINE) and full.count("###") == 12
    short = render.block(rows, ["weak"], 4000)
    assert int(render.sizes(short).sum()) + 2 <= 4000 and "omitted" in short and render.WEAK_HEADING in short
    cut = render.block(rows, [], 2000)
    assert cut.endswith(render.CUT_LINE) and int(render.sizes(cut).sum()) + 2 <= 2000
    assert render.block([], []) == render.NO_HITS
