"""Ingestion, search, mutation, components, transcripts and streams on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loamstone import scale
from loamstone.config import EngineConfig
from loamstone.functions import text as T
from loamstone.operators import ingest, mutate, render, search, store, views
from loamstone.operators.components import components

from loamstone.sources import transcripts
from loamstone.sources.snapshots import Outdated, SnapshotStore
from loamstone.streaming import ingest as streaming

CFG = EngineConfig(owner="me", embedding_dim=16)
CALL = "arrival bigint, content string, role string, agent_name string, owner_id string, importance string, session_id string, turn_id string"
NOW = 1_000_000.0


def calls(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], CALL)


def no_guards(spark):
    return spark.createDataFrame([], "guard_key string, record_id string, expires_at double")


def saved(spark, rows, cfg=CFG, embed=T.hashed_vector):
    made = ingest.ingest(calls(spark, rows), no_guards(spark), cfg, NOW, embed)
    records = made.records.withColumn("arrived_at", F.lit(None).cast("timestamp_ntz"))
    return made, mutate.Snapshot(records, made.documents, made.guards)


def call(content, role=None, owner="me", importance=None, session="s", turn=None):
    return (content, role, "agent", owner, importance, session, turn)


def test_statuses(spark):
    long = "First sentence here. " * 40
    rows = [
        call("hello world"), call(" hello world "), call("x", owner="you"), call("y", importance="no"), call("  "), call("​"), call(None), call(long), call(long),
        call("same", "user", turn="t1"), call("same", "user", turn="t2"), call("same", "user", turn="t1"), call("same", "user"), call("ｈｅｌｌｏ world"),
    ]
    made, _ = saved(spark, rows)
    got = [r["status"] for r in made.statuses.orderBy("arrival").collect()]
    assert got == ["saved", "duplicate", "error: owner", "error: importance", "error: empty", "error: invisible", "error: empty", "saved", "duplicate", "saved", "saved", "duplicate", "saved", "duplicate"]
    doc = made.documents.first()
    pieces = {r["id"]: r for r in made.records.where("parent_id <> ''").collect()}
    assert doc["content"] == long.strip() and doc["chunk_count"] == len(doc["chunk_ids"]) == len(pieces)
    assert "".join(pieces[i]["content"] for i in doc["chunk_ids"]) == long.strip()
    again = ingest.ingest(calls(spark, rows), made.guards, CFG, NOW + 1)
    assert again.records.count() == 0 and again.statuses.where("status = 'saved'").count() == 0
    later = ingest.ingest(calls(spark, rows), made.guards, CFG, NOW + CFG.ttl_seconds + 1)
    assert later.statuses.where("status = 'saved'").count() == 5
    assert ingest.ingest(calls(spark, [call("a ``` b")]), no_guards(spark), CFG.with_(skip_code_blocks=True), NOW).statuses.first()["status"] == "skipped_code"
    assert ingest.ingest(calls(spark, rows).limit(0), no_guards(spark), CFG, NOW).records.count() == 0


def asked(spark, *rows):
    schema = "query_id string, text string, result_limit int, session_id string, since_epoch double, until_epoch double, now_epoch double"
    return store.searches(spark.createDataFrame(list(rows), schema), CFG)


def test_search(spark):
    texts = [f"budget for team {k} is {k * 7} coins and the harbor gate stays open until the late ferry has left pier {k}" for k in range(8)]
    _, snap = saved(spark, [call(t) for t in texts] + [call("The harbor report. " * 40)])
    stored, docs = store.records(snap.records), store.documents(snap.documents)
    queries = asked(
        spark, ("q1", "budget for team 3", 5, "s", None, None, NOW + 10), ("q2", "", 5, None, None, None, NOW + 10), ("q3", "harbor report", None, "s", None, None, NOW + 10),
        ("q4", "budget", 5, "s", 0.0, 1.0, NOW), ("q5", "budget", 5, "s", None, None, NOW + CFG.ttl_seconds + 1), ("q6", "!!", 0, "s", None, None, NOW),
    )
    cfg = CFG.with_(vector_min_cos=0.2, version_order_enabled=False)
    got = search.search(stored, docs, queries, cfg).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    assert "team 3" in by["q1"][0]["content"] and not by["q1"][0]["weak"] and len(by["q1"]) <= 5
    assert by["q3"][0]["is_doc"] and sum(r["is_doc"] for r in by["q3"]) == 1
    assert "q4" not in by and "q5" not in by
    for rows in by.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        normal = [r["score"] for r in rows if not r["weak"]]
        assert normal == sorted(normal, reverse=True)
    blocks = render.rendered(search.search(stored, docs, queries, cfg), cfg).collect()
    assert {b["query_id"] for b in blocks} == set(by)
    nothing = search.search(stored.limit(0), docs.limit(0), queries, cfg)
    assert nothing.count() == 0 and search.search(stored, docs, queries.limit(0), cfg).count() == 0


def test_blocks_of_searches_give_what_one_gives(spark, data, monkeypatch):
    """Many small blocks, with and without terms in common, against one block."""
    from loamstone.operators import scan
    from loamstone.plans import catalogue

    stored, queries = catalogue.lying(spark, data), catalogue.asked(spark, data).persist()
    whole = [{tuple(r) for r in leg.collect()} for leg in search.legs(stored, queries, catalogue.CFG)]
    small = scan.blocks_of
    monkeypatch.setattr(scan, "blocks_of", lambda searches, columns: small(searches, columns, 2))
    monkeypatch.setattr(scan, "TERMS", 20)
    assert [{tuple(r) for r in leg.collect()} for leg in search.legs(stored, queries, catalogue.CFG)] == whole
    groups = list(scan.groups_of(iter([[{"terms": ["a", "b"]}], [{"terms": ["b"]}], [{"terms": ["c"]}], [{"terms": list("defg")}]]), 2))
    assert [(len(blocks), terms) for blocks, terms in groups] == [(2, ["a", "b"]), (1, ["c"]), (1, list("defg"))]


def test_versions_take_the_better_places(spark):
    schema = "query_id string, pos int, id string, is_doc boolean, chunk_ids array<string>, score double, filter_score double, timestamp_epoch double"
    kept = spark.createDataFrame([("q", 1, "a", False, None, 0.9, 0.9, 1.0), ("q", 2, "x", False, None, 0.8, 0.8, 9.0), ("q", 3, "b", False, None, 0.7, 0.7, 3.0), ("q", 4, "c", False, None, 0.6, 0.6, 2.0)], schema)
    text = "t" * 120
    stored = spark.createDataFrame(
        [("a", text, [1.0, 0.0]), ("b", text, [0.99, 0.1]), ("c", text, [0.96, 0.2]), ("x", text, [0.0, 1.0])], "id string, content string, embedding array<double>"
    )
    got = {r["pos"]: r for r in search.version_ordered(kept, stored, CFG).collect()}
    assert [got[p]["id"] for p in (1, 2, 3, 4)] == ["b", "x", "c", "a"]
    assert [got[p]["score"] for p in (1, 3, 4)] == [0.9, 0.7, 0.6] and got[1]["version_group"] == 1 and got[2]["version_group"] is None


def test_owner_filter_stays_above_the_leg(spark, data):
    from loamstone.plans.catalogue import knn_owner_postfilter, knn_topk

    mine = {(r["query_id"], r["id"]) for r in knn_owner_postfilter(spark, data).collect()}
    assert mine < {(r["query_id"], r["id"]) for r in knn_topk(spark, data).collect()}


def test_mutation(spark):
    long = "A sentence of the document. " * 30
    _, snap = saved(spark, [call("one"), call("two", session="other"), call(long), call("four", "user", session="other", turn="t")], embed=None)
    doc_id = snap.documents.first()["id"]
    pieces = snap.records.where("parent_id <> ''").count()
    after, report = mutate.delete(snap, spark.createDataFrame([("doc:" + doc_id,), ("none",)], "id string"), CFG)
    assert {(r["id"], r["status"], r["chunks"]) for r in report.collect()} == {(doc_id, "deleted", pieces), ("none", "not_found", 0)}
    assert after.records.count() == 3 and after.documents.count() == 0 and after.guards.count() == 3
    after, report = mutate.delete_session(snap, spark.createDataFrame([("other",), ("nil",), (" ",)], "session_id string"), CFG)
    got = {r["session_id"]: r for r in report.collect()}
    assert got["other"]["singles_deleted"] == got["other"]["deleted"] == 2 and got["nil"]["deleted"] == 0 and after.guards.count() == 2
    fixed, report = mutate.repair(snap, T.hashed_vector, CFG.with_(repair_batch=2))
    row = report.first()
    assert (row["reembedded"], row["remaining"]) == (2, pieces + 1) and fixed.records.where("embedding IS NOT NULL").count() == 2
    hit = snap.records.where("parent_id <> ''").first()
    hits = spark.createDataFrame([(doc_id, True, hit["id"])], "id string, is_doc boolean, chunk_id string")
    newer = mutate.refresh(snap, hits, CFG, NOW + 100)
    assert newer.records.where(F.col("expires_at") > NOW + CFG.ttl_seconds).count() == pieces
    assert newer.records.where("access_count = 1").count() == 1 and newer.guards.where(F.col("expires_at") > NOW + CFG.ttl_seconds).count() == 1
    gone = mutate.expire(newer, NOW + CFG.ttl_seconds + 1)
    assert gone.records.count() == pieces and gone.documents.count() == 1 and gone.guards.count() == 1


def test_views(spark):
    schema = "id string, content string, timestamp string, timestamp_epoch double, owner_id string, session_id string, turn_id string, parent_id string, arrived_at timestamp_ntz"
    rows = [(f"r{k}", f"[{'user' if k % 2 else 'claude'}] {k}", f"2026-01-0{k}", float(k), "me", "s", "T" if k == 4 else f"t{k}", "", None) for k in range(1, 8)]
    records = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([], "id string, content string, timestamp string, timestamp_epoch double, owner_id string, turn_id string, chunk_count int, chunk_ids array<string>")
    got = views.recall_thread(records, docs, "T", 2, 2, CFG).collect()
    assert sorted(r["id"] for r in got) == ["r2", "r3", "r4", "r5", "r6"] and [r["id"] for r in got if r["is_hit"]] == ["r4"]
    assert views.recall_thread(records, docs, "none", 2, 2, CFG).count() == 0
    assert [r["id"] for r in views.list_newest(records, docs, 3, CFG).collect()] == ["r7", "r6", "r5"]
    assert views.list_newest(records, docs, -5, CFG).count() == 1 and views.list_newest(records, docs, 0, CFG).count() == 7
    assert views.preview(views.list_newest(records, docs, 1, CFG)).first()["shown"] == "[user] 7"
    replies = {r["id"]: r["reply_id"] for r in views.previous_replies(records).collect()}
    assert replies == {"r1": None, "r3": "r2", "r5": "r4", "r7": "r6"}
    turns = {r["id"]: r["prompt_turn"] for r in views.turn_handoff(records).collect()}
    assert turns == {"r2": "t1", "r4": "t3", "r6": "t5"}


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_transcripts(spark, tmp_path):
    def line(kind, content, **more):
        return json.dumps({"type": kind, "message": {"content": content}} | more)

    lines = [
        line("user", "first"), line("assistant", [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]), "no json", line("assistant", "side", isSidechain=True),
        line("user", "<system-reminder> x"), line("user", "meta", isMeta=True), line("user", [{"type": "tool_result"}]), line("user", "now"),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    df = transcripts.read_lines(spark, str(tmp_path))
    assert transcripts.last_replies(df, "now").first()["reply"] == "two"
    assert transcripts.last_replies(df, "other").first()["reply"] is None
    transcripts.append_audit(spark.range(2), str(tmp_path / "log"))
    transcripts.append_audit(spark.range(3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5


def test_streams(spark, tmp_path):
    rows = [call("hello"), call("hello"), call("[user] x", "user", turn="t"), call("long text. " * 80)]
    folder = tmp_path / "in"
    calls(spark, rows).coalesce(1).write.parquet(str(folder))
    schema = calls(spark, rows).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = streaming.save_batches(stream, str(tmp_path / "store"), CFG, lambda n: NOW + n, str(tmp_path / "cp"))
        assert q.awaitTermination(120)

    run()
    held = spark.read.parquet(str(tmp_path / "store/statuses"))
    assert held.groupBy("status").count().orderBy("status").collect() == [("duplicate", 1), ("saved", 3)]
    calls(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
    run()
    assert spark.read.parquet(str(tmp_path / "store/statuses")).where("status = 'saved'").count() == 3
    assert spark.read.parquet(str(tmp_path / "store/guards")).count() == 3


def test_turn_stream_and_guards(spark, tmp_path):
    rows = [("s", 1, "user", "T1", 1.0), ("s", 2, "claude", None, 2.0), ("r", 3, "claude", None, 1.0), ("s", 4, "user", None, 3.0)]
    schema = "session_id string, event_id bigint, role string, turn_id string, at double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = streaming.turns(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["event_id"]: r["turn_id"] for r in spark.sql("SELECT * FROM turns").collect()}
    assert got == {1: "T1", 2: "T1", 3: "turn-3", 4: "turn-4"}
    timed = stream.withColumn("time", F.timestamp_seconds("at")).withColumn("content", F.lit("same"))
    first = streaming.first_per_guard(streaming.guarded(timed).select("guard_key", "time", "event_id"), "time", 60)
    q = first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.sql("SELECT * FROM firsts").count() == 4 - 1  # one guard within T1, one without a turn per role


def test_turns_of_a_long_session_in_mixed_order(spark, tmp_path):
    """More events of one session than an Arrow batch holds, out of order, and the stream ends."""
    n = 12_500
    rows = [("s", 2 * k, "user", f"T{k}", NOW + 2 * k) for k in range(n)] + [("s", 2 * k + 1, "claude", None, NOW + 2 * k + 1) for k in range(n)]
    random.Random(1).shuffle(rows)
    schema = "session_id string, event_id bigint, role string, turn_id string, at double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = streaming.turns(stream).writeStream.format("memory").queryName("long_turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["event_id"]: r["turn_id"] for r in spark.sql("SELECT * FROM long_turns").collect()}
    assert got == {e: f"T{e // 2}" for e in range(2 * n)}


def test_guards_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT_EVERY", 2)
    store_dir = str(tmp_path / "store")
    schema = calls(spark, []).schema
    for k in range(4):
        calls(spark, [call(f"text {k}"), call("text 0")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streaming.save_batches(stream, store_dir, CFG, lambda n: NOW + n * CFG.ttl_seconds * 0.4, str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    statuses = spark.read.parquet(store_dir + "/statuses")
    # The guard of the first batch has expired by the fourth, so its text is saved again there.
    assert sorted((r["batch"], r["status"]) for r in statuses.collect()) == [(0, "duplicate"), (0, "saved"), (1, "duplicate"), (1, "saved"), (2, "duplicate"), (2, "saved"), (3, "saved"), (3, "saved")]
    assert streaming._batches(spark, store_dir + "/guards_compacted") == [1, 3]
    assert streaming._known_guards(spark, store_dir, 4).count() == 4


def test_expired_rows_are_gone(spark):
    _, snap = saved(spark, [call("one"), call("two"), call("A sentence of the document. " * 30)])
    after = NOW + CFG.ttl_seconds + 1
    ids = snap.records.select("id")
    assert {r["status"] for r in mutate.delete(snap, ids, CFG, after)[1].collect()} == {"not_found"}
    hits = ids.select("id", F.lit(False).alias("is_doc"), F.lit(None).cast("string").alias("chunk_id"))
    assert mutate.refresh(snap, hits, CFG, after).records.count() == 0
    assert mutate.refresh(snap, hits, CFG, NOW + 1).records.where(F.col("expires_at") > NOW + CFG.ttl_seconds).count() == snap.records.count()
    assert views.list_newest(snap.records, snap.documents, 9, CFG, after).count() == 0 and views.list_newest(snap.records, snap.documents, 9, CFG, NOW).count() == 3
    assert mutate.repair(snap, T.hashed_vector, CFG, after)[1].first()["remaining"] == 0
    ranked = hits.withColumn("rank", F.lit(6)).withColumn("weak", F.lit(False))
    assert mutate.refresh(snap, ranked, CFG, NOW + 1).records.where(F.col("expires_at") > NOW + CFG.ttl_seconds).count() == 0


def test_search_then_refresh(spark):
    _, snap = saved(spark, [call("the harbor gate stays open"), call("nothing alike")])
    cfg = CFG.with_(vector_min_cos=0.2, version_order_enabled=False)
    queries = asked(spark, ("q", "harbor gate", 5, "s", None, None, NOW + 10))
    found, after = mutate.search_then_refresh(snap, queries, cfg, NOW + 10)
    hit = {r["id"] for r in found.where("not weak").collect()}
    assert hit and {r["id"] for r in after.records.where("access_count = 1").collect()} == hit
    assert mutate.search_then_refresh(snap, queries, cfg.with_(ttl_refresh_on_search=False), NOW + 10)[1] is snap


def test_numbers_and_carried_values_of_a_hot_group(spark):
    """A third of all rows in one group: no partition holds more than a share of them, and numbers run through."""
    rows = [("hot" if k % 3 == 0 else f"g{k}", float((k * 7919) % 30000), k) for k in range(30000)]
    df = spark.createDataFrame(rows, "g string, at double, k bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert scale.placed(df, ["g"], ["at", "k"]).groupBy("_part").count().agg(F.max("count")).first()[0] < 30000 / 4
        got = {r["k"]: r["no"] for r in scale.numbered(df, ["g"], ["at", "k"], "no").where("g = 'hot'").collect()}
        hot = sorted((at, k) for g, at, k in rows if g == "hot")
        assert got == {k: n + 1 for n, (_, k) in enumerate(hot)}
        odd = F.when(F.col("k") % 5 == 0, F.col("k"))
        carried = {r["k"]: r["v"] for r in scale.latest_before(df, "g", ["at", "k"], odd, "v").where("g = 'hot'").collect()}
        last, want = None, {}
        for _, k in hot:
            want[k] = last
            last = k if k % 5 == 0 else last
        assert carried == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_versions_of_the_store(spark, tmp_path):
    _, snap = saved(spark, [call("one"), call("A sentence of the document. " * 30)])
    held = SnapshotStore(spark, str(tmp_path / "versions"))
    empty, number = held.read()
    assert number == 0 and empty.records.count() == empty.guards.count() == 0
    assert held.commit(snap, 0, CFG) == 1
    first, number = held.read()
    assert number == 1 and first.records.count() == snap.records.count() and first.documents.first()["chunk_ids"] == snap.documents.first()["chunk_ids"]
    second = mutate.delete(first, first.records.select("id"), CFG)[0]
    assert held.commit(second, 1) == 2
    with pytest.raises(Outdated):
        held.commit(first, 1)
    with pytest.raises(ValueError):
        held.commit(first, 2, CFG.with_(embedding_dim=8))
    folders = [p.name for p in (tmp_path / "versions").iterdir() if p.name.startswith("version-")]
    assert held.versions() == [1, 2] and len(folders) == 2
    assert held.read(1)[0].records.count() == snap.records.count() and held.read()[0].records.where("parent_id = ''").count() == 0
    fewer = mutate.Snapshot(first.records.drop("agent_name"), first.documents, first.guards)
    assert held.commit(fewer, 2) == 3 and held.read()[0].records.where("agent_name IS NULL").count() == snap.records.count()
    held.clean(1)
    assert held.versions() == [3] and held.read()[0].guards.count() == snap.guards.count()


def test_intermediates_are_removed(spark):
    import os

    with scale.intermediates(spark):
        held = scale.materialize(spark.range(3))
        path = held.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and held.count() == 3
    assert not os.path.exists(path)


def test_core_never_imports_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "loamstone"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"^\s*(from|import)\s+loamstone\.llm", path.read_text(), re.M), path


@pytest.mark.parametrize("bad", [None])
def test_salt_and_shared_dir(spark, bad):
    from loamstone import scale

    assert scale.shared_dir(spark) == scale.shared_dir(spark)
    assert scale.materialize(spark.range(5)).count() == 5
