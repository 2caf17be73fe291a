"""Registered queries: each runs one operator over its whole tables.

Every query here has its SQL in ``oracles``; doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions import chunk as C
from loamstone.functions import payload as P
from loamstone.functions import rank as R
from loamstone.functions import text as T
from loamstone.operators import ingest, mutate, scan, search, store, views
from loamstone.operators.render import NO_HITS, rendered, row_text
from loamstone.scale import materialize, numbered
from loamstone.sources import transcripts
from loamstone.sources.tables import table

#: The hashed test vectors are not those of a trained model, so the vector floor is lower than the default.
CFG = EngineConfig(owner="own-8dab45165e", vector_min_cos=0.7)
NOW = 1769500000.0


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rec(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return store.records(table(spark, root, "mem_records", *({"id", "arrived_at", "parent_id", *columns} if columns else ())))


def lying(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The rows of records as they lie, deliveries not merged."""
    return store.deliveries(table(spark, root, "mem_records", *({"id", "parent_id", *columns} if columns else ())))


def bodies(spark: SparkSession, root: str) -> DataFrame:
    """The rows of documents as they lie."""
    return table(spark, root, "doc_records").where(F.col("id").isNotNull()).withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def doc(spark: SparkSession, root: str) -> DataFrame:
    return store.documents(table(spark, root, "doc_records"))


def asked(spark: SparkSession, root: str) -> DataFrame:
    return store.searches(table(spark, root, "search_queries"), CFG)


def guards(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "guards")


def snapshot(spark: SparkSession, root: str) -> mutate.Snapshot:
    return mutate.Snapshot(rec(spark, root), doc(spark, root), guards(spark, root))


# ---- text


def text_purify(spark, root):
    calls = table(spark, root, "incoming", "arrival", "content")
    return calls.select("arrival", F.md5(T.purify(F.col("content"))).alias("purified"), F.length(T.purify(F.col("content"))).cast("bigint").alias("chars"))


def visible_filter(spark, root):
    calls = table(spark, root, "incoming", "arrival", "content")
    return calls.where(T.has_visible(F.col("content"))).select("arrival")


def importance_clamp(spark, root):
    calls = table(spark, root, "incoming", "arrival", "importance")
    return calls.select("arrival", r6(T.importance(F.col("importance"))).alias("clamped"))


def role_prefix(spark, root):
    calls = table(spark, root, "incoming", "arrival", "content", "role")
    role = F.when(F.col("role").isin("user", "claude"), F.col("role"))
    return calls.select("arrival", F.md5(T.prefixed(role, T.purify(F.col("content")))).alias("stored"))


def text_guard(spark, root):
    """The guard of every standalone record and of every document."""
    rows = rec(spark, root, "content", "turn_id").where("parent_id = ''")
    return mutate.stored_guards(rows, False).unionByName(mutate.stored_guards(doc(spark, root), True))


def text_tokens(spark, root):
    tokens = T.tokens(T.nfkc(F.col("content")))
    return rec(spark, root, "content").select("id", F.array_join(tokens, " ").alias("tokens"))


def text_query_terms(spark, root):
    return asked(spark, root).select("query_id", F.array_join(F.array_sort("terms"), " ").alias("terms"), F.size("terms").cast("bigint").alias("n"))


def text_ngrams(spark, root):
    return store.indexed(rec(spark, root, "content")).select("id", F.array_join("ngram_tokens", " ").alias("ngrams"))


def text_context_size(spark, root):
    return rec(spark, root, "content").select("id", T.context_size(F.col("content")).cast("bigint").alias("size"))


def safe_session(spark, root):
    return rec(spark, root, "session_id").select("id", T.safe_session(F.col("session_id")).alias("safe"))


def saved_times(spark, root):
    """The saved time of every record, also of those whose time is missing or no usual one."""
    return rec(spark, root, "timestamp_epoch").select("id", T.fmt_saved(F.col("timestamp_epoch")).alias("saved"))


def time_bounds(spark, root):
    """Every record's time as a bound in five forms, two of which can't be read."""
    at = F.col("timestamp")
    forms = {"iso": at, "day": F.substring(at, 1, 10), "spaced": F.replace(at, F.lit("T"), F.lit(" ")), "slashed": F.replace(F.substring(at, 1, 10), F.lit("-"), F.lit("/")), "month": F.concat(F.lit("2026-13-"), F.substring(at, 9, 2))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("told")) for k, v in forms.items())))
    rows = rec(spark, root, "timestamp").select("id", each.alias("x")).select("id", "x.form", "x.told")
    since, until = T.time_bound(F.col("told")), T.time_bound(F.col("told"), True)
    return rows.select("id", "form", F.round(since, 3).alias("since"), F.round(until, 3).alias("until"), T.bounds_error(F.col("told"), F.lit("2026-02-01")).alias("error"))


def payload_prompts(spark, root):
    """The calls as payloads of four forms: the prompt of each, and whether a person wrote it."""
    content = F.col("content")
    forms = {
        "object": F.to_json(F.struct(F.col("session_id"), content.alias("prompt"))), "text": F.concat(F.lit("say: "), content), "list": F.lit("[1, 2]"),
        "system": F.concat(F.lit("  <system-reminder> "), content), "bytes": P.decoded(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(content, "UTF-8"), F.unhex(F.lit("FF")))),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in forms.items())))
    rows = table(spark, root, "incoming", "arrival", "content", "session_id").where("content IS NOT NULL").select("arrival", each.alias("x")).select("arrival", "x.form", "x.raw")
    prompt = P.prompt_of(F.col("raw"))
    return rows.select("arrival", "form", F.md5(prompt).alias("prompt"), P.is_system_prompt(prompt).alias("system"))


def filled_calls(spark, root):
    """Sessions and agents of the calls with defaults for blank ones, and what would be embedded."""
    calls = table(spark, root, "incoming", "arrival", "content", "session_id", "agent_name", "role")
    session = P.filled(F.col("session_id"), F.lit("default"))
    agent = P.filled(F.col("agent_name"), F.lit(" "), F.col("role"), F.lit("client "))
    passage = F.when(T.has_visible(F.col("content")), F.md5(P.embedding_input(T.nfkc(F.col("content")))))  # nothing else is saved
    return calls.select("arrival", session.alias("session"), agent.alias("agent"), passage.alias("passage"))


def text_parts(spark, root):
    """Prompts of typed parts, made from the calls: their text parts by lines."""
    calls = table(spark, root, "incoming", "arrival", "content", "role").where("content IS NOT NULL AND role IS NOT NULL")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    prompt = F.to_json(F.array(part("text", F.col("content")), part("image", F.lit("none")), part("text", F.col("role"))))
    return calls.select("arrival", F.md5(T.text_parts(prompt)).alias("text"), F.md5(T.text_parts(F.col("content"))).alias("plain"))


def chunk_counts(spark, root):
    bodies = doc(spark, root).select("id", F.regexp_replace("content", r"^\[(user|claude)\] ", "").alias("body"))
    cut = bodies.withColumn("p", C.chunks(F.col("body"), CFG.chunk_threshold, CFG.chunk_overlap))
    ends = F.array_join(F.transform("p", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
    return cut.select("id", F.size("p").cast("bigint").alias("pieces"), ends.alias("spans"))


def query_vectors(spark, root):
    rows = asked(spark, root).select("query_id", F.posexplode("qvec").alias("place", "x"))
    return rows.select("query_id", F.col("place").cast("bigint").alias("place"), r6("x").alias("x"))


# ---- ingestion


def ingest_statuses(spark, root):
    calls = ingest.resolved(ingest.judged(table(spark, root, "incoming"), CFG.with_(owner=""), NOW), guards(spark, root), NOW)
    return calls.select("arrival", "status", "guard_key", F.when(F.col("status") == "duplicate", F.col("existing_id")).alias("existing_id"))


def ingest_without_code(spark, root):
    """The statuses where calls with a code fence are refused."""
    cfg = CFG.with_(owner="", skip_code_blocks=True)
    return ingest.resolved(ingest.judged(table(spark, root, "incoming"), cfg, NOW), guards(spark, root), NOW).select("arrival", "status")


def _ingested(spark, root):
    return ingest.ingest(table(spark, root, "incoming"), guards(spark, root), CFG.with_(owner=""), NOW)


def ingest_records(spark, root):
    """The rows that saving all calls appends to the records."""
    rows = _ingested(spark, root).records
    kept = ["id", "parent_id", "agent_name", "session_id", "turn_id", "timestamp", "access_count"]
    return rows.select(*kept, F.md5("content").alias("content"), r6("importance").alias("importance"), F.round("expires_at", 3).alias("expires_at"))


def ingest_documents(spark, root):
    """The rows that saving all calls appends to the documents."""
    rows = _ingested(spark, root).documents
    return rows.select("id", F.md5("content").alias("content"), F.col("chunk_count").cast("bigint").alias("chunk_count"), F.array_join("chunk_ids", " ").alias("chunk_ids"), F.round("expires_at", 3).alias("expires_at"))


def ingest_counts(spark, root):
    return ingest_statuses(spark, root).groupBy("status").agg(F.count("*").alias("calls"))


def dedup_exact(spark, root):
    """The first record of each stored text."""
    rows = rec(spark, root, "content", "timestamp_epoch").where("parent_id = ''").withColumn("_sha", T.sha1_hex(T.nfkc(F.col("content"))))
    return rows.groupBy("_sha").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


# ---- the legs and their fusion


def _leg(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("leg_rank").cast("bigint").alias("leg_rank"), "id", r6("score").alias("score"))


def knn_topk(spark, root):
    return _leg(scan.knn(lying(spark, root, "embedding", "timestamp_epoch", "expires_at"), asked(spark, root)))


def bm25_topk(spark, root):
    return _leg(scan.bm25(lying(spark, root, "content", "timestamp_epoch", "expires_at"), asked(spark, root), CFG))


def knn_owner_postfilter(spark, root):
    stored = lying(spark, root, "embedding", "timestamp_epoch", "expires_at", "owner_id")
    near = scan.knn(stored, asked(spark, root)).join(stored.where(F.col("owner_id") == CFG.owner).select("id"), "id", "left_semi")
    return _leg(near)


def _fused(spark, root):
    stored, queries = lying(spark, root), materialize(asked(spark, root), "searches")
    nearest, matched = search.legs(stored, queries, CFG)
    return stored, queries, search.fuse(nearest, matched)


def hybrid_fuse(spark, root):
    _, _, fused = _fused(spark, root)
    return fused.select("query_id", "id", r6("real_cos").alias("real_cos"), r6("bm25").alias("bm25"))


def _candidates(spark, root):
    stored, queries, fused = _fused(spark, root)
    return stored, search.candidates(fused, stored, queries, CFG)


def keyword_relevance(spark, root):
    _, cands = _candidates(spark, root)
    return cands.select("query_id", "id", r6("kw").alias("kw"))


def fused_score(spark, root):
    _, cands = _candidates(spark, root)
    rows = search.scored(cands, F.coalesce("real_cos", F.lit(0.0)), CFG)
    return rows.select("query_id", "id", r6("filter_score").alias("filter_score"), r6("score").alias("score"))


def search_full(spark, root):
    rows = search.search(lying(spark, root), bodies(spark, root), asked(spark, root), CFG)
    return rows.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "weak", "id", "is_doc", r6("score").alias("score"), r6("filter_score").alias("filter_score"),
        F.col("version_group").cast("bigint").alias("version_group"),
    )


def search_counts(spark, root):
    rows = search.search(lying(spark, root), bodies(spark, root), asked(spark, root), CFG)
    return rows.groupBy("query_id").agg(F.count_if(~F.col("weak")).alias("normal"), F.count_if("weak").alias("weak"), F.count_if("is_doc").alias("documents"))


def render_rows(spark, root):
    """The row of every record and document, of any owner and time."""
    shared = ("id", "content", "turn_id", "timestamp_epoch")
    single = rec(spark, root, *shared).select(*shared, F.lit(False).alias("is_doc"), F.lit(0).alias("chunk_count"), F.lit(0.5).alias("score"))
    whole = doc(spark, root).select(*shared, F.lit(True).alias("is_doc"), "chunk_count", F.lit(0.5).alias("score"))
    return single.unionByName(whole).select("id", "is_doc", F.md5(row_text()).alias("line"))


def render_blocks(spark, root):
    """The block of every search, within the context limit; a search without results gets the block that says so."""
    queries = asked(spark, root)
    made = rendered(search.search(lying(spark, root), bodies(spark, root), queries, CFG), CFG)
    text = F.coalesce("block", F.lit(NO_HITS))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", T.context_size(text).cast("bigint").alias("size"), F.md5(text).alias("block"))


def record_neighbours(spark, root):
    """The 20 nearest of all records with a vector to each of them whose id is divisible by 100, whatever the owner."""
    stored = lying(spark, root, "embedding", "timestamp_epoch", "expires_at").where(F.col("embedding").isNotNull())
    ends = F.lit(None).cast("double")
    chosen = stored.where(F.conv(F.substring("id", -6, 6), 16, 10).cast("bigint") % 100 == 0).dropDuplicates(["id"])
    asking = chosen.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"), F.lit(20).alias("k"), ends.alias("since_epoch"), ends.alias("until_epoch"), ends.alias("now_epoch"))
    return _leg(scan.knn(stored, asking))


# ---- time to live, refresh, repair


def ttl_expired(spark, root):
    return rec(spark, root, "expires_at").where(~store.live(F.col("expires_at"), NOW)).select("id")


def time_window(spark, root):
    rows = rec(spark, root, "timestamp_epoch").where(F.col("timestamp_epoch").between(NOW - 86400, NOW))
    return rows.select("id", r6(R.time_decay(F.col("timestamp_epoch"), F.lit(NOW), CFG.half_life_days)).alias("decay"))


def _refreshed(spark, root):
    """The snapshot after all searches, at one clock, with the first normal results of each refreshed."""
    found = search.search(lying(spark, root), bodies(spark, root), asked(spark, root), CFG)
    hits = materialize(found.select("query_id", "rank", "weak", "id", "is_doc", "chunk_id"), "hits")  # refresh reads them several times
    return mutate.refresh(snapshot(spark, root), hits, CFG, NOW)


def ttl_refresh(spark, root):
    after = _refreshed(spark, root)
    kept = [F.round("expires_at", 3).alias("expires_at")]
    records = after.records.select("id", F.lit(False).alias("is_doc"), *kept, F.col("access_count").cast("bigint").alias("access_count"))
    return records.unionByName(after.documents.select("id", F.lit(True).alias("is_doc"), *kept, F.lit(None).cast("bigint").alias("access_count")))


def ttl_refresh_guards(spark, root):
    return _refreshed(spark, root).guards.select("guard_key", "record_id", F.round("expires_at", 3).alias("expires_at"))


def repaired_vectors(spark, root):
    """The vectors that a repair gives, place by place."""
    after, _ = mutate.repair(snapshot(spark, root), T.hashed_vector, CFG, NOW)
    lacking = mutate.missing_vectors(store.living(rec(spark, root), NOW), CFG).select("id")
    new = after.records.where(F.col("embedding").isNotNull()).join(lacking, "id", "left_semi")
    rows = new.select("id", F.posexplode("embedding").alias("place", "x"))
    return rows.select("id", F.col("place").cast("bigint").alias("place"), F.round(F.col("x").cast("double"), 4).alias("x"))


def repair_counts(spark, root):
    return mutate.repair(snapshot(spark, root), T.hashed_vector, CFG, NOW)[1]


# ---- listing, recall, deletion


def list_newest(spark, root):
    return views.list_newest(rec(spark, root), doc(spark, root), 20, CFG, NOW).select("id", "is_doc")


def list_preview(spark, root):
    """The newest rows as they are shown."""
    shown = views.preview(views.list_newest(rec(spark, root), doc(spark, root), 20, CFG, NOW))
    return shown.select("id", "is_doc", F.col("chunk_count").cast("bigint").alias("chunk_count"), "saved", F.md5("shown").alias("shown"))


def recall_slice(spark, root):
    stored, docs = rec(spark, root), doc(spark, root)
    first = store.living(stored, NOW).where((F.col("owner_id") == CFG.owner) & (F.coalesce("turn_id", F.lit("")) != "")).agg(F.min("turn_id").alias("t")).first()["t"]
    rows = views.recall_thread(stored, docs, first or "", 2, 2, CFG, NOW)
    return rows.select("id", "is_doc", "is_hit")


def orphan_chunks(spark, root):
    """Live pieces whose document has expired or is gone."""
    now = mutate.expire(snapshot(spark, root), NOW)
    docs = now.documents.select(F.col("id").alias("parent_id"))
    return now.records.where("parent_id <> ''").join(docs, "parent_id", "left_anti").select("id", "parent_id")


def guard_lookup(spark, root):
    """Standalone records and documents whose text is guarded by a live guard."""
    own = text_guard(spark, root).join(guards(spark, root).where(store.live(F.col("expires_at"), NOW)), "guard_key")
    return own.select("id", "record_id")


def _doomed(spark, root):
    """Every record and document: another owner's are not found."""
    return rec(spark, root, "content").select("id").unionByName(doc(spark, root).select("id"))


def delete_cascade(spark, root):
    _, report = mutate.delete(snapshot(spark, root), _doomed(spark, root), CFG, NOW)
    return report


def delete_remaining(spark, root):
    after, _ = mutate.delete(snapshot(spark, root), _doomed(spark, root), CFG, NOW)
    return after.records.agg(F.count("*").alias("n")).select(F.lit("records").alias("kind"), "n").unionByName(
        after.documents.agg(F.count("*").alias("n")).select(F.lit("documents").alias("kind"), "n")
    ).unionByName(after.guards.agg(F.count("*").alias("n")).select(F.lit("guards").alias("kind"), "n"))


def delete_session_counts(spark, root):
    sessions = rec(spark, root).where(F.col("owner_id") == CFG.owner).select("session_id").distinct()
    _, report = mutate.delete_session(snapshot(spark, root), sessions, CFG, NOW)
    return report


def previous_reply(spark, root):
    return views.previous_replies(rec(spark, root))


def turn_handoff(spark, root):
    return views.turn_handoff(rec(spark, root))


def transcript_replies(spark, root):
    """The last reply of every session, its messages told as the lines of a transcript."""
    rows = rec(spark, root, "content", "session_id", "timestamp_epoch").where((F.coalesce("session_id", F.lit("")) != "") & F.col("content").rlike(T.MESSAGE_PREFIX))
    role = F.regexp_extract("content", T.MESSAGE_PREFIX, 1)
    kind = F.when(role == "user", F.lit("user")).otherwise(F.lit("assistant"))
    line = F.to_json(F.struct(kind.alias("type"), F.struct(F.regexp_replace("content", T.MESSAGE_PREFIX, "").alias("content")).alias("message")))
    lines = numbered(rows.select(F.col("session_id").alias("path"), "timestamp_epoch", "id", line.alias("line")), ["path"], ["timestamp_epoch", "id"], "line_no")
    return transcripts.last_replies(lines).select(F.col("path").alias("session_id"), F.md5("reply").alias("reply"))


def session_counters(spark, root):
    rows = rec(spark, root, "session_id", "timestamp_epoch").where(F.coalesce("session_id", F.lit("")) != "")
    return rows.groupBy("session_id").agg(F.count("*").alias("records"), F.countDistinct("parent_id").alias("parents"), F.round(F.min("timestamp_epoch"), 3).alias("since"))


QUERIES = (
    text_purify, visible_filter, importance_clamp, role_prefix, text_guard, text_tokens, text_query_terms, text_ngrams, text_context_size, safe_session,
    saved_times, time_bounds, text_parts, payload_prompts, filled_calls, chunk_counts, query_vectors, ingest_statuses, ingest_without_code, ingest_records, ingest_documents, ingest_counts, dedup_exact,
    knn_topk, bm25_topk, knn_owner_postfilter, hybrid_fuse, keyword_relevance, fused_score, search_full, search_counts, render_rows, render_blocks, record_neighbours,
    ttl_expired, time_window, ttl_refresh, ttl_refresh_guards, repair_counts, repaired_vectors, list_newest, list_preview, recall_slice, orphan_chunks, guard_lookup,
    delete_cascade, delete_remaining, delete_session_counts, previous_reply, turn_handoff, transcript_replies, session_counters,
)
