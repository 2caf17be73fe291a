"""The SQL (DuckDB dialect) of every query in ``catalogue``, written from the operators' definitions.

Compatibility normalization has no SQL function; it is written out here by rule for the forms that
the tables hold: full- and half-width forms, spaces, raised figures and the ellipsis, then NFC.
"""

from __future__ import annotations

import unicodedata

from loamstone.functions.text import CJK, INVISIBLE, SIGNS, SPACES
from loamstone.operators.render import BETWEEN, CUT_LINE, LEAST_ROWS, NO_HITS, VERSION_LINE, WEAK_HEADING
from loamstone.plans.catalogue import CFG


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _singles() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms, by rule."""
    codes = [*range(0xFF01, 0xFFEF), 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0xB2, 0xB3, 0xB9, *range(0x2070, 0x208F), 0x3099, 0x309A]
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in codes]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _singles()


def nfkc(x: str) -> str:
    return f"nfc_normalize(translate(replace({x}, '…', '...'), {quoted(_FROM)}, {quoted(_TO)}))"


def purify(x: str) -> str:
    return f"regexp_replace({x}, '```[\\s\\S]*?(?:```|\\z)', '[code omitted]', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+\\z', '', 'g')"


def clean(n: str) -> str:
    return f"translate(regexp_replace({n}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), {quoted(SIGNS)}, {quoted(' ' * len(SIGNS))})"


def runs(n: str) -> str:
    return f"regexp_extract_all({clean(n)}, '([{CJK}]+|[^{CJK}{SPACES}]+)', 1)"


def _pairs(r: str) -> str:
    return f"CASE WHEN regexp_matches({r}, '^[{CJK}]') AND length({r}) > 1 THEN list_transform(range(1, length({r})), lambda i: substr({r}, i, 2)) ELSE [{r}] END"


def tokens(n: str) -> str:
    return f"list_filter(flatten(list_transform({runs(n)}, lambda r: {_pairs('r')})), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))"


def ngrams(n: str) -> str:
    # Without diacritics: decomposed text without marks, which bigram scripts do not take part in.
    fold = "strip_accents(r)"
    return f"flatten(list_transform({runs(n)}, lambda r: CASE WHEN NOT regexp_matches(r, '^[{CJK}]') AND {fold} <> r AND {fold} <> '' THEN [r, {fold}] ELSE {_pairs('r')} END))"


def guard(content: str, turn: str, is_doc: str) -> str:
    scoped = f"(coalesce({turn}, '') <> '' AND ({content} LIKE '[user%' OR {content} LIKE '[claude%'))"
    return f"(CASE WHEN {is_doc} THEN 'docsha:' ELSE 'mem:sha:' END || CASE WHEN {scoped} THEN {turn} || ':' ELSE '' END || sha1({nfkc(content)}))"


REC = """rec AS (
  SELECT * EXCLUDE (parent_id), coalesce(parent_id, '') AS parent_id FROM mem_records WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at) = 1)"""
DOC = """doc AS (
  SELECT * EXCLUDE (chunk_ids), coalesce(chunk_ids, []) AS chunk_ids FROM doc_records WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY timestamp_epoch) = 1)"""
OWNER = quoted("own-8dab45165e")
NOW = 1769500000.0
LIVE = f"coalesce(expires_at > {NOW}, true)"
LIVE_REC = f"{REC.replace('rec AS', 'held AS', 1)}, rec AS (SELECT * FROM held WHERE {LIVE})"
LIVE_DOC = f"{DOC.replace('doc AS', 'whole AS', 1)}, doc AS (SELECT * FROM whole WHERE {LIVE})"
PREFIX = "^\\[(user|claude)( [0-9]+/[0-9]+)?\\] "

ASKED = f"""asked_ AS (
  SELECT query_id, coalesce(text, '') AS asked, substr(coalesce(text, ''), 1, {CFG.search_query_max_chars}) AS text,
         CAST(greatest(1, coalesce(result_limit, {CFG.search_result_limit})) AS INT) AS lim,
         CASE WHEN coalesce({strip('session_id')}, '') <> '' THEN session_id ELSE '' END AS session, since_epoch, until_epoch, now_epoch
  FROM search_queries
), asked_n AS (SELECT *, least(lim * 5, 100) AS k, {nfkc('text')} AS normal FROM asked_),
asked_t AS (SELECT *, {tokens('normal')} AS toks FROM asked_n),
asked_a AS (SELECT *, list_filter(toks, lambda t: NOT regexp_matches(t, '^[{CJK}]$')) AS long_ FROM asked_t),
asked_b AS (SELECT *, CASE WHEN len(long_) > 0 THEN long_ ELSE toks END AS kept FROM asked_a),
asked_c AS (SELECT *, list_filter(kept, lambda t: NOT regexp_matches(t, '^[\\x{{3040}}-\\x{{309F}}\\x{{30FC}}]+$')) AS hira FROM asked_b),
asked AS (SELECT *, list_distinct(list_transform(toks, lambda t: lower(t))) AS qt,
          list_distinct(list_transform(CASE WHEN len(hira) > 0 THEN hira ELSE kept END, lambda t: lower(t))) AS terms FROM asked_c)"""

VECTORS = """qwords AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(normal), '\\s+'), lambda w: w <> '')) AS w FROM asked),
qhits AS (SELECT query_id, CAST('0x' || substr(md5(w), 32, 1) AS INT) AS i, 1.0 AS x FROM qwords
          UNION ALL SELECT query_id, CAST('0x' || substr(md5(w), 28, 1) AS INT), 0.5 FROM qwords),
qraw AS (SELECT q.query_id, p.i, coalesce(sum(h.x), 0.0) AS x FROM (SELECT DISTINCT query_id FROM qwords) q CROSS JOIN (SELECT unnest(range(16)) AS i) p
         LEFT JOIN qhits h ON h.query_id = q.query_id AND h.i = p.i GROUP BY ALL),
qvec AS (SELECT query_id, list(CAST(x AS DOUBLE) / n ORDER BY i) AS qvec FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS n FROM qraw) GROUP BY query_id)"""

SEEN = """coalesce(r.expires_at > a.now_epoch, r.expires_at IS NULL OR a.now_epoch IS NULL)
  AND ((a.since_epoch IS NULL AND a.until_epoch IS NULL) OR coalesce(r.timestamp_epoch >= coalesce(a.since_epoch, '-infinity'::DOUBLE) AND r.timestamp_epoch <= coalesce(a.until_epoch, 'infinity'::DOUBLE), false))"""

KNN = f"""knn_all AS (
  SELECT a.query_id, r.id, a.k, round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), v.qvec), 9) AS score
  FROM asked a JOIN qvec v USING (query_id), rec r WHERE r.embedding IS NOT NULL AND {SEEN}
), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS leg_rank FROM knn_all QUALIFY leg_rank <= k)"""

_FIELDS = (("c", CFG.content_weight), ("g", CFG.ngram_weight))
BM25 = f"""norm AS (SELECT id, {nfkc('content')} AS n FROM rec),
toks AS (
  SELECT id, 'c' AS f, list_transform(regexp_extract_all({clean('n')}, '([^{SPACES}]+)', 1), lambda t: lower(t)) AS t FROM norm
  UNION ALL SELECT id, 'g', list_transform({ngrams('n')}, lambda t: lower(t)) FROM norm
), lens AS (SELECT id, f, len(t) AS l, avg(len(t)) OVER (PARTITION BY f) AS m FROM toks),
flat AS (SELECT id, f, unnest(t) AS term FROM toks),
tf AS (SELECT id, f, term, count(*) AS tf FROM flat GROUP BY ALL),
qterm AS (SELECT query_id, unnest(terms) AS term FROM asked),
df AS (SELECT f, term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qterm) GROUP BY ALL),
part AS (
  SELECT tf.id, tf.term, CASE tf.f WHEN 'c' THEN {CFG.content_weight} ELSE {CFG.ngram_weight} END
         * ln(1 + ((SELECT count(*) FROM rec) - df.df + 0.5) / (df.df + 0.5)) * tf.tf * ({CFG.bm25_k1} + 1)
         / (tf.tf + {CFG.bm25_k1} * (1 - {CFG.bm25_b} + {CFG.bm25_b} * lens.l / lens.m)) AS s
  FROM tf JOIN df USING (f, term) JOIN lens ON lens.id = tf.id AND lens.f = tf.f
), bm_all AS (
  SELECT a.query_id, r.id, a.k, round(sum(p.s), 9) AS score FROM qterm q JOIN part p USING (term) JOIN asked a ON a.query_id = q.query_id JOIN rec r ON r.id = p.id
  WHERE {SEEN} GROUP BY ALL
), bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS leg_rank FROM bm_all QUALIFY leg_rank <= k)"""

FUSED = """fused AS (
  SELECT coalesce(n.query_id, m.query_id) AS query_id, coalesce(n.id, m.id) AS id,
         CASE WHEN n.id IS NOT NULL THEN greatest(0.0, least(1.0, n.score)) END AS real_cos, m.score AS bm25, coalesce(n.leg_rank, m.leg_rank + 100000) AS place
  FROM knn n FULL JOIN bm m ON n.query_id = m.query_id AND n.id = m.id)"""

CANDS = f"""cand_ AS (
  SELECT f.*, r.content, r.timestamp_epoch, r.session_id, r.turn_id, r.importance, r.parent_id, a.session, a.now_epoch, a.lim, a.asked, a.normal, a.qt,
         coalesce(max(abs(bm25)) OVER (PARTITION BY f.query_id), 0.0) AS mb
  FROM fused f JOIN rec r ON r.id = f.id JOIN asked a ON a.query_id = f.query_id WHERE r.owner_id = {OWNER}
), cand AS (
  SELECT *, CASE WHEN bm25 IS NULL OR abs(bm25) < {CFG.bm25_min_threshold} THEN 0.0 ELSE least(1.0, abs(bm25) / greatest(1.0, mb)) END AS kw,
         greatest(0.5, least(2.0, CASE WHEN importance IS NULL OR isnan(importance) THEN 1.0 ELSE importance END)) AS bl,
         CASE WHEN timestamp_epoch IS NULL THEN 1.0 ELSE pow(2.0, -greatest(0.0, (now_epoch - timestamp_epoch) / 86400.0) / {CFG.half_life_days}) END AS decay,
         CASE WHEN session <> '' AND coalesce(session_id = session, false) THEN {CFG.b_session_match} ELSE {CFG.b_session_mismatch} END AS bs
  FROM cand_)"""


def _scored(source: str, cos: str) -> str:
    return f"SELECT *, (({cos}) * 0.7 + kw * 0.3) * bl AS fs0, (({cos}) * 0.7 + kw * 0.3) * decay * bl * bs AS s0 FROM {source}"


def _resolved(name: str, source: str, order: str) -> str:
    """Documents for their first piece, then both scores with the lexical bonus."""
    bonus = f"""(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt) ELSE 0.0 END * {CFG.rerank_weight}
      + CASE WHEN ql <> '' AND contains(cl, ql) THEN {CFG.rerank_phrase_weight} ELSE 0.0 END) * CASE WHEN length(cl) < 50 THEN length(cl) / 50.0 ELSE 1.0 END"""
    return f"""{name}_j AS (
  SELECT s.* EXCLUDE (id, content, turn_id, timestamp_epoch), d.id IS NOT NULL AS is_doc, coalesce(d.id, s.id) AS id, CASE WHEN d.id IS NULL THEN s.content ELSE d.content END AS content,
         coalesce(CASE WHEN d.id IS NOT NULL THEN d.timestamp_epoch END, s.timestamp_epoch) AS timestamp_epoch, d.owner_id AS d_owner, d.chunk_ids AS chunk_ids,
         row_number() OVER (PARTITION BY s.query_id, coalesce(d.id, '-' || s.id) ORDER BY {order}) AS first_
  FROM {source} s LEFT JOIN doc d ON s.parent_id <> '' AND s.parent_id = d.id AND d.content IS NOT NULL
), {name}_n AS (
  SELECT *, lower({nfkc("coalesce(content, '')")}) AS cl, lower({strip('normal')}) AS ql,
         list_distinct(list_transform({tokens(nfkc("coalesce(content, '')"))}, lambda t: lower(t))) AS ct
  FROM {name}_j WHERE first_ = 1 AND (NOT is_doc OR d_owner = {OWNER})
), {name} AS (SELECT *, fs0 + {bonus} AS fs, s0 + {bonus} AS s FROM {name}_n)"""


NEAR = f"coalesce(real_cos >= {CFG.vector_min_cos}, false)"
RESULTS = f"""main0 AS ({_scored('cand', f'CASE WHEN {NEAR} THEN real_cos ELSE 0.0 END')} WHERE {NEAR} OR bm25 IS NOT NULL),
{_resolved('main', 'main0', 's.s0 DESC, s.place')},
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, timestamp_epoch DESC NULLS LAST, id DESC) AS pos FROM main WHERE fs >= {CFG.min_score}),
vecs AS (
  SELECT k.query_id, k.pos, CAST(r.embedding AS DOUBLE[]) AS v FROM kept k JOIN rec r ON r.id = CASE WHEN k.is_doc THEN k.chunk_ids[1] ELSE k.id END
  WHERE r.embedding IS NOT NULL AND length(r.content) >= {CFG.version_min_chars}
), edges AS (SELECT a.query_id, a.pos AS a, b.pos AS b FROM vecs a JOIN vecs b USING (query_id) WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {CFG.version_sim_threshold}),
reach AS (SELECT query_id, a, b FROM edges UNION SELECT r.query_id, r.a, e.b FROM reach r JOIN edges e ON e.query_id = r.query_id AND e.a = r.b),
root AS (SELECT query_id, a AS pos, min(b) AS root, count(DISTINCT b) AS n FROM reach GROUP BY ALL),
grp AS (SELECT query_id, pos, dense_rank() OVER (PARTITION BY query_id ORDER BY root) AS version_group FROM root WHERE n > 1),
marked AS (
  SELECT k.*, g.version_group, row_number() OVER (PARTITION BY k.query_id, g.version_group ORDER BY k.pos) AS slot,
         row_number() OVER (PARTITION BY k.query_id, g.version_group ORDER BY k.timestamp_epoch DESC NULLS LAST, k.id DESC) AS age
  FROM kept k LEFT JOIN grp g ON g.query_id = k.query_id AND g.pos = k.pos
), moved AS (
  SELECT m.* EXCLUDE (pos, s, fs), CASE WHEN m.version_group IS NULL THEN m.pos ELSE o.pos END AS pos, CASE WHEN m.version_group IS NULL THEN m.s ELSE o.s END AS s,
         CASE WHEN m.version_group IS NULL THEN m.fs ELSE o.fs END AS fs
  FROM marked m LEFT JOIN marked o ON o.query_id = m.query_id AND o.version_group = m.version_group AND o.slot = m.age
), cut AS (
  SELECT * FROM (SELECT *, max(fs) OVER (PARTITION BY query_id) AS top FROM moved) WHERE version_group IS NOT NULL OR fs >= top * {CFG.relative_min_score_ratio}
), normal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM cut QUALIFY rank <= lim),
pool0 AS ({_scored('cand', 'coalesce(real_cos, 0.0)')}),
{_resolved('pool', 'pool0', 's.fs0 DESC, s.timestamp_epoch DESC NULLS LAST, s.id DESC')},
counts AS (SELECT query_id, count(*) AS n FROM normal GROUP BY ALL),
weak AS (
  SELECT p.*, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY p.query_id ORDER BY p.fs DESC, p.timestamp_epoch DESC NULLS LAST, p.id DESC) AS w
  FROM pool p LEFT JOIN counts c ON c.query_id = p.query_id
  WHERE p.fs >= 1e-6 AND {strip('asked')} <> '' AND NOT EXISTS (SELECT 1 FROM normal o WHERE o.query_id = p.query_id AND o.id = p.id)
  QUALIFY w <= least({CFG.min_results}, lim) - coalesce(c.n, 0)
), results AS (
  SELECT query_id, rank, false AS weak, id, is_doc, round(s, 6) AS score, round(fs, 6) AS filter_score, version_group FROM normal
  UNION ALL SELECT query_id, n + w, true, id, is_doc, round(s, 6), round(fs, 6), NULL FROM weak)"""

SAVED = """CASE WHEN timestamp_epoch IS NULL OR isnan(timestamp_epoch) OR abs(timestamp_epoch) >= 2.5e11 THEN 'unknown'
  ELSE strftime(make_timestamp(CAST(floor(timestamp_epoch) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') || ' (UTC+0000)' END"""


def _line(score: str) -> str:
    """A row's text, from id, content, turn_id, timestamp_epoch, is_doc and chunk_count."""
    return f"""'### ' || CASE WHEN is_doc THEN '[doc×' || CAST(coalesce(chunk_count, 0) AS VARCHAR) || '] ' ELSE '' END || '[' || id || ']'
  || CASE WHEN coalesce(turn_id, '') <> '' THEN ' turn=' || turn_id ELSE '' END || ' score=' || {score} || ' saved=' || {SAVED} || chr(10) || {purify("coalesce(content, '')")}"""


def _size(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + length({x}) - length(replace({x}, chr(10), '')))"


_GAP = "chr(10) || chr(10)"
_CUT = f"{_GAP} || {quoted(CUT_LINE)}"
BLOCKS = f"""shown AS (
  SELECT query_id, rank, false AS weak, id, is_doc, s, timestamp_epoch FROM normal
  UNION ALL SELECT query_id, n + w, true, id, is_doc, s, timestamp_epoch FROM weak
), told AS (
  SELECT s.*, CASE WHEN is_doc THEN d.content ELSE r.content END AS content, CASE WHEN is_doc THEN d.turn_id ELSE r.turn_id END AS turn_id, d.chunk_count
  FROM shown s LEFT JOIN doc d ON s.is_doc AND d.id = s.id LEFT JOIN rec r ON NOT s.is_doc AND r.id = s.id
), lines AS (SELECT query_id, rank, weak, {_line("printf('%.3f', s)")} AS line FROM told
), lists AS (
  SELECT query_id, coalesce(list(line ORDER BY rank) FILTER (NOT weak), []) AS main, coalesce(list(line ORDER BY rank) FILTER (weak), []) AS less FROM lines GROUP BY query_id
), tries AS (SELECT *, unnest(range(greatest(1, len(main) - {LEAST_ROWS} + 1))) AS omitted FROM lists
), bodies_ AS (
  SELECT query_id, omitted, CASE WHEN len(main) = 0 THEN {quoted(NO_HITS)} ELSE {quoted(VERSION_LINE)} || {_GAP} || array_to_string(main[1:len(main) - omitted], {quoted(BETWEEN)})
    || CASE WHEN omitted > 0 THEN {_GAP} || '_(' || omitted || ' lower-ranked match(es) omitted to keep this block within the context limit.)_' ELSE '' END END
    || CASE WHEN len(less) > 0 THEN {_GAP} || {quoted(WEAK_HEADING)} || {_GAP} || array_to_string(less, {_GAP}) ELSE '' END AS body
  FROM tries
), fitting AS (SELECT *, {_size('body')} + 2 <= {CFG.context_max_chars} AS fits, max(omitted) OVER (PARTITION BY query_id) AS most FROM bodies_
), chosen AS (SELECT * FROM fitting WHERE fits OR omitted = most QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY omitted) = 1
), chars AS (SELECT query_id, unnest(regexp_extract_all(body, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(body, '(?s).'), 1) AS i FROM chosen WHERE NOT fits
), room AS (
  SELECT query_id, ch, i, sum(CASE WHEN ch = chr(10) OR regexp_matches(ch, '[\\x{{10000}}-\\x{{10FFFF}}]') THEN 2 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY i) AS used FROM chars
), head AS (SELECT query_id, string_agg(ch, '' ORDER BY i) AS kept FROM room WHERE used <= {CFG.context_max_chars} - 2 - {_size('(' + _CUT + ')')} GROUP BY query_id
), blocks AS (
  SELECT a.query_id, coalesce(CASE WHEN c.fits THEN c.body ELSE regexp_replace(h.kept, '[{SPACES}]+\\z', '') || {_CUT} END, {quoted(NO_HITS)}) AS block
  FROM asked a LEFT JOIN chosen c USING (query_id) LEFT JOIN head h USING (query_id))"""

BODIES = "bodies AS (SELECT id, regexp_replace(content, '^\\[(user|claude)\\] ', '') AS t FROM doc WHERE content IS NOT NULL)"
CHUNKS = f"""cuts AS (
  SELECT id, t, 0 AS k, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS nxt FROM bodies
  UNION ALL
  SELECT id, t, k + 1, nxt, e, CASE WHEN e >= length(t) THEN length(t) + 1 WHEN soft THEN e ELSE greatest(nxt + 1, e - {CFG.chunk_overlap}) END
  FROM (
    SELECT id, t, k, nxt, CASE WHEN nxt + {CFG.chunk_threshold} >= length(t) THEN length(t) ELSE coalesce(lo + cut, nxt + {CFG.chunk_threshold}) END AS e, cut IS NOT NULL AS soft
    FROM (
      SELECT *, coalesce({", ".join(f"CASE WHEN contains(seg, {mark}) THEN length(seg) - instr(reverse(seg), reverse({mark})) + 1 END" for mark in ("chr(10) || chr(10)", "chr(10)", "'. '", "'! '", "'? '", "'。'", "'！'", "'？'", "'…'", "' '", "chr(9)"))}) AS cut
      FROM (SELECT id, t, k, nxt, greatest(nxt + 1, nxt + {CFG.chunk_threshold - CFG.chunk_overlap}) AS lo,
                   array_to_string(str_split(substr(t, greatest(nxt + 1, nxt + {CFG.chunk_threshold - CFG.chunk_overlap}) + 1, nxt + {CFG.chunk_threshold} - greatest(nxt + 1, nxt + {CFG.chunk_threshold - CFG.chunk_overlap})), ''), '') AS seg
            FROM cuts WHERE nxt < length(t) OR (k = 0 AND length(t) = 0))
    )
  )
), spans AS (
  SELECT *, max(k) OVER (PARTITION BY id) AS last FROM cuts WHERE k > 0
), merged AS (
  SELECT s.id, s.t, s.k, s.a, CASE WHEN s.k = s.last - 1 AND n.b - n.a < 20 THEN greatest(s.b, n.b) ELSE s.b END AS b
  FROM spans s LEFT JOIN spans n ON n.id = s.id AND n.k = s.k + 1 WHERE NOT (s.k = s.last AND s.last > 1 AND s.b - s.a < 20)
)"""

# A search's rows keep the place of the candidate they came from, which names the piece that hit.
# What has expired by then is neither refreshed nor kept.
SEARCH_HITS = f"""lrec AS (SELECT * FROM rec WHERE {LIVE}), ldoc AS (SELECT * FROM doc WHERE {LIVE}), hits AS (
  SELECT n.query_id, n.id, n.is_doc, CASE WHEN n.is_doc THEN f.id END AS chunk_id, f.id AS hit
  FROM normal n JOIN fused f ON f.query_id = n.query_id AND f.place = n.place WHERE n.rank <= {CFG.ttl_refresh_top_k}
), keys AS (
  SELECT hit AS id FROM hits UNION SELECT unnest(d.chunk_ids) FROM ldoc d WHERE d.id IN (SELECT id FROM hits WHERE is_doc)
), counted AS (SELECT hit AS id, count(*) AS n FROM hits GROUP BY ALL)"""

JUDGED = f"""calls0 AS (
  SELECT arrival, coalesce(agent_name, '') AS agent, CASE WHEN coalesce({strip('session_id')}, '') <> '' THEN session_id ELSE '' END AS session, {strip("coalesce(content, '')")} AS c, CASE WHEN importance IS NULL THEN 1.0 ELSE try_cast({strip('importance')} AS DOUBLE) END AS imp, coalesce(owner_id, '') AS owner,
         CASE WHEN role IN ('user', 'claude') THEN role END AS role, coalesce(turn_id, '') AS turn FROM incoming
), calls1 AS (
  SELECT *, {purify('c')} AS body,
         CASE WHEN imp IS NULL OR isnan(imp) OR isinf(imp) THEN 'error: importance' WHEN owner <> '' THEN 'error: owner' WHEN c = '' THEN 'error: empty'
              WHEN NOT regexp_matches(c, '[^{INVISIBLE}]') THEN 'error: invisible' END AS st
  FROM calls0
), calls2 AS (SELECT *, CASE WHEN role IS NULL THEN body ELSE '[' || role || '] ' || body END AS stored, length(body) > {CFG.chunk_threshold} AS is_doc FROM calls1),
calls3 AS (SELECT *, CASE WHEN st IS NULL THEN {guard('stored', "CASE WHEN role IS NULL THEN '' ELSE turn END", 'is_doc')} END AS guard_key FROM calls2),
judged AS (
  SELECT c.*, g.record_id, coalesce(c.st, CASE WHEN g.guard_key IS NOT NULL OR c.arrival > min(c.arrival) OVER (PARTITION BY c.guard_key) THEN 'duplicate' ELSE 'saved' END) AS status
  FROM calls3 c LEFT JOIN (SELECT guard_key, record_id FROM guards WHERE {LIVE}) g ON g.guard_key = c.guard_key)"""
NO_CODE = JUDGED.replace("'error: invisible' END", "'error: invisible' WHEN contains(c, '```') THEN 'skipped_code' END")

DOOMED = f"""doomed AS (SELECT id FROM held UNION SELECT id FROM whole),
ddoc AS (SELECT * FROM doc WHERE owner_id = {OWNER} AND id IN (SELECT id FROM doomed)),
dpiece AS (
  SELECT id AS doc, unnest(chunk_ids) AS id FROM ddoc WHERE len(chunk_ids) > 0
  UNION SELECT d.id, r.id FROM ddoc d JOIN rec r ON r.parent_id = d.id WHERE len(d.chunk_ids) = 0
), dsingle AS (SELECT * FROM rec WHERE owner_id = {OWNER} AND id IN (SELECT id FROM doomed) AND id NOT IN (SELECT id FROM doc)),
dead AS (SELECT id, {guard('content', 'turn_id', 'true')} AS guard_key FROM ddoc UNION ALL SELECT id, {guard('content', 'turn_id', 'false')} FROM dsingle WHERE parent_id = '')"""

RECALL = f"""rows_ AS (
  SELECT id, content, turn_id, coalesce(timestamp_epoch, 0.0) AS t_at, true AS is_doc FROM doc WHERE owner_id = {OWNER} AND content IS NOT NULL
  UNION ALL SELECT id, content, turn_id, coalesce(timestamp_epoch, 0.0), false FROM rec WHERE owner_id = {OWNER} AND content IS NOT NULL
    AND parent_id NOT IN (SELECT id FROM doc WHERE owner_id = {OWNER} AND content IS NOT NULL)
), wanted AS (SELECT min(turn_id) AS t FROM rec WHERE owner_id = {OWNER} AND coalesce(turn_id, '') <> ''),
placed AS (SELECT *, coalesce(turn_id = (SELECT t FROM wanted), false) AS is_hit, row_number() OVER (ORDER BY t_at, id) AS rn FROM rows_),
edge AS (SELECT min(rn) AS a, max(rn) AS b FROM placed WHERE is_hit)"""

MESSAGES = f"messages AS (SELECT id, session_id, turn_id, timestamp_epoch, regexp_extract(content, '{PREFIX}', 1) AS role FROM rec WHERE coalesce(session_id, '') <> '' AND regexp_matches(content, '{PREFIX}'))"
BEFORE = "OVER (PARTITION BY session_id ORDER BY timestamp_epoch NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SAVED_CALLS = f"""saved AS (
  SELECT *, printf('%012X', arrival) || '-' || left(sha1(stored), 12) AS id, greatest(0.5, least(2.0, imp)) AS weight FROM judged WHERE status = 'saved'
), bodies AS (SELECT id, body AS t FROM saved WHERE is_doc)"""
PIECES = """pieces AS (SELECT id, k - 1 AS no, id || '-' || printf('%05d', k) AS piece, substr(t, a + 1, b - a) AS text, count(*) OVER (PARTITION BY id) AS n FROM merged)"""

SESSION = f"""sess AS (SELECT DISTINCT session_id FROM held WHERE owner_id = {OWNER} AND {strip('session_id')} <> ''),
own AS (SELECT * FROM rec WHERE owner_id = {OWNER}),
sdoc AS (SELECT * FROM doc WHERE owner_id = {OWNER} AND session_id IN (SELECT session_id FROM sess)),
spiece AS (
  SELECT id, min(session_id) AS session_id FROM (
    SELECT session_id, unnest(chunk_ids) AS id FROM sdoc UNION SELECT d.session_id, o.id FROM sdoc d JOIN own o ON o.parent_id = d.id)
  WHERE id IN (SELECT id FROM rec) GROUP BY id
), lab AS (SELECT * FROM own WHERE session_id IN (SELECT session_id FROM sess) AND id NOT IN (SELECT id FROM spiece)),
cnt AS (
  SELECT session_id, 'd' AS k FROM sdoc UNION ALL SELECT session_id, 'c' FROM spiece
  UNION ALL SELECT session_id, 'c' FROM lab WHERE parent_id <> '' AND parent_id NOT IN (SELECT id FROM doc)
  UNION ALL SELECT session_id, 's' FROM lab WHERE parent_id = '')"""


def oracle_sql() -> dict[str, str]:
    legs = f"WITH {REC}, {ASKED}"
    near = f"{legs}, {VECTORS}, {KNN}"
    match = f"{legs}, {BM25}"
    fused = f"{near}, {BM25}, {FUSED}"
    cands = f"{fused}, {CANDS}"
    full = f"WITH RECURSIVE {REC}, {DOC}, {ASKED}, {VECTORS}, {KNN}, {BM25}, {FUSED}, {CANDS}, {RESULTS}"
    return {
        "text_purify": f"SELECT arrival, md5({purify('content')}) AS purified, length({purify('content')}) AS chars FROM incoming",
        "visible_filter": f"SELECT arrival FROM incoming WHERE regexp_matches(content, '[^{INVISIBLE}]')",
        "importance_clamp": f"""SELECT arrival, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE round(greatest(0.5, least(2.0, x)), 6) END AS clamped
            FROM (SELECT arrival, try_cast({strip('importance')} AS DOUBLE) AS x FROM incoming)""",
        "role_prefix": f"SELECT arrival, md5(CASE WHEN role IN ('user', 'claude') THEN '[' || role || '] ' || {purify('content')} ELSE {purify('content')} END) AS stored FROM incoming",
        "text_guard": f"WITH {REC}, {DOC} SELECT id, {guard('content', 'turn_id', 'false')} AS guard_key FROM rec WHERE parent_id = '' UNION ALL SELECT id, {guard('content', 'turn_id', 'true')} FROM doc",
        "text_tokens": f"WITH {REC}, n AS (SELECT id, {nfkc('content')} AS n FROM rec) SELECT id, array_to_string({tokens('n')}, ' ') AS tokens FROM n",
        "text_query_terms": f"WITH {ASKED} SELECT query_id, array_to_string(list_sort(terms), ' ') AS terms, len(terms) AS n FROM asked",
        "text_ngrams": f"WITH {REC}, n AS (SELECT id, {nfkc('content')} AS n FROM rec) SELECT id, array_to_string(list_transform({ngrams('n')}, lambda t: lower(t)), ' ') AS ngrams FROM n",
        "text_context_size": f"""WITH {REC} SELECT id, length(content) + length(regexp_replace(content, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))
            + length(content) - length(replace(content, chr(10), '')) AS size FROM rec""",
        "safe_session": f"WITH {REC} SELECT id, substr(regexp_replace(session_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64) AS safe FROM rec",
        "saved_times": f"WITH {REC} SELECT id, {SAVED} AS saved FROM rec",
        "time_bounds": f"""WITH {REC}, x AS (SELECT id, timestamp AS t, epoch_us(CAST(timestamp AS TIMESTAMPTZ)) / 1e6 AS e, epoch(CAST(left(timestamp, 10) AS DATE)) AS d FROM rec),
            forms AS (
              SELECT id, 'iso' AS form, e AS a, e AS b, t AS told FROM x UNION ALL SELECT id, 'spaced', e, e, replace(t, 'T', ' ') FROM x
              UNION ALL SELECT id, 'day', d, d + 86399.999999, left(t, 10) FROM x
              UNION ALL SELECT id, 'slashed', NULL, NULL, replace(left(t, 10), '-', '/') FROM x UNION ALL SELECT id, 'month', NULL, NULL, '2026-13-' || substr(t, 9, 2) FROM x)
            SELECT id, form, round(a, 3) AS since, round(b, 3) AS until, CASE WHEN told IS NULL THEN NULL
              WHEN a IS NULL THEN 'Error: since must be an ISO 8601 date or datetime (got ' || chr(39) || told || chr(39) || ')' WHEN a > 1769990399.999999 THEN 'Error: since is later than until' END AS error
            FROM forms""",
        "payload_prompts": """WITH c AS (SELECT arrival, content FROM incoming WHERE content IS NOT NULL), p AS (
              SELECT arrival, 'object' AS form, content AS prompt FROM c UNION ALL SELECT arrival, 'text', 'say: ' || content FROM c UNION ALL SELECT arrival, 'list', '[1, 2]' FROM c
              UNION ALL SELECT arrival, 'system', '  <system-reminder> ' || content FROM c UNION ALL SELECT arrival, 'bytes', content || chr(65533) FROM c)
            SELECT arrival, form, md5(prompt) AS prompt, starts_with(ltrim(prompt), '<system-reminder>') AS system FROM p""",
        "filled_calls": f"""SELECT arrival, CASE WHEN coalesce({strip('session_id')}, '') <> '' THEN session_id ELSE 'default' END AS session,
            CASE WHEN coalesce({strip('agent_name')}, '') <> '' THEN agent_name WHEN coalesce({strip('role')}, '') <> '' THEN {strip('role')} ELSE 'client' END AS agent,
            CASE WHEN regexp_matches(content, '[^{INVISIBLE}]') THEN md5('passage: ' || {nfkc('content')}) END AS passage FROM incoming""",
        "text_parts": "SELECT arrival, md5(content || chr(10) || role) AS text, md5(content) AS plain FROM incoming WHERE content IS NOT NULL AND role IS NOT NULL",
        "chunk_counts": f"WITH RECURSIVE {DOC}, {BODIES}, {CHUNKS} SELECT id, count(*) AS pieces, string_agg(a || '-' || b, ' ' ORDER BY k) AS spans FROM merged GROUP BY id",
        "query_vectors": f"WITH {ASKED}, {VECTORS} SELECT query_id, CAST(i AS BIGINT) AS place, round(qvec[i + 1], 6) AS x FROM qvec CROSS JOIN (SELECT unnest(range(16)) AS i)",
        "ingest_statuses": f"WITH {JUDGED} SELECT arrival, status, guard_key, CASE WHEN status = 'duplicate' THEN record_id END AS existing_id FROM judged",
        "ingest_without_code": f"WITH {NO_CODE} SELECT arrival, status FROM judged",
        "ingest_records": f"""WITH RECURSIVE {JUDGED}, {SAVED_CALLS}, {CHUNKS}, {PIECES}, texts AS (
            SELECT id, '' AS parent_id, stored AS content, agent, session, turn, weight FROM saved WHERE NOT is_doc
            UNION ALL SELECT p.piece, p.id, CASE WHEN s.role IS NULL THEN p.text WHEN p.n > 1 THEN '[' || s.role || ' ' || (p.no + 1) || '/' || p.n || '] ' || p.text ELSE '[' || s.role || '] ' || p.text END,
              s.agent, s.session, s.turn, s.weight FROM pieces p JOIN saved s ON s.id = p.id)
            SELECT id, parent_id, agent AS agent_name, session AS session_id, turn AS turn_id, '2026-01-27T07:46:40.000000+00:00' AS timestamp, 0 AS access_count, md5(content) AS content,
              round(weight, 6) AS importance, {NOW} + 604800.0 AS expires_at FROM texts""",
        "ingest_documents": f"""WITH RECURSIVE {JUDGED}, {SAVED_CALLS}, {CHUNKS}, {PIECES}
            SELECT s.id, md5(any_value(s.stored)) AS content, count(*) AS chunk_count, string_agg(p.piece, ' ' ORDER BY p.no) AS chunk_ids, {NOW} + 604800.0 AS expires_at
            FROM saved s JOIN pieces p ON p.id = s.id GROUP BY s.id""",
        "ingest_counts": f"WITH {JUDGED} SELECT status, count(*) AS calls FROM judged GROUP BY status",
        "dedup_exact": f"WITH {REC} SELECT min(id) AS id, count(*) AS copies FROM rec WHERE parent_id = '' GROUP BY sha1({nfkc('content')})",
        "knn_topk": f"{near} SELECT query_id, leg_rank, id, round(score, 6) AS score FROM knn",
        "bm25_topk": f"{match} SELECT query_id, leg_rank, id, round(score, 6) AS score FROM bm",
        "knn_owner_postfilter": f"{near} SELECT query_id, leg_rank, id, round(score, 6) AS score FROM knn WHERE id IN (SELECT id FROM rec WHERE owner_id = {OWNER})",
        "hybrid_fuse": f"{fused} SELECT query_id, id, round(real_cos, 6) AS real_cos, round(bm25, 6) AS bm25 FROM fused",
        "keyword_relevance": f"{cands} SELECT query_id, id, round(kw, 6) AS kw FROM cand",
        "fused_score": f"{cands}, x AS ({_scored('cand', 'coalesce(real_cos, 0.0)')}) SELECT query_id, id, round(fs0, 6) AS filter_score, round(s0, 6) AS score FROM x",
        "search_full": f"{full} SELECT * FROM results",
        "search_counts": f"{full} SELECT query_id, count(*) FILTER (NOT weak) AS normal, count(*) FILTER (weak) AS weak, count(*) FILTER (is_doc) AS documents FROM results GROUP BY query_id",
        "render_rows": f"""WITH {REC}, {DOC}, rows_ AS (SELECT id, content, turn_id, timestamp_epoch, false AS is_doc, 0 AS chunk_count FROM rec
            UNION ALL SELECT id, content, turn_id, timestamp_epoch, true, chunk_count FROM doc) SELECT id, is_doc, md5({_line("'0.500'")}) AS line FROM rows_""",
        "render_blocks": f"{full}, {BLOCKS} SELECT query_id, {_size('block')} AS size, md5(block) AS block FROM blocks",
        "record_neighbours": f"""WITH {REC}, v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM rec WHERE embedding IS NOT NULL),
            n AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a, v b WHERE CAST('0x' || right(a.id, 6) AS BIGINT) % 100 = 0)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS leg_rank, id, round(s, 6) AS score FROM n QUALIFY leg_rank <= 20""",
        "ttl_expired": f"WITH {REC} SELECT id FROM rec WHERE NOT {LIVE}",
        "time_window": f"WITH {REC} SELECT id, round(pow(2.0, -greatest(0.0, ({NOW} - timestamp_epoch) / 86400.0) / {CFG.half_life_days}), 6) AS decay FROM rec WHERE timestamp_epoch BETWEEN {NOW - 86400} AND {NOW}",
        "ttl_refresh": f"""{full}, {SEARCH_HITS} SELECT r.id, false AS is_doc, round(CASE WHEN r.id IN (SELECT id FROM keys) THEN {NOW + CFG.ttl_seconds} ELSE r.expires_at END, 3) AS expires_at,
            coalesce(r.access_count, 0) + coalesce(c.n, 0) AS access_count FROM lrec r LEFT JOIN counted c ON c.id = r.id
            UNION ALL SELECT id, true, round(CASE WHEN id IN (SELECT id FROM hits WHERE is_doc) THEN {NOW + CFG.ttl_seconds} ELSE expires_at END, 3), NULL FROM ldoc""",
        "ttl_refresh_guards": f"""{full}, {SEARCH_HITS}, renewed AS (
            SELECT {guard('content', 'turn_id', 'true')} AS guard_key, id FROM ldoc WHERE id IN (SELECT id FROM hits WHERE is_doc)
            UNION ALL SELECT {guard('content', 'turn_id', 'false')}, id FROM lrec WHERE parent_id = '' AND id IN (SELECT id FROM hits WHERE NOT is_doc))
            SELECT guard_key, record_id, round(expires_at, 3) AS expires_at FROM guards WHERE {LIVE} AND guard_key NOT IN (SELECT guard_key FROM renewed)
            UNION ALL SELECT guard_key, min(id), {NOW + CFG.ttl_seconds} FROM renewed GROUP BY guard_key""",
        "repair_counts": f"""WITH {LIVE_REC}, n AS (SELECT count(*) AS n FROM rec WHERE owner_id = {OWNER} AND embedding IS NULL AND content IS NOT NULL)
            SELECT least(n, {CFG.repair_batch}) AS reembedded, greatest(n - {CFG.repair_batch}, 0) AS remaining FROM n""",
        "repaired_vectors": f"""WITH {LIVE_REC}, asked AS (SELECT id AS query_id, {nfkc('content')} AS n_, content AS normal FROM rec WHERE owner_id = {OWNER} AND embedding IS NULL AND content IS NOT NULL ORDER BY id LIMIT {CFG.repair_batch}), {VECTORS}
            SELECT query_id AS id, CAST(i AS BIGINT) AS place, round(CAST(CAST(qvec[i + 1] AS FLOAT) AS DOUBLE), 4) AS x FROM qvec CROSS JOIN (SELECT unnest(range(16)) AS i)""",
        "list_newest": f"""WITH {LIVE_REC}, {LIVE_DOC}, both_ AS (
            (SELECT id, timestamp, false AS is_doc FROM rec WHERE owner_id = {OWNER} AND parent_id = '' ORDER BY timestamp_epoch DESC NULLS LAST, id DESC LIMIT 20)
            UNION ALL (SELECT id, timestamp, true FROM doc WHERE owner_id = {OWNER} AND content IS NOT NULL ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20))
            SELECT id, is_doc FROM both_ ORDER BY coalesce(timestamp, '') DESC, is_doc, id DESC LIMIT 20""",
        "list_preview": f"""WITH {LIVE_REC}, {LIVE_DOC}, both_ AS (
            (SELECT id, timestamp, false AS is_doc, content, 0 AS chunk_count FROM rec WHERE owner_id = {OWNER} AND parent_id = '' ORDER BY timestamp_epoch DESC NULLS LAST, id DESC LIMIT 20)
            UNION ALL (SELECT id, timestamp, true, content, coalesce(chunk_count, 0) FROM doc WHERE owner_id = {OWNER} AND content IS NOT NULL ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20)),
            shown AS (SELECT *, {purify("coalesce(content, '')")} AS body FROM both_ ORDER BY coalesce(timestamp, '') DESC, is_doc, id DESC LIMIT 20)
            SELECT id, is_doc, chunk_count, left(coalesce(timestamp, ''), 19) AS saved, md5(CASE WHEN is_doc AND length(body) > 200 THEN left(body, 200) || '…' ELSE body END) AS shown FROM shown""",
        "recall_slice": f"WITH {LIVE_REC}, {LIVE_DOC}, {RECALL} SELECT id, is_doc, is_hit FROM placed, edge WHERE rn BETWEEN a - 2 AND b + 2",
        "orphan_chunks": f"WITH {LIVE_REC}, {LIVE_DOC} SELECT id, parent_id FROM rec WHERE parent_id <> '' AND parent_id NOT IN (SELECT id FROM doc)",
        "guard_lookup": f"""WITH {REC}, {DOC}, own AS (SELECT id, {guard('content', 'turn_id', 'false')} AS guard_key FROM rec WHERE parent_id = '' UNION ALL SELECT id, {guard('content', 'turn_id', 'true')} FROM doc)
            SELECT o.id, g.record_id FROM own o JOIN guards g USING (guard_key) WHERE coalesce(g.expires_at > {NOW}, true)""",
        "delete_cascade": f"""WITH {LIVE_REC}, {LIVE_DOC}, {DOOMED} SELECT d.id, CASE WHEN d.id IN (SELECT id FROM ddoc) OR d.id IN (SELECT id FROM dsingle) THEN 'deleted' ELSE 'not_found' END AS status,
            (SELECT count(*) FROM dpiece p WHERE p.doc = d.id AND p.id IN (SELECT id FROM rec)) AS chunks FROM doomed d""",
        "delete_remaining": f"""WITH {LIVE_REC}, {LIVE_DOC}, {DOOMED} SELECT 'records' AS kind, (SELECT count(*) FROM rec WHERE id NOT IN (SELECT id FROM dpiece) AND id NOT IN (SELECT id FROM dsingle)) AS n
            UNION ALL SELECT 'documents', (SELECT count(*) FROM doc WHERE id NOT IN (SELECT id FROM ddoc))
            UNION ALL SELECT 'guards', (SELECT count(*) FROM guards g WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.guard_key = g.guard_key AND (coalesce(g.record_id, '') = '' OR g.record_id = d.id)))""",
        "delete_session_counts": f"""WITH {LIVE_REC}, {LIVE_DOC}, {SESSION} SELECT s.session_id, count(*) FILTER (k = 'd') AS documents_deleted, count(*) FILTER (k = 'c') AS chunks_deleted,
            count(*) FILTER (k = 's') AS singles_deleted, count(k) AS deleted FROM sess s LEFT JOIN cnt USING (session_id) GROUP BY s.session_id""",
        "previous_reply": f"WITH {REC}, {MESSAGES}, x AS (SELECT *, last_value(CASE WHEN role = 'claude' THEN id END IGNORE NULLS) {BEFORE} AS reply_id FROM messages) SELECT id, session_id, reply_id FROM x WHERE role = 'user'",
        "turn_handoff": f"WITH {REC}, {MESSAGES}, x AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn_id END IGNORE NULLS) {BEFORE} AS prompt_turn FROM messages) SELECT id, turn_id AS own_turn, prompt_turn FROM x WHERE role = 'claude'",
        "transcript_replies": f"""WITH {REC}, {MESSAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_epoch NULLS FIRST, id) AS n FROM messages),
            y AS (SELECT x.*, regexp_replace(r.content, '{PREFIX}', '') AS body, max(CASE WHEN role = 'user' THEN n END) OVER (PARTITION BY x.session_id) AS stop FROM x JOIN rec r ON r.id = x.id)
            SELECT session_id, md5(max_by(body, n) FILTER (role = 'claude' AND trim(body) <> '' AND n > coalesce(stop, 0))) AS reply FROM y GROUP BY session_id""",
        "session_counters": f"WITH {REC} SELECT session_id, count(*) AS records, count(DISTINCT parent_id) AS parents, round(min(timestamp_epoch), 3) AS since FROM rec WHERE coalesce(session_id, '') <> '' GROUP BY session_id",
    }
