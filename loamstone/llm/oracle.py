"""SQL forms of the queries that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

from loamstone.llm.lookalikes import LOOKALIKES

P5_FOUND = r"""
WITH rows_ AS (
  SELECT DISTINCT session_id, nullif(turn_id, '') AS turn_id, coalesce(parent_id, '') AS parent_id, timestamp_epoch AS t_at,
         regexp_extract(content, '^\[(user|claude)( [0-9]+/[0-9]+)?\] ', 1) AS role,
         regexp_extract(content, '^\[(user|claude) ([0-9]+)/([0-9]+)\] ', 2) AS part,
         regexp_extract(content, '^\[(user|claude) ([0-9]+)/([0-9]+)\] ', 3) AS parts,
         regexp_replace(content, '^\[(user|claude)( [0-9]+/[0-9]+)?\] ', '') AS body, id
  FROM mem_records
  WHERE coalesce(session_id, '') <> '' AND regexp_matches(content, '^\[(user|claude)( [0-9]+/[0-9]+)?\] ')
), named AS (
  SELECT *, CASE WHEN parent_id <> '' THEN 'p' || parent_id WHEN part <> '' THEN 'i' || id ELSE 't' || body END AS message,
         CASE WHEN part <> '' THEN CAST(part AS INT) ELSE 1 END AS k, CASE WHEN part <> '' THEN CAST(parts AS INT) ELSE 1 END AS n,
         regexp_matches(body, '[^\s\p{Cc}\p{Cf}\p{Zs}\p{Zl}\p{Zp}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]') AS shows
  FROM rows_
), stored AS (
  SELECT session_id, turn_id, role, message, min(t_at) AS t_at, bool_or(shows) AS shows,
         min(n) = max(n) AND count(DISTINCT k) = max(n) AND min(k) = 1 AND max(k) = max(n) AS whole,
         string_agg(DISTINCT lpad(CAST(k AS VARCHAR), 6, '0') || body, chr(30) ORDER BY lpad(CAST(k AS VARCHAR), 6, '0') || body) AS text
  FROM named GROUP BY session_id, turn_id, role, message
), messages AS (
  SELECT session_id, turn_id, role, text, min(t_at) AS t_at, bool_and(shows AND whole) AS good FROM stored GROUP BY session_id, turn_id, role, text
), turns AS (
  SELECT session_id, turn_id,
         turn_id IS NOT NULL AND count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'claude') = 1 AND bool_and(good)
         AND coalesce(min(t_at) FILTER (role = 'user') < min(t_at) FILTER (role = 'claude'), false) AS fine
  FROM messages GROUP BY session_id, turn_id
)
SELECT session_id FROM turns GROUP BY session_id HAVING NOT bool_and(fine)
"""


# The same messages, with the pieces of each joined in order, each without what it repeats.
P5_CONVERSATIONS = P5_FOUND.replace("SELECT session_id FROM turns GROUP BY session_id HAVING NOT bool_and(fine)", r"""
, kept AS (SELECT session_id FROM turns GROUP BY session_id HAVING bool_and(fine)),
parts_ AS (SELECT session_id, turn_id, role, message, k, min(t_at) AS t_at, min(body) AS body FROM named WHERE session_id IN (SELECT session_id FROM kept) GROUP BY ALL),
lists AS (SELECT session_id, turn_id, role, message, min(t_at) AS t_at, list(body ORDER BY k) AS bodies FROM parts_ GROUP BY ALL),
joined AS (
  SELECT *, list_reduce(bodies, lambda a, b: a || substr(b, 1 + coalesce(list_max(list_filter(range(1, 1 + least(100, length(a), length(b))), lambda n: right(a, n) = left(b, n))), 0))) AS content
  FROM lists
), numbers AS (SELECT session_id, turn_id, row_number() OVER (PARTITION BY session_id ORDER BY t_at, turn_id) AS turn_no FROM joined WHERE role = 'user')
SELECT session_id, turn_no, turn_id, role AS speaker, content, t_at AS timestamp_epoch FROM joined JOIN numbers USING (session_id, turn_id)""")

# Every stored split is walked through all places at which its pieces can lie.
P1_FOUND = r"""
WITH RECURSIVE docs AS (
  SELECT id, regexp_replace(any_value(content), '^\[(user|claude)\] ', '') AS body, any_value(chunk_count) AS held, any_value(coalesce(chunk_ids, [])) AS ids
  FROM doc_records WHERE id IS NOT NULL GROUP BY id HAVING length(regexp_replace(any_value(content), '^\[(user|claude)\] ', '')) > 400
), named AS (SELECT id, unnest(ids) AS piece, generate_subscripts(ids, 1) AS no FROM docs),
pieces AS (
  SELECT DISTINCT n.id, n.no, regexp_replace(m.content, '^\[(user|claude)( [0-9]+/[0-9]+)?\] ', '') AS t FROM named n JOIN mem_records m ON m.id = n.piece AND m.parent_id = n.id
), backs AS (SELECT unnest(range(101)) AS back),
reach AS (
  SELECT id, 0 AS no, 0 AS stop FROM docs
  UNION
  SELECT r.id, r.no + 1, CAST(r.stop - b.back + length(p.t) AS INT)
  FROM reach r JOIN docs d ON d.id = r.id JOIN pieces p ON p.id = r.id AND p.no = r.no + 1 JOIN backs b ON b.back <= r.stop
  WHERE length(p.t) BETWEEN 1 AND 400 AND length(p.t) > b.back AND r.stop - b.back + length(p.t) <= length(d.body)
    AND substr(d.body, r.stop - b.back + 1, length(p.t)) = p.t
    AND NOT (r.no + 1 < len(d.ids) AND regexp_matches(substr(d.body, r.stop - b.back + length(p.t), 2), '^[\p{L}\p{N}]{2}$')
             AND regexp_matches(right(p.t, 100), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]'))
)
SELECT id FROM docs d WHERE NOT coalesce(len(ids) > 0 AND held = len(ids) AND EXISTS (SELECT 1 FROM reach r WHERE r.id = d.id AND r.no = len(d.ids) AND r.stop = length(d.body)), false)
"""

_PLAIN = "regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_ENTRY = r"^\s*(?:[-*•]\s+)?[^:=]+?\s*[:=]"


def _entries(separator: str) -> str:
    """The content's entries between separators; NULL unless there are two and all of them name a value."""
    parts = f"list_filter(regexp_split_to_array(trim(content, ' ' || chr(9) || chr(10) || chr(13)), '{separator}'), lambda x: trim(x) <> '')"
    return f"CASE WHEN len({parts}) > 1 AND len(list_filter({parts}, lambda x: NOT regexp_matches(x, '{_ENTRY}'))) = 0 THEN {parts} END"


_TOLD = "list_sort(list_transform({0}, lambda x: {1} || chr(31) || {2}))"
P2_FOUND = f"""
WITH RECURSIVE facts AS (
  SELECT id, lower(trim(any_value(owner_id), ' ')) AS owner, any_value(content) AS content FROM mem_records
  WHERE id IS NOT NULL AND coalesce(parent_id, '') = '' AND lower(trim(owner_id, ' ')) <> '' AND NOT regexp_matches(content, '^\\[(user|claude)( [0-9]+/[0-9]+)?\\] ') GROUP BY id
), split_ AS (
  SELECT *, {_PLAIN.format('content')} AS plain, CASE WHEN content LIKE '{{%' AND json_valid(content) THEN content END AS doc,
         coalesce({_entries('[\\r\\n]+')}, {_entries('\\s*[;]\\s*')}, {_entries('\\s*[|]\\s*')}) AS entries FROM facts
), told AS (
  SELECT id, owner, plain, CASE WHEN doc IS NOT NULL THEN CASE WHEN len(json_keys(doc)) > 1 THEN
           {_TOLD.format('json_keys(doc)', _PLAIN.format('x'), _PLAIN.format("json_extract_string(doc, '$.' || chr(34) || x || chr(34))"))} END
         WHEN entries IS NOT NULL THEN {_TOLD.format('entries', _PLAIN.format("regexp_extract(x, '^([^:=]*)[:=]', 1)"), _PLAIN.format("regexp_extract(x, '(?s)^[^:=]*[:=](.*)$', 1)"))} END AS fields
  FROM split_ WHERE plain <> ''
), nodes AS (
  SELECT id, owner || chr(29) || plain AS a, CASE WHEN fields IS NOT NULL THEN owner || chr(28) || array_to_string(fields, chr(30)) ELSE owner || chr(29) || plain END AS b FROM told
), edges AS (SELECT DISTINCT a AS x, b AS y FROM nodes UNION SELECT DISTINCT b, a FROM nodes),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
label AS (SELECT x, min(y) AS label FROM reach GROUP BY x),
sets AS (SELECT n.id, l.label, min(n.id) OVER (PARTITION BY l.label) AS least FROM nodes n JOIN label l ON l.x = n.a)
SELECT least AS id_a, id AS id_b FROM sets WHERE id <> least
"""

_SINGLE = {a: b for a, b in LOOKALIKES.items()}
_COMPOSED = {
    c: d for c, d in ((chr(k), unicodedata.normalize("NFC", "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", chr(k))))) for k in range(0x370, 0x530)) if c != d and len(d) == 1
}
_WIDE = {chr(k): unicodedata.normalize("NFKC", chr(k)) for k in range(0xFF01, 0xFFEF) if len(unicodedata.normalize("NFKC", chr(k))) == 1}
_MAP = _WIDE | _SINGLE | _COMPOSED
_PICTURE = r"\x{2190}-\x{2BFF}\x{1F000}-\x{10FFFF}\p{So}"
_JOIN = r"\x{200D}\x{FE0E}\x{FE0F}"
_HIDDEN = r"[\x00-\x08\x0d-\x1f\x7f-\x84\x86-\x9f\x{ad}\x{34f}\x{600}-\x{605}\x{61c}\x{6dd}\x{70f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}\x{200c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0d}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0001}\x{e0020}-\x{e007f}\x{e0100}-\x{e01ef}]"
P3_FOUND = f"""
WITH seen AS (
  SELECT arrival, content, regexp_replace(regexp_replace(content, '{_HIDDEN}', '', 'g'), '(^|[^{_PICTURE}{_JOIN}])[{_JOIN}]+', '\\1', 'g') AS shown FROM incoming
  WHERE regexp_matches(content, '[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}\\x{{2800}}]') AND regexp_replace(content, '{_HIDDEN}|[{_JOIN}\\s\\p{{Z}}\\x{{85}}\\x{{2800}}]', '', 'g') <> ''
), formed AS (
  SELECT arrival, content, nfc_normalize(translate(nfc_normalize(translate(regexp_replace(shown, '\\p{{Zs}}', ' ', 'g'), '{"".join(_WIDE)}', '{"".join(_WIDE.values()).replace("'", "''")}')), '{"".join(_MAP)}', '{"".join(_MAP.values()).replace("'", "''")}')) AS form FROM seen
)
SELECT a.arrival AS arrival_a, b.arrival AS arrival_b FROM formed a JOIN formed b ON a.form = b.form AND a.arrival < b.arrival AND a.content <> b.content
"""

P4_FOUND = r"""
WITH rows_ AS (
  SELECT id, any_value(timestamp_epoch) AS t_at, list_distinct(regexp_extract_all(lower(any_value(content)), '([\p{L}\p{N}]+)', 1)) AS words FROM mem_records
  WHERE id IS NOT NULL AND timestamp_epoch IS NOT NULL AND coalesce(parent_id, '') = '' AND length(content) >= 100 GROUP BY id
), sized AS (SELECT *, len(words) AS n FROM rows_ WHERE len(words) > 0),
met AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS n, len(list_intersect(a.words, b.words)) AS both_
  FROM sized a JOIN sized b ON a.id < b.id AND abs(a.t_at - b.t_at) <= 604800 AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
)
SELECT id_a, id_b FROM met WHERE both_ >= 0.8 * (n - both_) - 1e-9
"""


P2_COLLAPSED = P2_FOUND.replace("SELECT least AS id_a, id AS id_b FROM sets WHERE id <> least", "SELECT least AS id, count(*) AS copies FROM sets GROUP BY least")


def _forms(key: str, source: str) -> str:
    """The form of every content of a table, also of those that show nothing."""
    whole = P3_FOUND[: P3_FOUND.index(" FROM incoming")] + f" FROM {source}\n)" + P3_FOUND[P3_FOUND.index(", formed AS") : P3_FOUND.index("SELECT a.arrival")]
    return whole.replace("arrival", key) + f"SELECT {key}, form AS canonical FROM formed"


P4_GROUPS = f"""WITH RECURSIVE{P4_FOUND.replace("WITH", "", 1).replace("SELECT id_a, id_b FROM met", ", pairs AS (SELECT id_a, id_b FROM met")}),
edges AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
groups_ AS (SELECT x AS id, min(y) AS group_id FROM reach GROUP BY x)
SELECT id, group_id, last(id) OVER w AS newest_id, count(*) OVER (PARTITION BY group_id) AS members FROM groups_ JOIN rows_ USING (id)
WINDOW w AS (PARTITION BY group_id ORDER BY t_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_collapsed": P2_COLLAPSED, "p3_found": P3_FOUND, "p3_incoming": _forms("arrival", "incoming"),
        "p3_records": _forms("id", "(SELECT id, any_value(content) AS content FROM mem_records WHERE id IS NOT NULL GROUP BY id)"), "p4_found": P4_FOUND, "p4_groups": P4_GROUPS,
        "p5_found": P5_FOUND, "p5_conversations": P5_CONVERSATIONS,
    }
