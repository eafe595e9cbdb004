"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
k AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
),
f AS (SELECT s, min(doc_id) AS earliest FROM k GROUP BY s),
gone AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS j
  FROM k JOIN f USING (s) WHERE k.doc_id > f.earliest
),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.j) AS t
  FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j
  GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

EXACT_TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: CAST(q.v[i] * c.v[i] AS BIGINT))) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

DECONTAMINATION = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^ 	-
]+') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ 	-
]+') AS w FROM documents WHERE text IS NOT NULL),
si AS (
  SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)
),
sd AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[j:j + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d JOIN (SELECT DISTINCT n FROM si) ON len(w) >= n)
),
t AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM si JOIN sd USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item,
       CAST(n_shared AS DOUBLE) / n_item AS containment
FROM c JOIN t USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

def _safe(c: str) -> str:
    return rf"replace(replace(replace({c}, '\', '\\'), '#', '\#'), '</', '<\/')"


CHAT_FORMAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
f AS (SELECT *, '### ' || replace({_safe('role')}, ':', '\:') || ': ' || {_safe('text')} || '</turn>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def _least(*found: str) -> str:
    return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"


def _insert(after: str, role: str) -> str:
    return f"{{'c': 3 + {after}.c, 'a': 'I' || {after}.a, 'o': list_prepend('{role}:', {after}.o)}}"


# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the next letter of the alternation and its role
_NEXT, _SAYS = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def _row(s: int) -> str:
    kept = {0: "CASE initial WHEN 's' THEN f1 WHEN 'u' THEN f2 END", 1: "CASE initial WHEN 'u' THEN f2 END"}
    k = kept.get(s, "CASE initial WHEN 'a' THEN f3 END" if s == 2 else "CASE initial WHEN 'u' THEN f2 END")
    n = f"f{_NEXT[s]}"
    return _least(
        f"{{'c': 4 + f{s}.c, 'a': 'D' || f{s}.a, 'o': f{s}.o}}",
        f"CASE WHEN NOT gone AND ({k}) IS NOT NULL THEN {{'c': cut + ({k}).c, 'a': 'K' || ({k}).a, 'o': list_prepend(role || ':' || text, ({k}).o)}} END",
        f"CASE WHEN NOT gone THEN {{'c': 3 + cut + {n}.c, 'a': 'R' || {n}.a, 'o': list_prepend('{_SAYS[s]}:' || text, {n}.o)}} END",
    )


def _closed(s: int) -> str:
    n = _NEXT[s]
    return _least(f"g{s}", _insert(f"g{n}", _SAYS[s]), _insert(f"({_insert(f'g{_NEXT[n]}', _SAYS[n])})", _SAYS[s]))


CHAT_REPAIR = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
       lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, j: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind
  FROM k
),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM c WHERE kind <> 0
),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn, substr(role, 1, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended
  FROM r
),
m AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair
  FROM n
),
e AS (
  SELECT conv_id, rn, role, text, initial, pair, turn, blank, duplicate, blank OR duplicate AS gone,
         CASE WHEN unended AND NOT blank AND NOT duplicate THEN 3 ELSE 0 END AS cut
  FROM m
),
w AS (
  SELECT conv_id, max(rn) + 1 AS rn, CAST({{'c': 0, 'a': '', 'o': []}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS f0,
         CAST({{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS f1,
         CAST({{'c': 3, 'a': 'I', 'o': ['assistant:']}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS f2,
         CAST({{'c': 0, 'a': '', 'o': []}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS f3
  FROM e GROUP BY conv_id
  UNION ALL
  SELECT conv_id, rn, {_closed(0)}, {_closed(1)}, {_closed(2)}, {_closed(3)}
  FROM (SELECT w.conv_id, e.rn, {_row(0)} AS g0, {_row(1)} AS g1, {_row(2)} AS g2, {_row(3)} AS g3
        FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.rn = w.rn - 1)
),
s AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE cut > 0) AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(w.f0.c, 0) AS BIGINT) AS cost, coalesce(w.f0.a, '') AS audit,
       sha256(coalesce(array_to_string(w.f0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.rn = 1
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_decontamination": DECONTAMINATION,
    "op5_exact_topk": EXACT_TOPK,
    "op11_chat_format": CHAT_FORMAT,
    "op12_chat_repair": CHAT_REPAIR,
}
