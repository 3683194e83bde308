"""SQL (DuckDB) that says the same as some of the queries, by all pairs and all windows."""

from __future__ import annotations

from .quality import BOILERPLATE, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Smallest id reachable over links (a, b), for the ids of `nodes`.
COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node),
  component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

VECTORS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
  {COMPONENTS}, n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN component ON node = vec_id"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  same AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM same JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same.n >= 85 * (p.n + q.n - same.n)),
  {COMPONENTS}
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component ON node = d.doc_id"""

REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(w) - 48)) AS t(i)),
  least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
  gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN least ON least.s = win.s AND lo < doc_id, unnest(range(50)) AS t(k)),
  each AS (SELECT w.doc_id, j, w.w[j] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(j)),
  kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.j) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j WHERE g.j IS NULL GROUP BY e.doc_id)
  SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

_BOILER = " OR ".join(f"contains(lower(x), '{phrase}')" for phrase in BOILERPLATE)
_COUNT = "len(regexp_extract_all(x, '[^ \\t\\n\\x0B\\f\\r]+'))"
_TOKENS = "string_split(x, ' ')"
_STUTTER = f"len(list_filter(range(1, len({_TOKENS}) - 3), lambda i: regexp_full_match({_TOKENS}[i], '[^ \\t\\n\\x0B\\f\\r]+') AND {' AND '.join(f'{_TOKENS}[i] = {_TOKENS}[i + {k}]' for k in range(1, 5))})) > 0"
_FAILS = (
    f"(len(regexp_extract_all(x, '[#*$%&|<>]')) * 100 > n * {RULES['max_line_symbol_percent']} OR len(regexp_extract_all(x, '[|»›•]')) * 100 > n * {RULES['max_line_separator_percent']}"
    f" OR (length(x) - length(replace(x, '!!', ''))) / 2 * 100 > n * {RULES['max_line_shout_percent']}"
    f" OR (length(x) < {RULES['max_boilerplate_chars']} AND ({_BOILER} OR (n < {RULES['min_unpunctuated_words']} AND NOT regexp_matches(x, '[.!?:;,…。][\"'')\\]»”]*[ \\t\\n\\x0B\\f\\r]*$')))) OR {_STUTTER})"
)
QUALITY = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(w) - 6)) AS t(i)),
  twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
  covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT win.doc_id, i + k AS j FROM win JOIN twice ON twice.doc_id = win.doc_id AND twice.s = win.s, unnest(range(8)) AS t(k)) GROUP BY 1),
  lines AS (SELECT doc_id, x, {_COUNT} AS n FROM w, unnest(string_split(text, chr(10))) AS t(x) WHERE regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')),
  per AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, coalesce(sum(n) FILTER (NOT {_FAILS}), 0) AS kept_words FROM lines GROUP BY 1),
  m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN per p ON p.doc_id = w.doc_id),
  b AS (SELECT *, n_words < {RULES['min_words']} OR 100 * n_repeat_words > {RULES['max_repeat_percent']} * n_words AS base_failed FROM m)
  SELECT *, NOT base_failed AND kept_words * 100 >= n_words * {RULES['min_kept_percent']} AS kept FROM b"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of an ASCII string: each byte is mixed in (elements from 0 on) and followed by eight shifts (elements of -1).
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(place) + 1), lambda k: [ord(place[k]), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""
#: Conversations repaired by one forward programme over turns: for each state (start, after s, u, a) the cheapest and then least edits.
TURNS = f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
  how AS (SELECT *, ({_CRC} % 20)::INTEGER AS h FROM src),
  hit AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM how WHERE h <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i, left(role, 1) AS c FROM hit),
  rows AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN trim(txt, {_WS}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(rtrim(txt, {_WS}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
  per AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
  put(q, p, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
    (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
  move(p, q, edit, c, cost, role) AS (VALUES (0, 0, 'D', NULL, 4, NULL), (1, 1, 'D', NULL, 4, NULL), (2, 2, 'D', NULL, 4, NULL), (3, 3, 'D', NULL, 4, NULL), (0, 1, 'K', 's', 0, NULL), (0, 2, 'K', 'u', 0, NULL), (1, 2, 'K', 'u', 0, NULL),
    (3, 2, 'K', 'u', 0, NULL), (2, 3, 'K', 'a', 0, NULL), (0, 2, 'R', NULL, 3, 'user'), (1, 2, 'R', NULL, 3, 'user'), (3, 2, 'R', NULL, 3, 'user'), (2, 3, 'R', NULL, 3, 'assistant')),
  best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM per
    UNION ALL SELECT b.conv_id, r.i, m.q, b.cost + put.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END AS spent, b.audit || put.audit || m.edit AS edits,
      b.lines || put.lines || CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.role, r.role) || ':' || r.txt] END AS lines
    FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN put ON put.q = b.q JOIN move m ON m.p = put.p AND (m.c IS NULL OR m.c = r.c) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    QUALIFY row_number() OVER (PARTITION BY b.conv_id, m.q ORDER BY spent, edits) = 1),
  done AS (SELECT p.*, b.cost + put.cost AS spent, b.audit || put.audit AS edits, array_to_string(b.lines || put.lines, chr(10)) AS said FROM per p JOIN best b ON b.conv_id IS NOT DISTINCT FROM p.conv_id AND b.i = p.n JOIN put ON put.q = b.q AND put.p IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY spent, edits) = 1)
  SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(spent, 0)::BIGINT AS cost,
    coalesce(edits, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLES = {"op2_pivot_near_dedup": VECTORS, "op5_minhash_near_dedup": NEAR, "op7_substring_dedup": REPEATS, "op8_quality_rules": QUALITY, "op11_turn_repair": TURNS}
