"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, gaps: str = SPACE) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{gaps}'), lambda x: x != '')"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def spread(name: str, source: str) -> str:
    """Words of each row as rows: (doc_id, word, pos)."""
    return f"{name} AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {source})"


JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words(lower("text"))} AS w FROM documents),
{spread("ws", "docs")},
runs AS (SELECT doc_id, string_agg(word, ' ') OVER five AS gram, count(*) OVER five AS n FROM ws WINDOW five AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
grams AS (SELECT DISTINCT doc_id, gram FROM runs WHERE n = 5 UNION SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

SUBSTRING = f"""
WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
{spread("ws", "docs")},
runs AS (SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER fifty) AS code, count(*) OVER fifty AS n FROM ws WINDOW fifty AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT code, min(doc_id) AS owner FROM runs WHERE n = 50 GROUP BY code),
marked AS (SELECT r.doc_id, r.pos, r.word, coalesce(f.owner < r.doc_id, false) AS hit FROM runs r LEFT JOIN firsts f ON f.code = r.code AND r.n = 50),
covered AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {words(lower("text"), NO_WORD)} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {words(lower("text"), NO_WORD)} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(w[i:i + 1], ' ') AS first, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM starts),
{spread("ws", "docs")},
twos AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS first FROM ws),
met AS (SELECT t.doc_id, t.pos, wins.item, wins.win, wins.n FROM twos t JOIN wins ON wins.first = t.first UNION ALL SELECT ws.doc_id, ws.pos, wins.item, wins.win, wins.n FROM ws JOIN wins ON wins.n = 1 AND wins.first = ws.word),
hits AS (SELECT m.doc_id, m.pos, m.n, m.item FROM met m JOIN docs d ON d.doc_id = m.doc_id WHERE array_to_string(d.w[m.pos:m.pos + m.n - 1], ' ') = m.win AND m.pos + m.n - 1 <= len(d.w)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {words(lower("text"), NO_TERM)} AS w FROM documents),
sizes AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tfs AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM docs) GROUP BY 1, 2),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({words(lower("text"), NO_TERM)}) AS term FROM benchmark),
weights AS (SELECT a.item_id, a.term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked a JOIN dfs USING (term), whole),
scored AS (SELECT w.item_id, s.row, s.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * s.n * n_docs) // n_terms))))::BIGINT AS score FROM weights w JOIN tfs t USING (term) JOIN sizes s USING (row), whole GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS owner FROM p),
fives AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i::INTEGER + 1, 5))::INTEGER) AS parts FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda v: substr('{BASE32}', (v >> 15) + 1, 1) || substr('{BASE32}', ((v >> 10) & 31) + 1, 1) || substr('{BASE32}', ((v >> 5) & 31) + 1, 1) || substr('{BASE32}', (v & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != owner THEN owner END AS refers_to FROM fives
"""

_PHRASES = " UNION ALL ".join(f"SELECT lang, word{''.join(f" || ' ' || lead(word, {j}) OVER piece" for j in range(1, k))} AS phrase, {k} AS len FROM ws WINDOW piece AS (PARTITION BY piece_no ORDER BY pos)" for k in range(1, 6))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, len, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS head, array_to_string(w[{k + 1}:], ' ') AS tail FROM cands WHERE len > {k}" for k in range(1, 5))

PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece_no, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x != '') AS w FROM pieces),
ws AS (SELECT lang, piece_no, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM numbered),
f AS MATERIALIZED (SELECT lang, phrase, len, count(*)::BIGINT AS a FROM ({_PHRASES}) WHERE phrase IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang || chr(31) || phrase AS key, a FROM f WHERE a >= 100),
cands AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND a >= 100),
cut AS ({_CUTS}),
ways AS (SELECT c.lang, c.phrase, c.len, c.a, c.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cut c JOIN often x ON x.key = c.lang || chr(31) || c.head JOIN often y ON y.key = c.lang || chr(31) || c.tail JOIN total t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM ways),
kept AS (SELECT lang, phrase, a, l, r, n, score FROM best b WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.lang = b.lang AND c.len > b.len AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op4_jaccard": JACCARD, "op7_substring": SUBSTRING, "op8_decontaminate": DECONTAMINATE, "op11_search": SEARCH, "op12_warc": WARC, "op13_phrases": PHRASES}
