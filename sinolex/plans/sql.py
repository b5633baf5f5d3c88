"""DuckDB fragments that restate expressions of the library for the oracle."""

from __future__ import annotations

from sinolex.functions import charset, predicates


class Fragment(str):
    """SQL with places for one expression. Braces of patterns stay as they are."""

    def of(self, expression: str) -> Fragment:
        return Fragment(self.replace("{0}", expression).replace("{}", expression))


WORDS = Fragment("list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x != '')")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def translate(tables: tuple[str, str]) -> Fragment:
    return Fragment(f"translate({{}}, {quote(tables[0])}, {quote(tables[1])})")


CONVERT = translate(charset.convert_table())
NORMALIZE = translate(charset.normalize_table())
OUTSIDE = "[^" + charset.ALLOWED.replace("\\xa0", "\\x{a0}").replace("\\u3000", "\\x{3000}") + "]"
MASK = Fragment(f"regexp_replace({{}}, '{OUTSIDE}', '{charset.UNKNOWN}', 'g')")
PREPROCESS = MASK.of(CONVERT)


def re2(pattern: str) -> str:
    """A pattern of the library in RE2: digits of any script, end of text."""
    return pattern.replace("(?U)", "").replace("\\d", "\\p{Nd}")


NUMBER, TIME = re2(predicates.NUMBER), re2(predicates.TIME)
SEPARATED = Fragment("({0} LIKE '%@%' OR {0} LIKE '%，%' OR {0} LIKE '%·%' OR {0} LIKE '%ん%')")
CHINESE = Fragment("regexp_matches({}, '[一-龥]')")
SINGLE = quote(predicates.SURNAMES)
DOUBLE = ", ".join(quote(s) for s in predicates.LONG_SURNAMES)
NAME = Fragment(f"coalesce(CASE length({{0}}) WHEN 2 THEN instr({SINGLE}, substr({{0}}, 1, 1)) > 0 WHEN 3 THEN instr({SINGLE}, substr({{0}}, 1, 1)) > 0 OR substr({{0}}, 1, 2) IN ({DOUBLE}) WHEN 4 THEN (instr({SINGLE}, substr({{0}}, 1, 1)) > 0 AND instr({SINGLE}, substr({{0}}, 2, 1)) > 0) OR substr({{0}}, 1, 2) IN ({DOUBLE}) ELSE false END, false)")
PLAIN = Fragment(f"NOT regexp_matches({{0}}, '{NUMBER}') AND NOT {{0}} LIKE '%百分之%' AND NOT regexp_matches({{0}}, '{TIME}')")


def tag_unigram(word: str, freq: str, word_max: int, trim: int, common: int = 500) -> str:
    return f"(length({word}) <= {word_max} AND {PLAIN.of(word)} AND (length({word}) = 1 OR NOT {SEPARATED.of(word)}) AND {freq} >= {trim} AND ({freq} >= {common} OR NOT {NAME.of(word)}))"


def unigram(word: str, freq: str | None, word_min: int, word_max: int, trim: int = 1, common: int = 500) -> str:
    """Without the need for a Chinese character."""
    good = f"length({word}) BETWEEN {word_min} AND {word_max} AND {PLAIN.of(word)} AND NOT {SEPARATED.of(word)}"
    return f"({good} AND NOT {NAME.of(word)})" if freq is None else f"({good} AND {freq} >= {trim} AND ({freq} >= {common} OR NOT {NAME.of(word)}))"


def hits(rule: str, boundary: str, core: str) -> str:
    """SELECT of (doc_id, s, b, e, t): what ``core`` matches between two ``boundary`` characters, as a check of the rules.

    RE2 has no look-around, so boundary characters are doubled (in ``core`` as well) and matches marked; a place is the
    length of what lies before it with pairs counted once, less the padding.
    """
    doubled = f"regexp_replace('￥' || text || '￥', '({boundary})', '\\1\\1', 'g')"
    marked = f"regexp_replace({doubled}, '({boundary})({core})({boundary})', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    size = f"(length(x) - length(regexp_replace(x, '{boundary.replace('[^', '[', 1)}', '', 'g')) / 2)"
    return (
        f"SELECT doc_id, substr(text, b + 1, n) AS s, b::INTEGER AS b, (b + n)::INTEGER AS e, '{rule}' AS t FROM (SELECT doc_id, text, k, n, (sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n - 1)::BIGINT AS b FROM "
        f"(SELECT doc_id, text, k, {size}::BIGINT AS n FROM (SELECT doc_id, text, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, text, string_split({marked}, chr(1)) AS p FROM documents)))) WHERE k % 2 = 0"
    )


def greedy(texts: str, words: str) -> str:
    """CTEs from ``texts`` (id, txt) and ``words`` (word) up to ``scan`` (id, b, n): longest words from the left."""
    return (
        f"places AS (SELECT id, txt, unnest(generate_series(1, length(txt))) AS i FROM {texts} WHERE length(txt) > 0), found AS (SELECT id, i - 1 AS b, max(k) AS n FROM places, (SELECT DISTINCT length(word) AS k FROM {words}) l WHERE i + k - 1 <= length(txt) AND substr(txt, i, k) IN (SELECT word FROM {words}) GROUP BY 1, 2), "
        "linked AS (SELECT m.id, m.b, m.n, x.b AS nb FROM found m ASOF LEFT JOIN found x ON m.id = x.id AND m.b + m.n <= x.b), "
        "scan AS (SELECT l.id, l.b, l.n, l.nb FROM linked l JOIN (SELECT id, min(b) AS b FROM linked GROUP BY id) f USING (id, b) UNION ALL SELECT l.id, l.b, l.n, l.nb FROM scan s JOIN linked l ON l.id = s.id AND l.b = s.nb)"
    )
