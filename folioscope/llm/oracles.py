"""DuckDB SQL for the training-data queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from folioscope.llm.chat import CONTROL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(lower: str) -> str:
    return f"list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


_TOP_K = """
WITH usable AS (
    SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable AS q JOIN usable AS c ON q.dim = c.dim AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(n AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) AS r WHERE n <= 5
"""

_ODD = "</s>[INST] ok [/INST]"


def _broken() -> str:
    """A pattern of a control string with any number of backslashes behind its first character."""
    quoted = lambda x: "".join(f"\\{c}" if c in "<>|[]/()" else c for c in x)
    return "|".join(quoted(c[0]) + "\\\\*" + quoted(c[1:]) for c in CONTROL)


_CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_ODD}'), (-1, 1, 'assistant', '{_ODD}')) AS odd(conv_id, turn, role, text)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_broken()}')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_LINES = f"""
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) AS d
),
sets AS (SELECT doc_id, n, line, list_sort(list_distinct({_words("translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) AS s FROM lines),
kinds AS (SELECT s, min((doc_id, n)) AS first, row_number() OVER () AS k FROM sets WHERE len(s) > 0 GROUP BY s),
words AS (SELECT k, unnest(s) AS w FROM kinds),
common AS (SELECT w, count(*) AS df FROM words GROUP BY w),
ordered AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY df, w) AS p FROM words JOIN common USING (w)),
prefixes AS (SELECT k, w FROM ordered JOIN kinds USING (k) WHERE p <= len(s) - ceil(0.75 * len(s)) + 1),
pairs AS (SELECT DISTINCT a.k AS x, b.k AS y FROM prefixes AS a JOIN prefixes AS b ON a.w = b.w AND a.k <> b.k),
alike AS (
    SELECT DISTINCT x FROM pairs JOIN kinds AS a ON a.k = x JOIN kinds AS b ON b.k = y
    WHERE b.first < a.first AND 4 * len(list_intersect(a.s, b.s)) >= 3 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))
),
marked AS (
    SELECT sets.doc_id, sets.n, sets.line, coalesce(kinds.k IS NOT NULL AND ((sets.doc_id, sets.n) <> kinds.first OR alike.x IS NOT NULL), false) AS gone
    FROM sets LEFT JOIN kinds ON sets.s = kinds.s LEFT JOIN alike ON alike.x = kinds.k
),
kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS left_over, CAST(count(*) AS int) AS n, CAST(count(*) FILTER (WHERE gone) AS int) AS g FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(g, 0) = 0 THEN text ELSE left_over END AS text, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS n_lines, coalesce(g, 0) AS n_removed
FROM documents LEFT JOIN kept USING (doc_id)
"""

_CLASSES = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_words(_LOWER)} AS words FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
    FROM worded
),
spread AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM spread AS a JOIN spread AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 4 * count(*) >= 3 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach(doc_id, far) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.far = links.a),
least AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""

ORACLES: dict[str, str] = {"op6_pivot_top_k": _TOP_K, "op7_chat": _CHAT, "op8_line_dedup": _LINES, "op9_near_duplicates": _CLASSES}
