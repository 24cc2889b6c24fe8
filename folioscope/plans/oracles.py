"""The same results as DuckDB SQL, written apart from the operators; fixed values are shared."""

from __future__ import annotations

import re

from folioscope.functions import rules
from folioscope.functions.text import DASHES, STOP_WORDS
from folioscope.operators import search
from folioscope.plans import figure_queries, passage_queries
from folioscope.plans.queries import ASK, ASKED, HEADERS
from folioscope.sources.corpora import PROSE, WORDS, manual_sql


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({x}, '')), '{DASHES}', '------'), '[_\\-./()\\[\\]{{}}:;,=+*<>|]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _symbol(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9_]', '', 'g')"


_STOP = "[" + ", ".join(map(_q, STOP_WORDS)) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def _word(flat: str, term: str) -> str:
    return f"len(regexp_extract_all({flat}, '\\b{term}\\b'))"


def _loose(flat: str, term: str) -> str:
    return f"CAST((length({flat}) - length(replace({flat}, '{term}', ''))) / {len(term)} AS int)"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _all(x: str, patterns) -> str:
    return "(" + " AND ".join(_has(x, p) for p in patterns) + ")"


def _first(x: str, pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_all(x, p if isinstance(p, tuple) else (p,))} THEN '{k}'" for k, p in pairs) + f" ELSE '{other}' END"


def _manual(*kinds: str) -> str:
    where = f" WHERE kind IN ({', '.join(map(_q, kinds))})" if kinds else ""
    return f"(SELECT * FROM ({manual_sql()}) AS m{where})"


def _group(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, {_q(pattern)}, {i})"


_QUERY = search.Query(ASK)


def _lexical(query: search.Query, text: str = "text") -> str:
    flat, parts = "flat", [f"CASE WHEN contains(flat, {_q(query.phrase)}) THEN 70 ELSE 0 END"]
    parts += [f"CASE WHEN contains(symbol, {_q(s)}) THEN 25 ELSE 0 END" for s in query.symbols]
    parts += [f"10 * {_word(flat, t)} + 2 * {_loose(flat, t)}" for t in query.terms]
    parts += [f"CASE WHEN {_has(text, p)} THEN {n} ELSE 0 END" for p, n in search.VOCABULARY]
    return "CAST(" + " + ".join(parts) + " AS int)"


def _scored(query: search.Query) -> str:
    return f"(SELECT filename, page, text, flat, {_lexical(query)} AS score FROM (SELECT *, {_norm('text')} AS flat, {_symbol('text')} AS symbol FROM ({PROSE}) AS p) AS s)"


_TERMS = "[" + ", ".join(map(_q, _QUERY.terms + _QUERY.expanded)) + "]"
_WEIGHT = "CASE term " + " ".join(f"WHEN '{t}' THEN {_QUERY.weight(t)}" for t in _QUERY.terms + _QUERY.expanded) + " END"
_BM25 = f"""SELECT filename, page, CAST(floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * ({search.K1} + 1) / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))) * {_WEIGHT}) * {search.BM25_WEIGHT} + 0.5) AS int) AS bm25, CAST(count(*) AS int) AS hits
FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT filename, page, dl, term, count(*) AS tf FROM (SELECT filename, page, len(toks) AS dl, unnest(toks) AS term FROM (SELECT filename, page, {_tokens('text')} AS toks FROM ({PROSE}) AS p) AS a) AS b WHERE list_contains({_TERMS}, term) GROUP BY ALL) AS c) AS tf,
(SELECT greatest(count(*), 1) AS n, greatest(avg(len({_tokens('text')})), 1.0) AS avgdl FROM ({PROSE}) AS p) AS stats GROUP BY filename, page"""
_IMPORTANT = "[" + ", ".join(map(_q, _QUERY.important)) + "]"
_HITS = f"""(SELECT * FROM (SELECT filename, page, term, place, row_number() OVER (PARTITION BY filename, page, term ORDER BY place) AS n FROM (SELECT filename, page, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM (SELECT filename, page, {_tokens('text')} AS toks FROM ({PROSE}) AS p) AS a) AS b WHERE list_contains({_IMPORTANT}, term)) AS c WHERE n <= {search.POSITIONS})"""
_PROXIMITY = f"""SELECT a.filename, a.page, CAST(count(*) AS int) AS pairs, CAST(floor(least(120.0, count(*) * 8 + ({search.WINDOW} - min(abs(a.place - b.place))) * {search.WINDOW_WEIGHT} / {search.WINDOW}) + 0.5) AS int) AS proximity
FROM {_HITS} AS a JOIN {_HITS} AS b ON a.filename = b.filename AND a.page = b.page AND b.term > a.term AND abs(a.place - b.place) <= {search.WINDOW} GROUP BY a.filename, a.page"""
_COVERAGE = "CAST(floor(120.0 * (" + " + ".join(f"CASE WHEN {_has('flat', rf'\b{re.escape(t)}\b')} THEN 1 ELSE 0 END" for t in _QUERY.important) + f") / {max(1, len(_QUERY.important))} + 0.5) AS int)"
_HYBRID = f"""SELECT filename, page, CAST(score + coverage + phrase + coalesce(bm25, 0) + coalesce(proximity, 0) AS int) AS score, score AS lexical, coalesce(bm25, 0) AS bm25, coalesce(proximity, 0) AS proximity, coverage
FROM (SELECT filename, page, score, {_COVERAGE} AS coverage, CASE WHEN contains(flat, {_q(_QUERY.phrase)}) THEN 130 ELSE 0 END AS phrase FROM {_scored(_QUERY)} AS s) AS l LEFT JOIN ({_BM25}) AS b USING (filename, page) LEFT JOIN ({_PROXIMITY}) AS x USING (filename, page)
WHERE score + coverage + phrase + coalesce(bm25, 0) + coalesce(proximity, 0) >= {search.MIN_SCORE} ORDER BY 3 DESC, 1, 2 LIMIT 40"""

# --- sections -----------------------------------------------------------------------------------
_TITLE = r"substr(trim(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '[.·•]+$', '')), 1, 240)"


def _section_case(column: int) -> str:
    out = []
    for row in rules.SECTION_TYPES:
        name, level, sure, pattern = row
        value = (f"'{'topic' if name == 'register_topic' else name}'", "len(string_split(regexp_extract(title, '^\\d+(?:\\.\\d+)*', 0), '.'))" if level < 0 else str(level), str(sure))[column]
        out.append(f"WHEN {_has('title', pattern)} THEN {value}")
    return "CASE " + " ".join(out) + " END"


def _sections(*kinds: str) -> str:
    inner = f"SELECT filename, page, pos, line, {_TITLE} AS title FROM {_manual(*kinds)} AS x"
    typed = f"SELECT filename, page, pos, line AS title, {_section_case(0)} AS type, CAST({_section_case(1)} AS int) AS level, {_section_case(2)} AS confidence FROM ({inner}) AS y WHERE length(title) >= 4 AND NOT {_has('title', rules.SECTION_NOISE)}"
    one = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, page, lower(title) ORDER BY confidence DESC, pos) AS n FROM ({typed}) AS z WHERE type IS NOT NULL) AS w WHERE n = 1"
    return f"(SELECT concat(filename, ':s', row_number() OVER (PARTITION BY filename ORDER BY page, pos)) AS section_id, filename, page, pos, title, type, level, confidence FROM ({one}) AS v)"


# --- chunk types --------------------------------------------------------------------------------


def _typed() -> str:
    pages = f"parts AS (SELECT filename, page, 0 AS chunk_index, string_agg(line, chr(10) ORDER BY pos) AS text FROM {_manual()} AS x GROUP BY filename, page)"
    return f"(SELECT * EXCLUDE (chunk_index) FROM ({passage_queries.kinds_sql(pages)}) AS k)"


_CHUNKS = f"""WITH RECURSIVE p AS (SELECT filename, page, text FROM ({PROSE}) AS d WHERE text <> ''),
c(filename, page, text, start, stop) AS (
  SELECT filename, page, text, 0, CASE WHEN length(text) <= 2600 THEN length(text) ELSE NULL END FROM p
  UNION ALL
  SELECT filename, page, text, start2, NULL FROM (SELECT filename, page, text, greatest(0, e - 450) AS start2, e FROM (SELECT *, {{end}} AS e FROM c) AS x WHERE e < length(text)) AS y)
SELECT filename, page, CAST(row_number() OVER (PARTITION BY filename, page ORDER BY start) - 1 AS int) AS chunk_index, length(t) AS n_chars, md5(t) AS digest FROM (SELECT filename, page, start, CASE WHEN length(text) <= 2600 THEN text ELSE regexp_replace(substr(text, start + 1, e - start), '^\\s+|\\s+$', '', 'g') END AS t FROM (SELECT *, {{end}} AS e FROM c) AS z) AS w WHERE t <> ''"""


def _chunk_sql() -> str:
    piece = "substr(text, start + 1, 2600)"
    breaks = ["chr(10) || chr(10)", "chr(10)", "'. '", "'; '", "': '"]
    last = ", ".join(f"CASE WHEN contains({piece}, {b}) THEN length({piece}) - strpos(reverse({piece}), reverse({b})) - length({b}) + 1 ELSE -1 END" for b in breaks)
    end = f"CASE WHEN start + 2600 >= length(text) THEN length(text) WHEN greatest({last}) > 2600 * 0.55 THEN start + greatest({last}) + 1 ELSE start + 2600 END"
    return _CHUNKS.replace("{end}", end)


# --- registers and bit fields -------------------------------------------------------------------
_PY_ROW = rules.REGISTER_ROW


def _list_rows(*kinds: str) -> str:
    g = lambda i: f"trim({_group('line', _PY_ROW, i)})"
    return f"(SELECT * FROM (SELECT filename, page, pos, {g(2)} AS name, regexp_replace({g(1)}, '\\s+', ' ', 'g') AS description, {g(3)} AS initial_value, regexp_replace({g(4)}, '\\s+', ' ', 'g') AS \"offset\", {g(5)} AS access_size FROM {_manual(*kinds)} AS x WHERE {_has('line', _PY_ROW)}) AS y WHERE lower(description) NOT IN ('reserve', ''))"


_SYMBOLS = f"(SELECT * FROM (SELECT DISTINCT filename, page, pos, unnest(regexp_extract_all(line, {_q(rules.REGISTER_SYMBOL)})) AS name FROM {_manual('register', 'bit', 'step', 'caution')} AS x) AS y WHERE length({_symbol('name')}) BETWEEN 3 AND 80 AND {_symbol('name')} NOT IN ({', '.join(map(_q, rules.NOT_REGISTERS))}) AND {_has(_symbol('name'), rules.REGISTER_NAME)})"
_REGISTERS = f"""(SELECT *, CAST(greatest(1, least(99, floor(least(55.0, points / occurrences) + least(18, occurrences * 2) + least(8, pages) + 25 * explicit + 0.5))) AS int) AS confidence FROM (
SELECT filename, {_symbol('name')} AS canonical, min(name) AS name, count(*) AS occurrences, CAST(sum(points) AS bigint) AS points, count(DISTINCT page) AS pages, min(page) AS first_page, min(description) AS description, min(access_size) AS access_size, max(explicit) AS explicit FROM (
SELECT filename, page, name, description, access_size, 1 AS explicit, 90 AS points FROM {_list_rows('register', 'bit', 'step', 'caution')} AS l UNION ALL SELECT filename, page, name, NULL, NULL, 0, 10 FROM {_SYMBOLS} AS s) AS u GROUP BY filename, {_symbol('name')}) AS v)"""
_BARE = _symbol("regexp_replace(regexp_replace(name, '(?i)^[A-Z0-9]+m_', ''), '(?i)^(GBETH|ETH|GMAC|WDT|GPT|POEG|ICU)_', '')")
_KNOWN = f"list_filter([{_symbol('name')}, {_BARE}, " + ", ".join(f"CASE WHEN starts_with({_BARE}, '{re.sub('[^A-Z0-9_]', '', p.upper())}') THEN NULL ELSE concat('{re.sub('[^A-Z0-9_]', '', p.upper())}', {_BARE}) END" for p in rules.ALIAS_PREFIXES) + "], lambda t: t IS NOT NULL AND t <> '')"

_HEAD = r"^(\d{1,3}(?:\s*(?:to|:|-)\s*\d{1,3})?)\s+([A-Z][A-Z0-9_]{1,31})(?:\s*\[\s*(\d{1,3}\s*:\s*\d{1,3})\s*\])?\s+(\S+)\s"


def _range(x: str) -> str:
    flat = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[−–—-]|to', ':', 'g'), 'bits?|[()\\[\\]\\s]', '', 'g')"
    g = lambda i: f"regexp_extract({flat}, '^(\\d{{1,3}})(?::(\\d{{1,3}}))?$', {i})"
    return f"CASE WHEN {g(1)} = '' THEN 'unknown' WHEN {g(2)} = '' THEN CAST(CAST({g(1)} AS int) AS varchar) ELSE concat(CAST({g(1)} AS int), ':', CAST({g(2)} AS int)) END"


_ACCESS = "CASE regexp_replace(upper(" + _group("line", rules.ACCESS_WORD, 1) + "), '\\s+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ACCESS.items()) + " ELSE 'unknown' END"
_RESET_RAW = f"trim({_group('line', _HEAD, 4)})"
_RESET = f"CASE WHEN {_RESET_RAW} = '' OR lower(replace({_RESET_RAW}, '_', '')) IN ('-', 'undefined', 'reserved') THEN 'unknown' WHEN regexp_matches(lower(replace({_RESET_RAW}, '_', '')), '^0+[hb]?$') THEN '0' WHEN regexp_matches(lower(replace({_RESET_RAW}, '_', '')), '^1+b$') OR {_RESET_RAW} = '1' THEN '1' ELSE {_RESET_RAW} END"


def _bit_rows(*kinds: str) -> str:
    g = lambda i: _group("line", _HEAD, i)
    return f"(SELECT * FROM (SELECT filename, page, pos, {_group('line', rules.REGISTER_SYMBOL, 0)} AS register, {g(2)} AS bitfield, {_range(g(1))} AS position, {_range(g(3))} AS field_range, {_ACCESS} AS access, {_RESET} AS reset FROM {_manual(*kinds)} AS x WHERE {_has('line', _HEAD)}) AS y WHERE register <> '' AND regexp_replace(upper(bitfield), '[^A-Z0-9]', '', 'g') NOT IN ('NOTE', 'TABLE', 'FIGURE', 'BIT', 'BITS', 'NAME', 'READ', 'WRITE', 'RESERVED', 'DESCRIPTION', 'RESET', 'CPU', 'RAM', 'GLOBAL'))"


_ATTRS = ("position", "field_range", "access", "reset")
_FIELDS = f"(SELECT filename, register, bitfield, {', '.join(f'''coalesce(arg_min({c}, page * 1000000 + pos) FILTER (WHERE {c} <> 'unknown'), 'unknown') AS {c}''' for c in _ATTRS)}, count(*) AS lines, {' + '.join(f'''CASE WHEN count(DISTINCT {c}) FILTER (WHERE {c} <> 'unknown') > 1 THEN 1 ELSE 0 END''' for c in _ATTRS)} AS conflicts FROM {_bit_rows('bit')} AS x GROUP BY filename, register, bitfield)"


def _bounds(c: str, p: str) -> str:
    a, b = f"TRY_CAST(string_split({c}, ':')[1] AS int)", f"coalesce(TRY_CAST(string_split({c}, ':')[2] AS int), TRY_CAST(string_split({c}, ':')[1] AS int))"
    return f"greatest({a}, {b}) AS {p}_high, least({a}, {b}) AS {p}_low"


_AT = f"(SELECT *, {_bounds('position', 'at')}, {_bounds('field_range', 'own')} FROM {_FIELDS} AS f)"
_VALID = f"""(SELECT *, concat_ws('; ', CASE WHEN at_high IS NULL THEN 'position' END, CASE WHEN access = 'unknown' THEN 'access' END, CASE WHEN reset = 'unknown' THEN 'reset' END, CASE WHEN conflicts > 0 THEN 'conflict' END, CASE WHEN at_high >= register_width THEN 'beyond register' END, CASE WHEN at_high - at_low <> own_high - own_low THEN 'width' END, CASE WHEN at_high IS NOT NULL AND regexp_matches(reset, '^[0-9]+h$') AND CAST(concat('0x', rtrim(reset, 'h')) AS bigint) >= pow(2, at_high - at_low + 1) THEN 'reset too large' END) AS issues
FROM {_AT} AS a LEFT JOIN (SELECT filename, name AS register, TRY_CAST(regexp_extract(min(access_size), '\\b(8|16|32|64|128)\\b', 1) AS int) AS register_width FROM {_list_rows('register')} AS l GROUP BY filename, name) AS w USING (filename, register))"""

_ASKED = "(" + ASKED.replace("{lines}", f"{_manual('bit')} AS l") + ")"


def _hardware(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def _stands(name: str, text: str) -> str:
    return f"(CASE WHEN contains(lower({text}), lower({name})) THEN regexp_matches({text}, concat('(?i)(^|[^A-Za-z0-9_])\\Q', {name}, '\\E([^A-Za-z0-9_]|$)')) ELSE false END)"


#: The registers of the given tables have no module prefix that an alias is made for, so a bare name and its prefixes are all.
_BARE = "regexp_replace(regexp_replace(upper(regexp_replace(name, '(?i)^[A-Z0-9]+m_', '')), '[^A-Z0-9_]', '', 'g'), '(?i)^(GBETH|ETH|GMAC|WDT|GPT|POEG|ICU)_', '')"
_NAMES = f"list_concat([name, {_symbol('name')}, {_BARE}], [" + ", ".join(f"concat({_q(p)}, {_BARE})" for p in rules.ALIAS_PREFIXES) + "])"
_POINTS = f"""35 + CASE WHEN starts_with({_hardware('name')}, 'PRTM') THEN 25 ELSE 0 END + CASE WHEN explicit = 1 THEN 20 ELSE 0 END
+ CASE WHEN {_stands('name', 'heading')} THEN 220 WHEN {_stands('name', 'evidence')} THEN 170 WHEN len(list_filter({_NAMES}, lambda x: {_stands('x', 'evidence')})) > 0 THEN 100
WHEN len(list_filter({_NAMES}, lambda x: contains({_hardware('evidence')}, {_hardware('x')}))) > 0 THEN 70 ELSE 0 END"""
_SCORED_NAMES = f"SELECT a.filename, a.page, a.pos, name, {_POINTS} AS points FROM (SELECT * FROM {_ASKED} AS q WHERE source = 'PRTM_BASE') AS a JOIN {_REGISTERS} AS r ON a.filename = r.filename AND a.page = r.first_page"
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER w AS n, lead(points) OVER w AS nxt FROM ({_SCORED_NAMES}) AS s WINDOW w AS (PARTITION BY filename, page, pos ORDER BY points DESC, lower(name), name)) AS r WHERE n = 1)"
_SURE = "coalesce(points >= 70 AND (nxt IS NULL OR points - nxt >= 15), false)"
_MAPPING = f"""SELECT a.filename, a.page, a.pos, CASE WHEN source <> 'PRTM_BASE' THEN source WHEN {_SURE} THEN name ELSE source END AS register, CASE WHEN source <> 'PRTM_BASE' THEN 'direct' WHEN {_SURE} THEN 'resolved' ELSE 'unresolved' END AS status,
CASE WHEN source <> 'PRTM_BASE' THEN 100 ELSE least(100, coalesce(points, 0)) END AS confidence, CASE WHEN source <> 'PRTM_BASE' THEN source ELSE name END AS best FROM {_ASKED} AS a LEFT JOIN {_BEST} AS b ON a.filename = b.filename AND a.page = b.page AND a.pos = b.pos AND source = 'PRTM_BASE'"""

# --- cautions, sequences ------------------------------------------------------------------------
_LABELS = "concat_ws(',', " + ", ".join([f"CASE WHEN {_has('line', p)} THEN {_q(k)} END" for k, p in rules.CAUTION_LABELS] + [f"CASE WHEN {_all('line', ps)} THEN {_q(k)} END" for k, ps in rules.CAUTION_PAIRS]) + ")"


def _cautions(*kinds: str) -> str:
    return f"(SELECT *, {_first('text', rules.CAUTION_TYPES, 'general')} AS type, {_group('line', rules.REGISTER_SYMBOL, 0)} AS register FROM (SELECT *, concat(replace(labels, ',', ' '), ' ', line) AS text FROM (SELECT filename, page, pos, line, {_LABELS} AS labels FROM {_manual(*kinds)} AS x) AS y WHERE labels <> '') AS z)"


_TOPICS = "(SELECT concat('manual', f) AS filename, topic FROM range(5) AS r(f), (VALUES ('reserved bits'), ('flag'), ('transfer is stopped'), ('reset'), ('writing 0')) AS t(topic))"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY filename, topic ORDER BY score DESC, page, pos) AS n FROM (SELECT c.*, topic, CASE WHEN contains({_norm('line')}, topic) THEN 80 ELSE 0 END + 20 * len(string_split(labels, ',')) AS score FROM {_cautions('caution')} AS c JOIN {_TOPICS} AS t USING (filename)) AS x WHERE score >= 80)"
_CAUTION_INDEX = f"""SELECT filename, topic, lines, pages, CAST(score AS int) AS score, type, CASE WHEN score >= 220 THEN 'high' WHEN score >= 120 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT filename, topic, count(*) AS lines, count(DISTINCT page) AS pages, max(score) AS score FROM {_RANKED} AS r WHERE n <= 10 GROUP BY ALL) AS s JOIN (SELECT filename, topic, arg_max(type, c * 1000 - first) AS type FROM (SELECT filename, topic, type, count(*) AS c, min(n) AS first FROM {_RANKED} AS r WHERE n <= 10 GROUP BY ALL) AS k GROUP BY ALL) AS t USING (filename, topic)"""
_NUMBER = "TRY_CAST(regexp_extract(line, '^(\\d{1,2})[.)]\\s', 1) AS int)"
_STEPS = f"(SELECT filename, page, CAST(step AS int) AS step, number, operation, register, CAST(lead(step) OVER (PARTITION BY filename, page ORDER BY pos) AS int) AS next_step FROM (SELECT *, row_number() OVER (PARTITION BY filename, page ORDER BY pos) AS step FROM (SELECT filename, page, pos, {_NUMBER} AS number, {_first('line', rules.STEP_OPERATIONS, 'other')} AS operation, {_group('line', rules.REGISTER_SYMBOL, 0)} AS register FROM {_manual('step')} AS x) AS y WHERE number IS NOT NULL) AS z WHERE step <= 16)"
_CLUSTERS = f"(SELECT filename, topic, CAST(cluster AS bigint) AS cluster, min(page) AS page_start, max(page) AS page_end, count(*) AS pages, CAST(sum(score) AS bigint) AS score, CAST(sum(score) + 25 * count(*) AS bigint) AS weight FROM (SELECT *, sum(new) OVER (PARTITION BY filename, topic ORDER BY page) AS cluster FROM (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY filename, topic ORDER BY page) > 1 THEN 1 ELSE 0 END AS new FROM (SELECT filename, type AS topic, page, count(*) AS score FROM {_cautions('caution')} AS c GROUP BY ALL) AS h) AS i) AS j GROUP BY filename, topic, cluster)"

# --- tables -------------------------------------------------------------------------------------
_CELLS = f"""(SELECT filename, page, CAST("row" AS bigint) AS "row", CAST(cell AS bigint) AS cell, min(x0) AS x0, min(y0) AS y0, string_agg(word, ' ' ORDER BY x0, word) AS text FROM (SELECT *, sum(new2) OVER (PARTITION BY filename, page, "row" ORDER BY x0, word) AS cell FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY filename, page, "row" ORDER BY x0, word) > 14.0 THEN 1 ELSE 0 END AS new2 FROM (SELECT *, sum(new) OVER (PARTITION BY filename, page ORDER BY y0, x0, word) AS "row" FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY filename, page ORDER BY y0, x0, word) > 2.5 THEN 1 ELSE 0 END AS new FROM (SELECT filename, page, CAST(x0 AS double) AS x0, CAST(x1 AS double) AS x1, CAST(y0 AS double) AS y0, word FROM ({WORDS}) AS w) AS a) AS b) AS c) AS d) AS e GROUP BY filename, page, "row", cell)"""
_BLOCKS = f"""(SELECT filename, page, CAST(block AS bigint) AS block, count(*) AS "rows", CAST(sum(cells) AS bigint) AS cells, max(cells) AS "columns" FROM (SELECT *, sum(new) OVER (PARTITION BY filename, page ORDER BY "row") AS block FROM (SELECT *, CASE WHEN "row" - lag("row") OVER w > 1 OR y0 - lag(y0) OVER w > 28.0 THEN 1 ELSE 0 END AS new FROM (SELECT filename, page, "row", count(*) AS cells, min(y0) AS y0 FROM {_CELLS} AS c GROUP BY ALL HAVING count(*) >= 3) AS r WINDOW w AS (PARTITION BY filename, page ORDER BY "row")) AS n) AS b GROUP BY filename, page, block)"""
_STITCH = f"""SELECT filename, CAST(run AS bigint) AS run, CAST(piece AS bigint) AS piece, min(page) AS page_start, max(page) AS page_end, CAST(sum("rows") AS bigint) AS "rows", max("columns") AS "columns" FROM (SELECT *, floor((row_number() OVER (PARTITION BY filename, run ORDER BY page, block) - 1) / 2) AS piece FROM (SELECT *, sum(new) OVER (PARTITION BY filename ORDER BY page, block) AS run FROM (SELECT *, CASE WHEN page - lag(page) OVER w = 1 AND "columns" = lag("columns") OVER w THEN 0 ELSE 1 END AS new FROM {_BLOCKS} AS b WINDOW w AS (PARTITION BY filename ORDER BY page, block)) AS n) AS r) AS p GROUP BY filename, run, piece"""
_TABLE_LIKE = f"(len(regexp_split_to_array(trim(line), '\\s{{2,}}')) >= 3 OR {_has('line', r'(?i)\b(Abbreviation|Offset\s+Address|Bit\s+Name|Initial\s+Value|Access\s+Size)\b')} OR {_has('line', r'\b[0-9A-F]+h\b')})"

# --- figures ------------------------------------------------------------------------------------


def _captions(*kinds: str) -> str:
    g = lambda i: f"trim({_group('line', rules.CAPTION, i)})"
    inner = f"SELECT *, count(*) OVER (PARTITION BY filename, page ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS context_lines FROM {_manual(*kinds)} AS x"
    return f"(SELECT *, concat('cap-p', page, '-', number, '-', substr(sha1(title), 1, 12)) AS caption_id FROM (SELECT filename, page, pos, CASE WHEN lower({g(1)}) LIKE 'fig%' THEN 'Figure' ELSE 'Table' END AS type, {g(2)} AS number, {g(4)} AS title, context_lines FROM ({inner}) AS y WHERE {_has('line', rules.CAPTION)}) AS z)"


def _manifest(*kinds: str) -> str:
    kind = f"CASE {_first(_norm('title'), rules.FIGURE_KINDS, 'unknown')} WHEN 'unknown' THEN lower(type) ELSE {_first(_norm('title'), rules.FIGURE_KINDS, 'unknown')} END"
    return f"(SELECT filename, page, pos, type, number, title, context_lines, caption_id, kind, printf('p%d_f%03d', page, row_number() OVER (PARTITION BY filename, page ORDER BY pos)) AS figure_id, CAST(least(100, 50 + CASE WHEN number <> '' THEN 25 ELSE 8 END + CASE WHEN kind IN ('figure', 'table') THEN 0 ELSE 15 END + CASE WHEN length(title) > 8 THEN 6 ELSE 0 END) AS int) AS confidence FROM (SELECT *, {kind} AS kind FROM {_captions(*kinds)} AS c) AS k)"


_VISUAL = {k: f"CASE WHEN {_has('title', p)} THEN 1 ELSE 0 END" for k, p in rules.VISUAL_TABLES}
_MOST = "greatest(" + ", ".join(_VISUAL.values()) + ")"
_LAST = "(SELECT user_id AS entry, arg_max(event_type, {o}) AS status, arg_max(event_id, {o}) AS event_id, max(epoch_us(ts)) AS updated, count(*) AS states FROM events GROUP BY user_id)".replace("{o}", "(epoch_us(ts), event_type, event_id)")
_FACTS = "(SELECT concat('manual', p_partkey % 5) AS filename, concat('PRTm_R', p_partkey, '_n') AS name, CASE WHEN p_partkey % 3 = 0 THEN '8' ELSE '16' END AS access_size FROM part)"
_EDGES = ", ".join(f"('{a}', '{n}')" for a, ns in rules.ARTIFACT_NEEDS.items() for n in ns)


def _search(query: str, k: int) -> str:
    return f"SELECT filename, page, score FROM {_scored(search.Query(query))} AS s WHERE score > 0 ORDER BY score DESC, filename, page LIMIT {k}"


def _section_score() -> str:
    q = search.Query("Reset Procedure")
    flat, sym = _norm("title"), _symbol("title")
    parts = [f"CASE WHEN {flat} = '{q.phrase}' THEN 140 ELSE 0 END", f"CASE WHEN contains({flat}, '{q.phrase}') THEN 95 ELSE 0 END"]
    for t in q.terms:
        parts += [f"CASE WHEN {_has(flat, rf'\b{t}\b')} THEN 18 ELSE 0 END", f"CASE WHEN contains({flat}, '{t}') THEN 8 ELSE 0 END"]
    parts += [f"CASE WHEN contains({sym}, '{t.upper()}') THEN 18 ELSE 0 END" for t in "Reset Procedure".split()]
    parts += ["CASE type WHEN 'numbered' THEN 12 WHEN 'appendix' THEN 8 ELSE 0 END", f"CASE WHEN {_has('title', rules.SECTION_WORDS)} THEN 10 ELSE 0 END"]
    return " + ".join(parts)


def _fuzzy_all() -> str:
    """All pages and tokens. Letters beyond ASCII count as one that no term has, as levenshtein compares bytes."""
    terms = search.Query("thatin theren thingon").important
    out = []
    for i, t in enumerate(terms):
        out.append(f"max(CASE WHEN w = '{t}' THEN 1 ELSE 0 END) AS x{i}, max(CASE WHEN abs(length(w) - {len(t)}) <= 2 AND 1 - levenshtein(regexp_replace(w, '[^\\x00-\\x7F]', '#', 'g'), '{t}') / greatest(length(w), {len(t)}) >= 0.86 THEN 1 ELSE 0 END) AS y{i}")
    points = " + ".join(f"CASE WHEN x{i} = 0 AND y{i} = 1 THEN 12 ELSE 0 END" for i in range(len(terms)))
    words = f"SELECT DISTINCT filename, page, unnest({_tokens('text')}) AS w FROM ({PROSE}) AS p"
    scored = f"SELECT filename, page, {points} AS points FROM (SELECT filename, page, {', '.join(out)} FROM ({words}) AS d GROUP BY filename, page) AS e"
    return f"SELECT filename, page, CAST(coalesce(points, 0) AS int) AS points FROM ({PROSE}) AS p LEFT JOIN ({scored}) AS s USING (filename, page)"


_LINES = f"(SELECT filename, page, pos, line FROM (SELECT filename, page, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT filename, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({PROSE}) AS p) AS a) AS b)"
_EVIDENCE = f"""SELECT filename, page, CAST(rank AS int) AS rank, CAST(pos AS int) AS pos, score, md5(context) AS context FROM (SELECT *, row_number() OVER (PARTITION BY filename, page ORDER BY score DESC, pos) AS rank FROM (SELECT filename, page, pos, concat_ws(' / ', lag(line) OVER w, line, lead(line) OVER w) AS context, CAST({' + '.join(f'10 * {_word("flat", t)} + 2 * {_loose("flat", t)}' for t in _QUERY.terms)} + CASE WHEN contains(flat, {_q(_QUERY.phrase)}) THEN 40 ELSE 0 END AS int) AS score FROM (SELECT *, {_norm('line')} AS flat FROM {_LINES} AS l) AS f WINDOW w AS (PARTITION BY filename, page ORDER BY pos)) AS s WHERE score > 0) AS r WHERE rank <= 3"""

ORACLES: dict[str, str] = {
    "text_normalize": f"SELECT filename, page, length(s) AS n_search, md5(s) AS search, length(p) AS n_plain, md5(p) AS plain FROM (SELECT filename, page, {_norm('text')} AS s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r', chr(10), 'g'), '[\\t ]+', ' ', 'g'), '\\n +', chr(10), 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS p FROM ({PROSE}) AS d) AS e",
    "text_symbols": f"SELECT filename, page, pos, {_symbol('line')} AS symbol, regexp_replace(upper(line), '[^A-Z0-9]', '', 'g') AS hardware, regexp_replace(replace({_norm('line')}, ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug, regexp_replace(lower(line), '[\\s\\[\\]{{}}()_,\\-]+', '', 'g') AS comparable, CASE WHEN length(line) > 40 THEN concat(substr(line, 1, 37), '...') ELSE line END AS short, substr(sha1(line), 1, 12) AS hash FROM {_manual('register', 'bit')} AS x",
    "text_tokens": f"SELECT filename, page, CAST(len(t) AS int) AS tokens, CAST(len(list_distinct(t)) AS int) AS distinct_tokens FROM (SELECT filename, page, {_tokens('text')} AS t FROM ({PROSE}) AS p) AS x",
    "text_counts": f"SELECT filename, page, CAST({_word('flat', 'the')} AS int) AS words, {_loose('flat', 'th')} AS loose FROM (SELECT *, {_norm('text')} AS flat FROM ({PROSE}) AS p) AS x",
    "text_fuzzy": "SELECT DISTINCT p_type, CAST(floor(1000 * CASE WHEN p_type = '' THEN 0 WHEN p_type = 'STANDARD POLISHED TIN' THEN 1 ELSE 1 - levenshtein(p_type, 'STANDARD POLISHED TIN') / greatest(length(p_type), 21) END + 0.5) AS int) AS similarity FROM part",
    "chunk_text": _chunk_sql(),
    "chunk_profile": f"SELECT * FROM {_typed()} AS t",
    "chunk_type_stats": f"SELECT chunk_type, count(*) AS chunks, CAST(floor(avg(noise) + 0.5) AS bigint) AS noise, CAST(floor(avg(content) + 0.5) AS bigint) AS content, min(page) AS first_page FROM {_typed()} AS t GROUP BY chunk_type",
    "section_index": f"SELECT section_id, filename, page, title, type, level, confidence FROM {_sections()} AS s",
    "section_search": f"SELECT filename, page, title, CAST({_section_score()} AS int) AS score FROM {_sections()} AS s WHERE {_section_score()} > 0 ORDER BY 4 DESC, page, level, filename, title LIMIT 30",
    "section_nearest": f"SELECT r.filename, r.page, r.name, s.section_id FROM {_list_rows('register')} AS r ASOF LEFT JOIN (SELECT filename, page, arg_max(section_id, level * 1000000 - pos) AS section_id FROM {_sections('heading')} AS s GROUP BY filename, page) AS s ON r.filename = s.filename AND r.page >= s.page",
    "search_lexical": _search(ASK, 30),
    "search_bm25": _BM25,
    "search_proximity": _PROXIMITY,
    "search_hybrid": _HYBRID,
    "search_fuzzy": _fuzzy_all(),
    "search_evidence": _EVIDENCE,
    "search_fusion": f"SELECT filename, page, CAST(max(score) + CASE WHEN count(*) > 1 THEN floor(min(score) / 10) ELSE 0 END AS int) AS score, CAST(count(*) AS int) AS queries FROM (SELECT * FROM ({_search('than there', 200)}) AS a UNION ALL SELECT * FROM ({_search('over thing', 200)}) AS b) AS u GROUP BY filename, page",
    "register_rows": f"SELECT * FROM {_list_rows()} AS r",
    "register_index": f"SELECT * FROM {_REGISTERS} AS r",
    "register_find": f"SELECT filename, name, CAST(score AS int) AS score, confidence FROM (SELECT *, CASE WHEN canonical = 'PRTM_R17_N' THEN 180 ELSE 0 END + CASE WHEN list_contains({_KNOWN}, 'PRTM_R17_N') THEN 160 ELSE 0 END + CASE WHEN len(list_filter({_KNOWN}, lambda a: contains(a, 'PRTM_R17_N') OR contains('PRTM_R17_N', a))) > 0 THEN 85 ELSE 0 END + CASE WHEN contains({_norm('concat_ws(chr(32), name, description)')}, 'prtm r17 n') THEN 45 ELSE 0 END AS score FROM {_REGISTERS} AS r) AS s WHERE score > 0 ORDER BY score DESC, confidence DESC, first_page, filename, name LIMIT 30",
    "register_near_pages": f"SELECT n.filename, n.page, count(*) AS registers, min(name) AS first_register FROM (SELECT DISTINCT filename, page FROM {_cautions('caution')} AS c) AS n JOIN {_REGISTERS} AS r ON n.filename = r.filename AND abs(n.page - r.first_page) <= 1 WHERE explicit = 1 GROUP BY n.filename, n.page",
    "register_mapping": _MAPPING,
    "bitfield_conflicts": "SELECT filename, register, bitfield, field, string_agg(value, ',' ORDER BY value) AS values FROM (" + " UNION ".join(f"SELECT filename, register, bitfield, '{c}' AS field, {c} AS value FROM {_bit_rows('bit')} AS b WHERE trim({c}) <> '' AND lower({c}) <> 'unknown'" for c in ("position", "field_range", "access", "reset")) + ") AS v GROUP BY filename, register, bitfield, field HAVING count(*) > 1",
    "bitfield_rows": f"SELECT * FROM {_bit_rows()} AS b",
    "bitfield_index": f"SELECT * FROM {_FIELDS} AS f",
    "bitfield_validation": f"SELECT filename, register, bitfield, position, register_width, coalesce(at_high - at_low, own_high - own_low) + 1 AS width, CASE WHEN issues = '' THEN 'valid' WHEN conflicts > 0 THEN 'conflict' ELSE 'needs_verification' END AS status, issues FROM {_VALID} AS v WHERE issues = '' OR conflicts > 0 OR position <> 'unknown' OR (CASE WHEN access <> 'unknown' THEN 1 ELSE 0 END + CASE WHEN reset <> 'unknown' THEN 1 ELSE 0 END) >= 2",
    "bitfield_overlaps": f"SELECT DISTINCT a.filename, a.register, a.bitfield, b.bitfield AS other FROM {_AT} AS a JOIN {_AT} AS b ON a.filename = b.filename AND a.register = b.register AND a.at_low <= b.at_high AND b.at_low <= a.at_high AND a.bitfield <> b.bitfield",
    "caution_lines": f"SELECT filename, page, pos, labels, type, register FROM {_cautions()} AS c",
    "caution_index": _CAUTION_INDEX,
    "sequence_write_pairs": f"SELECT filename, page, pos, {_group('line', rules.WRITE_PAIR, 1)} AS first_value, {_group('line', rules.WRITE_PAIR, 2)} AS second_value, {_group('line', rules.WRITE_PAIR, 3)} AS register FROM {_manual()} AS x WHERE {_has('line', rules.WRITE_PAIR)}",
    "sequence_steps": f"SELECT * FROM {_STEPS} AS s",
    "sequence_structure": f"SELECT filename, page, steps, known, CASE WHEN known = steps THEN 'complete' WHEN known > 0 THEN 'partial' ELSE 'unstructured' END AS status FROM (SELECT filename, page, count(*) AS steps, count(*) FILTER (WHERE operation <> 'other' AND register <> '') AS known FROM {_STEPS} AS s GROUP BY filename, page) AS t",
    "sequence_clusters": f"SELECT * FROM {_CLUSTERS} AS c",
    "sequence_best_cluster": f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY filename, topic ORDER BY weight DESC, page_start) AS n FROM {_CLUSTERS} AS c) AS r WHERE n = 1",
    "sequence_topics": f"SELECT filename, page, pos, concat_ws(',', {', '.join(f'CASE WHEN {_has(_norm("line"), p)} THEN {_q(k)} END' for k, p in rules.SEQUENCE_KINDS)}) AS kinds FROM {_manual('heading')} AS x",
    "table_cells": f'SELECT filename, page, "row", cell, x0, text FROM {_CELLS} AS c',
    "table_blocks": f"SELECT * FROM {_BLOCKS} AS b",
    "table_stitch": _STITCH,
    "table_kinds": f"SELECT filename, {_first('line', rules.TABLE_KINDS, 'table')} AS table_kind, {_TABLE_LIKE} AS table_like, count(*) AS lines FROM {_manual()} AS x GROUP BY ALL",
    "table_continuation": f"SELECT filename, page, CAST(g AS bigint) AS \"group\", arg_min(head, pos) AS head, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS parts FROM (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY filename, page ORDER BY pos) AS g FROM (SELECT filename, page, pos, {_group('line', rules.REGISTER_SYMBOL, 0)} AS head, CAST(length(line) AS varchar) AS text FROM {_manual('register', 'write')} AS x) AS y) AS z WHERE g > 0 GROUP BY filename, page, g",
    "table_carried_register": f"SELECT filename, \"current\", count(*) AS lines FROM (SELECT filename, last_value(nullif(register, '') IGNORE NULLS) OVER (PARTITION BY filename ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS \"current\" FROM (SELECT filename, page, pos, {_group('line', rules.REGISTER_SYMBOL, 0)} AS register FROM {_manual('step', 'write')} AS x) AS y) AS z GROUP BY filename, \"current\"",
    "figure_manifest": f"SELECT * FROM {_manifest()} AS m",
    "figure_visual_tables": f"SELECT filename, page, caption_id, CASE {' '.join(f'WHEN {h} = {_MOST} THEN {_q(k)}' for k, h in _VISUAL.items())} END AS visual_kind, {' + '.join(_VISUAL.values())} AS hits, CAST(least(95, 45 + 10 * ({' + '.join(_VISUAL.values())}) + CASE WHEN {' + '.join(_VISUAL.values())} > 1 THEN 10 ELSE 0 END) AS int) AS visual_confidence FROM {_captions('caption')} AS c WHERE {_MOST} > 0",
    "figure_kinds": f"SELECT kind, count(*) AS figures, min(page) AS first_page FROM {_manifest('caption')} AS m GROUP BY kind",
    "evidence_latest": f"SELECT entry, status, event_id, states FROM {_LAST} AS l",
    "evidence_queue": f"SELECT entry, status, updated FROM {_LAST} AS l ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, updated DESC, entry LIMIT 30",
    "evidence_report": f"SELECT status, count(*) AS entries, CAST(sum(states) AS bigint) AS states FROM {_LAST} AS l GROUP BY status",
    "artifact_descendants": f"WITH RECURSIVE n(artifact, needs) AS (VALUES {_EDGES}), r(artifact, depth) AS (SELECT 'tables', 0 UNION ALL SELECT n.artifact, depth + 1 FROM n JOIN r ON n.needs = r.artifact WHERE depth < 14) SELECT artifact, min(depth) AS depth FROM r WHERE depth > 0 AND artifact <> 'tables' GROUP BY artifact",
    "artifact_health": "SELECT filename, CAST(max(s) AS int) AS severity, count(*) AS artifacts, ['ok', 'stale', 'missing', 'broken'][max(s) + 1] AS health FROM (SELECT concat('manual', o_custkey) AS filename, o_orderkey % 97 % 4 AS s FROM orders WHERE o_orderstatus <> 'P') AS x GROUP BY filename",
    "golden_facts": f"SELECT f.filename, f.name, f.access_size, CASE WHEN r.name IS NULL THEN 'missing' WHEN r.access_size = f.access_size THEN 'pass' ELSE 'fail' END AS result FROM {_FACTS} AS f LEFT JOIN {_list_rows('register')} AS r ON f.filename = r.filename AND f.name = r.name",
    "requirement_match": f"""WITH need AS (SELECT item_id AS req_id, list_distinct({_tokens('text')}) AS need FROM benchmark), have AS (SELECT DISTINCT doc_id AS ev_id, unnest({_tokens('text')}) AS token FROM documents),
score AS (SELECT req_id, ev_id, CAST(floor(count(*) * 100.0 / n + 0.5) AS int) AS coverage FROM (SELECT req_id, len(need) AS n, unnest(need) AS token FROM need) AS t JOIN have USING (token) GROUP BY req_id, n, ev_id),
best AS (SELECT req_id, coalesce(max(coverage), 0) AS coverage, arg_max(ev_id, CAST(coverage AS bigint) * 1000000000 - ev_id) AS ev_id FROM need LEFT JOIN score USING (req_id) WHERE len(need) > 0 GROUP BY req_id)
SELECT *, CASE WHEN coverage >= 60 THEN 'implemented_candidate' WHEN coverage >= 35 THEN 'unclear' ELSE 'missing_or_not_reported' END AS status FROM best""",
    "eval_assertions": f"SELECT case_id, CAST(CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END + CASE WHEN c THEN 1 ELSE 0 END AS int) AS failed, concat_ws('; ', CASE WHEN a THEN 'lacks the' END, CASE WHEN b THEN 'has license' END, CASE WHEN c THEN 'short' END) AS reasons FROM (SELECT doc_id AS case_id, NOT contains({_norm('text')}, 'the') AS a, contains({_norm('text')}, 'license') AS b, length(text) < 100 AS c FROM documents) AS x",
    "cache_evict": "SELECT * FROM (SELECT folder, updated, bytes, file, CAST(sum(bytes) OVER (PARTITION BY folder ORDER BY updated DESC, file ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS kept_bytes FROM (SELECT o_custkey AS folder, epoch_us(o_orderdate) AS updated, CAST(length(o_orderpriority) AS int) AS bytes, o_orderkey AS file FROM orders) AS o) AS w WHERE kept_bytes > 40",
    "resume_pages": f"SELECT DISTINCT filename, page FROM {_manual('heading')} AS h WHERE (filename, page) NOT IN (SELECT filename, page FROM {_manual('caution')} AS c)",
}

_EXPLICIT = f"(SELECT * FROM {_REGISTERS} AS x WHERE explicit = 1)"
_USAGE = f"(SELECT *, {_first('t', rules.ACCESS_TYPES, 'write')} AS access, {_first('t', rules.USAGE_INTENTS, 'configure')} AS intent FROM (SELECT *, {_norm('operation')} AS t FROM (SELECT DISTINCT filename, {_group('line', rules.REGISTER_SYMBOL, 0)} AS register, regexp_replace(line, '^\\d+\\. | of PRTm_R.*$', '', 'g') AS operation FROM {_manual('step')} AS x) AS y) AS z)"
_SAYS = f"(SELECT filename, register, max(CASE WHEN type IN ('reserved-bit', 'prohibited') THEN 1 ELSE 0 END) AS reserved, max(CASE WHEN starts_with(type, 'clear-semantics') THEN 1 ELSE 0 END) AS clears, max(CASE WHEN type = 'write-timing' THEN 1 ELSE 0 END) AS timing FROM {_cautions('caution')} AS c GROUP BY filename, register)"
_GAPS = "concat_ws(', ', CASE WHEN known IS NULL THEN 'register' END, CASE WHEN access IN ('raw_write', 'write', 'set_bits', 'clear_bits') AND coalesce(reserved, 0) = 0 THEN 'reserved bits' END, CASE WHEN (intent = 'clear' OR access IN ('write_one_to_clear', 'write_zero_to_clear')) AND coalesce(clears, 0) = 0 THEN 'clear semantics' END, CASE WHEN intent IN ('start', 'stop', 'reset', 'init', 'irq', 'error') AND ordered IS NULL THEN 'order' END)"
_ARROWS = f"(SELECT *, {_first(_norm('source'), rules.BLOCK_KINDS, 'unknown')} AS source_kind, {_first(_norm('target'), rules.BLOCK_KINDS, 'unknown')} AS target_kind, {_first(_norm('label'), rules.EDGE_KINDS, 'unknown')} AS edge_kind FROM (SELECT filename, page, pos, trim({_group('line', rules.ARROW, 1)}) AS source, trim({_group('line', rules.ARROW, 2)}) AS target, trim({_group('line', rules.ARROW, 3)}) AS label FROM {_manual()} AS x WHERE {_has('line', rules.ARROW)}) AS a)"
_EVENTS = f"(SELECT filename, page, pos, n, event FROM (SELECT filename, page, pos, unnest(e) AS event, generate_subscripts(e, 1) - 1 AS n FROM (SELECT filename, page, pos, regexp_extract_all(line, {_q(rules.SIGNAL_EDGE)}, 0) AS e FROM {_manual()} AS x) AS a) AS b)"

ORACLES |= {
    "read_pages": f"SELECT filename, page, length(text) AS n_chars FROM ({PROSE}) AS p WHERE page BETWEEN 10 AND 29",
    "register_list": f"SELECT filename, name, confidence, first_page FROM {_REGISTERS} AS r WHERE (explicit = 1 OR confidence >= 70) AND contains({_norm('concat_ws(chr(32), name, description)')}, 'brushed') ORDER BY confidence DESC, first_page, filename, name LIMIT 50",
    "register_groups": f"SELECT filename, \"group\", count(*) AS registers, arg_min(name, (first_page, name)) AS first_register FROM (SELECT *, {_first('upper(concat_ws(chr(32), name, description))', rules.REGISTER_GROUPS, 'Other registers')} AS \"group\" FROM {_REGISTERS} AS r) AS g GROUP BY filename, \"group\"",
    "module_type": f"SELECT filename, {_first(_norm('text'), rules.MODULE_TYPES, 'unknown')} AS module_type FROM (SELECT filename, string_agg(title, ' ' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY page, pos) AS n FROM {_sections('heading')} AS x) AS y WHERE n <= 40 GROUP BY filename) AS z",
    "register_summary": f"SELECT filename, register, confidence, coalesce(bitfields, 0) AS bitfields, coalesce(valid_bitfields, 0) AS valid_bitfields, coalesce(cautions, 0) AS cautions, coalesce(steps, 0) AS steps, CASE WHEN explicit = 1 AND coalesce(bitfields, 0) > 0 THEN 'high' WHEN explicit = 1 THEN 'medium' ELSE 'low' END AS reliability FROM (SELECT *, name AS register FROM {_REGISTERS} AS r) AS r LEFT JOIN (SELECT filename, register, count(*) AS bitfields, count(*) FILTER (WHERE issues = '') AS valid_bitfields FROM {_VALID} AS v GROUP BY ALL) AS f USING (filename, register) LEFT JOIN (SELECT filename, register, count(*) AS cautions FROM {_cautions('caution')} AS c WHERE register <> '' GROUP BY ALL) AS c USING (filename, register) LEFT JOIN (SELECT filename, register, count(*) AS steps FROM {_STEPS} AS s WHERE register <> '' GROUP BY ALL) AS s USING (filename, register)",
    "register_usage": f"SELECT filename, register, operation, access, intent, CASE WHEN missing <> '' THEN 'needs_verification' WHEN coalesce(timing, 0) = 1 THEN 'review_required' ELSE 'likely_ok' END AS severity, missing FROM (SELECT *, {_GAPS} AS missing FROM {_USAGE} AS u LEFT JOIN (SELECT DISTINCT filename, name AS register, 1 AS known FROM {_EXPLICIT} AS e) AS k USING (filename, register) LEFT JOIN {_SAYS} AS s USING (filename, register) LEFT JOIN (SELECT DISTINCT filename, register, 1 AS ordered FROM {_STEPS} AS t WHERE register <> '') AS o USING (filename, register)) AS m",
    "register_alias": f"SELECT a.filename, a.symbol, min(name) AS register, count(DISTINCT name) AS candidates FROM (SELECT concat('manual', p_partkey % 5) AS filename, concat('R', p_partkey, '_n') AS symbol FROM part) AS a JOIN (SELECT filename, name, unnest({_KNOWN}) AS alias FROM {_EXPLICIT} AS e) AS s ON a.filename = s.filename AND {_symbol('a.symbol')} = s.alias GROUP BY a.filename, a.symbol",
    "diagram_edges": f"SELECT * FROM {_ARROWS} AS a",
    "diagram_nodes": f"SELECT filename, page, node, CAST(sum(o) AS bigint) AS \"out\", CAST(sum(i) AS bigint) AS \"in\" FROM (SELECT filename, page, source AS node, 1 AS o, 0 AS i FROM {_ARROWS} AS a UNION ALL SELECT filename, page, target, 0, 1 FROM {_ARROWS} AS b) AS u GROUP BY filename, page, node",
    "diagram_signals": f"SELECT filename, page, pos, CAST(n AS int) AS n, signal, edge, lag(signal) OVER (PARTITION BY filename, page ORDER BY pos, n) AS after FROM (SELECT *, regexp_extract(event, '^(\\S+)', 1) AS signal, CASE WHEN regexp_matches(event, '(?i)rises|high|asserted') THEN 'rising' ELSE 'falling' END AS edge FROM {_EVENTS} AS e) AS f",
    "pin_functions": f"SELECT DISTINCT filename, page, pin, function FROM (SELECT filename, page, replace({_group('line', rules.PIN, 1)}, '-', '_') AS pin, unnest(regexp_extract_all(line, {_q(rules.PIN_FUNCTION)}, 1)) AS function FROM {_manual('pin')} AS x WHERE {_has('line', rules.PIN)}) AS y WHERE NOT regexp_matches(function, '^P\\d')",
    "figure_context": f"SELECT c.filename, c.page, caption_id, count(*) AS lines, md5(string_agg(l.line, chr(10) ORDER BY l.pos)) AS digest FROM {_captions()} AS c JOIN {_manual()} AS l ON c.filename = l.filename AND c.page = l.page AND l.pos BETWEEN c.pos - 4 AND c.pos + 5 GROUP BY c.filename, c.page, c.pos, caption_id",
    "table_coverage": f"SELECT filename, page, coalesce(captions, 0) AS captions, coalesce(tables, 0) AS tables, CASE WHEN tables IS NULL THEN 'caption_only' WHEN captions IS NULL THEN 'table_only' ELSE 'covered' END AS status FROM (SELECT filename, page, count(*) AS captions FROM {_captions('caption')} AS c WHERE type = 'Table' GROUP BY ALL) AS a FULL JOIN (SELECT filename, page, count(*) AS tables FROM {_BLOCKS} AS b GROUP BY ALL) AS b USING (filename, page)",
    "evidence_gate": f"SELECT status, count(*) AS entries, count(*) FILTER (WHERE status NOT IN ('verified', 'purchase')) AS blockers FROM {_LAST} AS l GROUP BY status",
    "golden_bootstrap": f"SELECT filename, name, band, CAST(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY confidence DESC, filename, name) AS rank FROM (SELECT *, CASE WHEN explicit = 1 AND confidence >= 90 THEN 'high_quality' WHEN confidence >= 40 THEN 'needs_manual_review' ELSE 'rejected_noise' END AS band FROM {_REGISTERS} AS r WHERE (filename, name) NOT IN (SELECT concat('manual', p_partkey % 5), concat('PRTm_R', p_partkey, '_n') FROM part WHERE p_size > 25)) AS b) AS c WHERE rank <= 20",
    "artifact_reconcile": f"SELECT *, CASE WHEN declared <> actual THEN 'differs' WHEN actual = 0 THEN 'empty' WHEN actual < 10 THEN 'few' ELSE 'ok' END AS status FROM (SELECT filename, artifact, declared, coalesce(actual, 0) AS actual FROM (SELECT filename, kind AS artifact, count(*) AS declared FROM {_manual('register', 'caution')} AS x GROUP BY ALL) AS d LEFT JOIN (SELECT filename, artifact, count(*) AS actual FROM (SELECT filename, 'register' AS artifact FROM {_list_rows('register', 'caution')} AS r UNION ALL SELECT filename, 'caution' FROM {_cautions('register', 'caution')} AS c) AS u GROUP BY ALL) AS a USING (filename, artifact)) AS z",
}

_ROLE_NAMES = list(dict.fromkeys(r for r, _, _ in rules.COLUMN_ROLES))


def _roles(cells: str) -> str:
    per_role = {r: " + ".join(f"CASE WHEN {_has('text', p)} THEN {n} ELSE 0 END" for role, p, n in rules.COLUMN_ROLES if role == r) for r in _ROLE_NAMES}
    each = " UNION ALL ".join(f"SELECT filename, cell, '{r}' AS role, CAST(sum({e}) AS bigint) AS points, max({e}) AS best FROM {cells} AS c GROUP BY filename, cell" for r, e in per_role.items())
    return f"SELECT filename, cell, role, points FROM (SELECT *, row_number() OVER (PARTITION BY filename, cell ORDER BY points DESC, role) AS n FROM ({each}) AS e WHERE best >= {rules.ROLE_LEAST}) AS r WHERE n = 1"


ORACLES |= {
    "table_roles": _roles("(" + HEADERS.replace("FROM VALUES", "FROM (VALUES").replace(" AS t(", ") AS t(") + ")"),
    "table_found_roles": _roles(f"(SELECT filename, cell, text FROM {_CELLS} AS d)"),
}

ORACLES |= figure_queries.oracles(_cautions("caution"), _CELLS)

_CUT, _, _NUMBERED = _chunk_sql().removeprefix("WITH RECURSIVE ").rpartition("\nSELECT filename, page, CAST(row_number()")
_PARTS = f"{_CUT},\nparts AS (SELECT filename, page, CAST(row_number(){_NUMBERED.replace('length(t) AS n_chars, md5(t) AS digest', 't AS text')})"
ORACLES |= passage_queries.oracles(_PARTS)
