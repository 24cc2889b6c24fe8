"""Queries over technical tokens, recognized text, driver hints and diagrams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import tokens as K
from folioscope.functions.text import DASHES
from folioscope.operators import diagrams as D
from folioscope.operators import tables
from folioscope.sources.corpora import manual_lines, manual_sql, manual_words

KEYS = ["filename", "page", "pos"]
#: Sentences of diagrams, made from the given lines: steps, states, connections.
SAID = [
    "concat('Step ', page % 7 + 1, ': Write 1 to ', line, ' when the counter stops')",
    "concat('from idle to ', CASE page % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'error state' ELSE 'standby' END, ' when timeout ', pos % 4)",
    "concat('DMA controller drives SRAM block ', page % 5, '; CPU core ', pos % 3, ' is connected to AXI bus')",
    "concat('Timing of clock edge ', page % 4, '; block diagram of module; state mode')",
]


def _said_sql(lines: str) -> str:
    return f"SELECT filename, page, CAST(pos AS int) AS pos, CASE (pos + page) % 4 WHEN 0 THEN {SAID[0]} WHEN 1 THEN {SAID[1]} WHEN 2 THEN {SAID[2]} ELSE {SAID[3]} END AS line, CASE page % 3 WHEN 0 THEN 'timing-diagram' WHEN 1 THEN 'block' END AS kind FROM {lines} AS l"


def _said(spark, d):
    lines = manual_lines(spark, d, "signal", "arrow", "caption").select(*KEYS, "line")
    return spark.sql(_said_sql("{lines}").replace("FROM {lines} AS l", "FROM {lines}"), lines=lines)


# --- queries ------------------------------------------------------------------------------------


def technical_tokens(spark, d):
    rows = manual_lines(spark, d, "register", "bit", "signal", "pin", "arrow")
    return rows.select(*KEYS, F.explode(K.hardware_tokens(F.col("line"))).alias("t")).select(*KEYS, "t.token", "t.token_type")


def technical_names(spark, d):
    rows = manual_lines(spark, d, "register", "bit", "signal", "pin", "arrow").withColumn("t", K.hardware_tokens(F.col("line")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (K.value_tokens(F.col("line")) if k == "value" else K.names_of(F.col("t"), k)).alias("names")) for k in ("register", "counter", "signal", "value")))
    return rows.select(*KEYS, F.explode(kinds).alias("k")).where(F.size("k.names") > 0).select(*KEYS, "k.kind", F.array_join("k.names", ",").alias("names"))


def ocr_text(spark, d):
    spoilt = F.replace(F.replace(F.col("line"), F.lit("_"), F.lit(" _ ")), F.lit("Register n "), F.lit("$"))
    rows = K.with_ocr(manual_lines(spark, d, "register", "signal", "pin").select(*KEYS, spoilt.alias("said")), "said")
    return rows.select(*KEYS, "normalized", F.array_join("candidates", ",").alias("candidates"), "token_type")


def driver_hints(spark, d):
    rows = manual_lines(spark, d, "arrow", "heading", "pin").select("line").distinct()
    return rows.select("line", K.profile_name(F.col("line")).alias("profile"), K.subsystem_hint(F.col("line")).alias("subsystem"), K.family_hint(F.col("line")).alias("family"), K.block_kind(F.col("line")).alias("block_kind"))


def sequence_topics_checked(spark, d):
    rows = manual_lines(spark, d, "heading", "step", "write")
    score = F.length("line") * 6
    status = F.when(F.col("pos") % 2 == 0, "complete").otherwise("partial")
    return rows.select(*KEYS, K.sequence_topic(F.col("line")).alias("topic"), K.sequence_id(F.col("filename"), F.col("line")).alias("sequence_id"), K.is_boilerplate(F.col("line")).alias("boilerplate"), K.is_trusted_topic(F.col("line")).alias("trusted"), K.sequence_confidence(score, status).alias("confidence"))


def caution_risks(spark, d):
    from folioscope.operators import guidance

    found = guidance.caution_lines(manual_lines(spark, d, "caution"))
    return found.select(*KEYS, K.caution_id(F.col("filename"), F.col("register"), F.col("type")).alias("caution_id"), "type", K.risk_of(F.col("type")).alias("risk"))


def figure_types(spark, d):
    return D.figure_types(_said(spark, d), ["filename", "page"])


def diagram_states(spark, d):
    return D.states(_said(spark, d))


def diagram_transitions(spark, d):
    return D.transitions(_said(spark, d))


def diagram_steps(spark, d):
    return D.numbered_steps(_said(spark, d))


def diagram_block_edges(spark, d):
    return D.block_edges(_said(spark, d))


def diagram_blocks(spark, d):
    return D.blocks(_said(spark, d))


#: First rows of the tables of word boxes as layouts; those of some pages are moved, some have no roles.
LAYOUTS = "SELECT filename, CAST(page AS int) AS page, CASE WHEN page % 5 = 0 THEN 'pinmux-table' ELSE 'register-table' END AS kind, CASE WHEN page % 3 = 0 THEN 'Register Name Offset Address' ELSE 'Pin Name Function 12' END AS header, x0 + CASE WHEN page % 7 = 1 THEN 60.0 ELSE 0.0 END AS x, cell, rows FROM {cells}"


def _layout_rows(spark, d):
    cells = tables.cells(manual_words(spark, d))
    rows = cells.groupBy("filename", "page").agg(F.countDistinct("row").alias("rows"))
    return spark.sql(LAYOUTS, cells=cells.where("row = 0").join(rows, ["filename", "page"]))


def table_layouts(spark, d):
    x = F.transform(F.sort_array(F.collect_list(F.struct("cell", "x"))), lambda c: c["x"])
    found = _layout_rows(spark, d).groupBy("filename", "page", "kind", "header", "rows").agg(x.alias("columns"))
    roles = F.when(F.col("page") % 2 == 0, F.array(F.lit("register"), F.lit("offset"))).otherwise(F.array(F.lit("unknown")))
    return tables.stitch_layouts(found.withColumn("roles", roles))


def table_pages(spark, d):
    line = F.concat(F.when(F.col("page") % 4 == 0, F.lit("Register Name ")).otherwise(""), F.lit("x Offset Address"))
    return tables.candidate_pages(manual_lines(spark, d, "register").select("filename", "page").distinct().withColumn("text", line))


QUERIES = {f.__name__: f for f in (table_layouts, table_pages, technical_tokens, technical_names, ocr_text, driver_hints, sequence_topics_checked, caution_risks, figure_types, diagram_states, diagram_transitions, diagram_steps, diagram_block_edges, diagram_blocks)}


# --- the same as SQL ----------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(_has(x, p) for p in patterns) + ")"


def _in(x: str, names) -> str:
    return f"{x} IN ({', '.join(map(_q, names))})"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


def _norm(x: str) -> str:
    return f"trim({_sub(_sub(f'translate(lower({x}), {_q(DASHES)}, {_q("-" * len(DASHES))})', r'[_\-./()\[\]{}:;,=+*<>|]+', ' '), r'\s+', ' ')})"


def _compact(x: str, most: int) -> str:
    flat = f"trim({_sub(x, r'\s+', ' ')})"
    return f"CASE WHEN length({flat}) > {most} THEN concat(substr({flat}, 1, {most - 3}), '...') ELSE {flat} END"


def _distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position(list_transform({xs}, lambda y: lower(y)), lower(x)) = i)"


def _tokens(text: str) -> str:
    return _distinct(f"list_filter(regexp_extract_all({text}, {_q(K.TOKEN)}), lambda t: length(t) >= 2)")


def _base(t: str) -> str:
    return f"regexp_replace(split_part({t}, '.', 1), '\\[[^\\]]+\\]', '', 'g')"


def _is_register(t: str) -> str:
    base = _base(t)
    return f"(NOT {_has(base, K.VALUE)} AND NOT ({_any(base, K.SIGNAL)} AND NOT {_has(base, '(?i)CNT|COUNT')}) AND NOT {_in(f'upper({base})', K.NON_SYMBOLS)} AND {_any(base, K.REGISTER)})"


def _type(t: str, context: str) -> str:
    pin = f"({_has(context, K.PIN_CONTEXT)} AND {_has(t, K.PIN_TOKEN)} AND NOT {_in(f'upper({t})', K.NON_SYMBOLS)})"
    return f"CASE WHEN {_has(t, K.VALUE)} THEN 'value' WHEN {_has(t, K.BITFIELD)} THEN 'bitfield' WHEN {_is_register(t)} THEN CASE WHEN {_has(t, K.COUNTER)} THEN 'counter' ELSE 'register' END WHEN {_any(t, K.SIGNAL)} OR {pin} THEN 'signal' ELSE 'unknown' END"


def _manual(*kinds: str) -> str:
    return f"(SELECT * FROM ({manual_sql()}) AS m WHERE {_in('kind', kinds)})"


def _typed(lines: str, text: str = "line") -> str:
    """Rows (keys, i, token, token_type) of known types."""
    inner = f"SELECT filename, page, pos, {text} AS text, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM (SELECT *, {_tokens(text)} AS toks FROM {lines} AS a) AS b"
    return f"(SELECT * FROM (SELECT *, {_type('token', 'text')} AS token_type FROM ({inner}) AS c) AS d WHERE token_type <> 'unknown')"


_LINES = _manual("register", "bit", "signal", "pin", "arrow")
_BASES = f"(SELECT *, {_base('token')} AS base FROM {_typed(_LINES)} AS t)"
_NAMED = " UNION ALL ".join(f"SELECT filename, page, pos, '{k}' AS kind, base, i FROM {_BASES} AS t WHERE {w}" for k, w in (("register", "token_type = 'register'"), ("counter", f"token_type = 'counter' OR {_has('token', '(?i)CNT|counter')}"), ("signal", "token_type = 'signal'")))
_VALUES = f"SELECT filename, page, pos, 'value' AS kind, unnest(v) AS base, generate_subscripts(v, 1) AS i FROM (SELECT *, regexp_extract_all(line, {_q(K.VALUE_WITHIN)}) AS v FROM {_LINES} AS a) AS b"


def _block(x: str) -> str:
    flat = _norm(x)
    return "CASE " + " ".join(f"WHEN {_has(flat, p)}{f' OR {_is_register(x)}' if k == 'register' else ''} THEN '{k}'" for k, p in K.BLOCK_KINDS) + " ELSE 'unknown' END"


def _profile(x: str) -> str:
    flat = _sub(_sub(_sub(f"lower(trim({x}))", "[^a-z0-9_-]+", "-"), "-+", "-"), "^-+|-+$", "")
    return f"CASE WHEN {flat} = '' THEN 'generic' ELSE {flat} END"


def _hint(x: str, rules) -> str:
    raw = f"lower(trim({x}))"
    when = lambda p: f"{raw} = {_q(p[1:])}" if p[0] == "=" else f"contains({raw}, {_q(p.replace('_', ' '))})"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(when, parts.split()))} THEN '{label}'" for label, parts in rules) + f" ELSE {_profile(x)} END"


_SPOILT = "replace(replace(line, '_', ' _ '), 'Register n ', '$')"


def _cleaned(x: str) -> str:
    out = f"replace({_sub(x, '[{}$]', '')}, '\\_', '_')"
    for mark in ("_", r"\.", r"\[", r"\]"):
        out = _sub(out, rf"\s*{mark}\s*", mark.lstrip("\\"))
    out = f"trim({_sub(out, r'\s+', ' ')})"
    out = _sub(out, r"\b([A-Z]{2,}[A-Z0-9]*)_([A-Z0-9])\b", r"\1\2")
    return f"trim({_sub(out, r'\b([A-Z]{2}[A-Z0-9]+)\s+([A-Z])\b', r'\1\2')})"


def _known(text: str) -> str:
    """Tokens of known types of a text, as a list of (t, k)."""
    return f"list_filter(list_transform({_tokens(text)}, lambda t: {{'t': t, 'k': {_type('t', text)}}}), lambda x: x.k <> 'unknown')"


def _candidate(clean: str, known: str) -> str:
    joined = _sub(_sub(clean, r"\s+", ""), r"[^A-Za-z0-9_.:\[\]]+", "")
    return f"CASE WHEN len({known}) = 1 AND upper({known}[1].t) = upper({joined}) THEN {known}[1].t WHEN {_has(joined, r'^[A-Za-z][A-Za-z0-9_.:\[\]]+$')} AND length({joined}) >= 3 THEN {joined} ELSE '' END"


def _confused(s: str) -> str:
    o, i = _has(s, "[O0]"), _has(s, "[Il1]")
    each = f"[{s}, CASE WHEN {o} THEN replace({s}, 'O', '0') END, CASE WHEN {o} THEN replace({s}, '0', 'O') END, CASE WHEN {i} THEN translate({s}, 'Il', '11') END, CASE WHEN {i} THEN replace({s}, '1', 'I') END]"
    return f"list_filter({each}, lambda c: c IS NOT NULL AND c <> '')"


_O1 = f"SELECT filename, page, pos, {_SPOILT} AS said, {_cleaned(_SPOILT)} AS clean FROM {_manual('register', 'signal', 'pin')} AS a"
_O2 = f"SELECT *, {_known('clean')} AS known FROM ({_O1}) AS b"
_O3 = f"SELECT *, {_candidate('clean', 'known')} AS candidate FROM ({_O2}) AS c"
_O4 = f"SELECT *, CASE WHEN candidate <> '' AND NOT {_has('clean', r'\s')} THEN candidate ELSE clean END AS normal, list_concat(CASE WHEN candidate <> '' THEN {_confused('candidate')} ELSE [] END, flatten(list_transform(known, lambda y: {_confused('y.t')}))) AS variants FROM ({_O3}) AS d"
_O5 = f"SELECT *, {_known('normal')} AS found, list_filter(regexp_extract_all(normal, {_q(K.VALUE_WITHIN)}), lambda v: true) AS vals, {_cleaned('normal')} AS again FROM ({_O4}) AS e"
_O6 = f"SELECT *, {_known('again')} AS known2, array_to_string({_distinct('vals')}, ' ') AS joined FROM ({_O5}) AS f"
_O7 = f"SELECT *, {_candidate('again', 'known2')} AS candidate2, list_transform(found, lambda x: x.k) AS kinds, concat(normal, ' ', said) AS context FROM ({_O6}) AS g"
_OCR = f"""SELECT filename, page, pos, {_compact('normal', 500)} AS normalized, array_to_string(list_slice({_distinct('variants')}, 1, 8), ',') AS candidates,
CASE WHEN len(found) = 1 THEN CASE kinds[1] WHEN 'counter' THEN 'register' ELSE kinds[1] END WHEN joined <> '' AND joined = trim(normal) THEN 'value' WHEN list_contains(kinds, 'bitfield') THEN 'bitfield'
WHEN list_contains(kinds, 'register') OR list_contains(kinds, 'counter') THEN 'register' WHEN list_contains(kinds, 'signal') THEN 'signal'
WHEN candidate2 <> '' THEN CASE {_type('candidate2', 'context')} WHEN 'counter' THEN 'register' ELSE {_type('candidate2', 'context')} END WHEN normal <> '' THEN 'normal_text' ELSE 'unknown' END AS token_type FROM ({_O7}) AS h"""

_TOPIC = "trim(regexp_replace(line, '^\\d+(?:\\.\\d+)*\\s+', ''))"
_BOILED = f"(trim(line) = '' OR {_any('trim(line)', K.BOILERPLATE)})"
_TRUSTED = f"({_TOPIC} <> '' AND length({_TOPIC}) <= {K.TOPIC_CHARS} AND NOT {_any(_TOPIC, K.BOILERPLATE)} AND {_has(_TOPIC, K.TOPIC_WORDS)} AND NOT ({_has(_TOPIC, K.TOPIC_REGISTER)} AND NOT {_has(_TOPIC, K.TOPIC_STEPS)}) AND NOT ({_has(_TOPIC, '[.!?]')} AND len(string_split_regex({_TOPIC}, '\\s+')) > {K.TOPIC_SENTENCE}))"


def _slug(x: str) -> str:
    return _sub(_sub(_norm(x), r"\s+", "-"), "[^a-z0-9-]", "")


_SAID = f"({_said_sql(_manual('signal', 'arrow', 'caption'))})"
_PIECES = f"(SELECT filename, page, pos, kind, part - 1 AS part, text FROM (SELECT filename, page, pos, kind, unnest(p) AS text, generate_subscripts(p, 1) AS part FROM (SELECT *, list_filter(list_transform(string_split_regex(line, '[\\r\\n;]+'), lambda x: {_compact('x', 500)}), lambda x: x <> '') AS p FROM {_SAID} AS s) AS u) AS v)"


def _first(rows: str, by: str, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, page, {by} ORDER BY {order}) AS nth FROM {rows} AS r) AS w WHERE nth = 1)"


def _spoken() -> str:
    flat, parts = _norm("line"), []
    for n, (kind, options) in enumerate(D.FIGURE_EVIDENCE):
        points = "CASE " + " ".join(f"WHEN {' AND '.join(_has(flat, p) for p in patterns)} THEN {worth}" for worth, patterns in options) + " END"
        parts.append(f"SELECT filename, page, '{kind}' AS figure_type, {points} AS points, (pos, {n}) AS spot FROM {_SAID} AS s")
    named = f"(SELECT filename, page, max(kind) AS kind, max(pos) AS pos FROM {_SAID} AS s GROUP BY filename, page)"
    parts += [f"SELECT filename, page, '{kind}', {D.KIND_POINTS}, (pos + 1, {n}) FROM {named} AS k WHERE {_has('kind', f'(?i){p}')}" for n, (kind, p) in enumerate(D.KIND_EVIDENCE)]
    return " UNION ALL ".join(parts)


_RANKED = f"SELECT *, row_number() OVER w AS n, lead(points, 1, 0) OVER w AS nxt FROM (SELECT filename, page, figure_type, CAST(sum(points) AS int) AS points, min(spot) AS spot FROM ({_spoken()}) AS e WHERE points IS NOT NULL GROUP BY filename, page, figure_type) AS g WINDOW w AS (PARTITION BY filename, page ORDER BY points DESC, spot)"
_TYPES = f"""SELECT s.filename, s.page, CASE WHEN points >= {D.LEAST_POINTS} THEN figure_type ELSE 'unknown' END AS figure_type, coalesce(points, 0) AS points,
round(CASE WHEN points >= {D.LEAST_POINTS} THEN least({D.SURE_MOST}, {D.SURE_BASE} + CAST({D.SURE_POINT} AS DOUBLE) * points + CAST({D.SURE_MARGIN} AS DOUBLE) * (points - nxt)) ELSE {D.SURE_NONE} END, 3) AS confidence
FROM (SELECT DISTINCT filename, page FROM {_SAID} AS x) AS s LEFT JOIN (SELECT * FROM ({_RANKED}) AS r WHERE n = 1) AS b ON s.filename = b.filename AND s.page = b.page"""

_STATE = f"trim(regexp_replace(regexp_replace({_compact('text', 120)}, '(?i)^(?:state|mode)\\s*[:=\\-]\\s*', ''), '(?i)\\s+(?:state|mode)$', ''))"
_STATES = f"SELECT filename, page, pos, state FROM {_first(f'(SELECT * FROM (SELECT *, {_STATE} AS state FROM {_PIECES} AS p) AS q WHERE length(state) BETWEEN 2 AND {D.STATE_CHARS} AND {_has("state", D.STATE_WORD)} AND len(string_split_regex(state, {_q(r"\s+")})) <= {D.STATE_WORDS})', _norm('state'), 'pos, part')} AS z"


def _ends(condition: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex(text, {_q(D.ARROWS)}), lambda x: {_compact('x', 120)}), lambda x: x <> '')"
    return f"SELECT *, unnest(a) AS source, unnest(b) AS target, {condition} AS condition, generate_subscripts(a, 1) AS i FROM (SELECT *, list_slice(l, 1, len(l) - 1) AS a, list_slice(l, 2, len(l)) AS b FROM (SELECT *, {parts} AS l FROM {_PIECES} AS p) AS q WHERE len(l) > 1) AS r"


def _sentence(pattern: str, unless: str) -> str:
    part = lambda i, n: _compact(f"regexp_extract(text, {_q(pattern)}, {i})", n)
    return f"SELECT filename, page, pos, part, text, {part(1, 80)} AS source, {part(2, 80)} AS target, {part(3, 160)} AS condition, 1000 AS i FROM {_PIECES} AS p WHERE {_has('text', pattern)}{unless}"


_FOUND = f"(SELECT filename, page, pos, part, text, source, target, condition, i FROM ({_ends(_q(''))}) AS a UNION ALL {_sentence(D.TRANSITIONS[0], '')} UNION ALL {_sentence(D.TRANSITIONS[1], f' AND NOT {_has("text", D.TRANSITIONS[0])}')})"
_TRIGGERED = f"SELECT filename, page, pos, part, i, source, target, CASE WHEN condition <> '' THEN condition ELSE regexp_extract(text, {_q(D.TRIGGER)}, 0) END AS condition FROM {_FOUND} AS f"
_LONELY = f"SELECT filename, page, pos, part, 0 AS i, '' AS source, '' AS target, {_compact('text', 180)} AS condition FROM {_PIECES} AS p WHERE {_has('text', D.STATE_WORD)} AND {_has('text', D.TRIGGER)} AND {_has('text', '(?i)\\b(?:when|if|after|on)\\b')} AND NOT EXISTS (SELECT 1 FROM {_FOUND} AS f WHERE f.filename = p.filename AND f.page = p.page AND f.pos = p.pos AND f.part = p.part)"
_TRANSITIONS = f"SELECT filename, page, pos, source, target, condition FROM {_first(f'({_TRIGGERED} UNION ALL {_LONELY})', f'{_norm("source")}, {_norm("target")}, {_norm("condition")}', 'pos, part, i')} AS z"

_NUMBER = lambda i: f"CASE WHEN {_has('text', D.NUMBERED[0])} THEN regexp_extract(text, {_q(D.NUMBERED[0])}, {i}) WHEN {_has('text', D.NUMBERED[1])} THEN regexp_extract(text, {_q(D.NUMBERED[1])}, {i}) END"
_STEPS0 = f"(SELECT *, CAST({_NUMBER(1)} AS int) AS number, {_compact(_NUMBER(2), 320)} AS said FROM {_PIECES} AS p WHERE {_has('text', D.NUMBERED[0])} OR {_has('text', D.NUMBERED[1])})"
_STEPS1 = f"(SELECT *, list_transform(list_filter({_known('said')}, lambda x: x.k = 'register'), lambda x: {_base('x.t')}) AS all_names FROM {_first(_STEPS0, f'number, {_norm("said")}', 'pos, part')} AS o)"
_STEPS2 = f"(SELECT *, {_distinct('all_names')} AS names, regexp_extract({_compact('said', 260)}, {_q(D.ACTION)}, 0) AS act FROM {_STEPS1} AS o)"
_STEPS = f"""SELECT filename, page, pos, number AS step, CASE WHEN len(names) > 0 THEN names[1] ELSE regexp_extract(said, {_q(D.ACTOR)}, 0) END AS actor,
CASE WHEN act <> '' THEN {_compact('act', 220)} ELSE {_compact('said', 260)} END AS action, CASE WHEN len(names) > 0 THEN names[least(len(names), 2)] ELSE regexp_extract(said, {_q(D.TARGET)}, 0) END AS target,
{_compact(f'regexp_extract(said, {_q(D.CONDITION)}, 0)', 180)} AS condition, lead(number) OVER (PARTITION BY filename, page ORDER BY number, pos, part) AS ordered_before FROM {_STEPS2} AS q"""


def _endpoint(x: str) -> str:
    name = f"trim({_sub(_sub(_compact(x, 80), r'''^[\s"'`(\[{]+|[\s"'`)\]}]+$''', ''), '[,:.]+$', '')})"
    return f"CASE WHEN length({name}) BETWEEN 2 AND 80 AND NOT {_has(name, D.NO_ENDPOINT)} THEN {name} ELSE '' END"


_DRAWN = f"SELECT filename, page, pos, part, text, unnest(a) AS source, unnest(b) AS target, '' AS label, generate_subscripts(a, 1) AS i FROM (SELECT *, list_slice(l, 1, len(l) - 1) AS a, list_slice(l, 2, len(l)) AS b FROM (SELECT *, list_filter(list_transform(string_split_regex(text, {_q(D.ARROWS)}), lambda x: {_endpoint('x')}), lambda x: x <> '') AS l FROM {_PIECES} AS p WHERE {_has('text', '->|=>')}) AS q WHERE len(l) > 1) AS r"
_CONNECTED = " UNION ALL ".join(f"SELECT filename, page, pos, part, text, {_endpoint(f'regexp_extract(text, {_q(p)}, 1)')}, {_endpoint(f'regexp_extract(text, {_q(p)}, 2)')}, '{label}', {1000 + n} FROM {_PIECES} AS p WHERE {_has('text', p)}" for n, (label, p) in enumerate(D.CONNECTIONS))
_EDGES = f"SELECT filename, page, pos, source, target, label, CASE {' '.join(f'WHEN {_has(_norm("CASE WHEN label <> chr(0) AND label <> {q} THEN label ELSE text END".format(q=_q(""))), p)} THEN {_q(k)}' for k, p in D.EDGE_KINDS)} ELSE 'unknown' END AS kind FROM {_first(f'(SELECT * FROM ({_DRAWN} UNION ALL {_CONNECTED}) AS e WHERE source <> {_q("")} AND target <> {_q("")} AND {_norm("source")} <> {_norm("target")})', f'{_norm("source")}, {_norm("target")}, {_norm("label")}', 'pos, part, i')} AS z"

_LABEL = _compact("text", 100)
_WHOLE = f"SELECT filename, page, pos, part, 0 AS i, {_LABEL} AS block FROM {_PIECES} AS p WHERE length({_LABEL}) BETWEEN 2 AND 100 AND NOT {_has('text', '(?i)->|=>|connected to|feeds|drives|input to|output to')} AND {_block(_LABEL)} <> 'unknown'"
_PARTS = f"SELECT filename, page, pos, part, i, x.t FROM (SELECT filename, page, pos, part, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT *, {_known('text')} AS k FROM {_PIECES} AS p) AS q) AS r WHERE x.k IN ('register', 'signal', 'counter') OR {_block('x.t')} <> 'unknown'"
_BLOCKS = f"SELECT filename, page, pos, block, {_block('block')} AS kind, {_has('block', '(?i)\\b(?:clk|clock|rst|reset|irq|int|req|ack|rx|tx|sda|scl)\\b')} AS port FROM {_first(f'({_WHOLE} UNION ALL {_PARTS})', _norm('block'), 'pos, part, i')} AS z"


def _layouts_sql(cells: str) -> str:
    first = f"(SELECT c.*, rows FROM {cells} AS c JOIN (SELECT filename, page, count(DISTINCT \"row\") AS rows FROM {cells} AS d GROUP BY filename, page) AS n USING (filename, page) WHERE \"row\" = 0)"
    tables_ = f"SELECT filename, page, kind, header, rows, list(x ORDER BY cell) AS xs, page % 2 = 0 AS known FROM ({LAYOUTS.replace('{cells}', first + ' AS f')}) AS l GROUP BY filename, page, kind, header, rows"
    before = f"SELECT *, lag(page) OVER w AS p, lag(kind) OVER w AS k, lag(xs) OVER w AS o, lag(known) OVER w AS kn, lag(header) OVER w AS hd FROM ({tables_}) AS t WINDOW w AS (PARTITION BY filename ORDER BY page, kind)"
    aligned = "len(xs) > 0 AND abs(len(xs) - len(o)) <= 1 AND len(list_filter(range(1, least(len(xs), len(o)) + 1), lambda i: abs(xs[i] - o[i]) <= 24)) / least(len(xs), len(o)) >= 0.7"
    marked = f"SELECT *, CASE WHEN coalesce(page = p + 1 AND kind = k AND {aligned} AND CASE WHEN known AND kn THEN true WHEN known <> kn THEN false ELSE header = hd END, false) THEN 0 ELSE 1 END AS new FROM ({before}) AS b"
    runs = f"SELECT *, sum(new) OVER (PARTITION BY filename ORDER BY page, kind) AS run FROM ({marked}) AS m"
    nth = f"SELECT *, row_number() OVER (PARTITION BY filename, run ORDER BY page) - 1 AS nth, CASE WHEN kind = 'pinmux-table' THEN 4 ELSE 2 END AS span FROM ({runs}) AS r"
    return f"SELECT filename, kind, min(page) AS page_start, max(page) AS page_end, CAST(sum(rows - CASE WHEN nth % span = 0 THEN 0 ELSE 1 END) AS bigint) AS rows FROM ({nth}) AS q GROUP BY filename, kind, run, nth // span"


def oracles(caution_lines: str, cells: str) -> dict[str, str]:
    """SQL by query; caution_lines is a subquery of (filename, page, pos, type, register), cells one of table cells."""
    signed = f"SELECT DISTINCT filename, page FROM {_manual('register')} AS m WHERE page % 4 = 0"
    risks = "CASE type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in K.RISKS.items()) + f" ELSE {_q(K.OTHER_RISK)} END"
    ident = lambda part, name: f"concat(filename, ':{part}:', CASE WHEN {name} = '' THEN 'unknown' ELSE {name} END)"
    score, status = "length(line) * 6", "pos % 2 = 0"
    return {
        "table_layouts": _layouts_sql(cells),
        "table_pages": f"SELECT DISTINCT m.filename, m.page FROM {_manual('register')} AS m JOIN ({signed}) AS s ON m.filename = s.filename AND abs(m.page - s.page) <= 1",
        "technical_tokens": f"SELECT filename, page, pos, token, token_type FROM {_typed(_LINES)} AS t",
        "technical_names": f"SELECT filename, page, pos, kind, string_agg(base, ',' ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY filename, page, pos, kind, lower(base) ORDER BY i) AS n FROM ({_NAMED} UNION ALL {_VALUES}) AS a) AS b WHERE n = 1 GROUP BY filename, page, pos, kind",
        "ocr_text": _OCR,
        "driver_hints": f"SELECT line, {_profile('line')} AS profile, {_hint('line', K.SUBSYSTEMS)} AS subsystem, {_hint('line', K.FAMILIES)} AS family, {_block('line')} AS block_kind FROM (SELECT DISTINCT line FROM {_manual('arrow', 'heading', 'pin')} AS m) AS l",
        "sequence_topics_checked": f"SELECT filename, page, pos, trim({_sub(_sub('line', '[_\\-]+', ' '), '\\s+', ' ')}) AS topic, {ident('seq', _slug('line'))} AS sequence_id, {_BOILED} AS boilerplate, {_TRUSTED} AS trusted, CASE WHEN {score} >= 220 AND {status} THEN 'high' WHEN {score} >= 120 THEN 'medium' ELSE 'low' END AS confidence FROM {_manual('heading', 'step', 'write')} AS m",
        "caution_risks": f"SELECT filename, page, pos, {ident('caution', _slug("concat(type, ' ', register)"))} AS caution_id, type, {risks} AS risk FROM {caution_lines} AS c",
        "figure_types": _TYPES,
        "diagram_states": _STATES,
        "diagram_transitions": _TRANSITIONS,
        "diagram_steps": _STEPS,
        "diagram_block_edges": _EDGES,
        "diagram_blocks": _BLOCKS,
    }
