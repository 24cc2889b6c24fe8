"""Queries over detected passages and their hybrid ranking, with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioscope.functions.text import DASHES, STOP_WORDS
from folioscope.operators import pages
from folioscope.operators import passages as P
from folioscope.sources.corpora import prose_pages

KEYS = ["filename", "page", "chunk_index"]
#: Intent and query of the ranking: words of the invented language, and of manuals.
RANKED = P.HybridQuery("than there, over the thing register", "caution")


def passage_names(spark, d):
    rows = P.detected(pages.chunks(prose_pages(spark, d)))
    joined = [F.array_join(c, "|").alias(c) for c in ("headings", "registers", "bit_fields", "symbols")]
    return rows.select(*KEYS, *joined)


def passage_kinds(spark, d):
    rows = P.detected(pages.chunks(prose_pages(spark, d))).withColumn("k", P.kind())
    return rows.select(*KEYS, "k.chunk_type", F.array_join("k.types", ",").alias("types"), "k.noise", "k.content")


def search_ranked(spark, d):
    return P.hybrid_rank(pages.chunks(prose_pages(spark, d)), RANKED, KEYS, 50)


QUERIES = {f.__name__: f for f in (passage_names, passage_kinds, search_ranked)}


# --- the same as SQL ----------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _all(x: str, patterns) -> str:
    return "(" + " AND ".join(_has(x, p) for p in patterns) + ")"


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(_has(x, p) for p in patterns) + ")"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '{DASHES}', '------'), '[_\\-./()\\[\\]{{}}:;,=+*<>|]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _symbol(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9_]', '', 'g')"


def _distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _extracted(patterns) -> str:
    out = f"regexp_extract_all(text, {_q(patterns[0])})"
    for p in patterns[1:]:
        out = f"list_concat({out}, regexp_extract_all(text, {_q(p)}))"
    return out


def _points(checks) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in checks) or "0"


def _with(chunks: str) -> str:
    """CTEs up to prepared: everything the ranking and the kinds need, by passage."""
    heading = f"({_any('x', P.HEADINGS)} OR ({_has('x', P.HEADING_WORDS)} AND length(x) <= {P.HEADING_WORD_CHARS}) OR {_all('x', P.HEADING_CAPS)})"
    flags: list[tuple[str, int, int, str]] = [("noise", -20, 45, f"(trim(text) = '' OR length(text) < {P.SHORT_CHARS})")]
    toc = f"({_has('text', P.CONTENTS)} OR ({_has(_norm("array_to_string(headings, ' ')"), P.INDEX_HEADING)} AND n_lines > {P.TOC_LINES}) OR (n_lines >= {P.TOC_LINES} AND referring / n_lines > {P.TOC_SHARE}) OR (contains({_norm('text')}, 'contents') AND chapters >= {P.TOC_CHAPTERS}))"
    flags.append(("toc_index", -35, 70, toc))
    flags += [(n, c, z, _all("text", needs) + (f" AND NOT {_has('text', without)}" if without else "")) for n, c, z, needs, without in P.KINDS]
    flags.append(("register_description", 35, -8, f"len(registers) > 0 AND {_has('text', P.REGISTER_WORDS)}"))
    flags.append(("bitfield_table", 30, -8, f"len(bit_fields) >= 2 AND {_has('text', P.BITFIELD_WORDS)}"))
    flags.append(("overview", 18, -3, f"({_has('text', P.OVERVIEW)} OR len(list_filter(headings, lambda h: {_has('h', P.OVERVIEW_HEADING)})) > 0)"))
    flags.append(("noise", -25, 35, f"n_lines > {P.CAPS_LINES} AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1) > {P.CAPS_SHARE} AND NOT is_register AND NOT is_bit"))
    flags.append(("toc_index", -25, 45, f"len(regexp_extract_all(text, {_q('(?m)' + P.PAGE_REF)})) >= {P.TOC_REFS} AND NOT is_register"))
    columns = ", ".join(f"({c}) AS f{i}" for i, (_, _, _, c) in enumerate(flags))
    of = lambda name: "(" + (" OR ".join(f"f{i}" for i, f in enumerate(flags) if f[0] == name) or "false") + ")"
    content = f"{P.START} + " + _points([(f"f{i}", f[1]) for i, f in enumerate(flags)])
    noise = _points([(f"f{i}", f[2]) for i, f in enumerate(flags)])
    types = "list_filter([" + ", ".join(f"CASE WHEN {of(k)} THEN '{k}' END" for k in P.PRIORITY[:-1]) + "], lambda t: t IS NOT NULL)"
    is_register = next(_all("text", k[3]) for k in P.KINDS if k[0] == "register_table")
    is_bit = f"({next(_all('text', k[3]) for k in P.KINDS if k[0] == 'bitfield_table')} OR (len(bit_fields) >= 2 AND {_has('text', P.BITFIELD_WORDS)}))"
    useful = " OR ".join(of(k) for k in ("register_table", "bitfield_table", "procedure", "caution"))
    return f"""WITH RECURSIVE {chunks},
split AS (SELECT filename, page, chunk_index, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS plain,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS tidy,
  list_filter({_extracted(P.REGISTERS)}, lambda x: length(x) BETWEEN 3 AND 80) AS r,
  list_filter(list_transform({_extracted(P.BITFIELDS)}, lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: length(x) BETWEEN 2 AND 40) AS b FROM parts),
named AS (SELECT filename, page, chunk_index, text, plain, list_slice({_distinct('r')}, 1, {P.MOST_REGISTERS}) AS registers, list_slice({_distinct('b')}, 1, {P.MOST_BITFIELDS}) AS bit_fields,
  list_transform(list_slice(list_filter(tidy, lambda x: {heading}), 1, {P.MOST_HEADINGS}), lambda x: substr(x, 1, {P.HEADING_CHARS})) AS h FROM split),
measured AS (SELECT *, {_distinct('h')} AS headings, list_transform(list_concat(registers, bit_fields), lambda x: {_symbol('x')}) AS s, len(plain) AS n_lines,
  len(list_filter(plain, lambda x: {_has('x', P.PAGE_REF)} OR {_has('x', P.NUMBERED_REF)})) AS referring, len(list_filter(plain, lambda x: {_has('x', P.CHAPTER)})) AS chapters FROM named),
symbolled AS (SELECT *, list_filter({_distinct('s')}, lambda x: x <> '') AS symbols, ({is_register}) AS is_register, ({is_bit}) AS is_bit FROM measured),
flagged AS (SELECT *, {columns} FROM symbolled),
summed AS (SELECT *, {content} AS c0, CASE WHEN {useful} THEN greatest(({noise}) - {P.USEFUL}, 0) ELSE {noise} END AS n0, {types} AS t0 FROM flagged),
kinded AS (SELECT *, CASE WHEN len(t0) > 0 THEN t0 ELSE ['text'] END AS types, CAST(least(greatest(n0, 0), 100) AS int) AS noise, CAST(least(greatest(c0 - floor(n0 / 3 + 0.5), 0), 100) AS int) AS content,
  concat_ws(chr(10), text, array_to_string(headings, chr(10)), array_to_string(registers, chr(10)), array_to_string(bit_fields, chr(10))) AS raw,
  {_norm("array_to_string(headings, chr(10))")} AS head_flat, {_norm("array_to_string(registers, chr(10))")} AS reg_flat, {_norm("array_to_string(bit_fields, chr(10))")} AS bit_flat,
  {_symbol("concat_ws(chr(10), array_to_string(registers, chr(10)), array_to_string(bit_fields, chr(10)), array_to_string(headings, chr(10)), text)")} AS canonical FROM summed),
flattened AS (SELECT *, {_norm('raw')} AS flat FROM kinded),
tokened AS (SELECT *, list_filter(string_split(flat, ' '), lambda t: length(t) > 1 AND NOT list_contains([{', '.join(map(_q, STOP_WORDS))}], t)) AS toks FROM flattened),
ready AS (SELECT *, list_slice({_distinct('toks')}, 1, {P.DISTINCT_TOKENS}) AS words, len(toks) AS dl FROM tokened)"""


def _ranked_sql(q: P.HybridQuery) -> str:
    holds = lambda where, t: f"contains({where}, {_q(t)})"
    member = lambda xs, t: f"list_contains({xs}, {_q(t)})"
    checks = [(holds("flat", q.phrase), 70), (holds("head_flat", q.phrase), 45), (holds("reg_flat", q.phrase), 90), (holds("bit_flat", q.phrase), 60), (member("symbols", q.symbol), 120)]
    checks += [(member("symbols", s), 60) for s in q.symbols]
    for t in q.all_words:
        checks += [(holds("head_flat", t), 12), (holds("reg_flat", t), 20), (holds("bit_flat", t), 14)]
    checks += [(_has("raw", p), n) for p, n in P.VOCABULARY]
    checks += [(holds("flat", q.phrase), 130), (member("symbols", q.symbol), 160)]
    counts = [f"25 * len(list_filter(symbols, lambda s: contains(s, {_q(q.symbol)}) OR contains({_q(q.symbol)}, s)))"]
    counts += [f"10 * len(regexp_extract_all(flat, {_q(chr(92) + 'b' + re.escape(t) + chr(92) + 'b')})) + 2 * CAST((length(flat) - length(replace(flat, {_q(t)}, ''))) / {len(t)} AS int)" for t in q.all_words]
    kinds = lambda names: f"len(list_intersect(types, [{', '.join(map(_q, names))}])) > 0"
    counts.append("CAST(floor(content / 8 + 0.5) AS int) - CASE WHEN noise >= 75 THEN 120 WHEN noise >= 50 THEN 55 ELSE 0 END")
    if not q.has("section", "table"):
        checks.append((kinds(("toc_index", "revision_history", "legal_notice", "noise")), -85))
    checks += [(kinds(k), n) for intents, n, k in P.BOOSTS if q.has(*intents)]
    counts.append(f"least({_points([(f'{member("symbols", a)} OR {holds("canonical", a)}', 45) for a in q.aliases])}, 180)")
    covered = _points([(f"{member('words', t)} OR {holds('flat', t)}", 1) for t in q.important])
    counts.append(f"CAST(floor(120.0 * ({covered}) / {len(q.important)} + 0.5) AS int)")
    counts += [f"CASE WHEN {member('words', t)} THEN 4 WHEN {holds('flat', t)} THEN 2 ELSE 0 END" for t in q.expanded]
    for t in [t for t in q.important if len(t) >= 4][:12]:
        near = f"len(list_filter(words, lambda w: abs(length(w) - {len(t)}) <= 2 AND w <> '' AND (w = {_q(t)} OR (greatest(length(w), {len(t)}) > 2 AND 1 - levenshtein(w, {_q(t)}) / greatest(length(w), {len(t)}) >= 0.86)))) > 0"
        checks.append((f"NOT {member('words', t)} AND {near}", 12))
    checks += [(_has("raw", p), n) for intents, n, p in P.LANGUAGE if q.has(*intents)]
    checks.append(("head_flat <> ''", 25) if q.has("section") else (_has("raw", P.FRONT_MATTER), -20))
    if q.has("table"):
        counts.append(f"least(16 * len(regexp_extract_all(raw, {_q(P.TABLE_WORDS)})), 90)")
    checks.append(("length(text) < 80", -25))
    told = P._kept([q.phrase, *P._kept([*q.important, *q.expanded], 40)], 99)
    lines = f"list_filter(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\x{{A0}} ]+', ' ', 'g')))), lambda x: length(x) >= 3 AND ({' OR '.join(f'contains({_norm("x")}, {_q(t)})' for t in told)}))"
    counts.append(f"least(10 * least(len({lines}), 6), 40)")
    wanted = [t for t in q.important if len(t) > 1][:24]
    places = "[" + ", ".join(f"list_slice(list_filter(list_transform(toks, lambda t, n: CASE WHEN t = {_q(t)} THEN n END), lambda x: x IS NOT NULL), 1, {P.PLACES})" for t in wanted) + "]"
    pairs = "list_concat([], " * 0 + "flatten(flatten([" + ", ".join(f"list_transform(pl[{a + 1}], lambda x: list_transform(list_filter(pl[{b + 1}], lambda y: abs(y - x) <= {P.WINDOW}), lambda y: abs(y - x)))" for a in range(len(wanted)) for b in range(a + 1, len(wanted))) + "]))"
    idf = lambda i: f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5))"
    tf = lambda t: f"len(list_filter(toks, lambda x: x = {_q(t)}))"
    bm25 = " + ".join(f"CASE WHEN {member('toks', t)} THEN {idf(i)} * ({tf(t)} * CAST({P.K1 + 1} AS DOUBLE) / ({tf(t)} + CAST({P.K1} AS DOUBLE) * (CAST({1 - P.B} AS DOUBLE) + CAST({P.B} AS DOUBLE) * greatest(dl, 1) / mean))) * CAST({q.weight(t)} AS DOUBLE) ELSE 0 END" for i, t in enumerate(q.counted))
    seen = ", ".join(f"count(*) FILTER (WHERE {member('toks', t)}) AS df{i}" for i, t in enumerate(q.counted))
    return f""",
stats AS (SELECT greatest(count(*), 1) AS docs, greatest(coalesce(avg(dl), 1.0), 1.0) AS mean, {seen} FROM ready),
near AS (SELECT *, {places} AS pl FROM ready),
close AS (SELECT *, {pairs} AS gaps FROM near),
scored AS (SELECT *, {_points(checks)} + {' + '.join(counts)} AS sure, CASE WHEN len(gaps) > 0 THEN least({P.MOST_PROXIMITY}.0, len(gaps) * 8 + ({P.WINDOW} - list_min(gaps)) * {P.WINDOW_WEIGHT} / {P.WINDOW}) ELSE 0 END AS closeness, CAST(floor(({bm25}) * {P.BM25_WEIGHT} + 0.5) AS int) AS bm25 FROM close, stats)
SELECT filename, page, chunk_index, types[1] AS chunk_type, bm25, CAST(floor(sure + closeness + bm25 + 0.5) AS int) AS score FROM scored ORDER BY score DESC, filename, page, chunk_index LIMIT 50"""


def kinds_sql(chunks: str) -> str:
    return f"{_with(chunks)} SELECT filename, page, chunk_index, types[1] AS chunk_type, array_to_string(types, ',') AS types, noise, content FROM ready"


def oracles(chunks: str) -> dict[str, str]:
    """SQL by query; chunks are CTEs that end in parts (filename, page, chunk_index, text)."""
    ready = _with(chunks)
    joined = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("headings", "registers", "bit_fields", "symbols"))
    return {
        "passage_names": f"{ready} SELECT filename, page, chunk_index, {joined} FROM ready",
        "passage_kinds": kinds_sql(chunks),
        "search_ranked": ready + _ranked_sql(RANKED),
    }
