"""One query per operator group, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans import figure_queries, passage_queries
from folioscope.operators import bitfields, figures, guidance, pages, passages, quality, registers, review, search, tables
from folioscope.sources import artifacts
from folioscope.sources.corpora import manual_lines, manual_words, prose_pages, written_lines

#: The prose query: words of the invented language of the documents.
ASK = "than there, over the thing"
KEYS = ["filename", "page"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _page_text(lines: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("filename", "page").agg(text.alias("text"))


# --- text ---------------------------------------------------------------------------------------


def text_normalize(spark, d):
    flat = T.normalize_for_search(F.col("text"))
    plain = T.normalize_text(F.col("text"))
    return prose_pages(spark, d).select(*KEYS, F.length(flat).alias("n_search"), F.md5(flat.cast("binary")).alias("search"), F.length(plain).alias("n_plain"), F.md5(plain.cast("binary")).alias("plain"))


def text_symbols(spark, d):
    line = F.col("line")
    rows = manual_lines(spark, d, "register", "bit")
    return rows.select(*KEYS, "pos", T.canonical_symbol(line).alias("symbol"), T.canonical_hardware_symbol(line).alias("hardware"), T.slug(line).alias("slug"), T.comparable(line).alias("comparable"), T.compact(line, 40).alias("short"), T.stable_hash(line).alias("hash"))


def text_tokens(spark, d):
    toks = T.tokens(F.col("text"))
    return prose_pages(spark, d).select(*KEYS, F.size(toks).alias("tokens"), F.size(F.array_distinct(toks)).alias("distinct_tokens"))


def text_counts(spark, d):
    flat = T.normalize_for_search(F.col("text"))
    return prose_pages(spark, d).select(*KEYS, T.count_word(flat, "the").cast("int").alias("words"), T.count_loose(flat, "th").alias("loose"))


def text_fuzzy(spark, d):
    names = _table(spark, d, "part").select("p_type").distinct()
    return names.select("p_type", T.half_up(1000 * T.fuzzy_similarity(F.col("p_type"), F.lit("STANDARD POLISHED TIN"))).cast("int").alias("similarity"))


# --- pages --------------------------------------------------------------------------------------


def chunk_text(spark, d):
    return pages.chunks(prose_pages(spark, d)).select(*KEYS, "chunk_index", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def typed(rows):
    return T.once(passages.detected(rows), "c", passages.kind()).select(*KEYS, "c.chunk_type", F.array_join("c.types", ",").alias("types"), "c.noise", "c.content")


def _typed(spark, d):
    return typed(_page_text(manual_lines(spark, d)))


def chunk_profile(spark, d):
    return _typed(spark, d)


def chunk_type_stats(spark, d):
    return pages.chunk_type_stats(_typed(spark, d))


def section_index(spark, d):
    return pages.sections(manual_lines(spark, d)).select("section_id", *KEYS, "title", "type", "level", "confidence")


def section_search(spark, d):
    ask = "Reset Procedure"
    return pages.search_sections(written_lines(spark, d), ask, search.Query(ask).terms, 30).select(*KEYS, "title", "score")


def section_nearest(spark, d):
    rows = registers.list_rows(manual_lines(spark, d, "register"))
    headings = pages.sections(manual_lines(spark, d, "heading"))
    return pages.nearest_section(rows.select(*KEYS, "name"), headings).select(*KEYS, "name", "section_id")


# --- search -------------------------------------------------------------------------------------


def search_lexical(spark, d):
    return search.search(prose_pages(spark, d), ASK, 30, KEYS).select(*KEYS, "score")


def search_bm25(spark, d):
    return search.bm25(prose_pages(spark, d), ASK, KEYS)


def search_proximity(spark, d):
    return search.proximity(prose_pages(spark, d), ASK, KEYS)


def search_hybrid(spark, d):
    return search.hybrid_search(prose_pages(spark, d), ASK, 40, KEYS)


def search_fuzzy(spark, d):
    """Pages in any alphabet, by all their tokens."""
    return prose_pages(spark, d).select(*KEYS, search.fuzzy_points(F.col("text"), search.Query("thatin theren thingon")).alias("points"))


def search_evidence(spark, d):
    return search.evidence(pages.lines_of(prose_pages(spark, d)), ASK, KEYS, 3).select(*KEYS, "rank", "pos", "score", F.md5(F.col("context").cast("binary")).alias("context"))


def search_fusion(spark, d):
    docs = prose_pages(spark, d)
    both = search.search(docs, "than there", 200, KEYS).unionByName(search.search(docs, "over thing", 200, KEYS))
    return search.fuse(both, KEYS)


# --- registers and bit fields -------------------------------------------------------------------


def register_rows(spark, d):
    return registers.list_rows(manual_lines(spark, d))


def _registers(spark, d):
    lines = manual_lines(spark, d, "register", "bit", "step", "caution")
    return registers.index(registers.list_rows(lines), registers.symbol_rows(lines))


def register_index(spark, d):
    return _registers(spark, d)


def register_find(spark, d):
    return registers.find(_registers(spark, d), "PRTm_R17_n", 30).select("filename", "name", "score", "confidence")


def register_near_pages(spark, d):
    index = _registers(spark, d).where("explicit = 1")
    notes = guidance.caution_lines(manual_lines(spark, d, "caution")).select(*KEYS).distinct()
    met = registers.near_pages(notes, index, 1)
    return met.groupBy(*KEYS).agg(F.count("*").alias("registers"), F.min("name").alias("first_register"))


#: Bit lines as fields of a pseudo-register: some keep their text as evidence, some have none, some name a register.
ASKED = "SELECT filename, page, pos, line, CASE WHEN pos % 3 = 2 THEN regexp_extract(line, '(PRTm_R[0-9]+_n)', 1) ELSE 'PRTM_BASE' END AS source, CASE WHEN pos % 6 = 0 THEN regexp_extract(line, '(PRTm_R[0-9]+_n)', 1) ELSE '' END AS heading, CASE WHEN pos % 3 = 0 THEN line ELSE '' END AS evidence FROM {lines}"


def register_mapping(spark, d):
    asked = spark.sql(ASKED, lines=manual_lines(spark, d, "bit"))
    known = _registers(spark, d).select("filename", F.col("first_page").alias("page"), "name", "explicit")
    return registers.resolve(asked, known, [*KEYS, "pos"])


def bitfield_conflicts(spark, d):
    return bitfields.conflicts(bitfields.parse(manual_lines(spark, d, "bit")))


def bitfield_rows(spark, d):
    return bitfields.parse(manual_lines(spark, d))


def _fields(spark, d):
    return bitfields.merge(bitfields.parse(manual_lines(spark, d, "bit")))


def bitfield_index(spark, d):
    return _fields(spark, d)


def bitfield_validation(spark, d):
    lists = registers.list_rows(manual_lines(spark, d, "register")).groupBy("filename", "name").agg(F.min("access_size").alias("access_size"))
    return bitfields.retained(bitfields.validate(_fields(spark, d), lists)).select("filename", "register", "bitfield", "position", "register_width", "width", "status", "issues")


def bitfield_overlaps(spark, d):
    return bitfields.overlaps(_fields(spark, d))


# --- cautions and sequences ---------------------------------------------------------------------


def caution_lines(spark, d):
    return guidance.caution_lines(manual_lines(spark, d)).drop("line")


def caution_index(spark, d):
    topics = spark.sql("SELECT concat('manual', f) AS filename, topic FROM (SELECT explode(sequence(0, 4)) AS f) CROSS JOIN (VALUES ('reserved bits'), ('flag'), ('transfer is stopped'), ('reset'), ('writing 0')) AS t(topic)")
    return guidance.caution_index(guidance.caution_lines(manual_lines(spark, d, "caution")), topics)


def sequence_write_pairs(spark, d):
    return guidance.write_pairs(manual_lines(spark, d))


def sequence_steps(spark, d):
    return guidance.steps(manual_lines(spark, d, "step"))


def sequence_structure(spark, d):
    return guidance.structure(guidance.steps(manual_lines(spark, d, "step")))


def _clusters(spark, d):
    found = guidance.caution_lines(manual_lines(spark, d, "caution"))
    hits = found.groupBy("filename", F.col("type").alias("topic"), "page").agg(F.count("*").alias("score"))
    return guidance.page_clusters(hits, 1)


def sequence_clusters(spark, d):
    return _clusters(spark, d)


def sequence_best_cluster(spark, d):
    return guidance.best_cluster(_clusters(spark, d))


def sequence_topics(spark, d):
    rows = manual_lines(spark, d, "heading").select(*KEYS, "pos", F.array_join(guidance.rules.labels(T.normalize_for_search(F.col("line")), guidance.rules.SEQUENCE_KINDS), ",").alias("kinds"))
    return rows


# --- tables -------------------------------------------------------------------------------------


def table_cells(spark, d):
    return tables.cells(manual_words(spark, d)).select(*KEYS, "row", "cell", "x0", "text")


def _blocks(spark, d):
    return tables.blocks(tables.cells(manual_words(spark, d)))


def table_blocks(spark, d):
    return _blocks(spark, d)


def table_stitch(spark, d):
    return tables.stitch(_blocks(spark, d))


def table_kinds(spark, d):
    rows = manual_lines(spark, d)
    return rows.groupBy("filename", tables.kind(F.col("line")).alias("table_kind"), tables.is_table_like(F.col("line")).alias("table_like")).agg(F.count("*").alias("lines"))


def table_continuation(spark, d):
    rows = manual_lines(spark, d, "register", "write").select(*KEYS, "pos", F.regexp_extract("line", T.rx(registers.rules.REGISTER_SYMBOL), 0).alias("head"), F.length("line").cast("string").alias("text"))
    return tables.continued(rows)


def table_carried_register(spark, d):
    rows = manual_lines(spark, d, "step", "write").select(*KEYS, "pos", F.regexp_extract("line", T.rx(registers.rules.REGISTER_SYMBOL), 0).alias("register"))
    return tables.carried_register(rows).groupBy("filename", "current").agg(F.count("*").alias("lines"))


# --- figures ------------------------------------------------------------------------------------


def figure_manifest(spark, d):
    return figures.manifest(figures.captions(manual_lines(spark, d)))


def figure_visual_tables(spark, d):
    return figures.visual_tables(figures.captions(manual_lines(spark, d, "caption"))).select(*KEYS, "caption_id", "visual_kind", "hits", "visual_confidence")


def figure_kinds(spark, d):
    return figures.kind_counts(figures.manifest(figures.captions(manual_lines(spark, d, "caption"))))


# --- evidence, quality, control -----------------------------------------------------------------


def _log(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.col("user_id").alias("entry"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"), F.col("event_type").alias("status"), "event_id")


def evidence_latest(spark, d):
    return quality.latest(_log(spark, d), ["entry"], "updated", ["status", "event_id"])


def evidence_queue(spark, d):
    last = quality.latest(_log(spark, d), ["entry"], "updated", ["updated", "status", "event_id"])
    return quality.queue(last, "status", "updated", {"error": 0, "click": 1, "view": 2}, 30, ["entry"]).select("entry", "status", "updated")


def evidence_report(spark, d):
    return quality.latest(_log(spark, d), ["entry"], "updated", ["status", "event_id"]).groupBy("status").agg(F.count("*").alias("entries"), F.sum("states").alias("states"))


def artifact_descendants(spark, d):
    return quality.descendants(spark, ["tables"])


def artifact_health(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("ok", "stale", "missing", "broken"))), (F.col("o_orderkey") % 97 % 4 + 1).cast("int"))
    rows = _table(spark, d, "orders").select(F.concat(F.lit("manual"), F.col("o_custkey")).alias("filename"), F.col("o_orderkey").alias("artifact"), status.alias("status"), (F.col("o_orderstatus") != "P").alias("required"))
    return quality.health(rows)


def golden_facts(spark, d):
    part = _table(spark, d, "part")
    facts = part.select((F.concat(F.lit("manual"), F.col("p_partkey") % 5)).alias("filename"), F.concat(F.lit("PRTm_R"), F.col("p_partkey"), F.lit("_n")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "8").otherwise("16").alias("access_size"))
    return quality.golden(facts, registers.list_rows(manual_lines(spark, d, "register")), ["filename", "name"], ["access_size"])


def requirement_match(spark, d):
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("req_id"), "text")
    return quality.requirements(items, _table(spark, d, "documents").select(F.col("doc_id").alias("ev_id"), "text"))


def eval_assertions(spark, d):
    return quality.assertions(_table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "text"), ["the"], ["license"], 100)


def cache_evict(spark, d):
    files = _table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"), F.length("o_orderpriority").alias("bytes"), F.col("o_orderkey").alias("file"))
    return quality.evict(files, 40, ["file"])


def resume_pages(spark, d):
    wanted = manual_lines(spark, d, "heading").select(*KEYS).distinct()
    return artifacts.missing_pages(wanted, manual_lines(spark, d, "caution"))


# --- answers from several tables ----------------------------------------------------------------


def read_pages(spark, d):
    return review.page_range(prose_pages(spark, d), 10, 500).select(*KEYS, F.length("text").alias("n_chars"))


def register_list(spark, d):
    return review.list_registers(_registers(spark, d), "brushed", 50).select("filename", "name", "confidence", "first_page")


def register_groups(spark, d):
    return review.register_groups(_registers(spark, d))


def module_type(spark, d):
    return review.module_type(pages.sections(manual_lines(spark, d, "heading")))


def register_summary(spark, d):
    lists = registers.list_rows(manual_lines(spark, d, "register")).groupBy("filename", "name").agg(F.min("access_size").alias("access_size"))
    fields = bitfields.validate(_fields(spark, d), lists)
    out = review.summarize(_registers(spark, d), fields, guidance.caution_lines(manual_lines(spark, d, "caution")), guidance.steps(manual_lines(spark, d, "step")))
    return out.select("filename", "register", "confidence", "bitfields", "valid_bitfields", "cautions", "steps", "reliability")


def register_usage(spark, d):
    asked = manual_lines(spark, d, "step").select("filename", F.regexp_extract("line", T.rx(registers.rules.REGISTER_SYMBOL), 0).alias("register"), F.regexp_replace("line", r"^\d+\. | of PRTm_R.*$", "").alias("operation")).distinct()
    return review.verify_usage(asked, _registers(spark, d).where("explicit = 1"), guidance.caution_lines(manual_lines(spark, d, "caution")), guidance.steps(manual_lines(spark, d, "step")))


def register_alias(spark, d):
    asked = _table(spark, d, "part").select(F.concat(F.lit("manual"), F.col("p_partkey") % 5).alias("filename"), F.concat(F.lit("R"), "p_partkey", F.lit("_n")).alias("symbol"))
    return review.alias_lookup(asked, _registers(spark, d).where("explicit = 1"))


def diagram_edges(spark, d):
    return review.arrows(manual_lines(spark, d))


def diagram_nodes(spark, d):
    return review.diagram_nodes(review.arrows(manual_lines(spark, d, "arrow")))


def diagram_signals(spark, d):
    return review.signal_edges(manual_lines(spark, d))


def pin_functions(spark, d):
    return review.pin_functions(manual_lines(spark, d, "pin"))


def figure_context(spark, d):
    lines = manual_lines(spark, d)
    return review.caption_context(figures.captions(lines), lines).select(*KEYS, "caption_id", "lines", F.md5(F.col("text").cast("binary")).alias("digest"))


def table_coverage(spark, d):
    return review.coverage(figures.captions(manual_lines(spark, d, "caption")), _blocks(spark, d))


def evidence_gate(spark, d):
    return review.gate(quality.latest(_log(spark, d), ["entry"], "updated", ["status", "event_id"]), "verified_only")


def golden_bootstrap(spark, d):
    facts = _table(spark, d, "part").where(F.col("p_size") > 25).select(F.concat(F.lit("manual"), F.col("p_partkey") % 5).alias("filename"), F.concat(F.lit("PRTm_R"), "p_partkey", F.lit("_n")).alias("name"))
    return review.bootstrap_golden(_registers(spark, d), facts, ["filename", "name"], 20).select("filename", "name", "band", "rank")


def artifact_reconcile(spark, d):
    lines = manual_lines(spark, d, "register", "caution")
    declared = lines.groupBy("filename", F.col("kind").alias("artifact")).agg(F.count("*").alias("declared"))
    found = registers.list_rows(lines).select("filename", F.lit("register").alias("artifact")).unionByName(guidance.caution_lines(lines).select("filename", F.lit("caution").alias("artifact")))
    actual = found.groupBy("filename", "artifact").agg(F.count("*").alias("actual"))
    return review.reconcile(declared.join(actual, ["filename", "artifact"], "left").fillna(0, ["actual"]), 10)


HEADERS = "SELECT filename, cell, row, text FROM VALUES ('a', 0, 0, 'Bit'), ('a', 0, 1, '31:28'), ('a', 1, 0, 'Bit Name'), ('a', 2, 0, 'R/W'), ('a', 2, 1, 'RW'), ('a', 3, 0, 'Description'), ('b', 0, 0, 'Register Name'), ('b', 1, 0, 'Offset Address'), ('b', 1, 1, '0040h'), ('b', 2, 0, 'xyz') AS t(filename, cell, row, text)"


def table_roles(spark, d):
    return tables.column_roles(spark.sql(HEADERS), ["filename", "cell"])


def table_found_roles(spark, d):
    return tables.column_roles(tables.cells(manual_words(spark, d)).select("filename", "cell", F.concat_ws(":", "page", "row").alias("row"), "text"), ["filename", "cell"])


QUERIES = {f.__name__: f for f in (text_normalize, text_symbols, text_tokens, text_counts, text_fuzzy, chunk_text, chunk_profile, chunk_type_stats, section_index, section_search, section_nearest, search_lexical, search_bm25, search_proximity, search_hybrid, search_fuzzy, search_evidence, search_fusion, register_rows, register_index, register_find, register_near_pages, register_mapping, bitfield_conflicts, bitfield_rows, bitfield_index, bitfield_validation, bitfield_overlaps, caution_lines, caution_index, sequence_write_pairs, sequence_steps, sequence_structure, sequence_clusters, sequence_best_cluster, sequence_topics, table_cells, table_blocks, table_stitch, table_kinds, table_continuation, table_carried_register, figure_manifest, figure_visual_tables, figure_kinds, evidence_latest, evidence_queue, evidence_report, artifact_descendants, artifact_health, golden_facts, requirement_match, eval_assertions, cache_evict, resume_pages, read_pages, register_list, register_groups, module_type, register_summary, register_usage, register_alias, diagram_edges, diagram_nodes, diagram_signals, pin_functions, figure_context, table_coverage, evidence_gate, golden_bootstrap, artifact_reconcile, table_roles, table_found_roles)}
QUERIES |= figure_queries.QUERIES
QUERIES |= passage_queries.QUERIES
