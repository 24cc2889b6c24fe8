"""A library of manuals and the questions that can be put to it, by name.

A Library is built from page rows (filename, page, text); what is derived from them is planned
once and read when asked. `call(name, **arguments)` checks the arguments and returns a DataFrame.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import share
from folioscope.functions import tokens
from folioscope.functions.bits import parse_range
from folioscope.functions.text import normalize_for_search
from folioscope.operators import bitfields, diagrams, figures, guidance, pages, passages, quality, registers, review, search, tables


class Library:
    """Questions over all manuals at once, or over one by `filename`."""

    def __init__(self, page_rows: DataFrame, words: DataFrame | None = None):
        share(page_rows.sparkSession)
        self.pages, self.words = page_rows.select("filename", "page", "text"), words

    @property
    def spark(self) -> SparkSession:
        return self.pages.sparkSession

    # --- derived tables ---

    @cached_property
    def lines(self) -> DataFrame:
        return pages.lines_of(self.pages)

    @cached_property
    def chunks(self) -> DataFrame:
        rows = pages.chunks(self.pages)
        return passages.detected(rows).withColumn("c", passages.kind()).select("filename", "page", "chunk_index", "text", "c.chunk_type", "c.noise", "c.content")

    @cached_property
    def sections(self) -> DataFrame:
        return pages.sections(self.lines)

    @cached_property
    def registers(self) -> DataFrame:
        return registers.index(registers.list_rows(self.lines), registers.symbol_rows(self.lines))

    @cached_property
    def bitfields(self) -> DataFrame:
        widths = registers.list_rows(self.lines).groupBy("filename", "name").agg(F.min("access_size").alias("access_size"))
        return bitfields.retained(bitfields.validate(bitfields.merge(bitfields.parse(self.lines)), widths))

    @cached_property
    def cautions(self) -> DataFrame:
        return guidance.caution_lines(self.lines)

    @cached_property
    def steps(self) -> DataFrame:
        return guidance.steps(self.lines)

    @cached_property
    def figures(self) -> DataFrame:
        return figures.manifest(figures.captions(self.lines))

    # --- questions ---

    def list_pdfs(self) -> DataFrame:
        return self.pages.groupBy("filename").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))

    def search_pdf(self, query: str, top_k: int = 8) -> DataFrame:
        return search.search(self.chunks, query, min(top_k, 30), ["filename", "page", "chunk_index"])

    def hybrid_search_pdf(self, query: str, intent: str = "auto", register: str = "", top_k: int = 12) -> DataFrame:
        """The best passages; those near the register asked for, or near sections of that title, gain."""
        asked = passages.HybridQuery(query, intent, register)
        found = registers.find(self.registers, register, 6).select("name", "first_page").collect() if register else []
        near = [r.page for r in self.find_section(query, 5).select("page").collect()]
        return passages.hybrid_rank(pages.chunks(self.pages), asked, ["filename", "page", "chunk_index"], min(top_k, 40), sorted({*near, *(r.first_page for r in found)}), [r.name for r in found], compatibility=True)

    def figure_types(self) -> DataFrame:
        return diagrams.figure_types(self.lines.withColumn("kind", F.lit(None).cast("string")), ["filename", "page"])

    def parse_diagram(self, kind: str, page: int | None = None) -> DataFrame:
        """What the lines of a page, or all pages, say of a state_machine, sequence_diagram, block_diagram (edges) or blocks."""
        parsers = {"state_machine": diagrams.transitions, "sequence_diagram": diagrams.numbered_steps, "block_diagram": diagrams.block_edges, "blocks": diagrams.blocks}
        return parsers[kind](self.lines if page is None else self.lines.where(F.col("page") == page))

    def find_sequence(self, topic: str, top_k: int = 8) -> DataFrame:
        """Headings that may stand for a sequence, with the topic's words, best first, and how complete the page's steps are."""
        found = self.sections.where(tokens.is_trusted_topic(F.col("title")))
        terms = search.Query(topic).terms
        scored = found.withColumn("score", pages.score_section(F.col("title"), F.col("type"), topic, terms)).where("score > 0")
        status = guidance.structure(self.steps).select("filename", "page", "status")
        met = scored.join(status, ["filename", "page"], "left").withColumn("status", F.coalesce("status", F.lit("unstructured")))
        ids = met.withColumn("sequence_id", tokens.sequence_id(F.col("filename"), F.col("title"))).withColumn("confidence", tokens.sequence_confidence(F.col("score"), F.col("status")))
        return ids.select("sequence_id", "filename", "page", "title", "score", "status", "confidence").orderBy(F.desc("score"), "page", "filename", "title").limit(min(top_k, 30))

    def find_caution(self, topic: str, top_k: int = 8) -> DataFrame:
        """Caution lines on a topic, best first, with what each puts at risk."""
        score = guidance.caution_score(F.col("line"), F.lit(topic), F.col("labels"))
        found = self.cautions.withColumn("score", score).where("score >= 80")
        ids = found.withColumn("caution_id", tokens.caution_id(F.col("filename"), F.lit(topic), F.col("type"))).withColumn("risk", tokens.risk_of(F.col("type")))
        return ids.select("caution_id", "filename", "page", "type", "labels", "register", "line", "risk", "score").orderBy(F.desc("score"), "page", "pos").limit(min(top_k, 30))

    def extract_bitfield_table(self, register: str, top_k: int = 64) -> DataFrame:
        """A register's bit fields, from the highest bit, with what its lines say differently."""
        said = bitfields.conflicts(bitfields.parse(self.lines)).groupBy("filename", "register", "bitfield").agg(F.concat_ws("; ", F.sort_array(F.collect_list(F.concat_ws("=", "field", "values")))).alias("differing"))
        rows = self.bitfields.where(F.col("register") == register).join(said, ["filename", "register", "bitfield"], "left")
        return rows.orderBy(F.desc(parse_range(F.col("position"))["high"]), "bitfield").limit(min(top_k, 200))

    def read_pdf_pages(self, start_page: int, end_page: int) -> DataFrame:
        return review.page_range(self.pages, start_page, end_page)

    def read_pdf_chunk(self, page: int, chunk_index: int) -> DataFrame:
        return self.chunks.where((F.col("page") == page) & (F.col("chunk_index") == chunk_index))

    def chunk_type_stats(self) -> DataFrame:
        return pages.chunk_type_stats(self.chunks)

    def find_section(self, section: str, top_k: int = 8) -> DataFrame:
        scored = self.sections.withColumn("score", pages.score_section(F.col("title"), F.col("type"), section, search.Query(section).terms))
        return scored.where("score > 0").orderBy(F.desc("score"), "page", "level", "filename", "title").limit(min(top_k, 30))

    def list_registers(self, filter: str = "", top_k: int = 80, include_low_confidence: bool = False) -> DataFrame:
        return review.list_registers(self.registers, filter, min(top_k, 200), include_low_confidence)

    def find_register(self, register: str, top_k: int = 8) -> DataFrame:
        return registers.find(self.registers, register, min(top_k, 30))

    def summarize_register(self, register: str) -> DataFrame:
        return review.summarize(self.registers, self.bitfields, self.cautions, self.steps).where(F.col("register") == register)

    def extract_register_table(self, start_page: int = 0, end_page: int = 1 << 30) -> DataFrame:
        return registers.list_rows(self.lines.where(F.col("page").between(start_page, end_page)))

    def list_bitfields(self, register: str = "", top_k: int = 80) -> DataFrame:
        rows = self.bitfields.where(F.col("register") == register) if register else self.bitfields
        return rows.orderBy("filename", "register", "bitfield").limit(min(top_k, 240))

    def find_bitfield(self, bitfield: str, register: str = "") -> DataFrame:
        return self.list_bitfields(register, 240).where(F.upper("bitfield") == bitfield.upper())

    def list_sequences(self) -> DataFrame:
        return guidance.structure(self.steps)

    def get_sequence(self, topic: str) -> DataFrame:
        near = self.lines.where(F.contains(normalize_for_search(F.col("line")), normalize_for_search(F.lit(topic)))).select("filename", "page").distinct()
        return self.steps.join(near, ["filename", "page"], "left_semi")

    def list_cautions(self, filter: str = "", register: str = "", type: str = "", top_k: int = 80) -> DataFrame:
        rows = self.cautions
        if filter:
            rows = rows.where(F.contains(normalize_for_search(F.col("line")), normalize_for_search(F.lit(filter))))
        if register:
            rows = rows.where(F.col("register") == register)
        if type:
            rows = rows.where(F.contains(F.col("type"), F.lit(type)))
        return rows.orderBy("filename", "page", "pos").limit(min(top_k, 200))

    def get_cautions_for_register(self, register: str) -> DataFrame:
        return self.list_cautions(register=register, top_k=200)

    def extract_tables_from_pages(self, start_page: int, end_page: int) -> DataFrame:
        if self.words is None:
            raise ValueError("this library has no word boxes")
        return tables.stitch(tables.blocks(tables.cells(self.words.where(F.col("page").between(start_page, end_page)))))

    def extract_pinmux_table(self) -> DataFrame:
        return review.pin_functions(self.lines)

    def table_coverage_report(self) -> DataFrame:
        if self.words is None:
            raise ValueError("this library has no word boxes")
        return review.coverage(figures.captions(self.lines), tables.blocks(tables.cells(self.words)))

    def list_figures(self, kind: str = "", limit: int = 40) -> DataFrame:
        rows = self.figures.where(F.col("kind") == kind) if kind else self.figures
        return rows.orderBy("filename", "page", "pos").limit(min(limit, 200))

    def search_figures(self, query: str, limit: int = 40) -> DataFrame:
        return search.search(self.figures.withColumn("text", F.col("title")), query, min(limit, 200), ["filename", "page", "pos"])

    def get_figure_context_pack(self, figure_id: str) -> DataFrame:
        return review.caption_context(self.figures.where(F.col("figure_id") == figure_id), self.lines)

    def list_figure_semantics(self) -> DataFrame:
        return review.arrows(self.lines)

    def get_module_profile(self) -> DataFrame:
        return review.module_type(self.sections).join(review.register_groups(self.registers), "filename", "left")

    def verify_register_usage(self, register: str, operation: str) -> DataFrame:
        asked = self.list_pdfs().select("filename", F.lit(register).alias("register"), F.lit(operation).alias("operation"))
        return review.verify_usage(asked, self.registers.where("explicit = 1"), self.cautions, self.steps)

    def compare_driver_requirements(self, requirements: list[str], evidence: list[str]) -> DataFrame:
        rows = lambda xs, key: self.spark.createDataFrame(list(enumerate(xs)), f"{key} long, text string")
        return quality.requirements(rows(requirements, "req_id"), rows(evidence, "ev_id"))


def tools() -> dict[str, Callable]:
    """The questions by name."""
    derived = {"spark"} | {n for n, v in vars(Library).items() if isinstance(v, cached_property)}
    return {n: v for n, v in vars(Library).items() if callable(v) and not n.startswith("_") and n not in derived}


def call(library: Library, name: str, filename: str | None = None, **arguments) -> DataFrame:
    """Asks a question by name; with filename of one manual alone. Unknown names or arguments are errors."""
    known = tools()
    if name not in known:
        raise ValueError(f"no such tool: {name}")
    wanted = inspect.signature(known[name]).parameters
    if extra := set(arguments) - set(wanted):
        raise ValueError(f"{name} does not take {', '.join(sorted(extra))}")
    if lacking := [p for p, v in wanted.items() if p != "self" and v.default is v.empty and p not in arguments]:
        raise ValueError(f"{name} needs {', '.join(lacking)}")
    if filename is not None:
        one = lambda df: None if df is None else df.where(F.col("filename") == filename)
        library = Library(one(library.pages), one(library.words))
    return known[name](library, **arguments)
