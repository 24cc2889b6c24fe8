"""Answers put together from several tables: summaries, usage checks, diagrams, gates, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import canonical_symbol, normalize_for_search, rx


def page_range(pages: DataFrame, first: int, last: int, most: int = 20) -> DataFrame:
    """Pages first to last, at most `most` of them; the filter reaches the scan."""
    return pages.where(F.col("page").between(first, min(last, first + most - 1)))


def list_registers(registers: DataFrame, text: str = "", k: int = 80, unsure: bool = False) -> DataFrame:
    """Explicit registers or those of 70 or more, that hold the text in name or description."""
    rows = registers if unsure else registers.where((F.col("explicit") == 1) | (F.col("confidence") >= 70))
    if text:
        rows = rows.where(F.contains(normalize_for_search(F.concat_ws(" ", "name", "description")), normalize_for_search(F.lit(text))))
    return rows.orderBy(F.desc("confidence"), "first_page", "filename", "name").limit(k)


def register_groups(registers: DataFrame) -> DataFrame:
    """Per file and group of registers: how many, and the first by page."""
    group = rules.first_label(F.upper(F.concat_ws(" ", "name", "description")), rules.REGISTER_GROUPS, "Other registers")
    return registers.withColumn("group", group).groupBy("filename", "group").agg(F.count("*").alias("registers"), F.min_by("name", F.struct("first_page", "name")).alias("first_register"))


#: Fixed value: titles of a file that its module is told by.
MODULE_TITLES = 40


def module_type(sections: DataFrame, most: int = MODULE_TITLES) -> DataFrame:
    """The kind of module a file is about, by the titles of its first `most` sections: the first rule that fits any."""
    first = sections.withColumn("n", F.row_number().over(W.partitionBy("filename").orderBy("page", "pos"))).where(F.col("n") <= most)
    text = first.groupBy("filename").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("n", "title"))), lambda x: x["title"])).alias("text"))
    return text.select("filename", rules.first_label(normalize_for_search(F.col("text")), rules.MODULE_TYPES, "unknown").alias("module_type"))


def summarize(registers: DataFrame, fields: DataFrame, cautions: DataFrame, steps: DataFrame) -> DataFrame:
    """Per register what is known: bit fields, valid ones, cautions, steps, and how sure it is."""
    key = ["filename", "register"]
    of_fields = fields.groupBy(*key).agg(F.count("*").alias("bitfields"), F.count_if(F.col("status") == "valid").alias("valid_bitfields"))
    of_cautions = cautions.where("register <> ''").groupBy(*key).agg(F.count("*").alias("cautions"))
    of_steps = steps.where("register <> ''").groupBy(*key).agg(F.count("*").alias("steps"))
    rows = registers.select("filename", F.col("name").alias("register"), "confidence", "explicit")
    for part in (of_fields, of_cautions, of_steps):
        rows = rows.join(part, key, "left")
    rows = rows.fillna(0, ["bitfields", "valid_bitfields", "cautions", "steps"])
    sure = F.when((F.col("explicit") == 1) & (F.col("bitfields") > 0), "high").when(F.col("explicit") == 1, "medium").otherwise("low")
    return rows.withColumn("reliability", sure)


def verify_usage(asked: DataFrame, registers: DataFrame, cautions: DataFrame, steps: DataFrame) -> DataFrame:
    """Each use (filename, register, operation) against what the manual says.

    Needed are the register itself, a caution on reserved bits for plain writes, proof of how flags
    are cleared, and a sequence where the order matters; what is missing is listed.
    """
    text = normalize_for_search(F.col("operation"))
    rows = asked.withColumn("access", rules.first_label(text, rules.ACCESS_TYPES, "write")).withColumn("intent", rules.first_label(text, rules.USAGE_INTENTS, "configure"))
    key = ["filename", "register"]
    known = registers.select("filename", F.col("name").alias("register"), F.lit(1).alias("known")).distinct()
    says = cautions.groupBy(*key).agg(F.max(F.col("type").isin("reserved-bit", "prohibited").cast("int")).alias("reserved"), F.max(F.col("type").startswith("clear-semantics").cast("int")).alias("clears"), F.max((F.col("type") == "write-timing").cast("int")).alias("timing"))
    ordered = steps.where("register <> ''").select(*key, F.lit(1).alias("ordered")).distinct()
    met = rows.join(known, key, "left").join(says, key, "left").join(ordered, key, "left").fillna(0, ["known", "reserved", "clears", "timing", "ordered"])
    missing = F.array_compact(
        F.array(
            F.when(F.col("known") == 0, F.lit("register")),
            F.when(F.col("access").isin("raw_write", "write", "set_bits", "clear_bits") & (F.col("reserved") == 0), F.lit("reserved bits")),
            F.when(((F.col("intent") == "clear") | F.col("access").isin("write_one_to_clear", "write_zero_to_clear")) & (F.col("clears") == 0), F.lit("clear semantics")),
            F.when(F.col("intent").isin("start", "stop", "reset", "init", "irq", "error") & (F.col("ordered") == 0), F.lit("order")),
        )
    )
    severity = F.when(F.size("gaps") > 0, "needs_verification").when(F.col("timing") == 1, "review_required").otherwise("likely_ok")
    return met.withColumn("gaps", missing).withColumn("severity", severity).select(*key, "operation", "access", "intent", "severity", F.array_join("gaps", ", ").alias("missing"))


def arrows(lines: DataFrame) -> DataFrame:
    """Edges of diagrams drawn in text: source, target, label, and the kinds of all three."""
    part = lambda i: F.trim(F.regexp_extract("line", rules.ARROW, i))
    rows = lines.where(F.col("line").rlike(rules.ARROW)).select("filename", "page", "pos", part(1).alias("source"), part(2).alias("target"), part(3).alias("label"))
    kind = lambda c: rules.first_label(normalize_for_search(F.col(c)), rules.BLOCK_KINDS, "unknown")
    return rows.withColumn("source_kind", kind("source")).withColumn("target_kind", kind("target")).withColumn("edge_kind", rules.first_label(normalize_for_search(F.col("label")), rules.EDGE_KINDS, "unknown"))


def diagram_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of each page's diagram with how many edges leave and reach them."""
    both = edges.select("filename", "page", F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select("filename", "page", F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return both.groupBy("filename", "page", "node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))


def signal_edges(lines: DataFrame) -> DataFrame:
    """Events of timing diagrams in order: signal, edge, and the event before on the page."""
    found = F.regexp_extract_all("line", F.lit(rx(rules.SIGNAL_EDGE)), F.lit(0))
    rows = lines.select("filename", "page", "pos", F.posexplode(found).alias("n", "event"))
    rows = rows.select("filename", "page", "pos", "n", F.regexp_extract("event", r"^(\S+)", 1).alias("signal"), F.when(F.col("event").rlike("(?i)rises|high|asserted"), "rising").otherwise("falling").alias("edge"))
    return rows.withColumn("after", F.lag("signal").over(W.partitionBy("filename", "page").orderBy("pos", "n")))


def pin_functions(lines: DataFrame) -> DataFrame:
    """One row per pin and function of multiplexing lists."""
    pin = F.replace(F.regexp_extract("line", rx(rules.PIN), 1), F.lit("-"), F.lit("_"))
    rows = lines.where(F.col("line").rlike(rx(rules.PIN))).select("filename", "page", pin.alias("pin"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(rx(rules.PIN_FUNCTION)), F.lit(1)))).alias("function"))
    return rows.where(~F.col("function").rlike(r"^P\d")).distinct()


def caption_context(captions: DataFrame, lines: DataFrame, before: int = 4, after: int = 5) -> DataFrame:
    """The lines around each caption as one text; each line is dealt to the captions near it."""
    near = captions.select("filename", "page", F.col("pos").alias("at"), "caption_id", F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("pos"))
    met = near.join(lines.select("filename", "page", "pos", "line"), ["filename", "page", "pos"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return met.groupBy("filename", "page", "at", "caption_id").agg(F.count("*").alias("lines"), text.alias("text"))


def coverage(captions: DataFrame, tables: DataFrame) -> DataFrame:
    """Outer join of captioned and found tables by page: covered, only captioned or only found."""
    said = captions.where(F.col("type") == "Table").groupBy("filename", "page").agg(F.count("*").alias("captions"))
    there = tables.groupBy("filename", "page").agg(F.count("*").alias("tables"))
    both = said.join(there, ["filename", "page"], "full")
    status = F.when(F.col("tables").isNull(), "caption_only").when(F.col("captions").isNull(), "table_only").otherwise("covered")
    return both.select("filename", "page", F.coalesce("captions", F.lit(0)).alias("captions"), F.coalesce("tables", F.lit(0)).alias("tables"), status.alias("status"))


def gate(entries: DataFrame, policy: str) -> DataFrame:
    """Review gate over evidence (entry, status): advisory lets all pass, verified_only and block_unverified do not."""
    verified = F.col("status") == "purchase" if policy == "" else F.col("status").isin("verified", "purchase")
    blocked = F.lit(False) if policy == "advisory" else ~verified
    return entries.groupBy("status").agg(F.count("*").alias("entries"), F.count_if(blocked).alias("blockers"))


def bootstrap_golden(entries: DataFrame, facts: DataFrame, keys: list[str], per_band: int) -> DataFrame:
    """Per quality band the surest entries that are no facts yet."""
    new = entries.join(facts.select(*keys).distinct(), keys, "left_anti")
    band = F.when((F.col("explicit") == 1) & (F.col("confidence") >= 90), "high_quality").when(F.col("confidence") >= 40, "needs_manual_review").otherwise("rejected_noise")
    rank = F.row_number().over(W.partitionBy("band").orderBy(F.desc("confidence"), *keys))
    return new.withColumn("band", band).withColumn("rank", rank).where(F.col("rank") <= per_band)


def reconcile(counts: DataFrame, least: int) -> DataFrame:
    """Declared against actual counts (filename, artifact, declared, actual): ok, empty, few or differs."""
    status = F.when(F.col("declared") != F.col("actual"), "differs").when(F.col("actual") == 0, "empty").when(F.col("actual") < least, "few").otherwise("ok")
    return counts.withColumn("status", status)


def alias_lookup(names: DataFrame, registers: DataFrame) -> DataFrame:
    """Alias join: names (filename, symbol) to the registers one of whose aliases they are, the first by name."""
    from folioscope.operators.registers import aliases

    spread = registers.select("filename", "name", F.explode(F.transform(aliases(F.col("name")), canonical_symbol)).alias("alias")).distinct()
    asked = names.withColumn("alias", canonical_symbol(F.col("symbol")))
    return asked.join(spread, ["filename", "alias"]).groupBy("filename", "symbol").agg(F.min("name").alias("register"), F.countDistinct("name").alias("candidates"))
