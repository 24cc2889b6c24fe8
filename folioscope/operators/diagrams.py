"""Figures read from their text: what kind they are, and the states, steps, blocks and edges that lines name.

Input rows are lines or blocks of text (filename, page, pos, line) of figures; geometry plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules, tokens
from folioscope.functions.text import compact, has, normalize_for_search, rx

KEYS = ["filename", "page", "pos"]

# --- fixed values: evidence for a kind of figure ------------------------------------------------
#: (type, points, all of these are found) or, with several alternatives, the first that is.
FIGURE_EVIDENCE: list[tuple[str, list[tuple[int, tuple[str, ...]]]]] = [
    ("timing_diagram", [(4, (r"\b(?:timing|waveform|wave form|clock|counter|edge|rising edge|falling edge|both edges|saw wave|up counting|down counting|input capture|gtio|gtcnt|gtccr)\b",))]),
    ("sequence_diagram", [(4, (r"\b(?:sequence|flow|operation sequence|setting flow|procedure|step name|initialization flow|reset flow|dma flow|interrupt flow)\b",))]),
    (
        "state_machine",
        [
            (5, (r"\b(?:state machine|state diagram|state transition|mode transition|fsm|transition state)\b",)),
            (3, (r"\bstate\b", r"\b(?:transition|reset|enable|disable|start|stop|suspend|resume|timeout|error)\b")),
        ],
    ),
    (
        "block_diagram",
        [
            (5, (r"\b(?:block diagram|functional block|module configuration|system diagram|configuration diagram|overview diagram)\b",)),
            (2, (r"\b(?:axi|ahb|apb|bus|dma|irq|interrupt|clock|reset|fifo|memory|cpu|module|peripheral|mux)\b",)),
        ],
    ),
    ("register_diagram", [(4, (r"\b(?:register diagram|register layout|bit field|bitfield|bit\s+name|offset address|access size|initial value|reset value)\b",))]),
    ("table", [(2, (r"^table\b|\b(?:table|columns|rows|no step name description)\b",))]),
]
#: Points of a kind that an index gave before, by what its name holds.
KIND_EVIDENCE = [("timing_diagram", "timing"), ("sequence_diagram", "flow|sequence"), ("block_diagram", "block"), ("register_diagram", "register"), ("table", "table")]
KIND_POINTS, LEAST_POINTS, SURE_BASE, SURE_POINT, SURE_MARGIN, SURE_MOST, SURE_NONE = 3, 2, 0.35, 0.055, 0.04, 0.92, 0.2

# --- fixed values: states, steps and edges ------------------------------------------------------
STATE_WORD = r"(?i)\b(?:reset|idle|run|running|stop|stopped|wait|standby|sleep|suspend|resume|error|fault|enable|disable|disabled|active|inactive|ready|busy|halt|normal|transition|state|mode)\b"
TRIGGER = r"(?i)\b(?:reset|enable|disable|error|interrupt|irq|timeout|start|stop|suspend|resume|clear|set|request|complete|done|fail|fault)\b"
ARROWS = r"\s*(?:->|=>|-->)\s*"
TRANSITIONS = [
    r"(?i)\bfrom\s+(.{2,80}?)\s+to\s+(.{2,80}?)(?:\s+(?:when|if|after|on)\s+(.{2,160}))?$",
    r"(?i)\b(.{2,80}?)\s+transitions?\s+to\s+(.{2,80}?)(?:\s+(?:when|if|after|on)\s+(.{2,160}))?$",
]
STATE_WORDS, STATE_CHARS = 6, 80
NUMBERED = [r"(?i)^\s*(?:step\s*)?(\d{1,3})[).:\-]\s+(.{3,500})$", r"^\s*(\d{1,3})\s+([A-Z][A-Za-z0-9 /_\-]{2,80}\s+.{8,500})$"]
ACTOR = r"(?i)\b(?:CPU|DMAC?|DMA Controller|Interrupt Controller|Peripheral|Software|Hardware|Module|Counter|Timer)\b"
TARGET = r"(?i)\b(?:counter|clock|interrupt|IRQ|DMA|buffer|FIFO|memory|pin|signal)\b"
CONDITION = r"(?i)\b(?:if|when|after|before|until|while|only when|in Figure [^,.]+)\b.{0,160}"
ACTION = r"(?i)\b(?:set|write|read|poll|wait|select|enable|disable|clear|start|stop|configure|load|reset)\b.{0,180}"
#: (label, pattern with the two ends); feeds and drives are their own labels.
CONNECTIONS = [
    ("connects_to", r"(?i)^(.+?)\s+(?:is\s+)?(?:connected\s+to|connects\s+to)\s+(.+)$"),
    ("feeds", r"(?i)^(.+?)\s+feeds\s+(.+)$"),
    ("drives", r"(?i)^(.+?)\s+drives\s+(.+)$"),
    ("input_to", r"(?i)^(.+?)\s+(?:is\s+)?input\s+to\s+(.+)$"),
    ("output_to", r"(?i)^output\s+from\s+(.+?)\s+to\s+(.+)$"),
]
NO_ENDPOINT = r"(?i)^(and|or|then|before|after|when|while|with|without|input|output|connected|connects|feeds|drives)$"
EDGE_KINDS = [
    ("bus", r"\b(?:axi|ahb|apb|bus)\b"),
    ("clock", r"\b(?:clk|clock)\b"),
    ("reset", r"\b(?:rst|reset)\b"),
    ("interrupt", r"\b(?:irq|int|interrupt)\b"),
    ("dma", r"\b(?:dma|dmac)\b"),
    ("data", r"\b(?:data|rx|tx)\b"),
    ("control", r"\b(?:ctrl|control|enable|start|stop)\b"),
    ("signal", r"\b(?:signal|req|ack)\b"),
]


def _all(text: Column, patterns) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & has(text, p)
    return out


def figure_types(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per figure (keys) its type, points and confidence, from rows (keys, pos, line, kind); kind may be null.

    Each text counts for every type it speaks for; ties go to the type first spoken for.
    """
    flat = normalize_for_search(F.col("line"))
    spoken = []
    for n, (kind, options) in enumerate(FIGURE_EVIDENCE):
        points = F.lit(None).cast("int")
        for worth, patterns in reversed(options):
            points = F.when(_all(flat, patterns), worth).otherwise(points)
        spoken.append(F.struct(F.lit(kind).alias("figure_type"), points.alias("points"), F.lit(n).alias("n")))
    by_text = blocks.select(*keys, "pos", F.explode(F.array(*spoken)).alias("e")).where("e.points is not null").select(*keys, "e.figure_type", "e.points", F.struct("pos", "e.n").alias("at"))
    named = blocks.groupBy(*keys).agg(F.max("kind").alias("kind"), F.max("pos").alias("pos"))
    before = [F.struct(F.lit(kind).alias("figure_type"), F.lit(n).alias("n"), F.col("kind").rlike(f"(?i){p}").alias("is")) for n, (kind, p) in enumerate(KIND_EVIDENCE)]
    by_kind = named.select(*keys, "pos", F.explode(F.array(*before)).alias("e")).where("e.is").select(*keys, "e.figure_type", F.lit(KIND_POINTS).alias("points"), F.struct((F.col("pos") + 1).alias("pos"), F.col("e.n").alias("n")).alias("at"))
    summed = by_text.unionByName(by_kind).groupBy(*keys, "figure_type").agg(F.sum("points").cast("int").alias("points"), F.min("at").alias("at"))
    ranked = W.partitionBy(*keys).orderBy(F.desc("points"), "at")
    best = summed.withColumn("n", F.row_number().over(ranked)).withColumn("next", F.lead("points", 1, 0).over(ranked)).where("n = 1")
    sure = F.least(F.lit(SURE_MOST), SURE_BASE + SURE_POINT * F.col("points") + SURE_MARGIN * (F.col("points") - F.col("next")))
    met = blocks.select(*keys).distinct().join(best, keys, "left")
    known = F.coalesce(F.col("points") >= LEAST_POINTS, F.lit(False))
    return met.select(*keys, F.when(known, F.col("figure_type")).otherwise("unknown").alias("figure_type"), F.coalesce("points", F.lit(0)).alias("points"), F.round(F.when(known, sure).otherwise(SURE_NONE), 3).alias("confidence"))


def _pieces(lines: DataFrame) -> DataFrame:
    return lines.select(*KEYS, F.posexplode(tokens.semantic_lines(F.col("line"))).alias("part", "text"))


def _arrow_ends(text: Column) -> Column:
    """Pairs of neighbours in a line of arrows."""
    parts = F.filter(F.transform(F.split(text, ARROWS), lambda x: compact(x, 120)), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.get(parts, i).alias("source"), F.get(parts, i + 1).alias("target"), F.lit("").alias("condition"))))


def states(lines: DataFrame) -> DataFrame:
    """Names of states: one for each spelling on a page."""
    name = F.trim(F.regexp_replace(F.regexp_replace(compact(F.col("text"), 120), r"(?i)^(?:state|mode)\s*[:=\-]\s*", ""), r"(?i)\s+(?:state|mode)$", ""))
    rows = _pieces(lines).withColumn("state", name).where(F.length("state").between(2, STATE_CHARS) & has(F.col("state"), STATE_WORD) & (F.size(F.split("state", r"\s+")) <= STATE_WORDS))
    first = F.row_number().over(W.partitionBy("filename", "page", normalize_for_search(F.col("state"))).orderBy("pos", "part"))
    return rows.withColumn("n", first).where("n = 1").select(*KEYS, "state")


def transitions(lines: DataFrame) -> DataFrame:
    """Transitions (source, target, condition) of arrows and sentences; lines that only name a trigger have no ends."""
    rows = _pieces(lines)
    text = F.col("text")
    said = F.lit(None).cast("struct<source:string,target:string,condition:string>")
    for pattern in reversed(TRANSITIONS):
        part = lambda i, p=pattern: F.regexp_extract(text, rx(p), i)
        found = F.struct(compact(part(1), 80).alias("source"), compact(part(2), 80).alias("target"), compact(part(3), 160).alias("condition"))
        said = F.when(has(text, pattern), found).otherwise(said)
    none = F.array().cast("array<struct<source:string,target:string,condition:string>>")
    both = F.concat(F.coalesce(_arrow_ends(text), none), F.when(said.isNotNull(), F.array(said)).otherwise(none))
    trigger = F.regexp_extract(text, rx(TRIGGER), 0)
    bare = F.struct(F.lit("").alias("source"), F.lit("").alias("target"), compact(text, 180).alias("condition"))
    lonely = (F.size(both) == 0) & has(text, STATE_WORD) & has(text, TRIGGER) & has(text, r"(?i)\b(?:when|if|after|on)\b")
    named = F.transform(both, lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), F.when(x["condition"] != "", x["condition"]).otherwise(trigger).alias("condition")))
    spread = rows.select(*KEYS, "part", F.posexplode(F.when(lonely, F.array(bare)).otherwise(named)).alias("i", "t"))
    flat = [normalize_for_search(F.col(f"t.{c}")) for c in ("source", "target", "condition")]
    first = F.row_number().over(W.partitionBy("filename", "page", *flat).orderBy("pos", "part", "i"))
    return spread.withColumn("n", first).where("n = 1").select(*KEYS, "t.source", "t.target", "t.condition")


def numbered_steps(lines: DataFrame) -> DataFrame:
    """Numbered steps of a page, in order: step, actor, action, target and condition; ordered_before is the next step's number."""
    text = F.col("text")
    one = lambda i: F.coalesce(*(F.when(has(text, p), F.regexp_extract(text, rx(p), i)) for p in NUMBERED))
    rows = _pieces(lines).withColumn("number", one(1).cast("int")).withColumn("said", compact(one(2), 320)).where("number is not null")
    first = F.row_number().over(W.partitionBy("filename", "page", "number", normalize_for_search(F.col("said"))).orderBy("pos", "part"))
    rows = rows.withColumn("n", first).where("n = 1")
    names = tokens.names_of(tokens.hardware_tokens(F.col("said")), "register")
    action = F.regexp_extract(compact(F.col("said"), 260), rx(ACTION), 0)
    out = rows.select(
        *KEYS,
        F.col("number").alias("step"),
        F.when(F.size(names) > 0, F.get(names, F.lit(0))).otherwise(F.regexp_extract("said", rx(ACTOR), 0)).alias("actor"),
        F.when(action != "", compact(action, 220)).otherwise(compact(F.col("said"), 260)).alias("action"),
        F.when(F.size(names) > 0, F.get(names, F.least(F.size(names) - 1, F.lit(1)))).otherwise(F.regexp_extract("said", rx(TARGET), 0)).alias("target"),
        compact(F.regexp_extract("said", rx(CONDITION), 0), 180).alias("condition"),
        "part",
    )
    return out.withColumn("ordered_before", F.lead("step").over(W.partitionBy("filename", "page").orderBy("step", "pos", "part"))).drop("part")


def endpoint(text: Column) -> Column:
    """A name at an end of an edge without brackets and marks; empty where it is none."""
    name = F.regexp_replace(compact(text, 80), r"""^[\s"'`(\[{]+|[\s"'`)\]}]+$""", "")
    name = F.trim(F.regexp_replace(name, r"[,:.]+$", ""))
    return F.when(F.length(name).between(2, 80) & ~name.rlike(NO_ENDPOINT), name).otherwise("")


def edge_kind(label: Column) -> Column:
    return rules.first_label(normalize_for_search(label), EDGE_KINDS, "unknown")


def block_edges(lines: DataFrame) -> DataFrame:
    """Edges between blocks that lines draw with arrows or name in words: source, target, label, kind."""
    text = F.col("text")
    parts = F.filter(F.transform(F.split(text, ARROWS), endpoint), lambda x: x != "")
    none = F.array().cast("array<struct<source:string,target:string,label:string>>")
    drawn = F.when(has(text, r"->|=>") & (F.size(parts) > 1), F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.get(parts, i).alias("source"), F.get(parts, i + 1).alias("target"), F.lit("").alias("label")))).otherwise(none)
    said = [F.when(text.rlike(p), F.array(F.struct(endpoint(F.regexp_extract(text, p, 1)).alias("source"), endpoint(F.regexp_extract(text, p, 2)).alias("target"), F.lit(label).alias("label")))).otherwise(none) for label, p in CONNECTIONS]
    rows = _pieces(lines).select(*KEYS, "part", "text", F.posexplode(F.concat(drawn, *said)).alias("i", "e")).select(*KEYS, "part", "i", "text", "e.*")
    rows = rows.where((F.col("source") != "") & (F.col("target") != "") & (normalize_for_search(F.col("source")) != normalize_for_search(F.col("target"))))
    flat = [normalize_for_search(F.col(c)) for c in ("source", "target", "label")]
    first = F.row_number().over(W.partitionBy("filename", "page", *flat).orderBy("pos", "part", "i"))
    kind = edge_kind(F.when(F.col("label") != "", F.col("label")).otherwise(F.col("text")))
    return rows.withColumn("n", first).where("n = 1").select(*KEYS, "source", "target", "label", kind.alias("kind"))


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks that lines name, one for each spelling on a page: block, kind, and whether it is a port."""
    rows = _pieces(lines)
    label = compact(F.col("text"), 100)
    edge = has(F.col("text"), r"(?i)->|=>|connected to|feeds|drives|input to|output to")
    whole = F.when(F.length(label).between(2, 100) & ~edge & (tokens.block_kind(label) != "unknown"), F.array(label)).otherwise(F.array().cast("array<string>"))
    typed = F.filter(tokens.hardware_tokens(F.col("text")), lambda x: x["token_type"].isin("register", "signal", "counter") | (tokens.block_kind(x["token"]) != "unknown"))
    spread = rows.select(*KEYS, "part", F.posexplode(F.concat(whole, F.transform(typed, lambda x: x["token"]))).alias("i", "block"))
    first = F.row_number().over(W.partitionBy("filename", "page", normalize_for_search(F.col("block"))).orderBy("pos", "part", "i"))
    port = has(F.col("block"), r"(?i)\b(?:clk|clock|rst|reset|irq|int|req|ack|rx|tx|sda|scl)\b")
    return spread.withColumn("n", first).where("n = 1").select(*KEYS, "block", tokens.block_kind(F.col("block")).alias("kind"), port.alias("port"))
