"""Passages: what is detected in them, their kind, and the hybrid ranking.

A passage is a row with a text; detected adds arrays of headings, registers and bit fields, from
which its kind and its points follow. The ranking needs no join: term counts and places stay in the
passage's own row, and the corpus' statistics are one row of sums.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import DASHES, STOP_WORDS, canonical_symbol, count_loose, count_word, fuzzy_similarity, half_up, has, normalize_for_search, normalize_text, once, rx

# --- fixed values: detection --------------------------------------------------------------------
HEADINGS = [r"^\d+(?:\.\d+){1,8}\s+\S+", r"(?i)^Appendix\s+[A-Z0-9]+\b", r"(?i)^(Table|Figure)\s+\d[\d.\-]*\b"]
HEADING_WORDS, HEADING_WORD_CHARS = r"(?i)\b(Register|Registers|Bit Field|Interrupt|Clock|Reset|Operation|Description)\b", 180
HEADING_CAPS = [r"^[A-Z0-9][A-Z0-9_ /,()\-]{8,160}$", r"[A-Z]{4}"]
MOST_HEADINGS, HEADING_CHARS, MOST_REGISTERS, MOST_BITFIELDS = 10, 220, 120, 100
_ENDS = "(?:R|CR|SR|DR|MR|ER|FR|RR|TR|BR|AR|LR|PR|CSR|ISR|IER|ICR|CTRL|STAT)"
REGISTERS = [
    r"\b[A-Z][A-Za-z0-9]*m_[A-Za-z0-9_]+(?:_n)?\b",
    r"\b[A-Z]{2,12}m_[A-Za-z0-9_]+(?:_n)?\b",
    rf"\b[A-Z]{{2,12}}_[A-Z0-9_]*{_ENDS}\d*\b",
    rf"\b(?:MAC|MTL|DMA|DMAC|GMAC|ETH|GBETH|WDT|GPT|GT|POEG|ICU|IRQ|INT|SPI|I2C|I3C|UART|CAN|ADC)[A-Z0-9_]*{_ENDS}\d*\b",
    r"\b(?:WDT|WDTRR|WDTCR|WDTSR|WDTRCR|GTCR|GTUDDTYC|GTCNT|GTCCR|GTCCRA|GTCCRB|GTIOR|GTINTAD|GTST|GTBER|GTPR|GTPBR|GTDTCR|GTDVU|GTDVD)\b",
]
BITFIELDS = [r"\b[A-Z][A-Z0-9_]{1,31}\s*\[[0-9]+(?::[0-9]+)?\]", r"\b[A-Z][A-Z0-9_]{1,31}\b"]

# --- fixed values: kinds of passages ------------------------------------------------------------
CONTENTS, INDEX_HEADING, PAGE_REF, NUMBERED_REF, CHAPTER = r"(?i)\b(table of contents|contents|list of figures|list of tables)\b", r"(?i)\bindex\b", r"\.{2,}\s*\d+\s*$", r"^\d+(?:\.\d+){1,5}\s+.+\s+\d+\s*$", r"^\d+(?:\.\d+)*\s+.+"
TOC_LINES, TOC_SHARE, TOC_CHAPTERS, TOC_REFS = 8, 0.45, 5, 5
#: (type, content points, noise points, all of these, none of this)
KINDS: list[tuple[str, int, int, tuple[str, ...], str]] = [
    ("revision_history", -30, 65, (r"(?i)\b(revision history|document revision|revision record|rev\.?\s+date|description of revision)\b",), ""),
    ("legal_notice", -25, 55, (r"(?i)\b(copyright|trademark|notice|disclaimer|all rights reserved|renesas electronics corporation)\b",), r"(?i)\bregister|bit|operation\b"),
    ("register_table", 55, -15, (r"(?i)\b(Register\s+Name|Abbreviation|Offset\s+Address|Initial\s+Value|Access\s+Size)\b",), ""),
    ("bitfield_table", 55, -15, (r"(?i)\b(Bit\s+Name|Bit\s+Field|R/W|R/O|W/O|Initial\s+Value|Description)\b", r"(?i)\b(bit|b\d+|\[\d+(?::\d+)?\])\b"), ""),
    ("caution", 45, -10, (r"(?i)\b(Caution|CAUTION|Note|NOTES?|Restriction|Restrictions|Prohibited|Forbidden|Undefined|Invalid|Reserved|must\s+not|do\s+not|only\s+when)\b",), ""),
    ("procedure", 35, -5, (r"(?i)\b(sequence|procedure|operation|setting|settings|step|steps|before|after|when|while|first|then|enable|disable|start|stop|clear|reset|initialize|initialization)\b",), ""),
    ("interrupt_status", 30, -5, (r"(?i)\b(interrupt|IRQ|INT|status flag|interrupt request|interrupt status|enable interrupt|clear interrupt)\b",), ""),
    ("clock_reset", 22, -3, (r"(?i)\b(clock|PCLK|module stop|standby|reset release|software reset|SWRST|reset)\b",), ""),
]
REGISTER_WORDS, BITFIELD_WORDS = r"(?i)\b(Address|Offset|Initial\s+Value|Access|Description|Register)\b", r"(?i)\b(Bit|Description|Set|Clear|Read|Write)\b"
OVERVIEW, OVERVIEW_HEADING = r"(?i)\b(overview|features|block diagram|functional overview|outline)\b", r"(?i)overview|outline|features"
CAPS_LINES, CAPS_SHARE, SHORT_CHARS, START, USEFUL = 30, 0.78, 30, 35, 25
PRIORITY = ["register_table", "bitfield_table", "caution", "procedure", "interrupt_status", "clock_reset", "register_description", "overview", "toc_index", "revision_history", "legal_notice", "noise", "text"]

# --- fixed values: the hybrid query -------------------------------------------------------------
SYNONYMS = [
    ["start", "enable", "activate", "run", "kick", "trigger", "seten", "tstart", "issue", "pending"],
    ["stop", "disable", "halt", "terminate", "abort", "pause", "suspend", "clren", "clrrq"],
    ["clear", "ack", "acknowledge", "reset flag", "clear flag", "clear status", "w1c", "w0c", "write one", "write zero"],
    ["interrupt", "irq", "isr", "event", "interrupt request", "interrupt status"],
    ["error", "fault", "abnormal", "bus error", "err", "overflow", "underflow"],
    ["initialize", "initialise", "initialization", "initialisation", "init", "setup", "configure", "configuration", "setting"],
    ["reset", "software reset", "module reset", "swrst", "rst", "reset release"],
    ["status", "flag", "state", "condition", "result"],
    ["register", "reg", "abbreviation", "offset", "address", "initial value", "reset value", "access size"],
    ["bitfield", "bit field", "field", "bit", "mask", "shift", "bit name"],
    ["caution", "note", "restriction", "prohibited", "forbidden", "undefined", "invalid", "reserved", "do not", "must not"],
    ["transfer complete", "transfer end", "tc", "end", "completion", "done"],
    ["read modify write", "rmw", "preserve", "reserved bits", "write back", "mask"],
]
SYMBOL_ALIASES = [["IRQ", "INT", "INTERRUPT"], ["ERR", "ER", "ERROR"], ["TC", "TRANSFERCOMPLETE", "TRANSFEREND", "END"], ["EN", "ENABLE", "SETEN", "START"], ["DIS", "DISABLE", "CLREN", "STOP"], ["SUS", "SUSPEND", "SUSPENDED"], ["RST", "RESET", "SWRST"], ["STAT", "STATUS", "SR"], ["CTRL", "CONTROL", "CR"], ["CFG", "CONFIG", "CONFIGURATION"]]
REWRITES = [("INT", "IRQ"), ("IRQ", "INT"), ("CTRL", "CONTROL"), ("STAT", "STATUS")]
#: (intent, words of the normalized query, or parts of its canonical form)
INTENTS: list[tuple[str, str, str]] = [
    ("register", r"\b(register|offset|address|initial value|reset value|access size|abbreviation)\b", ""),
    ("bitfield", r"\b(bit|bits|bitfield|field|mask|bit name|r/w|rw|write only|read only)\b", ""),
    ("sequence", r"\b(sequence|procedure|flow|operation|step|steps|before|after|start|stop|enable|disable|init|initialize|configuration|configure|reset|clear|interrupt|irq|error)\b", ""),
    ("caution", r"\b(caution|note|restriction|prohibited|forbidden|undefined|invalid|reserved|must|do not|only when|write 1|write one|write 0|write zero|w1c|w0c)\b", ""),
    ("section", r"\b(section|chapter|paragraph|overview|description)\b", ""),
    ("table", r"\b(table|list of registers|register list|register map|column|row)\b", ""),
    ("init", r"\b(init|initial|initialize|initialization|setup|setting|configure|configuration)\b", ""),
    ("start", r"\b(start|enable|run|trigger|request|activate|resume|seten|tstart)\b", "SETEN|TSTART"),
    ("stop", r"\b(stop|disable|halt|suspend|pause|cancel|terminate|abort|clren|clrrq)\b", "CLREN|CLRRQ|SUSP"),
    ("clear", r"\b(clear|ack|acknowledge|status|flag|complete|completion|done|end|w1c|w0c|write 1|write one|write 0|write zero)\b", ""),
    ("reset", r"\b(reset|software reset|swrst|module reset|rst)\b", "SWRST|RESET"),
    ("irq", r"\b(interrupt|irq|request|event|status)\b", ""),
    ("error", r"\b(error|err|fault|bus error|overflow|underflow|abnormal)\b", ""),
]
INTENT_TERMS = {
    "register": ["register", "register name", "abbreviation", "offset", "address", "initial value", "reset value", "access size"],
    "bitfield": ["bit", "bit name", "bit field", "field", "mask", "description", "r w", "read only", "write only"],
    "sequence": ["sequence", "procedure", "operation", "setting", "initial", "initialize", "configure", "configuration", "before", "after"],
    "init": ["sequence", "procedure", "operation", "setting", "initial", "initialize", "configure", "configuration", "before", "after"],
    "start": ["start", "enable", "run", "trigger", "request", "activate", "resume", "seten", "tstart"],
    "stop": ["stop", "disable", "halt", "suspend", "pause", "terminate", "abort", "clren", "clrrq"],
    "clear": ["clear", "status", "flag", "acknowledge", "write 1", "write one", "write 0", "write zero", "w1c", "w0c", "end", "complete"],
    "reset": ["reset", "software reset", "module reset", "swrst", "rst"],
    "irq": ["interrupt", "irq", "event", "request", "status", "enable interrupt", "interrupt status"],
    "error": ["error", "fault", "bus error", "abnormal", "overflow", "underflow", "err"],
    "caution": ["caution", "note", "restriction", "prohibited", "forbidden", "undefined", "invalid", "reserved", "must", "do not", "only when"],
    "section": ["section", "chapter", "overview", "description", "operation", "register description"],
    "table": ["table", "row", "column", "register name", "abbreviation", "offset address", "access size", "bit name"],
}
FLOW_INTENTS = ("sequence", "init", "start", "stop", "clear", "reset", "irq", "error")
#: (one of these intents, points, pattern of the search text)
LANGUAGE: list[tuple[tuple[str, ...], int, str]] = [
    (("register",), 70, r"(?i)\b(Register Name|Abbreviation|Offset Address|Address|Initial Value|Access Size)\b"),
    (("bitfield",), 70, r"(?i)\b(Bit Name|Bit|Description|R/W|Initial Value|Access)\b"),
    (FLOW_INTENTS, 60, r"(?i)\b(sequence|procedure|operation|setting|start|stop|enable|disable|clear|reset|interrupt|status|request|error)\b"),
    (FLOW_INTENTS, 35, r"(?i)\b(before|after|when|must|should|first|then|following|steps?)\b"),
    (("caution",), 90, r"(?i)\b(Caution|Note|Restriction|Prohibited|Forbidden|Undefined|Invalid|Reserved|must|do not|only when)\b"),
    (("caution",), 55, r"(?i)write\s+(?:1|one|0|zero)|write-?1|write-?0|W1C|W0C"),
]
TABLE_WORDS, FRONT_MATTER = r"(?i)\b(Register Name|Abbreviation|Offset|Bit Name|Access Size|Initial Value|Description)\b", r"(?i)\b(Revision|Contents|Index)\b"
#: (one of these intents, points, one of these types)
BOOSTS: list[tuple[tuple[str, ...], int, tuple[str, ...]]] = [
    (("register",), 95, ("register_table", "register_description")),
    (("bitfield", "table"), 95, ("bitfield_table",)),
    (("table",), 80, ("register_table", "bitfield_table")),
    (("caution",), 110, ("caution",)),
    (FLOW_INTENTS, 90, ("procedure",)),
    (("irq",), 90, ("interrupt_status",)),
    (("reset",), 65, ("clock_reset",)),
    (("section",), 35, ("overview",)),
]
VOCABULARY = [(r"(?i)\bAddress\s*:?\b", 8), (r"(?i)\bOffset\s*:?\b", 5), (r"(?i)\bAccess\s+Size\s*:?\b", 8), (r"(?i)\bInitial\s+Value\s*:?\b", 8), (r"(?i)\bBit\s+Name\b", 10), (r"(?i)\bDescription\b", 3)]
K1, B, BM25_WEIGHT, WINDOW, WINDOW_WEIGHT, PLACES, MOST_PROXIMITY = 1.35, 0.72, 24, 18, 28, 12, 120
DISTINCT_TOKENS = 500


def _flat(text: str) -> str:
    out = re.sub(f"[{DASHES}]", "-", unicodedata.normalize("NFKC", text.lower()))
    return re.sub(r"\s+", " ", re.sub(r"[_\-./()\[\]{}:;,=+*<>|]+", " ", out)).strip()


def _symbol(text: str) -> str:
    return re.sub(r"[^A-Z0-9_]", "", unicodedata.normalize("NFKC", text.upper()))


def _kept(items, most: int) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))[:most]


def _phrases(group: list[str]) -> list[str]:
    """The phrases of a group and their words."""
    out: dict[str, None] = {}
    for phrase in map(_flat, group):
        out[phrase] = None
        out.update(dict.fromkeys(w for w in phrase.split() if w not in STOP_WORDS))
    return list(out)


def _neighbours(groups: list[list[str]]) -> dict[str, list[str]]:
    out: dict[str, dict[str, None]] = {}
    for group in groups:
        for word in group:
            out.setdefault(word, {}).update(dict.fromkeys(x for x in group if x != word))
    return {k: list(v) for k, v in out.items()}


_NEAR_WORDS, _NEAR_SYMBOLS = _neighbours([_phrases(g) for g in SYNONYMS]), _neighbours(SYMBOL_ALIASES)


class HybridQuery:
    """A query with its intents, and the terms and symbols that follow from them."""

    def __init__(self, text: str, intent: str = "auto", register: str = ""):
        self.raw, self.phrase, self.symbol = text.strip(), _flat(text), _symbol(text)
        self.all_words = _kept((t for t in self.phrase.split(" ") if len(t) > 1), 1 << 30)
        self.terms = [t for t in self.all_words if t not in STOP_WORDS]
        self.symbols = _kept((s for s in map(_symbol, re.split(r"[\s,;:/()\[\]{}]+", self.raw)) if len(s) > 1), 1 << 30)
        self.register = _symbol(register)
        forced = [intent.strip().lower()] if intent.strip().lower() not in ("", "auto") else []
        found = [name for name, words, parts in INTENTS if re.search(words, self.phrase, re.A) or parts and re.search(parts, self.symbol)]
        self.intents = _kept([*forced, *found], 99) or ["generic"]
        self.intent_terms = _kept((t for i in self.intents for phrase in INTENT_TERMS.get(i, ()) for t in _flat(phrase).split() if len(t) > 1 and t not in STOP_WORDS), 1 << 30)
        near: dict[str, None] = {}
        for t in [*self.terms, *self.intent_terms]:
            near.update(dict.fromkeys([t, *_NEAR_WORDS.get(t, ())]))
        aliases: dict[str, None] = {}
        for s in self.symbols:
            aliases.update(dict.fromkeys([s, *_NEAR_SYMBOLS.get(s, ()), *(s.replace(a, b) for a, b in REWRITES if a in s)]))
        self.aliases = list(aliases)[:80]
        spelt = [t for t in map(_flat, self.aliases) if t]
        self.expanded = _kept([*self.terms, *self.intent_terms, *list(near)[:140], *spelt], 140)
        self.important = _kept([*self.terms, *map(_flat, self.symbols), *spelt], 90)
        self.counted = _kept([*self.expanded, *self.important], 160)

    def weight(self, term: str) -> float:
        return 2.4 if term in self.terms else 2.0 if term in self.important else 1.15 if term in self.intent_terms else 0.9

    def has(self, *intents: str) -> bool:
        return any(i in self.intents for i in intents)


def total(parts: list[Column]) -> Column:
    """Their sum, as a balanced tree: a long chain takes the analyzer one round for each link."""
    if not parts:
        return F.lit(0)
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | has(text, p)
    return out


def _needed(pattern: str) -> list[str]:
    """Lower-case texts one of which every match of a pattern of alternatives holds; none if that cannot be said."""
    body = pattern.removeprefix("(?i)")
    inner = re.search(r"\((?:\?:)?([^()]*(?:\([^()]*\)\??[^()]*)*)\)", body)
    if not pattern.startswith("(?i)") or "|" in (body.replace(inner[0], "") if inner else body):
        return []
    parts = re.split(r"\|(?![^(]*\))", inner[1]) if inner else [body]
    out = []
    for part in parts:
        plain = re.sub(r"\([^()]*\)\?|\[[^\]]*\]|.\?|\\[a-zA-Z][+*]?|\\.", "\n", part)
        runs = [r for r in re.findall(r"[A-Za-z/ ]{2,}", plain)]
        if not runs:
            return []
        out.append(max(runs, key=len).lower())
    return list(dict.fromkeys(out))


def _seen(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern is found; the costly search is left out where none of its words stands in low, the text in lower case."""
    needed = _needed(pattern)
    if not needed:
        return has(text, pattern)
    there = F.contains(low, F.lit(needed[0]))
    for part in needed[1:]:
        there = there | F.contains(low, F.lit(part))
    return there & has(text, pattern)


#: What a text must hold for a pattern of REGISTERS, and of BITFIELDS, to be found in it.
_SIGNS = [r"m_", r"m_", r"[A-Z]_", r"MAC|MTL|DMA|ETH|WDT|GPT|GT|POEG|ICU|IRQ|INT|SPI|I2C|I3C|UART|CAN|ADC", r"WDT|GT"], [r"\[[0-9]", r"[A-Z][A-Z0-9_]"]


def _found(text: Column, patterns, signs) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(text.rlike(sign), F.regexp_extract_all(text, F.lit(rx(p)), F.lit(0))).otherwise(none) for p, sign in zip(patterns, signs, strict=True)))


def detected(passages: DataFrame) -> DataFrame:
    """passages with headings, registers, bit_fields and symbols, each an array in order of detection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    heading = lambda x: _any(x, HEADINGS) | ((F.length(x) <= HEADING_WORD_CHARS) & _seen(x, F.lower(x), HEADING_WORDS)) | (x.rlike(HEADING_CAPS[0]) & x.rlike(HEADING_CAPS[1]))
    headings = F.array_distinct(F.transform(F.slice(F.filter(lines, heading), 1, MOST_HEADINGS), lambda x: F.substring(x, 1, HEADING_CHARS)))
    registers = F.slice(F.array_distinct(F.filter(_found(text, REGISTERS, _SIGNS[0]), lambda x: F.length(x).between(3, 80))), 1, MOST_REGISTERS)
    fields = F.filter(F.transform(_found(text, BITFIELDS, _SIGNS[1]), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: F.length(x).between(2, 40))
    names = F.struct(F.lower(text).alias("low"), headings.alias("headings"), registers.alias("registers"), F.slice(F.array_distinct(fields), 1, MOST_BITFIELDS).alias("bit_fields"))
    out = once(passages, "__names", names).withColumns({c: F.col(f"__names.{c}") for c in ("low", "headings", "registers", "bit_fields")}).drop("__names")
    symbols = F.filter(F.array_distinct(F.transform(F.concat("registers", "bit_fields"), canonical_symbol)), lambda x: x != "")
    return out.withColumn("symbols", symbols)


def kind() -> Column:
    """struct(chunk_type, types, noise, content) of a detected passage."""
    text, headings, low = F.coalesce(F.col("text"), F.lit("")), F.col("headings"), F.col("low")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n_lines = F.size(lines)
    referring = F.size(F.filter(lines, lambda x: (F.contains(x, F.lit("..")) & x.rlike(PAGE_REF)) | x.rlike(NUMBERED_REF)))
    chapters = F.size(F.filter(lines, lambda x: x.rlike(CHAPTER)))
    toc = _seen(text, low, CONTENTS) | (has(normalize_for_search(F.array_join(headings, " ")), INDEX_HEADING) & (n_lines > TOC_LINES))
    toc = toc | ((n_lines >= TOC_LINES) & (referring / F.greatest(n_lines, F.lit(1)) > TOC_SHARE)) | (F.contains(low, F.lit("contents")) & F.contains(normalize_for_search(text), F.lit("contents")) & (chapters >= TOC_CHAPTERS))
    checks: list[tuple[str, int, int, Column]] = [("noise", -20, 45, (F.trim(text) == "") | (F.length(text) < SHORT_CHARS)), ("toc_index", -35, 70, toc)]
    for name, content, noise, needs, without in KINDS:
        found = _seen(text, low, needs[0])
        for more in needs[1:]:
            found = found & has(text, more)
        checks.append((name, content, noise, found & ~has(text, without) if without else found))
    checks.append(("register_description", 35, -8, (F.size("registers") > 0) & _seen(text, low, REGISTER_WORDS)))
    checks.append(("bitfield_table", 30, -8, (F.size("bit_fields") >= 2) & _seen(text, low, BITFIELD_WORDS)))
    checks.append(("overview", 18, -3, _seen(text, low, OVERVIEW) | F.exists(headings, lambda h: h.rlike(OVERVIEW_HEADING))))
    letters, capitals = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    shouted = (n_lines > CAPS_LINES) & (capitals / F.greatest(letters, F.lit(1)) > CAPS_SHARE)
    refs = F.contains(text, F.lit("..")) & (F.regexp_count(text, F.lit(f"(?m){PAGE_REF}")) >= TOC_REFS)
    checks += [("noise", -25, 35, shouted), ("toc_index", -25, 45, refs)]
    # Each check is made once; what follows reads its result.
    made = F.array(F.struct(*(found.alias(f"c{i}") for i, (*_, found) in enumerate(checks))))
    return F.get(F.transform(made, lambda m: _kind([(name, content, noise, m[f"c{i}"]) for i, (name, content, noise, _) in enumerate(checks)])), F.lit(0))


def _kind(checks: list[tuple[str, int, int, Column]]) -> Column:
    """The kind by the checks' results; the last two are of shouting and of references."""
    *checks, (*shout, shouted), (*refer, refs) = checks
    present = {name: F.lit(False) for name in PRIORITY}
    for name, _, _, found in checks:
        present[name] = present[name] | found
    shouted = shouted & ~present["register_table"] & ~present["bitfield_table"]
    refs = refs & ~present["register_table"]
    checks += [(*shout, shouted), (*refer, refs)]
    present["noise"], present["toc_index"] = present["noise"] | shouted, present["toc_index"] | refs
    content, noise = F.lit(START), F.lit(0)
    for _, c, n, found in checks:
        content, noise = content + F.when(found, c).otherwise(0), noise + F.when(found, n).otherwise(0)
    useful = present["register_table"] | present["bitfield_table"] | present["procedure"] | present["caution"]
    noise = F.when(useful, F.greatest(noise - USEFUL, F.lit(0))).otherwise(noise)
    types = F.array_compact(F.array(*(F.when(present[k], F.lit(k)) for k in PRIORITY[:-1])))
    types = F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("text")))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(100)).cast("int")
    return F.struct(F.get(types, F.lit(0)).alias("chunk_type"), types.alias("types"), clamp(noise).alias("noise"), clamp(content - half_up(noise / 3)).alias("content"))


def type_points(query: HybridQuery) -> Column:
    """Points for a passage's kind, over types, noise and content."""
    types = F.col("types")
    score = half_up(F.col("content") / 8) - F.when(F.col("noise") >= 75, 120).when(F.col("noise") >= 50, 55).otherwise(0)
    if not query.has("section", "table"):
        score = score - F.when(F.arrays_overlap(types, F.array(*map(F.lit, ("toc_index", "revision_history", "legal_notice", "noise")))), 85).otherwise(0)
    for intents, points, kinds in BOOSTS:
        if query.has(*intents):
            score = score + F.when(F.arrays_overlap(types, F.array(*map(F.lit, kinds))), points).otherwise(0)
    return score


def lexical(query: HybridQuery) -> Column:
    """Points for the query's phrase, symbols and words, over flat, raw, and the normalized names."""
    flat, heads, regs, bits, symbols = (F.col(c) for c in ("flat", "head_flat", "reg_flat", "bit_flat", "symbols"))
    parts: list[Column] = []
    if query.phrase:
        for where, points in ((flat, 70), (heads, 45), (regs, 90), (bits, 60)):
            parts.append(F.when(F.contains(where, F.lit(query.phrase)), points).otherwise(0))
    if query.symbol:
        own = F.lit(query.symbol)
        parts.append(F.when(F.array_contains(symbols, own), 120).otherwise(0) + 25 * F.size(F.filter(symbols, lambda s: F.contains(s, own) | F.contains(own, s))))
    for s in query.symbols:
        parts.append(F.when(F.array_contains(symbols, F.lit(s)), 60).otherwise(0))
    for t in query.all_words:
        inside = F.when(F.contains(flat, F.lit(t)), 10 * count_word(flat, t) + 2 * count_loose(flat, t)).otherwise(0)
        parts.append(inside)
        for where, points in ((heads, 12), (regs, 20), (bits, 14)):
            parts.append(F.when(F.contains(where, F.lit(t)), points).otherwise(0))
    for pattern, points in VOCABULARY:
        parts.append(F.when(_seen(F.col("raw"), F.col("raw_low"), pattern), points).otherwise(0))
    return total(parts)


def _closeness(query: HybridQuery) -> Column:
    """Points for important terms close to each other, over toks."""
    wanted = [t for t in query.important if len(t) > 1][:24]
    if len(wanted) < 2:
        return F.lit(0.0)
    hits = F.filter(F.transform(F.col("toks"), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(*wanted))
    of = lambda t: lambda x: x["t"] == t
    first = F.concat(*(F.slice(F.filter(hits, of(t)), 1, PLACES) for t in wanted))
    gaps = F.flatten(F.transform(first, lambda x: F.transform(F.filter(first, lambda y: (y["t"] > x["t"]) & (F.abs(y["i"] - x["i"]) <= WINDOW)), lambda y: F.abs(y["i"] - x["i"]))))
    near = (F.lit(WINDOW) - F.array_min(gaps)) * WINDOW_WEIGHT / WINDOW
    return F.when(F.size(gaps) > 0, F.least(F.lit(float(MOST_PROXIMITY)), F.size(gaps) * 8 + near)).otherwise(0.0)


def hybrid_points(query: HybridQuery, related_pages=(), related_registers=()) -> Column:
    """All of a passage's points but BM25, over what prepared() adds."""
    flat, raw, words, symbols = F.col("flat"), F.col("raw"), F.col("words"), F.col("symbols")
    parts = [lexical(query), type_points(query), _closeness(query)]
    canonical = F.col("canonical")
    named = [F.when(F.array_contains(symbols, F.lit(a)) | F.contains(canonical, F.lit(a)), 45).otherwise(0) for a in query.aliases]
    if named:
        parts.append(F.least(sum(named[1:], named[0]), F.lit(180)))
    if query.phrase:
        parts.append(F.when(F.contains(flat, F.lit(query.phrase)), 130).otherwise(0))
    if query.symbol:
        parts.append(F.when(F.array_contains(symbols, F.lit(query.symbol)), 160).otherwise(0))
    if query.important:
        hits = [F.when(F.array_contains(words, F.lit(t)) | F.contains(flat, F.lit(t)), 1).otherwise(0) for t in query.important]
        parts.append(half_up(F.lit(120.0) * sum(hits[1:], hits[0]) / len(query.important)))
    for t in query.expanded:
        parts.append(F.when(F.array_contains(words, F.lit(t)), 4).when(F.contains(flat, F.lit(t)), 2).otherwise(0))
    alike = lambda t: lambda w: (F.abs(F.length(w) - len(t)) <= 2) & (fuzzy_similarity(F.lit(t), w) >= 0.86)
    for t in [t for t in query.important if len(t) >= 4][:12]:
        parts.append(F.when(~F.array_contains(words, F.lit(t)) & F.exists(words, alike(t)), 12).otherwise(0))
    if query.register:
        parts.append(F.when(F.contains(canonical, F.lit(query.register)), 170).otherwise(0))
    if related_pages:
        parts.append(F.when(F.col("page").isin(*related_pages), 45).otherwise(0))
    if related_registers:
        parts.append(F.when(F.arrays_overlap(symbols, F.array(*(F.lit(_symbol(r)) for r in related_registers))), 30).otherwise(0))
    for intents, points, pattern in LANGUAGE:
        if query.has(*intents):
            parts.append(F.when(_seen(raw, F.col("raw_low"), pattern), points).otherwise(0))
    if query.has("section"):
        parts.append(F.when(F.col("head_flat") != "", 25).otherwise(0))
    else:
        parts.append(-F.when(_seen(raw, F.col("raw_low"), FRONT_MATTER), 20).otherwise(0))
    if query.has("table"):
        parts.append(F.least(16 * F.regexp_count(raw, F.lit(rx(TABLE_WORDS))), F.lit(90)))
    parts.append(-F.when(F.length(F.coalesce(F.col("text"), F.lit(""))) < 80, 25).otherwise(0))
    terms = _kept([*query.important, *query.expanded], 40)
    lines = F.filter(F.array_distinct(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), normalize_text)), lambda x: F.length(x) >= 3)
    asked = F.array(*map(F.lit, [*([query.phrase] if query.phrase else []), *terms]))
    pairs = F.transform(lines, lambda x: F.struct(normalize_for_search(x).alias("flat"), (canonical_symbol(x) if query.register else F.lit("")).alias("symbol")))
    telling = lambda x: F.exists(asked, lambda t: F.contains(x["flat"], t)) | (F.contains(x["symbol"], F.lit(query.register)) if query.register else F.lit(False))
    shown = F.size(F.filter(pairs, telling))
    return total([*parts, F.least(10 * F.least(shown, F.lit(6)), F.lit(40))])


def prepared(passages: DataFrame, compatibility: bool = False) -> DataFrame:
    """Detected passages with all that points are given for: raw, flat, the names' texts, canonical, toks and words."""
    found = once(detected(passages), "k", kind())
    names = [F.array_join(c, "\n") for c in ("headings", "registers", "bit_fields")]
    found = found.withColumns({"raw": F.concat_ws("\n", F.coalesce("text", F.lit("")), *names), "types": F.col("k.types"), "noise": F.col("k.noise"), "content": F.col("k.content")})
    flat = lambda c, by: normalize_for_search(F.array_join(c, by), compatibility)
    canonical = canonical_symbol(F.concat_ws("\n", F.array_join("registers", "\n"), F.array_join("bit_fields", "\n"), F.array_join("headings", "\n"), F.coalesce("text", F.lit(""))))
    found = found.withColumns({"raw_low": F.lower("raw"), "flat": normalize_for_search(F.col("raw"), compatibility), "head_flat": flat("headings", "\n"), "reg_flat": flat("registers", "\n"), "bit_flat": flat("bit_fields", "\n"), "canonical": canonical})
    keep = lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)
    found = found.withColumn("toks", F.filter(F.split("flat", " "), keep))
    return found.withColumn("words", F.slice(F.array_distinct("toks"), 1, DISTINCT_TOKENS))


def hybrid_rank(passages: DataFrame, query: HybridQuery, keys: list[str], k: int, related_pages=(), related_registers=(), compatibility: bool = False) -> DataFrame:
    """The k best passages: keys, chunk_type, bm25, and score, the sum of all points.

    Two scans of the passages, one for the corpus' sums and one for the ranking; nothing is joined
    but one row, and only the k best rows of each partition are shuffled.
    """
    ready = prepared(passages, compatibility)
    terms = query.counted
    hits = F.filter("toks", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    base = ready.withColumn("hits", hits).withColumn("dl", F.size("toks"))
    seen = [F.sum(F.when(F.array_contains("hits", t), 1).otherwise(0)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = base.select("dl", "hits").agg(F.greatest(F.count("*"), F.lit(1)).alias("docs"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("mean"), *seen)
    met = base.crossJoin(F.broadcast(stats))  # one row
    parts, same = [], lambda t: lambda x: x == t
    for i, t in enumerate(terms):
        tf = F.size(F.filter("hits", same(t)))
        idf = F.ln(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        parts.append(F.when(F.array_contains("hits", t), idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.col("mean")))) * query.weight(t)).otherwise(0.0))
    met = met.withColumn("bm25", half_up(total(parts) * BM25_WEIGHT).cast("int")).withColumn("points", hybrid_points(query, related_pages, related_registers))
    out = met.select(*keys, F.col("k.chunk_type").alias("chunk_type"), "bm25", half_up(F.col("points") + F.col("bm25")).cast("int").alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(k)


