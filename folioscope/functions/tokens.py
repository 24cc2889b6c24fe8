"""Technical tokens of figures and recognized text as Column expressions: their types, names drawn from them, and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import DASHES, compact, has, nfkc, normalize_for_search, rx, slug

# --- fixed values: tokens -----------------------------------------------------------------------
TOKEN = r"\b[A-Za-z][A-Za-z0-9_]*(?:\[[A-Za-z0-9_:.]+\])?(?:\.[A-Za-z][A-Za-z0-9_]*(?:\[[A-Za-z0-9_:.]+\])?)?\b"
VALUE = r"(?i)^(?:0x[0-9a-f_]+|[01x_]+b|[0-9a-f_]+h)$"
VALUE_WITHIN = r"(?i)\b(?:0x[0-9a-f_]+|[01x_]+b|[0-9a-f_]+h)\b"
BITFIELD = r"\.[A-Za-z][A-Za-z0-9_]*|\[[0-9A-Za-z_:.]+\]"
SIGNAL = (r"(?i)^GTIOC", r"(?i)\b(?:IRQ|INT|NMI|REQ|ACK|CLK|CLOCK|RST|RESET|RX|TX|SDA|SCL|MISO|MOSI|CTS|RTS)\b", r"[A-Z]{2,}[A-Za-z0-9_]*n[A-Z0-9]?[A-Za-z0-9_]*$")
REGISTER = (r"(?i)^(?:GT|GTP|WDT|DMAC|DMA|USB|GBETH|PFC|GPIO|CAN|IIC|RIIC|SPI|RSPI|PCI|PCIE|INTC|IRQ|ETH|MAC|TCON|POE)[A-Za-z0-9_]*$", r"^[A-Z][A-Z0-9_]{2,}$")
NON_SYMBOLS = (
    "A AN AND ARE AS AT BE BY COUNT COUNTER DESCRIPTION EDGES EDGE EXAMPLE FIGURE FOR FROM HIGH INPUT LOW MODE NAME NO NOTE OF ON OPERATION OUTPUT PAGE PIN REGISTER REV SAW SET SETTING SOURCE STEP TABLE THE TIME TO UP VALUE WAVE WAVES WITH"
).split()
COUNTER, PIN_CONTEXT, PIN_TOKEN = r"(?i)CNT", r"(?i)\b(?:pin|signal|input|output)\b", r"^[A-Z0-9_]{3,}$"

# --- fixed values: blocks of diagrams, the first that is found ------------------------------------
BLOCK_KINDS = [
    ("bus", r"\b(?:axi|ahb|apb|bus|crossbar|interconnect)\b"),
    ("dma", r"\b(?:dma|dmac|dma controller)\b"),
    ("interrupt_controller", r"\b(?:irq|int|interrupt|intc)\b"),
    ("clock", r"\b(?:clk|clock|pll|oscillator)\b"),
    ("reset", r"\b(?:rst|reset)\b"),
    ("register", r"\b(?:register|reg)\b"),
    ("memory", r"\b(?:fifo|buffer)\b"),
    ("memory", r"\b(?:memory|ram|rom|sram|dram|flash)\b"),
    ("module", r"\b(?:cpu|ca55|cortex|processor|core)\b"),
    ("peripheral", r"\b(?:peripheral|timer|gpio|usb|can|spi|i2c|ethernet|uart|pwm)\b"),
    ("module", r"\b(?:module|controller|unit|engine|mux|selector|block)\b"),
]

# --- fixed values: driver hints; parts of a name, or (with =) a whole one, the first that is found --
SUBSYSTEMS = [
    ("pwm", "pwm timer"), ("ethernet", "ethernet netdev stmmac dwmac gbeth"), ("dmaengine", "dma"), ("watchdog", "watchdog =wdt"),
    ("pinctrl", "pinctrl pfc"), ("gpio", "gpio"), ("i2c", "i2c iic riic"), ("spi", "spi rspi"), ("uart", "uart serial"), ("can", "can"),
    ("usb", "usb xhci ehci ohci dwc3"), ("pcie", "pcie pci_express =pci pci-"), ("adc", "adc iio"), ("rtc", "rtc"),
]
FAMILIES = [
    ("stmmac", "stmmac dwmac"), ("xhci", "xhci usb3"), ("dwc3", "dwc3"), ("ehci", "ehci"), ("ohci", "ohci"), ("canfd", "canfd can-fd can_fd"),
    ("pcie-host", "pcie-host host_bridge root_complex =host =rc"), ("rspi", "rspi"), ("riic", "riic"), ("pfc", "pfc"), ("irq", "irq"),
]

# --- fixed values: sequences and cautions -------------------------------------------------------
BOILERPLATE = [
    r"(?i)\b(REVISION HISTORY|copyright|all rights reserved|notation of numbers and symbols)\b",
    r"(?i)\b(bit names? and statements?|examples? and have nothing to do with|correct operation of this LSI chip is not guaranteed)\b",
    r"(?i)^(?:Note\s*:?)?\s*(?:Access to (?:the\s+)?reserved|Access to (?:the\s+)?unavailable|Settings other than the above are prohibited)",
    r"\.{2,}\s*\d+\s*$",
]
TOPIC_WORDS = r"(?i)\b(operation|procedure|sequence|setting|settings|initial|start|stop|clear|reset|interrupt|error|transfer|request|enable|disable|suspend|refresh|handling|control|write)\b"
TOPIC_REGISTER, TOPIC_STEPS = r"(?i)\bregister\b\s*(?:\([^)]*\))?\s*$", r"(?i)\b(operation|procedure|steps?)\b"
TOPIC_CHARS, TOPIC_SENTENCE = 160, 14
RISKS = {
    "reserved-bit": "Preserve reserved bits and avoid raw writes that may change undefined/reserved fields.",
    "clear-semantics-write-1": "Verify write-1-to-clear behavior before acknowledging interrupt/status flags.",
    "clear-semantics-write-0": "Verify write-0-to-clear behavior before acknowledging interrupt/status flags.",
    "write-timing": "Verify allowed write timing such as stopped/running state before register writes.",
    "undefined-invalid": "Avoid invalid/undefined settings and mark unsupported configurations in the driver.",
    "prohibited": "Do not implement register operations that the manual marks as prohibited/forbidden.",
    "reset-access": "Verify reset/access constraints and preserve initial/reset values where required.",
}
OTHER_RISK = "Review this caution before approving related register writes."
HIGH_SCORE, MEDIUM_SCORE = 220, 120


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | has(text, p)
    return out


def distinct_by_case(items: Column) -> Column:
    """The first of each kind of spelling, whatever its case, in order."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)


def figure_symbol(text: Column) -> Column:
    """Letters, digits and the marks of bit ranges; upper and lower case stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_.:\[\]]+", "")


def semantic_lines(text: Column) -> Column:
    """Lines and parts between semicolons, each on one line of at most 500 characters, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n;]+"), lambda x: compact(x, 500)), lambda x: x != "")


def candidate_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx(TOKEN)), F.lit(0))
    return distinct_by_case(F.filter(found, lambda t: F.length(t) >= 2))


def base_name(token: Column) -> Column:
    """A token without its field and range."""
    return F.regexp_replace(F.get(F.split(token, r"\."), F.lit(0)), r"\[[^\]]+\]", "")


def is_register_token(token: Column) -> Column:
    base = base_name(token)
    signal = _any(base, SIGNAL) & ~has(base, r"(?i)CNT|COUNT")
    return ~base.rlike(VALUE) & ~signal & ~F.upper(base).isin(*NON_SYMBOLS) & _any(base, REGISTER)


def token_type(token: Column, context: Column) -> Column:
    pin = has(context, PIN_CONTEXT) & token.rlike(PIN_TOKEN) & ~F.upper(token).isin(*NON_SYMBOLS)
    register = F.when(token.rlike(COUNTER), "counter").otherwise("register")
    return F.when(token.rlike(VALUE), "value").when(token.rlike(BITFIELD), "bitfield").when(is_register_token(token), register).when(_any(token, SIGNAL) | pin, "signal").otherwise("unknown")


def hardware_tokens(text: Column) -> Column:
    """Array of (token, token_type), those of no known type left out."""
    typed = F.transform(candidate_tokens(text), lambda t: F.struct(t.alias("token"), token_type(t, text).alias("token_type")))
    return F.filter(typed, lambda x: x["token_type"] != "unknown")


def names_of(tokens: Column, kind: str) -> Column:
    """Base names of the hardware tokens of a type, distinct."""
    wanted = (lambda x: (x["token_type"] == "counter") | has(x["token"], r"(?i)CNT|counter")) if kind == "counter" else (lambda x: x["token_type"] == kind)
    return distinct_by_case(F.transform(F.filter(tokens, wanted), lambda x: base_name(x["token"])))


def value_tokens(text: Column) -> Column:
    return distinct_by_case(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx(VALUE_WITHIN)), F.lit(0)))


def block_kind(name: Column) -> Column:
    flat = normalize_for_search(name)
    out = F.lit("unknown")
    for kind, pattern in reversed(BLOCK_KINDS):
        found = has(flat, pattern) | is_register_token(name) if kind == "register" else has(flat, pattern)
        out = F.when(found, kind).otherwise(out)
    return out


# --- recognized text ----------------------------------------------------------------------------


def clean_ocr(text: Column) -> Column:
    """Recognized text with the marks of markup gone, and split names closed up."""
    out = F.translate(F.coalesce(text, F.lit("")), DASHES, "-" * len(DASHES))
    out = F.replace(F.regexp_replace(out, r"[{}$]", ""), F.lit("\\_"), F.lit("_"))
    for mark in ("_", r"\.", r"\[", r"\]"):
        out = F.regexp_replace(out, rf"\s*{mark}\s*", mark.lstrip("\\"))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, rx(r"\b([A-Z]{2,}[A-Z0-9]*)_([A-Z0-9])\b"), "$1$2")
    return F.trim(F.regexp_replace(out, rx(r"\b([A-Z]{2}[A-Z0-9]+)\s+([A-Z])\b"), "$1$2"))


def technical_candidate(clean: Column, found: Column) -> Column:
    """The one symbol that cleaned text with these hardware tokens is, or an empty text."""
    joined = figure_symbol(F.regexp_replace(clean, r"\s+", ""))
    only = F.get(found, F.lit(0))["token"]
    return F.when((F.size(found) == 1) & (F.upper(only) == F.upper(joined)), only).when(joined.rlike(r"^[A-Za-z][A-Za-z0-9_.:\[\]]+$") & (F.length(joined) >= 3), joined).otherwise("")


def confusions(symbol: Column) -> Column:
    """Readings of a symbol whose O and 0, or I, l and 1, may have been confused."""
    swapped = [F.replace(symbol, F.lit("O"), F.lit("0")), F.replace(symbol, F.lit("0"), F.lit("O")), F.translate(symbol, "Il", "11"), F.replace(symbol, F.lit("1"), F.lit("I"))]
    gates = [symbol.rlike("[O0]")] * 2 + [symbol.rlike("[Il1]")] * 2
    each = F.array(symbol, *(F.when(g, x) for g, x in zip(gates, swapped, strict=True)))
    return F.array_distinct(F.filter(each, lambda x: x.isNotNull() & (x != "")))


def with_ocr(rows: DataFrame, column: str) -> DataFrame:
    """rows with normalized, candidates and token_type of a column of recognized text.

    Step by step: each is a column of its own, so that none is worked out again for every use.
    """
    had = rows.columns
    out = rows.withColumn("__said", nfkc(F.coalesce(F.col(column), F.lit("")))).withColumn("__clean", clean_ocr(F.col("__said")))
    out = out.withColumn("__found", hardware_tokens(F.col("__clean")))
    out = out.withColumn("__one", technical_candidate(F.col("__clean"), F.col("__found")))
    out = out.withColumn("__text", F.when((F.col("__one") != "") & ~F.col("__clean").rlike(r"\s"), F.col("__one")).otherwise(F.col("__clean")))
    own = F.when(F.col("__one") != "", confusions(F.col("__one"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("__read", F.concat(own, F.flatten(F.transform("__found", lambda x: confusions(x["token"])))))
    out = out.withColumns({"__tokens": hardware_tokens(F.col("__text")), "__values": value_tokens(F.col("__text")), "__again": clean_ocr(F.col("__text"))})
    out = out.withColumn("__found2", hardware_tokens(F.col("__again"))).withColumn("__two", technical_candidate(F.col("__again"), F.col("__found2")))
    out = out.withColumn("__kind2", token_type(F.col("__two"), F.concat_ws(" ", "__text", F.coalesce(F.col(column), F.lit("")))))
    plain = lambda t: F.when(t == "counter", "register").otherwise(t)
    holds = lambda *kinds: F.exists("__tokens", lambda x: x["token_type"].isin(*kinds))
    values = F.array_join("__values", " ")
    kind = (
        F.when(F.size("__tokens") == 1, plain(F.get("__tokens", F.lit(0))["token_type"]))
        .when((values != "") & (values == F.trim("__text")), "value")
        .when(holds("bitfield"), "bitfield")
        .when(holds("register", "counter"), "register")
        .when(holds("signal"), "signal")
        .when(F.col("__two") != "", plain(F.col("__kind2")))
        .when(F.col("__text") != "", "normal_text")
        .otherwise("unknown")
    )
    return out.select(*had, compact(F.col("__text"), 500).alias("normalized"), F.slice(distinct_by_case(F.col("__read")), 1, 8).alias("candidates"), kind.alias("token_type"))


# --- driver hints -------------------------------------------------------------------------------


def profile_name(text: Column) -> Column:
    """A name as lower-case letters, digits, dashes and underscores; generic where nothing is left."""
    flat = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9_-]+", "-")
    flat = F.regexp_replace(F.regexp_replace(flat, "-+", "-"), "^-+|-+$", "")
    return F.when(flat == "", "generic").otherwise(flat)


def _hint(text: Column, rules) -> Column:
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = profile_name(raw)
    for label, parts in reversed(rules):
        found = F.lit(False)
        for part in parts.split():
            found = found | (raw == part[1:] if part[0] == "=" else raw.contains(part.replace("_", " ")))
        out = F.when(found, label).otherwise(out)
    return F.when(raw == "", "").otherwise(out)


def subsystem_hint(text: Column) -> Column:
    return _hint(text, SUBSYSTEMS)


def family_hint(text: Column) -> Column:
    return _hint(text, FAMILIES)


# --- sequences and cautions ---------------------------------------------------------------------


def sequence_topic(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[_\-]+", " "), r"\s+", " "))


def is_boilerplate(text: Column) -> Column:
    raw = F.trim(F.coalesce(text, F.lit("")))
    return (raw == "") | _any(raw, BOILERPLATE)


def is_trusted_topic(text: Column) -> Column:
    """Whether a heading may stand for a sequence of operations."""
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\d+(?:\.\d+)*\s+", ""))
    names_register = has(raw, TOPIC_REGISTER) & ~has(raw, TOPIC_STEPS)
    sentence = raw.rlike("[.!?]") & (F.size(F.split(raw, r"\s+")) > TOPIC_SENTENCE)
    return (raw != "") & (F.length(raw) <= TOPIC_CHARS) & ~is_boilerplate(raw) & has(raw, TOPIC_WORDS) & ~names_register & ~sentence


def _id(filename: Column, part: str, name: Column) -> Column:
    return F.concat(filename, F.lit(f":{part}:"), F.when(name == "", "unknown").otherwise(name))


def sequence_id(filename: Column, topic: Column) -> Column:
    return _id(filename, "seq", slug(topic))


def caution_id(filename: Column, topic: Column, kind: Column) -> Column:
    return _id(filename, "caution", slug(F.concat_ws(" ", kind, topic)))


def sequence_confidence(score: Column, status: Column) -> Column:
    return F.when((score >= HIGH_SCORE) & (status == "complete"), "high").when(score >= MEDIUM_SCORE, "medium").otherwise("low")


def risk_of(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, text) for k, text in RISKS.items()), F.lit(OTHER_RISK))


def limit_output(text: Column, most: int = 30_000) -> Column:
    """An answer of at most `most` characters, with a note where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[Output truncated. Original length: "), F.length(text), F.lit(" characters.]"))).otherwise(text)


def display_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def search_text(text: Column, *lists: Column) -> Column:
    """What a passage is searched by: its text, and its lists of names, a line each."""
    return F.concat_ws("\n", text, *(F.array_join(x, "\n") for x in lists))


