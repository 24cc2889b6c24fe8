"""Rule tables, and the Column expressions that apply them.

A rule is (label, pattern); `\\b` is an ASCII word boundary. Multi-label rules give all labels whose
pattern is found, first-match rules the first one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import has

Rule = tuple[str, str]

# --- fixed values: sections ---------------------------------------------------------------------
SECTION_NOISE = r"(?i)^([-–—_\s]+|Page\s+\d+.*|R\d{2}[A-Z0-9]+.*|(Rev\.|Revision|Preliminary|Confidential|Copyright)\b.*|\d+)$"
#: (type, level or -1 for the number's depth, confidence, pattern)
SECTION_TYPES: list[tuple[str, int, int, str]] = [
    ("numbered", -1, 95, r"^\d+(\.\d+){0,8}\s+\S.+$"),
    ("appendix", 1, 90, r"(?i)^Appendix\s+[A-Z0-9]+([.\-]\d+)*\s+.{2,}$"),
    ("table", 99, 80, r"(?i)^Table\s+\d[\d.\-]*\s+.{2,}$"),
    ("figure", 99, 80, r"(?i)^Figure\s+\d[\d.\-]*\s+.{2,}$"),
    ("register_topic", 50, 78, r"\b[A-Z][A-Z0-9_]{2,}\b.*\b(Register|Registers)\b"),
    ("topic", 50, 65, r"^[A-Z0-9][A-Za-z0-9_ /,()\-:+]*\b(Overview|Registers?|Bit Field|Operation|Operating|Procedure|Settings?|Interrupts?|Clock|Reset|Initialization|Configuration|Caution|Note|Restriction|Pin|DMA|Transfer|Mode)\b[A-Za-z0-9_ /,()\-:+]*$"),
    ("caps", 60, 55, r"^[A-Z0-9][A-Z0-9_ /,()\-:+]*[A-Z]{4}[A-Z0-9_ /,()\-:+]*$"),
]
SECTION_WORDS = r"(?i)\b(Register|Description|Operation|Interrupt|Clock|Reset|Caution|Note|Restriction)\b"

# --- fixed values: registers --------------------------------------------------------------------
REGISTER_ROW = r"^(.+?)\s+([A-Z][A-Za-z0-9]*m_[A-Za-z0-9_]+)\s+([0-9A-Fa-f_]+h|-)\s+(.+?)\s+(\d+|-)\s*$"
REGISTER_NAME = r"(R\d*$|(CR|SR|DR|MR|ER|FR|RR|TR|BR|AR|LR|PR|CSR|ISR|IER|ICR|CTRL|STAT)$|^[A-Z0-9]+M_[A-Z0-9_]+$|^(WDT|GT|GPT|POEG|MAC|MTL|DMA|DMAC|GMAC|ETH|GBETH|ICU|I3C|I2C|SPI|UART|CAN|ADC)[A-Z0-9_]*$)"
NOT_REGISTERS = "NOTE NOTES TABLE FIGURE SECTION CHAPTER PAGE PAGES REGISTER REGISTERS ADDRESS OFFSET DESCRIPTION INITIALVALUE ACCESS ACCESSSIZE BIT BITS BITNAME READ WRITE RESET RESERVED UNDEFINED CAUTION CAUTIONS PROHIBITED FUNCTION OPERATION".split()
REGISTER_SYMBOL = r"\b[A-Z][A-Za-z0-9]*m_[A-Za-z0-9_]+\b"
ALIAS_PREFIXES = ["GBETHm_", "ETH_", "GMAC_", "WDT_", "GPT_", "POEG_", "ICU_"]

# --- fixed values: bit fields -------------------------------------------------------------------
ACCESS = {"RW": "R/W", "R/W": "R/W", "R": "R", "W": "W", "RO": "R/O", "R/O": "R/O", "WO": "W/O", "W/O": "W/O", "W1C": "W1C", "W0C": "W0C", "R/W1C": "R/W1C", "READONLY": "R/O", "WRITEONLY": "W/O", "READ/WRITE": "R/W"}
ACCESS_WORD = r"(?i)\b(R\s*/\s*W1C|R\s*/\s*W|R\s*/\s*O|W\s*/\s*O|W1C|W0C|RW|RO|WO|R|W|Read only|Write only|Read/Write)\b"

# --- fixed values: cautions ---------------------------------------------------------------------
CAUTION_LABELS: list[Rule] = [
    ("caution", r"\b(Caution|CAUTION)\b"),
    ("note", r"\b(Note|Notes|NOTE|NOTES)\b"),
    ("restriction", r"(?i)\b(Restriction|Restrictions|restricted)\b"),
    ("prohibited/forbidden", r"(?i)\b(prohibit|prohibited|do\s+not|must\s+not|cannot|can't)\b"),
    ("undefined/invalid", r"(?i)\b(undefined|invalid|indeterminate|unpredictable)\b"),
    ("reserved-bit handling", r"(?i)\breserved\b"),
    ("reset/read-write constraint", r"(?i)\b(initial value|reset value|read as|write as|must be written)\b"),
]
#: Labels that need several patterns.
CAUTION_PAIRS: list[tuple[str, tuple[str, ...]]] = [
    ("clear semantics", (r"(?i)\b(write|written|writing)\b", r"(?i)\b(clear|cleared)\b")),
    ("write value semantics", (r"(?i)\b(write|written|writing)\b", r"(?i)\b(0|zero|1|one)\b", r"(?i)\b(clear|cleared|set|reserved)\b")),
    ("operation-order condition", (r"(?i)\b(only|when|while|before|after|until)\b", r"(?i)\b(stop|stopped|start|running|operation|operating|enable|disable|setting|set|write)\b")),
]
CAUTION_TYPES: list[tuple[str, tuple[str, ...]]] = [
    ("reserved-bit", (r"(?i)reserved",)),
    ("clear-semantics-write-1", (r"(?i)write\s*1|write one|cleared?\s+by\s+writing\s+1|w1c",)),
    ("clear-semantics-write-0", (r"(?i)write\s*0|write zero|cleared?\s+by\s+writing\s+0|w0c",)),
    ("write-timing", (r"(?i)while|when|stopp?ed|running|operation|before|after|only", r"(?i)write|set|clear|enable|disable")),
    ("undefined-invalid", (r"(?i)undefined|invalid",)),
    ("prohibited", (r"(?i)prohibit|forbidden|do\s+not|must\s+not|cannot",)),
    ("reset-access", (r"(?i)reset|initial|read|write",)),
    ("restriction", (r"(?i)restriction",)),
    ("caution", (r"(?i)caution",)),
    ("note", (r"(?i)note",)),
]

# --- fixed values: sequences --------------------------------------------------------------------
SEQUENCE_KINDS: list[Rule] = [
    ("init", r"(?i)\b(init|initial|initialize|initialization|setup|setting|configure|configuration)\b"),
    ("start", r"(?i)\b(start|enable|run|trigger|request|kick|resume|seten|tstart|transfer start)\b"),
    ("stop", r"(?i)\b(stop|disable|halt|suspend|pause|cancel|clear enable|clren|clrrq)\b"),
    ("clear", r"(?i)\b(clear|ack|acknowledge|status|flag|interrupt|w1c|write 1|write one|end|tc|er)\b"),
    ("reset", r"(?i)\b(reset|software reset|swrst|module reset|rst)\b"),
    ("interrupt", r"(?i)\b(interrupt|irq|request|event|status)\b"),
    ("clock-reset", r"(?i)\b(clock|reset release|module standby|mstp|pclk)\b"),
]
STEP_OPERATIONS: list[Rule] = [
    ("write", r"(?i)\b(write|writes|written|program)\b"),
    ("read", r"(?i)\b(read|reads)\b"),
    ("poll", r"(?i)\b(poll|wait until|until .*(becomes|is set|is cleared))\b"),
    ("wait", r"(?i)\b(wait|delay|cycle|microsecond|millisecond|ns|us|ms)\b"),
    ("clear", r"(?i)\b(clear|cleared)\b"),
    ("set", r"(?i)\b(set|assert)\b"),
    ("enable", r"(?i)\b(enable|start|trigger|request)\b"),
    ("disable", r"(?i)\b(disable|stop|suspend|deassert)\b"),
]
WRITE_PAIR = r"(?i)writing\s+(0x[0-9a-f]+|[0-9a-f]+h|[01]+b|\d+)\s+and\s+then\s+writing\s+(0x[0-9a-f]+|[0-9a-f]+h|[01]+b|\d+)\s+to\s+([A-Z][A-Z0-9_]*)"

# --- fixed values: figures ----------------------------------------------------------------------
CAPTION = r"(?i)^(Figure|Fig\.?|Table)\s+([A-Za-z]?\d+([.\-]\d+)*[A-Za-z]?)\s*[:.\-]?\s*(.{0,220})$"
FIGURE_KINDS: list[Rule] = [
    ("clock-tree", r"clock\s*tree|clock\s*distribution|clock\s*generation|pll|oscillator"),
    ("timing-diagram", r"timing|waveform|read\s*cycle|write\s*cycle|setup\s*time|hold\s*time"),
    ("block-diagram", r"block\s*diagram|module\s*configuration|configuration\s*diagram|overview\s*diagram"),
    ("flow-sequence", r"flow|sequence|procedure"),
    ("pinmux", r"pin\s*function|pinmux|pin\s*mux|multiplexed\s*pin|pfc|ioport|port\s*function"),
    ("register-table", r"register|bit\s*field|offset|access\s*size|initial\s*value"),
    ("interrupt", r"interrupt|irq|vector|routing|event\s*link|intc"),
    ("reset-power", r"reset|standby|power\s*state|low\s*power"),
]
VISUAL_TABLES: list[Rule] = [
    ("timing-visual-table", r"(?i)\b(timing|waveform|read\s+cycle|write\s+cycle)\b"),
    ("sequence-visual-table", r"(?i)\b(sequence|flow|operation\s+sequence|state\s+transition)\b"),
    ("bit-layout", r"(?i)\b(bit\s+(assignment|layout|allocation)|bit\s+map)\b"),
    ("format-diagram", r"(?i)\b(data|frame|transfer|packet|protocol|word|sample|slot|bus)\s+format\b"),
    ("layout-table", r"(?i)\b(layout|arrangement|alignment)\b"),
]

# --- fixed values: tables -----------------------------------------------------------------------
TABLE_KINDS: list[Rule] = [
    ("register", r"(?i)\b(abbreviation|offset\s+address|register\s+name|access\s+size)\b"),
    ("pinmux", r"(?i)\b(pin\s*function|pinmux|multiplexed|port)\b"),
    ("bitfield", r"(?i)\b(bit\s+name|bit|R/W)\b"),
    ("caution", r"(?i)\b(caution|note|restriction)\b"),
]

# --- fixed values: query intents, artifact graph ------------------------------------------------
INTENTS: list[Rule] = [
    ("register", r"(?i)\b(register|offset|address|access size)\b"),
    ("bitfield", r"(?i)\b(bit|bits|field|mask)\b"),
    ("sequence", r"(?i)\b(sequence|procedure|order|step|flow)\b"),
    ("caution", r"(?i)\b(caution|restriction|note|prohibited|reserved)\b"),
    ("irq", r"(?i)\b(irq|interrupt|isr)\b"),
    ("reset", r"(?i)\b(reset|rst)\b"),
    ("section", r"(?i)\b(section|chapter|overview)\b"),
    ("table", r"(?i)\b(table|list)\b"),
]
ARTIFACT_NEEDS: dict[str, tuple[str, ...]] = {
    "pages": (),
    "chunk-index": ("pages",),
    "sections": ("pages",),
    "tables": ("pages", "chunk-index", "sections"),
    "registers": ("chunk-index", "sections", "tables"),
    "bitfields": ("registers", "tables"),
    "sequences": ("chunk-index", "sections", "tables", "registers", "bitfields", "cautions"),
    "cautions": ("chunk-index", "sections", "registers"),
    "figures": ("pages",),
    "figure_ocr": ("figures",),
    "visual-evidence": ("figures",),
    "module-profile": ("registers", "sections"),
    "driver-pack": ("registers", "bitfields", "sequences", "cautions"),
    "driver-task-plan": ("registers", "bitfields", "sequences", "cautions"),
}


def labels(text: Column, rules: list[Rule]) -> Column:
    """All labels whose pattern is found, in the rules' order."""
    return F.array_compact(F.array(*(F.when(has(text, p), F.lit(label)) for label, p in rules)))


def first_label(text: Column, rules: list[Rule], other: str) -> Column:
    """The first label whose pattern is found."""
    return F.coalesce(*(F.when(has(text, p), F.lit(label)) for label, p in rules), F.lit(other))


def all_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = has(text, patterns[0])
    for p in patterns[1:]:
        out = out & has(text, p)
    return out


def first_of_all(text: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first label all of whose patterns are found."""
    return F.coalesce(*(F.when(all_of(text, ps), F.lit(label)) for label, ps in rules), F.lit(other))


def caution_labels(text: Column) -> Column:
    pairs = (F.when(all_of(text, ps), F.lit(label)) for label, ps in CAUTION_PAIRS)
    return F.array_compact(F.concat(F.array(*(F.when(has(text, p), F.lit(label)) for label, p in CAUTION_LABELS)), F.array(*pairs)))


# --- fixed values: modules, register groups, usage ----------------------------------------------
MODULE_TYPES: list[Rule] = [
    ("dmaengine", r"dma|direct memory access"),
    ("watchdog", r"watchdog|wdt"),
    ("pwm/timer", r"pwm|gpt|timer"),
    ("gpio", r"gpio|port|pin"),
    ("i2c", r"i2c|iic"),
    ("spi", r"spi|rsci|serial peripheral"),
    ("uart", r"uart|sci|serial communication"),
    ("ethernet", r"ethernet|geth|gbeth|mac|phy"),
    ("can", r"can"),
    ("usb", r"usb|xhci|ehci|ohci|dwc3"),
    ("pcie", r"pcie|pci express|root complex|host bridge"),
    ("adc", r"adc|analog digital|a d converter"),
    ("rtc", r"rtc|real time clock"),
]
REGISTER_GROUPS: list[Rule] = [
    ("Address registers", r"_N[01]SA|_N[01]DA|_CRSA|_CRDA|SOURCE ADDRESS|DESTINATION ADDRESS"),
    ("Transfer size/count registers", r"_N[01]TB|_CRTB|TRANSFER BYTE|TRANSFER COUNT|COUNT"),
    ("Control registers", r"CHCTRL|CTRL|CONTROL|DCTRL|CR\b|WDTCR|GTCR"),
    ("Configuration registers", r"CHCFG|CFG|CONFIG|MODE|SETTING"),
    ("Status/error registers", r"CHSTAT|STATUS|STAT|_SR\b|DST_|ERROR|END|SUS|TC"),
    ("Interrupt registers", r"INT|IRQ|IEN|IER|ISR|FLAG"),
    ("Reset registers", r"RESET|RST|SWRST"),
    ("Counter/compare/capture registers", r"COMPARE|CAPTURE|COUNTER|COUNT|PERIOD|GTCC|GTCNT"),
    ("Data/FIFO registers", r"DATA|FIFO|BUFFER|TX|RX"),
    ("Per-channel registers", r"_N\b|_N\d|_CH|CHANNEL"),
]
ACCESS_TYPES: list[Rule] = [
    ("read_modify_write", r"read\s*modify\s*write|rmw|update bits|set bits|clear bits"),
    ("write_one_to_clear", r"write 1|write one|w1c"),
    ("write_zero_to_clear", r"write 0|write zero|w0c"),
    ("poll", r"poll|wait"),
    ("read", r"readl|ioread|regmap read|read register"),
    ("raw_write", r"writel|iowrite|regmap write|write register|raw write"),
    ("reset", r"reset|swrst"),
    ("clear_bits", r"clear"),
]
USAGE_INTENTS: list[Rule] = [
    ("init", r"init|setup|configure|configuration|clock"),
    ("start", r"start|enable|run|activate|transmit|receive|seten"),
    ("stop", r"stop|disable|halt|terminate|suspend|abort"),
    ("clear", r"clear|ack|w1c|w0c|write one|write zero|status flag"),
    ("irq", r"irq|interrupt|isr"),
    ("reset", r"reset|swrst"),
    ("error", r"error|fault|abnormal"),
    ("status", r"status|poll|wait|read"),
    ("write", r"write"),
]
BLOCK_KINDS: list[Rule] = [
    ("bus", r"\b(axi|ahb|apb|bus|crossbar|interconnect)\b"),
    ("dma", r"\b(dma|dmac)\b"),
    ("interrupt_controller", r"\b(irq|int|interrupt|intc)\b"),
    ("clock", r"\b(clk|clock|pll|oscillator)\b"),
    ("reset", r"\b(rst|reset)\b"),
    ("register", r"\b(register|reg)\b"),
    ("memory", r"\b(fifo|buffer|memory|ram|rom|sram|dram|flash)\b"),
    ("module", r"\b(cpu|cortex|processor|core)\b"),
    ("peripheral", r"\b(peripheral|timer|gpio|usb|can|spi|i2c|ethernet|uart|pwm)\b"),
    ("module", r"\b(module|controller|unit|engine|mux|selector|block)\b"),
]
EDGE_KINDS: list[Rule] = [
    ("bus", r"\b(axi|ahb|apb|bus)\b"),
    ("clock", r"\b(clk|clock)\b"),
    ("reset", r"\b(rst|reset)\b"),
    ("interrupt", r"\b(irq|int|interrupt)\b"),
    ("dma", r"\b(dma|dmac)\b"),
    ("data", r"\b(data|rx|tx)\b"),
    ("control", r"\b(ctrl|control|enable|start|stop)\b"),
    ("signal", r"\b(signal|req|ack)\b"),
]
#: An arrow between two names, and what it is labelled with.
ARROW = r"^\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*->\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*(?::\s*(.*))?$"
SIGNAL_EDGE = r"(?i)\b([A-Z][A-Z0-9_]{1,31})\s+(rises|falls|goes high|goes low|is asserted|is negated)\b"
PIN = r"\b(P\d{1,2}[_-]\d{1,2}|GPIO\d+[_-]\d+|PORT\d+)\b"
PIN_FUNCTION = r"\b([A-Z][A-Z0-9]{2,}_[A-Z][A-Z0-9]*)\b"

# --- fixed values: column roles -----------------------------------------------------------------
#: (role, pattern, points): points add up; a role needs ROLE_LEAST.
ROLE_LEAST = 35
COLUMN_ROLES: list[tuple[str, str, int]] = [
    ("bit", r"(?i)^\s*(bit|bits|b\d+|bit\s*position|bit\s*no\.?|no\.?|position)\s*$", 70),
    ("bit", r"(?i)\b(bit|bits|b\d+|bit\s*position|bit\s*no)\b", 35),
    ("bit", r"^\s*\[?\d{1,2}(:\d{1,2})?\]?\s*$", 42),
    ("bitfield", r"(?i)\b(bit\s*name|field\s*name|bit\s*field|symbol|name|mnemonic|abbreviation)\b", 65),
    ("bitfield", r"(?i)^\s*(name|symbol|field)\s*$", 38),
    ("access", r"(?i)\b(access|r\s*/\s*w|read\s*/\s*write|read|write|r/o|w/o)\b", 70),
    ("access", r"(?i)^\s*(r|w|rw|ro|wo|r/w|r/o|w/o|read only|write only)\s*$", 55),
    ("reset", r"(?i)\b(initial\s*value|reset\s*value|default\s*value|initial|reset|default)\b", 70),
    ("reset", r"(?i)^\s*(0x[0-9a-f]+|[0-9a-f]+h|[01]b|0|1|-|undefined)\s*$", 25),
    ("description", r"(?i)\b(description|function|operation|setting|settings|contents|meaning|remarks|note)\b", 70),
    ("register", r"(?i)\b(register\s*name|register|name)\b", 65),
    ("register", r"^\s*[A-Z][A-Z0-9_]{2,}\s*$", 18),
    ("abbreviation", r"(?i)\b(abbreviation|abbrev\.?|symbol|register\s*symbol|short\s*name)\b", 70),
    ("abbreviation", r"^\s*[A-Z0-9]+m?_[A-Za-z0-9_]+\s*$", 35),
    ("offset", r"(?i)\b(offset\s*address|address\s*offset|offset|address|addr\.?)\b", 70),
    ("offset", r"\b[0-9A-Fa-f]{3,8}h\b", 45),
    ("accessSize", r"(?i)\b(access\s*size|access\s*width|size|width|byte)\b", 60),
    ("accessSize", r"(?i)^\s*(8|16|32|64|128)\s*(bit|bits|byte|bytes)?\s*$", 35),
    ("pin", r"(?i)\b(pin\s*name|pin\s*no\.?|pin\s*number|pin|pad|ball|terminal)\b", 72),
    ("port", r"(?i)\b(port\s*name|port|gpio\s*port|i/o\s*port)\b", 70),
    ("function", r"(?i)\b(pin\s*function|function\s*name|alternate\s*function|alt\s*function|function\s*select)\b", 75),
    ("signal", r"(?i)\b(signal\s*name|signal|multiplexed\s*signal|peripheral\s*signal)\b", 72),
    ("peripheral", r"(?i)\b(peripheral|module|ip\s*block|function\s*group|interface)\b", 68),
    ("mode", r"(?i)\b(mode|mux\s*mode|function\s*mode|pin\s*mode|select\s*code|sel|mux)\b", 66),
    ("group", r"(?i)\b(group|pin\s*group|function\s*group|bank)\b", 60),
]
