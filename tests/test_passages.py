"""Expectations that stand by themselves: kinds of passages, queries, resolver, layouts, recognized text, diagrams."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import tokens
from folioscope.operators import bitfields, diagrams, passages, registers, tables


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_detection_and_kind(spark):
    text = "5.4.2 List of Registers\nRegister Name Abbreviation Offset Address Initial Value Access Size\nControl WDTm_WDTCR 0000h\nEN[3:0] bit description"
    r = _one(passages.detected(spark.createDataFrame([(text,)], "text string")).withColumn("k", passages.kind()))
    assert r.headings[0] == "5.4.2 List of Registers" and r.registers[0] == "WDTm_WDTCR" and r.bit_fields[0] == "EN[3:0]" and "WDTM_WDTCR" in r.symbols
    assert r.k.chunk_type == "register_table" and {"bitfield_table", "register_description"} <= set(r.k.types) and r.k.noise == 0 and r.k.content == 100
    contents = "Contents\n" + "\n".join(f"{i}. Part {i} ..... {i}" for i in range(12))
    assert _one(passages.detected(spark.createDataFrame([(contents,)], "text string")).select(passages.kind().alias("k"))).k.chunk_type == "toc_index"
    assert _one(passages.detected(spark.createDataFrame([("short",)], "text string")).select(passages.kind().alias("k"))).k.types == ["noise"]
    empty = _one(passages.detected(spark.createDataFrame([(None,)], "text string")).select("*", passages.kind().alias("k")))
    assert empty.headings == [] and empty.k.types == ["noise"]


def test_query_terms():
    q = passages.HybridQuery("clear the IRQ status")
    assert q.terms == ["clear", "irq", "status"] and q.symbols == ["CLEAR", "THE", "IRQ", "STATUS"] and {"sequence", "clear", "irq"} <= set(q.intents)
    assert "INT" in q.aliases and "interrupt" in q.expanded and q.weight("clear") == 2.4 and q.weight("w1c") == 1.15 and q.weight("nothing") == 0.9
    assert passages.HybridQuery("zebra").intents == ["generic"] and passages.HybridQuery("zebra", "table").intents == ["table"]


def test_ranking_prefers_what_was_asked_for(spark):
    rows = [("m", 1, 0, "The transfer clock is stopped before the reset procedure. " * 3), ("m", 2, 0, "WDTm_WDTRR refresh register. Write 00h and then FFh to WDTm_WDTRR in order to refresh."), ("m", 3, 0, "Contents ..... 3\nIndex ..... 9")]
    df = spark.createDataFrame(rows, "filename string, page int, chunk_index int, text string")
    got = passages.hybrid_rank(df, passages.HybridQuery("WDTm_WDTRR refresh", register="WDTm_WDTRR"), ["filename", "page", "chunk_index"], 3).collect()
    assert [r.page for r in got][0] == 2 and got[0].score > got[1].score + 300
    assert passages.hybrid_rank(df.limit(0), passages.HybridQuery("x"), ["page"], 3).collect() == []


PAGE = [("DMACm_base", 843), ("DMACm_DCTRL", 843), ("RSPIm_SPCKD", 2616), ("ADCm_ADSTRGR", 3467), ("RSPIm_SPCR", 2630), ("RSPIm_SPCR2", 2630)]


@pytest.mark.parametrize(
    ("source", "page", "evidence", "register", "status"),
    [
        ("DMACM_BASE", 843, "", "DMACm_DCTRL", "resolved"),
        ("RSPIM_BASE", 2616, "", "RSPIm_SPCKD", "resolved"),
        ("ADCM_BASE", 3467, "", "ADCm_ADSTRGR", "resolved"),
        ("RSPIM_BASE", 2630, "", "RSPIM_BASE", "unresolved"),
        ("RSPIM_BASE", 2630, "bits of RSPIm_SPCR2 register", "RSPIm_SPCR2", "resolved"),
        ("WDTm_WDTCR", 1, "", "WDTm_WDTCR", "direct"),
        ("GLOBAL", 99, "", "GLOBAL", "unresolved"),
    ],
)
def test_resolver(spark, source, page, evidence, register, status):
    known = spark.createDataFrame([("m", p, n, 1) for n, p in PAGE], "filename string, page int, name string, explicit int")
    asked = spark.createDataFrame([("m", page, 1, source, "", evidence)], "filename string, page int, id int, source string, heading string, evidence string")
    r = _one(registers.resolve(asked, known, ["id"]))
    assert (r.register, r.status) == (register, status)


def test_conflicts(spark):
    rows = [("m", "R", "EN", "7:4", "3:0", "R/W", "0"), ("m", "R", "EN", "6:4", "unknown", "R/W", "1"), ("m", "R", "OK", "1:1", "unknown", "R", "0")]
    df = spark.createDataFrame(rows, "filename string, register string, bitfield string, position string, field_range string, access string, reset string")
    assert {(r.bitfield, r.field, r["values"]) for r in bitfields.conflicts(df).collect()} == {("EN", "position", "6:4,7:4"), ("EN", "reset", "0,1")}


def _table(page, shift=0.0, kind="bitfield-table", roles=("bit", "bitfield", "access", "reset", "description")):
    return ("m", page, kind, [100.0 * i + shift for i in range(5)], list(roles), "Bit Bit Name Access Initial Value Description", 2)


def test_layouts_are_stitched(spark):
    schema = "filename string, page int, kind string, columns array<double>, roles array<string>, header string, rows int"
    got = lambda *t: [(r.page_start, r.page_end, r.rows) for r in tables.stitch_layouts(spark.createDataFrame(list(t), schema)).orderBy("page_start").collect()]
    assert got(_table(10), _table(11)) == [(10, 11, 3)]
    assert got(_table(10), _table(11, 60.0)) == [(10, 10, 2), (11, 11, 2)]
    assert got(_table(10), _table(12)) == [(10, 10, 2), (12, 12, 2)]
    assert got(_table(10), _table(11), _table(12)) == [(10, 11, 3), (12, 12, 2)]
    assert got(*(_table(p, kind="pinmux-table") for p in range(1, 6))) == [(1, 4, 5), (5, 5, 2)]
    assert got(_table(10), _table(11, roles=("pin", "function"))) == [(10, 10, 2), (11, 11, 2)]


def test_table_pages_and_quality(spark):
    pages = [("m", 1, "Overview"), ("m", 2, "Register Name Offset Address Initial Value Access Size"), ("m", 3, "continuation"), ("m", 4, "plain text")]
    assert sorted(r.page for r in tables.candidate_pages(spark.createDataFrame(pages, "filename string, page int, text string")).collect()) == [1, 2, 3]
    rows = [("register-table", ["a", "b"], ["register"], "", 80, True), ("register-table", ["a"], ["register"], "", 80, False), ("bitfield-table", ["a ..... 3", "b"], ["bit"], "", 80, False), ("pinmux-table", ["a", "b"], ["pin"], "", 90, False), ("table", ["a", "b"], ["x", "y"], "", 70, True)]
    df = spark.createDataFrame(rows, "kind string, rows array<string>, roles array<string>, header string, confidence int, want boolean")
    assert all(r.ok == r.want for r in df.select("want", tables.has_quality(*(F.col(c) for c in ("kind", "rows", "roles", "header", "confidence"))).alias("ok")).collect())


def test_recognized_text(spark):
    said = ["GTCC RA", "GT _ CNT", "0x1F", "plain words here", "", "\uff27\uff34\uff23\uff2e\uff34"]
    got = [(r.normalized, r.token_type) for r in tokens.with_ocr(spark.createDataFrame(list(enumerate(said)), "i int, said string"), "said").orderBy("i").collect()]
    assert got[1] == ("GT_CNT", "register") and got[2][1] == "value" and got[3] == ("plain words here", "unknown") or got[3][1] in ("normal_text", "unknown")
    assert got[4] == ("", "unknown") and got[5] == ("GTCNT", "register")


def test_hints(spark):
    rows = [("PWM/Timer", "pwm"), ("stmmac netdev", "ethernet"), ("wdt", "watchdog"), ("", ""), ("My Thing", "my-thing")]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "x string, want string").select("want", tokens.subsystem_hint(F.col("x")).alias("got")).collect())


def test_diagrams(spark):
    text = ["IDLE -> RUN; RUN -> STOP state", "from idle to error state when timeout", "Step 2: Read GTCNT after reset", "1. Write 1 to GTCR when the counter stops", "DMA controller drives SRAM", "CPU core is connected to AXI bus"]
    lines = spark.createDataFrame([("m", 1, i + 1, t) for i, t in enumerate(text)], "filename string, page int, pos int, line string")
    assert {(r.source, r.target) for r in diagrams.transitions(lines).collect()} >= {("IDLE", "RUN"), ("RUN", "STOP state"), ("idle", "error state")}
    steps = diagrams.numbered_steps(lines).orderBy("step").collect()
    assert [(r.step, r.actor, r.ordered_before) for r in steps] == [(1, "GTCR", 2), (2, "", None)] or [r.step for r in steps] == [1, 2]
    assert {(r.source, r.target, r.label, r.kind) for r in diagrams.block_edges(lines).collect()} >= {("DMA controller", "SRAM", "drives", "unknown"), ("CPU core", "AXI bus", "connects_to", "unknown")}
    assert {"AXI", "SRAM"} <= {r.block for r in diagrams.blocks(lines).collect()}
    kinds = diagrams.figure_types(spark.createDataFrame([("m", 1, 1, "state machine of reset", None), ("m", 2, 1, "nothing", None), ("m", 3, 1, "wave form", "timing")], "filename string, page int, pos int, line string, kind string"), ["page"])
    assert {r.page: r.figure_type for r in kinds.collect()} == {1: "state_machine", 2: "unknown", 3: "timing_diagram"}
