"""Scalar functions and rules on cases with known results."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import bits, rules, text
from folioscope.operators import figures, guidance, pages, quality, registers, search, tables
from folioscope.sources import artifacts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "wanted"),
    [
        (bits.normalize_range, "31 to 28", "31:28"),
        (bits.normalize_range, "[31-28]", "31:28"),
        (bits.normalize_range, "7", "7"),
        (bits.normalize_range, "x", "unknown"),
        (bits.normalize_range, None, "unknown"),
        (bits.normalize_access, "r / w", "R/W"),
        (bits.normalize_access, "Read only", "R/O"),
        (bits.normalize_access, "?", "unknown"),
        (bits.normalize_reset, "0000_0000h", "0"),
        (bits.normalize_reset, "1b", "1"),
        (bits.normalize_reset, "-", "unknown"),
        (bits.normalize_reset, "5h", "5h"),
        (bits.access_of, "31 to 28 LWCA[3:0] 0h RW Link Writeback CACHE", "R/W"),
        (text.normalize_for_search, " WDT_RR (x)–Y:z ", "wdt rr x y z"),
        (text.normalize_for_search, None, ""),
        (text.canonical_symbol, "DMACm_N0SA n", "DMACM_N0SAN"),
        (text.canonical_hardware_symbol, "DMACm_N0SA n", "DMACMN0SAN"),
        (text.normalize_text, "a\t b\r\n  c\n\n\n\n\nd ", "a b\n\nc\n\n\nd"),
        (text.slug, "Caution: Write 1!", "caution-write-1"),
        (lambda c: text.nfkc(c), "ﬁ①", "fi1"),
    ],
)
def test_scalar(spark, function, value, wanted):
    assert one(spark, function, value) == wanted


def test_range_struct_and_reset_width(spark):
    r = spark.sql("SELECT '28:31' AS a, 'unknown' AS b").select(bits.parse_range(F.col("a")).alias("a"), bits.parse_range(F.col("b")).alias("b")).first()
    assert (r.a.high, r.a.low, r.a.width, r.b) == (31, 28, 4, None)
    rows = spark.createDataFrame([("0Fh", 4), ("10h", 4), ("101b", 2), ("?", 1)], "v string, w int")
    assert [x[0] for x in rows.select(bits.reset_fits(F.col("v"), F.col("w"))).collect()] == [True, False, False, True]


def test_counts_and_fuzzy(spark):
    r = spark.sql("SELECT 'éa a ba a' AS t").select(text.count_word(F.col("t"), "a"), text.count_loose(F.col("t"), "a")).first()
    assert tuple(r) == (3, 4)  # a word's borders are ASCII ones
    r = spark.sql("SELECT 'offset' AS a, 'ofset' AS b, 'x' AS c").select(text.fuzzy_similarity(F.col("a"), F.col("b")), text.fuzzy_similarity(F.col("c"), F.lit("y")), text.half_up(F.lit(-0.5))).first()
    assert abs(r[0] - (1 - 1 / 6)) < 1e-12 and r[1] == 0.0 and r[2] == 0


def test_rules(spark):
    lines = ["Caution: do not write 1 to reserved bits", "The flag is cleared by writing 0", "Nothing"]
    rows = spark.createDataFrame([("m", 1, i, x) for i, x in enumerate(lines)], "filename string, page int, pos int, line string")
    got = {r.pos: r for r in guidance.caution_lines(rows).collect()}
    assert set(got) == {0, 1}
    assert got[0].type == "reserved-bit" and "prohibited/forbidden" in got[0].labels
    assert got[1].type == "clear-semantics-write-0"
    assert one(spark, lambda c: rules.first_label(c, rules.STEP_OPERATIONS, "other"), "Poll STAT until set") == "poll"


def test_sections(spark):
    cases = {"5.4.2 Transfer Operation": ("numbered", 3), "Appendix A Pins": ("appendix", 1), "Table 3.1 Registers": ("table", 99), "Page 12": None, "plain words here": None, "WATCHDOG TIMER AREA": ("caps", 60)}
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", pages.section_type(F.col("line")).alias("s")).collect()
    assert {r.line: (r.s.type, r.s.level) if r.s else None for r in rows} == cases


def test_register_rows_and_aliases(spark):
    line = "Next0 Source Address Register n  DMACm_N0SA_n  0000_0000h  0000h + k x 0040h  32"
    rows = spark.createDataFrame([("m", 843, 1, line), ("m", 843, 2, "nothing")], "filename string, page int, pos int, line string")
    r = registers.list_rows(rows).collect()
    assert len(r) == 1 and (r[0].name, r[0].offset, r[0].access_size) == ("DMACm_N0SA_n", "0000h + k x 0040h", "32")
    assert "ETH_MACCR" in one(spark, registers.aliases, "GBETHm_MACCR")


def test_write_pair(spark):
    rows = spark.createDataFrame([("m", 1, 1, "Refresh by writing 00h and then writing FFh to WDTRR")], "filename string, page int, pos int, line string")
    assert tuple(guidance.write_pairs(rows).first())[3:] == ("00h", "FFh", "WDTRR")


def test_chunks_overlap_and_lose_nothing(spark):
    long = ". ".join(f"Sentence number {i} of a long page" for i in range(400))
    rows = spark.createDataFrame([("m", 1, long), ("m", 2, ""), ("m", 3, None), ("m", 4, "short")], "filename string, page int, text string")
    got = pages.chunks(rows).orderBy("page", "chunk_index").collect()
    assert {r.page for r in got} == {1, 4} and all(len(r.text) <= pages.CHUNK_CHARS for r in got)
    parts = [r.text for r in got if r.page == 1]
    at = 0
    for p in parts:
        found = long.index(p)
        assert found <= at
        at = found + len(p)
    assert at >= len(long) - 1


def test_evidence_and_empty_tables(spark):
    empty = spark.createDataFrame([], "filename string, page int, text string")
    assert search.hybrid_search(empty, "a clock reset", 5, ["filename", "page"]).collect() == []
    assert pages.chunks(empty).collect() == []
    rows = spark.createDataFrame([("m", 1, "a\nthe clock starts\nb\nreset")], "filename string, page int, text string")
    got = search.evidence(pages.lines_of(rows), "clock", ["filename", "page"]).collect()
    assert [r.context for r in got] == ["a / the clock starts / b"]


def test_captions(spark):
    rows = spark.createDataFrame([("m", 1, 1, "Figure 2.1 Timing of Read Cycle"), ("m", 1, 2, "Table 2.2 Ordinary Values"), ("m", 1, 3, "text")], "filename string, page int, pos int, line string")
    got = {r.number: r for r in figures.manifest(figures.captions(rows)).collect()}
    assert got["2.1"].kind == "timing-diagram" and got["2.2"].kind == "table" and got["2.1"].figure_id == "p1_f001"


def test_tables(spark):
    words = [("m", 1, 10.0, 25.0, 20.0, "Bit"), ("m", 1, 60.0, 90.0, 20.4, "Name"), ("m", 1, 95.0, 99.0, 20.0, "x"), ("m", 1, 10.0, 25.0, 40.0, "7")]
    rows = spark.createDataFrame(words, "filename string, page int, x0 double, x1 double, y0 double, word string")
    got = [(r.row, r.cell, r.text) for r in tables.cells(rows).orderBy("row", "cell").collect()]
    assert got == [(0, 0, "Bit"), (0, 1, "Name x"), (1, 0, "7")]


def test_artifacts(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    df = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b")], "filename string, page int, text string")
    assert artifacts.read_through(spark, path, lambda: df, "size=1;mtimeMs=2").count() == 2
    assert artifacts.read(spark, path, "size=1;mtimeMs=3").count() == 0
    wanted = spark.createDataFrame([("m", p) for p in (1, 2, 3)], "filename string, page int")
    assert [r.page for r in artifacts.missing_pages(wanted, artifacts.read(spark, path)).collect()] == [3]
    assert {r.artifact for r in quality.descendants(spark, ["figures"]).collect()} == {"figure_ocr", "visual-evidence"}


def test_fuzzy_points_look_at_every_token(spark):
    """In any alphabet, and beyond the first 500 distinct tokens."""
    long = " ".join(f"w{i}" for i in range(600)) + " 東京 thatim"
    df = spark.createDataFrame([(long,)], "text string")
    query = search.Query("thatin theren thingon")
    assert tuple(df.select(search.fuzzy_points(F.col("text"), query, 0.8)).first()) == (12,)


def test_fuzzy_query_has_every_page(spark):
    from folioscope.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["search_fuzzy"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
