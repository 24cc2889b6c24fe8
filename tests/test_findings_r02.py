"""Cases of the second round's findings."""

from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import rx
from folioscope.operators import pages, passages, registers, search
from folioscope.plans import queries


def test_lines_keep_their_digits(spark):
    text = "10 starts with one\n  ends with 1  \nends with 42\n 3 \n"
    rows = spark.createDataFrame([("m", 1, text)], "filename string, page int, text string")
    lines = pages.lines_of(rows)
    assert [(r.pos, r.line) for r in lines.orderBy("pos").collect()] == [(1, "10 starts with one"), (2, "ends with 1"), (3, "ends with 42"), (4, "3")]
    got = search.evidence(lines, "ends", ["filename", "page"]).orderBy("rank").collect()
    assert [(r.pos, r.context) for r in got] == [(2, "10 starts with one / ends with 1 / ends with 42"), (3, "ends with 1 / ends with 42 / 3")]


def test_kinds_see_whole_lines(spark):
    # Half of the lines refer to a page, whose number is the line's own index.
    text = "\n".join(f"entry {chr(97 + i)} .... {i}" if i < 4 else f"some words stand here, line {chr(97 + i)}" for i in range(8))
    rows = spark.createDataFrame([("m", 1, text)], "filename string, page int, text string")
    got = passages.detected(rows).select(passages.kind()["types"].alias("types")).first()
    assert "toc_index" in got.types


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_typed_once(spark):
    lines = spark.createDataFrame([("m", 1, 1, "1.2 Reset Procedure of Channel 3")], "filename string, page int, pos int, line string")
    found = pages.sections(lines)
    assert [(r.title, r.type, r.level) for r in found.collect()] == [("1.2 Reset Procedure of Channel 3", "numbered", 2)]
    pattern = next(p for kind, _, _, p in rules.SECTION_TYPES if kind == "numbered")
    assert _plan(found.select("type", "level", "confidence")).count(rx(pattern)) == _plan(lines.select(pages.section_type(F.col("line")))).count(rx(pattern))


def test_passages_are_checked_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    rows = spark.createDataFrame([("m", 1, "List of registers\nRegister Name Offset Address")], "filename string, page int, text string")
    found = queries.typed(rows)
    assert [tuple(r) for r in found.select("chunk_type", "noise").collect()] == [("register_table", 0)]
    assert _plan(found).count("document revision|revision record") == 1


def test_names_are_spelt_out_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    asked = spark.createDataFrame([("m", 1, 1, "PRTM_BASE", "", "Flag of PRTm_R7_n"), ("m", 1, 2, "PRTm_R8_n", "", "")], "filename string, page int, pos int, source string, heading string, evidence string")
    known = spark.createDataFrame([("m", 1, "PRTm_R7_n", 1), ("m", 1, "PRTm_R70_n", 1)], "filename string, page int, name string, explicit int")
    found = registers.resolve(asked, known, ["filename", "page", "pos"])
    assert sorted((r.pos, r.register, r.status) for r in found.collect()) == [(1, "PRTm_R7_n", "resolved"), (2, "PRTm_R8_n", "direct")]
    plan = _plan(found)
    assert 0 < plan.count("(GBETH|ETH|GMAC") <= _plan(known.select(registers.aliases(F.col("name")))).count("(GBETH|ETH|GMAC")
