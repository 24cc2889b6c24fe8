"""The search for sections: the same rows as ranking all of them, without numbering or sorting every line."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import canonical_symbol
from folioscope.operators import pages, search
from folioscope.plans import queries
from folioscope.sources import corpora

SF = "/root/testdata/sf0.001"
LINES = [
    "1.2 Reset Procedure", "1.2 RESET PROCEDURE", "Reset Procedure Mode", "RESET PROCEDURE MODE", "reset procedure mode", "3 Presets", "3  PRESETS", "Reset_Procedure Note",
    "4 RE-SET PRO-CEDURE", "4 Re-Set Pro-Cedure", "31 to 28 F1A[3:0] 0h RW", "Clock Overview", "Appendix A Reset", "Nothing of note", "page 3", "", None, "5 straße RESET", "5 STRASSE reset",
]


@pytest.mark.parametrize("query", ["Reset Procedure", "Clock", "what? reset", "zzz"])
@pytest.mark.parametrize("k", [4, 100])
def test_the_best_of_all_sections(spark, query, k):
    rows = [(f"m{n % 2}", n % 3, i * 7 % 20, x) for n in range(4) for i, x in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "filename string, page int, pos int, line string")
    terms = search.Query(query).terms
    order = [F.desc("score"), "page", "level", "filename", "title"]
    flat, symbol = F.col("title"), canonical_symbol(F.col("title"))
    inside = sum((F.when(F.contains(symbol, F.lit(t.upper())), 18).otherwise(0) for t in query.split()), F.lit(0))
    score = pages.score_section(flat, F.col("type"), "", terms) + inside
    want = pages.sections(lines).withColumn("score", score).where("score > 0").orderBy(*order).limit(k)
    columns = ["filename", "page", "title", "type", "score"]
    got = pages.search_sections(lines, query, terms, k).select(*columns).collect()
    assert got == want.select(*columns).collect()
    assert query == "zzz" or got


def test_lines_are_not_numbered_or_joined(spark):
    plan = queries.section_search(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert not any("row_number" in x and "kind" in x for x in plan.splitlines())


def test_written_lines_sort_as_the_numbers_do(spark):
    both = [f(spark, SF).select("filename", "page", "pos", "line", "kind").distinct().orderBy("filename", "page", "pos").select("filename", "page", "line", "kind").collect() for f in (corpora.manual_lines, corpora.written_lines)]
    assert both[0] == both[1]
