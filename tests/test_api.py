"""Every question answers over a small library."""

import pytest

from folioscope import api

PAGE = """5.4.2 Transfer Operation of WDT
Next0 Source Address Register n  PRTm_R1_n  0000_0000h  0000h + k x 0040h  32
31 to 28 LWCA[3:0] 0h RW Link of PRTm_R1_n
Caution: do not write 1 to reserved bits of PRTm_R1_n
1. Write 1 to the enable bit of PRTm_R1_n
2. Wait 10 cycles
Figure 2.1 Timing of Read Cycle
IDLE -> DMA controller: irq request
P1_2 CANFD0_TX as input"""


@pytest.fixture(scope="module")
def library(spark):
    rows = spark.createDataFrame([("a", 1, PAGE), ("b", 1, "nothing here"), ("b", 2, None)], "filename string, page int, text string")
    words = spark.createDataFrame([("a", 1, 10.0 * i, 10.0 * i + 2, 20.0 + r, "w") for i in (1, 5, 9) for r in (0, 12)], "filename string, page int, x0 double, x1 double, y0 double, word string")
    return api.Library(rows, words)


ASKED = {
    "search_pdf": {"query": "transfer operation"},
    "hybrid_search_pdf": {"query": "transfer operation"},
    "read_pdf_pages": {"start_page": 1, "end_page": 9},
    "read_pdf_chunk": {"page": 1, "chunk_index": 0},
    "find_section": {"section": "transfer operation"},
    "find_register": {"register": "R1_n"},
    "summarize_register": {"register": "PRTm_R1_n"},
    "find_bitfield": {"bitfield": "lwca"},
    "get_sequence": {"topic": "enable bit"},
    "get_cautions_for_register": {"register": "PRTm_R1_n"},
    "extract_tables_from_pages": {"start_page": 1, "end_page": 2},
    "search_figures": {"query": "read cycle"},
    "parse_diagram": {"kind": "block_diagram"},
    "find_sequence": {"topic": "transfer operation"},
    "find_caution": {"topic": "reserved bits"},
    "extract_bitfield_table": {"register": "PRTm_R1_n"},
    "get_figure_context_pack": {"figure_id": "p1_f001"},
    "verify_register_usage": {"register": "PRTm_R1_n", "operation": "write 1 to start"},
    "compare_driver_requirements": {"requirements": ["handle reset line"], "evidence": ["the reset line is handled"]},
}


@pytest.mark.parametrize("name", sorted(api.tools()))
def test_tool(library, name):
    assert api.call(library, name, filename="a", **ASKED.get(name, {})).count() > 0


def test_arguments(library):
    for name, args in (("nothing", {}), ("search_pdf", {}), ("search_pdf", {"query": "x", "other": 1})):
        with pytest.raises(ValueError):
            api.call(library, name, **args)
    assert api.call(library, "list_pdfs").count() == 2
