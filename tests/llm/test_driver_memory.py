"""Memory that the driver's processes keep."""

import re
from pathlib import Path

from folioscope.llm import common


def _held(pid: str) -> int:
    """MB of the process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) >> 10


def test_cut_gives_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getName().partition("@")[0]
    df = spark.range(10)
    common.cut(df, "warm")
    took = [jvm.java.util.zip.Deflater() for _ in range(800)]  # native memory that the C library keeps when they end
    for x in took[:-1]:
        x.end()
    before = _held(pid)
    assert sorted(r.id for r in common.cut(df, "after").collect()) == list(range(10))
    assert _held(pid) < before - 40
    took[-1].end()
