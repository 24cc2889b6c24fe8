"""Corpora: page text from tables, by expressions that any SQL engine reads alike.

prose_pages is the documents table as pages. manual_lines writes technical-manual lines from the
relational tables (register lists, bit tables, headings, cautions, write orders, captions), so
that every extractor has rows whose truth is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope import share

PROSE = "SELECT source AS filename, CAST(doc_id AS int) AS page, coalesce(text, '') AS text FROM documents"

#: Lines of a kind on a page at most.
KIND_LINES = 1_000_000
MANUAL_TABLES = ("part", "lineitem", "orders", "customer", "supplier", "nation")
#: (kind, table, filename key, page key, line)
_LINES = [
    ("register", "part", "p_partkey", "p_partkey / 40", "concat(p_type, ' Register n PRTm_R', p_partkey, '_n 0000_', lpad(concat(p_size), 4, '0'), 'h ', lpad(concat(p_partkey * 4), 8, '0'), 'h + k x 0040h ', CASE p_partkey % 3 WHEN 0 THEN '8' WHEN 1 THEN '16' ELSE '32' END)"),
    ("bit", "lineitem", "l_partkey", "l_partkey / 40", "concat(l_linenumber * 3 + l_suppkey % 4, ' to ', l_linenumber * 3, ' F', l_linenumber, 'A[', l_suppkey % 4, ':0] ', l_suppkey % 2, 'h ', CASE l_suppkey % 3 WHEN 0 THEN 'RW' WHEN 1 THEN 'RO' ELSE 'W1C' END, ' Flag ', l_returnflag, ' of PRTm_R', l_partkey, '_n')"),
    ("heading", "orders", "o_custkey", "o_orderkey / 40", "concat(o_orderkey % 9 + 1, '.', o_orderkey % 7 + 1, '.', o_custkey % 5 + 1, ' ', CASE o_orderkey % 4 WHEN 0 THEN 'Transfer Operation' WHEN 1 THEN 'Interrupt Setting' WHEN 2 THEN 'Reset Procedure' ELSE 'Clock Overview' END, ' of Channel ', o_custkey % 8)"),
    ("write", "orders", "o_custkey", "o_orderkey / 40", "concat('Refresh by writing ', lpad(concat(o_orderkey % 100), 2, '0'), 'h and then writing FFh to WDT', o_custkey % 50)"),
    ("step", "orders", "o_custkey", "o_orderkey / 40", "concat(o_orderkey % 6 + 1, '. ', CASE o_orderkey % 5 WHEN 0 THEN 'Write 1 to the enable bit' WHEN 1 THEN 'Read the status' WHEN 2 THEN 'Wait 10 cycles' WHEN 3 THEN 'Stop the transfer' ELSE 'Check nothing' END, ' of PRTm_R', o_custkey, '_n')"),
    ("caution", "customer", "c_custkey", "c_custkey / 40", "concat(CASE c_custkey % 6 WHEN 0 THEN 'Caution: do not write 1 to reserved bits of PRTm_R' WHEN 1 THEN 'Note: the flag is cleared by writing 0 to PRTm_R' WHEN 2 THEN 'Write only while the transfer is stopped, PRTm_R' WHEN 3 THEN 'Operation is undefined after reset of PRTm_R' WHEN 4 THEN 'Restriction on PRTm_R' ELSE 'Nothing of note about PRTm_R' END, c_custkey, '_n')"),
    ("arrow", "nation", "n_nationkey", "n_nationkey / 5", "concat(n_name, ' -> ', CASE n_nationkey % 4 WHEN 0 THEN 'DMA controller' WHEN 1 THEN 'IDLE' WHEN 2 THEN 'CPU core' ELSE 'memory bus' END, CASE n_nationkey % 3 WHEN 0 THEN ': irq request' WHEN 1 THEN ': data word' ELSE '' END)"),
    ("signal", "nation", "n_nationkey", "n_nationkey / 5", "concat('After that SIG_', n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN ' rises' ELSE ' is negated' END, ' and ACK_', n_regionkey, ' falls')"),
    ("pin", "supplier", "s_suppkey", "s_suppkey / 10", "concat('P', s_nationkey, '_', s_suppkey % 16, ' CANFD', s_suppkey % 3, '_TX SPI', s_suppkey % 4, '_CLK as input')"),
    ("caption", "supplier", "s_suppkey", "s_suppkey / 10", "concat(CASE s_suppkey % 3 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Table ' ELSE 'Fig. ' END, s_suppkey % 9 + 1, '.', s_suppkey, ' ', CASE s_suppkey % 5 WHEN 0 THEN 'Timing of Read Cycle' WHEN 1 THEN 'Block Diagram of Unit' WHEN 2 THEN 'Operation Sequence' WHEN 3 THEN 'Frame Format' ELSE 'Pin Function List' END)"),
]


def manual_sql() -> str:
    """SQL for rows (filename, page, pos, line, kind); pos orders the lines of a page, those of a kind together.

    Lines are numbered within their kind, so that a filter on the kind reaches the scans.
    """
    return f"SELECT filename, page, CAST(start + row_number() OVER (PARTITION BY filename, page, kind, start ORDER BY line) AS int) AS pos, line, kind FROM ({' UNION ALL '.join(_kinds('DISTINCT '))}) AS l"


def _kinds(distinct: str = "") -> list[str]:
    """SQL for rows (filename, page, line, kind, start) of each kind."""
    rank = {kind: i for i, kind in enumerate(sorted(k for k, *_ in _LINES))}
    return [f"SELECT {distinct}concat('manual', {key} % 5) AS filename, CAST(floor({page}) AS int) AS page, {line} AS line, '{kind}' AS kind, {rank[kind] * KIND_LINES} AS start FROM {table}" for kind, table, key, page, line in _LINES]


#: Word boxes of a register table: four cells a row, at fixed columns with a little jitter.
WORDS = """SELECT concat('manual', p_partkey % 5) AS filename, CAST(floor(p_partkey / 40) AS int) AS page, x0, x0 + 20.0 + p_partkey % 3 AS x1, 100.0 + (p_partkey % 40) * 12 + (p_partkey % 2) * 0.5 AS y0, word
FROM (SELECT p_partkey, 10.0 AS x0, concat('PRTm_R', p_partkey, '_n') AS word FROM part
UNION ALL SELECT p_partkey, 33.0 + p_partkey % 3 AS x0, 'word' AS word FROM part
UNION ALL SELECT p_partkey, 110.0 AS x0, concat(p_size, 'h') AS word FROM part
UNION ALL SELECT p_partkey, 210.0 AS x0, concat(p_partkey * 4, 'h') AS word FROM part) AS w"""


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    share(spark)
    text = sql
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables})


def prose_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PROSE, "documents")


def manual_lines(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """All lines, or those of some kinds; a kind's tables alone are then read."""
    df = _sql(spark, sf_dir, manual_sql(), *MANUAL_TABLES)
    return df.where(df["kind"].isin(*kinds)) if kinds else df


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as they are written, those that occur twice twice: no line waits for the others of its page.

    pos is a struct, which sorts the lines of a page as manual_lines' numbers do.
    """
    sql = f"SELECT filename, page, struct(start, line) AS pos, line, kind FROM ({' UNION ALL '.join(_kinds())}) AS l"
    return _sql(spark, sf_dir, sql, *MANUAL_TABLES)


def manual_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, WORDS, "part")
