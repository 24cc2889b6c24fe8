"""Tables from word boxes: rows, cells, blocks, kinds, stitching over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import has, normalize_for_search

ROW_TOLERANCE, CELL_GAP, BLOCK_GAP, MIN_CELLS, SPAN = 2.5, 14.0, 28.0, 3, 2


def cells(words: DataFrame) -> DataFrame:
    """Words (filename, page, x0, x1, y0, word) as cells: rows by y, a new cell where the gap is wide."""
    page = W.partitionBy("filename", "page").orderBy("y0", "x0", "word")
    new_row = F.when(F.col("y0") - F.lag("y0").over(page) > ROW_TOLERANCE, 1).otherwise(0)
    rows = words.withColumn("new", new_row).withColumn("row", F.sum("new").over(page.rowsBetween(W.unboundedPreceding, 0)))
    in_row = W.partitionBy("filename", "page", "row").orderBy("x0", "word")
    new_cell = F.when(F.col("x0") - F.lag("x1").over(in_row) > CELL_GAP, 1).otherwise(0)
    split = rows.withColumn("new", new_cell).withColumn("cell", F.sum("new").over(in_row.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word"))), lambda x: x["word"]), " ")
    return split.groupBy("filename", "page", "row", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), ordered.alias("text"))


def blocks(cell_rows: DataFrame) -> DataFrame:
    """Runs of rows with MIN_CELLS or more cells, not far apart: tables (filename, page, block, rows, cells, columns)."""
    rows = cell_rows.groupBy("filename", "page", "row").agg(F.count("*").alias("cells"), F.min("y0").alias("y0")).where(F.col("cells") >= MIN_CELLS)
    w = W.partitionBy("filename", "page").orderBy("row")
    new = F.when((F.col("row") - F.lag("row").over(w) > 1) | (F.col("y0") - F.lag("y0").over(w) > BLOCK_GAP), 1).otherwise(0)
    marked = rows.withColumn("new", new).withColumn("block", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("filename", "page", "block").agg(F.count("*").alias("rows"), F.sum("cells").alias("cells"), F.max("cells").alias("columns"))


def stitch(tables: DataFrame, span: int = SPAN) -> DataFrame:
    """Tables that go on over the next page, with as many columns, as one; at most `span` pages each."""
    w = W.partitionBy("filename").orderBy("page", "block")
    goes_on = (F.col("page") - F.lag("page").over(w) == 1) & (F.col("columns") == F.lag("columns").over(w))
    run = tables.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy("filename", "run").orderBy("page", "block")) - 1
    return run.withColumn("piece", F.floor(nth / span)).groupBy("filename", "run", "piece").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("rows").alias("rows"), F.max("columns").alias("columns"))


def kind(header) -> object:
    return rules.first_label(header, rules.TABLE_KINDS, "table")


def is_table_like(line):
    """Whether a line of text looks like a table's row."""
    return (F.size(F.split(F.trim(line), r"\s{2,}")) >= MIN_CELLS) | has(line, r"(?i)\b(Abbreviation|Offset\s+Address|Bit\s+Name|Initial\s+Value|Access\s+Size)\b") | has(line, r"\b[0-9A-F]+h\b")


def continued(rows: DataFrame) -> DataFrame:
    """Rows (filename, page, pos, head, text) without a head are added to the last that has one."""
    w = W.partitionBy("filename", "page").orderBy("pos")
    group = F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("group", group).where("`group` > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("filename", "page", "group").agg(F.min_by("head", "pos").alias("head"), text.alias("text"), F.count("*").alias("parts"))


def carried_register(rows: DataFrame) -> DataFrame:
    """Adds current: the last register named at or before a row, over a file's pages in order."""
    w = W.partitionBy("filename").orderBy("page", "pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("current", F.last_value(F.when(F.col("register") != "", F.col("register")), True).over(w))


def column_roles(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The role of each column (keys, text of its cells): the role whose rules its cells meet best, if well enough.

    Each cell is scored for every role; a column's role has the greatest sum of its header's and its
    samples' best points, the first by name on ties.
    """
    points = F.array(*(F.struct(F.lit(role).alias("role"), F.when(has(F.col("text"), pattern), n).otherwise(0).alias("points")) for role, pattern, n in rules.COLUMN_ROLES))
    each = cell_rows.select(*keys, "row", F.explode(points).alias("p")).groupBy(*keys, "row", F.col("p.role").alias("role")).agg(F.sum("p.points").alias("points"))
    summed = each.groupBy(*keys, "role").agg(F.sum("points").alias("total"), F.max("points").alias("best")).where(F.col("best") >= rules.ROLE_LEAST)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("total"), "role"))
    return summed.withColumn("n", rank).where("n = 1").select(*keys, "role", F.col("total").alias("points"))


# --- tables with a layout -----------------------------------------------------------------------

#: How far columns may be apart, the shares of columns and roles that must agree, and pages of a table at most.
COLUMN_TOLERANCE, COLUMN_SHARE, ROLE_SHARE, SPANS, OTHER_SPAN = 24.0, 0.7, 0.6, {"pinmux-table": 4}, 2
HEADER_TOKENS, LEADERS, LEADER_SHARE, SURE, LEAST_ROLES = 20, r"\.{4,}\s*\d+\s*$", 0.3, 70, 2
PAGE_SIGNS = [
    r"(?i)\bRegister\s+Name\b[\s\S]{0,240}\b(?:Offset\s+Address|Initial\s+Value|Access\s+Size)\b",
    r"(?i)\b(?:Bit\s+Name|Bit\s+Field)\b[\s\S]{0,240}\b(?:R\s*/\s*W|Access|Initial\s+Value|Description)\b",
    r"(?i)\b(?:Pin\s+Name|Pin\s+No\.?|Port\s+Name)\b[\s\S]{0,240}\b(?:Function|Signal|Peripheral|Mux)\b",
    r"(?i)\b(?:Caution|Restriction)\b[\s\S]{0,180}\b(?:Condition|Description|Action|Setting)\b",
]


def columns_align(a: Column, b: Column, tolerance: float = COLUMN_TOLERANCE) -> Column:
    """Whether two arrays of column positions agree: as many columns but for one, COLUMN_SHARE of them near each other."""
    shared = F.least(F.size(a), F.size(b))
    near = F.size(F.filter(F.zip_with(F.slice(a, 1, shared), F.slice(b, 1, shared), lambda x, y: F.abs(x - y) <= tolerance), lambda x: x))
    return (shared > 0) & (F.abs(F.size(a) - F.size(b)) <= 1) & (near / F.greatest(shared, F.lit(1)) >= COLUMN_SHARE)


def header_signature(kind_: Column, roles: Column, header: Column) -> Column:
    words = F.filter(F.split(normalize_for_search(header), r"\s+"), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$"))
    return F.array_join(F.array_distinct(F.concat(F.array(kind_), known_roles(roles), F.slice(words, 1, HEADER_TOKENS))), "|")


def known_roles(roles: Column) -> Column:
    return F.array_distinct(F.filter(roles, lambda r: r.isNotNull() & (r != "") & (r != "unknown")))


def can_stitch(left: str, right: str) -> Column:
    """Whether one table goes on in the other, both structs (kind, page_start, page_end, columns, roles, header) by name."""
    a, b = (lambda c, t=t: F.col(f"{t}.{c}") for t in (left, right))
    span = F.coalesce(*(F.when(a("kind") == k, n) for k, n in SPANS.items()), F.lit(OTHER_SPAN))
    one, other = known_roles(a("roles")), known_roles(b("roles"))
    most = F.greatest(F.size(one), F.size(other))
    same = F.when((F.size(one) == 0) | (F.size(other) == 0), header_signature(a("kind"), a("roles"), a("header")) == header_signature(b("kind"), b("roles"), b("header")))
    same = same.otherwise(F.size(F.array_intersect(one, other)) / F.greatest(most, F.lit(1)) >= ROLE_SHARE)
    return (b("page_start") == a("page_end") + 1) & (a("kind") == b("kind")) & (a("page_end") - a("page_start") + 1 < span) & columns_align(a("columns"), b("columns")) & same


def stitch_layouts(tables: DataFrame) -> DataFrame:
    """Tables (filename, page, kind, columns, roles, header, rows) that go on over the next page as one, of as many pages as their kind may have.

    The last table of a page is compared with the first of the next; rows counts those of all pages,
    without the header that each page but the first repeats.
    """
    w = W.partitionBy("filename").orderBy("page", "kind")
    here = F.struct("kind", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "columns", "roles", "header")
    pairs = tables.withColumn("here", here).withColumn("before", F.lag("here").over(w))
    goes_on = F.coalesce(can_stitch("before", "here"), F.lit(False))
    run = pairs.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    span = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in SPANS.items()), F.lit(OTHER_SPAN))
    nth = F.row_number().over(W.partitionBy("filename", "run").orderBy("page")) - 1
    pieces = run.withColumn("nth", nth).withColumn("piece", F.floor(F.col("nth") / span)).withColumn("first", (F.col("nth") % span) == 0)
    out = pieces.groupBy("filename", "kind", "run", "piece").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(F.col("rows") - F.when(F.col("first"), 0).otherwise(1)).alias("rows"))
    return out.select("filename", "kind", "page_start", "page_end", "rows")


def has_quality(kind_: Column, rows: Column, roles: Column, header: Column, confidence: Column) -> Column:
    """Whether a found table is worth keeping: rows (array of texts), without lists of contents, with the roles its kind needs."""
    known = known_roles(roles)
    is_ = lambda *names: F.arrays_overlap(known, F.array(*map(F.lit, names)))
    leading = F.size(F.filter(rows, lambda x: x.rlike(LEADERS))) / F.greatest(F.size(rows), F.lit(1))
    fits = (
        F.when(kind_ == "register-table", is_("register", "abbreviation", "offset"))
        .when(kind_ == "bitfield-table", is_("bit", "bitfield"))
        .when(kind_ == "pinmux-table", is_("pin", "port") & is_("function", "signal", "peripheral"))
        .when(kind_ == "caution-table", has(header, r"(?i)\b(Caution|Restriction|Prohibited|Reserved)\b"))
        .otherwise((confidence >= SURE) & (F.size(known) >= LEAST_ROLES))
    )
    return (F.size(rows) >= 2) & (leading < LEADER_SHARE) & fits


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Pages (filename, page) whose text has a table's header, and those next to them."""
    sign = F.lit(False)
    for p in PAGE_SIGNS:
        sign = sign | has(F.col("text"), p)
    near = pages.where(sign).select("filename", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page")).distinct()
    return pages.select("filename", "page").distinct().join(near, ["filename", "page"], "left_semi")
