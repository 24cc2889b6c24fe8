"""Registers: extraction from lists and headings, keyed merge, confidence, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import canonical_hardware_symbol, canonical_symbol, half_up, has, normalize_for_search, once, rx

#: Points for where a register was seen.
SOURCE_POINTS = {"register-list-table": 90, "register-description-heading": 75, "symbol-scan": 10}


def looks_like_register(symbol: Column) -> Column:
    name = canonical_symbol(symbol)
    return F.length(name).between(3, 80) & ~name.isin(*rules.NOT_REGISTERS) & has(name, rules.REGISTER_NAME)


def list_rows(lines: DataFrame) -> DataFrame:
    """Rows of "List of Registers" tables: keys, name, description, initial_value, offset, access_size."""
    part = lambda i: F.trim(F.regexp_extract("line", rules.REGISTER_ROW, i))
    found = lines.where(F.col("line").rlike(rules.REGISTER_ROW))
    rows = found.select("filename", "page", "pos", part(2).alias("name"), F.regexp_replace(part(1), r"\s+", " ").alias("description"), part(3).alias("initial_value"), F.regexp_replace(part(4), r"\s+", " ").alias("offset"), part(5).alias("access_size"))
    return rows.where(~F.lower("description").isin("reserve", ""))


def symbol_rows(lines: DataFrame) -> DataFrame:
    """One row per register-like symbol of a line."""
    found = lines.select("filename", "page", "pos", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(rx(rules.REGISTER_SYMBOL)), F.lit(0)))).alias("name"))
    return found.where(looks_like_register(F.col("name")))


def aliases(name: Column) -> Column:
    """The name, its canonical form, without its module prefix, and with other modules' prefixes."""
    bare = canonical_symbol(F.regexp_replace(F.regexp_replace(name, "(?i)^[A-Z0-9]+m_", ""), "(?i)^(GBETH|ETH|GMAC|WDT|GPT|POEG|ICU)_", ""))
    others = [F.when(~F.startswith(bare, canonical_symbol(F.lit(p))), F.concat(F.lit(p), bare)) for p in rules.ALIAS_PREFIXES]
    return F.array_distinct(F.array_compact(F.array(name, canonical_symbol(name), F.when(bare != "", bare), *others)))


def index(lists: DataFrame, symbols: DataFrame) -> DataFrame:
    """Registers by (filename, name), merged over all sources, with a confidence of 1 to 99."""
    points = lambda kind: F.lit(SOURCE_POINTS[kind])
    both = lists.select("filename", "page", "name", "description", "access_size", F.lit("register-list-table").alias("source"), points("register-list-table").alias("points"))
    both = both.unionByName(symbols.select("filename", "page", "name", F.lit("symbol-scan").alias("source"), points("symbol-scan").alias("points")), allowMissingColumns=True)
    merged = both.groupBy("filename", canonical_symbol(F.col("name")).alias("canonical")).agg(
        F.min("name").alias("name"),
        F.count("*").alias("occurrences"),
        F.sum("points").alias("points"),
        F.countDistinct("page").alias("pages"),
        F.min("page").alias("first_page"),
        F.min("description").alias("description"),
        F.min("access_size").alias("access_size"),
        F.max(F.when(F.col("source") == "register-list-table", 1).otherwise(0)).alias("explicit"),
    )
    mean = F.least(F.lit(55.0), F.col("points") / F.col("occurrences"))
    confidence = half_up(mean + F.least(F.lit(18), F.col("occurrences") * 2) + F.least(F.lit(8), F.col("pages")) + 25 * F.col("explicit"))
    return merged.withColumn("confidence", F.greatest(F.lit(1), F.least(F.lit(99), confidence)).cast("int"))


def find(registers: DataFrame, wanted: str, k: int = 8) -> DataFrame:
    """The k registers that best match a name: by itself, an alias, or a part of either."""
    target = canonical_symbol(F.lit(wanted))
    known = F.transform(aliases(F.col("name")), canonical_symbol)
    text = normalize_for_search(F.concat_ws(" ", "name", "description"))
    score = F.when(F.col("canonical") == target, 180).otherwise(0) + F.when(F.array_contains(known, target), 160).otherwise(0)
    score = score + F.when(F.exists(known, lambda a: F.contains(a, target) | F.contains(target, a)), 85).otherwise(0)
    score = score + F.when(F.contains(text, normalize_for_search(F.lit(wanted))), 45).otherwise(0)
    return registers.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("confidence"), "first_page", "filename", "name").limit(k)


def near_pages(pages: DataFrame, registers: DataFrame, radius: int) -> DataFrame:
    """Band join: rows of pages within `radius` of a page a register stands on, as an equi-join."""
    spread = registers.select("filename", "name", F.explode(F.sequence(F.col("first_page") - radius, F.col("first_page") + radius)).alias("page"), "first_page")
    return pages.join(spread, ["filename", "page"])


#: Points for what ties a field of a pseudo-register to a register, the least that settles it, and its lead.
SAME_PAGE, SAME_PREFIX, EXPLICIT_POINTS, IN_HEADING, IN_EVIDENCE, ALIAS_IN_EVIDENCE, WITHIN_EVIDENCE, SETTLED, LEAD = 35, 25, 20, 220, 170, 100, 70, 70, 15


def is_pseudo(name: Column) -> Column:
    """Whether a name stands for a block of registers, not for one."""
    symbol = canonical_hardware_symbol(name)
    return (symbol == "") | (symbol == "GLOBAL") | F.endswith(symbol, F.lit("BASE"))


def stands_in(name: Column, text: Column) -> Column:
    """Whether the name stands in the text as a whole symbol, in any case."""
    return F.contains(F.lower(text), F.lower(name)) & _whole(name, text)


def _whole(name: Column, text: Column) -> Column:
    pattern = F.concat(F.lit("(?i)(^|[^A-Za-z0-9_])\\Q"), name, F.lit("\\E([^A-Za-z0-9_]|$)"))
    return F.regexp_like(text, pattern)


def resolve(candidates: DataFrame, registers: DataFrame, keys: list[str]) -> DataFrame:
    """The register that each field of a pseudo-register belongs to: keys, register, status, confidence, best.

    candidates (keys, filename, page, source, heading, evidence) meet the registers (filename, page,
    name, explicit) of their own page. A field of a real register is direct; another is resolved if
    one register has SETTLED points and leads by LEAD, else unresolved, with the best as a hint.
    """
    pseudo = is_pseudo(F.col("source"))
    direct = candidates.where(~pseudo).select(*keys, F.col("source").alias("register"), F.lit("direct").alias("status"), F.lit(100).alias("confidence"), F.col("source").alias("best"))
    asked = candidates.where(pseudo)
    known = registers.where(~is_pseudo(F.col("name"))).groupBy("filename", "page", "name").agg(F.max("explicit").alias("explicit"))
    # What follows from a name or from a text alone is worked out before they meet: a text meets all names of its page.
    spelt = F.transform(aliases(F.col("name")), lambda x: F.struct(x.alias("name"), F.lower(x).alias("low"), canonical_hardware_symbol(x).alias("symbol")))
    known = once(known, "__name", F.struct(F.lower("name").alias("low"), canonical_hardware_symbol(F.col("name")).alias("own"), spelt.alias("spelt")))
    symbol = canonical_hardware_symbol(F.col("source"))
    prefix = F.when(F.endswith(symbol, F.lit("BASE")), F.regexp_replace(symbol, "BASE$", "")).otherwise("")
    texts = F.struct(prefix.alias("prefix"), F.lower("heading").alias("heading"), F.lower("evidence").alias("evidence"), canonical_hardware_symbol(F.col("evidence")).alias("symbol"))
    met = once(asked, "__text", texts).join(known, ["filename", "page"])
    name, text = F.col("__name"), F.col("__text")
    prefix, own = text["prefix"], name["own"]
    alias = F.exists(name["spelt"], lambda x: F.contains(text["evidence"], x["low"]) & _whole(x["name"], F.col("evidence")))
    within = F.exists(name["spelt"], lambda x: F.contains(text["symbol"], x["symbol"]))
    inside = lambda c: F.contains(text[c], name["low"]) & _whole(F.col("name"), F.col(c))
    named = F.when(inside("heading"), IN_HEADING).when(inside("evidence"), IN_EVIDENCE).when(alias, ALIAS_IN_EVIDENCE).when(within, WITHIN_EVIDENCE).otherwise(0)
    points = F.lit(SAME_PAGE) + F.when((prefix != "") & F.startswith(own, prefix), SAME_PREFIX).otherwise(0) + F.when(F.col("explicit") == 1, EXPLICIT_POINTS).otherwise(0) + named
    w = W.partitionBy(*keys).orderBy(F.desc("points"), F.lower("name"), "name")
    ranked = met.select(*keys, "name", points.alias("points")).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("points").over(w)).where("n = 1")
    found = asked.select(*keys, "source").join(ranked, keys, "left")
    sure = F.coalesce((F.col("points") >= SETTLED) & (F.col("next").isNull() | (F.col("points") - F.col("next") >= LEAD)), F.lit(False))
    out = found.select(*keys, F.when(sure, F.col("name")).otherwise(F.when(F.col("source") == "", "GLOBAL").otherwise(F.col("source"))).alias("register"), F.when(sure, "resolved").otherwise("unresolved").alias("status"), F.least(F.lit(100), F.coalesce("points", F.lit(0))).alias("confidence"), F.col("name").alias("best"))
    return direct.unionByName(out)
