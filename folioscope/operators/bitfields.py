"""Bit fields: parsing bit-table lines, keyed merge, conflicts, overlaps, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.bits import UNKNOWN, access_of, normalize_range, normalize_reset, parse_range, register_width, reset_fits
from folioscope.functions.rules import REGISTER_SYMBOL
from folioscope.functions.text import canonical_hardware_symbol, rx

#: Position, name and field-local range at the head of a bit-table line.
HEAD = r"^(\d{1,3}(?:\s*(?:to|:|-)\s*\d{1,3})?)\s+([A-Z][A-Z0-9_]{1,31})(?:\s*\[\s*(\d{1,3}\s*:\s*\d{1,3})\s*\])?\s+(\S+)\s"
NOISE = ["NOTE", "TABLE", "FIGURE", "BIT", "BITS", "NAME", "READ", "WRITE", "RESERVED", "DESCRIPTION", "RESET", "CPU", "RAM", "GLOBAL"]


def parse(lines: DataFrame) -> DataFrame:
    """Rows (filename, page, pos, register, bitfield, position, field_range, access, reset) of bit-table lines."""
    part = lambda i: F.regexp_extract("line", HEAD, i)
    found = lines.where(F.col("line").rlike(HEAD))
    rows = found.select("filename", "page", "pos", F.regexp_extract("line", rx(REGISTER_SYMBOL), 0).alias("register"), part(2).alias("bitfield"), normalize_range(part(1)).alias("position"), normalize_range(part(3)).alias("field_range"), access_of(F.col("line")).alias("access"), normalize_reset(part(4)).alias("reset"))
    return rows.where(~canonical_hardware_symbol(F.col("bitfield")).isin(*NOISE) & (F.col("register") != ""))


def merge(rows: DataFrame) -> DataFrame:
    """Bit fields by (filename, register, bitfield): the first known value of each attribute, and how many differ."""
    known = lambda c: F.when(F.col(c) != UNKNOWN, F.col(c))
    first = lambda c: F.coalesce(F.min_by(known(c), F.when(F.col(c) != UNKNOWN, F.struct("page", "pos"))), F.lit(UNKNOWN)).alias(c)
    names = ("position", "field_range", "access", "reset")
    out = rows.groupBy("filename", "register", "bitfield").agg(*map(first, names), *(F.countDistinct(known(c)).alias(f"n_{c}") for c in names), F.count("*").alias("lines"))
    conflicts = sum((F.when(F.col(f"n_{c}") > 1, 1).otherwise(0) for c in names), F.lit(0))
    return out.withColumn("conflicts", conflicts).drop(*(f"n_{c}" for c in names))


def conflicts(rows: DataFrame) -> DataFrame:
    """Attributes that the lines of one bit field give differently: (filename, register, bitfield, field, values), in order of value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.trim(F.col(c)).alias("value")) for c in ("position", "field_range", "access", "reset"))))
    said = rows.select("filename", "register", "bitfield", each.alias("x")).where((F.col("x.value") != "") & (F.lower("x.value") != UNKNOWN))
    values = said.groupBy("filename", "register", "bitfield", "x.field").agg(F.sort_array(F.collect_set("x.value")).alias("values"))
    return values.where(F.size("values") > 1).withColumn("values", F.array_join("values", ","))


def validate(fields: DataFrame, registers: DataFrame) -> DataFrame:
    """Adds register_width, width, issues (joined by `; `) and status: valid, conflict or needs_verification."""
    width = registers.select("filename", F.col("name").alias("register"), register_width(F.col("access_size")).alias("register_width"))
    met = fields.join(width, ["filename", "register"], "left").withColumn("at", parse_range(F.col("position"))).withColumn("own", parse_range(F.col("field_range")))
    issues = F.array_compact(
        F.array(
            F.when(F.col("at").isNull(), F.lit("position")),
            F.when(F.col("access") == UNKNOWN, F.lit("access")),
            F.when(F.col("reset") == UNKNOWN, F.lit("reset")),
            F.when(F.col("conflicts") > 0, F.lit("conflict")),
            F.when(F.col("at.high") >= F.col("register_width"), F.lit("beyond register")),
            F.when(F.col("at.width") != F.col("own.width"), F.lit("width")),
            F.when(F.col("at").isNotNull() & ~reset_fits(F.col("reset"), F.col("at.width")), F.lit("reset too large")),
        )
    )
    status = F.when(F.size("found") == 0, "valid").when(F.col("conflicts") > 0, "conflict").otherwise("needs_verification")
    return met.withColumn("found", issues).withColumn("status", status).withColumn("issues", F.array_join("found", "; ")).withColumn("width", F.coalesce("at.width", "own.width")).drop("at", "own", "found")


def overlaps(fields: DataFrame) -> DataFrame:
    """Interval-overlap self-join within a register: rows (filename, register, bitfield, other), both ways."""
    at = fields.withColumn("at", parse_range(F.col("position"))).where("at is not null").select("filename", "register", "bitfield", "at.high", "at.low")
    # Bit positions are few: sharing one of them is the overlap, and makes an equi-join of it.
    bits = at.select("filename", "register", "bitfield", F.explode(F.sequence("low", "high")).alias("bit"))
    other = bits.withColumnRenamed("bitfield", "other")
    return bits.join(other, ["filename", "register", "bit"]).where("bitfield <> other").select("filename", "register", "bitfield", "other").distinct()


def retained(fields: DataFrame) -> DataFrame:
    """Valid and conflicting ones, and others with a known position or two known attributes."""
    known = sum((F.when(F.col(c) != UNKNOWN, 1).otherwise(0) for c in ("position", "access", "reset")), F.lit(0))
    return fields.where(F.col("status").isin("valid", "conflict") | (F.col("position") != UNKNOWN) | (known >= 2))
