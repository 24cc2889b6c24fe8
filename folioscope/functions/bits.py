"""Bit ranges, access kinds and reset values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.rules import ACCESS, ACCESS_WORD
from folioscope.functions.text import rx

UNKNOWN = "unknown"


def normalize_range(text: Column) -> Column:
    """`31 to 28`, `[31-28]` or `7` as `31:28` or `7`; anything else is unknown."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[−–—-]|to", ":"), r"bits?|[()\[\]\s]", "")
    high, low = F.regexp_extract(flat, r"^(\d{1,3})(?::(\d{1,3}))?$", 1), F.regexp_extract(flat, r"^(\d{1,3})(?::(\d{1,3}))?$", 2)
    return F.when(high == "", UNKNOWN).when(low == "", high.cast("int").cast("string")).otherwise(F.concat_ws(":", high.cast("int"), low.cast("int")))


def parse_range(text: Column) -> Column:
    """A normalized range as struct(high, low, width), null if unknown."""
    parts = F.split(text, ":")
    a = F.get(parts, F.lit(0)).try_cast("int")
    b = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), a)
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNotNull(), F.struct(high.alias("high"), low.alias("low"), (high - low + 1).alias("width")))


def normalize_access(text: Column) -> Column:
    flat = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", "")
    return F.coalesce(*(F.when(flat == k, v) for k, v in ACCESS.items()), F.lit(UNKNOWN))


def normalize_reset(text: Column) -> Column:
    raw = F.trim(F.coalesce(text, F.lit("")))
    flat = F.lower(F.replace(raw, F.lit("_"), F.lit("")))
    return F.when((raw == "") | flat.isin("-", "undefined", "reserved"), UNKNOWN).when(flat.rlike("^0+[hb]?$"), "0").when(flat.rlike("^1+b$") | (flat == "1"), "1").otherwise(raw)


def access_of(line: Column) -> Column:
    return normalize_access(F.regexp_extract(line, rx(ACCESS_WORD), 1))


def reset_value(text: Column) -> Column:
    """The number a reset literal stands for, null if it is none; up to 63 bits."""
    flat = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit("")))
    hexed = F.when(flat.rlike("^0x[0-9a-f]{1,15}$"), F.substring(flat, 3, 15)).when(flat.rlike("^[0-9a-f]{1,15}h$"), F.expr("NULL")).otherwise(F.lit(None))
    hexed = F.coalesce(hexed, F.when(flat.rlike("^[0-9a-f]{1,15}h$"), F.regexp_replace(flat, "h$", "")))
    return F.when(hexed.isNotNull(), F.conv(hexed, 16, 10).try_cast("long")).when(flat.rlike("^[01]{1,62}b$"), F.conv(F.regexp_replace(flat, "b$", ""), 2, 10).try_cast("long")).when(flat.rlike(r"^\d{1,18}$"), flat.try_cast("long"))


def reset_fits(text: Column, width: Column) -> Column:
    """Whether the reset value can be held by that many bits; true where either is not known."""
    value = reset_value(text)
    return F.coalesce(value < F.pow(F.lit(2.0), width), F.lit(True))


def register_width(access_size: Column) -> Column:
    return F.regexp_extract(F.coalesce(access_size, F.lit("")), rx(r"\b(8|16|32|64|128)\b"), 1).try_cast("int")
