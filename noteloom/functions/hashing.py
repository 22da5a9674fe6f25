"""Hashes with fixed definitions, folded inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME, MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def fnv1a(text: Column, prefix: int = 120) -> Column:
    """FNV-1a over the code points of the first ``prefix`` characters, as 8 hex digits."""
    codes = F.transform(F.split(F.substring(text, 1, prefix), "(?!^)"), lambda c: F.when(c == "", F.lit(None)).otherwise(F.ascii(c)).cast("long"))
    folded = F.aggregate(F.filter(codes, lambda c: c.isNotNull()), F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(MASK))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def djb2(text: Column) -> Column:
    """64-bit djb2 (h * 33 + byte) over UTF-8 bytes, as hex without leading zeros."""
    raw = F.hex(F.encode(text, "UTF-8"))
    values = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    # Two 32-bit halves, so that nothing overflows.
    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        low = s["lo"] * 33 + b
        return F.struct((s["hi"] * 33 + F.shiftright(low, 32)).bitwiseAND(MASK).alias("hi"), low.bitwiseAND(MASK).alias("lo"))

    digits = F.aggregate(values, start, step, lambda s: F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0")))
    return F.lower(F.regexp_replace(F.when(F.octet_length(text) == 0, F.lit("1505")).otherwise(digits), "^0+(?=.)", ""))


def content_key(text: Column, digits: int = 64) -> Column:
    """SHA-256 as hex, the first ``digits`` of it."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def rolling32(text: Column) -> Column:
    """32-bit rolling hash (h * 31 + code) over the characters, as 8 hex digits: the stand-in
    for a content key where no digest is at hand. Characters beyond the BMP count by code point."""
    codes = F.transform(F.filter(F.split(text, "(?!^)"), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(MASK))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")
