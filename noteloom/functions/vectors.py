"""Cosine, signatures and Hamming distance on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.text import let

BITS = 128
#: Rounds of the mixed projection: xor with the shifted number, then multiply (31 bits are kept between).
MIX = ((13, 1664525), (11, 1103515245), (15, 1664525))


def dot(a: Column, b: Column) -> Column:
    """Over the common prefix."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, mode: str = "prefix") -> Column:
    """Zero for a zero or null vector; ``prefix`` compares the common prefix, ``strict`` equal lengths only."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    scale = norm(x) * norm(y)
    value = F.when(F.coalesce(scale, F.lit(0.0)) > 0, dot(a, b) / scale).otherwise(F.lit(0.0))
    value = F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0)) if mode == "strict" else value


def _sign(bit: Column, dim: Column, projection: str) -> Column:
    """+1 or -1. ``compat``: the low bit of an FNV-1a hash of (bit, dim), which depends on three
    low bits only, so all rows are one vector or its negation; ``mixed``: a well mixed hash."""
    if projection == "compat":
        low = bit.bitwiseAND(1).bitwiseXOR(dim.bitwiseAND(1)).bitwiseXOR(F.shiftright(dim.cast("int"), 8).bitwiseAND(1))
        return F.when(low == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    h = (bit.cast("long") * 512 + dim.cast("long") + 1) * 1103515245
    for shift, factor in MIX:
        h = h.bitwiseAND(0x7FFFFFFF)
        h = h.bitwiseXOR(F.shiftright(h, shift)) * factor
    return F.when(F.shiftright(h, 16).bitwiseAND(1) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def signature_bits(vec: Column, projection: str = "mixed", dims: int = 512) -> Column:
    """Signs of ``BITS`` projections as array<boolean>."""

    def folded(x: Column, bit: Column) -> Column:
        return F.aggregate(F.transform(x, lambda v, d: v.cast("double") * _sign(bit, d, projection)), F.lit(0.0), lambda s, v: s + v)

    numbers = F.sequence(F.lit(0), F.lit(BITS - 1))
    used = F.slice(vec, 1, dims)
    if projection == "compat":  # two distinct rows only: fold once, negate for the other
        return let(folded(used, F.lit(0)), lambda one: F.transform(numbers, lambda b: F.when(b % 2 == 0, one).otherwise(-one) > 0))
    return F.transform(numbers, lambda b: folded(used, b) > 0)


def signature(vec: Column, projection: str = "mixed", dims: int = 512) -> Column:
    """Four 32-bit words as 32 hex digits; bit b is bit b % 32 of word b / 32."""

    def word(bits: Column, k: int) -> Column:
        powers = F.transform(F.slice(bits, 32 * k + 1, 32), lambda on, i: F.when(on, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.lpad(F.lower(F.hex(F.aggregate(powers, F.lit(0).cast("long"), lambda s, x: s + x))), 8, "0")

    return F.when(vec.isNotNull(), let(signature_bits(vec, projection, dims), lambda bits: F.concat(*(word(bits, k) for k in range(4)))))


def hamming(a: Column, b: Column) -> Column:
    """Distance of two 32-digit signatures."""
    part = lambda s, k: F.conv(F.substring(s, 8 * k + 1, 8), 16, 10).cast("long")
    total = F.bit_count(part(a, 0).bitwiseXOR(part(b, 0)))
    for k in range(1, 4):
        total = total + F.bit_count(part(a, k).bitwiseXOR(part(b, k)))
    return total
