"""FNV-1a of strings, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.binding import let

#: The 64-bit offset basis as two halves, and the part of the prime 2**40 + 435 below 2**32.
_BASIS = 3421674724, 2216829733
_PRIME = 435
_MASK = 0xFFFFFFFF


def fnv1a64_hex(value: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as 16 lower-case hex digits, which sort as the unsigned numbers do.

    The state is two unsigned 32-bit halves, as a 64-bit product would overflow.
    """
    digits = F.hex(F.encode(value, "utf-8"))

    def step(acc: Column, k: Column) -> Column:
        x = acc["lo"].bitwiseXOR(F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint"))
        p = x * _PRIME
        hi = acc["hi"] * _PRIME + F.shiftleft(x, 8) + F.shiftrightunsigned(p, 32)
        return F.struct(hi.bitwiseAND(F.lit(_MASK)).alias("hi"), p.bitwiseAND(F.lit(_MASK)).alias("lo"))

    start = F.struct(*(F.lit(n).cast("bigint").alias(c) for n, c in zip(_BASIS, ("hi", "lo"), strict=True)))
    halves = F.when(F.octet_length(value) == 0, start).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.octet_length(value) - 1), start, step)
    )
    half = lambda h, c: F.lpad(F.lower(F.hex(h[c])), 8, "0")
    return let(halves, lambda h: F.concat(half(h, "hi"), half(h, "lo")))


def shard_index(domain: Column) -> Column:
    """FNV-1a 64 mod 8: the low three bits."""
    return (F.conv(F.right(fnv1a64_hex(domain), F.lit(1)), 16, 10).cast("int") % 8).cast("int")
