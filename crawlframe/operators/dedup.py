"""URL deduplication: exact, and by a Bloom filter with FNV-1a 128 double hashing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.binding import let
from crawlframe.functions.hashing import fnv1a64_hex


def new_urls(urls: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows of urls whose URL isn't in seen (url), one for each URL."""
    return urls.join(seen.select(url), url, "left_anti").dropDuplicates([url])


def keyed(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumn("url_key", fnv1a64_hex(F.col(url)))


def mark_seen(seen: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    return seen.select(url).unionByName(urls.select(url)).distinct()


# Fixed value: the offset basis of FNV-1a 128.
_BASIS = 0x6C62272E07BB014262B821756295C58D


def size_of(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n items at false-positive rate p."""
    m = max(1, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / n * math.log(2)))


def hashes(key: bytes) -> tuple[int, int]:
    """Both halves of FNV-1a 128."""
    state = _BASIS
    for b in key:
        state = (state ^ b) * 0x0000000001000000000000000000013B % (1 << 128)
    return state >> 64, state & 0xFFFFFFFFFFFFFFFF


class Bloom:
    """The filter in one process: for small sets, and what the distributed form is held against."""

    def __init__(self, n: int, p: float, bits: np.ndarray | None = None):
        self.m, self.k = size_of(n, p)
        self.bits = np.zeros((self.m + 7) // 8, np.uint8) if bits is None else bits

    def places(self, key: str) -> list[int]:
        h1, h2 = hashes(key.encode())
        return [(h1 + i * h2) % (1 << 64) % self.m for i in range(self.k)]

    def add(self, key: str) -> None:
        for at in self.places(key):
            self.bits[at >> 3] |= 1 << (at & 7)

    def test(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.places(key))

    def test_and_add(self, key: str) -> bool:
        was = self.test(key)
        self.add(key)
        return was

    def size_bytes(self) -> int:
        return len(self.bits)


#: Bits of one of Spark's bitmaps, and the largest filter that is broadcast.
PAGE, BROADCAST_BYTES = 32_768, 64 << 20


def double_hash(value: Column) -> Column:
    """struct(h1, h2): both halves of FNV-1a 128 of the UTF-8 bytes, as decimals of unsigned 64-bit numbers.

    The state is four unsigned 32-bit limbs, the lowest first; the prime is 2**88 + 315.
    """
    digits = F.hex(F.encode(value, "utf-8"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    carry = lambda x: F.shiftrightunsigned(x, 32)

    def step(s: Column, k: Column) -> Column:
        byte = F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint")
        return let(
            F.struct(s["a"].bitwiseXOR(byte).alias("a"), *(s[c].alias(c) for c in "bcd")),
            lambda x: let(
                x["a"] * 315,
                lambda p: let(
                    x["b"] * 315 + carry(p),
                    lambda q: let(
                        x["c"] * 315 + carry(q) + low(F.shiftleft(x["a"], 24)),
                        lambda r: F.struct(
                            low(p).alias("a"), low(q).alias("b"), low(r).alias("c"),
                            low(x["d"] * 315 + carry(r) + F.shiftrightunsigned(x["a"], 8) + low(F.shiftleft(x["b"], 24))).alias("d"),
                        ),
                    ),
                ),
            ),
        )

    start = F.struct(*(F.lit(_BASIS >> 32 * k & 0xFFFFFFFF).cast("bigint").alias(c) for k, c in enumerate("abcd")))
    state = F.when(F.octet_length(value) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.octet_length(value) - 1), start, step))
    wide = lambda high, less: high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + less
    return let(state, lambda s: F.struct(wide(s["d"], s["c"]).cast("decimal(20,0)").alias("h1"), wide(s["b"], s["a"]).cast("decimal(20,0)").alias("h2")))


def bloom_places(value: Column, n: int, p: float = 0.01) -> Column:
    """The places (array<bigint>) of a value's bits in a filter for n items: (h1 + i * h2) mod 2**64 mod m."""
    m, k = size_of(n, p)
    wrap = F.lit(str(1 << 64)).cast("decimal(20,0)")
    one = lambda h, i: (((h["h1"] + i.cast("decimal(3,0)") * h["h2"]) % wrap) % F.lit(m).cast("decimal(19,0)")).cast("bigint")
    return let(double_hash(F.coalesce(value, F.lit(""))), lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: one(h, i)))


def build_bloom(keys: DataFrame, key: str, n: int, p: float = 0.01) -> DataFrame:
    """(page, bits): the filter in pages of 4 KB. Native; each task sends the pages that it touches, which are or-ed.

    The filter is never whole in one task, so that its size has no bound.
    """
    at = keys.select(F.explode(bloom_places(F.col(key), n, p)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE).alias("bits"))


def add_to_bloom(bloom: DataFrame, keys: DataFrame, key: str, n: int, p: float = 0.01) -> DataFrame:
    both = bloom.unionByName(build_bloom(keys, key, n, p))
    return both.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def test_bloom(rows: DataFrame, key: str, bloom: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """rows with maybe: whether the filter may hold their key; a false one it surely doesn't.

    Each distinct key's places meet the filter's pages by page number: pages of
    a filter of up to BROADCAST_BYTES are broadcast, larger ones are shuffled.
    """
    pages = F.broadcast(bloom) if size_of(n, p)[0] / 8 <= BROADCAST_BYTES else bloom
    keys = rows.select(F.col(key).alias("__key")).distinct()
    at = keys.select("__key", F.explode(bloom_places(F.col("__key"), n, p)).alias("__at")).select(
        "__key", F.floor(F.col("__at") / PAGE).alias("page"), (F.col("__at") % PAGE).cast("int").alias("__bit")
    )
    byte = F.conv(F.hex(F.expr("substring(bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) > 0, F.lit(False))
    found = at.join(pages, "page", "left").groupBy("__key").agg(F.bool_and(held).alias("maybe"))
    return rows.join(found, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


test_bloom.__test__ = False  # no test of pytest's


def test_and_add(rows: DataFrame, key: str, bloom: DataFrame, n: int, p: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(rows with maybe, the filter with their keys)."""
    return test_bloom(rows, key, bloom, n, p), add_to_bloom(bloom, rows, key, n, p)


test_and_add.__test__ = False


def new_by_bloom(urls: DataFrame, seen: DataFrame, bloom: DataFrame, n: int, url: str = "url", p: float = 0.01) -> DataFrame:
    """new_urls with the seen set behind its filter: only URLs that the filter may hold are joined with seen (exact, no URL is lost)."""
    tested = test_bloom(urls.dropDuplicates([url]), url, bloom, n, p)
    fresh = tested.where(~F.col("maybe")).drop("maybe")
    return fresh.unionByName(new_urls(tested.where("maybe").drop("maybe"), seen, url))
