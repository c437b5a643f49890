"""Bloom filters over 32-bit key hashes as sets of bit positions, and their bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hash32 import MASK


def bits_per_key(entries: int, false_positives: float) -> int:
    if entries <= 0:
        return 0
    return math.ceil(-math.log(false_positives) / math.log(2) ** 2)


def hash_count(bits: int) -> int:
    return min(30, max(1, int(bits * 0.69)))


def filter_bits(keys: Column, bits: int) -> Column:
    """Size of a filter for so many keys: 64 bits at least, whole bytes."""
    return (F.floor((F.greatest(keys * bits, F.lit(64)) + 7) / 8) * 8).cast("long")


def positions(h: Column, k: int, nbits: Column) -> Column:
    """The bits of a hash: steps of the hash rotated right by 17, each modulo 2**32."""
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(MASK))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h + i.cast("long") * delta).bitwiseAND(MASK) % nbits)


def build(hashes: DataFrame, bits: int) -> DataFrame:
    """(filter, nbits, bit): the distinct set bits of each filter. hashes: filter, h. Counts are taken before bits are made,
    so each row is shuffled as its few bits only."""
    sizes = hashes.groupBy("filter").agg(filter_bits(F.count("*"), bits).alias("nbits"))
    made = hashes.join(sizes, "filter").select("filter", "nbits", F.explode(positions(F.col("h"), hash_count(bits), F.col("nbits"))).alias("bit"))
    return made.distinct()


#: Bits in a piece of a filter, as Spark's bitmap functions have them.
PIECE = 8 * 4096


def packed(filters: DataFrame) -> DataFrame:
    """filter, nbits, data: a filter's bits in bytes, lowest first. Bits are put together by pieces, then pieces by filter."""
    within = F.bitmap_construct_agg(F.col("bit") % PIECE).alias("bits")
    pieces = filters.groupBy("filter", "nbits", F.expr(f"cast(bit div {PIECE} as int)").alias("piece")).agg(within)
    held = pieces.groupBy("filter", "nbits").agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("m"))
    none = F.lit(bytes(PIECE // 8))
    whole = F.aggregate(F.sequence(F.lit(0), F.expr(f"cast((nbits - 1) div {PIECE} as int)")), F.lit(b""), lambda a, i: F.concat(a, F.coalesce(F.element_at("m", i), none)))
    return held.select("filter", "nbits", F.substring(whole, F.lit(1), F.expr("cast(nbits div 8 as int)")).alias("data"))


def may_contain(probes: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """probes (filter, h) with may_contain: are all the hash's bits set? A filter without bits holds nothing."""
    byte = lambda i: F.conv(F.hex(F.substring("data", (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda i: F.call_function("shiftright", byte(i), (i % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    asked = probes.select("filter", "h").distinct().join(packed(filters), "filter", "left")
    return asked.select("filter", "h", F.coalesce(F.forall(positions(F.col("h"), hash_count(bits), F.col("nbits")), is_set), F.lit(False)).alias("may_contain"))


def to_bytes(filters: DataFrame, bits: int) -> DataFrame:
    """filter, data: its bytes (lowest bit first) and a byte for the number of hashes."""
    return packed(filters).select("filter", F.concat("data", F.lit(bytes([hash_count(bits)]))).alias("data"))


def from_bytes(rows: DataFrame) -> DataFrame:
    """(filter, nbits, bit) from (filter, data)."""
    n = F.octet_length("data") - 1
    value = lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("int")
    bits = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when((F.floor(value(i) / F.pow(F.lit(2), j)) % 2) == 1, (i * 8 + j).cast("long"))), lambda x: x.isNotNull())))
    return rows.select("filter", (n * 8).cast("long").alias("nbits"), F.explode(bits).alias("bit"))


def filter_bytes(hashes: set[int], bits: int) -> bytes:
    """The bytes of one filter, as to_bytes gives them, from the hashes of a file's keys."""
    nbits, k = max(len(hashes) * bits, 64) + 7 & ~7, hash_count(bits)
    data = bytearray(nbits // 8)
    for h in hashes:
        step = (h >> 17 | h << 15) & MASK
        for i in range(k):
            bit = (h + i * step & MASK) % nbits
            data[bit >> 3] |= 1 << (bit & 7)
    return bytes(data) + bytes([k])
