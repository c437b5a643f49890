"""A 32-bit multiplicative hash of bytes, in column arithmetic that stays within BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
SEED = 0xBC9F1D34
FACTOR = 0xC6A4A793
MASK = 0xFFFFFFFF


def _times(h: Column) -> Column:
    """h * FACTOR modulo 2**32, by halves, so that no product leaves 64 bits."""
    high = F.shiftleft((F.shiftrightunsigned(h, 16) * FACTOR) % 65536, 16)
    return (h.bitwiseAND(65535) * FACTOR + high).bitwiseAND(MASK)


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")


def hash32(data: Column | str) -> Column:
    """Words of four bytes, little-endian, are added and multiplied in; then the rest, and a last mixing of it."""
    data = F.col(data) if isinstance(data, str) else data
    n = F.octet_length(data)
    start = F.lit(SEED).bitwiseXOR((n.cast("long") * FACTOR).bitwiseAND(MASK))
    whole = F.floor(n / 4).cast("int")

    def word(h: Column, i: Column) -> Column:
        four = sum((F.shiftleft(_byte(data, i * 4 - 3 + j), 8 * j) for j in range(4)), F.lit(0).cast("long"))
        h = _times((h + four).bitwiseAND(MASK))
        return h.bitwiseXOR(F.shiftrightunsigned(h, 16))

    words = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(words, start, word)
    left = n % 4
    rest = sum((F.when(left > j, F.shiftleft(_byte(data, whole * 4 + 1 + j), 8 * j)).otherwise(F.lit(0).cast("long")) for j in range(3)), F.lit(0).cast("long"))
    mixed = _times((h + rest).bitwiseAND(MASK))
    return F.when(left > 0, mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 24))).otherwise(h)


def hash32_of(data: bytes) -> int:
    """The same of one byte string, on the driver or in a task that writes a file."""
    h = SEED ^ len(data) * FACTOR & MASK
    for at in range(0, len(data) - 3, 4):
        h = (h + int.from_bytes(data[at : at + 4], "little")) * FACTOR & MASK
        h ^= h >> 16
    if rest := data[len(data) & ~3 :]:
        h = (h + int.from_bytes(rest, "little")) * FACTOR & MASK
        h ^= h >> 24
    return h
