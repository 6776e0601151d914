"""Small string hashes as pure expressions. Characters count as code points, so text beyond the basic plane differs from UTF-16 hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))


def _int32(c: Column) -> Column:
    low = F.pmod(c, F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def h31(c: Column) -> Column:
    """31-polynomial hash in 32 bits, absolute value."""
    chars = F.when(F.length(c) > 0, _codes(c)).otherwise(F.array().cast("array<bigint>"))
    return F.abs(F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, x: _int32(h * 31 + x)))


def h31_base36(c: Column) -> Column:
    return F.lower(F.conv(h31(c).cast("string"), 10, 36))


def fnv1a32(c: Column) -> Column:
    """FNV-1a in 32 bits as eight hexadecimal digits."""
    chars = F.when(F.length(c) > 0, _codes(c)).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(chars, F.lit(0x811C9DC5).cast("bigint"), lambda h, x: F.pmod(h.bitwiseXOR(x) * 16777619, F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def sha16(*parts: Column) -> Column:
    """First sixteen hexadecimal digits of SHA-256 over the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)
