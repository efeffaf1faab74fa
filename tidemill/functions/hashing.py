"""FNV-1a over 64 bits as a Spark expression, and the key hashes and row checksums made with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: offset basis (as a signed long), and the prime 2^40 + 0x1B3.
FNV_BASIS = 0xCBF29CE484222325 - 2**64
FNV_PRIME_LOW, FNV_PRIME_SHIFT = 0x1B3, 8  # 2^40 is a shift of the upper half by 8


def fnv1a_64(text: Column) -> Column:
    """The hash of the UTF-8 bytes of ``text`` as a signed long; null stays null.

    The product is formed in halves of 32 bits, so that no step overflows.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.filter(F.sequence(F.lit(0), F.length(digits).cast("int")), lambda i: (i % 2 == 0) & (i < F.length(digits)))
    data = F.transform(places, lambda i: F.conv(F.substring(digits, i + 1, F.lit(2)), 16, 10).cast("long"))
    half = F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low = x.bitwiseAND(half) * FNV_PRIME_LOW
        high = F.shiftrightunsigned(x, 32) * FNV_PRIME_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x, FNV_PRIME_SHIFT).bitwiseAND(half)
        return F.shiftleft(high.bitwiseAND(half), 32).bitwiseOR(low.bitwiseAND(half))

    return F.aggregate(data, F.lit(FNV_BASIS), step)


def key_hash(*keys: str) -> Column:
    """The hash of a window's keys: null is \\x01, a value \\x02 and its text, \\x00 stands between; 0 without keys."""
    if not keys:
        return F.lit(0).cast("long")
    marked = [F.coalesce(F.concat(F.lit("\x02"), F.col(k).cast("string")), F.lit("\x01")) for k in keys]
    return fnv1a_64(F.concat_ws("\x00", *marked))


def row_checksum(*columns: str, decimals: dict[str, int] | None = None) -> Column:
    """The hash of a row's canonical text: its columns joined by ``|``, some with fixed decimals."""
    places = decimals or {}
    return fnv1a_64(F.concat_ws("|", *[F.format_string(f"%.{places[c]}f", F.col(c)) if c in places else F.col(c).cast("string") for c in columns]))
