"""Levels of 16-bit and 32-bit little-endian samples, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_pcm16(samples: Column) -> Column:
    """Samples (ints, -32768 to 32767) as binary."""
    low = F.transform(samples, lambda s: F.lpad(F.hex(F.pmod(s, F.lit(65536)).cast("long")), 4, "0"))
    return F.unhex(F.array_join(F.transform(low, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))


def pack_pcm32(samples: Column) -> Column:
    """Samples (ints) as binary, four bytes each; null without an array of them."""
    digits = F.transform(samples, lambda s: F.lpad(F.hex(F.pmod(s.cast("long"), F.lit(1 << 32))), 8, "0"))
    return F.unhex(F.array_join(F.transform(digits, lambda h: F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])), ""))


def pcm16(data: Column) -> Column:
    """The samples of a binary; half a sample at the end is left out."""
    digits = F.hex(data)
    words = F.regexp_extract_all(digits, F.lit("[0-9A-F]{4}"), F.lit(0))
    value = lambda w: F.conv(F.concat(F.substring(w, 3, 2), F.substring(w, 1, 2)), 16, 10).cast("int")
    return F.transform(words, lambda w: value(w) - F.when(value(w) >= 32768, 65536).otherwise(0))


def pcm32(data: Column) -> Column:
    """The samples of a binary of four bytes each; what is less than a sample at the end is left out."""
    words = F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]{8}"), F.lit(0))
    value = lambda w: F.conv(F.concat(*[F.substring(w, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.transform(words, lambda w: value(w) - F.when(value(w) >= 1 << 31, 1 << 32).otherwise(0))


def rms(data: Column, bits: int = 16) -> Column:
    """Root of the mean square of samples of 16 or 32 bits; 0 without samples, null without data."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    xs = pcm32(data) if bits == 32 else pcm16(data)
    return F.when(F.size(xs) == 0, 0.0).otherwise(F.sqrt(total(xs) / F.size(xs)))
