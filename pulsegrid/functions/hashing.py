"""32-bit FNV-1a over UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published FNV-1a definition.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619
MASK_32 = 0xFFFFFFFF


def fnv1a32(key: str | Column) -> Column:
    """FNV-1a of a string column as a bigint in ``[0, 2**32)``.

    Re-reading the UTF-8 bytes as Latin-1 turns each byte into one character,
    so ``split`` and ``ascii`` walk the bytes without a Python UDF.
    """
    key = F.col(key) if isinstance(key, str) else key
    one_char_per_byte = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1")
    folded = F.aggregate(
        F.split(one_char_per_byte, ""),
        F.lit(FNV_BASIS).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32)),
    )
    return F.when(key == "", F.lit(FNV_BASIS).cast("bigint")).otherwise(folded)


def fnv1a32_text(key: str) -> int:
    """The same hash of one driver-side string (ring points, tests)."""
    h = FNV_BASIS
    for byte in key.encode("utf-8"):
        h = ((h ^ byte) * FNV_PRIME) & MASK_32
    return h
