"""Digests and 64-bit hashes kept as hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(col: Column) -> Column:
    """The 64 hex digits in a digest's text, lower case; null where there are none or all are zero."""
    hexa = F.lower(F.regexp_extract(col, "[0-9a-fA-F]{64}", 0))
    return F.when((hexa != "") & (hexa != "0" * 64), hexa)


def hash64(col: Column) -> Column:
    """A 64-bit hash in hex text, padded or not, as a bigint; null where it is malformed or zero."""
    text = F.regexp_extract(F.trim(col), "^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    value = F.conv(text, 16, -10).cast("bigint")
    return F.when((text != "") & (value != 0), value)


def bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two bigints."""
    return F.bit_count(a.bitwiseXOR(b))
