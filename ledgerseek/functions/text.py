"""Helpers of block mappers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_zeros(c: Column) -> Column:
    """Without leading zeros; a value of zeros only is one zero."""
    out = F.ltrim(c, F.lit("0"))
    return F.when((out == "") & (c != ""), "0").otherwise(out)


def chunk_map(c: Column, size: int, n: int, name: str = "c") -> Column:
    """Map of the first ``n + 1`` chunks of ``size`` bytes each of a binary column: ``c0``, ``c1``, ... to lower-case hex without leading zeros; chunks that are not there are left out."""
    digits = F.lower(F.hex(c))
    chunks = [(f"{name}{k}", F.substring(digits, 2 * k * size + 1, 2 * size)) for k in range(n + 1)]
    entries = F.array(*(F.when(F.length(v) > 0, F.struct(F.lit(k).alias("k"), trim_zeros(v).alias("v"))) for k, v in chunks))
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def first_chunks(c: Column, size: int, n: int) -> list[Column]:
    """The first ``n + 1`` chunks (numbers 0 to n) of ``size`` characters each; null where there is none."""
    return [F.nullif(F.substring(c, k * size + 1, size), F.lit("")) for k in range(n + 1)]
