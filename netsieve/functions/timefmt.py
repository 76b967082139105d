"""Timestamp parsing and conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp layouts, day first as in the CIC flow files.
DAY_FIRST_FORMATS = [
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
]


def parse_ts(c, formats=None) -> Column:
    """P20: first layout that parses wins; text that parses with none is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    fmts = formats or DAY_FIRST_FORMATS
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in fmts])


def epoch_seconds(c) -> Column:
    """Timestamp -> fractional epoch seconds (DOUBLE)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / 1e6
