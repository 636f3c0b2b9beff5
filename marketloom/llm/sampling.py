"""Bounded samples by a hash of the id: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_of(wanted: int, rows: int) -> float:
    """The share of ``rows`` that gives ``wanted`` of them, or all."""
    return min(1.0, wanted / max(1, rows))


def picked(share: Column | float, *key: Column | str) -> Column:
    """Whether a row with this key is in a sample of ``share``: 53 bits of its hash as a number from 0 to 1, so no share is too small."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53) < share
