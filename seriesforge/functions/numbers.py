"""Rounding of doubles as C libraries do it: scale, round half away from zero, scale back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column | str, places: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = 10.0**places
    return F.round(c.cast("double") * scale) / scale
