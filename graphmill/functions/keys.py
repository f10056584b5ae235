"""Column builders for loosely written keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as surrounding blanks of an id.
BLANKS = " \t\n\r\x0b\x0c  　﻿"


def trimmed(col: str | Column) -> Column:
    """`col` without surrounding blanks, line ends and tabs included."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def norm_id(col: str | Column) -> Column:
    """An id trimmed and in lower case; null when null or blank, so that it refers to nothing."""
    t = F.lower(trimmed(col))
    return F.when(t != "", t)


def nonblank(col: str | Column) -> Column:
    """`col` unchanged, or null when nothing but blanks stands in it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(trimmed(c) != "", c)
