"""Column helpers shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """a / b where b > 0, else the default."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(default))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def sequence_window(*more: str) -> WindowSpec:
    """Rows of a contiguous sequence in time order."""
    return Window.partitionBy("ticker", "seq_id", *more).orderBy("ts")


def last_rows(spec: WindowSpec, n: int) -> WindowSpec:
    """The frame of the current row and the n - 1 before it."""
    return spec.rowsBetween(-(n - 1), Window.currentRow)


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ln(c: Column | str) -> Column:
    """Natural logarithm by IEEE rules: minus infinity of 0, NaN of less, where Spark's own gives null; null of null."""
    c = col(c)
    return F.when(c == 0, F.lit(-math.inf)).when(c < 0, F.lit(math.nan)).otherwise(F.ln(c))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def truncated(c: Column) -> Column:
    """int() of a positive double."""
    return F.floor(c).cast("int")
