"""Schemas and their checks.

A matrix is its stored scalars, one row each: block row ``bi``, block column
``bj``, place (``r``, ``c``) in the block, value ``v`` and, if complex, ``w``.
Explicit zeros are data. Vectors are (``b``, ``r``, ``v``[, ``w``]) and
multivectors have a column number ``col`` besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ("bi", "bj", "r", "c", "v")
PLACE = ("bi", "bj", "r", "c")


def is_complex(df: DataFrame) -> bool:
    """Whether there is an imaginary part."""
    return "w" in df.columns


def check(df: DataFrame, columns: tuple[str, ...] = ENTRY) -> DataFrame:
    """``df`` if it has the columns, else TypeError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TypeError(f"columns missing: {missing}")
    return df


def same_kind(a: DataFrame, b: DataFrame) -> None:
    """Both real or both complex, else TypeError."""
    if is_complex(a) != is_complex(b):
        raise TypeError("operands must both be real or both be complex")


class Cx:
    """A pair of columns as a complex number; ``im`` None is real."""

    def __init__(self, re: Column, im: Column | None = None):
        self.re, self.im = re, im

    def __mul__(self, o: Cx) -> Cx:
        if self.im is None and o.im is None:
            return Cx(self.re * o.re)
        a, b = self.im if self.im is not None else F.lit(0.0), o.im if o.im is not None else F.lit(0.0)
        return Cx(self.re * o.re - a * b, self.re * b + a * o.re)

    def conj(self) -> Cx:
        return Cx(self.re, None if self.im is None else -self.im)

    def abs2(self) -> Column:
        return self.re * self.re if self.im is None else self.re * self.re + self.im * self.im

    def sums(self) -> list[Column]:
        return [F.sum(self.re).alias("v")] + ([] if self.im is None else [F.sum(self.im).alias("w")])

    def columns(self) -> list[Column]:
        return [self.re.alias("v")] + ([] if self.im is None else [self.im.alias("w")])


def value(df: DataFrame, prefix: str = "") -> Cx:
    """The value of a matrix or vector row, its columns optionally prefixed."""
    return Cx(F.col(f"{prefix}v"), F.col(f"{prefix}w") if is_complex(df) else None)


def constant(x: complex) -> Cx:
    """A number as literals."""
    return Cx(F.lit(float(x.real)), F.lit(float(x.imag)) if isinstance(x, complex) else None)
