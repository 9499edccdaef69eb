"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_of(vector: Column) -> Column:
    """The scale of symmetric int8 quantisation: max |x| / 127, and 1e-8 for zeros."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(top == 0, F.lit(1e-8)).otherwise(top / 127.0)


def quantised(vector: Column, scale: Column) -> Column:
    """int8 codes, rounded half to even and clipped to -127..127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / scale).cast("int"))))


def dequantised(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: q * scale)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), F.lit(0).cast("double" if kind == "double" else "bigint"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / (|a| + 1e-9)."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-9))


def half(x: Column) -> Column:
    """A positive number rounded to half precision, half to even: 11 bits, fewer below 2^-14, infinite from 65520 on."""
    power = F.floor(F.log2(x))
    power = F.when(F.pow(F.lit(2.0), power + 1) <= x, power + 1).when(F.pow(F.lit(2.0), power) > x, power - 1).otherwise(power)  # the logarithm isn't exact
    unit = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14)) - 10)
    return F.when(x >= 65520.0, F.lit(float("inf"))).otherwise(F.rint(x / unit) * unit)


def int4_groups(vector: Column, group: int = 32) -> Column:
    """Group-wise int4 simulation: per group of `group` values a scale max |x| / 7 and codes clipped to -7..7, multiplied out.

    Codes are taken from the scale as it is; it is rounded to half precision afterwards, as it is stored.
    """
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(group))

    def one(start: Column) -> Column:
        part = F.transform(F.slice(vector, start, group), lambda x: x.cast("double"))
        top = F.array_max(F.transform(part, F.abs))
        scale = F.when(top == 0, F.lit(1e-8)).otherwise(top / 7.0)
        return F.transform(part, lambda x: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(x / scale))) * half(scale))

    return F.flatten(F.transform(starts, one))
