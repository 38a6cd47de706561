"""Angle encodings and differences as Spark column expressions.

A minutia direction is a signed byte on a 256-step circle. Expressions take
and return columns, so they stay inside code generation.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgemark.settings import DEG_TO_RAD

TWO_PI = 2 * math.pi


def wrap8(v: Column) -> Column:
    """Reduce an integer to the signed byte circle −128..127."""
    return F.shiftright(F.shiftleft(v.cast("int"), 24), 24)


def diff256(a: Column, b: Column) -> Column:
    return wrap8(a - b)


def trunc(v: Column) -> Column:
    """Round a double toward zero (an integer column)."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def encode(file_angle: Column) -> Column:
    """Byte direction of a file angle, which is half the degrees."""
    return wrap8(trunc((file_angle * 512 - 46080) / F.lit(360.0))).cast("int")


def degrees(th: Column) -> Column:
    return F.floor((th + 128) * 360 / F.lit(256.0)).cast("int")


def radians(th: Column) -> Column:
    return degrees(th) * F.lit(DEG_TO_RAD)


def complement(th: Column) -> Column:
    """Clockwise degrees, 360 − direction."""
    return 360 - degrees(th)


def complement_radians(th: Column) -> Column:
    """Clockwise direction moved to −180..180, in radians."""
    return (180 - degrees(th)) * F.lit(DEG_TO_RAD)


def complement_byte(th: Column) -> Column:
    return wrap8(-th)


def folded_diff(a: Column, b: Column) -> Column:
    """Radian difference that folds back to positive values beyond ±π."""
    d = a - b
    return (F.when(d > math.pi, TWO_PI - d)
            .when(d <= -math.pi, TWO_PI + d).otherwise(d))


def wrapped_diff(a: Column, b: Column) -> Column:
    """Radian difference wrapped to [−π, π)."""
    d = a - b
    return (F.when(d < -math.pi, TWO_PI + d)
            .when(d >= math.pi, d - TWO_PI).otherwise(d))


def relative_direction(x1: Column, y1: Column, rad1: Column, x2: Column, y2: Column) -> Column:
    return wrapped_diff(rad1, F.atan2((y1 - y2).cast("double"), (x2 - x1).cast("double")))
