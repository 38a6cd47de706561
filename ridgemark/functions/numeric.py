"""Sigmoid, rounding, geometry and small-array expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.settings import INV_SIGMA_D, NP_MIN, NP_MU, NP_TAU, RHO_ANGLE, RHO_DIST


def sigmoid(v: Column, mu: float, tau: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(tau)) * (F.lit(float(mu)) - v)))


def millionths(v: Column) -> Column:
    """A similarity as a whole number of millionths.

    Sums, ranks and distinctness of similarities are all taken on this
    integer, so no result depends on the order in which rows arrive.
    """
    return F.floor((v + 1e-9) * 1e6 + 0.5).cast("bigint")


def rounded(v: Column, digits: int = 6) -> Column:
    scale = float(10 ** digits)
    return F.floor((v + 1e-9) * scale + 0.5) / scale


def np_expr(n_a: Column, n_b: Column, np_fn=None) -> Column:
    """Number of local matches averaged for a pair of fingerprints.

    ``np_fn`` maps the smaller size to another count, for instance the wider
    4..12 range of the published cylinder-code paper.
    """
    smaller = F.least(n_a, n_b)
    if np_fn is not None:
        return np_fn(smaller)
    return (NP_MIN + F.floor(sigmoid(smaller, NP_MU, NP_TAU) + 0.5)).cast("int")


def square_distance(x1, y1, x2, y2) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segment_distance(cx, cy, ax, ay, bx, by) -> Column:
    """Distance of a point from the segment a–b."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    along, length2 = vx * ux + vy * uy, ux * ux + uy * uy
    ends = F.sqrt(F.least(square_distance(cx, cy, ax, ay), square_distance(cx, cy, bx, by)))
    return (F.when((length2 > 0) & (along >= 0) & (along <= length2),
                   F.abs(vx * uy - vy * ux) / F.sqrt(length2 * F.lit(1.0)))
            .otherwise(ends))


def rho_expr(ta, ia, tb, ib) -> Column:
    """Compatibility of two local matches (ta, ia) and (tb, ib).

    Each argument is a struct column with ``x, y, th``.
    """
    def dist(p, q):
        return F.sqrt(square_distance(p["x"], p["y"], q["x"], q["y"]).cast("double"))

    def direction(p, q):
        return A.relative_direction(p["x"], p["y"], A.radians(p["th"]), q["x"], q["y"])

    def turn(p, q):
        return A.wrapped_diff(A.radians(p["th"]), A.radians(q["th"]))

    d1 = F.abs(dist(ta, tb) - dist(ia, ib))
    d2 = F.abs(A.wrapped_diff(turn(ta, tb), turn(ia, ib)))
    d3 = F.abs(A.wrapped_diff(direction(ta, tb), direction(ia, ib)))
    return sigmoid(d1, *RHO_DIST) * sigmoid(d2, *RHO_ANGLE) * sigmoid(d3, *RHO_ANGLE)


def direction_weights() -> list[float]:
    """Directional contribution for each byte difference −128..127."""
    def area(z):
        return (1 + math.erf(z * 0.707106781)) / 2

    steps = [b * INV_SIGMA_D * math.pi / 128 for b in range(-128, 128)]
    return [area(s + 0.5) - area(s - 0.5) for s in steps]


def top_n(values: Column, n) -> Column:
    """The n largest array entries, largest first, duplicates kept."""
    return F.slice(F.sort_array(values, asc=False), 1, n)


def top_n_distinct(values: Column, n) -> Column:
    return top_n(F.array_distinct(values), n)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def min_position(values: Column) -> Column:
    """Zero-based position of the first smallest entry."""
    return F.array_position(values, F.array_min(values)) - 1


def max_position(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def sort_indexes(values: Column) -> Column:
    """Zero-based positions of the entries in ascending order."""
    tagged = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def without_nulls(values: Column) -> Column:
    return F.array_compact(values)
