"""Scalar geometry as Columns, all inside code generation. Points are given by the names of their x, y, z columns' prefix:
point("a") reads a_x, a_y, a_z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def point(prefix: str) -> Vec:
    return tuple(F.col(f"{prefix}_{k}") for k in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return F.sqrt(dot(d, d))


def surface_distance(a: Vec, ra: Column, b: Vec, rb: Column) -> Column:
    """Between the balls' surfaces; negative where they overlap."""
    return distance(a, b) - ra - rb


def overlap(gap: Column) -> Column:
    return F.greatest(-gap, F.lit(0.0))


def aw_offset(d: Column, ra: Column, rb: Column) -> Column:
    """From a's centre towards b's, where the additively weighted bisector crosses the line of centres."""
    return (d + ra - rb) / 2


def pow_offset(d: Column, ra: Column, rb: Column) -> Column:
    """The same for the power bisector (a plane)."""
    return d / 2 - (rb * rb - ra * ra) / (2 * d)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    n = cross(sub(b, a), sub(c, a))
    return F.sqrt(dot(n, n)) / 2


def tetra_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return F.abs(dot(sub(a, d), cross(sub(b, d), sub(c, d)))) / 6


def angle(a: Vec, apex: Vec, b: Vec) -> Column:
    """At apex, in radians; null where a side has no length."""
    u, v = sub(a, apex), sub(b, apex)
    cos = F.try_divide(dot(u, v), F.sqrt(dot(u, u) * dot(v, v)))
    return F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))


def sphericity(volume: Column, area: Column) -> Column:
    return F.try_divide(F.pow(F.lit(3.141592653589793), F.lit(1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)), area)


def isoperimetric_quotient(volume: Column, area: Column) -> Column:
    return F.try_divide(36 * 3.141592653589793 * volume * volume, F.pow(area, F.lit(3.0)))


def helfrich_energy(int_h2: Column, int_h: Column, area: Column, kappa: float = 1.0, c0: float = 0.0) -> Column:
    """kappa / 2 times the integral of (2 H - c0) ** 2; with the defaults, twice the integral of H ** 2."""
    return kappa / 2 * (4 * int_h2 - 4 * c0 * int_h + c0 * c0 * area)


def morphometric_energy(volume: Column, area: Column, int_h: Column, int_k: Column, p: float, sigma: float, kappa: float, kappa_bar: float) -> Column:
    return p * volume + sigma * area + kappa * int_h + kappa_bar * int_k


def cap_area(radius: Column, other: Column, d: Column) -> Column:
    """Of the part of a sphere inside another one whose centre is d away."""
    h = (other * other - (d - radius) * (d - radius)) / (2 * d)
    return 2 * 3.141592653589793 * radius * F.least(F.greatest(h, F.lit(0.0)), 2 * radius)
