"""Fuzzy sets, linguistic labels and scalar transforms, as Column builders and plain functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Triangle:
    """A triangular set; where left or right meets mid, the set is a shoulder that goes on beyond it."""

    left: float
    mid: float
    right: float

    def __call__(self, v: float) -> float:
        if v == self.mid:
            return 1.0
        if self.left < v < self.mid:
            return (v - self.left) / (self.mid - self.left)
        if self.mid < v < self.right:
            return (self.right - v) / (self.right - self.mid)
        return float((v < self.left and self.left == self.mid) or (v > self.right and self.right == self.mid))

    def membership(self, v: Column) -> Column:
        out = F.when(v == self.mid, 1.0)
        if self.left < self.mid:
            out = out.when((v > self.left) & (v < self.mid), (v - self.left) / (self.mid - self.left))
        else:
            out = out.when(v < self.left, 1.0)
        if self.mid < self.right:
            out = out.when((v > self.mid) & (v < self.right), (self.right - v) / (self.right - self.mid))
        else:
            out = out.when(v > self.right, 1.0)
        return out.otherwise(0.0)

    def supports(self, v: Column) -> Column:
        """Within the closed base."""
        return v.between(self.left, self.right)


def partition(lo: float, hi: float, labels: int) -> list[Triangle]:
    """Evenly spread triangles that add up to 1 everywhere between the bounds."""
    if labels < 2:
        raise ValueError("at least two labels are needed")
    half = (hi - lo) / (labels - 1)
    mid = [lo + half * j for j in range(labels)]
    return [Triangle(mid[j] if j == 0 else lo + half * (j - 1), mid[j], mid[j] if j == labels - 1 else lo + half * (j + 1)) for j in range(labels)]


def merge_points(sets: list[Triangle]) -> list[float]:
    """Where one label ends and the next begins."""
    return [b.mid - (b.mid - a.mid) / 2 for a, b in zip(sets, sets[1:])]


def crisp_label(v: Column, points: list[float]) -> Column:
    """The first label whose upper point lies above v; values on a point go up."""
    out = F.when(v < points[0], 0)
    for j, p in enumerate(points[1:], 1):
        out = out.when(v < p, j)
    return out.when(v.isNotNull(), len(points)).otherwise(None).cast("int")


def nominal_code(v: Column, values: tuple[str, ...]) -> Column:
    """Place in the list, -1 if it is not there."""
    return (F.coalesce(F.array_position(F.array(*[F.lit(x) for x in values]), v.cast("string")), F.lit(0)) - 1).cast("int")


def nominal_value(code: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), code)


def nominal_share(code: Column, values: tuple[str, ...]) -> Column:
    """Code as a share of 1; nominal_from_share is the inverse."""
    return code / float(len(values))


def nominal_from_share(share: Column, values: tuple[str, ...]) -> Column:
    return nominal_value(F.floor(share * len(values) + 1e-9).cast("int"), values)


def log_scale(v: Column, lo: float) -> Column:
    """ln of v, shifted to start at 1 where the variable can be negative; 0 for what has no logarithm."""
    x = F.greatest(v - lo + 1, F.lit(1.0)) if lo < 0 else v
    return F.when(x > 0, F.ln(F.when(x > 0, x))).otherwise(0.0)


def log_bounds(lo: float, hi: float) -> tuple[float, float]:
    return (math.log(lo), math.log(hi)) if lo > 0 else (0.0, math.log(hi - lo + 1))


def displaced(sets: list[Triangle], genes: list[float]) -> list[Triangle]:
    """Lateral shift of each set by (gene - 1/2) of the way to the neighbour on that side; ends know one neighbour."""
    out = []
    for j, (s, g) in enumerate(zip(sets, genes)):
        side = max(j - 1, 0) if g < 0.5 else min(j + 1, len(sets) - 1)
        if side == j:
            side = 1 if j == 0 else j - 1
        by = (g - 0.5) * abs(sets[side].mid - s.mid)
        out.append(Triangle(s.left + by, s.mid + by, s.right + by))
    return out


def gray(gene: Column, bits: int) -> Column:
    """Reflected binary code of a gene of [0, 1] in so many bits."""
    n = F.floor(gene * float(2**bits - 1) + 0.5).cast("long")
    return n.bitwiseXOR(F.shiftright(n, 1))


def gray_distance(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(gray(a, bits).bitwiseXOR(gray(b, bits)))


def gray_distance_of(a: float, b: float, bits: int) -> int:
    x, y = (int(g * (2**bits - 1) + 0.5) for g in (a, b))
    return ((x ^ x >> 1) ^ (y ^ y >> 1)).bit_count()


def blend_bounds(a: Column, b: Column, d: float) -> tuple[Column, Column]:
    """Ends of the interval around a from which a parent-centric blend draws its child."""
    reach = d * F.abs(a - b)
    return F.greatest(F.lit(0.0), a - reach), F.least(F.lit(1.0), a + reach)
