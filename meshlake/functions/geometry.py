"""Geometry on points, planes and triangles as column expressions: no UDFs, all of it compiles with the plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances and the constant of the published method.
PLANE_EPS = 1e-6
SAME_POINT_EPS = 1e-5
PI_SHORT = 3.14159265


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


class Vec(NamedTuple):
    """Three columns."""

    x: Column
    y: Column
    z: Column

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def over(self, k: Column) -> Vec:
        """Null where ``k`` is zero."""
        return Vec(*(F.try_divide(c, k) for c in self))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        """Null for the zero vector."""
        return self.over(self.length())

    def columns(self, prefix: str, f=lambda c: c) -> list[Column]:
        return [f(c).alias(f"{prefix}{axis}") for c, axis in zip(self, "xyz", strict=True)]


def vec(prefix: str = "") -> Vec:
    """The vector in columns ``<prefix>x``, ``<prefix>y``, ``<prefix>z``."""
    return Vec(*(F.col(f"{prefix}{axis}") for axis in "xyz"))


def fields(struct: Column) -> Vec:
    return Vec(struct["x"], struct["y"], struct["z"])


class Plane(NamedTuple):
    a: Column
    b: Column
    c: Column
    d: Column

    @property
    def normal(self) -> Vec:
        return Vec(self.a, self.b, self.c)

    def value(self, p: Vec) -> Column:
        return p.dot(self.normal) + self.d

    def side(self, p: Vec, eps: float = PLANE_EPS) -> Column:
        """1, 0 or -1."""
        v = self.value(p)
        return F.when(v > eps, 1).when(v < -eps, -1).otherwise(0)

    def bool_side(self, p: Vec) -> Column:
        return F.when(self.value(p) > 0, 1).otherwise(-1)

    def cut_side(self, a: Vec, b: Vec, c: Vec) -> Column:
        """The side of a triangle that lies in the plane: -1 if any component of its normal agrees in sign with the plane's."""
        n = face_normal(a, b, c)
        agrees = (n.x * self.a > 0) | (n.y * self.b > 0) | (n.z * self.c > 0)
        return F.when(F.coalesce(agrees, F.lit(False)), -1).otherwise(1)

    def cut(self, p: Vec, q: Vec, eps: float = PLANE_EPS) -> tuple[Vec, Column]:
        """Where the line through p and q meets the plane, and whether that is within the segment's box; null and false if parallel."""
        along = q.minus(p)
        t = F.try_divide(-self.value(p), self.normal.dot(along))
        at = p.plus(along.times(t))
        inside = F.lit(True)
        for lo, hi, x in zip(p, q, at, strict=True):
            inside = inside & (F.least(lo, hi) - eps <= x) & (x <= F.greatest(lo, hi) + eps)
        return at, F.coalesce(inside, F.lit(False))


def plane(prefix: str = "") -> Plane:
    return Plane(*(F.col(f"{prefix}{k}") for k in "abcd"))


def bisector(p: Vec, q: Vec) -> Plane:
    """The plane that perpendicularly bisects a segment; null if its ends coincide."""
    n = q.minus(p).unit()
    return Plane(n.x, n.y, n.z, -n.dot(p.plus(q).times(0.5)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return b.minus(a).cross(c.minus(a)).length() * 0.5


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal; null for a degenerate triangle."""
    return b.minus(a).cross(c.minus(a)).unit()


def signed_volume(a: Vec, b: Vec, c: Vec) -> Column:
    """Volume of the tetrahedron with the origin, positive if the triangle is wound outwards."""
    return a.dot(b.cross(c)) / 6


def same_point(p: Vec, q: Vec, eps: float = SAME_POINT_EPS) -> Column:
    d = p.minus(q)
    return (F.abs(d.x) < eps) & (F.abs(d.y) < eps) & (F.abs(d.z) < eps)


def cosine(p: Vec, q: Vec) -> Column:
    return F.try_divide(p.dot(q), p.length() * q.length())


def distance(p: Vec, q: Vec) -> Column:
    return p.minus(q).length()


def point_segment(p: Vec, s: Vec, t: Vec) -> Column:
    """Perpendicular distance to a segment; infinite if the foot lies outside, or the segment is a point."""
    from_end, along = p.minus(t), s.minus(t)
    reach = F.try_divide(from_end.dot(along), along.length())
    outside = reach.isNull() | (reach < 0) | (reach > along.length())
    return F.when(outside, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), from_end.dot(from_end) - reach * reach)))


def point_in_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Barycentric test of a point in the triangle's plane; false if degenerate."""
    e, f, g = c.minus(a), b.minus(a), p.minus(a)
    ee, ef, eg, ff, fg = e.dot(e), e.dot(f), e.dot(g), f.dot(f), f.dot(g)
    det = ee * ff - ef * ef
    u, v = F.try_divide(ff * eg - ef * fg, det), F.try_divide(ee * fg - ef * eg, det)
    return F.coalesce((u >= 0) & (v >= 0) & (u + v <= 1), F.lit(False))


def point_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance to a triangle: to its plane if the foot is inside, else the least over sides and corners."""
    n = face_normal(a, b, c)
    off = n.dot(p.minus(a))
    inside = point_in_triangle(p.minus(n.times(off)), a, b, c)
    around = F.least(
        point_segment(p, a, b), point_segment(p, b, c), point_segment(p, c, a), distance(p, a), distance(p, b), distance(p, c)
    )
    return F.when(off.isNotNull() & inside, F.abs(off)).otherwise(around)


def with_closest(rows: DataFrame, prefix: str = "q", names: str = "abc") -> DataFrame:
    """``rows`` with the closest point of triangle a, b, c (or other ``names``) to point p, by the region of the plane in which the foot falls.

    Done in steps with columns of their own: as one expression, the products would be
    written out so often that it outgrows what a compiled method may hold.
    """
    p, (a, b, c) = vec("p"), (vec(n) for n in names)
    ab, ac = b.minus(a), c.minus(a)
    sides = {f"_{k}": x for k, x in enumerate(
        (ab.dot(p.minus(a)), ac.dot(p.minus(a)), ab.dot(p.minus(b)), ac.dot(p.minus(b)), ab.dot(p.minus(c)), ac.dot(p.minus(c))), 1
    )}
    d1, d2, d3, d4, d5, d6 = (F.col(f"_{k}") for k in range(1, 7))
    areas = {"_va": d3 * d6 - d5 * d4, "_vb": d5 * d2 - d1 * d6, "_vc": d1 * d4 - d3 * d2}
    va, vb, vc = (F.col(n) for n in areas)
    # The point is a + s * ab + t * ac.
    on_bc, total = F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6)), va + vb + vc
    zero, one = F.lit(0.0), F.lit(1.0)
    regions = [
        ((d1 <= 0) & (d2 <= 0), zero, zero),
        ((d3 >= 0) & (d4 <= d3), one, zero),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), F.try_divide(d1, d1 - d3), zero),
        ((d6 >= 0) & (d5 <= d6), zero, one),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, F.try_divide(d2, d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), 1 - on_bc, on_bc),
    ]
    s, t = F.when(regions[0][0], regions[0][1]), F.when(regions[0][0], regions[0][2])
    for test, x, y in regions[1:]:
        s, t = s.when(test, x), t.when(test, y)
    shares = {"_s": s.otherwise(F.try_divide(vb, total)), "_t": t.otherwise(F.try_divide(vc, total))}
    found = a.plus(ab.times(F.col("_s"))).plus(ac.times(F.col("_t")))
    return rows.withColumns(sides).withColumns(areas).withColumns(shares).select(*rows.columns, *found.columns(prefix))


def radius_of_volume(volume: Column) -> Column:
    """Radius of the sphere of that volume (its absolute value), with the shortened constant."""
    return F.pow(F.abs(volume) * 3 / (4 * PI_SHORT), F.lit(1.0 / 3))


def midpoint(p: Vec, q: Vec) -> Vec:
    return p.plus(q).times(0.5)


def on_edge(p: Vec, q: Vec, t: Column) -> Vec:
    """The point at share ``t`` of an edge."""
    return p.plus(q.minus(p).times(t))


def slerp(p: Vec, q: Vec, t: Column | float) -> Vec:
    """Spherical interpolation of unit vectors; linear if they nearly agree."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p.dot(q)))
    angle, t = F.acos(c), _col(t)
    sine = F.sin(angle)
    flat = F.abs(sine) < 1e-12
    left = F.when(flat, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), sine))
    right = F.when(flat, t).otherwise(F.try_divide(F.sin(t * angle), sine))
    return p.times(left).plus(q.times(right))


def pair_of_index(k: Column, n: Column) -> tuple[Column, Column]:
    """Row and column (i < j) of the k-th pair in the upper triangle of an n x n matrix, row by row."""
    n, k = n.cast("double"), k.cast("double")
    i = F.floor((2 * n - 1 - F.sqrt((2 * n - 1) * (2 * n - 1) - 8 * k)) / 2)
    j = k - i * (2 * n - i - 1) / 2 + i + 1
    return i.cast("bigint"), j.cast("bigint")


def with_hits(rows: DataFrame, margin: float = 1e-3) -> DataFrame:
    """``rows`` with ``hit``: whether the segment p, q, less ``margin`` at both ends, crosses the triangle a, b, c (Moeller-Trumbore).

    Sides belong to the triangle, with some room for rounding: a segment through the side of
    two triangles must not slip between them. Done in steps, as :func:`with_closest` is.
    """
    p, q, a, b, c = (vec(n) for n in "pqabc")

    def step(df: DataFrame, **vectors: Vec) -> DataFrame:
        return df.withColumns({f"_{n}{axis}": x for n, v in vectors.items() for x, axis in zip(v, "xyz", strict=True)})

    e, f, s, w, h, m = (vec(f"_{n}") for n in "efswhm")
    df = rows.withColumn("_len", q.minus(p).length())
    df = step(df, e=b.minus(a), f=c.minus(a), s=p.minus(a), w=q.minus(p).over(F.col("_len")))
    df = step(df, h=w.cross(f), m=s.cross(e))
    df = df.withColumn("_det", e.dot(h))
    df = df.withColumns({n: F.try_divide(x, F.col("_det")) for n, x in (("_u", s.dot(h)), ("_v", w.dot(m)), ("_t", f.dot(m)))})
    u, v, t, eps = F.col("_u"), F.col("_v"), F.col("_t"), 1e-9
    hit = (F.abs("_det") > 1e-12) & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t > margin) & (t < F.col("_len") - margin)
    return df.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


def with_point_triangle(rows: DataFrame, name: str = "distance") -> DataFrame:
    """``rows`` with the :func:`point_triangle` distance of point p to triangle a, b, c, in steps."""
    p, a, b, c, n, g = (vec(x) for x in ("p", "a", "b", "c", "_n", "_g"))
    df = rows.withColumns(dict(zip(("_nx", "_ny", "_nz"), face_normal(a, b, c), strict=True)))
    df = df.withColumn("_off", n.dot(p.minus(a)))
    df = df.withColumns(dict(zip(("_gx", "_gy", "_gz"), p.minus(n.times(F.col("_off"))), strict=True)))
    df = df.withColumn("_in", point_in_triangle(g, a, b, c))
    df = df.withColumns({f"_s{k}": point_segment(p, s, t) for k, (s, t) in enumerate(((a, b), (b, c), (c, a)))})
    around = F.least("_s0", "_s1", "_s2", distance(p, a), distance(p, b), distance(p, c))
    return df.select(*rows.columns, F.when(F.col("_off").isNotNull() & F.col("_in"), F.abs("_off")).otherwise(around).alias(name))
