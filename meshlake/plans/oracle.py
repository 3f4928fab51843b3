"""Pieces of DuckDB SQL for the same fixtures and formulas, written independently of the column expressions."""

from __future__ import annotations

from meshlake.sources.fixtures import TEMPLATES


def template(kind: str, prefix: str = "") -> str:
    """CTEs ``<prefix>vertices`` and ``<prefix>triangles`` of a fixture, and ``<prefix>corners``."""
    points, faces = TEMPLATES[kind]
    v = ", ".join(f"({n}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for n, (x, y, z) in enumerate(points))
    t = ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate(faces))
    return f"""
{prefix}vertices AS (
  SELECT p_partkey AS mesh_id, CAST(0 AS INT) AS part_id, CAST(vertex_id AS INT) AS vertex_id,
    tx * CAST(p_size AS DOUBLE) AS x, ty * CAST(1 + p_partkey % 7 AS DOUBLE) AS y, tz * CAST(1 + p_partkey % 5 AS DOUBLE) AS z
  FROM part, (VALUES {v}) AS tv(vertex_id, tx, ty, tz)
), {prefix}triangles AS (
  SELECT p_partkey AS mesh_id, CAST(0 AS INT) AS part_id, CAST(triangle_id AS INT) AS triangle_id, CAST(v0 AS INT) AS v0, CAST(v1 AS INT) AS v1, CAST(v2 AS INT) AS v2
  FROM part, (VALUES {t}) AS tt(triangle_id, v0, v1, v2)
), {prefix}corners AS (
  SELECT t.mesh_id, t.part_id, t.triangle_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM {prefix}triangles t
  JOIN {prefix}vertices a ON a.mesh_id = t.mesh_id AND a.vertex_id = t.v0
  JOIN {prefix}vertices b ON b.mesh_id = t.mesh_id AND b.vertex_id = t.v1
  JOIN {prefix}vertices c ON c.mesh_id = t.mesh_id AND c.vertex_id = t.v2
)"""


SOUP = """
points AS (
  SELECT l_orderkey AS mesh_id, CAST(l_linenumber AS INT) AS triangle_id, CAST(min(l_quantity) AS DOUBLE) AS x,
    CAST(min(l_discount) AS DOUBLE) * 100 AS y, CAST(min(l_tax) AS DOUBLE) * 100 AS z
  FROM lineitem GROUP BY 1, 2
), strip AS (
  SELECT mesh_id, triangle_id, x AS ax, y AS ay, z AS az,
    lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(z, 1) OVER w AS bz,
    lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(z, 2) OVER w AS cz
  FROM points WINDOW w AS (PARTITION BY mesh_id ORDER BY triangle_id)
), soup AS (SELECT * FROM strip WHERE cx IS NOT NULL)"""

CLOUD = """
cloud AS (
  SELECT CAST(0 AS BIGINT) AS mesh_id, CAST(label AS INT) AS part_id, vec_id AS vertex_id,
    CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings
)"""

V = tuple[str, str, str]


def v(prefix: str) -> V:
    return f"{prefix}x", f"{prefix}y" + ("_" if prefix == "b" else ""), f"{prefix}z"


def add(a: V, b: V) -> V:
    return tuple(f"({p} + {q})" for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: V, b: V) -> V:
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def mul(a: V, k: str) -> V:
    return tuple(f"({p} * {k})" for p in a)  # type: ignore[return-value]


def div(a: V, k: str) -> V:
    return tuple(f"({p} / nullif({k}, 0))" for p in a)  # type: ignore[return-value]


def dot(a: V, b: V) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a: V, b: V) -> V:
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def length(a: V) -> str:
    return f"sqrt({dot(a, a)})"


def names(a: V, prefix: str, wrap=lambda x: x) -> str:
    return ", ".join(f"{wrap(x)} AS {prefix}{axis}" for x, axis in zip(a, "xyz", strict=True))


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


A, B, C = v("a"), v("b"), v("c")
NORMAL = cross(sub(B, A), sub(C, A))
AREA = f"(0.5 * {length(NORMAL)})"
VOLUME = f"({dot(A, cross(B, C))} / 6)"
RADIUS = "power(3 * abs({}) / (4 * 3.14159265::DOUBLE), 1.0::DOUBLE / 3)"


def segment(p: V, s: V, t: V) -> str:
    ba, bc = sub(p, t), sub(s, t)
    reach = f"({dot(ba, bc)} / nullif({length(bc)}, 0))"
    return f"CASE WHEN {reach} IS NULL OR {reach} < 0 OR {reach} > {length(bc)} THEN 'inf'::DOUBLE ELSE sqrt(greatest(0.0, {dot(ba, ba)} - {reach} * {reach})) END"


def side(p: V, plane: str = "", eps: str = "1e-6") -> str:
    value = f"({dot(p, (plane + 'a', plane + 'b', plane + 'c'))} + {plane}d)"
    return f"CASE WHEN {value} > {eps} THEN 1 WHEN {value} < -{eps} THEN -1 ELSE 0 END"


def point_triangle(rows: str, keep: str) -> str:
    """CTEs from ``rows`` (with p, a, b, c) to ``measured``: columns ``keep`` and the distance ``d``."""
    p = v("p")
    e, f = sub(C, A), sub(B, A)
    return f"""
pt1 AS (SELECT *, {names(div(NORMAL, length(NORMAL)), 'n')} FROM {rows}),
pt2 AS (SELECT *, {dot(v('n'), sub(p, A))} AS off FROM pt1),
pt3 AS (SELECT *, {names(sub(sub(p, mul(v('n'), 'off')), A), 'g')} FROM pt2),
pt4 AS (SELECT *, {dot(e, e)} AS ee, {dot(e, f)} AS ef, {dot(e, v('g'))} AS eg, {dot(f, f)} AS ff, {dot(f, v('g'))} AS fg FROM pt3),
pt5 AS (SELECT *, (ff * eg - ef * fg) / nullif(ee * ff - ef * ef, 0) AS bu, (ee * fg - ef * eg) / nullif(ee * ff - ef * ef, 0) AS bv FROM pt4),
measured AS (SELECT {keep}, coalesce(bu >= 0 AND bv >= 0 AND bu + bv <= 1, false) AS inside, CASE WHEN off IS NOT NULL AND coalesce(bu >= 0 AND bv >= 0 AND bu + bv <= 1, false) THEN abs(off)
  ELSE least({segment(p, A, B)}, {segment(p, B, C)}, {segment(p, C, A)}, {length(sub(p, A))}, {length(sub(p, B))}, {length(sub(p, C))}) END AS d FROM pt5)"""


def crossing(p: V, q: V, margin: str = "1e-3") -> str:
    """Whether a segment crosses the triangle a, b, c, in terms of signed volumes: both ends on different sides, and the line inside."""

    def vol(w: V, x: V, y: V, z: V) -> str:
        return dot(sub(x, w), cross(sub(y, w), sub(z, w)))

    h0, h1 = dot(sub(p, A), NORMAL), dot(sub(q, A), NORMAL)
    t = f"({length(sub(q, p))} * {h0} / nullif({h0} - {h1}, 0))"
    s = [vol(p, q, A, B), vol(p, q, B, C), vol(p, q, C, A)]
    same = f"(({s[0]} >= 0 AND {s[1]} >= 0 AND {s[2]} >= 0) OR ({s[0]} <= 0 AND {s[1]} <= 0 AND {s[2]} <= 0))"
    return f"({same} AND {t} > {margin} AND {t} < {length(sub(q, p))} - {margin})"
