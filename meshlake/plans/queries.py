"""Registered queries over the derived meshes, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.config import Config
from meshlake.functions import geometry as g
from meshlake.functions.geometry import Vec, vec
from meshlake.operators import aggregates as agg
from meshlake.operators import graphs
from meshlake.operators import lattice
from meshlake.operators import relations as rel
from meshlake.operators import solids
from meshlake.plans import oracle as o
from meshlake.sources import fixtures as fx
from meshlake.sources import meshes, obj

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class _Later:
    """A vector whose columns are made when they are used: there is no session yet when this module is read."""

    def __init__(self, make: Callable[[], Vec]):
        self._make = make

    def __getattr__(self, name: str):
        return getattr(self._make(), name)

    def __iter__(self):
        return iter(self._make())

    def __getitem__(self, k: int):
        return self._make()[k]


A, B, C = (_Later(lambda p=p: vec(p)) for p in "abc")
MESH, PART = agg.MESH, agg.PART


def query(name: str, sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            meshes.planned(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def r6(c: Column) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _corners(spark: SparkSession, d: str, kind: str) -> DataFrame:
    # A mesh of a fixture is one part, and lies in the task that it was dealt to: joined by mesh, none is dealt again.
    return agg.corners(fx.triangles(spark, d, kind), fx.vertices(spark, d, kind), MESH).withColumn("part_id", F.lit(0))


#: Scale factors of each part's mesh, and half the largest extent of its L-prism, by which that is normalised.
_SIZES = """sizes AS (SELECT *, greatest(2 * sx, 2 * sy, sz) / 2 AS half FROM (SELECT p_partkey AS mesh_id, CAST(p_size AS DOUBLE) AS sx, CAST(1 + p_partkey % 7 AS DOUBLE) AS sy, CAST(1 + p_partkey % 5 AS DOUBLE) AS sz FROM part))"""
#: How far the L-prism and its hull are from each other, in normalised units: the slanted side from the notch, or the notch from that side or a cap.
_GAP = "greatest(sx * sy / (sx + sy), least(sx * sy / sqrt(sx * sx + sy * sy), sz / 2)) / half"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """The same in Spark: ``mesh_id, sx, sy, sz, half, gap``."""
    rows = fx.vertices(spark, d, "lprism").groupBy("mesh_id").agg(*[(F.max(a) / n).alias(f"s{a}") for a, n in zip("xyz", (2, 2, 1), strict=True)])
    rows = rows.withColumn("half", F.greatest(F.col("sx") * 2, F.col("sy") * 2, "sz") / 2)
    slant, x, y = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")), F.col("sx"), F.col("sy")
    return rows.withColumn("gap", F.greatest(x * y / (x + y), F.least(x * y / slant, F.col("sz") / 2)) / F.col("half"))


def _soup(sql: str) -> str:
    return f"WITH {o.SOUP} {sql}"


def _mesh(kind: str, sql: str, more: str = "") -> str:
    return f"WITH {o.template(kind)}{more} {sql}"


def _ids(sql: str) -> str:
    return f"SELECT mesh_id, triangle_id, {sql} FROM soup"


def _plane_of_soup() -> g.Plane:
    """The plane of the fixture: x + 2y - z = 30, not normalised."""
    return g.Plane(F.lit(1.0), F.lit(2.0), F.lit(-1.0), F.lit(-30.0))


_PLANE = "1.0::DOUBLE AS a, 2.0::DOUBLE AS b, -1.0::DOUBLE AS c, -30.0::DOUBLE AS d"
_PROBE = _Later(lambda: Vec(F.lit(20.0), F.lit(5.0), F.lit(3.0)))
_PROBE_SQL = "20.0::DOUBLE AS px, 5.0::DOUBLE AS py, 3.0::DOUBLE AS pz"

# --- scalar functions --------------------------------------------------------


@query(
    "b1_vector_algebra",
    _soup(_ids(", ".join([
        o.names(o.add(o.A, o.B), "sum_", o.r6), o.names(o.sub(o.A, o.B), "diff_", o.r6), f"{o.r6(o.dot(o.A, o.B))} AS dot",
        o.names(o.cross(o.A, o.B), "cross_", o.r6), f"{o.r6(o.length(o.A))} AS length", o.names(o.div(o.A, o.length(o.A)), "unit_", o.r6)]))),
)
def b1(spark, d):
    return fx.soup(spark, d).select(
        "mesh_id", "triangle_id", *A.plus(B).columns("sum_", r6), *A.minus(B).columns("diff_", r6), r6(A.dot(B)).alias("dot"),
        *A.cross(B).columns("cross_", r6), r6(A.length()).alias("length"), *A.unit().columns("unit_", r6),
    )


@query("b2_triangle_area", _soup(_ids(f"{o.r6(o.AREA)} AS area")))
def b2(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", r6(g.triangle_area(A, B, C)).alias("area"))


@query("b3_face_normal", _soup(_ids(o.names(o.div(o.NORMAL, o.length(o.NORMAL)), "n", o.r6))))
def b3(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", *g.face_normal(A, B, C).columns("n", r6))


@query("b4_plane_side", _soup(f"SELECT mesh_id, triangle_id, {o.side(o.A)} AS side FROM (SELECT *, {_PLANE} FROM soup)"))
def b4(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", _plane_of_soup().side(A).alias("side"))


@query("b5_bool_side", _soup("SELECT mesh_id, triangle_id, CASE WHEN ax + 2 * ay - az - 30 > 0 THEN 1 ELSE -1 END AS side FROM soup"))
def b5(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", _plane_of_soup().bool_side(A).alias("side"))


@query(
    "b6_cut_side",
    _soup(f"SELECT mesh_id, triangle_id, CASE WHEN nx > 0 OR ny > 0 OR nz < 0 THEN -1 ELSE 1 END AS side FROM (SELECT *, {o.names(o.NORMAL, 'n')} FROM soup)"),
)
def b6(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", _plane_of_soup().cut_side(A, B, C).alias("side"))


@query("b7_segment_plane", _soup(f"""SELECT mesh_id, triangle_id,
  coalesce({' AND '.join(f'least({p}, {q}) - 1e-6 <= {i} AND {i} <= greatest({p}, {q}) + 1e-6' for p, q, i in zip(o.A, o.B, o.v('i'), strict=True))}, false) AS inside,
  {', '.join(f'{o.r6(i)} AS {i}' for i in o.v('i'))}
FROM (SELECT *, {o.names(o.add(o.A, o.mul(o.sub(o.B, o.A), 't')), 'i')}
  FROM (SELECT *, -(ax + 2 * ay - az - 30) / nullif((bx - ax) + 2 * (by_ - ay) - (bz - az), 0) AS t FROM soup))"""))
def b7(spark, d):
    at, inside = _plane_of_soup().cut(A, B)
    return fx.soup(spark, d).select("mesh_id", "triangle_id", inside.alias("inside"), *at.columns("i", r6))


@query("b8_same_point", _soup(_ids("abs(ax - bx) < 1e-5 AND abs(ay - by_) < 1e-5 AND abs(az - bz) < 1e-5 AS same")))
def b8(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", g.same_point(A, B).alias("same"))


@query("b9_point_segment", _soup(f"SELECT mesh_id, triangle_id, {o.r6('nullif(h, CAST(chr(105) || chr(110) || chr(102) AS DOUBLE))')} AS distance, h = 'inf'::DOUBLE AS outside FROM (SELECT *, {o.segment(o.A, o.B, o.C)} AS h FROM soup)"))
def b9(spark, d):
    h = g.point_segment(A, B, C)
    outside = h == float("inf")
    return fx.soup(spark, d).select("mesh_id", "triangle_id", r6(F.when(~outside, h)).alias("distance"), outside.alias("outside"))


@query("b10_point_in_triangle", f"WITH {o.SOUP}, probed AS (SELECT *, {_PROBE_SQL} FROM soup), {o.point_triangle('probed', 'mesh_id, triangle_id')} SELECT mesh_id, triangle_id, inside FROM measured")
def b10(spark, d):
    n = g.face_normal(A, B, C)
    foot = _PROBE.minus(n.times(n.dot(_PROBE.minus(A))))
    return fx.soup(spark, d).select("mesh_id", "triangle_id", g.point_in_triangle(foot, A, B, C).alias("inside"))


@query("b11_point_triangle", f"WITH {o.SOUP}, probed AS (SELECT *, {_PROBE_SQL} FROM soup), {o.point_triangle('probed', 'mesh_id, triangle_id')} SELECT mesh_id, triangle_id, {o.r6('d')} AS distance FROM measured")
def b11(spark, d):
    rows = g.with_point_triangle(fx.soup(spark, d).select("*", *_PROBE.columns("p")))
    return rows.select("mesh_id", "triangle_id", r6(F.col("distance")).alias("distance"))


def _closest_sql(rows: str, keep: str) -> str:
    """CTEs to ``closest``: the closest point qx, qy, qz of triangle a, b, c to p, by region."""
    p = o.v("p")
    ab, ac, pa, pb, pc = o.sub(o.B, o.A), o.sub(o.C, o.A), o.sub(p, o.A), o.sub(p, o.B), o.sub(p, o.C)
    d = {1: o.dot(ab, pa), 2: o.dot(ac, pa), 3: o.dot(ab, pb), 4: o.dot(ac, pb), 5: o.dot(ab, pc), 6: o.dot(ac, pc)}
    spots = [
        ("d1 <= 0 AND d2 <= 0", o.A), ("d3 >= 0 AND d4 <= d3", o.B), ("vc <= 0 AND d1 >= 0 AND d3 <= 0", o.add(o.A, o.mul(ab, "(d1 / nullif(d1 - d3, 0))"))),
        ("d6 >= 0 AND d5 <= d6", o.C), ("vb <= 0 AND d2 >= 0 AND d6 <= 0", o.add(o.A, o.mul(ac, "(d2 / nullif(d2 - d6, 0))"))),
        ("va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0", o.add(o.B, o.mul(o.sub(o.C, o.B), "((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0))"))),
    ]
    inside = o.add(o.add(o.A, o.mul(ab, "(vb / nullif(va + vb + vc, 0))")), o.mul(ac, "(vc / nullif(va + vb + vc, 0))"))
    cases = ", ".join("CASE " + " ".join(f"WHEN {w} THEN {s[k]}" for w, s in spots) + f" ELSE {inside[k]} END AS q{'xyz'[k]}" for k in range(3))
    return f"""
cl1 AS (SELECT *, {', '.join(f'{x} AS d{k}' for k, x in d.items())} FROM {rows}),
cl2 AS (SELECT *, d3 * d6 - d5 * d4 AS va, d5 * d2 - d1 * d6 AS vb, d1 * d4 - d3 * d2 AS vc FROM cl1),
closest AS (SELECT {keep}, {cases} FROM cl2)"""


@query("b12_closest_on_triangle", f"WITH {o.SOUP}, probed AS (SELECT *, {_PROBE_SQL} FROM soup), {_closest_sql('probed', 'mesh_id, triangle_id')} SELECT mesh_id, triangle_id, {', '.join(f'{o.r6(x)} AS {x}' for x in o.v('q'))} FROM closest")
def b12(spark, d):
    rows = g.with_closest(fx.soup(spark, d).select("*", *_PROBE.columns("p")))
    return rows.select("mesh_id", "triangle_id", *vec("q").columns("q", r6))


@query("b13_subdivide_edge", _soup(f"SELECT mesh_id, triangle_id, CAST(k AS INT) AS k, {o.names(o.add(o.A, o.mul(o.sub(o.B, o.A), '(k / 4.0::DOUBLE)')), 'e', o.r6)} FROM soup, range(5) AS r(k)"))
def b13(spark, d):
    rows = fx.soup(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return rows.select("mesh_id", "triangle_id", "k", *g.on_edge(A, B, F.col("k") / 4.0).columns("e", r6))


@query("b13_slerp", _soup(f"""SELECT mesh_id, triangle_id, {o.names(o.add(o.mul(o.v('u'), '(sin(0.75 * w) / sin(w))'), o.mul(o.v('v'), '(sin(0.25 * w) / sin(w))')), 's', o.r6)}
FROM (SELECT *, acos(greatest(-1.0, least(1.0, ux * vx + uy * vy + uz * vz))) AS w FROM (SELECT *, {o.names(o.div(o.A, o.length(o.A)), 'u')}, {o.names(o.div(o.B, o.length(o.B)), 'v')} FROM soup)) WHERE abs(sin(w)) > 1e-6"""))
def b13s(spark, d):
    rows = fx.soup(spark, d).select("mesh_id", "triangle_id", *A.unit().columns("u"), *B.unit().columns("v"))
    w = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec("u").dot(vec("v")))))
    return rows.where(F.abs(F.sin(w)) > 1e-6).select("mesh_id", "triangle_id", *g.slerp(vec("u"), vec("v"), 0.25).columns("s", r6))


@query("b14_cosine", _soup(_ids(f"{o.r6(f'{o.dot(o.A, o.B)} / nullif({o.length(o.A)} * {o.length(o.B)}, 0)')} AS cosine")))
def b14(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", r6(g.cosine(A, B)).alias("cosine"))


@query("b15_radius_of_volume", _soup(_ids(f"{o.r6(o.RADIUS.format('ax * ay - az'))} AS radius")))
def b15(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", r6(g.radius_of_volume(F.col("ax") * F.col("ay") - F.col("az"))).alias("radius"))


@query("b16_pair_of_index", "SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS k, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM range(200) AS a(i), range(200) AS b(j) WHERE i < j")
def b16(spark, d):
    i, j = g.pair_of_index(F.col("id"), F.lit(200))
    return spark.range(200 * 199 // 2).select(F.col("id").alias("k"), i.alias("i"), j.alias("j"))


# --- aggregations ------------------------------------------------------------

_BOX = ", ".join(f"{m}({a}) AS {m}_{a}" for m in ("min", "max") for a in "xyz")


@query("c1_bounding_box", _mesh("lprism", f"SELECT mesh_id, {', '.join(o.r6(f'{m}({a})') + f' AS {m}_{a}' for m in ('min', 'max') for a in 'xyz')} FROM vertices GROUP BY mesh_id"))
def c1(spark, d):
    return _rounded(agg.bounding_box(fx.vertices(spark, d, "lprism"), MESH))


_SIDE = "greatest(max_x - min_x, max_y - min_y, max_z - min_z)"
_NORMED = ", ".join(f"2 * (p.{a} - (max_{a} + min_{a}) / 2) / nullif({_SIDE}, 0) AS {a}" for a in "xyz")


@query("c2_normalize", _mesh("lprism", f"SELECT mesh_id, vertex_id, {', '.join(o.r6(a) + f' AS {a}' for a in 'xyz')} FROM (SELECT p.mesh_id, vertex_id, {_NORMED} FROM vertices p JOIN box USING (mesh_id))", f", box AS (SELECT mesh_id, {_BOX} FROM vertices GROUP BY mesh_id)"))
def c2(spark, d):
    v = fx.vertices(spark, d, "lprism").drop("part_id")
    return _rounded(agg.normalize(v, agg.bounding_box(v, MESH)))


@query("c3_normalize_points", _mesh("lprism", f"SELECT mesh_id, vertex_id, {', '.join(o.r6(a) + f' AS {a}' for a in 'xyz')} FROM (SELECT p.mesh_id, vertex_id, {_NORMED} FROM cage_vertices p JOIN box USING (mesh_id))", f", {o.template('cage', 'cage_')}, box AS (SELECT mesh_id, {_BOX} FROM vertices GROUP BY mesh_id)"))
def c3(spark, d):
    box = agg.bounding_box(fx.vertices(spark, d, "lprism"), MESH)
    return _rounded(agg.normalize(fx.vertices(spark, d, "cage").drop("part_id"), box))


@query("c4_unnormalize", _mesh("lprism", f"SELECT mesh_id, vertex_id, {', '.join(o.r6(a) + f' AS {a}' for a in 'xyz')} FROM vertices"))
def c4(spark, d):
    v = fx.vertices(spark, d, "lprism").drop("part_id")
    box = agg.bounding_box(v, MESH)
    return _rounded(agg.unnormalize(agg.normalize(v, box), box))


@query("c5_mesh_volume", _mesh("lprism", f"SELECT mesh_id, {o.r6(f'sum({o.VOLUME})')} AS volume, {o.r6(f'sum({o.AREA})')} AS area, count(*) AS n_triangles FROM corners GROUP BY mesh_id"))
def c5(spark, d):
    return _rounded(agg.measures(_corners(spark, d, "lprism"), MESH))


def _volumes(kind: str, prefix: str = "") -> str:
    return f"SELECT mesh_id, sum({o.VOLUME}) AS volume FROM {prefix}corners GROUP BY mesh_id"


@query("c6_volume_radius", f"WITH {o.template('lprism')}, {o.template('box', 'box_')} SELECT mesh_id, {o.r6(o.RADIUS.format('l.volume - b.volume'))} AS rv FROM ({_volumes('lprism')}) l JOIN ({_volumes('box', 'box_')}) b USING (mesh_id)")
def c6(spark, d):
    one, two = (agg.measures(_corners(spark, d, kind), MESH) for kind in ("lprism", "box"))
    return _rounded(agg.volume_radius(one, two))


@query("c6_volume_radius_pair", f"WITH {o.template('lprism')}, {o.template('box', 'box_')}, {o.template('cage', 'cage_')} SELECT mesh_id, {o.r6(o.RADIUS.format('l.volume + b.volume - c.volume'))} AS rv FROM ({_volumes('lprism')}) l JOIN ({_volumes('box', 'box_')}) b USING (mesh_id) JOIN ({_volumes('cage', 'cage_')}) c USING (mesh_id)")
def c6b(spark, d):
    one, two, three = (agg.measures(_corners(spark, d, kind), MESH) for kind in ("lprism", "box", "cage"))
    return _rounded(agg.volume_radius(one, two, three))


_P, _Q = o.v("p"), o.v("q")
_ENDS = "SELECT e.mesh_id, e.i, e.j, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM {} e JOIN vertices p ON p.mesh_id = e.mesh_id AND p.vertex_id = e.i JOIN vertices q ON q.mesh_id = e.mesh_id AND q.vertex_id = e.j"
_HITS = "SELECT DISTINCT p.mesh_id, i, j FROM pairs p JOIN {} t ON t.mesh_id = p.mesh_id WHERE " + o.crossing(_P, _Q)
_PAIRS = "SELECT p.mesh_id, p.vertex_id AS i, q.vertex_id AS j, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM vertices p JOIN vertices q ON q.mesh_id = p.mesh_id AND p.vertex_id < q.vertex_id"
_SEEN = f""", {o.template('cage', 'cage_')}, pairs AS ({_PAIRS}), past_cage AS ({_HITS.format('cage_corners')}), past_self AS ({_HITS.format('corners')}),
edges AS (SELECT * FROM past_cage EXCEPT SELECT * FROM past_self)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    own, cage = _corners(spark, d, "lprism"), _corners(spark, d, "cage")
    return rel.visibility_edges(fx.vertices(spark, d, "lprism"), own, cage)


@query("c7_part_score", _mesh("lprism", f"SELECT mesh_id, {o.r6(f'sum({o.length(o.sub(_P, _Q))})')} AS score FROM ({_ENDS.format('edges')}) GROUP BY mesh_id", _SEEN))
def c7(spark, d):
    return _rounded(agg.part_score(_edges(spark, d), fx.vertices(spark, d, "lprism"), MESH))


_PARTS_SQL = "SELECT l_orderkey AS mesh_id, CAST(l_linenumber AS INT) AS part_id, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return items.groupBy(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").cast("int").alias("part_id")).agg(F.max("l_quantity").cast("double").alias("score"))


@query("c8_best_part", f"SELECT mesh_id, part_id, score FROM ({_PARTS_SQL}) QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY score DESC, part_id) = 1")
def c8(spark, d):
    return agg.first_best(_scored(spark, d), MESH, "part_id", "score")


@query("c9_best_cached_concavity", f"SELECT mesh_id, part_id, score AS concavity FROM ({_PARTS_SQL}) WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY score DESC, part_id) = 1")
def c9(spark, d):
    cached = _scored(spark, d).withColumn("concavity", F.when(F.col("score") >= 10, F.col("score")))
    return agg.first_best(cached, MESH, "part_id", "concavity")


@query("c10_final_concavity", f"WITH {_SIZES} SELECT mesh_id, {o.r6(_GAP)} AS exact, true AS near FROM sizes")
def c10(spark, d):
    """The largest gap of each mesh, from samples: near to what it is exactly."""
    gaps = solids.hull_gap(*_normed(spark, d, "lprism"), 10_000)
    found = gaps.groupBy("mesh_id").agg(F.max("hausdorff").alias("concavity")).join(_sizes(spark, d), "mesh_id")
    return found.select("mesh_id", r6(F.col("gap")).alias("exact"), (F.abs(F.col("concavity") - F.col("gap")) < 0.03).alias("near"))


@query("c11_selection_concavity", f"WITH {_SIZES} SELECT mesh_id, CAST(0 AS INT) AS part_id, {o.r6(f'greatest(0.3::DOUBLE * ' + o.RADIUS.format('0.5::DOUBLE * sx * sy * sz / (half * half * half)') + f', {_GAP})')} AS exact, true AS near FROM sizes")
def c11(spark, d):
    """The greater of 0.3 rv and the gap, from samples: near to what it is exactly."""
    gaps = solids.hull_gap(*_normed(spark, d, "lprism"), 3000).join(_sizes(spark, d), "mesh_id")
    exact = F.greatest(F.col("rv") * 0.3, "gap")
    return gaps.select("mesh_id", "part_id", r6(exact).alias("exact"), (F.abs(F.greatest(F.col("rv") * 0.3, "hausdorff") - exact) < 0.05).alias("near"))


@query("c12_mesh_hash")
def c12(spark, d):
    return agg.mesh_hash(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism"))


def _normed(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    v = fx.vertices(spark, d, kind)
    return agg.normalize(v, agg.bounding_box(v, MESH)), fx.triangles(spark, d, kind)


# --- joins -------------------------------------------------------------------


@query("d1_corners", _mesh("lprism", f"SELECT mesh_id, triangle_id, {', '.join(f'{o.r6(x)} AS {p}{a}' for p, t in (('a', o.A), ('b', o.B), ('c', o.C)) for a, x in zip('xyz', t, strict=True))} FROM corners"))
def d1(spark, d):
    return _rounded(_corners(spark, d, "lprism").drop("part_id"))


_SIDES = "sides AS (SELECT DISTINCT mesh_id, triangle_id, least(u, w) AS lo, greatest(u, w) AS hi FROM (SELECT mesh_id, triangle_id, v0 AS u, v1 AS w FROM triangles UNION ALL SELECT mesh_id, triangle_id, v1, v2 FROM triangles UNION ALL SELECT mesh_id, triangle_id, v2, v0 FROM triangles))"


@query("d2_adjacency", _mesh("lprism", "SELECT DISTINCT a.mesh_id, a.triangle_id AS t1, b.triangle_id AS t2 FROM sides a JOIN sides b USING (mesh_id, lo, hi) WHERE a.triangle_id <> b.triangle_id", f", {_SIDES}"))
def d2(spark, d):
    return rel.adjacency(fx.triangles(spark, d, "lprism"))


@query("d3_visibility", _mesh("lprism", "SELECT mesh_id, i, j FROM edges", _SEEN))
def d3(spark, d):
    return _edges(spark, d)


@query("d4_incremental_visibility", _mesh("lprism", "SELECT mesh_id, i, j FROM edges WHERE i >= 8 OR j >= 8", _SEEN))
def d4(spark, d):
    v = fx.vertices(spark, d, "lprism").withColumn("is_new", F.col("vertex_id") >= 8)
    return rel.visibility_edges(v, _corners(spark, d, "lprism"), _corners(spark, d, "cage"), only_new=True)


@query("d5_inherit_edges", _mesh("lprism", "SELECT mesh_id, least(i - 1, j - 1) AS i, greatest(i - 1, j - 1) AS j FROM edges WHERE i % 4 <> 0 AND j % 4 <> 0", _SEEN))
def d5(spark, d):
    renamed = fx.vertices(spark, d, "lprism").where("vertex_id % 4 <> 0").select("mesh_id", F.col("vertex_id").alias("old_id"), (F.col("vertex_id") - 1).alias("new_id"))
    return rel.inherit_edges(_edges(spark, d), renamed)


_KNN = """ranked AS (SELECT q.part_id, q.vertex_id AS sample_id, t.vertex_id AS target_id, round((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), 9) AS d2
  FROM cloud q JOIN cloud t ON t.part_id = q.part_id AND t.vertex_id <> q.vertex_id)"""


@query("d6_knn10", f"WITH {o.CLOUD}, {_KNN} SELECT part_id, sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY d2, target_id) AS INT) AS rank, target_id FROM ranked QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d2, target_id) <= 10")
def d6(spark, d):
    return rel.nearest_points(fx.cloud(spark, d), 10).select("part_id", "sample_id", "rank", "target_id")


@query("d7_mesh_distance", f"WITH {o.CLOUD} SELECT a.part_id AS p1, b.part_id AS p2, {o.r6('min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))')} AS distance FROM cloud a JOIN cloud b ON a.part_id < b.part_id GROUP BY 1, 2")
def d7(spark, d):
    return rel.part_distances(fx.cloud(spark, d)).select("p1", "p2", r6(F.col("distance")).alias("distance"))


@query("d8_close_parts", f"WITH {o.CLOUD} SELECT DISTINCT a.mesh_id, a.part_id AS p1, b.part_id AS p2 FROM cloud a JOIN cloud b ON a.part_id < b.part_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.05 * 0.05")
def d8(spark, d):
    return rel.close_parts(fx.cloud(spark, d), 0.05)


@query("d9_boxes_overlap", f"WITH {o.CLOUD}, box AS (SELECT mesh_id, part_id, {_BOX} FROM cloud GROUP BY 1, 2) SELECT a.mesh_id, a.part_id AS p1, b.part_id AS p2 FROM box a JOIN box b ON a.mesh_id = b.mesh_id AND a.part_id < b.part_id WHERE " + " AND ".join(f"a.min_{x} - b.max_{x} < 0.05 AND b.min_{x} - a.max_{x} < 0.05" for x in "xyz"))
def d9(spark, d):
    return rel.boxes_overlap(agg.bounding_box(fx.cloud(spark, d)), 0.05)


_TOKENS = "SELECT l_orderkey AS mesh_id, CAST(l_linenumber AS INT) AS part_id, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (l_suppkey % 3) AS BIGINT) AS interface FROM lineitem"


@query("d10_adjacent_by_cut", f"WITH t AS ({_TOKENS}) SELECT DISTINCT a.mesh_id, a.part_id AS p1, b.part_id AS p2 FROM t a JOIN t b ON a.mesh_id = b.mesh_id AND a.interface = -b.interface AND a.interface <> 0 AND a.part_id < b.part_id")
def d10(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    sign = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    return rel.adjacent_by_cut(items.select(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").cast("int").alias("part_id"), (sign * (F.col("l_suppkey") % 3)).cast("bigint").alias("interface")))


_PLANES = "planes AS (SELECT p_partkey AS mesh_id, CAST(k AS INT) AS plane_id, na AS a, nb AS b, nc AS c, -off * CAST(p_size AS DOUBLE) AS d, k = 2 AS is_flat FROM part, (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.5::DOUBLE), (1, 0.6::DOUBLE, 0.8::DOUBLE, 0.0::DOUBLE, 0.7::DOUBLE), (2, 0.8::DOUBLE, 0.0::DOUBLE, 0.6::DOUBLE, 1.1::DOUBLE)) AS q(k, na, nb, nc, off))"


def _planes(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(n) for n, x in zip(("a", "b", "c", "off"), p, strict=True)]) for k, p in enumerate(((1.0, 0.0, 0.0, 1.5), (0.6, 0.8, 0.0, 0.7), (0.8, 0.0, 0.6, 1.1)))])
    part = fx.parts(spark, d).select("mesh_id", "p_size", F.inline(rows))
    return part.select("mesh_id", F.col("k").alias("plane_id"), "a", "b", "c", (-F.col("off") * F.col("p_size").cast("double")).alias("d"), (F.col("k") == 2).alias("is_flat"))


_SCORES = f""", {_PLANES}, ends AS ({_ENDS.format('edges')}), scores AS (
SELECT s.mesh_id, plane_id, {o.r6("coalesce(sum(CASE WHEN sp * sq < 0 THEN len END), 0) * CASE WHEN any_value(is_flat) THEN 2 ELSE 1 END")} AS score
FROM (SELECT p.mesh_id, plane_id, is_flat, {o.side(_P)} AS sp, {o.side(_Q)} AS sq, {o.length(o.sub(_P, _Q))} AS len FROM planes p LEFT JOIN ends e ON e.mesh_id = p.mesh_id) s GROUP BY 1, 2)"""


def _plane_scores(spark: SparkSession, d: str) -> DataFrame:
    ends = agg.with_ends(_edges(spark, d), fx.vertices(spark, d, "lprism"), MESH)
    return _rounded(rel.plane_scores(_planes(spark, d), ends))


@query("d11_plane_score", _mesh("lprism", "SELECT mesh_id, plane_id, score FROM scores", _SEEN + _SCORES))
def d11(spark, d):
    return _plane_scores(spark, d)


# --- rankings and deduplication ----------------------------------------------

_UNIT = o.div(o.sub(_Q, _P), o.length(o.sub(_Q, _P)))


@query("e1_bisector_planes", _mesh("lprism", f"SELECT mesh_id, i, j, {', '.join(f'{o.r6(x)} AS {n}' for n, x in zip('abc', _UNIT, strict=True))}, {o.r6('-' + o.dot(_UNIT, o.mul(o.add(_P, _Q), '0.5')))} AS d FROM ({_ENDS.format('edges')})", _SEEN))
def e1(spark, d):
    return _rounded(rel.bisector_planes(_edges(spark, d), fx.vertices(spark, d, "lprism"), MESH))


_UNIFORM = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_CANDIDATES = f"""placed AS (SELECT mesh_id, i, j, px, py, pz, qx, qy, qz, row_number() OVER (PARTITION BY mesh_id ORDER BY i, j) - 1 AS nth, count(*) OVER (PARTITION BY mesh_id) AS n FROM ({_ENDS.format('edges')})),
firsts AS (SELECT mesh_id, nth, min(draw) AS item FROM (SELECT mesh_id, draw, CAST(floor({_UNIFORM.format("'0:' || mesh_id || ':' || draw")} * n) AS BIGINT) AS nth FROM (SELECT DISTINCT mesh_id, n FROM placed), range(12500) AS r(draw)) GROUP BY 1, 2),
units AS (SELECT mesh_id, item, {', '.join(f'{x} AS {n}' for n, x in zip('abc', o.div(o.sub(_Q, _P), o.length(o.sub(_Q, _P))), strict=True))}, px + qx AS sx, py + qy AS sy, pz + qz AS sz FROM firsts JOIN placed USING (mesh_id, nth) WHERE {o.length(o.sub(_Q, _P))} >= 1e-6),
rows AS (SELECT mesh_id, array_agg({{'item': item, 'a': a, 'b': b, 'c': c, 'd': -(a * sx / 2 + b * sy / 2 + c * sz / 2)}} ORDER BY item) AS p FROM units GROUP BY 1),
walk AS (SELECT mesh_id, p, 1 AS n, [p[1]] AS kept FROM rows UNION ALL
  SELECT mesh_id, p, n + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k.a * p[n + 1].a + k.b * p[n + 1].b + k.c * p[n + 1].c) > cos(radians(5)) AND abs(k.d - p[n + 1].d) < 1e-3)) = 0 THEN list_append(kept, p[n + 1]) ELSE kept END
  FROM walk WHERE n < len(p))"""


@query("e1_candidate_planes", _mesh("lprism", f"SELECT mesh_id, k - 1 AS plane_id, {', '.join(o.r6(f'kept[k].{x}') + f' AS {x}' for x in 'abcd')} FROM (SELECT mesh_id, kept, unnest(range(1, len(kept) + 1)) AS k FROM walk WHERE n = len(p)) WHERE k <= 2500", f"{_SEEN}, {_CANDIDATES}").replace("WITH ", "WITH RECURSIVE ", 1))
def e1_candidates(spark, d):
    ends = agg.with_ends(_edges(spark, d), fx.vertices(spark, d, "lprism"), MESH)
    found = _rounded(graphs.candidate_planes(ends, 2500))
    return found.withColumn("plane_id", F.col("plane_id").cast("bigint"))


@query("e2_best_plane", _mesh("lprism", "SELECT mesh_id, plane_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY score DESC, plane_id) = 1", _SEEN + _SCORES))
def e2(spark, d):
    return agg.first_best(_plane_scores(spark, d), MESH, "plane_id", "score")


@query("e3_flat_weighting", _mesh("lprism", "SELECT mesh_id, score FROM scores WHERE plane_id = 2", _SEEN + _SCORES))
def e3(spark, d):
    return _plane_scores(spark, d).where("plane_id = 2").drop("plane_id")


_SURFACES = "SELECT CAST(l_suppkey AS BIGINT) AS mesh_id, CAST(l_partkey AS BIGINT) AS surface_id, CAST(max(l_extendedprice) AS DOUBLE) AS area FROM lineitem GROUP BY 1, 2"


@query("e4_top40_surfaces", f"SELECT mesh_id, surface_id, area FROM ({_SURFACES}) QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, surface_id) <= 40")
def e4(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return rel.top_by_area(items.groupBy(F.col("l_suppkey").alias("mesh_id"), F.col("l_partkey").alias("surface_id")).agg(F.max("l_extendedprice").cast("double").alias("area")))


#: The flat sides of a normalised L-prism in order of their first triangle: area, triangles, normal, offset before the 0.02 that planes stand above.
_L_SIDES = """sides_of AS (SELECT mesh_id, n, area / (half * half) AS area, CAST(triangles AS INT) AS n_triangles, a, b, c, -off / half - 0.02 AS d FROM sizes, LATERAL (VALUES
  (0, 3 * sx * sy, 4, 0.0, 0.0, -1.0, sz / 2), (1, 3 * sx * sy, 4, 0.0, 0.0, 1.0, sz / 2), (2, 2 * sx * sz, 2, 0.0, -1.0, 0.0, sy), (3, sy * sz, 2, 1.0, 0.0, 0.0, sx),
  (4, sx * sz, 2, 0.0, 1.0, 0.0, 0.0), (5, sy * sz, 2, 1.0, 0.0, 0.0, 0.0), (6, sx * sz, 2, 0.0, 1.0, 0.0, sy), (7, 2 * sy * sz, 2, -1.0, 0.0, 0.0, sx)) AS v(n, area, triangles, a, b, c, off))"""
_FLAT_SQL = f"WITH {_SIZES}, {_L_SIDES} SELECT mesh_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY n) - 1 AS INT) AS surface_id, {o.r6('area')} AS area, n_triangles, {', '.join(f'{o.r6(f'CAST({x} AS DOUBLE)')} AS {x}' for x in 'abcd')} FROM sides_of WHERE area > 0.1"


@query("e5_flat_planes", _FLAT_SQL)
def e5(spark, d):
    return _rounded(solids.flat_planes(*_normed(spark, d, "lprism")))


@query("e6_set_bits", "SELECT mesh_id, item, row_number() OVER (PARTITION BY mesh_id ORDER BY item) - 1 AS at FROM (SELECT o_custkey AS mesh_id, CAST(0 AS BIGINT) * 32 + k AS item FROM (SELECT o_custkey, bit_or(CAST(o_orderkey AS BIGINT) & 4294967295) AS bits FROM orders GROUP BY 1), range(32) AS r(k) WHERE (bits >> CAST(k AS INT)) & 1 = 1)")
def e6(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    words = orders.groupBy(F.col("o_custkey").alias("mesh_id")).agg(F.bit_or(F.col("o_orderkey").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bits"), F.lit(0).alias("word"))
    return rel.set_bits(words)


@query("e7_crossing_triangles", _soup(f"SELECT mesh_id, triangle_id FROM (SELECT *, {_PLANE} FROM soup) WHERE least({o.side(o.A)}, {o.side(o.B)}, {o.side(o.C)}) < 0 AND greatest({o.side(o.A)}, {o.side(o.B)}, {o.side(o.C)}) > 0"))
def e7(spark, d):
    sides = [_plane_of_soup().side(p) for p in (A, B, C)]
    return fx.soup(spark, d).where((F.least(*sides) < 0) & (F.greatest(*sides) > 0)).select("mesh_id", "triangle_id")


@query("e8_first_occurrence", _mesh("lprism", "SELECT mesh_id, old_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY \"at\") - 1 AS INT) AS new_id FROM (SELECT mesh_id, old_id, min(\"at\") AS \"at\" FROM (SELECT mesh_id, v0 AS old_id, triangle_id * 3 AS \"at\" FROM triangles UNION ALL SELECT mesh_id, v1, triangle_id * 3 + 1 FROM triangles UNION ALL SELECT mesh_id, v2, triangle_id * 3 + 2 FROM triangles) GROUP BY 1, 2)"))
def e8(spark, d):
    return rel.first_occurrence(fx.triangles(spark, d, "lprism"), MESH)


@query("e9_unique_edges", _mesh("lprism", "SELECT mesh_id, \"at\", u, v FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, least(u, v), greatest(u, v) ORDER BY \"at\") AS n FROM (SELECT mesh_id, triangle_id * 3 AS \"at\", v0 AS u, v1 AS v FROM triangles UNION ALL SELECT mesh_id, triangle_id * 3 + 1, v1, v2 FROM triangles UNION ALL SELECT mesh_id, triangle_id * 3 + 2, v2, v0 FROM triangles)) WHERE n = 1"))
def e9(spark, d):
    sides = rel.half_edges(fx.triangles(spark, d, "lprism")).select("mesh_id", (F.col("triangle_id") * 3 + F.col("k")).alias("at"), "u", "v")
    return rel.unique_edges(sides)


_WELD = f"""WITH RECURSIVE {o.CLOUD}, rows AS (SELECT CAST(part_id AS BIGINT) AS mesh_id, array_agg({{'id': vertex_id, 'x': x, 'y': y, 'z': z}} ORDER BY vertex_id) AS p FROM cloud GROUP BY 1),
walk AS (SELECT mesh_id, p, 1 AS n, [p[1]] AS kept, [p[1].id] AS target FROM rows
  UNION ALL SELECT mesh_id, p, n + 1, CASE WHEN hit IS NULL THEN list_append(kept, p[n + 1]) ELSE kept END, list_append(target, coalesce(hit, p[n + 1].id))
  FROM (SELECT *, list_filter(kept, lambda k: abs(k.x - p[n + 1].x) < 0.05 AND abs(k.y - p[n + 1].y) < 0.05 AND abs(k.z - p[n + 1].z) < 0.05)[1].id AS hit FROM walk WHERE n < len(p)))
SELECT mesh_id, p[k].id AS point_id, target[k] AS target_id FROM (SELECT mesh_id, p, target, unnest(range(1, len(p) + 1)) AS k FROM walk WHERE n = len(p))"""


@query("e10_weld", _WELD)
def e10(spark, d):
    points = fx.cloud(spark, d).select(F.col("part_id").cast("bigint").alias("mesh_id"), F.col("vertex_id").alias("point_id"), "x", "y", "z")
    return graphs.welded(points, 0.05)


_LEAST = "SELECT l_suppkey AS mesh_id, l_partkey AS part_id, min(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2"


@query("e11_least_element", f"SELECT mesh_id, part_id, score FROM ({_LEAST}) QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY score, part_id) = 1")
def e11(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = items.groupBy(F.col("l_suppkey").alias("mesh_id"), F.col("l_partkey").alias("part_id")).agg(F.min("l_extendedprice").alias("score"))
    return agg.first_best(rows, MESH, "part_id", "score", largest=False)


# --- connectivity ------------------------------------------------------------


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The L-prism and, far from it, the box of each part, as one mesh of two components."""
    far = fx.vertices(spark, d, "box").withColumns({"part_id": F.lit(1), "x": F.col("x") + 1000.0})
    v, t = rel.merge_meshes(
        fx.vertices(spark, d, "lprism").unionByName(far), fx.triangles(spark, d, "lprism").unionByName(fx.triangles(spark, d, "box").withColumn("part_id", F.lit(1)))
    )
    return v.withColumn("part_id", F.lit(0)), t.withColumn("part_id", F.lit(0))


_TWO = f"""WITH RECURSIVE {o.template('lprism', 'l_')}, {o.template('box', 'b_')},
vertices AS (SELECT mesh_id, vertex_id, x, y, z FROM l_vertices UNION ALL SELECT mesh_id, vertex_id + 12, x + 1000, y, z FROM b_vertices),
triangles AS (SELECT mesh_id, triangle_id, v0, v1, v2 FROM l_triangles UNION ALL SELECT mesh_id, triangle_id + 20, v0 + 12, v1 + 12, v2 + 12 FROM b_triangles),
{_SIDES}, near AS (SELECT DISTINCT a.mesh_id, a.triangle_id AS t1, b.triangle_id AS t2 FROM sides a JOIN sides b USING (mesh_id, lo, hi)),
reach AS (SELECT mesh_id, t1 AS root, t1 AS t FROM near WHERE t1 = t2 UNION SELECT r.mesh_id, r.root, n.t2 FROM reach r JOIN near n ON n.mesh_id = r.mesh_id AND n.t1 = r.t),
labels AS (SELECT mesh_id, t AS triangle_id, min(root) AS root FROM reach GROUP BY 1, 2)"""


@query("f1_components", f"{_TWO} SELECT mesh_id, CAST(triangle_id AS INT) AS triangle_id, CAST(root AS INT) AS root FROM labels")
def f1(spark, d):
    return graphs.face_components(_two(spark, d)[1])


@query("f2_separate", f"{_TWO}, ranked AS (SELECT DISTINCT mesh_id, root, dense_rank() OVER (PARTITION BY mesh_id ORDER BY root) - 1 AS part FROM labels) SELECT mesh_id, CAST(part AS INT) AS part_id, count(*) AS n_triangles, {o.r6(f'sum({o.VOLUME})')} AS volume FROM (SELECT t.mesh_id, r.part, {', '.join(f'{p}.{a} AS {n}' for p, t in (('a', o.A), ('b', o.B), ('c', o.C)) for a, n in zip('xyz', t, strict=True))} FROM triangles t JOIN labels USING (mesh_id, triangle_id) JOIN ranked r USING (mesh_id, root) JOIN vertices a ON a.mesh_id = t.mesh_id AND a.vertex_id = t.v0 JOIN vertices b ON b.mesh_id = t.mesh_id AND b.vertex_id = t.v1 JOIN vertices c ON c.mesh_id = t.mesh_id AND c.vertex_id = t.v2) GROUP BY 1, 2")
def f2(spark, d):
    v, t = graphs.separated(*_two(spark, d))
    found = agg.measures(agg.corners(t, v))
    return found.select("mesh_id", "part_id", "n_triangles", r6(F.col("volume") + 0).alias("volume"))


_CAGE_SQL = f"""{o.template('cage', 'cage_')}, pairs AS ({_PAIRS.replace(' vertices ', ' l_vertices ')}), past_cage AS ({_HITS.format('cage_corners')}), past_self AS ({_HITS.format('l_corners')}),
edges AS (SELECT * FROM past_cage EXCEPT SELECT * FROM past_self)"""


@query("f3_edges_to_components", f"""{_TWO}, {_CAGE_SQL}, found AS (SELECT mesh_id, i, j FROM edges UNION ALL SELECT mesh_id, CAST(i AS INT), CAST(j AS INT) FROM (SELECT DISTINCT mesh_id FROM triangles), (VALUES (12, 18), (13, 17), (0, 12)) AS m(i, j)),
held AS (SELECT DISTINCT mesh_id, v, root FROM (SELECT mesh_id, triangle_id, unnest([v0, v1, v2]) AS v FROM triangles) JOIN labels USING (mesh_id, triangle_id)), parts AS (SELECT mesh_id, root, row_number() OVER (PARTITION BY mesh_id ORDER BY root) - 1 AS part_id FROM (SELECT DISTINCT mesh_id, root FROM labels)),
firsts AS (SELECT f.mesh_id, i, j, min(a.root) AS root FROM found f JOIN held a ON a.mesh_id = f.mesh_id AND a.v = i JOIN held b ON b.mesh_id = f.mesh_id AND b.v = j AND b.root = a.root GROUP BY 1, 2, 3)
SELECT mesh_id, i, j, CAST(part_id AS INT) AS part_id FROM firsts JOIN parts USING (mesh_id, root)""")
def f3(spark, d):
    """Edges of both components of a mesh, and one between them, which goes."""
    two = _two(spark, d)
    more = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((12, 18), (13, 17), (0, 12))])
    edges = _edges(spark, d).unionByName(two[0].select("mesh_id").distinct().select("mesh_id", F.inline(more)))
    return graphs.edges_to_components(edges, two[1], graphs.face_components(two[1]))


@query("f4_component_sizes", f"{_TWO} SELECT mesh_id, CAST(root AS INT) AS root, count(*) AS n FROM labels GROUP BY 1, 2")
def f4(spark, d):
    return graphs.face_components(_two(spark, d)[1]).groupBy("mesh_id", "root").agg(F.count("*").alias("n"))


@query("f5_flat_regions", f"""WITH {_SIZES} SELECT mesh_id, CAST(n AS INT) AS surface_id, CAST(2 AS INT) AS n_triangles, {o.r6('area * 4 / power(greatest(sx, sy, sz), 2)')} AS area
  FROM sizes, LATERAL (VALUES (0, sx * sy), (1, sx * sy), (2, sx * sz), (3, sy * sz), (4, sx * sz), (5, sy * sz)) AS v(n, area)""")
def f5(spark, d):
    return solids.flat_planes(*_normed(spark, d, "box"), min_area=0.0).select("mesh_id", "surface_id", "n_triangles", r6(F.col("area")).alias("area"))


@query("f6_extract_surfaces", _FLAT_SQL)
def f6(spark, d):
    return _rounded(rel.top_by_area(solids.flat_planes(*_normed(spark, d, "lprism"))))


# --- constructive geometry ---------------------------------------------------


def _clip_planes(spark: SparkSession, d: str) -> DataFrame:
    return _planes(spark, d).where("plane_id = 0").drop("is_flat")


_CLIP = f", {_PLANES}, sided AS (SELECT t.*, p.a, p.b, p.c, p.d, {o.side(o.A)} AS r0, {o.side(o.B)} AS r1, {o.side(o.C)} AS r2, {o.names(o.NORMAL, 'n')} FROM corners t JOIN planes p ON p.mesh_id = t.mesh_id AND plane_id = 0), clipped AS (SELECT *, CASE WHEN r0 = 0 AND r1 = 0 AND r2 = 0 THEN CASE WHEN nx * a > 0 OR ny * b > 0 OR nz * c > 0 THEN -1 ELSE 1 END END AS flat FROM sided)"
_S = [f"coalesce(flat, r{k})" for k in range(3)]


def _cut_sql(k: int) -> tuple[str, str, list[str]]:
    """Of a triangle's side k: whether the plane crosses the triangle, whether the cut is on the side, and where."""
    p, q = (o.A, o.B, o.C)[k], (o.A, o.B, o.C)[(k + 1) % 3]
    n = ("a", "b", "c")
    at = [f"({x} + ({y} - {x}) * (-({o.dot(p, n)} + d) / nullif({o.dot(o.sub(q, p), n)}, 0)))" for x, y in zip(p, q, strict=True)]
    inside = "coalesce(" + " AND ".join(f"{i} BETWEEN least({x}, {y}) - 1e-6 AND greatest({x}, {y}) + 1e-6" for i, x, y in zip(at, p, q, strict=True)) + ", false)"
    crossed = f"(least({', '.join(_S)}) < 0 AND greatest({', '.join(_S)}) > 0)"
    return crossed, inside, at


_CUTS = "CAST(" + " + ".join(f"CASE WHEN {c} AND {i} THEN {1 << k} ELSE 0 END" for k in range(3) for c, i, _ in [_cut_sql(k)]) + " AS INT) AS mask, " + ", ".join(
    f"CASE WHEN {c} AND {i} THEN {o.r6(x)} END AS i{k}{axis}" for k in range(3) for c, i, at in [_cut_sql(k)] for x, axis in zip(at, "xyz", strict=True)
)


@query("g1_clip_prepare", _mesh("lprism", f"SELECT mesh_id, triangle_id, {', '.join(f'CAST({x} AS INT) AS s{k}' for k, x in enumerate(_S))}, {_CUTS}, CAST(CASE WHEN least({', '.join(_S)}) >= 0 THEN 1 WHEN greatest({', '.join(_S)}) <= 0 THEN -1 ELSE 0 END AS INT) AS side FROM clipped", _CLIP))
def g1(spark, d):
    return _rounded(rel.clip_prepare(_corners(spark, d, "lprism"), _clip_planes(spark, d)).drop("part_id"))


@query("g2_clip_volumes", _mesh("lprism", f"SELECT mesh_id, CAST(n AS INT) AS part_id, {o.r6(f'sum({o.VOLUME}) * (1 + 4 * n) / 6')} AS volume FROM corners, range(2) AS r(n) GROUP BY mesh_id, n"))
def g2(spark, d):
    """Volumes of both sides of a cut through the longer arm: a sixth is on the positive side, which comes first."""
    parts = solids.clip_meshes(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism"), _clip_planes(spark, d))
    return agg.measures(solids.part_corners(parts)).select("mesh_id", "part_id", r6(F.col("volume")).alias("volume"))


@query("g4_cap_areas", f"WITH {_SIZES} SELECT mesh_id, CAST(n AS INT) AS part_id, {o.r6('sy * sz')} AS area FROM sizes, range(2) AS r(n)")
def g4(spark, d):
    parts = solids.clip_meshes(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism"), _clip_planes(spark, d))
    return _rounded(agg.measures(solids.part_corners(parts).where("interface <> 0")).select("mesh_id", "part_id", "area"))


@query("g5_cap_tokens", "SELECT l_orderkey AS mesh_id, CAST(l_linenumber AS INT) AS cap_id, CAST(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END * (CAST(1 + l_suppkey % 5 AS BIGINT) * 4294967296 + l_linenumber + 1) AS BIGINT) AS interface FROM lineitem")
def g5(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    caps = items.select(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").cast("int").alias("cap_id"), (1 + F.col("l_suppkey") % 5).alias("split"), F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1).alias("side"))
    return rel.cap_tokens(caps).select("mesh_id", "cap_id", F.col("interface").cast("bigint").alias("interface"))


@query("g6_multi_clip", f"WITH {_SIZES} SELECT mesh_id, n = 1 AS beyond, {o.r6('sx * sy * sz * (5 - 4 * n) / 2')} AS volume FROM sizes, range(2) AS r(n)")
def g6(spark, d):
    """Volumes beyond and before the first of three cuts, summed over the parts that all three leave."""
    parts = solids.clip_meshes(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism"), _planes(spark, d).drop("is_flat"))
    xs = F.filter("xyz", lambda _, n: n % 3 == 0)
    middle = F.aggregate(xs, F.lit(0.0), lambda total, x: total + x) / F.size(xs)
    corners = solids.part_corners(parts.withColumn("middle", middle), "middle")
    found = agg.measures(corners, [*PART, "middle"])
    first = _clip_planes(spark, d).select("mesh_id", (-F.col("d")).alias("at"))
    found = found.join(first, "mesh_id").withColumn("beyond", F.col("middle") > F.col("at"))
    return found.groupBy("mesh_id", "beyond").agg(r6(F.sum("volume")).alias("volume"))


@query("g7_convex_hull", f"WITH {o.template('lprism')}, scale AS (SELECT p_partkey AS mesh_id, CAST(p_size AS DOUBLE) * (1 + p_partkey % 7) * (1 + p_partkey % 5) AS k FROM part) SELECT mesh_id, {o.r6('3.5 * k')} AS volume FROM scale")
def g7(spark, d):
    v = fx.vertices(spark, d, "lprism")
    return agg.measures(agg.corners(solids.convex_hulls(v), v), MESH).select("mesh_id", r6(F.col("volume")).alias("volume"))


#: The planes of the cage's hull, with unit normals, as normal and offset.
_HULL_PLANES = """planes_of AS (SELECT mesh_id, v.* FROM sizes, LATERAL (VALUES
  (0.0, 0.0, -1.0, 0.05 * sz), (0.0, 0.0, 1.0, 1.05 * sz), (0.0, -1.0, 0.0, 0.05 * sy), (-1.0, 0.0, 0.0, 0.05 * sx), (1.0, 0.0, 0.0, 2.05 * sx), (0.0, 1.0, 0.0, 2.05 * sy),
  (sy / sqrt(sx * sx + sy * sy), sx / sqrt(sx * sx + sy * sy), 0.0, 3.1 * sx * sy / sqrt(sx * sx + sy * sy))) AS v(a, b, c, off))"""


@query("g8_hull_faces", f"WITH {_SIZES}, {_HULL_PLANES} SELECT mesh_id, {', '.join(f'{o.r6(f'CAST({x} AS DOUBLE)')} AS {x}' for x in ('a', 'b', 'c', 'off'))} FROM planes_of")
def g8(spark, d):
    """The planes that a hull's triangles lie in, each once."""
    v = fx.vertices(spark, d, "cage")
    faces = agg.corners(solids.convex_hulls(v), v)
    normal = g.face_normal(A, B, C)
    rows = faces.select("mesh_id", *normal.columns("n"), *vec("a").columns("a"))
    return _rounded(rows.select("mesh_id", *[F.col(f"n{x}").alias(p) for x, p in zip("xyz", "abc", strict=True)], vec("n").dot(vec("a")).alias("off"))).distinct()


@query("g10_fix_normals", _mesh("box", "SELECT mesh_id, triangle_id, v0, v1, v2 FROM triangles"))
def g10(spark, d):
    """A box of which every third triangle is wound the wrong way, put right."""
    t, v = fx.triangles(spark, d, "box"), fx.vertices(spark, d, "box")
    wrong = F.col("triangle_id") % 3 == 0
    turned = t.withColumns({"v1": F.when(wrong, F.col("v2")).otherwise(F.col("v1")), "v2": F.when(wrong, F.col("v1")).otherwise(F.col("v2"))})
    return rel.outward(agg.corners(turned, v), turned, v)


@query("g11_merge_meshes", f"{_TWO} SELECT mesh_id, CAST(triangle_id AS INT) AS triangle_id, CAST(v0 AS INT) AS v0, CAST(v1 AS INT) AS v1, CAST(v2 AS INT) AS v2 FROM triangles")
def g11(spark, d):
    return _two(spark, d)[1].select("mesh_id", "triangle_id", "v0", "v1", "v2")


@query("g12_overlap_face", "SELECT p_partkey AS mesh_id, CAST(6 AS INT) AS face FROM part")
def g12(spark, d):
    from meshlake import kernels

    import numpy as np
    import pandas as pd

    def run(key, p, f):
        return pd.DataFrame({"mesh_id": [key[0]], "face": [kernels.overlap_face(p, f, p + np.array([p[:, 0].max() - p[:, 0].min(), 0.0, 0.0]))]})

    return solids.per_mesh(fx.vertices(spark, d, "box"), fx.triangles(spark, d, "box"), run, "mesh_id bigint, face int")


# --- samples and distances ---------------------------------------------------


def _drawn(corners: str, number: str, skip: str = "false", keys: str = "mesh_id") -> str:
    """CTEs ``sampled(keys, triangle_id, sample_id, x, y, z)``: points drawn on ``corners``, by the same numbers as ``graphs.surface_samples``."""
    salt = "'0:' || " + " || ':' || ".join(keys.split(", ")) + " || ':' || sample_id || ':{}'"
    u, v, w = (_UNIFORM.format(salt.format(x)) for x in "tuv")
    at = ", ".join(f"(1 - r) * a{x} + r * (1 - s) * {b} + r * s * c{x} AS {x}" for x, b in zip("xyz", o.B, strict=True))
    return f"""
weighted AS (SELECT *, CASE WHEN {skip} THEN 0.0 ELSE {o.AREA} END AS weight FROM {corners}),
summed AS (SELECT *, sum(weight) OVER (PARTITION BY {keys} ORDER BY triangle_id) AS upto, sum(weight) OVER (PARTITION BY {keys}) AS whole FROM weighted),
shares AS (SELECT *, upto - weight AS low, coalesce(lead(upto - weight) OVER (PARTITION BY {keys} ORDER BY triangle_id), 'inf'::DOUBLE) AS high FROM summed WHERE weight > 0),
numbers AS (SELECT {keys}, max(upto) AS total, {number} AS n FROM summed GROUP BY ALL),
draws AS (SELECT {keys}, sample_id, {u} * total AS at_ FROM (SELECT {keys}, total, unnest(range(0, n)) AS sample_id FROM numbers)),
met AS (SELECT d.sample_id, s.triangle_id, {', '.join('d.' + x for x in keys.split(', '))} FROM draws d JOIN shares s ON {' AND '.join(f'd.{x} = s.{x}' for x in keys.split(', '))} AND at_ >= low AND at_ < high),
missed AS (SELECT {keys}, triangle_id FROM {corners} EXCEPT SELECT {keys}, triangle_id FROM met),
placed AS (SELECT sample_id, triangle_id, {keys} FROM met UNION ALL SELECT n + row_number() OVER (PARTITION BY {keys} ORDER BY triangle_id) - 1, triangle_id, {keys} FROM missed JOIN numbers USING ({keys})),
turned AS (SELECT p.*, sqrt({v}) AS r, {w} AS s FROM placed p),
sampled AS (SELECT {keys}, triangle_id, sample_id, {at} FROM turned JOIN {corners} USING ({keys}, triangle_id))"""


_SAMPLES = f"triangle_id, count(*) AS n, {', '.join(o.r6(f'avg({x})') + f' AS {x}' for x in 'xyz')}"


def _centres(samples: DataFrame, *keys: str) -> DataFrame:
    return _rounded(samples.groupBy(*keys, "triangle_id").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in "xyz"]))


@query("h1_surface_samples", _mesh("lprism", f"SELECT mesh_id, {_SAMPLES} FROM sampled GROUP BY mesh_id, triangle_id", ", " + _drawn("corners", "3000")))
def h1(spark, d):
    """3,000 samples of each surface: how many each triangle has, and their middle."""
    return _centres(graphs.surface_samples(_corners(spark, d, "lprism"), 3000, base=0), "mesh_id")


def _vertex_samples(spark: SparkSession, d: str, kind: str) -> DataFrame:
    first = rel.half_edges(fx.triangles(spark, d, kind)).groupBy("mesh_id", F.col("u").alias("vertex_id")).agg(F.min("triangle_id").alias("triangle_id"))
    return fx.vertices(spark, d, kind).join(first, ["mesh_id", "vertex_id"]).select("mesh_id", F.col("vertex_id").alias("sample_id"), "triangle_id", "x", "y", "z")


def _one_sided_sql(q: str, t: str, name: str) -> str:
    return f"""
{name}_near AS (SELECT q.mesh_id, q.sample_id, t.triangle_id, q.x AS px, q.y AS py, q.z AS pz, round((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), 9) AS d2
  FROM {q}_samples q JOIN {t}_samples t USING (mesh_id) QUALIFY row_number() OVER (PARTITION BY q.mesh_id, q.sample_id ORDER BY d2, t.sample_id) <= 10),
{name}_rows AS (SELECT n.*, {', '.join(f'c.{x}' for p in (o.A, o.B, o.C) for x in p)} FROM {name}_near n JOIN {t}_corners c USING (mesh_id, triangle_id)),
{o.point_triangle(f'{name}_rows', 'mesh_id, sample_id, d2').replace('pt', name + '_pt').replace('measured', name + '_measured')},
{name}_best AS (SELECT mesh_id, sample_id, CASE WHEN min(d) > 10 THEN sqrt(min(d2)) ELSE min(d) END AS d FROM {name}_measured GROUP BY 1, 2),
{name}_side AS (SELECT mesh_id, max(d) AS h FROM {name}_best GROUP BY 1)"""


def _samples_sql(kind: str) -> str:
    return f"{kind}_samples AS (SELECT v.mesh_id, vertex_id AS sample_id, min(triangle_id) AS triangle_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM {kind}_vertices v JOIN {kind}_triangles t ON t.mesh_id = v.mesh_id AND vertex_id IN (v0, v1, v2) GROUP BY 1, 2)"


@query("h4_hausdorff", f"WITH {o.template('lprism', 'lprism_')}, {o.template('box', 'box_')}, {_samples_sql('lprism')}, {_samples_sql('box')}, {_one_sided_sql('lprism', 'box', 'one')}, {_one_sided_sql('box', 'lprism', 'two')} SELECT mesh_id, {o.r6('greatest(a.h, b.h)')} AS hausdorff FROM one_side a JOIN two_side b USING (mesh_id)")
def h4(spark, d):
    one, two = _vertex_samples(spark, d, "lprism"), _vertex_samples(spark, d, "box")
    return _rounded(rel.hausdorff(one, _corners(spark, d, "lprism").drop("part_id"), two, _corners(spark, d, "box").drop("part_id")))


@query("h5_hull_gap", f"WITH {_SIZES} SELECT mesh_id, CAST(0 AS INT) AS part_id, {o.r6(_GAP)} AS exact, true AS near FROM sizes")
def h5(spark, d):
    """The sampled distance of a mesh from its hull: near to what it is exactly."""
    gaps = solids.hull_gap(*_normed(spark, d, "lprism"), 3000, seed=1).join(_sizes(spark, d), "mesh_id")
    return gaps.select("mesh_id", "part_id", r6(F.col("gap")).alias("exact"), (F.abs(F.col("hausdorff") - F.col("gap")) < 0.05).alias("near"))


# --- lattices ----------------------------------------------------------------


def _vox(spark: SparkSession, d: str) -> DataFrame:
    v, t = _normed(spark, d, "lprism")
    return rel.voxelize(agg.corners(t, v).drop("part_id"), 2.0)


_SCALED = ", ".join(f"CAST(CAST({x} * 2 AS FLOAT) AS DOUBLE) AS {x}" for p in (o.A, o.B, o.C) for x in p)
_CLOSE_ACB = _closest_sql("placed", "mesh_id, triangle_id, px, py, pz").replace("bx", "#x").replace("by_", "#y").replace("bz", "#z").replace("cx", "bx").replace("cy", "by_").replace("cz", "bz").replace("#x", "cx").replace("#y", "cy").replace("#z", "cz")
_VOXELS = f"""
normed AS (SELECT p.mesh_id, vertex_id, {_NORMED} FROM vertices p JOIN (SELECT mesh_id, {_BOX} FROM vertices GROUP BY mesh_id) box USING (mesh_id)),
scaled AS (SELECT mesh_id, triangle_id, {_SCALED} FROM (SELECT t.mesh_id, t.triangle_id, {', '.join(f'{p}.{a} AS {n}' for p, t in (('a', o.A), ('b', o.B), ('c', o.C)) for a, n in zip('xyz', t, strict=True))}
  FROM triangles t JOIN normed a ON a.mesh_id = t.mesh_id AND a.vertex_id = t.v0 JOIN normed b ON b.mesh_id = t.mesh_id AND b.vertex_id = t.v1 JOIN normed c ON c.mesh_id = t.mesh_id AND c.vertex_id = t.v2)),
lattice AS (SELECT CAST(k AS DOUBLE) AS k FROM range(-4, 5) AS r(k)),
placed AS (SELECT s.*, x.k AS px, y.k AS py, z.k AS pz FROM scaled s
  JOIN lattice x ON x.k BETWEEN floor(least(ax, bx, cx)) - 1 AND ceil(greatest(ax, bx, cx)) + 1
  JOIN lattice y ON y.k BETWEEN floor(least(ay, by_, cy)) - 1 AND ceil(greatest(ay, by_, cy)) + 1
  JOIN lattice z ON z.k BETWEEN floor(least(az, bz, cz)) - 1 AND ceil(greatest(az, bz, cz)) + 1),
{_CLOSE_ACB},
far AS (SELECT mesh_id, triangle_id, px, py, pz, (px - qx) * (px - qx) + (py - qy) * (py - qy) + (pz - qz) * (pz - qz) AS d2 FROM closest),
seeds AS (SELECT f.mesh_id, f.triangle_id, px, py, pz FROM far f JOIN scaled s USING (mesh_id, triangle_id) WHERE d2 <= 0.75
    AND px BETWEEN floor(least(ax, bx, cx)) AND ceil(greatest(ax, bx, cx)) AND py BETWEEN floor(least(ay, by_, cy)) AND ceil(greatest(ay, by_, cy)) AND pz BETWEEN floor(least(az, bz, cz)) AND ceil(greatest(az, bz, cz))
  UNION SELECT mesh_id, triangle_id, floor(ax), floor(ay), floor(az) FROM scaled),
held AS (SELECT f.mesh_id, f.triangle_id, f.px, f.py, f.pz, round(d2, 9) AS d2 FROM far f WHERE EXISTS (SELECT 1 FROM seeds s WHERE s.mesh_id = f.mesh_id AND s.triangle_id = f.triangle_id AND abs(s.px - f.px) <= 1 AND abs(s.py - f.py) <= 1 AND abs(s.pz - f.pz) <= 1)),
voxels AS (SELECT mesh_id, CAST(px AS INT) AS x, CAST(py AS INT) AS y, CAST(pz AS INT) AS z, d2, triangle_id FROM held QUALIFY row_number() OVER (PARTITION BY mesh_id, px, py, pz ORDER BY d2, triangle_id) = 1)"""


@query("i1_voxelize", _mesh("lprism", f"SELECT mesh_id, x, y, z, {o.r6('d2')} AS d2, triangle_id FROM voxels", f", {_VOXELS}"))
def i1(spark, d):
    return _rounded(_vox(spark, d))


@query("a14_compare_voxels", _mesh("lprism", f"SELECT mesh_id, count(a.x) AS n_one, count(b.x) AS n_two, CAST(sum(CASE WHEN a.x = b.x AND a.y = b.y AND a.z = b.z THEN 0 ELSE 1 END) AS BIGINT) AS differing, {o.r6('max(CASE WHEN a.x = b.x AND a.y = b.y AND a.z = b.z THEN abs(a.d2 - b.d2) END)')} AS largest FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY x, y, z) AS n FROM voxels) a FULL JOIN (SELECT mesh_id, x, y, z, d2 * 2 AS d2, row_number() OVER (PARTITION BY mesh_id ORDER BY x, y, z) AS n FROM voxels WHERE x <= 1) b USING (mesh_id, n) GROUP BY mesh_id", f", {_VOXELS}"))
def a14(spark, d):
    """The voxels against those up to x = 1 with doubled values: places agree up to there, and no further."""
    one, two = _vox(spark, d), _vox(spark, d).where("x <= 1").withColumn("d2", F.col("d2") * 2)
    return _rounded(rel.compare_by_position(one, two, ["x", "y", "z"], "d2"))


@query("a14_stage_ulp", """SELECT mesh_id, 'lattice' AS stage, count(*) FILTER (x IS NOT NULL) AS n_one, count(*) FILTER (y IS NOT NULL) AS n_two, count(*) FILTER (y IS NULL) AS only_one, count(*) FILTER (x IS NULL) AS only_two,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND steps <> 0) AS differing, coalesce(max(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN steps END), -1) AS max_ulp
FROM (SELECT l_orderkey AS mesh_id, l_linenumber, CASE WHEN l_linenumber <> 2 THEN true END AS x, CASE WHEN l_linenumber <> 3 THEN true END AS y, max(CAST(l_quantity AS BIGINT)) % 20 AS steps FROM lineitem GROUP BY 1, 2) WHERE x IS NOT NULL OR y IS NOT NULL GROUP BY 1""")
def a14_ulp(spark, d):
    """Two tables of values that are so many doubles apart: one from 1 upwards by exact steps, and 1 itself scaled by a power of two."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("mesh_id"), "l_linenumber", "l_quantity")
    tasks = agg.tasks_for(items)
    rows = items.repartition(tasks, "mesh_id", "l_linenumber").groupBy("mesh_id", "l_linenumber").agg((F.max("l_quantity").cast("bigint") % 20).alias("steps"))
    power = F.pow(F.lit(2.0), F.col("l_linenumber") * 40 - 160)
    one = rows.where("l_linenumber <> 2").select("mesh_id", "l_linenumber", (-power).alias("value"))
    two = rows.where("l_linenumber <> 3").select("mesh_id", "l_linenumber", (-power * (1 + F.col("steps") * 2.0**-52)).alias("value"))
    return lattice.compared(one, two, "lattice", ["value"], ["l_linenumber"], tasks=tasks).withColumn("max_ulp", F.coalesce("max_ulp", F.lit(-1)))


@query("e12_voxel_order", _mesh("lprism", "SELECT mesh_id, x, y, z, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY x, y, z) AS INT) AS place FROM voxels", f", {_VOXELS}"))
def e12(spark, d):
    return _vox(spark, d).select("mesh_id", "x", "y", "z", F.row_number().over(Window.partitionBy("mesh_id").orderBy("x", "y", "z")).alias("place"))


@query("i5_signed_distance", _mesh("lprism", f"SELECT mesh_id, x, y, z, {o.r6('CASE WHEN x < 0 THEN -1 ELSE 1 END * sqrt(abs(d2)) * 0.5')} AS phi FROM voxels", f", {_VOXELS}"))
def i5(spark, d):
    rows = rel.signed_distance(_vox(spark, d).withColumn("inside", F.col("x") < 0), 0.5)
    return rows.select("mesh_id", "x", "y", "z", r6(F.col("phi")).alias("phi"))


#: Lattice points, at 30 units, within 0.55 of a normalised L-prism: the distance to the nearer of two boxes that make it up.
_INSIDE_30 = f"""WITH {_SIZES}, ends AS (SELECT mesh_id, {', '.join(f'-30 * {e} / half AS o{a}, 30 * {e} / half AS e{a}' for a, e in (('x', 'sx'), ('y', 'sy'), ('z', 'sz / 2')))} FROM sizes),
points AS (SELECT ends.*, CAST(x.k AS DOUBLE) AS lx, CAST(y.k AS DOUBLE) AS ly, CAST(z.k AS DOUBLE) AS lz FROM ends
  JOIN range(-32, 33) AS x(k) ON x.k BETWEEN ox - 1 AND ex + 1 JOIN range(-32, 33) AS y(k) ON y.k BETWEEN oy - 1 AND ey + 1 JOIN range(-32, 33) AS z(k) ON z.k BETWEEN oz - 1 AND ez + 1)
SELECT mesh_id, count(*) AS n_inside FROM points WHERE least({', '.join('sqrt(' + ' + '.join(f'power(greatest(o{a} - l{a}, 0.0, l{a} - {hi}), 2)' for a, hi in zip('xyz', his, strict=True)) + ')' for his in (('ex', '0.0', 'ez'), ('0.0', 'ey', 'ez')))}) < 0.55 GROUP BY mesh_id"""


@query("i6_level_set", _INSIDE_30)
def i6(spark, d):
    return solids.level_set(*_normed(spark, d, "lprism"), 30.0, 0.55 / 30).select("mesh_id", "n_inside")


@query("i10_split_quads", "SELECT CAST(o_orderkey AS BIGINT) AS mesh_id, CAST(h AS BIGINT) AS triangle_id, CAST(0 AS INT) AS v0, CAST(3 - h AS INT) + CASE WHEN h = 0 THEN -1 ELSE 1 END AS v1, CAST(1 + h AS INT) AS v2 FROM orders, range(2) AS r(h)")
def i10(spark, d):
    quads = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("mesh_id"), F.lit(0).cast("bigint").alias("quad_id"), *[F.lit(n).alias(f"q{n}") for n in range(4)])
    return rel.split_quads(quads)


@query("i11_remesh", "SELECT p_partkey AS mesh_id, true AS even, true AS between FROM part")
def i11(spark, d):
    """A surface 0.55 lattice units around a mesh: its volume lies between those of the mesh and of its surroundings."""
    v, t = _normed(spark, d, "lprism")
    parts = solids.remesh(v, t)
    found = agg.measures(solids.part_corners(parts), MESH)
    own = agg.measures(agg.corners(t, v, MESH), MESH).select("mesh_id", F.col("volume").alias("v"), F.col("area").alias("a"))
    rows = found.join(own, "mesh_id")
    between = (F.col("volume") > F.col("v")) & (F.col("volume") < F.col("v") + F.col("a") * (1.0 / 30) + 0.02)
    return rows.select("mesh_id", (F.col("n_triangles") % 2 == 0).alias("even"), between.alias("between"))


# --- merging, decomposition ----------------------------------------------------


@query("k3_merge_costs", f"SELECT p_partkey AS mesh_id, CAST(1 AS INT) AS p1, CAST(0 AS INT) AS p2, {o.r6('0.3 * ' + o.RADIUS.format('(1 + 2 - 3.5) * CAST(p_size AS DOUBLE) * (1 + p_partkey % 7) * (1 + p_partkey % 5)'))} AS cost FROM part")
def k3(spark, d):
    v, t = fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism")
    middle = fx.parts(spark, d).select("mesh_id", F.lit(0).alias("plane_id"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), (-F.col("p_size").cast("double")).alias("d"))
    parts = solids.clip_meshes(v, t, middle)
    pv = solids.part_vertices(parts)
    hulls = agg.measures(agg.corners(solids.convex_hulls(pv), pv))
    both = agg.measures(agg.corners(solids.convex_hulls(v), v), MESH).select("mesh_id", F.lit(1).alias("p1"), F.lit(0).alias("p2"), "volume")
    return _rounded(rel.merge_costs(hulls, both))


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The beam of every supplier: one long L-prism each, so that whole tables can be decomposed at the default settings."""
    return fx.vertices(spark, d, "beam"), fx.triangles(spark, d, "beam")


def _summary(spark: SparkSession, d: str, parts: DataFrame) -> DataFrame:
    """By mesh: its parts, whether the concavity is below the threshold, and whether the parts' volume is that of the mesh, remeshed, or a little more."""
    found = agg.measures(agg.corners(solids.part_triangles(parts), solids.part_vertices(parts)))
    found = found.groupBy("mesh_id").agg(F.sum("volume").alias("volume"), F.count("*").alias("n_parts"))
    own = agg.measures(_corners(spark, d, "beam"), MESH).select("mesh_id", F.col("volume").alias("v"), F.col("area").alias("a"), F.col("n_triangles").alias("n"))
    size = agg.bounding_box(fx.vertices(spark, d, "beam"), MESH).select("mesh_id", (F.greatest(*[F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"]) / 2).alias("half"))
    rows = found.join(own, "mesh_id").join(size, "mesh_id").join(parts.groupBy("mesh_id").agg(F.max("concavity").alias("concavity")), "mesh_id")
    fits = (F.col("volume") > F.col("v")) & (F.col("volume") < F.col("v") + F.col("a") * F.col("half") / 20)
    return rows.select("mesh_id", "n_parts", (F.col("concavity") < 0.04).alias("convex"), fits.alias("fits"))


_BEAMS = "SELECT s_suppkey AS mesh_id, CAST(2 AS BIGINT) AS n_parts, true AS convex, true AS fits FROM supplier"


@query("k1_split_budget", _BEAMS)
def k1(spark, d):
    return _summary(spark, d, solids.decompose(*_whole(spark, d), 0.04, 3))


@query("k4_adjacent_merge", _BEAMS)
def k4(spark, d):
    return _summary(spark, d, solids.decompose(*_whole(spark, d), 0.04, 2, Config(part_limit_policy="adjacent_merge", score_mode="edge")))


@query("k7_whole_parts", _BEAMS)
def k7(spark, d):
    return _summary(spark, d, solids.decompose(*_whole(spark, d), 0.04, 2, Config(return_parts=True, use_merging=True)))


# --- reports -------------------------------------------------------------------


@query("a15_digest", _mesh("lprism", """SELECT v.mesh_id, sha256('12|20|' || v.t || '|' || f.t) AS digest
FROM (SELECT mesh_id, string_agg(concat_ws(' ', CAST(round(x * 1000000) AS BIGINT), CAST(round(y * 1000000) AS BIGINT), CAST(round(z * 1000000) AS BIGINT)), ',' ORDER BY vertex_id) AS t FROM vertices GROUP BY 1) v
JOIN (SELECT mesh_id, string_agg(concat_ws(' ', v0, v1, v2), ',' ORDER BY triangle_id) AS t FROM triangles GROUP BY 1) f USING (mesh_id)"""))
def a15(spark, d):
    return agg.mesh_digest(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism"))


@query("l1_choose_rows", "SELECT p_partkey, stratum FROM (SELECT p_partkey, p_size, stratum, row_number() OVER (PARTITION BY stratum ORDER BY p_size, p_partkey) AS n FROM (SELECT p_partkey, p_size, CAST(ntile(7) OVER (ORDER BY p_size, p_partkey) AS INT) AS stratum FROM part WHERE p_size BETWEEN 5 AND 45)) WHERE n <= 100 // 7 + CASE WHEN stratum <= 100 % 7 THEN 1 ELSE 0 END")
def l1(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").where("p_size BETWEEN 5 AND 45")
    return rel.choose_rows(part, 7, 100, ["p_size", "p_partkey"], F.lit(0)).select("p_partkey", "stratum")


_COUNTS = "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS num_parts FROM lineitem GROUP BY 1"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("num_parts"))


@query("l2_histogram", f"SELECT num_parts, count(*) AS n, {o.r6('avg(num_parts) OVER ()')} AS one FROM (SELECT num_parts FROM ({_COUNTS})) GROUP BY num_parts")
def l2(spark, d):
    rows = _counts(spark, d).groupBy("num_parts").agg(F.count("*").alias("n"))
    return rows.withColumn("one", r6(F.avg("num_parts").over(Window.partitionBy())))


@query("l2_mean_stddev", f"SELECT {o.r6('avg(num_parts)')} AS mean, {o.r6('stddev_pop(num_parts)')} AS stddev FROM ({_COUNTS})")
def l2b(spark, d):
    return _counts(spark, d).agg(r6(F.avg("num_parts")).alias("mean"), r6(F.stddev_pop("num_parts")).alias("stddev"))


@query("l3_quantiles", "SELECT " + ", ".join(f"{o.r6(f'quantile_cont(l_extendedprice, {q})')} AS q{int(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM lineitem")
def l3(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    found = rel.quantiles(items, "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.agg(*[r6(F.max(F.when(F.col("at") == q, F.col("value")))).alias(f"q{int(100 * q)}") for q in (0.0, 0.25, 0.5, 0.75, 1.0)])


@query("l4_smooth_variants", "SELECT p_partkey AS mesh_id, CAST(k AS INT) AS variant, true AS moved, true AS bounded, true AS own FROM part, range(2) AS r(k)")
def l4(spark, d):
    """Variants of each mesh: moved, but no farther than amplitude and scaling allow, and each another one."""
    v, _ = _normed(spark, d, "lprism")
    normals = fx.vertices(spark, d, "lprism").select("mesh_id", "vertex_id", *vec().unit().columns("n"))
    made = rel.smooth_variant(v, normals, 2)
    off = vec().minus(vec("o"))
    rows = made.join(v.select("mesh_id", "vertex_id", *vec().columns("o")), ["mesh_id", "vertex_id"])
    found = rows.groupBy("mesh_id", "variant").agg(F.sqrt(F.avg(off.dot(off))).alias("rms"), F.max(off.length()).alias("largest"), F.max(vec("o").length()).alias("size"))
    bounded = F.col("largest") <= 2 * F.col("size") * 0.02 + 2 * F.col("size") * 0.02 + 1e-9
    other = F.col("rms") != F.coalesce(F.lag("rms").over(Window.partitionBy("mesh_id").orderBy("variant")), F.lit(-1.0))
    return found.select("mesh_id", "variant", (F.col("rms") > 1e-5).alias("moved"), bounded.alias("bounded"), other.alias("own"))


@query("l5_replicate", _mesh("lprism", "SELECT t.mesh_id, CAST(k AS INT) AS copy, triangle_id FROM triangles t, range(3) AS r(k)"))
def l5(spark, d):
    return fx.triangles(spark, d, "lprism").select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"), "triangle_id")


@query("l6_repeatability", "SELECT p_partkey AS mesh_id, CAST(2 AS BIGINT) AS n_runs, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_digests, p_partkey % 3 <> 0 AS repeatable FROM part")
def l6(spark, d):
    """Digests of two runs' meshes; in the second, every third mesh has moved by a little."""
    run = F.explode(F.array(F.lit(0), F.lit(1))).alias("run")
    v, t = fx.vertices(spark, d, "lprism").select("*", run), fx.triangles(spark, d, "lprism").select("*", run)
    moved = F.when((F.col("run") == 1) & (F.col("mesh_id") % 3 == 0), F.col("x") + 0.001).otherwise(F.col("x"))
    n = F.count_distinct("digest")
    return agg.mesh_digest(v.withColumn("x", moved), t, keys=["mesh_id", "run"]).groupBy("mesh_id").agg(F.count("*").alias("n_runs"), n.alias("n_digests"), (n == 1).alias("repeatable"))


@query("l8_single_precision", _soup("SELECT mesh_id, triangle_id, round(CAST(CAST(ax / 3 AS FLOAT) AS DOUBLE), 6) + 0.0 AS x FROM soup"))
def l8(spark, d):
    return fx.soup(spark, d).select("mesh_id", "triangle_id", r6((F.col("ax") / 3).cast("float").cast("double")).alias("x"))


@query("l14_work_buckets", f"SELECT l_orderkey, num_parts * 1000 AS size, CAST(floor(log2(num_parts * 1000)) AS BIGINT) AS bucket FROM ({_COUNTS})")
def l14(spark, d):
    return rel.work_buckets(_counts(spark, d).select("l_orderkey", (F.col("num_parts") * 1000).alias("size")))


_DEALT = "SELECT o_orderkey AS mesh_id, CAST(floor(power(o_totalprice / 1000, 1.5)) AS BIGINT) + 1 AS size FROM orders"


@query("l14_dealt_by_work", f"""WITH sized AS ({_DEALT}), ranked AS (SELECT *, (row_number() OVER (ORDER BY size DESC, mesh_id) - 1) % 32 AS nth FROM sized), placed AS (SELECT size, CASE WHEN nth < 16 THEN nth ELSE 31 - nth END AS task FROM ranked)
SELECT CAST(task AS INT) AS task, count(*) AS n_meshes, CAST(sum(size) AS BIGINT) AS work, sum(size) < 1.3 * (SELECT sum(size) / 16 FROM sized) AS even FROM placed GROUP BY task""")
def l14_dealt(spark, d):
    """Orders as meshes of very different sizes, dealt to 16 tasks by work; counted in the tasks where they are."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    sized = orders.select(F.col("o_orderkey").alias("mesh_id"), (F.floor(F.pow(F.col("o_totalprice") / 1000, F.lit(1.5))).cast("bigint") + 1).alias("size"))
    rows = agg.dealt_by_work(sized, sized, 16).select("size", F.spark_partition_id().alias("task"))
    found = rows.groupBy("task").agg(F.count("*").alias("n_meshes"), F.sum("size").alias("work"))
    total = sized.agg(F.sum("size").alias("total"))  # one row
    return found.join(F.broadcast(total)).select("task", "n_meshes", "work", (F.col("work") < 1.3 * F.col("total") / 16).alias("even"))


@query("l15_lattice_order", _mesh("lprism", "SELECT mesh_id, x, y, z, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY x // 8, y // 8, z // 8, x, y, z) AS INT) AS place FROM (SELECT mesh_id, x + 8 AS x, y + 8 AS y, z + 8 AS z FROM voxels)", f", {_VOXELS}"))
def l15(spark, d):
    rows = _vox(spark, d).select("mesh_id", *[(F.col(a) + 8).alias(a) for a in "xyz"])
    leaf = [(F.col(a) / 8).cast("int") for a in "xyz"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("mesh_id").orderBy(*leaf, "x", "y", "z")))

# --- files ---------------------------------------------------------------------


def _few(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One L-prism per row of ``nation``, the table that the SQL of ``a4_obj_files`` names."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("mesh_id"))
    pts = F.array(*[F.struct(*[F.lit(c).alias(a) for a, c in zip("xyz", p, strict=True)]) for p in fx.LPRISM_POINTS])
    faces = F.array(*[F.struct(*[F.lit(c).alias(f"v{k}") for k, c in enumerate(f)]) for f in fx.LPRISM_FACES])
    v = nation.select("mesh_id", F.posexplode(pts).alias("vertex_id", "p")).select("mesh_id", F.lit(0).alias("part_id"), "vertex_id", (F.col("p.x") * (1 + F.col("mesh_id") % 3)).alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z"))
    t = nation.select("mesh_id", F.posexplode(faces).alias("triangle_id", "f")).select("mesh_id", F.lit(0).alias("part_id"), "triangle_id", "f.v0", "f.v1", "f.v2")
    return v, t


@query("a4_obj_files", """WITH few AS (SELECT row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR) || '/') - 1 AS mesh_id, 1 + n_nationkey % 3 AS k FROM nation)
SELECT mesh_id, CAST(12 AS BIGINT) AS n_vertices, CAST(20 AS BIGINT) AS n_triangles, round(CAST(3 * k AS DOUBLE), 6) + 0.0 AS volume FROM few""")
def a4(spark, d):
    """Meshes written as OBJ files and read back; a file for each mesh, numbered by the files' names."""
    path = meshes.scratch(spark)
    meshes.write_obj(*_few(spark, d), path)
    v, t = meshes.read_obj(spark, f"{path}/*/*/*.txt")
    found = agg.measures(agg.corners(t, v), MESH).select("mesh_id", "volume", F.col("n_triangles").cast("bigint").alias("n_triangles"))
    return _rounded(v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")).join(found, "mesh_id"))


@query("a7_obj_source", f"WITH {_SIZES} SELECT row_number() OVER (ORDER BY mesh_id) - 1 AS mesh_id, CAST(12 AS BIGINT) AS n_vertices, CAST(20 AS BIGINT) AS n_triangles, {o.r6('3 * sx * sy * sz')} AS volume FROM sizes")
def a7(spark, d):
    """The L-prism of every part written as a file by the data source and read back."""
    obj.register(spark)
    path = meshes.scratch(spark)
    obj.gathered(fx.vertices(spark, d, "lprism"), fx.triangles(spark, d, "lprism")).write.format("obj").mode("append").save(path)
    read = spark.read.format("obj").option("table", "meshes").load(path)
    parts = read.select(*PART, F.col("points").alias("xyz"), "faces", F.array().cast("array<bigint>").alias("tokens"), (F.size("points") / 3).cast("bigint").alias("n_vertices"))
    found = agg.measures(solids.part_corners(parts, "n_vertices"), ["mesh_id", "n_vertices"])
    return _rounded(found.select("mesh_id", "n_vertices", F.col("n_triangles").cast("bigint").alias("n_triangles"), "volume"))


# --- steps on lattices ---------------------------------------------------------

_CELLS = """cells AS (SELECT p_partkey AS mesh_id, CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(k AS INT) AS z,
  CAST((i - 1) * (i - 1) + (j - 1) * (j - 1) + (k - 2) * (k - 2) - p_size % 6 AS DOUBLE) / 4 AS value
  FROM part, range(4) AS a(i), range(4) AS b(j), range(4) AS c(k) WHERE (i * 7 + j * 5 + k * 3 + p_partkey) % 4 <> 0)"""
_BESIDE = "m.mesh_id = c.mesh_id AND abs(m.x - c.x) <= 1 AND abs(m.y - c.y) <= 1 AND abs(m.z - c.z) <= 1 AND (m.x <> c.x OR m.y <> c.y OR m.z <> c.z)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A lattice of 4 x 4 x 4 points for each part, with holes; values are exact in binary."""
    rows = fx.parts(spark, d)
    for a in "xyz":
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias(a))
    x, y, z = (F.col(a) for a in "xyz")
    value = ((x - 1) * (x - 1) + (y - 1) * (y - 1) + (z - 2) * (z - 2) - F.col("p_size") % 6).cast("double") / 4
    return rows.where((x * 7 + y * 5 + z * 3 + F.col("mesh_id")) % 4 != 0).select("mesh_id", "x", "y", "z", value.alias("value"))


_SOLID = f"""solid AS (SELECT mesh_id, x, y, z FROM (SELECT mesh_id, CAST(lx AS INT) AS x, CAST(ly AS INT) AS y, CAST(lz AS INT) AS z, least({', '.join("sqrt(" + " + ".join(f"power(greatest({lo}{a} - l{a}, 0.0, l{a} - {hi}{a}), 2)" for a, lo, hi in zip('xyz', ('o', 'o', 'o'), ends, strict=True)) + ")" for ends in (('e', 'm', 'e'), ('m', 'e', 'e')))}) AS far
  FROM (SELECT mesh_id, {', '.join(f'8 * (min_{a} - (max_{a} + min_{a}) / 2) / {_SIDE} AS o{a}, 8 * (max_{a} - (max_{a} + min_{a}) / 2) / {_SIDE} AS e{a}, 0.0 AS m{a}' for a in 'xyz')} FROM (SELECT mesh_id, {_BOX} FROM vertices GROUP BY mesh_id)),
  (SELECT CAST(k AS DOUBLE) AS lx FROM range(-6, 7) AS r(k)), (SELECT CAST(k AS DOUBLE) AS ly FROM range(-6, 7) AS r(k)), (SELECT CAST(k AS DOUBLE) AS lz FROM range(-6, 7) AS r(k))) WHERE far < 0.83)"""


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """``mesh_id, x, y, z, phi``: the lattice of 4 units to one around each mesh, by voxels, the walk from outside and signs; the surface is 0.83 units away."""
    v, t = _normed(spark, d, "lprism")
    near = rel.voxelize(agg.corners(t, v).drop("part_id"), 4.0).select("mesh_id", "x", "y", "z", F.sqrt("d2").alias("far"))
    steps = F.sequence(F.lit(-6), F.lit(6))
    box = v.select("mesh_id").distinct().select("mesh_id", F.explode(steps).alias("x")).select("*", F.explode(steps).alias("y")).select("*", F.explode(steps).alias("z"))
    rows = meshes.settled(box.join(near, ["mesh_id", "x", "y", "z"], "left").withColumn("far", F.coalesce("far", F.lit(2.0))))
    return lattice.signed(lattice.exterior(rows.withColumn("open", F.col("far") >= 0.83), carry=("far",)), 0.83)


@query("i2_exterior", _mesh("lprism", "SELECT mesh_id, x, y, z FROM solid", f", {_SOLID}"))
def i2(spark, d):
    """The lattice points that a walk from outside doesn't reach: all within 0.83 units of the solid."""
    return _signed(spark, d).where("phi < 0").select("mesh_id", "x", "y", "z")


@query("i6_tile_lookup", _mesh("lprism", "SELECT mesh_id, x, y, z FROM solid", f", {_SOLID}"))
def i6_tiles(spark, d):
    """The signed lattices kept as tiles near the surface and signs of the others; all points looked up, those inside returned."""
    phi = meshes.settled(_signed(spark, d))
    values, signs = lattice.tile_tree(phi, 0.5)
    found = lattice.looked_up(phi.select("mesh_id", "x", "y", "z"), meshes.settled(values), meshes.settled(signs), 0.5)
    return found.where("phi < 0").select("mesh_id", "x", "y", "z")


@query("i3_crossing_signs", f"WITH {_CELLS}, placed AS (SELECT *, 1 + (x - 1) * 0.5::DOUBLE AS qx, 1 + (y - 1) * 0.5::DOUBLE AS qy, 2 + (z - 2) * 0.5::DOUBLE AS qz FROM (SELECT * EXCLUDE value, -value AS value FROM cells)), flips AS (SELECT DISTINCT c.mesh_id, c.x, c.y, c.z FROM placed c JOIN placed m ON {_BESIDE} WHERE m.value < -0.75 AND (m.x - m.qx) * (c.x - m.qx) + (m.y - m.qy) * (c.y - m.qy) + (m.z - m.qz) * (c.z - m.qz) > 0) SELECT c.mesh_id, c.x, c.y, c.z, CASE WHEN f.x IS NOT NULL AND value BETWEEN 0 AND 0.75 THEN -value ELSE value END + 0.0 AS value FROM placed c LEFT JOIN flips f USING (mesh_id, x, y, z)")
def i3(spark, d):
    closest = {f"q{a}": c + (F.col(a) - c) * 0.5 for a, c in zip("xyz", (1, 1, 2), strict=True)}
    found = lattice.crossing_signs(_cells(spark, d).withColumns({"value": -F.col("value"), **closest}))
    return found.withColumn("value", F.col("value") + 0.0)


@query("i4_validated", f"WITH {_CELLS} SELECT mesh_id, x, y, z, CASE WHEN value BETWEEN 0 AND 0.75 AND NOT EXISTS (SELECT 1 FROM cells m WHERE {_BESIDE} AND m.value < 0) THEN 0.7500001::DOUBLE ELSE value END + 0.0 AS value FROM cells c")
def i4(spark, d):
    return lattice.validated(_cells(spark, d)).withColumn("value", F.col("value") + 0.0)


@query("i4_cleaned", f"WITH {_CELLS} SELECT mesh_id, x, y, z, value + 0.0 AS value FROM cells c WHERE value <= 0.75 OR EXISTS (SELECT 1 FROM cells m WHERE {_BESIDE} AND m.value <= 0.75)")
def i4b(spark, d):
    return lattice.cleaned(_cells(spark, d)).withColumn("value", F.col("value") + 0.0)


def _godunov(axis: str) -> str:
    down, up = f"(phi0 - coalesce(d{axis}, far))", f"(coalesce(u{axis}, far) - phi0)"
    return f"CASE WHEN phi0 > 0 THEN greatest(power(greatest({down}, 0.0), 2), power(least({up}, 0.0), 2)) ELSE greatest(power(least({down}, 0.0), 2), power(greatest({up}, 0.0), 2)) END"


def _beside(axis: str) -> str:
    """The values at the lattice points before and after along an axis, null where there is a hole."""
    line = f"OVER (PARTITION BY mesh_id, {', '.join(b for b in 'xyz' if b != axis)} ORDER BY {axis})"
    return ", ".join(f"CASE WHEN {f}({axis}) {line} = {axis} {s} 1 THEN {f}(phi0) {line} END AS {n}{axis}" for n, f, s in (("d", "lag", "-"), ("u", "lead", "+")))


_MOVED = f""", shifted AS (SELECT mesh_id, x, y, z, value - 0.4::DOUBLE AS phi0, CASE WHEN value - 0.4::DOUBLE + 0.4::DOUBLE >= 0 THEN 1.5::DOUBLE ELSE -1.5::DOUBLE END AS far FROM cells),
around AS (SELECT *, {', '.join(_beside(a) for a in 'xyz')} FROM shifted),
squared AS (SELECT mesh_id, x, y, z, phi0, {' + '.join(_godunov(a) for a in 'xyz')} AS square FROM around),
moved AS (SELECT mesh_id, x, y, z, least(phi0, phi0 - 0.5::DOUBLE * coalesce(phi0 / nullif(sqrt(phi0 * phi0 + square), 0), 0) * (sqrt(square) / 0.5::DOUBLE - 1)) + 0.4::DOUBLE - 1e-7::DOUBLE AS moved FROM squared)"""


@query("i8_renormalized", f"WITH {_CELLS}{_MOVED} SELECT mesh_id, x, y, z, {o.r6('greatest(-1.5::DOUBLE, least(1.5::DOUBLE, moved))')} AS phi, moved > -1.5 AND moved < 1.5 AS active FROM moved")
def i8(spark, d):
    return _rounded(lattice.renormalized(_cells(spark, d).withColumnRenamed("value", "phi"), 0.5, 1.5, 1.5))


@query("i7_expanded", "SELECT p_partkey AS mesh_id, true AS grown, true AS within, true AS sound FROM part")
def i7(spark, d):
    """Bands grown from the voxels of each mesh to 3.5 units: no value is above that or below the true distance."""
    v, t = _normed(spark, d, "lprism")
    scaled = v.select(*PART, "vertex_id", *[(F.col(a) * 2.0).alias(a) for a in "xyz"])
    corner_rows = agg.corners(t, scaled).drop("part_id")
    band = _vox(spark, d).select("mesh_id", "x", "y", "z", F.sqrt(F.abs("d2")).alias("phi"), "triangle_id")
    found = lattice.expanded(band, corner_rows, 3.5, 3.5)
    far = found.select("mesh_id", "x", "y", "z", "phi").join(corner_rows.withColumnRenamed("triangle_id", "other"), "mesh_id").withColumns({f"p{a}": F.col(a).cast("double") for a in "xyz"})
    off = vec("p").minus(vec("q"))
    exact = g.with_closest(far, "q").groupBy("mesh_id", "x", "y", "z", "phi").agg(F.min(off.length()).alias("exact"))
    sums = exact.groupBy("mesh_id").agg(F.max("phi").alias("largest"), F.min(F.col("phi") - F.col("exact")).alias("least"), F.count("*").alias("n"))
    n_before = band.groupBy("mesh_id").agg(F.count("*").alias("before"))
    rows = sums.join(n_before, "mesh_id")
    return rows.select("mesh_id", (F.col("n") > F.col("before")).alias("grown"), (F.col("largest") < 3.5).alias("within"), (F.col("least") > -1e-4).alias("sound"))


@query("i9_closed_surface", "SELECT p_partkey AS mesh_id, CAST(0 AS BIGINT) AS n_open, true AS enough FROM part")
def i9(spark, d):
    """Sides of remeshed surfaces, by how many triangles share them: closed ones have no side with an odd number."""
    parts = solids.remesh(*_normed(spark, d, "lprism"))
    return solids.side_counts(parts).select("mesh_id", F.col("n_odd").alias("n_open"), (F.col("n_sides") > 300).alias("enough"))


_BESIDE_SOLID = " UNION ALL ".join(f"SELECT mesh_id, x {dx}, y {dy}, z {dz} FROM solid" for dx, dy, dz in (("+ 1", "", ""), ("- 1", "", ""), ("", "+ 1", ""), ("", "- 1", ""), ("", "", "+ 1"), ("", "", "- 1")))


@query("i9_dual_surface", _mesh("lprism", "SELECT mesh_id, 2 * count(*) AS n_triangles, CAST(0 AS BIGINT) AS n_bad, CAST(2 AS BIGINT) AS euler FROM (SELECT b.* FROM beside b LEFT JOIN solid s USING (mesh_id, x, y, z) WHERE s.x IS NULL AND abs(b.x) <= 6 AND abs(b.y) <= 6 AND abs(b.z) <= 6) GROUP BY mesh_id", f", {_SOLID}, beside(mesh_id, x, y, z) AS ({_BESIDE_SOLID})"))
def i9_dual(spark, d):
    """The dual surface of each signed lattice: two triangles for each crossed lattice edge, each side in just two of them, and the surface of one ball."""
    v, t = lattice.dual_surface(_signed(spark, d))
    t = meshes.settled(t)
    sides = rel.half_edges(t).groupBy("mesh_id", *rel.undirected("u", "v")).agg(F.count("*").alias("n"), F.count_if(F.col("u") < F.col("v")).alias("forth"))
    sums = sides.groupBy("mesh_id").agg(F.count("*").alias("e"), F.count_if((F.col("n") != 2) | (F.col("forth") != 1)).alias("n_bad"))
    rows = v.groupBy("mesh_id").agg(F.count("*").alias("v")).join(sums, "mesh_id").join(t.groupBy("mesh_id").agg(F.count("*").alias("n_triangles")), "mesh_id")
    return rows.select("mesh_id", "n_triangles", "n_bad", (F.col("v") - F.col("e") + F.col("n_triangles")).alias("euler"))


# --- further steps of clipping, distances and splitting -------------------------

_BORDER = """border AS (SELECT l_orderkey AS mesh_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS "at", x, y, z
  FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS DOUBLE) AS x, round(CAST(min(l_discount) AS DOUBLE) * 100) AS y, round(CAST(min(l_tax) AS DOUBLE) * 100) AS z FROM lineitem GROUP BY 1, 2))"""
_T, _U = o.v("t"), o.v("u")
_FRAME = f"""
one AS (SELECT mesh_id, x AS px, y AS py, z AS pz FROM border WHERE "at" = 0),
two AS (SELECT b.mesh_id, b."at" AS qat, px, py, pz, x AS qx, y AS qy, z AS qz FROM border b JOIN one USING (mesh_id) WHERE "at" > 0 AND {o.length(o.sub(_P, o.v('')))} > 0.01 QUALIFY row_number() OVER (PARTITION BY b.mesh_id ORDER BY "at") = 1),
three AS (SELECT t.*, x AS ax, y AS ay, z AS az FROM border b JOIN two t USING (mesh_id) WHERE "at" > 1 AND "at" <> qat
  AND abs(abs({o.dot(o.sub(_Q, _P), o.sub(o.v(''), _Q))} / nullif({o.length(o.sub(_Q, _P))} * {o.length(o.sub(o.v(''), _Q))}, 0)) - 1) > 1e-6 QUALIFY row_number() OVER (PARTITION BY b.mesh_id ORDER BY "at") = 1),
turned AS (SELECT *, {' + '.join(f'{w} * {x}' for w, x in zip((1, 2, -1), o.cross(o.sub(_Q, _P), o.sub(o.A, _P)), strict=True))} > 0 AS swapped FROM three),
based AS (SELECT mesh_id, swapped, qx, qy, qz, {', '.join(f'CASE WHEN swapped THEN a{x} ELSE p{x} END AS t{x}, CASE WHEN swapped THEN p{x} ELSE a{x} END AS u{x}' for x in 'xyz')} FROM turned),
first_axis AS (SELECT *, {o.names(o.div(o.sub(_T, _Q), o.length(o.sub(_T, _Q))), 'f')} FROM based),
crossed AS (SELECT *, {o.names(o.cross(o.v('f'), o.sub(_U, _T)), 'w')} FROM first_axis),
last_axis AS (SELECT *, {o.names(o.div(o.v('w'), o.length(o.v('w'))), 'h')} FROM crossed),
middle_axis AS (SELECT *, {o.names(o.cross(o.v('f'), o.v('h')), 'g')} FROM last_axis)"""


@query("g3_cap_frame", f"WITH {_BORDER}, {_FRAME} SELECT mesh_id, swapped, {o.names(_T, 't', o.r6)}, {o.names(o.v('f'), 'r0', o.r6)}, {o.names(o.v('g'), 'r1', o.r6)}, {o.names(o.v('h'), 'r2', o.r6)} FROM middle_axis")
def g3(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    whole = [F.round(F.min(c).cast("double") * 100).alias(a) for c, a in (("l_discount", "y"), ("l_tax", "z"))]
    border = items.groupBy(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").alias("at")).agg(F.min("l_quantity").cast("double").alias("x"), *whole)
    plane = border.select("mesh_id").distinct().select("mesh_id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(-1.0).alias("c"))
    return _rounded(rel.cap_frames(border, plane))


_PAIR = f"""{o.template('box')}, spans AS (SELECT mesh_id, max(x) AS wide FROM vertices GROUP BY 1),
hulls AS (SELECT mesh_id, CAST(h AS INT) AS part_id, triangle_id, {', '.join(f'{x} + h * wide AS {x}' if x.startswith(p + 'x') else x for p, t in (('a', o.A), ('b', o.B), ('c', o.C)) for x in t)}, wide FROM corners JOIN spans USING (mesh_id), range(2) AS r(h)),
sides_area AS (SELECT *, sum({o.AREA}) OVER (PARTITION BY mesh_id, part_id) / sum({o.AREA}) OVER (PARTITION BY mesh_id) AS part FROM hulls)"""


@query("h2_two_hull_samples", f"WITH {_PAIR}, {_drawn('sides_area', 'CASE WHEN max(part_id) = 0 THEN CAST(floor(2000 * max(part)) AS BIGINT) ELSE 2000 - CAST(floor(2000 * (1 - max(part))) AS BIGINT) END', 'abs(ax - wide) < 1e-3 AND abs(bx - wide) < 1e-3 AND abs(cx - wide) < 1e-3', 'mesh_id, part_id')} SELECT mesh_id, part_id, {_SAMPLES} FROM sampled GROUP BY mesh_id, part_id, triangle_id")
def h2(spark, d):
    """2,000 samples of a box and of the same box beside it, by their shares of the area: none by area on the side that they share."""
    own = _corners(spark, d, "box").drop("part_id").join(fx.vertices(spark, d, "box").groupBy("mesh_id").agg(F.max("x").alias("wide")), "mesh_id")
    both = own.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("part_id")).withColumns({f"{p}x": F.col(f"{p}x") + F.col("part_id") * F.col("wide") for p in "abc"})
    area = g.triangle_area(A, B, C)
    part = F.sum(area).over(Window.partitionBy(*PART)) / F.sum(area).over(Window.partitionBy(*MESH))
    first = F.floor(2000 * F.when(F.col("part_id") == 0, part).otherwise(1 - part))
    both = both.withColumn("wanted", F.when(F.col("part_id") == 0, first).otherwise(2000 - first))
    shared = F.lit(True)
    for p in "abc":
        shared = shared & (F.abs(F.col(f"{p}x") - F.col("wide")) < 1e-3)
    return _centres(graphs.surface_samples(both, "wanted", base=0, skip=shared, keys=PART), *PART)


def _nearest_sql(q: str, t: str, way: int) -> str:
    return f"SELECT q.mesh_id, CAST({way} AS INT) AS way, q.sample_id, t.sample_id AS target_id, t.triangle_id, round((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), 9) AS d2 FROM {q}_samples q JOIN {t}_samples t USING (mesh_id) QUALIFY row_number() OVER (PARTITION BY q.mesh_id, q.sample_id ORDER BY d2, t.sample_id) <= 10"


@query("h3_nearest_both_ways", f"WITH {o.template('lprism', 'lprism_')}, {o.template('box', 'box_')}, {_samples_sql('lprism')}, {_samples_sql('box')}, near AS ({_nearest_sql('lprism', 'box', 0)} UNION ALL {_nearest_sql('box', 'lprism', 1)}) SELECT mesh_id, way, sample_id, target_id, triangle_id, {o.r6('d2')} AS d2 FROM near")
def h3(spark, d):
    one, two = _vertex_samples(spark, d, "lprism"), _vertex_samples(spark, d, "box")
    there = rel.nearest_samples(one, two).withColumn("way", F.lit(0))
    both = there.unionByName(rel.nearest_samples(two, one).withColumn("way", F.lit(1)))
    return _rounded(both.select("mesh_id", "way", "sample_id", "target_id", "triangle_id", "d2"))


@query("h6_concavity", f"WITH {o.template('lprism', 'lprism_')}, {o.template('box', 'box_')}, {_samples_sql('lprism')}, {_samples_sql('box')}, {_one_sided_sql('lprism', 'box', 'one')}, {_one_sided_sql('box', 'lprism', 'two')}, l AS ({_volumes('lprism', 'lprism_')}), b AS ({_volumes('box', 'box_')}) SELECT mesh_id, {o.r6('greatest(0.3::DOUBLE * ' + o.RADIUS.format('l.volume - b.volume') + ', one_side.h, two_side.h)')} AS selection, {o.r6('greatest(one_side.h, two_side.h)')} AS final FROM one_side JOIN two_side USING (mesh_id) JOIN l USING (mesh_id) JOIN b USING (mesh_id)")
def h6(spark, d):
    one, two = _vertex_samples(spark, d, "lprism"), _vertex_samples(spark, d, "box")
    mine, other = _corners(spark, d, "lprism").drop("part_id"), _corners(spark, d, "box").drop("part_id")
    return _rounded(agg.concavity(mine, other, rel.hausdorff(one, mine, two, other), MESH))


@query("k2_admitted_parts", "SELECT mesh_id, part_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY part_id) AS INT) AS place FROM (SELECT l_orderkey AS mesh_id, CAST(l_linenumber AS INT) AS part_id, max(l_quantity) AS n FROM lineitem GROUP BY 1, 2) WHERE n >= 10")
def k2(spark, d):
    return rel.admitted(_scored(spark, d).withColumnRenamed("score", "n_vertices"))
