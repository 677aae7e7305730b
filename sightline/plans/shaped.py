"""Queries of contours' shapes, cameras, colour spaces, k-means and image files, added to the registry on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as m
from ..session import table
from ..sources import files, views
from .registry import PX, add, on, on_pixels


def rounded(df, *names, to=6):
    """Doubles to some places; a negative zero becomes zero."""
    return df.withColumns({c: F.round(c, to) + F.lit(0.0) for c in names})


R = lambda e, n, to=6: f"round({e}, {to}) + 0.0::DOUBLE AS {n}"
_seg = "sg AS (SELECT * FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i)) WHERE nx IS NOT NULL)"
on(views.contour_points, "segment_measures", lambda k: rounded(m.segment_measures(k, 1500.0, 500.0), "length", "angle", "distance"), f"SELECT contour_id, i, {R('sqrt(ll)', 'length')}, {R('atan2(dy::DOUBLE, dx::DOUBLE)', 'angle')}, {R('sqrt((x + t * dx - 1500) * (x + t * dx - 1500) + (y + t * dy - 500) * (y + t * dy - 500))', 'distance')} FROM (SELECT *, CASE WHEN ll > 0 THEN least(1, greatest(0, ((1500.0::DOUBLE - x) * dx + (500.0::DOUBLE - y) * dy) / ll)) ELSE 0::DOUBLE END AS t FROM (SELECT *, CAST(dx * dx + dy * dy AS DOUBLE) AS ll FROM (SELECT *, nx - x AS dx, ny - y AS dy FROM sg)))", _seg)
_side = lambda p, s, o: f"({p}.nx - {p}.x) * ({o}.{s}y - {p}.y) - ({p}.ny - {p}.y) * ({o}.{s}x - {p}.x)"
on(views.contour_points, "contour_crossings", lambda k: rounded(m.crossings(k), "cx", "cy"), f"SELECT contour_id, i, j, {R('x + u::DOUBLE / (u - w)::DOUBLE * (nx - x)', 'cx')}, {R('y + u::DOUBLE / (u - w)::DOUBLE * (ny - y)', 'cy')} FROM (SELECT a.*, b.i AS j, {_side('a', '', 'b')} AS s, {_side('a', 'n', 'b')} AS t, {_side('b', '', 'a')} AS u, {_side('b', 'n', 'a')} AS w FROM sg a JOIN sg b ON a.contour_id = b.contour_id AND a.i < b.i) WHERE sign(s) * sign(t) < 0 AND sign(u) * sign(w) < 0", _seg)
_ring = "kr AS (SELECT *, x * ny - nx * y AS c FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i)))"
on(views.contour_points, "contour_moments", lambda k: rounded(m.moments(k), "area", "cx", "cy", to=4), f"SELECT contour_id, {R('s / 2.0::DOUBLE', 'area', 4)}, {R('sx / (s * 3.0::DOUBLE)', 'cx', 4)}, {R('sy / (s * 3.0::DOUBLE)', 'cy', 4)} FROM (SELECT contour_id, sum(c) AS s, sum((x + nx) * c) AS sx, sum((y + ny) * c) AS sy FROM kr GROUP BY contour_id) WHERE s <> 0", _ring)
on(views.contour_points, "contour_arc_length", lambda k: rounded(m.arc_length(k), "length"), f"SELECT contour_id, i, {R('sum(coalesce(d, 0)) OVER (PARTITION BY contour_id ORDER BY i)', 'length')} FROM (SELECT *, sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) AS d FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i))")
on(views.contour_points, "contour_hausdorff", lambda k: rounded(m.hausdorff(k, k.withColumn("contour_id", F.col("contour_id") - 1)), "distance"), f"SELECT contour_id, {R('sqrt(CAST(max(d) AS DOUBLE))', 'distance')} FROM (SELECT a.contour_id, a.i, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM k a JOIN k b ON b.contour_id = a.contour_id + 1 GROUP BY a.contour_id, a.i) GROUP BY contour_id")

# a hull's sides: pairs of places with no place to their right, nor beyond them on their line
_hull = """d AS (SELECT DISTINCT contour_id, x, y FROM k),
hs AS (SELECT a.contour_id, a.x, a.y, b.x AS nx, b.y AS ny FROM d a JOIN d b ON a.contour_id = b.contour_id AND (a.x <> b.x OR a.y <> b.y) JOIN d c ON a.contour_id = c.contour_id GROUP BY ALL
  HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0 AND bool_and((b.x - a.x) * (c.y - a.y) <> (b.y - a.y) * (c.x - a.x) OR (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))"""
on(views.contour_points, "convex_hull", lambda k: m.hull(k).select("contour_id", "x", "y"), "SELECT DISTINCT contour_id, x, y FROM hs UNION SELECT contour_id, min(x), min(y) FROM d GROUP BY contour_id HAVING count(*) = 1", _hull)
on(views.contour_points, "hull_features", lambda k: rounded(m.hull_features(k), "area", "perimeter"), f"SELECT contour_id, count(*) AS corners, {R('coalesce(sum(hs.x * ny - nx * hs.y), 0) / 2.0::DOUBLE', 'area')}, {R('coalesce(sum(sqrt(CAST((nx - hs.x) * (nx - hs.x) + (ny - hs.y) * (ny - hs.y) AS DOUBLE))), 0)', 'perimeter')} FROM (SELECT DISTINCT contour_id FROM d) LEFT JOIN hs USING (contour_id) GROUP BY contour_id", _hull)
on(views.contour_points, "smallest_rectangle", lambda k: rounded(m.smallest_rectangle(k), "area", to=4), f"SELECT contour_id, {R('min(a)', 'area', 4)} FROM (SELECT s.contour_id, CAST(max((nx - s.x) * (o.x - s.x) + (ny - s.y) * (o.y - s.y)) - min((nx - s.x) * (o.x - s.x) + (ny - s.y) * (o.y - s.y)) AS DOUBLE) * (max((nx - s.x) * (o.y - s.y) - (ny - s.y) * (o.x - s.x)) - min((nx - s.x) * (o.y - s.y) - (ny - s.y) * (o.x - s.x))) / ((nx - s.x) * (nx - s.x) + (ny - s.y) * (ny - s.y)) AS a FROM hs s JOIN d o USING (contour_id) GROUP BY s.contour_id, s.x, s.y, nx, ny) GROUP BY contour_id", _hull)


def points3(spark, sf_dir):
    """Points in space: one for each line item."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100 - 5).alias("y"), (F.col("l_extendedprice") / 1000 + 10).alias("z"))


_p3 = "p3 AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_extendedprice / 1000 + 10 AS z FROM lineitem)"
_id = "SELECT l_orderkey, l_linenumber, "
_m = (0.8, -0.6, 0.0, 3.0, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 5.5)
add("rigid_points", _id + ", ".join(R(" + ".join(f"{c} * {_m[4 * i + j]!r}::DOUBLE" for j, c in enumerate("xyz")) + f" + {_m[4 * i + 3]!r}::DOUBLE", n) for i, n in enumerate("xyz")) + " FROM p3", _p3)(lambda s, d: rounded(m.rigid(points3(s, d), _m), *"xyz"))
_norm = "q AS (SELECT *, a * a + b * b AS q FROM (SELECT *, x / z AS a, y / z AS b FROM p3))"
_f = "(1 + q * (-0.2::DOUBLE + q * (0.05::DOUBLE + q * 0.01::DOUBLE)))"
add("project_points", f"{_id}{R(f'(a * {_f} + 0.002::DOUBLE * a * b + -0.002::DOUBLE * (q + 2 * a * a)) * 800 + 320', 'u', 4)}, {R(f'(b * {_f} + 0.001::DOUBLE * (q + 2 * b * b) + -0.004::DOUBLE * a * b) * 810 + 240', 'v', 4)} FROM q", f"{_p3}, {_norm}")(lambda s, d: rounded(m.project(points3(s, d), (800.0, 810.0), (320.0, 240.0), (-0.2, 0.05, 0.01), (0.001, -0.002)), "u", "v", to=4).select("l_orderkey", "l_linenumber", "u", "v"))
_fe = "CASE WHEN q > 0 THEN o * (1 + o * o * (0.03::DOUBLE + o * o * (-0.01::DOUBLE + o * o * (0.002::DOUBLE + o * o * 0.0005::DOUBLE)))) / sqrt(q) ELSE 1 END"
add("project_fisheye", f"{_id}{R('a * f * 300 + 320', 'u', 4)}, {R('b * f * 305 + 240', 'v', 4)} FROM (SELECT *, {_fe} AS f FROM (SELECT *, atan(sqrt(q)) AS o FROM q))", f"{_p3}, {_norm}")(lambda s, d: rounded(m.project_fisheye(points3(s, d), (300.0, 305.0), (320.0, 240.0), (0.03, -0.01, 0.002, 0.0005)), "u", "v", to=4).select("l_orderkey", "l_linenumber", "u", "v"))

_lin = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_xyz = "xyz AS (SELECT *, " + ", ".join(" + ".join(f"l{c} * {f!r}::DOUBLE" for c, f in zip("rgb", line, strict=True)) + f" AS {n}" for n, line in zip("xyz", m.TO_XYZ, strict=True)) + " FROM (SELECT *, " + ", ".join(f"{_lin(c)} AS l{c}" for c in "rgb") + " FROM rgb))"
on(views.rgb, "cie_xyz", lambda c: rounded(m.xyz(c), *"xyz").select("l_orderkey", "l_linenumber", *"xyz"), _id + ", ".join(R(n, n) for n in "xyz") + " FROM xyz", _xyz)
_fl = lambda n, w: f"CASE WHEN {n} / {w!r}::DOUBLE > 0.008856::DOUBLE THEN cbrt({n} / {w!r}::DOUBLE) ELSE ({n} / {w!r}::DOUBLE * 903.3::DOUBLE + 16) / 116.0::DOUBLE END"
on(views.rgb, "cie_lab", lambda c: rounded(m.lab(c), "ll", "aa", "bb", to=4).select("l_orderkey", "l_linenumber", "ll", "aa", "bb"), f"{_id}{R('116 * fy - 16', 'll', 4)}, {R('500 * (fx - fy)', 'aa', 4)}, {R('200 * (fy - fz)', 'bb', 4)} FROM (SELECT *, " + ", ".join(f"{_fl(n, w)} AS f{n}" for n, w in zip("xyz", m.WHITE, strict=True)) + " FROM xyz)", _xyz)
_C = [(40, 60, 80), (130, 120, 120), (220, 200, 160)]
_km = "k0(n, cr, cg, cb) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_C)) + ")"
for _i in range(4):
    _km += f", a{_i} AS (SELECT *, (SELECT arg_min(n, struct_pack(d := (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb), n := n)) FROM k{_i}) AS cluster FROM rgb), k{_i + 1} AS (SELECT n, coalesce(avg(r), any_value(cr)) AS cr, coalesce(avg(g), any_value(cg)) AS cg, coalesce(avg(b), any_value(cb)) AS cb FROM k{_i} LEFT JOIN a{_i} ON cluster = n GROUP BY n)"
on(views.rgb, "kmeans_three_rounds", lambda c: m.nearest(c, m.kmeans(c, _C, 3)), "SELECT * FROM a3", _km)
# until centres move less than 1, as the reference does; its number of rounds depends on the data, so it has no SQL
on(views.rgb, "kmeans", lambda c: m.nearest(c, m.kmeans(c, _C, 100, 1.0)), None)

on_pixels("image_files", lambda p: files.decoded(files.encoded(p)), f"{PX} v FROM p")
on_pixels("image_headers", lambda p: files.headers(files.encoded(p)), "SELECT image_id, w AS width, h AS height FROM dims")
