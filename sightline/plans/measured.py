"""Queries of the further measures, added to the registry on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import measures as m
from ..operators import raster as r
from ..operators import regions as rg
from ..sources import views
from . import registry as q
from .registry import PX, RUNS, near, on, on_pixels

on_pixels("roberts_amp", m.roberts, f"{PX} CASE WHEN c.v IS NULL THEN 0 ELSE CAST(least(255, abs(p.v - c.v) + abs(a.v - b.v)) AS INTEGER) END AS v FROM p LEFT JOIN (SELECT image_id, y, x - 1 AS x, v FROM p) a USING (image_id, y, x) LEFT JOIN (SELECT image_id, y - 1 AS y, x, v FROM p) b USING (image_id, y, x) LEFT JOIN (SELECT image_id, y - 1 AS y, x - 1 AS x, v FROM p) c USING (image_id, y, x)")
_tri = q._h + """, pk AS (SELECT *, CASE WHEN x1 < 128 THEN 255 ELSE 0 END AS x2 FROM (SELECT image_id, arg_max(v, struct_pack(n := n, u := -v)) AS x1, max(n) AS y1 FROM hist GROUP BY ALL)),
pe AS (SELECT pk.*, coalesce(n, 0) AS y2 FROM pk LEFT JOIN hist ON hist.image_id = pk.image_id AND v = x2),
bn AS (SELECT pe.*, unnest(range(least(x1, x2), greatest(x1, x2) + 1)) AS v FROM pe),
fr AS (SELECT bn.image_id, bn.v, abs((y2 - y1) * bn.v - (x2 - x1) * coalesce(n, 0) + x2 * y1 - y2 * x1) AS far FROM bn LEFT JOIN hist ON hist.image_id = bn.image_id AND hist.v = bn.v)"""
on_pixels("triangle", m.triangle, "SELECT image_id, v, (v + 0.5::DOUBLE) * 255 / 256 AS threshold FROM (SELECT image_id, CAST(arg_max(v, struct_pack(f := far, u := -v)) AS INTEGER) AS v FROM fr GROUP BY image_id)", _tri)
on_pixels("rotate_90", m.quarter_turn, "SELECT image_id, x AS y, h - 1 - y AS x, v FROM p JOIN dims USING (image_id)")
on_pixels("rotate_180", lambda p: r.mirror(r.mirror(p, "row"), "column"), "SELECT image_id, h - 1 - y AS y, w - 1 - x AS x, v FROM p JOIN dims USING (image_id)")
on_pixels("area_center_gray", lambda p: m.grey_centre(p).withColumns({c: F.round(c, 6) for c in ("row", "col")}), "SELECT image_id, CAST(sum(v) AS BIGINT) AS volume, round(sum(y * v)::DOUBLE / sum(v), 6) AS row, round(sum(x * v)::DOUBLE / sum(v), 6) AS col FROM p GROUP BY image_id HAVING sum(v) > 0")
on_pixels("gray_blackhat", lambda p: r.combine(r.erode(r.dilate(p, 1), 1), p, lambda a, b: a - b), f"{PX} o.v - p.v AS v FROM p JOIN (SELECT image_id, y, x, min(nv) AS v FROM nc GROUP BY image_id, y, x) o USING (image_id, y, x)", q._two("max", "min"))
on_pixels("dual_threshold", lambda p: r.point(p, lambda v: F.when(v < 100, -1).when(v > 160, 1).otherwise(0)), f"{PX} CASE WHEN v < 100 THEN -1 WHEN v > 160 THEN 1 ELSE 0 END AS v FROM p")
on_pixels("apply_mask", lambda p: p.join(rg.mask(q._a(p)), r.KEY, "left_semi").select(*r.KEY, "v"), f"{PX} v FROM p WHERE v >= 160")
on_pixels("lbp_histogram", lambda p: r.histogram(r.lbp(p)), f"SELECT image_id, v, count(*) AS n FROM (SELECT image_id, CASE WHEN y = 0 OR x = 0 OR y = h - 1 OR x = w - 1 THEN 0 ELSE {q._lbp} END AS v FROM nb JOIN dims USING (image_id) GROUP BY image_id, y, x, v, h, w) GROUP BY image_id, v", near(1, 1))

on_pixels("region_xor", lambda p: rg.union(rg.difference(q._a(p), q._b(p), q._frame(p)), rg.difference(q._b(p), q._a(p), q._frame(p))), RUNS, q._isl(f"(({q._A} EXCEPT {q._B}) UNION ({q._B} EXCEPT {q._A}))", "z"))
_opened = f"(SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {q._shrink}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))"
on_pixels("region_opening", lambda p: rg.dilate(rg.erode(rg.runs(r.in_range(p, 110, 255)), 1, 1), 1, 1), RUNS, q._isl(_opened, "z"))
on_pixels("hysteresis", lambda p: m.hysteresis(p, 170, 200), "SELECT * FROM lab WHERE (image_id, region_id) IN (SELECT (image_id, region_id) FROM px JOIN p USING (image_id, y, x) WHERE v >= 200)", q._cc, True)
on_pixels("regions_off_border", lambda p: m.off_border(q._feat(p), p), "SELECT ft.* FROM ft JOIN dims USING (image_id) WHERE y0 > 0 AND x0 > 0 AND y1 < h - 1 AND x1 < w - 1", q._cc, True)
on_pixels("select_shape_std", lambda p: m.usual(q._feat(p), "area", 1.0), "SELECT * EXCLUDE (mu, sd) FROM (SELECT *, avg(area) OVER (PARTITION BY image_id) AS mu, stddev_pop(area) OVER (PARTITION BY image_id) AS sd FROM ft) WHERE abs(area - mu) <= sd", q._cc, True)
on_pixels("region_roundness", lambda p: m.roundness(q._lab(p)).withColumns({c: F.round(c, 6) for c in ("circularity", "compactness")}), "SELECT image_id, region_id, round(4 * pi() * area / (pr * pr), 6) AS circularity, round(pr * pr / area::DOUBLE, 6) AS compactness FROM ft JOIN (SELECT image_id, region_id, count(*) AS pr FROM px a WHERE (SELECT count(*) FROM px b WHERE b.image_id = a.image_id AND b.region_id = a.region_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1) < 9 GROUP BY ALL) USING (image_id, region_id)", q._cc, True)
on_pixels("region_inertia", lambda p: m.inertia(q._feat(p)).withColumns({c: F.round(c, 3) for c in ("ia", "ib")}), "SELECT image_id, region_id, round((h + s) * area, 3) AS ia, round((h - s) * area, 3) AS ib FROM (SELECT *, (m20 + m02) / 2 AS h, sqrt(greatest(0, (m20 + m02) / 2 * ((m20 + m02) / 2) - (m20 * m02 - m11 * m11))) AS s FROM ft)", q._cc, True)

for _w, _o in {"first": "i", "last": "i DESC", "strongest": "amplitude DESC, i"}.items():
    on(views.profile, f"edge_{_w}", lambda p, w=_w: m.chosen_edges(q._e(p), w).select("user_id", "i", F.round("position", 6).alias("position"), "amplitude", "polarity"), f"SELECT user_id, i, round(position, 6) AS position, amplitude, polarity FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_o}) AS n FROM ed) WHERE n = 1", q._d)
on(views.profile, "fuzzy_edges", lambda p: m.fuzzy_edges(p, g.edges(p, 0.0), 5.0).select("user_id", "i", "amplitude", F.round("score", 6).alias("score")), "SELECT user_id, i, amplitude, round(CASE WHEN s < 0.3::DOUBLE THEN 0 WHEN s >= 0.8::DOUBLE THEN 1 ELSE (s - 0.3::DOUBLE) / (0.8::DOUBLE - 0.3::DOUBLE) END, 6) AS score FROM (SELECT user_id, i, a AS amplitude, a / max(a) OVER (PARTITION BY user_id) AS s FROM nb3 JOIN (SELECT user_id, max(v) - min(v) AS c FROM prof GROUP BY user_id) USING (user_id) WHERE a >= l AND a > r AND a >= 0.3::DOUBLE * greatest(5::DOUBLE, c))", q._d)
on(views.profile, "profile_stats", lambda p: p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation")), "SELECT user_id, count(*) AS n, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM prof GROUP BY user_id")


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


on(views.points, "robust_weights", lambda p: _rounded(m.robust_weights(p), "huber", "tukey"), "SELECT case_id, x, y, round(CASE WHEN z <= 1.345::DOUBLE THEN 1 ELSE 1.345::DOUBLE / z END, 6) AS huber, round(CASE WHEN z > 4.685::DOUBLE THEN 0 ELSE (1 - z / 4.685::DOUBLE * (z / 4.685::DOUBLE)) * (1 - z / 4.685::DOUBLE * (z / 4.685::DOUBLE)) END, 6) AS tukey FROM (SELECT *, CASE WHEN s > 0 THEN d / s ELSE 0 END AS z FROM (SELECT *, median(d) OVER (PARTITION BY case_id) / 0.6745::DOUBLE AS s FROM (SELECT *, abs(y - median(y) OVER (PARTITION BY case_id)) AS d FROM pts)))")
_row = lambda k, i: f"(x * {k[i]!r}::DOUBLE + y * {k[i + 1]!r}::DOUBLE + {k[i + 2]!r}::DOUBLE)"
for _n, _k in {"affine_points": (0.5, -0.25, 3.0, 0.25, 0.5, -7.0, 0.0, 0.0, 1.0), "homography_points": (1.0, 0.1, 5.0, -0.2, 0.9, 2.0, 0.001, 0.00001, 1.0)}.items():
    on(views.points, _n, lambda p, k=_k: _rounded(m.mapped(p, k), "u", "w"), f"SELECT case_id, x, y, round({_row(_k, 0)} / {_row(_k, 6)}, 6) AS u, round({_row(_k, 3)} / {_row(_k, 6)}, 6) AS w FROM pts")
on(views.points, "polar_points", lambda p: _rounded(m.polar(p, 25.0, 40000.0), "radius", "angle"), "SELECT case_id, x, y, round(sqrt((x - 25::DOUBLE) * (x - 25::DOUBLE) + (y - 40000::DOUBLE) * (y - 40000::DOUBLE)), 6) AS radius, round(atan2(y - 40000::DOUBLE, x - 25::DOUBLE), 6) AS angle FROM pts")
on(views.points, "distort_points", lambda p: _rounded(m.distorted(p.select("case_id", (F.col("x") / 50).alias("x"), (F.col("y") / 100000).alias("y")), (-0.2, 0.05, 0.01), (0.001, -0.002)), "u", "w"), "SELECT case_id, x, y, round(x * f + 0.002::DOUBLE * x * y + -0.002::DOUBLE * (r2 + 2 * x * x), 6) AS u, round(y * f + 0.001::DOUBLE * (r2 + 2 * y * y) + -0.004::DOUBLE * x * y, 6) AS w FROM (SELECT *, 1 + -0.2::DOUBLE * r2 + 0.05::DOUBLE * (r2 * r2) + 0.01::DOUBLE * (r2 * r2 * r2) AS f FROM (SELECT *, x * x + y * y AS r2 FROM (SELECT case_id, x / 50::DOUBLE AS x, y / 100000::DOUBLE AS y FROM pts)))")
on(views.points, "point_boxes", lambda p: p.groupBy("case_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")), "SELECT case_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY case_id")

on(views.rgb, "hsl", lambda c: _rounded(m.hsl(c), "h", "s", "l"), "SELECT l_orderkey, l_linenumber, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN 60 * ((g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END) WHEN hi = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END, 6) AS h, round(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(hi + lo - 1)) END, 6) AS s, round((hi + lo) / 2, 6) AS l FROM (SELECT *, hi - lo AS d FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT l_orderkey, l_linenumber, r / 255::DOUBLE AS r, g / 255::DOUBLE AS g, b / 255::DOUBLE AS b FROM rgb)))")
on(views.rgb, "color_range", lambda c: c.where("r BETWEEN 50 AND 200 AND g BETWEEN 0 AND 150 AND b BETWEEN 31 AND 248"), "SELECT * FROM rgb WHERE r BETWEEN 50 AND 200 AND g BETWEEN 0 AND 150 AND b BETWEEN 31 AND 248")
on(views.rgb, "invert_color", lambda c: c.select("l_orderkey", "l_linenumber", *((255 - F.col(x)).alias(x) for x in "rgb")), "SELECT l_orderkey, l_linenumber, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM rgb")
on(views.rgb, "color_covariance", lambda c: c.groupBy("l_linenumber").agg(*(F.round(F.covar_pop(a, b), 4).alias(a + b) for a, b in ("rr", "rg", "rb", "gg", "gb", "bb"))), "SELECT l_linenumber, " + ", ".join(f"round(covar_pop({a}, {b}), 4) AS {a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM rgb GROUP BY l_linenumber")
_C = [(40, 60, 80), (130, 120, 120), (220, 200, 160)]
_km = "kd AS (SELECT *, " + ", ".join(f"(r - {a}) * (r - {a}) + (g - {b}) * (g - {b}) + (b - {c}) * (b - {c}) AS d{i}" for i, (a, b, c) in enumerate(_C)) + " FROM rgb), ka AS (SELECT l_orderkey, l_linenumber, r, g, b, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM kd)"
on(views.rgb, "kmeans_assign", lambda c: m.assigned(c, _C), "SELECT * FROM ka", _km)
on(views.rgb, "kmeans_step", lambda c: m.assigned(c, _C).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(x), 6).alias(x) for x in "rgb")), "SELECT cluster, count(*) AS n, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM ka GROUP BY cluster", _km)

_ring = "kr AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i))"
on(views.contour_points, "point_in_contour", lambda k: m.contains(k, 1500.5, 500.5), "SELECT contour_id, count(*) FILTER (WHERE (y > 500.5::DOUBLE) <> (ny > 500.5::DOUBLE) AND 1500.5::DOUBLE < (nx - x) * (500.5::DOUBLE - y) / (ny - y) + x) % 2 = 1 AS inside FROM kr GROUP BY contour_id", _ring)
on(views.contour_points, "point_contour_distance", lambda k: _rounded(m.vertex_distance(k, 1500.0, 500.0), "distance"), "SELECT contour_id, round(sqrt(min((x - 1500::DOUBLE) * (x - 1500::DOUBLE) + (y - 500::DOUBLE) * (y - 500::DOUBLE))), 6) AS distance FROM k GROUP BY contour_id")
on(views.contour_points, "smooth_contour", lambda k: _rounded(m.smoothed(k), "x", "y"), "SELECT contour_id, i, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
