"""Queries of local thresholds, grey maps, kernels, distances, edges and warps, added to the registry on import."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import levels as m
from ..operators import raster as r
from ..operators import regions as rg
from . import registry as q
from .registry import PX, near, on_pixels

NB = "GROUP BY image_id, y, x"


def rounded(df, *names):
    """Doubles to six places."""
    return df.withColumns({c: F.round(c, 6) for c in names})


on_pixels("gamma_image", lambda p: m.gamma(p, 0.45), f"{PX} CAST(floor(greatest(0, least(255, pow(v / 255.0::DOUBLE, 0.45::DOUBLE) * 255.0::DOUBLE))) AS INTEGER) AS v FROM p")
on_pixels("log_image", m.logarithm, f"{PX} CAST(floor(greatest(0, least(255, ln(v + 1.0::DOUBLE) / ln(256.0::DOUBLE) * 255.0::DOUBLE))) AS INTEGER) AS v FROM p")
_two = "a AS (SELECT image_id, y, x, v > 150 AS s FROM p), b AS (SELECT image_id, y, w - 1 - x AS x, v > 150 AS t FROM p JOIN dims USING (image_id))"
for _n, _e in {"and": "s AND t", "or": "s OR t", "xor": "s <> t", "diff": "s AND NOT t"}.items():
    on_pixels(f"binary_{_n}", lambda p, n=_n: m.binary(b := r.threshold(p, 150), r.mirror(b, "column"), n), f"{PX} CASE WHEN {_e} THEN 255 ELSE 0 END AS v FROM a JOIN b USING (image_id, y, x)", _two)
on_pixels("image_counts", lambda p: rounded(m.counts(p, q.LO, q.HI), "foreground"), f"SELECT image_id, count(*) FILTER (WHERE v <> 0) AS nonzero, count(*) FILTER (WHERE v BETWEEN {q.LO} AND {q.HI}) AS in_range, round(count(*) FILTER (WHERE v > 0) / count(*)::DOUBLE, 6) AS foreground, bool_and(v IN (0, 255)) AS is_binary FROM p GROUP BY image_id")

_local = near(1, 1) + f", lm AS (SELECT image_id, y, x, v, sum(nv) / 9.0::DOUBLE AS m, sqrt((sum(nv * nv) * 9.0::DOUBLE - sum(nv) * sum(nv)) / 81.0::DOUBLE) AS s FROM nb GROUP BY image_id, y, x, v), wl AS (SELECT lm.*, lo, sd FROM lm JOIN (SELECT image_id, min(v) AS lo, max(s) AS sd FROM lm GROUP BY image_id) USING (image_id))"
for _n, _k, _e in (("mean", 8.0, "m - 8.0::DOUBLE"), ("niblack", 0.4, "m + 0.4::DOUBLE * s"), ("sauvola", 0.2, "m * (1 + 0.2::DOUBLE * (s / 128.0::DOUBLE - 1))"), ("wolf", 0.3, "m - 0.3::DOUBLE * (1 - s / 128.0::DOUBLE) * m")):
    on_pixels(f"adaptive_{_n}", lambda p, n=_n, k=_k: m.adaptive(p, 1, n, k), f"SELECT image_id, y, x FROM wl WHERE v > {_e}", _local)

_w = [[1.0, -2.0, 0.0], [3.0, 5.0, -1.0], [0.0, 2.0, -4.0]]
_at = lambda k: "CASE " + " ".join(f"WHEN dy = {i - 1} AND dx = {j - 1} THEN {f}::DOUBLE" for i, line in enumerate(k) for j, f in enumerate(line)) + " END"
on_pixels("convol_image", lambda p: m.convolve(p, _w), f"{PX} CAST(sum(nv * {_at(_w)}) AS DOUBLE) AS v FROM nb {NB}", near(1, 1))
_slopes = near(1, 1) + f", sl AS (SELECT image_id, y, x, CAST(sum(nv * dx * (2 - abs(dy))) AS DOUBLE) AS gx, CAST(sum(nv * dy * (2 - abs(dx))) AS DOUBLE) AS gy FROM nb {NB})"
on_pixels("sobel_dir", lambda p: m.slopes(p).select(*r.KEY, F.round(F.atan2("gy", "gx"), 6).alias("direction")), f"{PX} round(atan2(gy, gx), 6) AS direction FROM sl", _slopes)
on_pixels("gradient_magnitude", lambda p: m.slopes(p).select(*r.KEY, F.round(F.sqrt(F.expr("gx * gx + gy * gy")), 6).alias("v")), f"{PX} round(sqrt(gx * gx + gy * gy), 6) AS v FROM sl", _slopes)
_kernel = q._k
_taps = f"[{', '.join(f'{c!r}::DOUBLE' for c in _kernel)}]"
on_pixels("unsharp_mask", lambda p: m.unsharp(p, _kernel, 0.7, 2.0), f"{PX} CASE WHEN abs(v - g) > 2 THEN CAST(floor(greatest(0, least(255, v + 0.7::DOUBLE * (v - g)))) AS INTEGER) ELSE v END AS v FROM (SELECT image_id, y, x, v, sum(nv * {_taps}[dy + 4] * {_taps}[dx + 4]) AS g FROM nb GROUP BY image_id, y, x, v)", near(3, 3))
on_pixels("bilateral_filter", lambda p: rounded(m.bilateral(p, 1, 1.5, 30.0), "v"), f"{PX} round(sum(nv * f) / sum(f), 6) AS v FROM (SELECT *, exp(-(dy * dy + dx * dx) / 4.5::DOUBLE) * exp((nv - v) * (nv - v) / -1800.0::DOUBLE) AS f FROM nb) {NB}", near(1, 1))
on_pixels("local_maxima", m.local_maxima, f"{PX} v FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.image_id = p.image_id AND abs(o.y - p.y) <= 1 AND abs(o.x - p.x) <= 1 AND (o.y <> p.y OR o.x <> p.x) AND o.v >= p.v)")
on_pixels(
    "histogram_match",
    lambda p: m.match_histogram(p, p.where("image_id = 0")),
    f"""{PX} u AS v FROM p JOIN (
      SELECT image_id, v, arg_min(u, gap * 256 + u) AS u FROM (
        SELECT c.image_id, c.v, f.u, abs(f.c * c.total - c.c * f.total) AS gap
        FROM c, (SELECT g.u, max(total) AS total, sum(CASE WHEN v <= g.u THEN n ELSE 0 END) AS c FROM c, (SELECT unnest(range(256)) AS u) g WHERE image_id = 0 GROUP BY g.u) f)
      GROUP BY image_id, v) USING (image_id, v)""",
    q._h,
)
for _n, _e in {"l1": "abs(a.y - b.y) + abs(a.x - b.x)", "linf": "greatest(abs(a.y - b.y), abs(a.x - b.x))", "l2": "sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"}.items():
    on_pixels(f"distance_{_n}", lambda p, n=_n: rounded(m.distances(p, 80, n), "distance"), f"SELECT a.image_id, a.y, a.x, round(CAST(min({_e}) AS DOUBLE), 6) AS distance FROM p a LEFT JOIN p b ON a.image_id = b.image_id AND b.v < 80 WHERE a.v >= 80 GROUP BY a.image_id, a.y, a.x")

_at8 = lambda dy, dx: f"max(CASE WHEN b.y = a.y + ({dy}) AND b.x = a.x + ({dx}) THEN b.m END)"
_pick = lambda s: f"CASE WHEN abs(gy) <= abs(gx) * 0.41421356::DOUBLE THEN {_at8(0, s)} WHEN abs(gx) <= abs(gy) * 0.41421356::DOUBLE THEN {_at8(s, 0)} WHEN gx * gy > 0 THEN {_at8(s, s)} ELSE {_at8(s, -s)} END"
_thin = _slopes + f""", am AS (SELECT *, abs(gx) + abs(gy) AS m FROM sl),
te AS (SELECT image_id, y, x, CASE WHEN n = 9 AND m >= pa AND m >= pb THEN CAST(m AS INTEGER) ELSE 0 END AS v FROM (SELECT a.image_id, a.y, a.x, a.m, count(*) AS n, {_pick(-1)} AS pa, {_pick(1)} AS pb
  FROM am a JOIN (SELECT image_id, y, x, m FROM am) b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.image_id, a.y, a.x, a.m, a.gx, a.gy))"""
on_pixels("thin_edges", m.thin_edges, f"{PX} v FROM te", _thin)
on_pixels("edges_image", lambda p: m.strong_edges(p, 260, 420), "SELECT * FROM lab WHERE (image_id, region_id) IN (SELECT (image_id, region_id) FROM px JOIN te USING (image_id, y, x) WHERE v >= 420)", _thin + ", " + q._cc.replace("FROM p WHERE v >= 170", "FROM te WHERE v >= 260"), True)

_bilinear = lambda grid: f"""SELECT image_id, y, x, round(sum(f * v), 6) AS v FROM (SELECT g.image_id, g.y, g.x, s.v, (CASE WHEN a = 1 THEN w - w0 ELSE 1 - w + w0 END) * (CASE WHEN b = 1 THEN u - u0 ELSE 1 - u + u0 END) AS f
  FROM (SELECT *, floor(u) AS u0, floor(w) AS w0 FROM ({grid})) g CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) JOIN p s ON s.image_id = g.image_id AND s.y = w0 + a AND s.x = u0 + b) GROUP BY image_id, y, x HAVING count(*) = 4"""  # noqa: E731
_hm = (1.1, 0.05, -3.0, -0.04, 0.95, 2.0, 0.0009, -0.0004, 1.0)
_row = lambda i: f"(x * {_hm[i]!r}::DOUBLE + y * {_hm[i + 1]!r}::DOUBLE + {_hm[i + 2]!r}::DOUBLE)"
on_pixels("projective_warp", lambda p: rounded(m.projective(p, _hm), "v"), _bilinear(f"SELECT image_id, y, x, {_row(0)} / {_row(6)} AS u, {_row(3)} / {_row(6)} AS w FROM p"))
_step, _turn = (25.0 - 5.0) / 15, 2 * math.pi / 48
on_pixels("polar_unwrap", lambda p: rounded(m.unwrapped(p, 31.3, 30.7, 5.0, 25.0, 16, 48), "v"), _bilinear(f"SELECT image_id, y, x, (y * {_step!r}::DOUBLE + 5.0::DOUBLE) * cos(x * {_turn!r}::DOUBLE) + 30.7::DOUBLE AS u, (y * {_step!r}::DOUBLE + 5.0::DOUBLE) * sin(x * {_turn!r}::DOUBLE) + 31.3::DOUBLE AS w FROM (SELECT DISTINCT image_id FROM p), (SELECT CAST(unnest(range(16)) AS INTEGER) AS y), (SELECT CAST(unnest(range(48)) AS INTEGER) AS x)"))

_turns = [0.0, 0.3, -0.3]
_tv = ", ".join(f"({i}, {round(math.cos(a), 12)!r}::DOUBLE, {round(math.sin(a), 12)!r}::DOUBLE)" for i, a in enumerate(_turns))
_mir = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 15 THEN 30 - ({c}) ELSE {c} END"
_shape = _slopes + f""", tp AS (SELECT y, x, v FROM p WHERE image_id = 0 AND y < 16 AND x < 16),
ts AS (SELECT a.y, a.x, CAST(sum(b.v * dx * (2 - abs(dy))) AS DOUBLE) AS gx, CAST(sum(b.v * dy * (2 - abs(dx))) AS DOUBLE) AS gy FROM tp a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) JOIN tp b ON b.y = {_mir('a.y + dy')} AND b.x = {_mir('a.x + dx')} GROUP BY a.y, a.x),
tt AS (SELECT turn, CAST(floor(x * c - y * s + 0.5::DOUBLE) AS INTEGER) AS dx, CAST(floor(x * s + y * c + 0.5::DOUBLE) AS INTEGER) AS dy, (gx * c - gy * s) / n AS tu, (gx * s + gy * c) / n AS tw, count(*) OVER (PARTITION BY turn) AS points
  FROM (SELECT *, sqrt(gx * gx + gy * gy) AS n FROM ts WHERE abs(gx) + abs(gy) >= 420) CROSS JOIN (VALUES {_tv}) k(turn, c, s)),
un AS (SELECT image_id, y, x, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE gx / sqrt(gx * gx + gy * gy) END AS u, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE gy / sqrt(gx * gx + gy * gy) END AS w FROM sl)"""
on_pixels("shape_match", lambda p: rounded(m.shape_match(p, r.crop(p.where("image_id = 0"), 0, 0, 16, 16), 420.0, _turns), "score"), "SELECT image_id, turn, y - dy AS y, x - dx AS x, round(sum(tu * u + tw * w) / count(*), 6) AS score FROM un, tt GROUP BY image_id, turn, y - dy, x - dx, points HAVING count(*) = points", _shape)

on_pixels("region_gray_features", lambda p: rounded(m.region_grey(q._lab(p), p), "mean", "deviation"), "SELECT image_id, region_id, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM px JOIN p USING (image_id, y, x) GROUP BY image_id, region_id", q._cc, True)
on_pixels("region_moments", lambda p: m.raw_moments(q._lab(p)), "SELECT image_id, region_id, " + ", ".join(f"CAST(sum({'*'.join(['1', *['x'] * a, *['y'] * b])}) AS BIGINT) AS m{a}{b}" for a in range(4) for b in range(4 - a)) + " FROM px GROUP BY image_id, region_id", q._cc, True)
on_pixels("region_ellipse", lambda p: m.ellipse(q._feat(p)).withColumns({c: F.round(c, 4) for c in ("ra", "rb", "phi", "anisometry")}), "SELECT image_id, region_id, round(ra, 4) AS ra, round(rb, 4) AS rb, round(phi, 4) AS phi, round(CASE WHEN rb > 0.001::DOUBLE THEN ra / rb END, 4) AS anisometry FROM (SELECT *, sqrt(greatest(0, 2 * (m20 + m02 + s))) AS ra, sqrt(greatest(0, 2 * (m20 + m02 - s))) AS rb, 0.5::DOUBLE * atan2(CASE WHEN m11 = 0 THEN 0 ELSE 2 * m11 END, m02 - m20) AS phi FROM (SELECT *, sqrt((m20 - m02) * (m20 - m02) + 4 * m11 * m11) AS s FROM ft))", q._cc, True)
on_pixels("region_boundary", lambda p: m.inner_boundary(r.in_range(p, 110, 255)), "SELECT a.image_id, a.y, a.x FROM p a LEFT JOIN p b ON a.image_id = b.image_id AND b.v >= 110 AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.v >= 110 GROUP BY a.image_id, a.y, a.x HAVING count(b.x) < 4")
_hole = q._cc.replace("FROM p WHERE v >= 170", "FROM p WHERE v < 110").replace("a.cb <= b.ce AND b.cb <= a.ce", "a.cb < b.ce AND b.cb < a.ce") + ", hl AS (SELECT lab.* FROM lab WHERE (image_id, region_id) NOT IN (SELECT (image_id, region_id) FROM lab JOIN dims USING (image_id) WHERE y = 0 OR y = h - 1 OR cb = 0 OR ce = w))"
on_pixels("region_holes", lambda p: m.holes(r.in_range(p, 110, 255), q._frame(p)), "SELECT * FROM hl", _hole, True)
on_pixels("fill_up", lambda p: m.filled(r.in_range(p, 110, 255), q._frame(p)), "SELECT image_id, y, CAST(cb AS INTEGER) AS cb, CAST(ce AS INTEGER) AS ce FROM zz", _hole + ", " + q._isl("(SELECT image_id, y, x FROM p WHERE v >= 110 UNION SELECT image_id, y, unnest(range(cb, ce)) AS x FROM hl)", "zz"), True)
