"""Queries of further shape features, orders, structuring elements, tones, calipers and robust fits, added to the registry on import."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import blobs as b
from ..operators import calipers as cal
from ..operators import geometry as g
from ..operators import raster as r
from ..operators import regions as rg
from ..operators import shapes as sh
from ..operators import tone
from ..sources import views
from . import registry as q
from .registry import PX, on, on_pixels
from .shaped import R, _xyz, rounded

# regions

_hu = ["n20 + n02", "dd * dd + 4 * n11 * n11", "ss * ss + tt * tt", "pp * pp + qq * qq",
       "ss * pp * (pp * pp - 3 * qq * qq) + tt * qq * (3 * pp * pp - qq * qq)",
       "dd * (pp * pp - qq * qq) + 4 * n11 * pp * qq",
       "tt * pp * (pp * pp - 3 * qq * qq) - ss * qq * (3 * pp * pp - qq * qq)"]
_central = """ct AS (SELECT image_id, region_id, count(*) AS area,
  sum((x - cx) * (x - cx)) / pow(count(*), 2.0) AS n20, sum((y - cy) * (y - cy)) / pow(count(*), 2.0) AS n02, sum((x - cx) * (y - cy)) / pow(count(*), 2.0) AS n11,
  sum(pow(x - cx, 3)) / pow(count(*), 2.5) AS n30, sum(pow(y - cy, 3)) / pow(count(*), 2.5) AS n03,
  sum((x - cx) * (x - cx) * (y - cy)) / pow(count(*), 2.5) AS n21, sum((x - cx) * (y - cy) * (y - cy)) / pow(count(*), 2.5) AS n12
  FROM (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM px WINDOW w AS (PARTITION BY image_id, region_id)) GROUP BY image_id, region_id)"""
_n = ("n20", "n02", "n11", "n30", "n03", "n21", "n12")
on_pixels(
    "region_central_moments",
    lambda p: rounded(b.central_moments(q._lab(p)).select("image_id", "region_id", "area", *_n), *_n),
    "SELECT image_id, region_id, area, " + ", ".join(R(c, c) for c in _n) + " FROM ct",
    f"{q._cc}, {_central}",
    True,
)
on_pixels(
    "region_hu",
    lambda p: rounded(b.hu_moments(q._lab(p)), *(f"hu{i}" for i in range(1, 8))),
    "SELECT image_id, region_id, " + ", ".join(R(e, f"hu{i + 1}") for i, e in enumerate(_hu)) + " FROM (SELECT *, n30 + n12 AS pp, n21 + n03 AS qq, n30 - 3 * n12 AS ss, 3 * n21 - n03 AS tt, n20 - n02 AS dd FROM ct)",
    f"{q._cc}, {_central}",
    True,
)
_axes = """el AS (SELECT image_id, region_id, area, sqrt(greatest(0, 2 * (a + c + s))) AS ra, sqrt(greatest(0, 2 * (a + c - s))) AS rb
  FROM (SELECT *, sqrt((a - c) * (a - c) + 4 * m * m) AS s FROM (SELECT image_id, region_id, count(*) AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS m FROM px GROUP BY ALL)))"""
_long = {"eccentricity": "sqrt(1 - pow(rb / ra, 2))", "elongation": "1 - rb / ra", "bulkiness": "pi() * ra * rb / area", "structure": "ra / rb * (pi() * ra * rb / area) - 1"}
on_pixels(
    "region_elongation",
    lambda p: rounded(b.elongation(rg.features(q._lab(p))), *_long, to=5),
    "SELECT image_id, region_id, " + ", ".join(R(f"CASE WHEN rb > 0.001 THEN {e} END", n, 5) for n, e in _long.items()) + " FROM el",
    f"{q._cc}, {_axes}",
    True,
)
_cells = ", ".join(f"({i}, {j}, {1 << (2 * i + j)})" for i in (0, 1) for j in (0, 1))
on_pixels(
    "euler_number",
    lambda p: b.euler_number(r.in_range(p, 150, 255)),
    f"""SELECT image_id, CAST((sum((bits IN (1, 2, 4, 8))::INT) - sum((bits IN (7, 11, 13, 14))::INT) - 2 * sum((bits IN (6, 9))::INT)) / 4 AS BIGINT) AS euler
      FROM (SELECT image_id, y + a AS y, x + c AS x, sum(bit) AS bits FROM p, (VALUES {_cells}) t(a, c, bit) WHERE v >= 150 GROUP BY ALL) GROUP BY image_id""",
)
on_pixels("select_shape_multi", lambda p: b.select_shapes(q._feat(p), {"area": (3, 80), "row": (10, 50)}), "SELECT * FROM ft WHERE area BETWEEN 3 AND 80 AND row BETWEEN 10 AND 50", q._cc, True)
on_pixels("select_shape_any", lambda p: b.select_shapes(q._feat(p), {"area": (30, 80), "y0": (0, 3)}, False), "SELECT * FROM ft WHERE area BETWEEN 30 AND 80 OR y0 BETWEEN 0 AND 3", q._cc, True)
on_pixels("sort_regions_position", lambda p: b.ordered(q._feat(p), "position"), "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, region_id) - 1 AS place FROM ft", q._cc, True)
on_pixels("sort_regions_area", lambda p: b.ordered(q._feat(p), "area", True), "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, region_id) - 1 AS place FROM ft", q._cc, True)

# structuring elements of any form

CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
DISC = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 5]
HOOK = [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)]
_at = lambda element: ", ".join(map(str, element))
_A = "SELECT image_id, y, x FROM p WHERE v >= 160"
on_pixels("dilation_disc", lambda p: b.dilate(r.in_range(p, 160, 255), DISC), f"SELECT DISTINCT image_id, y + a AS y, x + c AS x FROM ({_A}), (VALUES {_at(DISC)}) t(a, c)")
on_pixels("erosion_hook", lambda p: b.erode(r.in_range(p, 110, 255), HOOK), f"SELECT image_id, y - a AS y, x - c AS x FROM p, (VALUES {_at(HOOK)}) t(a, c) WHERE v >= 110 GROUP BY ALL HAVING count(*) = {len(HOOK)}")
for _name, _up, _f in (("gray_dilation_cross", True, "max"), ("gray_erosion_cross", False, "min")):
    on_pixels(
        _name,
        lambda p, up=_up: b.grey_morphology(p, CROSS, up),
        f"SELECT image_id, y, x, {_f}(n.v) AS v FROM p JOIN (SELECT image_id, y - a AS y, x - c AS x, v FROM p, (VALUES {_at(CROSS)}) t(a, c)) n USING (image_id, y, x) GROUP BY ALL",
    )

# lines and positions

_better = "(o.votes > m.votes OR (o.votes = m.votes AND (o.t < m.t OR (o.t = m.t AND o.rho < m.rho))))"
on_pixels(
    "hough_peaks",
    lambda p: b.hough_peaks(g.hough(r.in_range(p, 185, 255), 180), 180, 8, 10, 6),
    f"SELECT image_id, t, rho, votes FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image_id = m.image_id AND abs(o.t - m.t) <= 10 AND abs(o.rho - m.rho) <= 6 AND {_better})",
    f"{q._votes}, m AS (SELECT * FROM votes WHERE votes >= 8), o AS (SELECT * FROM m UNION ALL SELECT image_id, t - 180, -rho, votes FROM m UNION ALL SELECT image_id, t + 180, -rho, votes FROM m)",
)
_spots = lambda p, test: p.where(test).select("image_id", F.col("y").cast("double").alias("row"), F.col("x").cast("double").alias("col"), (F.col("y") * 64 + F.col("x")).alias("id"))
on_pixels(
    "band_join",
    lambda p: b.band_join(_spots(p, "v >= 215"), _spots(p, "v <= 40"), 2.0),
    """SELECT a.image_id, a.y * 64 + a.x AS id, c.y * 64 + c.x AS id2, CAST(c.y - a.y AS DOUBLE) AS drow, CAST(c.x - a.x AS DOUBLE) AS dcol
      FROM p a JOIN p c ON a.image_id = c.image_id AND a.v >= 215 AND c.v <= 40 AND abs(a.y - c.y) <= 2 AND abs(a.x - c.x) <= 2""",
)

# contours

_of = "cf AS (SELECT contour_id, count(*) AS n, min(x) AS x0 FROM k GROUP BY ALL)"
_cf = lambda k: k.groupBy("contour_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"))
on(views.contour_points, "sort_contours", lambda k: b.ordered_contours(_cf(k), "n", True), "SELECT *, row_number() OVER (ORDER BY n DESC, contour_id) - 1 AS place FROM cf", _of)
on(views.contour_points, "sort_contours_position", lambda k: b.ordered_contours(_cf(k), "x0"), "SELECT *, row_number() OVER (ORDER BY x0, contour_id) - 1 AS place FROM cf", _of)
on(
    views.contour_points,
    "concat_contours",
    lambda k: b.concatenated(k, k.withColumn("contour_id", F.col("contour_id") + 1)),
    """SELECT contour_id, i, x, y FROM k UNION ALL SELECT k.contour_id + 1, k.i + coalesce(n, 0), x, y
      FROM k LEFT JOIN (SELECT contour_id, max(i) + 1 AS n FROM k GROUP BY ALL) m ON m.contour_id = k.contour_id + 1""",
)

# tones and colours

_T = 4
_clahe = f"""tl AS (SELECT p.*, h, w, y // CAST(ceil(h / {_T}.0) AS INT) AS ty, x // CAST(ceil(w / {_T}.0) AS INT) AS tx FROM p JOIN dims USING (image_id)),
th AS (SELECT image_id, ty, tx, v AS b, count(*) AS n FROM tl GROUP BY ALL),
tz AS (SELECT image_id, ty, tx, sum(n) AS size, greatest(1, floor(sum(n) * 2.0 / 256)) AS clip FROM th GROUP BY ALL),
tf AS (SELECT image_id, ty, tx, b, clip, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(256)) AS b FROM tz) LEFT JOIN th USING (image_id, ty, tx, b)),
to_ AS (SELECT *, sum(greatest(n - clip, 0)) OVER (PARTITION BY image_id, ty, tx) AS over_ FROM tf),
tn AS (SELECT image_id, ty, tx, b, least(n, clip) + floor(over_ / 256) + CAST(b < over_ % 256 AS INT) AS n FROM to_),
tu AS (SELECT image_id, ty, tx, b AS v, floor(least(255, sum(n) OVER (PARTITION BY image_id, ty, tx ORDER BY b) * 255.0::DOUBLE / sum(n) OVER (PARTITION BY image_id, ty, tx))) AS u FROM tn),
pp AS (SELECT image_id, y, x, v, (y + 0.5::DOUBLE) * {_T} / h - 0.5::DOUBLE AS py, (x + 0.5::DOUBLE) * {_T} / w - 0.5::DOUBLE AS qx FROM tl),
pq AS (SELECT *, CASE WHEN floor(py) < 0 OR floor(py) >= {_T - 1} THEN 0 ELSE py - floor(py) END AS fy, CASE WHEN floor(qx) < 0 OR floor(qx) >= {_T - 1} THEN 0 ELSE qx - floor(qx) END AS fx FROM pp)"""
on_pixels(
    "clahe",
    lambda p: tone.limited_equalize(p, _T, 2.0),
    f"""SELECT pq.image_id, y, x, CAST(floor(round(sum((CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN c = 1 THEN fx ELSE 1 - fx END) * u), 9) + 0.5) AS INTEGER) AS v
      FROM pq CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS c)
      JOIN tu ON tu.image_id = pq.image_id AND tu.v = pq.v AND ty = greatest(0, least({_T - 1}, floor(py) + a)) AND tx = greatest(0, least({_T - 1}, floor(qx) + c)) GROUP BY ALL""",
    _clahe,
)
_dirs = "(VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(dir, dy, dx)"
_tex = f"""q AS (SELECT *, least(v * 8 // 256, 7) AS i FROM p), o AS (SELECT a.image_id, dir, a.i, c.i AS j FROM q a CROSS JOIN {_dirs} JOIN q c ON a.image_id = c.image_id AND a.y + dy = c.y AND a.x + dx = c.x),
s AS (SELECT image_id, dir, i, j, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT image_id, dir, j, i FROM o) GROUP BY ALL),
d AS (SELECT image_id, dir, sum(p * (i - j) * (i - j)) AS contrast, sum(p * p) AS energy, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * i) AS mean, sum(p * i * i) - sum(p * i) * sum(p * i) AS variance, sum(p * i * j) AS ij
  FROM (SELECT *, n / (sum(n) OVER (PARTITION BY image_id, dir))::DOUBLE AS p FROM s) GROUP BY image_id, dir)"""
_names = ("contrast", "energy", "homogeneity", "mean", "variance", "correlation")
on_pixels(
    "glcm_texture",
    lambda p: rounded(tone.texture(p, 8), *_names),
    "SELECT image_id, " + ", ".join(R(f"avg({n})", n) for n in _names) + " FROM (SELECT *, CASE WHEN variance > 1e-12 THEN (ij - mean * mean) / variance ELSE 0 END AS correlation FROM d) GROUP BY image_id",
    _tex,
)
_xn, _yn, _zn = sh.WHITE
_dn = _xn + 15 * _yn + 3 * _zn
_uv = f"""uv AS (SELECT *, CASE WHEN y / {_yn!r}::DOUBLE > 0.008856::DOUBLE THEN 116 * cbrt(y / {_yn!r}::DOUBLE) - 16 ELSE 903.3::DOUBLE * (y / {_yn!r}::DOUBLE) END AS l,
  CASE WHEN x + 15 * y + 3 * z > 0 THEN 4 * x / (x + 15 * y + 3 * z) ELSE {4 * _xn / _dn!r}::DOUBLE END AS uq, CASE WHEN x + 15 * y + 3 * z > 0 THEN 9 * y / (x + 15 * y + 3 * z) ELSE {9 * _yn / _dn!r}::DOUBLE END AS vq FROM xyz)"""
on(
    views.rgb,
    "cie_luv",
    lambda c: rounded(tone.luv(sh.xyz(c), sh.WHITE), "ll", "uu", "vv", to=4).select("l_orderkey", "l_linenumber", "ll", "uu", "vv"),
    f"SELECT l_orderkey, l_linenumber, {R('l', 'll', 4)}, {R(f'13 * l * (uq - {4 * _xn / _dn!r}::DOUBLE)', 'uu', 4)}, {R(f'13 * l * (vq - {9 * _yn / _dn!r}::DOUBLE)', 'vv', 4)} FROM uv",
    f"{_xyz}, {_uv}",
)
_M = [[0.5, 0.25, 0.25, 10], [0.125, 0.75, 0.125, 0], [-0.25, 0.25, 1.0, -5]]
_cut = lambda e: f"CAST(floor(greatest(0, least(255, {e}))) AS INTEGER)"
on(
    views.rgb,
    "color_matrix",
    lambda c: tone.mixed_channels(c, _M),
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_cut(f'r * {w[0]!r}::DOUBLE + g * {w[1]!r}::DOUBLE + b * {w[2]!r}::DOUBLE + {w[3]!r}')} AS {n}" for w, n in zip(_M, "rgb", strict=True)) + " FROM rgb",
)
on(
    views.rgb,
    "white_balance",
    lambda c: tone.white_balance(c, ["l_linenumber"]),
    "SELECT l_linenumber, l_orderkey, " + ", ".join(f"CASE WHEN m{n} > 0 THEN {_cut(f'round({n} * ((mr + mg + mb) / 3) / m{n}, 9)')} ELSE {n} END AS {n}" for n in "rgb") + " FROM rgb JOIN (SELECT l_linenumber, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM rgb GROUP BY ALL) USING (l_linenumber)",
)

# calipers: one handle an image

_PHI, _L1, _L2, _SIGMA, _LEAST = 0.3, 22, 2, 1.0, 8.0
_handles = lambda p: p.select("image_id").distinct().select(F.col("image_id").alias("handle_id"), "image_id", F.lit(31.0).alias("row"), F.lit(32.0).alias("col"), F.lit(_PHI).alias("phi"), F.lit(_L1).alias("length1"), F.lit(_L2).alias("length2"))
_s, _c = math.sin(_PHI), math.cos(_PHI)
_mp = f"""gr AS (SELECT image_id, i, j, round(32 + i * {_c!r}::DOUBLE + j * {_s!r}::DOUBLE, 9) AS u, round(31 - i * {_s!r}::DOUBLE + j * {_c!r}::DOUBLE, 9) AS w FROM dims CROSS JOIN (SELECT unnest(range(-{_L1}, {_L1 + 1})) AS i) CROSS JOIN (SELECT unnest(range(-{_L2}, {_L2 + 1})) AS j)),
sm AS (SELECT gr.image_id, i, j, sum((CASE WHEN a = 1 THEN w - floor(w) ELSE 1 - w + floor(w) END) * (CASE WHEN e = 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * v) AS v
  FROM gr CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS e) JOIN p ON p.image_id = gr.image_id AND p.y = floor(w) + a AND p.x = floor(u) + e GROUP BY ALL HAVING count(*) = 4),
mp AS (SELECT image_id AS handle_id, i, avg(v) AS v FROM sm GROUP BY ALL)"""
_k = cal.slope_kernel(_SIGMA)
_taps = " + ".join(f"lag(v, {-t}) OVER w * {c!r}::DOUBLE" for t, c in zip(range(-(len(_k) // 2), len(_k) // 2 + 1), _k, strict=True))
_me = f"""{_mp}, mg AS (SELECT * FROM (SELECT *, {_taps} AS g FROM mp WINDOW w AS (PARTITION BY handle_id ORDER BY i)) WHERE g IS NOT NULL),
mn AS (SELECT *, abs(g) AS a, lag(abs(g)) OVER w AS l, lead(abs(g)) OVER w AS q FROM mg WINDOW w AS (PARTITION BY handle_id ORDER BY i)),
ed AS (SELECT handle_id, i, i + CASE WHEN l - 2 * a + q = 0 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (l - q) / (l - 2 * a + q))) END AS position, a AS amplitude, CASE WHEN g > 0 THEN 'positive' ELSE 'negative' END AS polarity
  FROM mn WHERE l IS NOT NULL AND q IS NOT NULL AND a >= {_LEAST!r}::DOUBLE AND a >= l AND a > q)"""
_edges = lambda p: cal.edges(cal.profiles(p, _handles(p)), _SIGMA, _LEAST)
on_pixels("measure_profile", lambda p: rounded(cal.profiles(p, _handles(p)), "v"), f"SELECT handle_id, i, {R('v', 'v')} FROM mp", _mp)
on_pixels("measure_pos", lambda p: rounded(_edges(p), "position", "amplitude", to=5), f"SELECT handle_id, i, {R('position', 'position', 5)}, {R('amplitude', 'amplitude', 5)}, polarity FROM ed", _me)
on_pixels(
    "measure_points",
    lambda p: rounded(cal.located(_edges(p), _handles(p)), "row", "col", "amplitude", to=5),
    f"SELECT handle_id, handle_id AS image_id, i, {R(f'31 - position * {_s!r}::DOUBLE', 'row', 5)}, {R(f'32 + position * {_c!r}::DOUBLE', 'col', 5)}, {R('amplitude', 'amplitude', 5)}, polarity FROM ed",
    _me,
)
on_pixels(
    "measure_pairs",
    lambda p: rounded(cal.pairs(_edges(p), 4.0), "centre", "width", "score", to=5),
    f"""SELECT handle_id, i, polarity, {R('(position + p2) / 2', 'centre', 5)}, {R('p2 - position', 'width', 5)}, {R('least(amplitude, a2) / greatest(amplitude, a2) * greatest(0, 1 - abs(p2 - position - 4) / 4)', 'score', 5)}
      FROM (SELECT *, lead(position) OVER w AS p2, lead(amplitude) OVER w AS a2, lead(polarity) OVER w AS s2 FROM ed WINDOW w AS (PARTITION BY handle_id ORDER BY i)) WHERE polarity <> s2""",
    _me,
)

# robust fits; y is taken in thousands

_scaled = lambda p: p.withColumn("y", F.col("y") / 1000)
_ax = lambda src, name: f"""{name} AS (SELECT case_id, mx, my, 0.5 * atan2(2 * cxy, cxx - cyy) AS angle FROM (
  SELECT case_id, sx / s AS mx, sy / s AS my, sxx / s - (sx / s) * (sx / s) AS cxx, syy / s - (sy / s) * (sy / s) AS cyy, sxy / s - (sx / s) * (sy / s) AS cxy FROM (
    SELECT case_id, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy, count(*) AS n FROM {src} GROUP BY case_id) WHERE s > 0 AND n >= 2))"""  # noqa: E731
_pt = "w0 AS (SELECT case_id, x, y / 1000 AS y, 1.0::DOUBLE AS w FROM pts)"
_irls = _pt
for _i in range(3):
    _irls += f""", {_ax(f'w{_i}', f'l{_i}')}, d{_i} AS (SELECT *, abs((y - my) * cos(angle) - (x - mx) * sin(angle)) AS d FROM w{_i} JOIN l{_i} USING (case_id)),
w{_i + 1} AS (SELECT case_id, x, y, CASE WHEN s <= 0 OR d <= 1.345::DOUBLE * s THEN 1.0::DOUBLE ELSE 1.345::DOUBLE * s / d END AS w FROM (SELECT *, median(d) OVER (PARTITION BY case_id) / 0.6745::DOUBLE AS s FROM d{_i}))"""
on(views.points, "fit_line_huber", lambda p: rounded(cal.fit_line_robust(_scaled(p)), "mx", "my", "angle", to=5), f"SELECT case_id, {R('mx', 'mx', 5)}, {R('my', 'my', 5)}, {R('angle', 'angle', 5)} FROM l3", f"{_irls}, {_ax('w3', 'l3')}")
_TRIES, _IN = 24, 3.0
_ransac = f"""{_pt}, nm AS (SELECT case_id, x, y, row_number() OVER (PARTITION BY case_id ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM w0),
tr AS (SELECT a.case_id, t, a.x AS x1, a.y AS y1, c.x - a.x AS dx, c.y - a.y AS dy FROM (SELECT unnest(range(1, {_TRIES + 1})) AS t) JOIN nm a ON a.n >= 2 AND a.i = (t * 7919) % a.n JOIN nm c ON c.case_id = a.case_id AND c.i = (t * 104729 + 1) % c.n WHERE c.x <> a.x OR c.y <> a.y),
hit AS (SELECT nm.case_id, t, x, y FROM nm JOIN tr USING (case_id) WHERE abs((y - y1) * dx - (x - x1) * dy) <= {_IN!r}::DOUBLE * sqrt(dx * dx + dy * dy)),
vt AS (SELECT case_id, t, count(*) AS inliers FROM hit GROUP BY ALL),
bs AS (SELECT case_id, t, inliers FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY inliers DESC, t) AS k FROM vt) WHERE k = 1),
ow AS (SELECT case_id, x, y, 1.0::DOUBLE AS w FROM hit JOIN bs USING (case_id, t)), {_ax('ow', 'ln')}"""
on(views.points, "ransac_line", lambda p: rounded(cal.ransac_line(_scaled(p), _TRIES, _IN), "mx", "my", "angle", to=5), f"SELECT case_id, inliers, {R('mx', 'mx', 5)}, {R('my', 'my', 5)}, {R('angle', 'angle', 5)} FROM ln JOIN bs USING (case_id)", _ransac)
_K, _P = (0.02, -0.003, 0.0005), (0.001, -0.002)
_norm = lambda p: p.select("case_id", (F.col("x") / 50).alias("x"), (F.col("y") / 100000).alias("y"))
_und = "u0 AS (SELECT case_id, x / 50 AS x, y / 100000 AS y, x / 50 AS u, y / 100000 AS w FROM pts)"
for _i in range(8):
    _und += f""", u{_i + 1} AS (SELECT case_id, x, y, (x - (2 * {_P[0]!r}::DOUBLE * u * w + {_P[1]!r}::DOUBLE * (r2 + 2 * u * u))) / s AS u, (y - ({_P[0]!r}::DOUBLE * (r2 + 2 * w * w) + 2 * {_P[1]!r}::DOUBLE * u * w)) / s AS w
  FROM (SELECT *, 1 + {_K[0]!r}::DOUBLE * r2 + {_K[1]!r}::DOUBLE * (r2 * r2) + {_K[2]!r}::DOUBLE * (r2 * r2 * r2) AS s FROM (SELECT *, u * u + w * w AS r2 FROM u{_i})))"""
on(views.points, "undistort_points", lambda p: rounded(cal.undistorted(_norm(p), _K, _P), "u", "w"), f"SELECT case_id, x, y, {R('u', 'u')}, {R('w', 'w')} FROM u8", _und)
