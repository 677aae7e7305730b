"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import raster as r
from ..operators import regions as rg
from ..sources import views
from ..streaming import variation

Q: dict = {}
SQL: dict[str, str] = {}
LO, HI, T = 90, 150, 150


def add(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Register a query; its SQL sees the views and further tables."""

    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{views.SQL.strip()}{', ' + ctes if ctes else ''} {sql}"
        return f

    return put


def on_pixels(name, f, sql, ctes="", recursive=False):
    add(name, sql, ctes, recursive)(lambda s, d: f(views.pixels(s, d)))


def on(view, name, f, sql, ctes=""):
    add(name, sql, ctes)(lambda s, d: f(view(s, d)))


def near(ry: int, rx: int, src: str = "p", border: str = "mirror") -> str:
    """CTE ``nb``: every pixel with its neighbours, mirrored at the border or the edge pixels repeated."""
    mir = lambda c, n: f"greatest(0, least({n} - 1, {c}))" if border == "clamp" else f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {n} THEN 2 * ({n} - 1) - ({c}) ELSE {c} END"
    return f"""nb AS (SELECT a.image_id, a.y, a.x, a.v, b.v AS nv, dy, dx FROM {src} a JOIN dims USING (image_id)
      CROSS JOIN (SELECT unnest(range(-{ry}, {ry + 1})) AS dy) CROSS JOIN (SELECT unnest(range(-{rx}, {rx + 1})) AS dx)
      JOIN {src} b ON b.image_id = a.image_id AND b.y = {mir('a.y + dy', 'h')} AND b.x = {mir('a.x + dx', 'w')})"""


PX = "SELECT image_id, y, x, "
for mode, e in {"binary": f"CASE WHEN v > {T} THEN 255 ELSE 0 END", "inv": f"CASE WHEN v > {T} THEN 0 ELSE 255 END", "trunc": f"least(v, {T})", "tozero": f"CASE WHEN v > {T} THEN v ELSE 0 END", "tozero_inv": f"CASE WHEN v > {T} THEN 0 ELSE v END"}.items():
    on_pixels(f"threshold_{mode}", lambda p, m=mode: r.threshold(p, T, m), f"{PX} CAST({e} AS INTEGER) AS v FROM p")
on_pixels("threshold_range", lambda p: r.in_range(p, LO, HI), f"SELECT image_id, y, x FROM p WHERE v BETWEEN {LO} AND {HI}")
on_pixels("threshold_multilevel", lambda p: r.multilevel(p, [100, 128, 160]), f"{PX} CAST((v >= 100) AS INT) + CAST((v >= 128) AS INT) + CAST((v >= 160) AS INT) AS v FROM p")
on_pixels("invert", lambda p: r.point(p, lambda v: 255 - v), f"{PX} 255 - v AS v FROM p")
on_pixels("scale_image", lambda p: r.point(p, lambda v: r.clamp(v * 1.5 - 40)), f"{PX} CAST(floor(greatest(0, least(255, v * 1.5 - 40))) AS INTEGER) AS v FROM p")
_flip = "f AS (SELECT image_id, y, (w - 1 - x) AS x, v AS v2 FROM p JOIN dims USING (image_id))"
for name, f, e in (("add_image", lambda a, b: r.clamp(a + b), "CAST(least(255, v + v2) AS INTEGER)"), ("sub_image", lambda a, b: r.clamp(a - b), "CAST(greatest(0, v - v2) AS INTEGER)"), ("abs_diff_image", lambda a, b: F.abs(a - b), "abs(v - v2)"), ("min_image", lambda a, b: F.least(a, b), "least(v, v2)"), ("max_image", lambda a, b: F.greatest(a, b), "greatest(v, v2)"), ("bit_and_image", lambda a, b: a.bitwiseAND(b), "v & v2"), ("bit_or_image", lambda a, b: a.bitwiseOR(b), "v | v2"), ("bit_xor_image", lambda a, b: a.bitwiseXOR(b), "xor(v, v2)")):
    on_pixels(name, lambda p, f=f: r.combine(p, r.mirror(p, "column"), f), f"{PX} {e} AS v FROM p JOIN f USING (image_id, y, x)", _flip)
on_pixels("mirror_column", lambda p: r.mirror(p, "column"), f"{PX} v2 AS v FROM f", _flip)
on_pixels("mirror_row", lambda p: r.mirror(p, "row"), "SELECT image_id, h - 1 - y AS y, x, v FROM p JOIN dims USING (image_id)")
on_pixels("transpose", lambda p: r.mirror(p, "diagonal"), "SELECT image_id, x AS y, y AS x, v FROM p")
on_pixels("crop", lambda p: r.crop(p, 5, 10, 20, 30), "SELECT image_id, y - 5 AS y, x - 10 AS x, v FROM p WHERE y BETWEEN 5 AND 24 AND x BETWEEN 10 AND 39")
on_pixels("pyramid", r.pyramid, f"{PX} CAST(floor(s / 4) AS INTEGER) AS v FROM (SELECT image_id, y // 2 AS y, x // 2 AS x, sum(v) AS s, count(*) AS n FROM p GROUP BY ALL) WHERE n = 4")
on_pixels("project_rows", lambda p: p.groupBy("image_id", "y").agg(F.sum("v").alias("total")), "SELECT image_id, y, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY ALL")
on_pixels("project_columns", lambda p: p.groupBy("image_id", "x").agg(F.sum("v").alias("total")), "SELECT image_id, x, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY ALL")

_nb = "GROUP BY image_id, y, x"
on_pixels("box_mean", lambda p: r.box_mean(p, 2), f"{PX} CAST(floor(sum(nv) / 25.0::DOUBLE) AS INTEGER) AS v FROM nb {_nb}", near(2, 2))
on_pixels("highpass", lambda p: r.combine(p, r.box_mean(p, 2), lambda a, b: r.clamp(a - b + 128)), f"{PX} CAST(greatest(0, least(255, v - CAST(floor(sum(nv) / 25.0::DOUBLE) AS INTEGER) + 128)) AS INTEGER) AS v FROM nb GROUP BY image_id, y, x, v", near(2, 2))
on_pixels("emphasize", lambda p: r.combine(p, r.box_mean(p, 1), lambda a, b: r.clamp(a + 2 * (a - b))), f"{PX} CAST(greatest(0, least(255, v + 2 * (v - CAST(floor(sum(nv) / 9.0::DOUBLE) AS INTEGER)))) AS INTEGER) AS v FROM nb GROUP BY image_id, y, x, v", near(1, 1))
on_pixels("dyn_threshold", lambda p: r.dyn_threshold(p, r.box_mean(p, 2), 20), f"SELECT image_id, y, x FROM nb GROUP BY image_id, y, x, v HAVING v > CAST(floor(sum(nv) / 25.0::DOUBLE) AS INTEGER) + 20", near(2, 2))
on_pixels("var_threshold", lambda p: r.local_deviation(p, 1).where("v > 40").select(*r.KEY), f"SELECT image_id, y, x FROM nb {_nb} HAVING sqrt((sum(nv * nv) * 9.0::DOUBLE - sum(nv) * sum(nv)) / 81.0::DOUBLE) > 40", near(1, 1))
on_pixels("deviation_image", lambda p: r.local_deviation(p, 1), f"{PX} sqrt((sum(nv * nv) * 9.0::DOUBLE - sum(nv) * sum(nv)) / 81.0::DOUBLE) AS v FROM nb {_nb}", near(1, 1))
on_pixels("gray_erosion", lambda p: r.erode(p, 1), f"{PX} min(nv) AS v FROM nb {_nb}", near(1, 1))
on_pixels("gray_dilation", lambda p: r.dilate(p, 1), f"{PX} max(nv) AS v FROM nb {_nb}", near(1, 1))
_two = lambda a, b: near(1, 1) + f", m AS ({PX} {a}(nv) AS v FROM nb {_nb}), " + near(1, 1, "m").replace("nb AS", "nc AS", 1)
on_pixels("gray_opening", lambda p: r.dilate(r.erode(p, 1), 1), f"{PX} max(nv) AS v FROM nc {_nb}", _two("min", "max"))
on_pixels("gray_closing", lambda p: r.erode(r.dilate(p, 1), 1), f"{PX} min(nv) AS v FROM nc {_nb}", _two("max", "min"))
on_pixels("gray_tophat", lambda p: r.combine(p, r.dilate(r.erode(p, 1), 1), lambda a, b: a - b), f"{PX} p.v - o.v AS v FROM p JOIN (SELECT image_id, y, x, max(nv) AS v FROM nc {_nb}) o USING (image_id, y, x)", _two("min", "max"))
on_pixels("gray_gradient", lambda p: r.combine(r.dilate(p, 1), r.erode(p, 1), lambda a, b: a - b), f"{PX} max(nv) - min(nv) AS v FROM nb {_nb}", near(1, 1))
on_pixels("median_image", lambda p: r.median(p, 1), f"{PX} list_sort(list(nv))[5] AS v FROM nb {_nb}", near(1, 1, border="clamp"))
on_pixels("rank_image", lambda p: r.rank(p, 1, 2), f"{PX} list_sort(list(nv))[3] AS v FROM nb {_nb}", near(1, 1, border="clamp"))
on_pixels("binomial", lambda p: r.point(r.separable(p, [1, 2, 1], [1, 2, 1]), lambda v: F.floor(v / 16).cast("int")), f"{PX} CAST(floor(sum(nv * (2 - abs(dy)) * (2 - abs(dx))) / 16.0::DOUBLE) AS INTEGER) AS v FROM nb {_nb}", near(1, 1))
on_pixels("sobel_amp", lambda p: r.gradient(p, [1, 2, 1]), f"{PX} CAST(least(255, abs(sum(nv * dx * (2 - abs(dy)))) + abs(sum(nv * dy * (2 - abs(dx))))) AS INTEGER) AS v FROM nb {_nb}", near(1, 1))
on_pixels("prewitt_amp", lambda p: r.gradient(p, [1, 1, 1]), f"{PX} CAST(least(255, abs(sum(nv * dx)) + abs(sum(nv * dy))) AS INTEGER) AS v FROM nb {_nb}", near(1, 1))
on_pixels("laplace", r.laplace, f"{PX} CAST(sum(CASE WHEN dx = 0 AND dy = 0 THEN -4 WHEN dx = 0 OR dy = 0 THEN 1 ELSE 0 END * nv) AS INTEGER) AS v FROM nb {_nb}", near(1, 1))
_k = g.gaussian(0.8)
on_pixels("gauss_image", lambda p: r.point(r.separable(p, _k, _k), lambda v: F.round(v, 6)), f"{PX} round(sum(nv * [{', '.join(f'{c!r}::DOUBLE' for c in _k)}][dy + 4] * [{', '.join(f'{c!r}::DOUBLE' for c in _k)}][dx + 4]), 6) AS v FROM nb {_nb}", near(3, 3))
on_pixels("integral_image", r.integral, f"{PX} CAST(sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM p)")
_lbp = " + ".join(f"CASE WHEN max(CASE WHEN dy = {dy} AND dx = {dx} THEN nv END) >= v THEN {1 << i} ELSE 0 END" for i, (dy, dx) in enumerate([(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]))
on_pixels("lbp", r.lbp, f"{PX} CASE WHEN y = 0 OR x = 0 OR y = h - 1 OR x = w - 1 THEN 0 ELSE {_lbp} END AS v FROM nb JOIN dims USING (image_id) GROUP BY image_id, y, x, v, h, w", near(1, 1))

_h = "hist AS (SELECT image_id, v, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id) AS total, sum(n * v) OVER (PARTITION BY image_id ORDER BY v) AS m, sum(n * v) OVER (PARTITION BY image_id) AS mt FROM hist)"
on_pixels("hist_gray", r.histogram, "SELECT image_id, v, n FROM hist", _h)
on_pixels("hist_percentile", lambda p: r.percentile(p, 0.9), "SELECT image_id, min(v) AS v FROM c WHERE c >= total * 0.9 GROUP BY ALL", _h)
on_pixels("hist_entropy", lambda p: r.entropy(p).withColumn("entropy", F.round("entropy", 6)), "SELECT image_id, round(-sum((n / total::DOUBLE) * log2(n / total::DOUBLE)), 6) AS entropy FROM c GROUP BY ALL", _h)
on_pixels("otsu", r.otsu, "SELECT image_id, v, (v + 0.5::DOUBLE) * 255 / 256 AS threshold FROM (SELECT image_id, arg_max(v, struct_pack(b := b, u := -v)) AS v FROM (SELECT image_id, v, c::DOUBLE * (total - c)::DOUBLE * (m / c::DOUBLE - (mt - m) / (total - c)::DOUBLE) * (m / c::DOUBLE - (mt - m) / (total - c)::DOUBLE) AS b FROM c WHERE c < total) GROUP BY image_id)", _h)
on_pixels(
    "equalize",
    r.equalize,
    f"""{PX} CAST(CASE WHEN total > lo THEN ((c - lo) * 510 + total - lo) // (2 * (total - lo)) ELSE 0 END AS INTEGER) AS v
      FROM p JOIN (SELECT *, min(c) OVER (PARTITION BY image_id) AS lo FROM c) l USING (image_id, v)""",
    _h,
)


def _stretched(low: float, high: float) -> str:
    at = lambda q: f"CASE WHEN floor(max(total) * {q} / 100) = 0 THEN 0.5::DOUBLE * 255 / 256 ELSE min(CASE WHEN c >= floor(total * {q} / 100) THEN (v + 0.5::DOUBLE) * 255 / 256 END) END"
    return f"""{PX} CASE WHEN hi > lo THEN CAST(floor(greatest(0, least(255, (v - lo) * (255 / (hi - lo)))) + 0.5::DOUBLE) AS INTEGER) ELSE v END AS v
      FROM p JOIN (SELECT image_id, {at(f"{low}::DOUBLE")} AS lo, {at(f"{high}::DOUBLE")} AS hi FROM c GROUP BY image_id) USING (image_id)"""


on_pixels("contrast_stretch", r.stretch, _stretched(1, 99), _h)
on_pixels("auto_contrast", lambda p: r.stretch(p, 0, 100), _stretched(0, 100), _h)


def _roi(lo: int, hi: int) -> str:
    inside = f"CASE WHEN v BETWEEN {lo} AND {hi} THEN v END"
    return f"""SELECT image_id, coalesce(min({inside}), 0) AS lo, coalesce(max({inside}), 0) AS hi, round(coalesce(avg({inside}), 0), 6) AS mean,
      round(coalesce(stddev_pop({inside}), 0), 6) AS deviation FROM p GROUP BY ALL"""


for _name, _lo, _hi in (("intensity", LO, HI), ("intensity_sparse", 254, 255)):
    on_pixels(_name, lambda p, lo=_lo, hi=_hi: r.intensity(p, r.in_range(p, lo, hi)).withColumns({c: F.round(c, 6) for c in ("mean", "deviation")}), _roi(_lo, _hi))
on_pixels(
    "entropy_image",
    lambda p: r.point(r.local_entropy(p, 1, 16), lambda v: F.round(v, 6)),
    f"""{PX} round(-sum(n / 9::DOUBLE * log2(n / 9::DOUBLE)), 6) AS v
      FROM (SELECT image_id, y, x, nv * 16 // 256 AS b, count(*) AS n FROM nb GROUP BY ALL) GROUP BY image_id, y, x""",
    near(1, 1, border="clamp"),
)

_g = "q AS (SELECT *, least(v * 8 // 256, 7) AS i FROM p), o AS (SELECT a.image_id, a.i, b.i AS j FROM q a JOIN q b ON a.image_id = b.image_id AND a.y = b.y AND a.x + 1 = b.x), s AS (SELECT image_id, i, j, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT image_id, j, i FROM o) GROUP BY ALL)"
on_pixels("glcm", lambda p: r.glcm(p, 8, 0, 1), "SELECT * FROM s", _g)
on_pixels("glcm_features", lambda p: (f := r.glcm_features(r.glcm(p, 8, 0, 1))).select("image_id", *(F.round(c, 6).alias(c) for c in f.columns[1:])), "SELECT image_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"contrast": "sum(p * (i - j) * (i - j))", "dissimilarity": "sum(p * abs(i - j))", "homogeneity": "sum(p / (1 + (i - j) * (i - j)))", "energy": "sum(p * p)", "entropy": "-sum(p * log2(p + 1e-10))", "most": "max(p)"}.items()) + " FROM (SELECT *, n / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS p FROM s) GROUP BY image_id", _g)

_train = "vm AS (SELECT y, x, avg(v) AS mean, var_pop(v) AS var FROM p GROUP BY ALL)"
_model = "SELECT y, x, round(mean, 6) AS mean, round(var, 4) AS var FROM vm"
_rounded = lambda m: m.select("y", "x", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))
_even = lambda: F.col("image_id") % 2 == 0
on_pixels("variation_train", lambda p: _rounded(r.variation_model(p)), _model, _train)
on_pixels("variation_incremental", lambda p: _rounded(variation.prepare(variation.merge(variation.train(p.where(_even())), variation.train(p.where(~_even()))))), _model, _train)
on_pixels("variation_compare", lambda p: r.variation_compare(p, r.variation_model(p), 20, 1.7), "SELECT image_id, y, x FROM p JOIN vm USING (y, x) WHERE abs(v - mean) > greatest(20, sqrt(var) * 1.7)", _train)
_m = (math.cos(0.3), -math.sin(0.3), 12.0, math.sin(0.3), math.cos(0.3), -7.0)
on_pixels("affine_warp", lambda p: r.point(r.affine(p, _m), lambda v: F.round(v, 6)), f"""{PX} round(sum(f * v), 6) AS v FROM (SELECT g.image_id, g.y, g.x, s.v, (CASE WHEN a = 1 THEN w - w0 ELSE 1 - w + w0 END) * (CASE WHEN b = 1 THEN u - u0 ELSE 1 - u + u0 END) AS f
  FROM (SELECT *, floor(u) AS u0, floor(w) AS w0 FROM (SELECT image_id, y, x, x * {_m[0]!r}::DOUBLE + y * {_m[1]!r}::DOUBLE + 12.0::DOUBLE AS u, x * {_m[3]!r}::DOUBLE + y * {_m[4]!r}::DOUBLE - 7.0::DOUBLE AS w FROM p)) g
  CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) JOIN p s ON s.image_id = g.image_id AND s.y = w0 + a AND s.x = u0 + b) GROUP BY image_id, y, x HAVING count(*) = 4""")
_ncc = "t AS (SELECT y AS ty, x AS tx, v AS t FROM p WHERE image_id = 0 AND y < 8 AND x < 8), a AS (SELECT image_id, y - ty AS y, x - tx AS x, count(*) AS n, sum(v) AS sv, sum(t) AS st, sum(v * v) AS svv, sum(t * t) AS stt, sum(v * t) AS svt FROM p, t GROUP BY ALL HAVING count(*) = 64), ncc AS (SELECT image_id, y, x, round((n * svt - sv * st) / sqrt((n * svv - sv * sv)::DOUBLE * (n * stt - st * st)), 9) AS score FROM a)"
_match = lambda p: r.ncc(p, r.crop(p.where("image_id = 0"), 0, 0, 8, 8), 8).withColumn("score", F.round("score", 9))
on_pixels("ncc", _match, "SELECT * FROM ncc", _ncc)
on_pixels("ncc_matches", lambda p: g.suppress(_match(p).where("score >= 0.3"), "score", 4), "SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.image_id = m.image_id AND abs(o.y - m.y) <= 4 AND abs(o.x - m.x) <= 4 AND (o.score > m.score OR (o.score = m.score AND (o.y < m.y OR (o.y = m.y AND o.x < m.x)))))", _ncc + ", m AS (SELECT * FROM ncc WHERE score >= 0.3)")
_cs = ", ".join(f"({i}, {round(math.cos(i * math.pi / 180), 12)!r}::DOUBLE, {round(math.sin(i * math.pi / 180), 12)!r}::DOUBLE)" for i in range(180))
_votes = f"votes AS (SELECT image_id, t, CAST(floor(x * c + y * s + 0.5::DOUBLE) AS BIGINT) AS rho, count(*) AS votes FROM p, (VALUES {_cs}) a(t, c, s) WHERE v >= 185 GROUP BY ALL)"
on_pixels("hough_lines", lambda p: g.hough(r.in_range(p, 185, 255), 180), "SELECT * FROM votes", _votes)

_isl = lambda w, n: f"{n} AS (SELECT image_id, y, min(x) AS cb, max(x) + 1 AS ce FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {w}) GROUP BY image_id, y, g)"
_A, _B = "(SELECT image_id, y, x FROM p WHERE v >= 160)", "(SELECT image_id, y, x FROM p WHERE v <= 190 AND x % 5 > 0)"
_a = lambda p: rg.runs(r.in_range(p, 160, 255))
_b = lambda p: rg.runs(p.where("v <= 190 AND x % 5 > 0").select(*r.KEY))
_frame = lambda p: p.groupBy("image_id", "y").agg(F.min("x").alias("cb"), (F.max("x") + 1).alias("ce"))
RUNS = "SELECT image_id, y, cb, ce FROM z"
on_pixels("rle_runs", _a, RUNS, _isl(_A, "z"))
on_pixels("mask_from_runs", lambda p: rg.mask(_a(p)), f"SELECT image_id, y, x FROM {_A}")
on_pixels("region_union", lambda p: rg.union(_a(p), _b(p)), RUNS, _isl(f"({_A} UNION {_B})", "z"))
on_pixels("region_intersection", lambda p: rg.intersection(_a(p), _b(p)), RUNS, _isl(f"({_A} INTERSECT {_B})", "z"))
on_pixels("region_difference", lambda p: rg.difference(_a(p), _b(p), _frame(p)), RUNS, _isl(f"({_A} EXCEPT {_B})", "z"))
on_pixels("region_complement", lambda p: rg.complement(_a(p), _frame(p)), RUNS, _isl("(SELECT image_id, y, x FROM p WHERE v < 160)", "z"))
on_pixels("region_move", lambda p: rg.shifted(_a(p), 3, -2), "SELECT image_id, y + 3 AS y, cb - 2 AS cb, ce - 2 AS ce FROM z", _isl(_A, "z"))
_grow = f"(SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {_A}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))"
on_pixels("region_dilation", lambda p: rg.dilate(_a(p), 1, 1), RUNS, _isl(_grow, "z"))
_shrink = "(SELECT image_id, y + dy AS y, x + dx AS x FROM (SELECT image_id, y, x FROM p WHERE v >= 110), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY image_id, y + dy, x + dx HAVING count(*) = 9)"
on_pixels("region_erosion", lambda p: rg.erode(rg.runs(r.in_range(p, 110, 255)), 1, 1), RUNS, _isl(_shrink, "z"))
# components by label spreading over touching runs
_cc = _isl("(SELECT image_id, y, x FROM p WHERE v >= 170)", "z") + """, n AS (SELECT *, image_id * 4294967296 + y * 65536 + cb AS id FROM z),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.cb <= b.ce AND b.cb <= a.ce), ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, root) AS (SELECT id, id FROM n UNION SELECT ee.b, reach.root FROM reach JOIN ee ON ee.a = reach.id WHERE ee.b > reach.root),
lab AS (SELECT n.image_id, y, cb, ce, region_id FROM n JOIN (SELECT id, (min(root) % 4294967296) // 65536 * 4294967296 + min(root) % 65536 AS region_id FROM reach GROUP BY id) USING (id)),
px AS (SELECT image_id, region_id, y, unnest(range(cb, ce)) AS x FROM lab),
ft AS (SELECT image_id, region_id, count(*) AS area, min(y) AS y0, CAST(min(x) AS INTEGER) AS x0, max(y) AS y1, CAST(max(x) AS INTEGER) AS x1, round(avg(y), 6) AS row, round(avg(x), 6) AS col, round(var_pop(y), 6) AS m20, round(var_pop(x), 6) AS m02, round(covar_pop(y, x), 6) AS m11 FROM px GROUP BY ALL)"""
_lab = lambda p: rg.connection(rg.runs(r.in_range(p, 170, 255)))
_feat = lambda p: (f := rg.features(_lab(p))).select(*f.columns[:7], *(F.round(c, 6).alias(c) for c in ("row", "col", "m20", "m02", "m11")))
on_pixels("connection", _lab, "SELECT * FROM lab", _cc, True)
on_pixels("region_features", _feat, "SELECT * FROM ft", _cc, True)
on_pixels("select_shape", lambda p: rg.select_shape(_feat(p), "area", 4, 60), "SELECT * FROM ft WHERE area BETWEEN 4 AND 60", _cc, True)
on_pixels("largest_regions", lambda p: rg.largest(_feat(p), 3), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, region_id) AS rank FROM ft) WHERE rank <= 3", _cc, True)
on_pixels("region_perimeter", lambda p: rg.perimeter(_lab(p)), "SELECT a.image_id, a.region_id, count(*) AS perimeter FROM px a WHERE (SELECT count(*) FROM px b WHERE b.image_id = a.image_id AND b.region_id = a.region_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1) < 9 GROUP BY ALL", _cc, True)

_d = "o AS (SELECT *, coalesce(lag(v) OVER w, v) AS b, coalesce(lead(v) OVER w, v) AS a FROM prof WINDOW w AS (PARTITION BY user_id ORDER BY i)), dv AS (SELECT user_id, i, (a - b) / 2 AS g FROM o), nb3 AS (SELECT *, abs(g) AS a, coalesce(lag(abs(g)) OVER w, 0) AS l, coalesce(lead(abs(g)) OVER w, 0) AS r FROM dv WINDOW w AS (PARTITION BY user_id ORDER BY i)), ed AS (SELECT user_id, i, i + CASE WHEN l - 2 * a + r = 0 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * a + r))) END AS position, a AS amplitude, CASE WHEN g > 0 THEN 'rising' ELSE 'falling' END AS polarity FROM nb3 WHERE a >= 5 AND a >= l AND a > r)"
_e = lambda p: g.edges(p, 5.0)
on(views.profile, "profile_derivative", g.derivative, "SELECT * FROM dv", _d)
on(views.profile, "edges_1d", lambda p: _e(p).withColumn("position", F.round("position", 6)), "SELECT user_id, i, round(position, 6) AS position, amplitude, polarity FROM ed", _d)
on(views.profile, "edge_pairs", lambda p: g.pairs(_e(p)).select("user_id", "i", *(F.round(c, 6).alias(c) for c in ("centre", "width", "gap"))), "SELECT user_id, i, round((position + p2) / 2, 6) AS centre, round(p2 - position, 6) AS width, round(lead(position) OVER (PARTITION BY user_id ORDER BY i) - p2, 6) AS gap FROM (SELECT *, lead(position) OVER w AS p2, lead(polarity) OVER w AS s2 FROM ed WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE polarity = 'rising' AND s2 = 'falling'", _d)
on(views.points, "fit_line", lambda p: g.fit_line(p).select("case_id", "n", *(F.round(c, 6).alias(c) for c in ("mx", "my", "angle"))), "SELECT case_id, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) AS angle FROM pts GROUP BY case_id HAVING count(*) >= 2")
on(views.points, "fit_circle", lambda p: (c := g.fit_circle(p.withColumn("y", F.col("y") / 1000))).select("case_id", *(F.round(x, 4).alias(x) for x in c.columns[1:])), "SELECT case_id, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) AS radius FROM (SELECT *, (p * vv - q * uv) / (2 * (uu * vv - uv * uv)) AS a, (q * uu - p * uv) / (2 * (uu * vv - uv * uv)) AS b FROM (SELECT case_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u + u * v * v) AS p, sum(v * v * v + v * u * u) AS q FROM (SELECT *, x - mx AS u, y - my AS v FROM (SELECT case_id, x, y / 1000 AS y, avg(x) OVER (PARTITION BY case_id) AS mx, avg(y / 1000) OVER (PARTITION BY case_id) AS my FROM pts)) GROUP BY case_id) WHERE n >= 3)")
on(views.points, "mad_inliers", g.mad_inliers, "SELECT case_id, x, y FROM (SELECT *, median(d) OVER (PARTITION BY case_id) AS mad FROM (SELECT *, abs(y - median(y) OVER (PARTITION BY case_id)) AS d FROM pts)) WHERE d <= 2.5::DOUBLE * 1.4826::DOUBLE * mad")
on(views.contour_points, "contour_features", lambda k: g.contour_features(k).withColumn("length", F.round("length", 6)), "SELECT contour_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2::DOUBLE ELSE 0 END AS area, round(sum(coalesce(sqrt(((nx - x) * (nx - x) + (ny - y) * (ny - y))::DOUBLE), 0)), 6) AS length, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i)) GROUP BY contour_id")
on(views.contour_points, "contour_turning", g.turning, "SELECT contour_id, i, (x - px) * (ny - y) - (y - py) * (nx - x) AS turn FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WINDOW w AS (PARTITION BY contour_id ORDER BY i)) WHERE px IS NOT NULL AND nx IS NOT NULL")
on(views.contour_points, "select_contours", lambda k: g.contour_features(k).where(F.col("n").between(5, 12)).select("contour_id", "n"), "SELECT contour_id, count(*) AS n FROM k GROUP BY ALL HAVING count(*) BETWEEN 5 AND 12")
for name, e in {"luminosity": "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "bt709": "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b", "average": "(r + g + b) / 3", "lightness": "(greatest(r, g, b) + least(r, g, b)) / 2", "max": "greatest(r, g, b)", "min": "least(r, g, b)"}.items():
    on(views.rgb, f"gray_{name}", lambda c, m=name: g.grey(c, m), f"SELECT *, CAST(floor({e}) AS INTEGER) AS v FROM rgb")
on(views.rgb, "gray_fast", g.grey_fast, "SELECT *, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM rgb")
_cut = lambda e: f"CAST(floor(greatest(0, least(255, {e}))) AS INTEGER)"
on(views.rgb, "ycrcb", g.ycrcb, f"SELECT l_orderkey, l_linenumber, {_cut('0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')} AS yy, {_cut('128 + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b')} AS cr, {_cut('128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b')} AS cb FROM rgb")
on(views.rgb, "hsv", lambda c: g.hsv(c).select("l_orderkey", "l_linenumber", *(F.round(x, 6).alias(x) for x in ("h", "s", "val"))), "SELECT l_orderkey, l_linenumber, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN 60 * (g - b)::DOUBLE / d + CASE WHEN g < b THEN 360 ELSE 0 END WHEN hi = g THEN 60 * (b - r)::DOUBLE / d + 120 ELSE 60 * (r - g)::DOUBLE / d + 240 END, 6) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d::DOUBLE / hi END, 6) AS s, round(hi / 255::DOUBLE, 6) AS val FROM (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM rgb)")


def queries():
    """Every query of the engine."""
    return dict(Q)


def oracle_sql():
    """The SQL of each."""
    return dict(SQL)
