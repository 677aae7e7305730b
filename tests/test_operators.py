import math
import os

import pytest
from pyspark.sql import functions as F

from sightline.operators import geometry, measures, raster, regions
from sightline.operators.components import components
from sightline.plans import further, levelled, measured, registry, shaped  # noqa: F401
from sightline.streaming import variation


def image(spark, rows, name=0):
    return spark.createDataFrame([(name, y, x, v) for y, line in enumerate(rows) for x, v in enumerate(line)], "image_id long, y int, x int, v int")


def grid(df, h, w):
    out = [[None] * w for _ in range(h)]
    for r in df.collect():
        out[r.y][r.x] = r.v
    return out


def test_ramp_statistics(spark):
    px = image(spark, [[4 * y + x for x in range(4)] for y in range(4)])
    roi = px.where("y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2")
    s = raster.intensity(px, roi).first()
    assert (s.lo, s.hi, s.mean) == (5, 10, 7.5) and abs(s.deviation - math.sqrt(4.25)) < 1e-12


def test_threshold_modes(spark):
    px = image(spark, [[10, 100, 101]])
    want = {"binary": [0, 0, 255], "inv": [255, 255, 0], "trunc": [10, 100, 100], "tozero": [0, 0, 101], "tozero_inv": [10, 100, 0]}
    for m, v in want.items():
        assert grid(raster.threshold(px, 100, m), 1, 3) == [v]
    with pytest.raises(ValueError):
        raster.threshold(px, 1, "other")


def test_mirrored_borders(spark):
    px = image(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert grid(raster.box_aggregate(px, 1, 1, F.sum), 3, 3) == [[33, 36, 39], [42, 45, 48], [51, 54, 57]]
    assert grid(raster.box_aggregate(px, 1, 1, F.max), 3, 3) == [[5, 6, 6], [8, 9, 9], [8, 9, 9]]


def test_region_algebra_and_components(spark):
    a = image(spark, [[1, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 0, 0, 1]]).where("v = 1").drop("v")
    r = regions.runs(a)
    ids = {(x.y, x.cb): x.region_id for x in regions.connection(r).collect()}
    assert ids[(0, 0)] == ids[(1, 2)] and ids[(0, 4)] == ids[(1, 4)] == ids[(2, 4)] != ids[(0, 0)]
    four = {(x.y, x.cb): x.region_id for x in regions.connection(r, eight=False).collect()}
    assert four[(0, 0)] != four[(1, 2)]
    f = {x.area: x for x in regions.features(regions.connection(r)).collect()}
    assert len(regions.features(regions.connection(r)).collect()) == 2 and f[3].y0 == 0
    frame = spark.createDataFrame([(0, y, 0, 5) for y in range(3)], "image_id long, y int, cb int, ce int")
    c = regions.complement(r, frame)
    assert regions.intersection(r, c).count() == 0
    assert sorted(map(tuple, regions.union(r, c).collect())) == [(0, y, 0, 5) for y in range(3)]


def test_components_of_a_chain(spark):
    e = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {x.root for x in components(e).collect()} == {0}
    assert components(e.limit(0)).collect() == []


def test_step_edge(spark):
    p = spark.createDataFrame([(1, i, 30.0 if i < 50 else 220.0) for i in range(100)], "user_id long, i int, v double")
    e = geometry.edges(p, 20.0).collect()
    assert len(e) == 1 and abs(e[0].position - 49.5) <= 1 and e[0].polarity == "rising" and e[0].amplitude > 20


def test_bar_pair(spark):
    p = spark.createDataFrame([(1, i, 230.0 if 70 <= i <= 130 else 25.0) for i in range(200)], "user_id long, i int, v double")
    r = geometry.pairs(geometry.edges(p, 20.0)).collect()
    assert len(r) == 1 and abs(r[0].width - 61) <= 3 and r[0].gap is None


def test_fits(spark):
    circle = [(1, 3 + 5 * math.cos(t / 7), -2 + 5 * math.sin(t / 7)) for t in range(40)]
    line = [(2, 1 + 2 * t, 4 + t) for t in range(20)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in circle + line], "case_id long, x double, y double")
    c = geometry.fit_circle(p).where("case_id = 1").first()
    assert max(abs(c.cx - 3), abs(c.cy + 2), abs(c.radius - 5)) < 1e-9
    assert abs(geometry.fit_line(p).where("case_id = 2").first().angle - math.atan2(1, 2)) < 1e-9


def test_template_is_found(spark):
    px = image(spark, [[200 if abs(x - 16) < 3 or abs(y - 16) < 3 else 50 for x in range(32)] for y in range(32)])
    t = raster.crop(px, 12, 12, 9, 9)
    m = geometry.suppress(raster.ncc(px, t, 9).where("score > 0.95"), "score", 4).collect()
    assert [(r.y, r.x) for r in m] == [(12, 12)] and m[0].score == pytest.approx(1)


def test_variation_on_a_stream(spark, tmp_path):
    for i in range(3):
        image(spark, [[10 * i, 5]], i).write.parquet(str(tmp_path / "in" / f"image={i}"))
    schema = "image_id long, y int, x int, v int"
    stream = variation.train(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "image=*")))
    q = stream.writeStream.format("memory").queryName("variation").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.x: (r.mean, r.var) for r in variation.prepare(spark.table("variation")).collect()}
    assert got[0] == (10.0, pytest.approx(200 / 3)) and got[1] == (5.0, 0.0)


def test_hysteresis_keeps_what_touches_strong_pixels(spark):
    px = image(spark, [[9, 9, 0, 9, 9], [0, 0, 0, 0, 20], [9, 0, 0, 0, 0]])
    assert sorted((r.y, r.cb, r.ce) for r in measures.hysteresis(px, 9, 20).collect()) == [(0, 3, 5), (1, 4, 5)]
    assert measures.hysteresis(px.limit(0), 9, 20).collect() == []


def test_roberts_and_triangle(spark):
    assert grid(measures.roberts(image(spark, [[1, 5], [2, 9]])), 2, 2) == [[11, 0], [0, 0]]
    t = measures.triangle(image(spark, [[10] * 50 + [11] * 3 + [200]])).first()
    assert t.v == 12 and t.threshold == 12.5 * 255 / 256


def test_edges_are_chosen(spark):
    e = spark.createDataFrame([(1, 3, 5.0), (1, 8, 9.0), (1, 9, 9.0)], "user_id long, i int, amplitude double")
    assert [measures.chosen_edges(e, w).first().i for w in ("first", "last", "strongest")] == [3, 9, 8]
    with pytest.raises(ValueError):
        measures.chosen_edges(e, "other")


def test_point_in_a_square(spark):
    k = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "contour_id long, i int, x long, y long")
    assert measures.contains(k, 2.0, 2.0).first().inside and not measures.contains(k, 5.0, 2.0).first().inside
    assert measures.vertex_distance(k, 7.0, 8.0).first().distance == 5.0


@pytest.mark.parametrize("name", sorted(registry.SQL)[::3])
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    r = con.execute(registry.SQL[name])
    cols = [d[0] for d in r.description]
    df = registry.Q[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    key = lambda t: tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in t)
    assert sorted(key(x) for x in df.select(*cols).collect()) == sorted(key(x) for x in r.fetchall())
