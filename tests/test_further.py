import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import functions as own
from sightline.operators import blobs, calipers, raster, regions, tiles, tone
from sightline.sources import files, models
from sightline.streaming import variation

PX = "image_id long, y int, x int, v int"


def image(spark, rows, image_id=0):
    return spark.createDataFrame([(image_id, y, x, int(v)) for y, line in enumerate(rows) for x, v in enumerate(line)], PX)


def grid(df):
    d = {(r.y, r.x): r.v for r in df.collect()}
    return [[d[y, x] for x in range(max(k[1] for k in d) + 1)] for y in range(max(k[0] for k in d) + 1)]


# the reference's semantics on images small enough to reckon by hand


def test_rank_repeats_the_edge_pixels(spark):
    px = image(spark, [[9, 1, 1], [1, 1, 1], [1, 1, 5]])
    # the corner's window holds its own pixel four times: 9 9 1 / 9 9 1 / 1 1 1
    assert grid(raster.rank(px, 1, 4))[0][0] == 1 and grid(raster.rank(px, 1, 5))[0][0] == 9
    assert grid(raster.rank(px, 1, 99))[2][2] == 5 and grid(raster.median(px, 1)) == [[1, 1, 1], [1, 1, 1], [1, 1, 1]]


def test_equalisation_rounds(spark):
    # shares 1/4, 2/4, 4/4: (c - 1) / 3 * 255 = 0, 85, 255; of five values 63.75, 127.5, 191.25 are rounded
    assert grid(raster.equalize(image(spark, [[10, 20], [30, 30]]))) == [[0, 85], [255, 255]]
    assert grid(raster.equalize(image(spark, [[1, 2, 3, 4, 5]]))) == [[0, 64, 128, 191, 255]]
    assert grid(raster.equalize(image(spark, [[7, 7]]))) == [[0, 0]]


def test_stretch_between_bin_centres(spark):
    centre = lambda v: (v + 0.5) * 255 / 256
    rows = [[50, 100, 150, 200]]
    to = lambda v, lo, hi: int(min(255, max(0, (v - lo) * 255 / (hi - lo))) + 0.5)
    assert grid(raster.stretch(image(spark, rows), 25, 75)) == [[to(v, centre(50), centre(150)) for v in rows[0]]]
    # a percentile of no pixels is the first bin, not the least value
    assert grid(raster.stretch(image(spark, rows), 0, 100)) == [[to(v, centre(0), centre(200)) for v in rows[0]]]
    assert grid(raster.stretch(image(spark, [[5, 5]]), 50, 100)) == [[5, 5]]


def test_matching_takes_the_nearest_share(spark):
    from sightline.operators import levels

    px, ref = image(spark, [[0, 1, 2, 3]]), image(spark, [[10, 10, 10, 20, 200, 200, 200, 200, 200, 200]])
    # shares 0.25 0.5 0.75 1 against 0 (value 0), 0.3 (10), 0.4 (20), 1 (200)
    assert grid(levels.match_histogram(px, ref)) == [[10, 20, 200, 200]]


def test_boundary_pixels_have_a_neighbour_outside_among_eight(spark):
    px = spark.createDataFrame([(0, y, x) for y in range(5) for x in range(5)] + [(0, 5, 5)], "image_id long, y int, x int")
    lab = regions.connection(regions.runs(px))
    assert regions.perimeter(lab).first().perimeter == 17  # 16 of the square, one below it
    assert regions.perimeter(lab, eight=False).first().perimeter == 17
    notch = px.where("NOT (y = 0 AND x = 0) AND y < 5")
    lab = regions.connection(regions.runs(notch))
    # without its corner the pixel at (1, 1) touches the outside on a diagonal only
    assert regions.perimeter(lab).first().perimeter == 16 and regions.perimeter(lab, eight=False).first().perimeter == 15


def test_intensity_of_a_region_and_of_none(spark):
    px = image(spark, [[4 * y + x for x in range(4)] for y in range(4)])
    roi = px.where("y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2").select("image_id", "y", "x")
    r = raster.intensity(px, roi).first()
    assert (r.lo, r.hi, r["mean"]) == (5, 10, 7.5) and r.deviation == pytest.approx(math.sqrt(4.25))
    r = raster.intensity(px, roi.limit(0)).first()
    assert (r.lo, r.hi, r["mean"], r.deviation) == (0, 0, 0.0, 0.0)


def test_local_entropy(spark):
    px = image(spark, [[0, 0, 255], [0, 0, 255], [0, 0, 255]])
    e = grid(raster.local_entropy(px, 1, 2))
    assert e[1][0] == 0 and e[1][1] == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))


# calipers and fits


def test_step_and_bar_at_a_handle(spark):
    step = image(spark, [[30 if x < 100 else 220 for x in range(200)] for _ in range(120)])
    h = spark.createDataFrame([(1, 0, 60.0, 100.0, 0.0, 40, 6), (2, 0, 60.0, 100.0, 0.3, 40, 6)], "handle_id long, image_id long, row double, col double, phi double, length1 int, length2 int")
    e = calipers.located(calipers.edges(calipers.profiles(step, h), 1.0, 20.0), h).collect()
    assert len(e) == 2 and all(abs(r.col - 99.5) < 0.3 and abs(r.row - 60) < 0.3 and r.amplitude > 20 and r.polarity == "positive" for r in e)
    bar = image(spark, [[230 if 70 <= x <= 130 else 25 for x in range(240)] for _ in range(120)])
    h = spark.createDataFrame([(1, 0, 60.0, 100.0, 0.0, 80, 6)], h.schema)
    r = calipers.pairs(calipers.edges(calipers.profiles(bar, h), 1.0, 20.0), 61.0).collect()
    assert len(r) == 1 and abs(r[0].width - 61) < 0.1 and r[0].score > 0.95 and r[0].polarity == "positive"
    # a handle outside the image has no samples
    assert calipers.profiles(bar, h.withColumn("row", F.lit(900.0))).count() == 0


def test_lines_with_outliers(spark):
    r = random.Random(1)
    rows = [(1, float(t), 2.0 + 0.5 * t + r.gauss(0, 0.01)) for t in range(60)] + [(1, r.uniform(0, 60), r.uniform(40, 90)) for _ in range(20)] + [(2, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "case_id long, x double, y double")
    got = calipers.ransac_line(p, 40, 0.1).collect()
    assert len(got) == 1 and got[0].inliers >= 60 and abs(math.tan(got[0].angle) - 0.5) < 1e-3
    plain = calipers.fit_line_robust(p, 0).where("case_id = 1").first()
    robust = calipers.fit_line_robust(p, 10).where("case_id = 1").first()
    assert abs(math.tan(robust.angle) - 0.5) < abs(math.tan(plain.angle) - 0.5)


def test_undistortion_inverts_distortion(spark):
    from sightline.operators import measures

    k, t = (0.05, -0.01, 0.002), (0.001, -0.002)
    p = spark.createDataFrame([(i, x / 5, y / 5) for i, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))], "case_id long, x double, y double")
    seen = measures.distorted(p, k, t).select("case_id", F.col("u").alias("x"), F.col("w").alias("y"))
    back = {r.case_id: (r.u, r.w) for r in calipers.undistorted(seen, k, t, 20).collect()}
    assert all(abs(back[r.case_id][0] - r.x) < 1e-9 and abs(back[r.case_id][1] - r.y) < 1e-9 for r in p.collect())


# regions


def test_moments_do_not_change_when_a_shape_is_turned(spark):
    shape = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 1)]
    px = spark.createDataFrame([(0, y, x) for y, x in shape] + [(1, x + 3, 9 - y) for y, x in shape], "image_id long, y int, x int")
    a, b = blobs.hu_moments(regions.connection(regions.runs(px))).orderBy("image_id").collect()
    assert all(abs(a[f"hu{i}"] - b[f"hu{i}"]) < 1e-12 for i in range(1, 8)) and a.hu1 > 0


def test_euler_number_and_orders(spark):
    ring = [(0, y, x) for y in range(5) for x in range(5) if not (y == 2 and x == 2)]
    px = spark.createDataFrame([*ring, (0, 9, 9), (1, 0, 0), (1, 1, 1)], "image_id long, y int, x int")
    assert {r.image_id: r.euler for r in blobs.euler_number(px).collect()} == {0: 1, 1: 1}
    f = regions.features(regions.connection(regions.runs(px)))
    assert [r.area for r in blobs.ordered(f, "area", True).where("image_id = 0").orderBy("place").collect()] == [24, 1]
    assert blobs.select_shapes(f, {"area": (2, 30), "y0": (0, 0)}).count() == 2
    for bad in (lambda: blobs.select_shapes(f, {"size": (0, 1)}), lambda: blobs.ordered(f, "size"), lambda: blobs.ordered_contours(f, "size")):
        with pytest.raises(ValueError):
            bad()


def test_wide_images_and_names_as_ids(spark):
    rows = [("a", 0, x) for x in (0, 1, 65536, 65537, 131072)] + [("a", 1, 65535), ("b", 0, 65536), ("b", 70_000, 0), ("b", 70_001, 1)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int")
    for tiled in (False, True):
        f = regions.features(regions.connection(regions.runs(px), tiled=tiled))
        assert sorted((r.image_id, r.area, r.y0, r.x0) for r in f.collect()) == [("a", 1, 0, 131072), ("a", 2, 0, 0), ("a", 3, 0, 65535), ("b", 1, 0, 65536), ("b", 2, 70_000, 0)]


def test_labels_of_random_regions_agree_with_the_tiled_form(spark):
    r = np.random.default_rng(3)
    px = spark.createDataFrame([(i, int(y), int(x)) for i in range(3) for y, x in zip(*np.nonzero(r.random((30, 40)) < 0.45), strict=True)], "image_id long, y int, x int")
    for eight in (True, False):
        a, b = ({tuple(x) for x in regions.connection(regions.runs(px), eight, tiled).collect()} for tiled in (False, True))
        assert a == b and len({x[::4] for x in a}) > 20


def test_peaks_wrap_round(spark):
    votes = spark.createDataFrame([(0, 0, 10, 9), (0, 179, -10, 20), (0, 90, 5, 8)], "image_id long, t int, rho long, votes long")
    assert sorted((r.t, r.rho) for r in blobs.hough_peaks(votes, 180, 5, 3, 2).collect()) == [(90, 5), (179, -10)]


def test_even_image_keeps_its_order_under_limited_equalisation(spark):
    px = image(spark, [[(x * 4 + y) % 256 for x in range(32)] for y in range(32)])
    out = grid(tone.limited_equalize(px, 2, 0))
    assert all(0 <= v <= 255 for line in out for v in line) and len({v for line in out for v in line}) > 50


# tiles, drawing, files, models, own functions, streams


def test_tiles_give_the_same_pixels(spark):
    r = np.random.default_rng(5)
    px = image(spark, r.integers(0, 256, (37, 50)))
    for f in (lambda p: raster.box_mean(p, 2), lambda p: raster.median(p, 2), lambda p: raster.gradient(p, [1, 2, 1])):
        assert grid(tiles.untiled(f(tiles.tiled(px, 16, 2)), 16)) == grid(f(px))
    assert tiles.tiled(px, 16, 2).groupBy("image_id").count().agg(F.max("count")).first()[0] <= 20 * 20


def test_drawing(spark):
    px = image(spark, [[0] * 6 for _ in range(6)])
    seg = spark.createDataFrame([(0, 0, 0, 4, 2), (0, 5, 5, 5, 5), (0, 3, 5, 9, 5)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    out = grid(tiles.painted(px, tiles.segment_pixels(seg), 9))
    assert [(x, y) for y in range(6) for x in range(6) if out[y][x]] == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (3, 5), (4, 5), (5, 5)]
    c = tiles.circle_pixels(spark.createDataFrame([(0, 3.0, 3.0, 2.0)], "image_id long, row double, col double, radius double"))
    assert {round(math.hypot(r.y - 3, r.x - 3)) for r in c.collect()} == {2} and c.count() == 12


def test_formats_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    px = image(spark, r.integers(0, 256, (5, 7))).union(image(spark, r.integers(0, 256, (3, 2)), 4))
    want = sorted(map(tuple, px.collect()))
    for kind in files.FORMATS:
        assert sorted(map(tuple, files.decoded(files.encoded(px, kind)).collect())) == want
        done = files.write_images(px, f"file://{tmp_path}/{kind}", kind).collect()
        assert len(done) == 2
        got = files.read_images(spark, f"file://{tmp_path}/{kind}", f"*.{kind}")
        assert sorted(x[1:] for x in map(tuple, got.collect())) == sorted(x[1:] for x in want)
        assert regions.connection(regions.runs(got.select("image_id", "y", "x"))).count() == 8  # names as ids
    assert files.read_sequence(spark, f"file://{tmp_path}/png/%d.png", 4, 4).count() == 6
    n, names = files.numbered(got)
    assert n.count() == len(want) and names.count() == 2
    with pytest.raises(ValueError):
        files.encoded(px, "tif")


def test_foreign_png_bmp_and_raw_files(spark):
    a = np.random.default_rng(8).integers(0, 256, (6, 5, 3)).astype(np.int32)
    grey = (77 * a[:, :, 0] + 150 * a[:, :, 1] + 29 * a[:, :, 2]) >> 8

    def filtered(kind, y):
        line, up = a[y].ravel(), a[y - 1].ravel() if y else np.zeros(15, int)
        left, corner = np.append([0] * 3, line[:-3]), np.append([0] * 3, up[:-3])
        p = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
        paeth = np.where((p[0] <= p[1]) & (p[0] <= p[2]), left, np.where(p[1] <= p[2], up, corner))
        return bytes([kind]) + bytes(((line - {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]) % 256).astype(np.uint8))

    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    body = zlib.compress(b"".join(filtered(y % 5, y) for y in range(6)))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")
    assert (files.from_png(png) == grey).all()
    lines = b"".join(a[y, :, ::-1].astype(np.uint8).tobytes() + b"\0" for y in range(5, -1, -1))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 6, 1, 24, 0, 0, 0, 0, 0, 0) + lines
    assert (files.from_bmp(bmp) == grey).all()
    raw = np.arange(12, dtype="<u2").tobytes()
    f = spark.createDataFrame([("a", bytearray(b"xx" + raw)), ("b", None), ("c", bytearray(b"x"))], "image_id string, content binary")
    assert [r.v for r in files.decoded_raw(f, 4, "<u2", 2).orderBy("y", "x").collect()] == list(range(12))
    bad = spark.createDataFrame([("a", bytearray(png[:60])), ("b", bytearray(bmp[:70])), ("c", bytearray(b"GIF89a")), ("d", None), ("e", bytearray())], f.schema)
    assert files.decoded(bad).collect() == [] and files.headers(bad).collect() == []


def test_header_with_a_long_comment(spark):
    content = b"P5\n# " + b"a long story " * 100 + b"\n3 2\n255\n" + bytes(range(6))
    f = spark.createDataFrame([(1, bytearray(content)), (2, bytearray(b"P5 4 1 255 abcd"))], "image_id long, content binary")
    assert sorted(map(tuple, files.headers(f).collect())) == [(1, 3, 2), (2, 4, 1)]
    assert files.decoded(f).where("image_id = 1").count() == 6


def test_models_are_written_and_read(spark, tmp_path):
    px = image(spark, [[1, 2], [3, 4]]).union(image(spark, [[3, 2], [3, 8]], 1))
    path = f"file://{tmp_path}/model"
    for _ in range(2):
        models.write_model(spark, path, "variation", {"factor": 1.7}, {"state": variation.train(px)})
    params, t = models.read_model(spark, path, "variation")
    m = {(r.y, r.x): r["mean"] for r in variation.prepare(t["state"]).collect()}
    assert params == {"factor": 1.7} and m == {(0, 0): 2, (0, 1): 2, (1, 0): 3, (1, 1): 6}
    with pytest.raises(ValueError):
        models.read_model(spark, path, "ncc")


def test_frames_are_compared_as_they_arrive(spark, tmp_path):
    px = image(spark, [[10, 10], [10, 10]]).union(image(spark, [[10, 10], [10, 200]], 1))
    files.write_images(px, f"file://{tmp_path}/in").collect()
    model = raster.variation_model(image(spark, [[10, 10], [10, 10]]))
    stream = raster.variation_compare(files.frames(spark, f"file://{tmp_path}/in", "*.pgm"), model, 20, 1.7)
    q = stream.writeStream.format("memory").queryName("odd_frames").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("odd_frames").collect()
    assert [(r.image_id.rpartition("/")[2], r.y, r.x) for r in got] == [("1.pgm", 1, 1)]


def test_own_functions(spark):
    d = spark.createDataFrame([(i % 3, float(i), float(i * i)) for i in range(12)] + [(9, None, 1.0)], "case_id long, x double, y double")
    assert own.select_where(d, ["x", "y"], lambda x, y: (x > 2) & (y < 50)).count() == 5
    fit = own.fit_each(d, "case_id", lambda g: {"n": len(g), "top": g["y"].max()}, "case_id long, n long, top double")
    assert sorted(map(tuple, fit.collect())) == [(0, 4, 81.0), (1, 4, 100.0), (2, 4, 121.0), (9, 1, 1.0)]
    out = own.run_model(d.dropna(), lambda: (lambda c: {"z": c["x"] * 2 + c["y"]}), ["x", "y"], "z double")
    assert all(r.z == 2 * r.x + r.y for r in out.collect()) and out.count() == 12
    with pytest.raises(ValueError):
        own.run_model(d, lambda: None, ["x"], "y double")
    own.register(spark)
    got = spark.sql("SELECT cb, ce FROM runs_of(array(true, true, false, true))").collect()
    assert sorted(map(tuple, got)) == [(0, 2), (3, 4)]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from sightline.session import shared_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))

