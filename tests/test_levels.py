import itertools
import math
import random

import pytest

from sightline.operators import levels, shapes
from sightline.sources import files

from test_operators import grid, image


@pytest.fixture(scope="module")
def noise(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(256) for _ in range(9)] for _ in range(7)]
    return rows, image(spark, rows)


def contour(spark, points, name=1):
    return spark.createDataFrame([(name, i, x, y) for i, (x, y) in enumerate(points)], "contour_id long, i long, x long, y long")


def test_distances_against_all_pairs(noise):
    rows, px = noise
    out = [(y, x) for y, x in itertools.product(range(7), range(9)) if rows[y][x] < 40]
    for metric, f in {"l1": lambda a, b: a + b, "linf": max, "l2": math.hypot}.items():
        for p in levels.distances(px, 40, metric).collect():
            assert math.isclose(p.distance, min(f(abs(p.y - y), abs(p.x - x)) for y, x in out))
    assert levels.distances(px, 0, "l2").where("distance IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        levels.distances(px, 40, "other")


def test_convolution_mirrors_borders(noise):
    rows, px = noise
    k = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    want = [[sum(k[a + 1][b + 1] * rows[mirror(y + a, 7)][mirror(x + b, 9)] for a in (-1, 0, 1) for b in (-1, 0, 1)) for x in range(9)] for y in range(7)]
    assert grid(levels.convolve(px, k), 7, 9) == want


def test_holes_are_filled_four_connected(spark):
    rows = [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 1, 1, 1]]
    px = image(spark, rows)
    frame = spark.createDataFrame([(0, y, 0, 4) for y in range(4)], "image_id long, y int, cb int, ce int")
    found = levels.holes(px.where("v = 1").select("image_id", "y", "x"), frame).collect()
    assert {(h.y, h.cb, h.ce) for h in found} == {(1, 1, 2), (2, 2, 3)}


def test_hull_of_square_line_and_point(spark):
    k = contour(spark, [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (0, 4), (0, 2)]).union(contour(spark, [(0, 0), (2, 2), (6, 6)], 2)).union(contour(spark, [(5, 5), (5, 5)], 3))
    f = {x.contour_id: x for x in shapes.hull_features(k).collect()}
    assert (f[1].corners, f[1].area, f[1].perimeter) == (4, 16.0, 16.0)
    assert (f[2].corners, f[2].area) == (2, 0.0) and math.isclose(f[2].perimeter, 2 * math.hypot(6, 6))
    assert (f[3].corners, f[3].area, f[3].perimeter) == (1, 0.0, 0.0)
    assert {x.contour_id: x.area for x in shapes.smallest_rectangle(k).collect()} == {1: 16.0, 2: 0.0}


def test_crossing_of_a_bow(spark):
    c = shapes.crossings(contour(spark, [(0, 0), (4, 4), (4, 0), (0, 4)])).collect()
    assert [(x.i, x.j, x.cx, x.cy) for x in c] == [(0, 2, 2.0, 2.0)]


def test_image_files(spark, tmp_path, noise):
    rows, px = noise
    for r in files.encoded(px).collect():
        (tmp_path / f"{r.image_id}.pgm").write_bytes(bytes(r.content))
    (tmp_path / "bad.pgm").write_bytes(b"P6 no grey map")
    (tmp_path / "small.pgm").write_bytes(b"P5 # a note\n2 1\n255\n" + bytes([7, 9]))
    got = files.read_images(spark, str(tmp_path))
    assert grid(got.where("image_id LIKE '%/0.pgm'"), 7, 9) == rows
    assert [(r.x, r.v) for r in got.where("image_id LIKE '%small.pgm'").orderBy("x").collect()] == [(0, 7), (1, 9)]
    assert got.where("image_id LIKE '%bad.pgm'").count() == 0
    heads = spark.createDataFrame([(1, bytearray(b"P5 # a note\n2 1\n255\nab")), (2, None), (3, bytearray(b""))], "image_id long, content binary")
    assert [tuple(x) for x in files.headers(heads).collect()] == [(1, 2, 1)]


def test_empty_tables(spark):
    px = image(spark, [[1]]).where("v > 1")
    k = contour(spark, [(1, 1)]).where("x > 1")
    for d in (levels.distances(px, 1, "l2"), levels.thin_edges(px), levels.adaptive(px, 1, "wolf", 0.3), levels.local_maxima(px), files.encoded(px), shapes.hull(k), shapes.moments(k), shapes.hausdorff(k, k)):
        assert d.collect() == []
