import math
import os

import duckdb
import numpy as np
import pytest

from sightline.plans import registry, shaped  # noqa: F401
from sightline.sources import views


def sql(name, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return sorted(con.execute(registry.SQL[name]).fetchall())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["variation_train", "variation_incremental", "variation_compare"])
def test_variation_of_all_images(spark, name):
    sf = "/root/testdata/sf0.01"
    n = views.pixels(spark, sf).select("image_id").distinct().count()
    assert n > 1
    got, want = rows(registry.Q[name](spark, sf)), sql(name, sf)
    assert len(got) == len(want) and all(abs(a - b) < 1e-4 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
    if name == "variation_compare":
        assert len({r[0] for r in got}) > 1


def test_hough_by_degrees(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    assert rows(registry.Q["hough_lines"](spark, sf)) == sql("hough_lines", sf)
    # a line midway between two angles of a table of 18
    c, s = math.cos(math.radians(35)), math.sin(math.radians(35))
    line = [(0, y, x, 255) for y in range(64) for x in range(64) if abs(x * c + y * s - 40) <= 0.5]
    px = spark.createDataFrame(line, "image_id long, y int, x int, v int")
    monkeypatch.setattr(views, "pixels", lambda s, d: px)
    best = max(registry.Q["hough_lines"](spark, "").collect(), key=lambda v: v.votes)
    assert (best.t, best.rho) == (35, 40) and best.votes == len(line)


def test_kmeans_against_a_lloyd_loop(spark):
    sf = "/root/testdata/sf0.01"
    data = np.array(sorted(tuple(r) for r in views.rgb(spark, sf).collect()))
    x, c, rounds = data[:, 2:].astype(float), np.array(shaped._C, float), 0
    while rounds < 100:
        y = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        old, c = c, np.array([x[y == i].mean(axis=0) if (y == i).any() else c[i] for i in range(len(c))])
        rounds += 1
        if np.sqrt(((c - old) ** 2).sum(axis=1)).max() < 1:
            break
    assert 3 < rounds < 100
    y = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    # keys repeat in the table; a row is told by its colours too
    got = rows(registry.Q["kmeans"](spark, sf))
    assert got == sorted((*(int(v) for v in k), int(v)) for k, v in zip(data, y, strict=True))
    three = rows(registry.Q["kmeans_three_rounds"](spark, sf))
    assert sum(a != b for a, b in zip(got, three, strict=True)) > len(got) / 50
