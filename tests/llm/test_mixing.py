from pyspark.sql import functions as F

from sightline.llm import mixing


def level(sizes):
    """Targets by resharing the excess again and again. sizes: {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        per = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * per > 2 * sizes[s]}
        if not over:
            target |= {s: w[s] * per for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def check(rows, got):
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = level(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(r.size for r in got if r.source == s)


def test_targets_are_met(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source"))).withColumn("n", F.lit(1))
    got = mixing.copies(d).collect()
    assert len(got) == d.count()
    check(d, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(d.repartition(3)).collect()))
    c = {r.id: r.copies for r in got}
    out = mixing.mix(d)
    assert out.columns == d.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {i: k for i, k in c.items() if k}


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x", None), (4, "x y\x0bz", None), (4, "x y\x0bz", None), (None, "q q", "b"), (5, "é é", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(d).collect()
    assert len(got) == 7 and {r.source_size for r in got if r.source == "a"} == {0} and {r.target for r in got if r.source == "a"} == {0.0}
    assert {r.source_size for r in got if r.source == "b"} == {3}
    check(rows, got)
    assert mixing.copies(d.limit(0)).collect() == []


def test_one_source_of_all_and_equal_sizes(spark):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.copies(d).collect()
    assert abs(sum(r.copies for r in got) - 3000) <= 1


def test_a_third_of_all_rows_without_id_and_very_long_texts(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 5).cast("int"))).alias("text"), F.lit("s").alias("source"), F.lit(1).alias("copies"))
    d = d.union(spark.createDataFrame([(9000, "y " * 200_000, "t", 1), (9001, "z", "t", 1)], d.schema))
    got = mixing.copies(d).collect()
    assert len(got) == 3002 and {r.id: r.size for r in got}[9000] == 200_000
    check(None, got)
    assert mixing.mix(d).columns == d.columns
