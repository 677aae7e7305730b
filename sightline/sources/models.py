"""Models as folders: parameters and named tables, in any store that Spark writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def write_model(spark: SparkSession, path: str, kind: str, params: dict, tables: dict[str, DataFrame]) -> None:
    """Write a model; an existing one of that path is replaced, its description last."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    about = json.dumps({"kind": kind, "version": VERSION, "params": params, "tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_model(spark: SparkSession, path: str, kind: str) -> tuple[dict, dict[str, DataFrame]]:
    """Parameters and tables of a model of the given kind; another kind or a later version is an error."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    if about["kind"] != kind:
        raise ValueError(f"a model of kind {about['kind']!r}, not {kind!r}")
    if about["version"] > VERSION:
        raise ValueError(f"a model of version {about['version']}")
    return about["params"], {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}
