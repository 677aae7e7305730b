"""Own functions within plans: predicates, fits of groups, table functions, and models that run on batches.

These are the slow path of the engine, for what built-in functions cannot say.
All of them work on Arrow batches; none is called for single rows but table
functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship


def select_where(features: DataFrame, columns: list[str], predicate: Callable[..., pd.Series]) -> DataFrame:
    """Rows for which a predicate over pandas columns holds; null counts as false."""
    ship(features.sparkSession)
    test = F.pandas_udf(lambda *c: predicate(*c).fillna(False).astype(bool), "boolean")
    return features.where(test(*(F.col(f"`{c}`") for c in columns)))


def fit_each(points: DataFrame, by: str, fit: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row a group, from a function of the group's rows; a group must fit a task."""
    ship(points.sparkSession)
    names = StructType.fromDDL(schema).names

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = fit(g)
        return pd.DataFrame([{n: g[by].iloc[0] if n == by else found.get(n) for n in names}])

    return points.groupBy(by).applyInPandas(run, schema)


def run_model(rows: DataFrame, make: Callable[[], Callable[[dict], dict]], inputs: list[str], outputs: str) -> DataFrame:
    """All columns and the outputs of a model: ``make`` loads it once a task, the model maps batches of columns (numpy) to columns.

    With onnxruntime, ``make`` may return a function that calls a session's run.
    """
    ship(rows.sparkSession)
    new = StructType.fromDDL(outputs)
    if clash := set(new.names) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    schema = StructType(rows.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            out = model({c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in inputs}) if b.num_rows else {}
            yield pa.record_batch([*b.columns, *(pa.array(out.get(n, [])) for n in new.names)], names=[*b.schema.names, *new.names])

    return rows.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """Make ``runs_of(bits)`` usable in SQL: the start and end of each run of true values of an array."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="cb int, ce int")
    class RunsOf:
        def eval(self, bits):
            start = None
            for i, on in enumerate([*(bits or []), False]):
                if on and start is None:
                    start = i
                elif not on and start is not None:
                    yield start, i
                    start = None

    spark.udtf.register("runs_of", RunsOf)
