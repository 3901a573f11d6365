"""User functions over a task table, and rules given as Spark SQL text."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions.attributes import false_if_null


def apply_task(
    rows: DataFrame, name: str, function: Callable[..., dict], arguments: list[str], result: str, keep: list[str]
) -> DataFrame:
    """Call ``function(**arguments)`` for every row; its dict fills the ``result`` columns.

    An exception fills ``error`` of that row and leaves the result null, and so does a result of another type. Arguments
    are what the columns hold: whole numbers stay whole, null is None. Rows stay in their partition and travel in Arrow batches.
    """
    wanted = T._parse_datatype_string(result)
    out = T.StructType([rows.schema[c] for c in keep] + list(wanted.fields) + [T.StructField("error", T.StringType())])
    unknown = set(arguments) - set(inspect.signature(function).parameters)
    if unknown:
        raise TypeError(f"{name} takes no argument {sorted(unknown)}")

    schema = to_arrow_schema(out)

    def one(values: dict) -> dict:
        given = {c: values[c] for c in keep}
        try:
            return {**given, **function(**{a: values[a] for a in arguments}), "error": None}
        except Exception as e:  # the task reports its failure as data
            return {**given, "error": f"{name} failed: {e}"}

    def typed(made: list[dict]) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist(made, schema=schema)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
            if len(made) == 1:  # a result of another type than declared
                return pa.RecordBatch.from_pylist([{c: made[0][c] for c in keep} | {"error": f"{name} failed: {e}"}], schema=schema)
            return pa.concat_batches([typed([m]) for m in made])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield typed([one(row) for row in batch.to_pylist()])

    return rows.select(*dict.fromkeys([*keep, *arguments])).mapInArrow(call, out)


def rule_expression(docs: DataFrame, rule: str) -> Column:
    """A rule over the document columns; a rule that does not parse or resolve is never satisfied."""
    test = F.expr(rule) if _resolves(docs, rule) else F.lit(False)
    return false_if_null(test.try_cast("boolean"))


def _resolves(docs: DataFrame, rule: str) -> bool:
    try:
        docs.select(F.expr(rule)).schema
    except (AnalysisException, ParseException):
        return False
    return True
