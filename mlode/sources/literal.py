"""Tables from plan-time values."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import Rec, Table, quoted


def spark_type(values: list[Any]) -> T.DataType:
    """The type of a column of plan-time values; mixed ones are refused."""
    some = [v for v in values if v is not None]
    if not some:
        return T.StringType()
    kinds = {V.kind_of_value(v).name for v in some}
    if len(kinds) > 1:
        raise UnsupportedError(f"a column of {', '.join(sorted(kinds))} values")
    kind = kinds.pop()
    if kind == "number":
        return T.LongType() if all(isinstance(v, int) and -(1 << 63) <= v < 1 << 63 for v in some) else T.DoubleType()
    if kind == "list":
        return T.ArrayType(spark_type([x for v in some for x in v]))
    if kind == "record":
        names = list(dict.fromkeys(k for v in some for k in v))
        return T.StructType([T.StructField(n, spark_type([v.get(n) for v in some])) for n in names])
    if kind == "time":
        return T.StructType([T.StructField(V.TIME_FIELD, T.DayTimeIntervalType())])
    simple = {"text": T.StringType(), "logical": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "datetimezone": T.TimestampType(), "duration": T.DayTimeIntervalType(), "binary": T.BinaryType()}
    if kind not in simple:
        raise UnsupportedError(f"a column of {kind} values")
    return simple[kind]


def cell(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(v, dt.time):
        return (dt.timedelta(hours=v.hour, minutes=v.minute, seconds=v.second, microseconds=v.microsecond),)
    if isinstance(v, dict):
        return tuple(cell(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(v, list):
        return [cell(x, t.elementType) for x in v]
    return v


def from_rows(ev: Any, names: list[str], rows: list[list[Any]]) -> Table:
    """A literal table; its order is the order given."""
    from mlode.operators.positional import ORDINAL

    rows = [[ev.const(v) for v in r] for r in rows]
    types = [spark_type([r[k] for r in rows]) for k in range(len(names))]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)] + [T.StructField(ORDINAL, T.LongType())])
    data = [(*(cell(v, t) for v, t in zip(r, types, strict=True)), k) for k, r in enumerate(rows)]
    df = ev.ctx.spark.createDataFrame(data, schema)
    df = df.select(*[quoted(n) for n in names], F.struct(F.lit("").alias("f"), F.col(ORDINAL).alias("r")).alias(ORDINAL))
    return Table(df, names, [(ORDINAL, True)])


def from_records(ev: Any, records: list[Rec]) -> Table:
    names = list(dict.fromkeys(k for r in records for k in r))
    return from_rows(ev, names, [[r.get(n) for n in names] for r in records])


def column_names(ev: Any, v: Any, width: int, what: str) -> list[str]:
    """Names from a list, a count, a table type or null (Column1..N)."""
    if isinstance(v, V.TypeValue):
        if v.fields is None:
            raise EvalError(f"{what}: a table type is expected")
        return v.fields
    v = ev.const(v, "column names")
    if v is None:
        return [f"Column{k + 1}" for k in range(width)]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return [f"Column{k + 1}" for k in range(int(v))]
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v) or len(set(v)) != len(v):
        raise EvalError(f"{what}: column names must be distinct texts")
    return v
