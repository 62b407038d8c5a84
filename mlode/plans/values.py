"""Plan-time values: constants, columns, tables, groups, functions and types.

A query is evaluated once, symbolically. What is known then (literals, names,
schemas) is a Python value; what depends on rows is a ``Col`` that Catalyst runs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.plans.errors import EvalError, UnsupportedError

HIDDEN = "__m_"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Kind:
    """The M type of a column: name, element kind of lists, field kinds of records."""

    name: str
    elem: "Kind | None" = None
    fields: tuple[tuple[str, "Kind"], ...] = ()


ANY, NULL, TEXT, NUMBER, LOGICAL = (Kind(x) for x in ("any", "null", "text", "number", "logical"))
#: a JSON value whose kind depends on the row: a VARIANT column, typed where it is used
JSON = Kind("json")
DATE, DATETIME, DATETIMEZONE, TIME, DURATION, BINARY = (Kind(x) for x in ("date", "datetime", "datetimezone", "time", "duration", "binary"))


def kind_of(t: T.DataType) -> Kind:
    if isinstance(t, T.ArrayType):
        return Kind("list", kind_of(t.elementType))
    if isinstance(t, T.StructType):
        if [f.name for f in t] == [TIME_FIELD]:
            return TIME
        return Kind("record", fields=tuple((f.name, kind_of(f.dataType)) for f in t))
    for types, kind in (((T.StringType, T.VarcharType, T.CharType), TEXT), (T.BooleanType, LOGICAL), (T.DateType, DATE), (T.TimestampNTZType, DATETIME), (T.TimestampType, DATETIMEZONE), (T.DayTimeIntervalType, DURATION), (T.BinaryType, BINARY), (T.NullType, NULL), (T.NumericType, NUMBER), (T.VariantType, JSON)):
        if isinstance(t, types):
            return kind
    return ANY


#: A time of day is a struct of one day-time interval since midnight.
TIME_FIELD = "time_of_day"


@dataclass
class Col:
    """An expression over rows; free if it names no column."""

    c: Column
    kind: Kind = ANY
    free: bool = False
    whole: bool = False  # known to hold whole numbers (long)


class Rec(dict):
    """A record: field name -> value, in order."""


@dataclass
class TypeValue:
    name: str  # primitive name
    facet: str = ""  # Int64, Currency, ...
    fields: list[str] | None = None

    @property
    def display(self) -> str:
        return f"{self.facet}.Type" if self.facet else f"type {self.name}"


@dataclass
class Fn:
    name: str
    call: Callable[..., Any]
    least: int
    most: int
    params: list[str] = field(default_factory=list)

    def __call__(self, *args):
        if not self.least <= len(args) <= self.most:
            raise UnsupportedError(f"{self.name} takes {self.least}{'' if self.least == self.most else f' to {self.most}'} arguments, not {len(args)}")
        return self.call(*args)


@dataclass(frozen=True)
class Enum:
    name: str
    value: int | None = None


class Table:
    """A DataFrame with its visible columns and its row order (hidden columns, leading key first)."""

    def __init__(self, df: DataFrame | None, cols: list[str], order: list[tuple[str, bool]] | None = None, explicit: bool = False, nested: Any = None):
        self._df, self.cols, self.order, self.explicit, self.nested = df, cols, list(order or []), explicit, nested
        if len({c.lower() for c in cols}) != len(cols):
            raise EvalError(f"columns with the same name: {', '.join(cols)}")

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.nested.materialise()
        return self._df

    @property
    def kinds(self) -> dict[str, Kind]:
        return {f.name: kind_of(f.dataType) for f in self.df.schema.fields if f.name in self.cols}

    def hidden(self) -> list[str]:
        return [n for n, _ in self.order]

    def need(self, *names: str) -> None:
        for n in names:
            if n not in self.cols:
                raise EvalError(f"The column '{n}' of the table wasn't found.")

    def col(self, name: str) -> Col:
        self.need(name)
        t = self.df.schema[name].dataType
        return Col(quoted(name), kind_of(t), whole=isinstance(t, T.IntegralType))

    def row(self) -> Rec:
        schema = self.df.schema
        return Rec((n, Col(quoted(n), kind_of(schema[n].dataType), whole=isinstance(schema[n].dataType, T.IntegralType))) for n in self.cols)

    def select(self, pairs: list[tuple[str, Column]], **how) -> "Table":
        """New visible columns; hidden ones stay."""
        df = self.df.select(*[c.alias(n) for n, c in pairs], *[quoted(h) for h in self.hidden()])
        return Table(df, [n for n, _ in pairs], how.get("order", self.order), how.get("explicit", self.explicit))

    def keep(self, df: DataFrame) -> "Table":
        return Table(df, self.cols, self.order, self.explicit)

    def order_by(self, reverse: bool = False) -> list[Column]:
        return [(quoted(n).asc_nulls_first() if up != reverse else quoted(n).desc_nulls_last()) for n, up in self.order]

    def need_order(self) -> None:
        if not self.order:
            raise UnsupportedError("this table has no row order; sort it first")
        if self.df.isStreaming:
            raise UnsupportedError("a stream has no row order: positional operators are refused")

    def result(self) -> DataFrame:
        df = self.df.orderBy(*self.order_by()) if self.explicit and self.order else self.df
        return df.select(*[quoted(c) for c in self.cols])


class TableColumn:
    """The list of a table's column: t[c]."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name
        self.col = table.col(name)


class Group:
    """The sub-table inside a grouping: row expressions under a condition, to be aggregated.

    modes: (value, condition, the aggregate that stands for it, shares or None) of each List.Mode, List.Median and List.Percentile, which Table.Group counts on its own; None elsewhere.
    """

    def __init__(self, row: Rec, cond: Column | None, order: list[tuple[str, bool]], nested: bool = False, modes: list | None = None):
        self.row, self.cond, self.order, self.modes = row, cond, order, modes


class GroupColumn:
    """A list of one value for each row of a group."""

    def __init__(self, col: Col, group: Group):
        self.col, self.group = col, group

    def value(self) -> Column:
        return self.col.c if self.group.cond is None else F.when(self.group.cond, self.col.c)

    def agg(self, fn: Callable[[Column], Column]) -> Column:
        return fn(self.value())

    def array(self) -> Col:
        """Gathered in row order; for what has no aggregate function."""
        keys = []
        for n, up in self.group.order:
            if not up:
                raise UnsupportedError("a descending order inside a group that is gathered as a list")
            keys.append(quoted(n).alias(n))
        item = F.struct(*keys, self.col.c.alias("v"))
        gathered = F.collect_list(item if self.group.cond is None else F.when(self.group.cond, item))
        return Col(F.transform(F.array_sort(gathered) if keys else gathered, lambda x: x["v"]), Kind("list", self.col.kind))


class Distinct(Col):
    """The distinct values of a group's column: a list that is gathered where it is needed, and counted without."""

    def __init__(self, of: GroupColumn):
        self.of, self.kind, self.free, self.whole = of, Kind("list", of.col.kind), False, False

    @property
    def c(self) -> Column:
        return F.array_distinct(self.of.array().c)

    def count(self) -> Column:
        """How many, null being one of them."""
        v = F.struct(self.of.col.c.alias("v"))
        v = v if self.of.group.cond is None else F.when(self.of.group.cond, v)
        # modes is None in a stream, which has no distinct aggregate, and in a pivot's cells
        return F.count_distinct(v) if self.of.group.modes is not None else F.size(F.array_distinct(F.collect_set(v))).cast("long")


PLAIN = (bool, int, float, str, bytes, dt.date, dt.datetime, dt.time, dt.timedelta)


def kind_of_value(v: Any) -> Kind:
    if v is None:
        return NULL
    if isinstance(v, Col):
        return v.kind
    for t, k in ((bool, LOGICAL), ((int, float), NUMBER), (str, TEXT), (bytes, BINARY), (dt.datetime, None), (dt.date, DATE), (dt.time, TIME), (dt.timedelta, DURATION)):
        if isinstance(v, t):
            return k or (DATETIMEZONE if v.tzinfo else DATETIME)
    if isinstance(v, list):
        kinds = {kind_of_value(x) for x in v} - {NULL}
        return Kind("list", kinds.pop() if len(kinds) == 1 else ANY if kinds else NULL)
    if isinstance(v, Rec):
        return Kind("record", fields=tuple((k, kind_of_value(x)) for k, x in v.items()))
    if isinstance(v, GroupColumn):
        return Kind("list", v.col.kind)
    return ANY


def time_value(interval: Column) -> Column:
    return F.struct(interval.alias(TIME_FIELD))


def as_col(v: Any) -> Col:
    """Any value that a cell can hold, as a column."""
    if isinstance(v, Col):
        return v
    if isinstance(v, GroupColumn):
        return v.array()
    if isinstance(v, Group):
        raise UnsupportedError("a nested table here")
    k = kind_of_value(v)
    if v is None:
        return Col(F.lit(None), NULL, True)
    if isinstance(v, bool):
        return Col(F.lit(v), LOGICAL, True)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            return Col(F.lit(float(v)), NUMBER, True)
        return Col(F.lit(v).cast("long"), NUMBER, True, True)
    if isinstance(v, dt.time):
        return Col(time_value(F.lit(dt.timedelta(hours=v.hour, minutes=v.minute, seconds=v.second, microseconds=v.microsecond))), TIME, True)
    if isinstance(v, dt.datetime) and not v.tzinfo:
        return Col(F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz"), DATETIME, True)
    if isinstance(v, bytes):
        return Col(F.unhex(F.lit(v.hex())), BINARY, True)
    if isinstance(v, PLAIN):
        return Col(F.lit(v), k, True)
    if isinstance(v, list):
        cols = [as_col(x) for x in v]
        kinds = {c.kind.name for c in cols} - {"null"}
        if len(kinds) > 1:
            raise UnsupportedError("a list of different types can't be a column")
        return Col(F.array(*[c.c for c in cols]), k, all(c.free for c in cols))
    if isinstance(v, Rec):
        cols = {n: as_col(x) for n, x in v.items()}
        if not cols:
            raise UnsupportedError("an empty record can't be a column")
        return Col(F.struct(*[c.c.alias(n) for n, c in cols.items()]), Kind("record", fields=tuple((n, c.kind) for n, c in cols.items())), all(c.free for c in cols.values()))
    if isinstance(v, TableColumn):
        raise UnsupportedError("another table's column in a row expression")
    raise UnsupportedError(f"{type(v).__name__} can't be a column")


def as_rec(v: Any) -> Rec | None:
    """A record value, field by field."""
    if v is None or isinstance(v, Rec):
        return v
    if isinstance(v, Col) and v.kind.name == "record":
        return Rec((n, Col(v.c.getField(n), k, v.free)) for n, k in v.kind.fields)
    raise EvalError("a record is expected")
