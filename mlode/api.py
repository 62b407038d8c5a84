"""Running M queries on Spark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.functions import registry
from mlode.lang import syntax as S
from mlode.lang.parser import parse, parse_section
from mlode.operators.positional import ORDINAL, counted_ordinal
from mlode.plans.errors import EvalError, MError, ParseError, UnsupportedError
from mlode.plans.evaluator import ORDERED, Context, Evaluator, Scope
from mlode.plans.values import Col, Enum, Fn, Group, GroupColumn, Rec, Table, TableColumn, quoted
from mlode.sources.files import bound

__all__ = ["EvalError", "MError", "ParseError", "UnsupportedError", "evaluate", "names", "run", "section_member", "write"]


def needs_order(node: S.Node) -> bool:
    return any((isinstance(n, S.Name) and n.name in ORDERED) or isinstance(n, S.Item) for n in S.walk(node))


def as_table(v: Any) -> Table:
    """A bound DataFrame, with the ordinal that it may carry."""
    cols = [c for c in v.columns if c != ORDINAL]
    return Table(v, cols, [(ORDINAL, True)] if ORDINAL in v.columns else [])


def evaluator(spark: SparkSession, node: S.Node, bindings: dict[str, Any] | None, nulls: str, base: str | None) -> Evaluator:
    if nulls not in ("sql", "strict"):
        raise ValueError("nulls: 'sql' or 'strict'")
    ordered = needs_order(node)
    context = Context(spark, {}, nulls, ordered, base)
    ev = Evaluator(context, {})
    ev.registry = registry(ev)
    cache: dict[str, Any] = {}

    def binding(name: str, value: Any) -> Any:
        if name not in cache:
            v = bound(spark, value, ordered)
            if isinstance(v, DataFrame):
                v = as_table(v if ORDINAL in v.columns or not ordered or v.isStreaming else counted_ordinal(v))
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                from mlode.sources.literal import from_records

                v = from_records(ev, [Rec(x) for x in v])
            cache[name] = v
        return cache[name]

    for name, value in (bindings or {}).items():
        context.bindings[name] = lambda name=name, value=value: binding(name, value)
    return ev


def evaluate(spark: SparkSession, text: str, bindings: dict[str, Any] | None = None, *, nulls: str = "sql", base: str | None = None, node: S.Node | None = None) -> Any:
    """The value of an M expression: a DataFrame for a table, else a Python value.

    bindings: names of sources or steps -> DataFrame, path, rows or value. nulls: "sql" lets nulls pass through
    arithmetic and aggregates; "strict" makes them errors, as the language does. base: the folder of relative paths."""
    node = node or parse(text)
    ev = evaluator(spark, node, bindings, nulls, base)
    return finished(ev, ev.eval(node, Scope({})))


def finished(ev: Evaluator, v: Any) -> Any:
    if isinstance(v, Table):
        return v.result()
    if isinstance(v, (Col, TableColumn)):
        return finished(ev, ev.const(v)) if isinstance(v, TableColumn) else ev.const(v)
    if isinstance(v, (Group, GroupColumn, Fn, Enum)):
        raise UnsupportedError(f"the result is a {type(v).__name__.lower()}")
    if isinstance(v, list):
        return [finished(ev, x) for x in v]
    if isinstance(v, Rec):
        return {k: finished(ev, x) for k, x in v.items()}
    return v


def run(spark: SparkSession, text: str, bindings: dict[str, Any] | None = None, **how: Any) -> DataFrame:
    """The table of an M query, as a DataFrame."""
    out = evaluate(spark, text, bindings, **how)
    if not isinstance(out, DataFrame):
        raise EvalError("the query gives no table")
    return out


def section_member(spark: SparkSession, text: str, member: str, bindings: dict[str, Any] | None = None, **how: Any) -> Any:
    """The value of one member of a section document; members see each other."""
    members = parse_section(text)
    if member not in members:
        raise EvalError(f"the section has no member '{member}'")
    node = S.Let(list(members.items()), S.Name(member))
    return evaluate(spark, "", bindings, node=node, **how)


def write(table: Any, path: str, to: str = "parquet", mode: str = "error") -> None:
    """A query's table to a folder, by all tasks: Parquet, CSV (with a header) or JSON lines. Times of day, intervals and JSON values are texts in CSV and JSON."""
    if not isinstance(table, DataFrame):
        raise EvalError("only a table can be written")
    if to == "parquet":
        table.write.mode(mode).parquet(path)
        return
    shown = []
    for f in table.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.VariantType):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DayTimeIntervalType, T.StructType, T.ArrayType)) and (to == "csv" or isinstance(f.dataType, T.DayTimeIntervalType)):
            c = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType)) else c.cast("string")
        shown.append(c.alias(f.name))
    out = table.select(*shown).write.mode(mode)
    (out.option("header", True).option("escape", '"') if to == "csv" else out.option("ignoreNullFields", False)).format(to).save(path)


def names(spark: SparkSession) -> list[str]:
    """All names of the registry."""
    return sorted(evaluator(spark, S.Literal(None), {}, "sql", None).registry)
