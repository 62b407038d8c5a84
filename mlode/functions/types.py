"""Type values, conversions of columns, Value.* and Type.*."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.functions import temporal as D
from mlode.functions.kit import Kit, exact, time_of
from mlode.functions.number import half_even, parse_number
from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.evaluator import equal
from mlode.plans.values import DATE, DATETIME, DATETIMEZONE, DURATION, LOGICAL, NULL, NUMBER, TEXT, TIME, Col, TypeValue, as_col, time_value

#: fixed values: ranges of whole-number types
WHOLE = {"Byte": (0, 255), "Int8": (-128, 127), "Int16": (-(1 << 15), (1 << 15) - 1), "Int32": (-(1 << 31), (1 << 31) - 1), "Int64": (-(1 << 63), (1 << 63) - 1)}
FACETS = ("Percentage", "Currency", "Double", "Single", "Decimal")
JSON_TO = {"text": (TEXT, "string"), "number": (NUMBER, "double"), "logical": (LOGICAL, "boolean"), "date": (DATE, "date"), "datetime": (DATETIME, "timestamp_ntz"), "datetimezone": (DATETIMEZONE, "timestamp")}


def iso_datetime(c: Column, kit: Kit) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T"), kit.clock_text(D.interval_micros(D.ntz_time(c))))


def convert(kit: Kit, c: Col, to: TypeValue) -> Col:
    """c as the type: null stays null, a value that doesn't convert is an error."""
    k, what = c.kind.name, f"can't convert to {to.display}"
    x = c.c
    if to.name == "any":
        return c
    if k == "null":
        return Col(F.lit(None), NULL, c.free)
    if k == "json":
        kind, sql = JSON_TO.get(to.name, (None, None))
        if kind is None:
            raise UnsupportedError(f"a conversion of a JSON value to {to.display}")
        made = kit.ev.json_convert(c, lambda x: convert(kit, x, to), kind, "bigint" if to.facet in WHOLE else sql)
        return Col(made.c, kind, c.free, to.facet in WHOLE)

    def parsed(pair: tuple[Column, Column], kind: str) -> Column:
        ok, value = pair
        return kit.fail(ok | x.isNull(), value, what, kind)

    def refuse() -> None:
        raise EvalError(f"can't convert a {k} to {to.display}")

    if to.name == "text":
        made = {
            "logical": lambda: F.when(x, "TRUE").when(~x, "FALSE"), "number": lambda: exact(c), "text": lambda: x, "any": lambda: x.cast("string"), "date": lambda: F.date_format(x, "yyyy-MM-dd"),
            "datetime": lambda: iso_datetime(x, kit), "datetimezone": lambda: F.concat(iso_datetime(x.cast("timestamp_ntz"), kit), F.lit("+00:00")), "time": lambda: kit.clock_text(D.interval_micros(time_of(x))), "duration": lambda: kit.duration_text(x),
        }
        return Col(made.get(k, refuse)(), TEXT, c.free)
    if to.name == "number":
        if k == "logical":
            value, whole = x.cast("long"), True
        elif k == "number":
            value, whole = x, c.whole
        elif k in ("text", "any"):
            value, whole = parsed(parse_number(x.cast("string")), "double"), False
        else:
            refuse()
        if to.facet in WHOLE:
            lo, hi = WHOLE[to.facet]
            if not whole:
                r = half_even(value, 0)
                ok = (r >= float(lo)) & (r <= float(hi) if to.facet != "Int64" else r < float(1 << 63))
                # whole-number text is read exactly
                value = F.when(value.isNotNull(), kit.fail(ok, F.when(ok, r).cast("long"), what, "bigint"))
            elif to.facet != "Int64":
                value = F.when(value.isNotNull(), kit.fail(value.between(lo, hi), value.cast("long"), what, "bigint"))
            return Col(value.cast("long"), NUMBER, c.free, True)
        if to.facet == "Currency":
            return Col(half_even(value, 4), NUMBER, c.free)
        if to.facet == "Single":
            return Col(value.cast("float").cast("double"), NUMBER, c.free)
        return Col(value.cast("double"), NUMBER, c.free)
    if to.name == "logical":
        if k == "logical":
            return c
        if k == "number":
            return Col(x != 0, LOGICAL, c.free)
        if k in ("text", "any"):
            t = F.lower(F.trim(x))
            return Col(parsed((t.isin("true", "false"), t == "true"), "boolean"), LOGICAL, c.free)
        refuse()
    if to.name == "date":
        if k in ("date", "datetime", "datetimezone"):
            return Col(x.cast("date"), DATE, c.free)
        if k in ("text", "any"):
            return Col(parsed(D.parse_date(x), "date"), DATE, c.free)
        refuse()
    if to.name == "datetime":
        if k in ("date", "datetime", "datetimezone"):
            return Col(x.cast("timestamp_ntz"), DATETIME, c.free)
        if k in ("text", "any"):
            return Col(parsed(D.parse_datetime(x), "timestamp_ntz"), DATETIME, c.free)
        refuse()
    if to.name == "datetimezone":
        if k == "datetimezone":
            return c
        if k in ("text", "any"):
            return Col(parsed(D.parse_zoned(x), "timestamp"), DATETIMEZONE, c.free)
        refuse()
    if to.name == "time":
        if k == "time":
            return c
        if k in ("datetime", "datetimezone"):
            return Col(F.when(x.isNotNull(), time_value(D.ntz_time(x.cast("timestamp_ntz")))), TIME, c.free)
        if k in ("text", "any"):
            return Col(F.when(x.isNotNull(), time_value(parsed(D.parse_time(x), "interval day to second"))), TIME, c.free)
        refuse()
    if to.name == "duration":
        if k == "duration":
            return c
        if k == "number":
            return Col(D.micros_interval(F.round(x.cast("double") * D.MICROS).cast("long")), DURATION, c.free)
        if k in ("text", "any"):
            return Col(parsed(D.parse_duration(x), "interval day to second"), DURATION, c.free)
        refuse()
    raise UnsupportedError(f"a conversion to {to.display}")


def register(kit: Kit) -> None:
    ev, fn = kit.ev, kit.fn
    for name in ("Any", "Text", "Number", "Logical", "Date", "DateTime"):
        kit.constant(f"{name}.Type", TypeValue(name.lower()))
    for name in (*WHOLE, *FACETS):
        kit.constant(f"{name}.Type", TypeValue("number", name))

    def same(a: Any, b: Any, criteria: Any = None) -> Any:
        if criteria is not None:
            kit.refuse("a comparer of Value.Equals")
        return equal(a, b)

    fn("Value.Equals", 2, 3, same)

    def compare(a: Any, b: Any, comparer: Any = None) -> Any:
        if comparer is not None:
            kit.refuse("a comparer of Value.Compare")
        x, y = as_col(a), as_col(b)
        kx, ky = x.kind.name, y.kind.name
        if kx != ky and "null" not in (kx, ky) and "any" not in (kx, ky):
            kit.refuse(f"Value.Compare of {kx} and {ky}")
        less = F.coalesce(F.when(x.c.isNull(), y.c.isNotNull()).when(y.c.isNull(), False).otherwise(F.lit(False) if "null" in (kx, ky) else x.c < y.c), F.lit(False))
        return Col(F.when(x.c.eqNullSafe(y.c) if "null" not in (kx, ky) else x.c.isNull() & y.c.isNull(), 0).when(less, -1).otherwise(1).cast("long"), NUMBER, x.free and y.free, True)

    fn("Value.Compare", 2, 3, compare)

    def type_of(v: Any) -> TypeValue:
        k = V.kind_of_value(v).name
        if isinstance(v, TypeValue) or k in ("list", "record", "any") or not isinstance(v, (Col, type(None), *V.PLAIN)):
            kit.refuse("Value.Type of a structured value")
        if isinstance(v, dt.datetime) and v.tzinfo:
            k = "datetimezone"
        return TypeValue(k)

    fn("Value.Type", 1, 1, type_of)

    def need_type(t: Any) -> TypeValue:
        if not isinstance(t, TypeValue):
            raise EvalError("a type is expected")
        return t

    def fits(t: TypeValue, to: TypeValue) -> bool:
        if to.name == "any":
            return True
        return t.name == to.name and (not to.facet or t.facet == to.facet)

    def value_is(v: Any, t: Any) -> Any:
        to = need_type(t)
        if to.name == "none":
            return False
        if v is None or to.name == "any":
            return True
        hit = V.kind_of_value(v).name == to.name
        if isinstance(v, Col) and not hit:
            return Col(v.c.isNull(), LOGICAL, v.free)
        if to.facet in WHOLE and hit:
            lo, hi = WHOLE[to.facet]
            c = as_col(v)
            return Col(F.coalesce(c.c.isNull() | ((c.c == F.floor(c.c.cast("double"))) & c.c.between(lo, hi)), F.lit(True)), LOGICAL, c.free)
        return hit

    fn("Value.Is", 2, 2, value_is)
    fn("Type.Is", 2, 2, lambda a, b: fits(need_type(a), need_type(b)))
    kit.convert = lambda c, t: convert(kit, c, need_type(t))
    ev.convert = kit.convert
