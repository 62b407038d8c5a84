"""How scalar functions are declared.

``Kit.add("Text.Start", "text!,#whole", TEXT, fn)``: the signature lists argument
kinds; a trailing ``?`` makes one optional (missing or null: None is passed), a
leading ``#`` takes its plan-time value (#text, #whole, #number, #list, #any), a
trailing ``!`` says that null is an error there (else null gives null). fn gets
Columns and plan-time values and returns a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import Col, Enum, Fn, Kind, as_col


class Kit:
    def __init__(self, ev: Any):
        self.ev, self.found = ev, {}

    def fail(self, ok: Column, value: Column, message: str, kind: str) -> Column:
        """value where ok, else an error."""
        return self.ev.fail(ok, value, message, kind)

    def fn(self, name: str, least: int, most: int, call: Callable[..., Any]) -> None:
        self.found[name] = Fn(name, call, least, most)

    def constant(self, name: str, value: Any) -> None:
        self.found[name] = value

    def enum(self, name: str, value: int | None = None) -> None:
        self.found[name] = Enum(name, value)

    def add(self, name: str, signature: str, out: Kind, fn: Callable[..., Column], whole: bool = False) -> None:
        specs = [s for s in signature.split(",") if s]
        least = sum(not s.endswith("?") for s in specs)

        def call(*args: Any) -> Any:
            passed, free = [], True
            for k, spec in enumerate(specs):
                optional, strict = spec.endswith("?"), spec.endswith("!")
                kind = spec.rstrip("?!")
                v = args[k] if k < len(args) else None
                if kind.startswith("#"):
                    passed.append(self.plain(name, kind[1:], v, optional))
                    continue
                if v is None:
                    if optional:
                        passed.append(None)
                        continue
                    if strict:
                        raise EvalError(f"{name}: null is not a {kind}")
                    return None
                c = as_col(v)
                if c.kind.name == "null":
                    return None
                for k in kind.split("|"):
                    c = self.ev.as_kind(c, Kind(k))
                if kind != "any" and c.kind.name not in (*kind.split("|"), "any"):
                    raise EvalError(f"{name} needs a {kind}, not a {c.kind.name}")
                free = free and c.free
                value = c.c
                if strict and self.ev.ctx.strict and not c.free:
                    value = self.fail(value.isNotNull(), value, f"{name}: null is not a {kind}", "void")
                passed.append(value if kind != "any" else c)
            return Col(fn(*passed), out, free, whole)

        self.found[name] = Fn(name, call, least, len(specs))

    def plain(self, name: str, kind: str, v: Any, optional: bool) -> Any:
        v = self.ev.const(v, f"argument of {name}")
        if v is None:
            if optional:
                return None
            raise EvalError(f"{name}: null is not a {kind}")
        if kind == "whole":
            return self.ev.whole(v, f"argument of {name}")
        if kind == "enum" and not isinstance(v, Enum):
            raise EvalError(f"{name}: an enumeration value is expected")
        if kind == "text" and not isinstance(v, str):
            raise EvalError(f"{name}: a text is expected")
        if kind == "list" and not isinstance(v, list):
            raise EvalError(f"{name}: a list is expected")
        if kind == "count":
            n = self.ev.whole(v, f"argument of {name}")
            if n < 0:
                raise EvalError(f"{name}: a count can't be negative")
            return n
        return v

    def refuse(self, what: str) -> None:
        raise UnsupportedError(f"{what} is not supported")


def number_text(c: Column, whole: bool = False) -> Column:
    """Shortest text of a number: whole values without a fraction, exponents as e-07."""
    if whole:
        return c.cast("string")
    d = c.cast("double")
    s = d.cast("string")
    digits, exponent = F.regexp_extract(s, "^(-?[0-9.]+)E(-?[0-9]+)$", 1), F.regexp_extract(s, "^(-?[0-9.]+)E(-?[0-9]+)$", 2)
    power = F.when(exponent != "", exponent.cast("int"))
    short = F.regexp_replace(digits, "\\.0$", "")
    wide = F.concat(short, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    # the JVM turns to exponents below 1e-3 already; plain notation runs down to 1e-4
    small = (F.abs(d) < 1e-3) & (F.abs(d) >= 1e-4)
    plain = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0.000"), F.regexp_replace(F.regexp_replace(digits, "[-.]", ""), "0+$", ""))
    return (
        F.when(F.isnan(d), "nan")
        .when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf"))
        .when((F.abs(d) < 1e16) & (d == F.floor(d)), d.cast("decimal(20,0)").cast("string"))
        .when(small, plain)
        .when((F.abs(d) < 1e16) & (power > 0), F.regexp_replace(F.regexp_replace(d.cast("decimal(38,10)").cast("string"), "0+$", ""), "\\.$", ""))
        .when(exponent != "", wide)
        .otherwise(s)
    )


def exact(c: Col) -> Column:
    return number_text(c.c, c.whole)


def time_of(c: Column) -> Column:
    return c.getField(V.TIME_FIELD)
