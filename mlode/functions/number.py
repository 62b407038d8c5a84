"""Number and logical functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.functions.kit import Kit
from mlode.plans.errors import EvalError
from mlode.plans.values import LOGICAL, NUMBER, TEXT, Col, as_col

NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
HEX_PATTERN = r"^[+-]?0[xX][0-9a-fA-F]+$"
NAN = float("nan")


def parse_number(c: Column) -> tuple[Column, Column]:
    """(is a number, its value) of a text."""
    t = F.trim(c, F.lit(" \t\r\n\x0b\x0c"))
    named = F.lower(t)
    hexed = F.conv(F.regexp_extract(t, "^[+-]?0[xX]([0-9a-fA-F]+)$", 1), 16, 10)
    value = (
        F.when(t.rlike(NUMBER_PATTERN), F.expr("1.0d") * F.when(t.rlike(NUMBER_PATTERN), t).cast("double"))
        .when(t.rlike(HEX_PATTERN), F.when(F.startswith(t, F.lit("-")), -1.0).otherwise(1.0) * F.when(t.rlike(HEX_PATTERN), hexed).cast("double"))
        .when(named == "#infinity", F.lit(float("inf")))
        .when(named == "#nan", F.lit(NAN))
    )
    return t.rlike(NUMBER_PATTERN) | t.rlike(HEX_PATTERN) | named.isin("#infinity", "#nan"), value


def rounded(c: Column, digits: int, how: Any) -> Column:
    scale = F.lit(float(10**digits) if digits >= 0 else 1.0 / 10**-digits)
    return how(c.cast("double") * scale).cast("double") / scale


def half_even(c: Column, digits: int) -> Column:
    """c rounded by its exact binary value, ties to even: 2.675 lies below the tie, so 2 digits make it 2.67."""
    d = c.cast("double")
    if digits == 0:
        return F.rint(d)
    if digits < 0:
        unit = 10.0**-digits
        rest = F.pmod(d, F.lit(unit))
        below = (d - rest) / unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (F.pmod(below, F.lit(2.0)) == 1))
        return (below + F.when(up, 1.0).otherwise(0.0)) * unit
    if digits > 22:
        return d
    unit = 10.0**digits
    scaled = d * unit

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * SPLIT - (x * SPLIT - x)
        return high, x - high

    # the part of the exact product that the double product lacks
    (a, b), (u, v) = halves(d), (float(high_half(unit)), unit - float(high_half(unit)))
    rest = ((a * u - scaled) + a * v + b * u) + b * v
    tie = scaled - F.floor(scaled) == 0.5
    whole = F.when(tie & (rest > 0), F.ceil(scaled).cast("double")).when(tie & (rest < 0), F.floor(scaled).cast("double")).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) < float(1 << 52), whole / unit).otherwise(d)


#: Splits a double into two halves whose products are exact.
SPLIT = float((1 << 27) + 1)


def high_half(x: float) -> float:
    return x * SPLIT - (x * SPLIT - x)


def register(kit: Kit) -> None:
    ev, add, fn = kit.ev, kit.add, kit.fn

    def number_from(v: Any) -> Any:
        if v is None:
            if ev.ctx.strict:
                raise EvalError("Number.From: null is not a number")
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "json":
            return ev.json_convert(c, number_from, NUMBER, "double")
        if k == "logical":
            return Col(c.c.cast("long"), NUMBER, c.free, True)
        if k == "number":
            return c
        if k in ("text", "any"):
            ok, value = parse_number(c.c.cast("string"))
            return Col(kit.fail(ok | c.c.isNull(), value, "Number.From: not a number", "double"), NUMBER, c.free)
        if k == "null":
            return number_from(None)
        raise EvalError(f"Number.From can't convert a {k}")

    fn("Number.From", 1, 1, number_from)

    def logical_from(v: Any) -> Any:
        if v is None:
            if ev.ctx.strict:
                raise EvalError("Logical.From: null is not logical")
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "json":
            return ev.json_convert(c, logical_from, LOGICAL, "boolean")
        if k == "logical":
            return c
        if k == "number":
            return Col(c.c != 0, LOGICAL, c.free)
        if k in ("text", "any"):
            t = F.lower(F.trim(c.c))
            return Col(kit.fail(t.isin("true", "false") | c.c.isNull(), t == "true", "Logical.From: not logical", "boolean"), LOGICAL, c.free)
        if k == "null":
            return logical_from(None)
        raise EvalError(f"Logical.From can't convert a {k}")

    fn("Logical.From", 1, 1, logical_from)

    def rounding(name: str, how: Any) -> None:
        add(name, "number,#whole?", NUMBER, lambda c, d: how(c, d or 0))

    rounding("Number.Round", half_even)
    rounding("Number.RoundUp", lambda c, d: rounded(c, d, F.ceil))
    rounding("Number.RoundDown", lambda c, d: rounded(c, d, F.floor))
    rounding("Number.RoundAwayFromZero", lambda c, d: rounded(c, d, lambda x: F.when(x >= 0, F.ceil(x)).otherwise(F.floor(x))))
    rounding("Number.RoundTowardZero", lambda c, d: rounded(c, d, lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))))
    fn("Number.Abs", 1, 1, lambda v: keep_whole(v, "Number.Abs", F.abs))
    add("Number.Sign", "number", NUMBER, lambda c: F.signum(c.cast("double")).cast("long"), True)

    def keep_whole(v: Any, name: str, how: Any) -> Any:
        if v is None:
            raise EvalError(f"{name}: null is not a number")
        c = as_col(v)
        if c.kind.name not in ("number", "any"):
            raise EvalError(f"{name} needs a number")
        return Col(how(c.c), NUMBER, c.free, c.whole)

    add("Number.Power", "number,number", NUMBER, lambda a, b: F.pow(a.cast("double"), b.cast("double")))
    add("Number.Sqrt", "number", NUMBER, lambda c: F.sqrt(c.cast("double")))
    add("Number.Exp", "number", NUMBER, lambda c: F.exp(c.cast("double")))
    add("Number.Ln", "number", NUMBER, lambda c: F.when(c <= 0, F.lit(NAN)).otherwise(F.ln(c.cast("double"))))

    def log(c: Column, base: Column | None) -> Column:
        if base is None:
            return F.when(c <= 0, F.lit(NAN)).otherwise(F.ln(c.cast("double")))
        return F.when((c <= 0) | (base <= 0) | (base == 1), F.lit(NAN)).otherwise(F.ln(c.cast("double")) / F.when(base == 1, F.lit(NAN)).otherwise(F.ln(base.cast("double"))))

    add("Number.Log", "number,number?", NUMBER, log)
    add("Number.Log10", "number", NUMBER, lambda c: F.when(c <= 0, F.lit(NAN)).otherwise(F.log10(c.cast("double"))))

    def divided(name: str, how: Any, whole: bool) -> None:
        def call(*args: Any) -> Any:
            if len(args) > 2 and args[2] is not None:
                kit.refuse(f"a precision of {name}")
            if args[0] is None or args[1] is None:
                return None
            a, b = as_col(args[0]), as_col(args[1])
            if any(x.kind.name not in ("number", "any") for x in (a, b)):
                raise EvalError(f"{name} needs numbers")
            both = a.whole and b.whole
            made = how(a.c, b.c, both)
            zero = "bigint" if both else "double"
            return Col(kit.fail((b.c != 0) | b.c.isNull(), made, f"{name}: division by zero", zero), NUMBER, a.free and b.free, both)

        fn(name, 2, 3, call)

    divided("Number.Mod", lambda a, b, whole: F.try_mod(a, b), True)
    nonzero = lambda b: F.when(b != 0, b)

    def quotient(a: Column, b: Column, whole: bool) -> Column:
        if whole:
            return F.try_divide(a - F.try_mod(a, b), b).cast("long")
        q = a.cast("double") / nonzero(b).cast("double")
        return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("double")

    divided("Number.IntegerDivide", quotient, True)

    def factorial(c: Column) -> Column:
        whole = (c >= 0) & (c == F.floor(c.cast("double")))
        large = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(c, F.lit(170)), F.lit(1)).cast("int")), F.lit(1.0), lambda a, x: a * x)
        value = F.when(c > 170, F.lit(float("inf"))).otherwise(large)
        return kit.fail(whole | c.isNull(), value, "Number.Factorial: a whole number from 0 is needed", "double")

    add("Number.Factorial", "number", NUMBER, factorial)

    def parity(name: str, rest: int) -> None:
        def made(c: Column) -> Column:
            return kit.fail((c == F.floor(c.cast("double"))) | c.isNull(), (F.abs(c) % 2) == rest, f"{name}: a fraction", "boolean")

        add(name, "number", LOGICAL, made)

    parity("Number.IsEven", 0)
    parity("Number.IsOdd", 1)
    add("Number.IsNaN", "number", LOGICAL, lambda c: F.isnan(c.cast("double")))
    for name, op in (("And", "bitwiseAND"), ("Or", "bitwiseOR"), ("Xor", "bitwiseXOR")):
        add(f"Number.Bitwise{name}", "number,number", NUMBER, lambda a, b, op=op: getattr(a.cast("long"), op)(b.cast("long")), True)
    fn("Number.Random", 0, 0, lambda: Col(F.rand(), NUMBER))

    def between(lo: Any, hi: Any) -> Any:
        a, b = as_col(lo), as_col(hi)
        if a.free and b.free and ev.const(a) > ev.const(b):
            raise EvalError("Number.RandomBetween: the lower bound is above the upper")
        return Col(a.c + F.rand() * (b.c - a.c), NUMBER)

    fn("Number.RandomBetween", 2, 2, between)

    def to_text(*args: Any) -> Any:
        from mlode.functions.kit import exact

        if args[0] is None:
            return None
        c = as_col(args[0])
        form = ev.const(args[1], "format") if len(args) > 1 else None
        if len(args) > 2 and args[2] is not None:
            kit.refuse("a culture of Number.ToText")
        if c.kind.name not in ("number", "any"):
            raise EvalError("Number.ToText needs a number")
        if form is None:
            return Col(exact(c), TEXT, c.free)
        if not isinstance(form, str) or form[:1] not in "Ff" or not (form[1:].isdigit() or form == form[:1]):
            kit.refuse(f"the number format {form!r}")
        digits = int(form[1:] or 2)
        return Col(F.format_string(f"%.{digits}f", c.c.cast("double")), TEXT, c.free)

    fn("Number.ToText", 1, 3, to_text)
