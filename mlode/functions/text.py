"""Text functions. Offsets are 0-based in M, 1-based in Spark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.functions.kit import Kit, exact
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import LOGICAL, NUMBER, TEXT, Col, Enum, GroupColumn, Kind, as_col

#: fixed values: what counts as white space in a trim
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　" + "".join(chr(c) for c in range(0x2000, 0x200B))


def _class(chars: str) -> str:
    return "[" + "".join("\\x{%X}" % ord(c) for c in chars) + "]"


def _literal(text: str) -> str:
    return "".join("\\x{%X}" % ord(c) for c in text)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def register(kit: Kit) -> None:
    ev, add, fn = kit.ev, kit.add, kit.fn

    def charset(v: Any, name: str) -> str:
        """A set of single characters, from a text or a list of texts."""
        v = ev.const(v, f"characters of {name}")
        parts = [v] if isinstance(v, str) else v
        if not isinstance(parts, list) or not all(isinstance(x, str) for x in parts):
            raise EvalError(f"{name}: characters must be a text or a list of texts")
        if isinstance(v, list) and any(len(x) != 1 for x in parts):
            raise EvalError(f"{name}: a list must hold single characters")
        return "".join(parts)

    def text_from(*args: Any) -> Any:
        v = args[0]
        if v is None:
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "json":
            return ev.json_convert(c, text_from, TEXT, "string")
        if k == "logical":
            return Col(F.when(c.c, "TRUE").when(~c.c, "FALSE"), TEXT, c.free)
        if k == "number":
            return Col(exact(c), TEXT, c.free)
        if k in ("text", "any"):
            return Col(c.c, TEXT, c.free)
        if k == "null":
            return None
        raise EvalError(f"Text.From can't convert a {k}")

    fn("Text.From", 1, 1, text_from)
    add("Text.Upper", "text!", TEXT, F.upper)
    add("Text.Lower", "text!", TEXT, F.lower)
    add("Text.Length", "text!", NUMBER, lambda c: F.length(c).cast("long"), True)
    add("Text.Reverse", "text", TEXT, F.reverse)
    add("Text.Clean", "text", TEXT, lambda c: F.regexp_replace(c, "[\\x00-\\x1F]", ""))
    add("Text.ToList", "text", Kind("list", TEXT), lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "")))
    add("Text.NewGuid", "", TEXT, lambda: F.upper(F.uuid()))

    def proper(c: Column, culture: Any) -> Column:
        if culture is not None:
            kit.refuse("a culture of Text.Proper")
        start = F.struct(F.lit("").alias("out"), F.lit(False).alias("within"))
        letter = lambda x: x.rlike("\\p{L}")
        step = lambda s, x: F.struct(F.concat(s["out"], F.when(s["within"], F.lower(x)).otherwise(F.upper(x))).alias("out"), letter(x).alias("within"))
        return F.aggregate(F.split(c, ""), start, step, lambda s: s["out"])

    add("Text.Proper", "text,#any?", TEXT, proper)

    def trimmed(name: str, signature: str, how: Any) -> None:
        def made(c: Column, chars: Any) -> Column:
            return how(c, F.lit(SPACES if chars is None else charset(chars, name)))

        add(name, signature, TEXT, made)

    trimmed("Text.Trim", "text!,#any?", F.trim)
    trimmed("Text.TrimStart", "text,#any?", F.ltrim)
    trimmed("Text.TrimEnd", "text,#any?", F.rtrim)
    add("Text.Start", "text!,#count", TEXT, lambda c, n: F.substring(c, 1, n))
    add("Text.End", "text!,#count", TEXT, lambda c, n: F.right(c, F.lit(n)))

    def middle(c: Column, start: int, count: int | None) -> Column:
        if start < 0:
            raise EvalError("Text.Middle: a negative start")
        return F.substring(c, F.lit(start + 1), F.length(c) if count is None else F.lit(count))

    add("Text.Middle", "text,#count,#count?", TEXT, middle)
    add("Text.At", "text,#count", TEXT, lambda c, i: F.when(F.length(c) > i, F.substring(c, i + 1, 1)))

    def insert(c: Column, at: int, new: str) -> Column:
        return kit.fail(F.length(c) >= at, F.concat(F.substring(c, 1, at), F.lit(new), F.substring(c, F.lit(at + 1), F.length(c))), "Text.Insert: the offset is out of range", "string")

    add("Text.Insert", "text,#count,#text", TEXT, insert)

    def combine(*args: Any) -> Any:
        items, sep = args[0], ev.text(args[1], "separator") if len(args) > 1 and args[1] is not None else ""
        if isinstance(items, list):
            if any(x is None for x in items):
                raise EvalError("Text.Combine: null is not a text")
            cols = [as_col(x) for x in items]
            if any(c.kind.name not in ("text", "any") for c in cols):
                raise EvalError("Text.Combine needs texts")
            if all(isinstance(x, str) for x in items):
                return sep.join(items)
            parts = [p for c in cols for p in (F.lit(sep), c.c)][1:]
            return Col(F.concat(*parts), TEXT, all(c.free for c in cols))
        if hasattr(items, "table"):
            return sep.join(ev.const(items))
        c = items.array() if isinstance(items, GroupColumn) else as_col(items)
        joined = F.array_join(c.c, sep)
        if ev.ctx.strict:
            joined = kit.fail(F.forall(c.c, lambda x: x.isNotNull()), joined, "Text.Combine: null is not a text", "string")
        return Col(joined, TEXT, c.free)

    fn("Text.Combine", 1, 2, combine)
    add("Text.Contains", "text!,text!", LOGICAL, lambda c, s: c.contains(s))

    def starts(name: str, how: Any) -> None:
        def made(c: Column, s: Column, comparer: Any) -> Column:
            if comparer is not None:
                kit.refuse(f"a comparer of {name}")
            return how(c, s)

        add(name, "text,text!,#any?", LOGICAL, made)

    starts("Text.StartsWith", lambda c, s: c.startswith(s))
    starts("Text.EndsWith", lambda c, s: c.endswith(s))

    def places(c: Column, s: str) -> Column:
        """0-based starts of s in c, from the left, not overlapping."""
        pieces = F.split(c, _literal(s), -1)
        step = lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, -1), F.lit(0)) + F.length(x) + F.when(F.size(a) > 1, len(s)).otherwise(0)))
        ends = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1))), F.array(F.lit(0)), step)
        return F.when(F.size(pieces) > 1, F.transform(F.slice(ends, 2, F.size(pieces) - 1), lambda x: x.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def occurrence(v: Any, name: str) -> int:
        v = ev.const(v, f"occurrence of {name}")
        n = v.value if isinstance(v, Enum) else 0 if v is None else v
        if n not in (0, 1, 2):
            raise EvalError(f"{name}: not an occurrence")
        return n

    def position(*args: Any) -> Any:
        if len(args) > 3 and args[3] is not None:
            kit.refuse("a comparer of Text.PositionOf")
        if args[0] is None:
            return None
        c, s, n = as_col(args[0]), ev.text(args[1], "text to find"), occurrence(args[2] if len(args) > 2 else None, "Text.PositionOf")
        if n == 2:
            if not s:
                kit.refuse("all places of an empty text")
            return Col(places(c.c, s), Kind("list", NUMBER), c.free)
        if n == 0:
            return Col((F.locate(s, c.c) - 1).cast("long"), NUMBER, c.free, True)
        last = F.locate(s[::-1], F.reverse(c.c))
        return Col(F.when(last == 0, -1).otherwise(F.length(c.c) - last + 1 - len(s)).cast("long"), NUMBER, c.free, True)

    fn("Text.PositionOf", 2, 4, position)

    def position_any(*args: Any) -> Any:
        if args[0] is None:
            return None
        c, chars, n = as_col(args[0]), charset(args[1], "Text.PositionOfAny"), occurrence(args[2] if len(args) > 2 else None, "Text.PositionOfAny")
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.length(c.c) - 1, F.lit(0))), lambda i: F.substring(c.c, i + 1, F.lit(1)).isin(list(chars)))
        at = F.transform(at, lambda i: i.cast("long"))
        if n == 2:
            return Col(at, Kind("list", NUMBER), c.free)
        return Col(F.when(c.c.isNotNull(), F.coalesce(F.try_element_at(at, F.lit(1 if n == 0 else -1)), F.lit(-1).cast("long"))), NUMBER, c.free, True)

    fn("Text.PositionOfAny", 2, 3, position_any)
    add("Text.Replace", "text!,text!,text!", TEXT, lambda c, old, new: F.replace(c, old, new))

    def split(c: Column, sep: str) -> Column:
        if not sep:
            raise EvalError("Text.Split: an empty separator")
        return F.split(c, _literal(sep), -1)

    add("Text.Split", "text!,#text", Kind("list", TEXT), split)
    add("Text.SplitAny", "text,#text", Kind("list", TEXT), lambda c, seps: F.split(c, _class(seps), -1) if seps else F.array(c))

    def index(v: Any, name: str) -> int:
        v = ev.const(v, f"index of {name}")
        if isinstance(v, list):
            raise UnsupportedError(f"{name}: an index with a direction")
        return 0 if v is None else kit.plain(name, "count", v, False)

    def before(c: Column, d: str, n: int) -> Column:
        return F.substring_index(c, d, n + 1)

    def after(c: Column, d: str, n: int) -> Column:
        found = F.size(F.split(c, _literal(d), -1)) > n + 1
        return F.when(found, F.substring(c, F.length(before(c, d, n)) + len(d) + 1, F.length(c))).when(c.isNotNull(), "")

    def nonempty(d: str, name: str) -> str:
        if not d:
            raise EvalError(f"{name}: an empty delimiter")
        return d

    add("Text.BeforeDelimiter", "text,#text,#any?", TEXT, lambda c, d, n: before(c, nonempty(d, "Text.BeforeDelimiter"), index(n, "Text.BeforeDelimiter")))
    add("Text.AfterDelimiter", "text,#text,#any?", TEXT, lambda c, d, n: after(c, nonempty(d, "Text.AfterDelimiter"), index(n, "Text.AfterDelimiter")))

    def between(c: Column, s: str, e: str, i: Any, j: Any) -> Column:
        n, m = index(i, "Text.BetweenDelimiters"), index(j, "Text.BetweenDelimiters")
        rest = after(c, nonempty(s, "Text.BetweenDelimiters"), n)
        found = (F.size(F.split(c, _literal(s), -1)) > n + 1) & (F.size(F.split(rest, _literal(nonempty(e, "Text.BetweenDelimiters")), -1)) > m + 1)
        return F.when(found, before(rest, e, m)).when(c.isNotNull(), "")

    add("Text.BetweenDelimiters", "text,#text,#text,#any?,#any?", TEXT, between)

    def select(c: Column, chars: Any) -> Column:
        chars = charset(chars, "Text.Select")
        return F.regexp_replace(c, "[^" + _class(chars)[1:], "") if chars else F.when(c.isNotNull(), "")

    def remove(c: Column, chars: Any) -> Column:
        chars = charset(chars, "Text.Remove")
        return F.regexp_replace(c, _class(chars), "") if chars else c

    add("Text.Select", "text,#any", TEXT, select)
    add("Text.Remove", "text,#any", TEXT, remove)

    def repeat(c: Column, n: int) -> Column:
        ev.ctx.tick(n)
        return F.repeat(c, n)

    add("Text.Repeat", "text,#count", TEXT, repeat)

    def padded(name: str, how: Any) -> None:
        def made(c: Column, n: int, ch: str | None) -> Column:
            ch = " " if ch is None else ch
            if len(ch) != 1:
                raise EvalError(f"{name}: one character is expected")
            return F.when(F.length(c) < n, how(c, n, ch)).otherwise(c)

        add(name, "text,#count,#text?", TEXT, made)

    padded("Text.PadStart", F.lpad)
    padded("Text.PadEnd", F.rpad)
    for k, name in enumerate(("First", "Last", "All")):
        kit.enum(f"Occurrence.{name}", k)
    for k, name in enumerate(("FromStart", "FromEnd")):
        kit.enum(f"RelativePosition.{name}", k)
