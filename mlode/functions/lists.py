"""List functions: plan-time lists, array columns, and the columns of a group.

A list that is known at plan time is worked on here; an array column by
higher-order functions; a group's column by an aggregate where one exists, else
as the array of its values in row order.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.functions.kit import Kit
from mlode.plans import values as V
from mlode.plans.errors import EvalError
from mlode.plans.evaluator import plain_equal
from mlode.plans.values import ANY, LOGICAL, NUMBER, Col, Distinct, Enum, Fn, Group, GroupColumn, Kind, Rec, Table, TableColumn, as_col


def register(kit: Kit) -> None:
    ev, fn = kit.ev, kit.fn

    def plain(v: Any) -> bool:
        """A Python list without row-dependent items."""
        return isinstance(v, list) and not any(isinstance(x, (Col, GroupColumn)) and not getattr(x, "free", False) for x in v)

    def settled(v: list) -> list:
        return [ev.const(x) if isinstance(x, Col) else x for x in v]

    def source(v: Any, name: str) -> Any:
        """list, Col of an array, GroupColumn or TableColumn."""
        v = ev.as_kind(v, Kind("list"))
        if isinstance(v, (GroupColumn, TableColumn)):
            return v
        if isinstance(v, Table):
            return [r for r in records(v)]
        if isinstance(v, list):
            return settled(v) if plain(v) else as_col(v)
        if isinstance(v, Col) and v.kind.name in ("list", "any"):
            return v
        if v is None:
            raise EvalError(f"{name}: null is not a list")
        raise EvalError(f"{name} needs a list")

    def records(t: Table) -> list[Rec]:
        from mlode.operators.positional import collect_records

        return collect_records(ev, t)

    def array(v: Any) -> Col:
        if isinstance(v, GroupColumn):
            return v.array()
        if isinstance(v, TableColumn):
            return as_col(ev.const(v))
        return as_col(v)

    def elem(c: Col) -> Kind:
        return c.kind.elem or ANY

    def lam(f: Any, kind: Kind, free: bool = False) -> Any:
        """An M function as a Spark lambda."""
        return lambda x: as_col(ev.call(f, Col(x, kind, free))).c

    def result_kind(f: Any, *kinds: Kind) -> Kind:
        """The kind that an M function gives for arguments of these kinds."""
        return as_col(ev.call(f, *[Col(F.lit(None), k) for k in kinds])).kind

    def both(name: str, least: int, most: int, on_list: Any, on_array: Any, on_group: Any = None) -> None:
        def call(v: Any, *rest: Any) -> Any:
            s = source(v, name)
            if isinstance(s, GroupColumn):
                if on_group is not None:
                    made = on_group(s, *rest)
                    if made is not NotImplemented:
                        return made
                return on_array(s.array(), *rest)
            if isinstance(s, TableColumn):
                if on_group is not None:
                    made = on_group(GroupColumn(s.col, Group(s.table.row(), None, s.table.order)), *rest)
                    if isinstance(made, Col):
                        return scalar(s.table, made)
                s = ev.const(s)
            return on_list(s, *rest) if isinstance(s, list) else on_array(s, *rest)

        fn(name, least, most, call)

    def scalar(t: Table, made: Col) -> Any:
        """An aggregate over a whole table: one job, one value."""
        from mlode.plans.evaluator import to_python

        return to_python(t.df.agg(made.c.alias("v")).first()[0], made.kind)

    def numbers(v: list, name: str) -> list:
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
            raise EvalError(f"{name} needs numbers")
        return v

    def guard(g: GroupColumn) -> Column:
        """The value to aggregate; in strict mode a null of the group raises."""
        if not ev.ctx.strict:
            return g.value()
        if ev.ctx.failures is not None:
            kit.refuse("try around an aggregate in strict mode")
        v = F.coalesce(g.col.c, F.raise_error(F.lit("an aggregate met a null")))
        return v if g.group.cond is None else F.when(g.group.cond, v)

    def agg(name: str, how: Any, kind: Any = None, whole: Any = False, need: str | None = "number") -> Any:
        def made(g: GroupColumn, *rest: Any) -> Any:
            if need and g.col.kind.name not in (need, "any", "null"):
                raise EvalError(f"{name} needs {need} values")
            return Col(how(guard(g)), kind or g.col.kind, False, g.col.whole if whole is None else whole)

        return made

    fold = lambda c, start, step: F.aggregate(c, start, step)
    both("List.Count", 1, 1, len, lambda c: Col(c.count() if isinstance(c, Distinct) else F.size(c.c).cast("long"), NUMBER, c.free, True), lambda g: Col(F.count(F.lit(1)) if g.group.cond is None else F.count_if(g.group.cond), NUMBER, False, True))
    both("List.NonNullCount", 1, 1, lambda v: sum(x is not None for x in v), lambda c: Col(F.size(F.filter(c.c, lambda x: x.isNotNull())).cast("long"), NUMBER, c.free, True), lambda g: Col(F.count(g.value()), NUMBER, False, True))
    both("List.IsEmpty", 1, 1, lambda v: not v, lambda c: Col(F.size(c.c) == 0, LOGICAL, c.free), lambda g: Col((F.count(F.lit(1)) if g.group.cond is None else F.count_if(g.group.cond)) == 0, LOGICAL))

    def array_sum(c: Col) -> Col:
        return Col(fold(F.filter(c.c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x.cast("double")), NUMBER, c.free)

    both("List.Sum", 1, 1, lambda v: sum(numbers(v, "List.Sum")), array_sum, agg("List.Sum", lambda v: F.coalesce(F.sum(v), F.lit(0)), NUMBER, None))

    def average(v: list) -> Any:
        return sum(numbers(v, "List.Average")) / len(v) if v else None

    def array_average(c: Col) -> Col:
        some = F.filter(c.c, lambda x: x.isNotNull())
        return Col(F.when(F.size(some) > 0, array_sum(c).c / F.size(some)), NUMBER, c.free)

    both("List.Average", 1, 1, average, array_average, agg("List.Average", F.avg, NUMBER))

    def extreme(name: str, pick: Any, on_array: Any, on_group: Any) -> None:
        def of_list(v: list, default: Any = None) -> Any:
            if not v:
                return default
            if len({V.kind_of_value(x).name for x in v}) > 1:
                raise EvalError(f"{name} of different types")
            return pick(v)

        def of_array(c: Col, default: Any = None) -> Col:
            made = on_array(c.c)
            return Col(made if default is None else F.when(F.size(c.c) == 0, as_col(default).c).otherwise(made), elem(c), c.free)

        def of_group(g: GroupColumn, default: Any = None) -> Any:
            made = on_group(guard(g))
            return Col(made if default is None else F.coalesce(made, as_col(default).c), g.col.kind, False, g.col.whole)

        both(name, 1, 2, of_list, of_array, of_group)

    extreme("List.Max", max, F.array_max, F.max)
    extreme("List.Min", min, F.array_min, F.min)

    def percentile(v: list, p: float) -> float:
        v = sorted(numbers(v, "List.Percentile"))
        at = p * (len(v) - 1)
        lo = int(at)
        hi = min(lo + 1, len(v) - 1)
        return v[lo] + (v[hi] - v[lo]) * (at - lo)

    def array_percentile(c: Column, p: float) -> Column:
        some = F.array_sort(F.filter(c, lambda x: x.isNotNull()))
        at = F.lit(float(p)) * (F.size(some) - 1)
        lo = F.floor(at).cast("int")
        a, b = F.get(some, lo).cast("double"), F.get(some, F.least(lo + 1, F.size(some) - 1)).cast("double")
        return a + (b - a) * (at - lo)

    def counted(g: GroupColumn, shares: list[float] | float | None) -> Column:
        """What Table.Group takes from the counts of the group's values: the mode, a percentile or several."""
        modes = g.group.modes
        made = F.first(F.col(f"{V.HIDDEN}mode{len(modes)}"))
        modes.append((g.col.c, g.group.cond, made, shares))
        return made

    def group_shares(g: GroupColumn, name: str, shares: list[float], listed: bool) -> Col:
        if g.col.kind.name not in ("number", "any", "null"):
            raise EvalError(f"{name} needs number values")
        if g.group.modes is None or ev.ctx.strict:
            got = [F.percentile(guard(g), F.lit(x)) for x in shares]
            return Col(F.array(*got), Kind("list", NUMBER)) if listed else Col(got[0], NUMBER)
        return Col(counted(g, shares if listed else shares[0]), Kind("list", NUMBER) if listed else NUMBER)

    both("List.Median", 1, 1, lambda v: percentile(v, 0.5) if v else None, lambda c: Col(F.when(F.size(c.c) > 0, array_percentile(c.c, 0.5)), NUMBER, c.free), lambda g: group_shares(g, "List.Median", [0.5], False))

    def shares(p: Any) -> tuple[list[float], bool]:
        p = ev.const(p, "percentile")
        many = p if isinstance(p, list) else [p]
        if not many or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1 for x in many):
            raise EvalError("List.Percentile: shares from 0 to 1 are needed")
        return [float(x) for x in many], isinstance(p, list)

    def options(rest: tuple) -> None:
        if rest and rest[0] is not None:
            kit.refuse("options of List.Percentile")

    def percentile_list(v: list, p: Any, *rest: Any) -> Any:
        options(rest)
        many, listed = shares(p)
        if not v:
            raise EvalError("List.Percentile of an empty list")
        made = [percentile(v, x) for x in many]
        return made if listed else made[0]

    def percentile_array(c: Col, p: Any, *rest: Any) -> Col:
        options(rest)
        many, listed = shares(p)
        made = [array_percentile(c.c, x) for x in many]
        return Col(F.array(*made), Kind("list", NUMBER), c.free) if listed else Col(made[0], NUMBER, c.free)

    def percentile_group(g: GroupColumn, p: Any, *rest: Any) -> Col:
        options(rest)
        return group_shares(g, "List.Percentile", *shares(p))

    both("List.Percentile", 2, 3, percentile_list, percentile_array, percentile_group)

    def deviation(v: list) -> float:
        if len(numbers(v, "List.StandardDeviation")) < 2:
            raise EvalError("List.StandardDeviation needs two values")
        mean = sum(v) / len(v)
        return (sum((x - mean) ** 2 for x in v) / (len(v) - 1)) ** 0.5

    def array_deviation(c: Col) -> Col:
        mean, n = array_average(c).c, F.size(F.filter(c.c, lambda x: x.isNotNull()))
        squares = F.aggregate(F.filter(c.c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return Col(F.when(n > 1, F.sqrt(squares / (n - 1))), NUMBER, c.free)

    both("List.StandardDeviation", 1, 1, deviation, array_deviation, agg("List.StandardDeviation", F.stddev_samp, NUMBER))

    def mode(v: list, criteria: Any = None) -> Any:
        if criteria is not None:
            kit.refuse("a comparer of List.Mode")
        if not v:
            raise EvalError("List.Mode of an empty list")
        count = Counter(v)
        first = {x: k for k, x in reversed(list(enumerate(v)))}
        return max(count, key=lambda x: (count[x], first[x]))

    def array_mode(c: Col, criteria: Any = None) -> Col:
        if criteria is not None:
            kit.refuse("a comparer of List.Mode")
        # the most frequent; of equally frequent ones the one whose first occurrence is latest
        rated = F.transform(F.array_distinct(c.c), lambda x: F.struct(F.size(F.filter(c.c, lambda y: y.eqNullSafe(x))).alias("n"), F.array_position(F.transform(c.c, lambda y: y.eqNullSafe(x)), True).alias("at"), x.alias("v")))
        return Col(F.array_max(F.transform(rated, lambda r: F.struct(r["n"].alias("n"), r["at"].alias("at"), r["v"].alias("v"))))["v"], elem(c), c.free)

    def group_mode(g: GroupColumn, criteria: Any = None) -> Any:
        modes = g.group.modes
        if criteria is not None or modes is None or not all(up for _, up in g.group.order):
            return NotImplemented
        return Col(counted(g, None), g.col.kind)

    both("List.Mode", 1, 2, mode, array_mode, group_mode)

    def truth(name: str, of_list: Any, on_array: Any, on_group: Any, empty: bool) -> None:
        def listed(v: list) -> bool:
            if any(not isinstance(x, bool) for x in v):
                raise EvalError(f"{name} needs logical values")
            return of_list(v)

        both(name, 1, 1, listed, lambda c: Col(on_array(c.c, lambda x: x), LOGICAL, c.free), agg(name, lambda v: F.coalesce(on_group(v), F.lit(empty)), LOGICAL, need="logical"))

    truth("List.AllTrue", all, F.forall, F.bool_and, True)
    truth("List.AnyTrue", any, F.exists, F.bool_or, False)

    # -- mapping and selection
    def need_logical(v: Any, name: str) -> bool:
        if not isinstance(v, bool):
            raise EvalError(f"{name}: the condition must be logical")
        return v

    def transform_group(g: GroupColumn, f: Any) -> GroupColumn:
        return GroupColumn(as_col(ev.call(f, g.col)), g.group)

    both("List.Transform", 2, 2, lambda v, f: [ev.call(f, x) for x in v], lambda c, f: Col(F.transform(c.c, lam(f, elem(c))), Kind("list", result_kind(f, elem(c))), c.free), transform_group)

    def select_group(g: GroupColumn, f: Any) -> GroupColumn:
        test = as_col(ev.call(f, g.col)).c
        cond = test if g.group.cond is None else g.group.cond & test
        return GroupColumn(g.col, Group(g.group.row, cond, g.group.order, modes=g.group.modes))

    def holds(f: Any, x: Any, name: str) -> bool:
        v = ev.call(f, x)
        return need_logical(ev.const(v) if isinstance(v, Col) else v, name)

    both("List.Select", 2, 2, lambda v, f: [x for x in v if holds(f, x, "List.Select")], lambda c, f: Col(F.filter(c.c, lam(f, elem(c))), c.kind, c.free), select_group)

    def accumulate_list(v: list, seed: Any, f: Any) -> Any:
        ev.ctx.tick(len(v))
        for x in v:
            seed = ev.call(f, seed, x)
        return seed

    def accumulate_array(c: Col, seed: Any, f: Any) -> Col:
        s = as_col(seed)
        kind = result_kind(f, s.kind, elem(c))
        start = s.c.cast("double") if kind == NUMBER else s.c
        step = lambda a, x: as_col(ev.call(f, Col(a, kind), Col(x, elem(c)))).c.cast("double") if kind == NUMBER else as_col(ev.call(f, Col(a, kind), Col(x, elem(c)))).c
        return Col(F.aggregate(c.c, start, step), kind, c.free and s.free)

    both("List.Accumulate", 3, 3, accumulate_list, accumulate_array)

    def generate(initial: Any, condition: Any, advance: Any, selector: Any = None) -> list:
        out, state = [], ev.call(initial)
        while holds(condition, state, "List.Generate"):
            ev.ctx.tick()
            out.append(ev.call(selector, state) if selector is not None else state)
            state = ev.call(advance, state)
        return out

    fn("List.Generate", 3, 4, generate)

    def end(name: str, k: int, by: Any) -> None:
        def of_group(g: GroupColumn, default: Any = None) -> Any:
            if not g.group.order or any(not up for _, up in g.group.order) or default is not None or g.group.cond is not None:
                return NotImplemented
            return Col(by(g.col.c, F.struct(*[V.quoted(n) for n, _ in g.group.order])), g.col.kind, False, g.col.whole)

        def of_array(c: Col, default: Any = None) -> Col:
            made = F.try_element_at(c.c, F.lit(1 if k == 0 else -1))
            return Col(made if default is None else F.when(F.size(c.c) == 0, as_col(default).c).otherwise(made), elem(c), c.free)

        both(name, 1, 2, lambda v, default=None: v[k] if v else default, of_array, of_group)

    end("List.First", 0, F.min_by)
    end("List.Last", -1, F.max_by)

    def count_of(n: Any, name: str) -> int:
        return kit.plain(name, "count", n, False)

    def first_false(c: Col, f: Any, a: Column) -> Column:
        """How many leading elements satisfy f."""
        bad = F.array_position(F.transform(a, lambda x: F.coalesce(as_col(ev.call(f, Col(x, elem(c)))).c, F.lit(False))), False)
        return F.when(bad == 0, F.size(a)).otherwise(bad - 1).cast("int")

    def while_list(v: list, f: Any, name: str) -> int:
        k = 0
        while k < len(v) and holds(f, v[k], name):
            k += 1
        return k

    def cut(name: str, least: int, on_list: Any, on_array: Any, default: Any = None) -> None:
        def size_list(v: list, n: Any) -> int:
            if isinstance(n, Fn):
                return while_list(v if name != "List.LastN" else v[::-1], n, name)
            return min(count_of(n, name), len(v))

        def size_array(c: Col, n: Any) -> Column:
            if isinstance(n, Fn):
                return first_false(c, n, c.c if name != "List.LastN" else F.reverse(c.c))
            if isinstance(n, Col) and not n.free:
                return F.least(n.c.cast("int"), F.size(c.c))
            return F.least(F.lit(count_of(n, name)), F.size(c.c))

        def amount(rest: tuple) -> Any:
            n = rest[0] if rest else default
            if n is None:
                raise EvalError(f"{name}: a count is needed")
            return n

        both(name, least, 2, lambda v, *r: on_list(v, size_list(v, amount(r))), lambda c, *r: Col(on_array(c.c, size_array(c, amount(r))), c.kind, c.free))

    cut("List.FirstN", 2, lambda v, n: v[:n], lambda a, n: F.slice(a, F.lit(1), n))
    cut("List.LastN", 1, lambda v, n: v[len(v) - n :], lambda a, n: F.slice(a, F.size(a) - n + 1, n))
    cut("List.Skip", 1, lambda v, n: v[n:], lambda a, n: F.slice(a, n + 1, F.size(a)), 1)

    def ranged(v: list, at: Any, count: Any = None) -> list:
        a = count_of(at, "List.Range")
        return v[a:] if count is None else v[a : a + count_of(count, "List.Range")]

    def range_array(c: Col, at: Any, count: Any = None) -> Col:
        a = count_of(at, "List.Range")
        return Col(F.slice(c.c, F.lit(a + 1), F.size(c.c) if count is None else F.lit(count_of(count, "List.Range"))), c.kind, c.free)

    both("List.Range", 2, 3, ranged, range_array)
    both("List.Reverse", 1, 1, lambda v: v[::-1], lambda c: Col(F.reverse(c.c), c.kind, c.free))

    def sort(v: list) -> list:
        if len({V.kind_of_value(x).name for x in v}) > 1:
            raise EvalError("List.Sort of different types")
        return sorted(v)

    both("List.Sort", 1, 1, sort, lambda c: Col(F.array_sort(c.c), c.kind, c.free))

    def distinct(v: list) -> list:
        out: list = []
        for x in v:
            if not any(plain_equal(x, y) for y in out):
                out.append(x)
        return out

    def distinct_of_table(s: TableColumn) -> list:
        """Only distinct values reach the driver, and cost a step each; those of kinds without an order or of their own equality are compared there."""
        from mlode.operators.positional import distinct_values

        if s.col.kind.name not in ("number", "text", "logical", "date", "datetime", "datetimezone", "duration", "time"):
            return distinct(ev.const(s))
        return ev.const(TableColumn(distinct_values(s.table, s.name), s.name))

    def list_distinct(v: Any) -> Any:
        s = source(v, "List.Distinct")
        if isinstance(s, GroupColumn):
            return Distinct(s)
        if isinstance(s, TableColumn):
            return distinct_of_table(s)
        return distinct(s) if isinstance(s, list) else Col(F.array_distinct(s.c), s.kind, s.free)

    fn("List.Distinct", 1, 1, list_distinct)

    # -- membership
    def criteria(rest: tuple, name: str) -> None:
        if rest and rest[0] is not None:
            kit.refuse(f"a comparer of {name}")

    def has(c: Column, x: Column) -> Column:
        return F.exists(c, lambda y: y.eqNullSafe(x))

    def contains(v: Any, x: Any) -> Any:
        s = source(v, "List.Contains")
        if isinstance(s, (list, TableColumn)):
            s = ev.const(s)
            if not isinstance(x, Col):
                return any(plain_equal(x, y) for y in s)
            some = [y for y in s if y is not None and V.kind_of_value(y).name == x.kind.name]
            # IN over literals reaches the scan
            made = F.coalesce(x.c.isin(some), F.lit(False)) if some else F.lit(False)
            return Col(made | x.c.isNull() if None in s else made, LOGICAL, x.free)
        if isinstance(s, GroupColumn):
            got = as_col(x)
            return Col(F.coalesce(F.max(F.when(F.lit(True) if s.group.cond is None else s.group.cond, s.col.c.eqNullSafe(got.c))), F.lit(False)), LOGICAL)
        got = as_col(x)
        return Col(has(s.c, got.c), LOGICAL, s.free and got.free)

    fn("List.Contains", 2, 2, contains)

    def any_all(name: str, of_list: Any, how: Any) -> None:
        def call(v: Any, values: Any, *rest: Any) -> Any:
            criteria(rest, name)
            a, b = source(v, name), source(values, name)
            if isinstance(a, list) and isinstance(b, list):
                return of_list(any(plain_equal(x, y) for y in a) for x in b)
            x, y = array(a), array(b)
            return Col(how(y.c, lambda e: has(x.c, e)), LOGICAL, x.free and y.free)

        fn(name, 2, 3, call)

    any_all("List.ContainsAny", any, F.exists)
    any_all("List.ContainsAll", all, F.forall)

    def many(name: str, on_lists: Any, on_arrays: Any) -> None:
        def call(v: Any, *rest: Any) -> Any:
            criteria(rest, name)
            if isinstance(v, Col):
                if not (v.kind.elem and v.kind.elem.name == "list"):
                    raise EvalError(f"{name} needs a list of lists")
                parts: Any = v
            else:
                parts = [source(x, name) for x in v]
                if all(isinstance(x, (list, TableColumn)) for x in parts):
                    return on_lists([ev.const(x) for x in parts])
                parts = [array(x) for x in parts]
                kind = next((p.kind for p in parts if p.kind.elem and p.kind.elem.name != "null"), parts[0].kind)
                return Col(on_arrays([p.c for p in parts]), kind, all(p.free for p in parts))
            if name != "List.Combine" and name != "List.Union":
                kit.refuse(f"{name} over a column of lists of lists")
            made = F.flatten(parts.c)
            return Col(made if name == "List.Combine" else F.array_distinct(made), parts.kind.elem, parts.free)

        fn(name, 1, 2, call)

    def folded(two: Any) -> Any:
        def made(parts: list[Column]) -> Column:
            out = F.array_distinct(parts[0])
            for p in parts[1:]:
                out = two(out, p)
            return out

        return made

    many("List.Combine", lambda ls: [x for v in ls for x in v], lambda ps: F.concat(*ps))
    many("List.Union", lambda ls: distinct([x for v in ls for x in v]), lambda ps: F.array_distinct(F.concat(*ps)))
    many("List.Intersect", lambda ls: [x for x in distinct(ls[0]) if all(any(plain_equal(x, y) for y in v) for v in ls[1:])] if ls else [], folded(F.array_intersect))

    def difference(name: str, most: int) -> None:
        def call(v: Any, w: Any, *rest: Any) -> Any:
            criteria(rest, name)
            a, b = source(v, name), source(w, name)
            if isinstance(a, list) and isinstance(b, list):
                return [x for x in a if not any(plain_equal(x, y) for y in b)]
            x, y = array(a), array(b)
            return Col(F.filter(x.c, lambda e: ~has(y.c, e)), x.kind, x.free and y.free)

        fn(name, 2, most, call)

    difference("List.Difference", 3)
    difference("List.RemoveItems", 2)

    def no_nulls(g: GroupColumn) -> GroupColumn:
        cond = g.col.c.isNotNull() if g.group.cond is None else g.group.cond & g.col.c.isNotNull()
        return GroupColumn(g.col, Group(g.group.row, cond, g.group.order, modes=g.group.modes))

    both("List.RemoveNulls", 1, 1, lambda v: [x for x in v if x is not None], lambda c: Col(F.array_compact(c.c), c.kind, c.free), no_nulls)

    def zipped(v: Any) -> Any:
        parts = [source(x, "List.Zip") for x in v]
        if all(isinstance(x, (list, TableColumn)) for x in parts):
            parts = [ev.const(x) for x in parts]
            size = max(map(len, parts), default=0)
            return [[x[k] if k < len(x) else None for x in parts] for k in range(size)]
        cols = [array(x) for x in parts]
        kinds = {elem(c) for c in cols}
        if len(kinds) > 1:
            kit.refuse("List.Zip of arrays of different types")
        names = [f"x{k}" for k in range(len(cols))]
        z = F.arrays_zip(*[c.c.alias(n) for c, n in zip(cols, names, strict=True)])
        return Col(F.transform(z, lambda r: F.array(*[r[n] for n in names])), Kind("list", Kind("list", kinds.pop())), all(c.free for c in cols))

    fn("List.Zip", 1, 1, zipped)

    def upto(n: Column) -> Column:
        """0..n-1."""
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    both("List.Positions", 1, 1, lambda v: list(range(len(v))), lambda c: Col(upto(F.size(c.c)).cast("array<bigint>"), Kind("list", NUMBER), c.free))

    def occurrence(rest: tuple) -> int:
        criteria(rest[1:], "List.PositionOf")
        v = ev.const(rest[0], "occurrence") if rest else None
        n = v.value if isinstance(v, Enum) else 0 if v is None else v
        if n not in (0, 1, 2):
            raise EvalError("List.PositionOf: not an occurrence")
        return n

    def position_list(v: list, x: Any, *rest: Any) -> Any:
        if isinstance(x, Col):
            return position_array(as_col(v), x, *rest)
        n, at = occurrence(rest), [k for k, y in enumerate(v) if plain_equal(x, y)]
        return at if n == 2 else (at[0 if n == 0 else -1] if at else -1)

    def position_array(c: Col, x: Any, *rest: Any) -> Col:
        n, got = occurrence(rest), as_col(x)
        flags = F.transform(c.c, lambda y: y.eqNullSafe(got.c))
        if n == 0:
            return Col((F.array_position(flags, True) - 1).cast("long"), NUMBER, c.free and got.free, True)
        if n == 1:
            at = F.array_position(F.reverse(flags), True)
            return Col(F.when(at == 0, -1).otherwise(F.size(c.c) - at).cast("long"), NUMBER, c.free and got.free, True)
        at = F.filter(upto(F.size(c.c)), lambda i: F.get(flags, i))
        return Col(at.cast("array<bigint>"), Kind("list", NUMBER), c.free and got.free)

    both("List.PositionOf", 2, 4, position_list, position_array)

    def list_numbers(start: Any, count: Any, step: Any = 1) -> Any:
        if isinstance(start, Col) or isinstance(count, Col) or isinstance(step, Col):
            s, n, d = as_col(start), as_col(count), as_col(1 if step is None else step)
            return Col(F.transform(upto(n.c.cast("int")), lambda i: s.c + i * d.c), Kind("list", NUMBER), s.free and n.free and d.free)
        n = count_of(count, "List.Numbers")
        ev.ctx.tick(n)
        return [start + k * (1 if step is None else step) for k in range(n)]

    fn("List.Numbers", 2, 3, list_numbers)

    def repeat(v: list, n: Any) -> list:
        n = count_of(n, "List.Repeat")
        ev.ctx.tick(n * len(v))
        return v * n

    both("List.Repeat", 2, 2, repeat, lambda c, n: Col(F.flatten(F.array_repeat(c.c, count_of(n, "List.Repeat"))), c.kind, c.free))

    def page(n: Any) -> int:
        n = count_of(n, "List.Split")
        if not n:
            raise EvalError("List.Split: a page size from 1 is needed")
        return n

    def split_array(c: Col, n: Any) -> Col:
        k = page(n)
        return Col(F.transform(upto(F.ceil(F.size(c.c) / k).cast("int")), lambda i: F.slice(c.c, i * k + 1, F.lit(k))), Kind("list", c.kind), c.free)

    both("List.Split", 2, 2, lambda v, n: [v[k : k + page(n)] for k in range(0, len(v), page(n))], split_array)

    def insert_list(v: list, at: Any, values: Any) -> list:
        k = count_of(at, "List.InsertRange")
        if k > len(v):
            raise EvalError("List.InsertRange: the index is out of range")
        return v[:k] + source(values, "List.InsertRange") + v[k:]

    def insert_array(c: Col, at: Any, values: Any) -> Col:
        k, w = count_of(at, "List.InsertRange"), array(source(values, "List.InsertRange"))
        made = F.concat(F.slice(c.c, 1, k), w.c, F.slice(c.c, F.lit(k + 1), F.size(c.c)))
        if ev.ctx.failures is not None:
            ev.ctx.failures.append(F.size(c.c) < k)
            return Col(F.when(F.size(c.c) >= k, made), c.kind, c.free)
        return Col(F.when(F.size(c.c) >= k, made).otherwise(F.raise_error(F.lit("List.InsertRange: the index is out of range"))), c.kind, c.free)

    both("List.InsertRange", 3, 3, insert_list, insert_array)
    both("List.ReplaceValue", 4, 4, lambda v, old, new, f: [ev.call(f, x, old, new) for x in v], lambda c, old, new, f: Col(F.transform(c.c, lambda x: as_col(ev.call(f, Col(x, elem(c)), old, new)).c), c.kind, c.free))
    fn("List.Buffer", 1, 1, lambda v: v)

