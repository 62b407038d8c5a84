"""Projection, filters, sorting, limits, sets and metadata of tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from mlode.functions.kit import Kit
from mlode.operators import positional as P
from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import LOGICAL, Col, Enum, Fn, Group, GroupColumn, Rec, Table, as_col, as_rec, quoted


def need_table(v: Any, name: str) -> Table:
    if isinstance(v, Table):
        return v
    raise EvalError(f"{name} needs a table")


def register(kit: Kit) -> None:
    ev, fn = kit.ev, kit.fn

    def table(v: Any, name: str) -> Table:
        if isinstance(v, list) and all(isinstance(x, Rec) for x in v) and v:
            from mlode.sources.literal import from_records

            return from_records(ev, v)
        return need_table(v, name)

    kit.table = table

    def op(name: str, least: int, most: int, call: Any) -> None:
        fn(name, least, most, lambda t, *rest: call(table(t, name), *rest))

    kit.op = op

    def predicate(row: Rec, f: Any, name: str) -> Any:
        test = ev.call(f, row)
        if isinstance(test, bool):
            return F.lit(test)
        if not isinstance(test, Col) or test.kind not in (LOGICAL, V.ANY):
            raise EvalError(f"{name}: the condition must be logical")
        return ev.guard(test)

    kit.predicate = predicate

    # -- filters and projection
    def select_rows(t: Any, f: Any) -> Any:
        if isinstance(t, Group):
            test = predicate(t.row, f, "Table.SelectRows")
            return Group(t.row, test if t.cond is None else t.cond & test, t.order, modes=t.modes)
        if isinstance(t, Col) and t.kind.name == "list":
            kind = t.kind.elem
            return Col(F.filter(t.c, lambda x: predicate(as_rec(Col(x, kind)), f, "Table.SelectRows")), t.kind, t.free)
        t = table(t, "Table.SelectRows")
        return t.keep(t.df.filter(predicate(t.row(), f, "Table.SelectRows")))

    fn("Table.SelectRows", 2, 2, select_rows)

    def select_columns(t: Any, names: Any) -> Any:
        names = ev.names(names)
        if isinstance(t, Group):
            return Group(Rec((n, group_field(t, n)) for n in names), t.cond, t.order, modes=t.modes)
        t = table(t, "Table.SelectColumns")
        t.need(*names)
        return t.select([(n, quoted(n)) for n in names])

    def group_field(g: Group, n: str) -> Any:
        if n not in g.row:
            raise EvalError(f"The column '{n}' of the table wasn't found.")
        return g.row[n]

    fn("Table.SelectColumns", 2, 2, select_columns)

    def remove_columns(t: Table, names: Any) -> Table:
        names = ev.names(names)
        t.need(*names)
        return t.select([(c, quoted(c)) for c in t.cols if c not in names])

    op("Table.RemoveColumns", 2, 2, remove_columns)

    def pairs(v: Any, name: str) -> list[list[Any]]:
        if isinstance(v, list) and v and not isinstance(v[0], list):
            v = [v]
        if not isinstance(v, list) or not all(isinstance(p, list) and len(p) == 2 for p in v):
            raise EvalError(f"{name}: pairs are expected")
        return [[ev.text(p[0], "column name"), p[1]] for p in v]

    kit.pairs = pairs

    def rename(t: Table, changes: Any) -> Table:
        names = {c: c for c in t.cols}
        for old, new in pairs(changes, "Table.RenameColumns"):
            t.need(old)
            names[old] = ev.text(new, "column name")
        return t.select([(names[c], quoted(c)) for c in t.cols])

    op("Table.RenameColumns", 2, 2, rename)

    def reorder(t: Table, order: Any, mode: Any = None) -> Table:
        if mode is not None:
            kit.refuse("the missing-field mode of Table.ReorderColumns")
        order = ev.names(order)
        t.need(*order)
        if len(set(order)) != len(order):
            raise EvalError("Table.ReorderColumns names a column twice")
        return t.select([(c, quoted(c)) for c in [*order, *[c for c in t.cols if c not in order]]])

    op("Table.ReorderColumns", 2, 3, reorder)

    def new_column(t: Table, name: str) -> None:
        if name in t.cols:
            raise EvalError(f"The column '{name}' exists already.")

    def duplicate(t: Table, old: Any, new: Any, kind: Any = None) -> Table:
        if kind is not None:
            kit.refuse("a type of Table.DuplicateColumn")
        old, new = ev.text(old, "column name"), ev.text(new, "column name")
        t.need(old)
        new_column(t, new)
        return t.select([*[(c, quoted(c)) for c in t.cols], (new, quoted(old))])

    op("Table.DuplicateColumn", 3, 4, duplicate)

    def storable(v: Any) -> Col:
        if isinstance(v, Table):
            raise UnsupportedError("a table made for each row; use a join")
        return as_col(v)

    def add_column(t: Any, name: Any, f: Any, kind: Any = None) -> Any:
        name = ev.text(name, "column name")
        if isinstance(t, Group):
            if name in t.row:
                raise EvalError(f"The column '{name}' exists already.")
            made = storable(ev.call(f, t.row))
            return Group(Rec(t.row | {name: made if kind is None else ev.convert(made, kind)}), t.cond, t.order, modes=t.modes)
        t = table(t, "Table.AddColumn")
        new_column(t, name)
        made = storable(ev.call(f, t.row()))
        if kind is not None:
            made = ev.convert(made, kind)
        df = t.df.select(*[quoted(c) for c in t.cols], made.c.alias(name), *[quoted(h) for h in t.hidden()])
        return Table(df, [*t.cols, name], t.order, t.explicit)

    fn("Table.AddColumn", 3, 4, add_column)

    def transform_columns(t: Table, changes: Any) -> Table:
        for name, f in pairs(changes, "Table.TransformColumns"):
            made = storable(ev.call(f, t.col(name)))
            t = t.select([(c, made.c if c == name else quoted(c)) for c in t.cols])
        return t

    op("Table.TransformColumns", 2, 2, transform_columns)

    def column_types(t: Table, changes: Any, culture: Any = None) -> Table:
        if culture is not None:
            kit.refuse("a culture of Table.TransformColumnTypes")
        made = {name: ev.convert(t.col(name), kind).c for name, kind in pairs(changes, "Table.TransformColumnTypes")}
        return t.select([(c, made.get(c, quoted(c))) for c in t.cols])

    op("Table.TransformColumnTypes", 2, 3, column_types)

    def column_names(t: Table, f: Any) -> Table:
        names = [ev.text(ev.call(f, c), "column name") for c in t.cols]
        if len(set(names)) != len(names):
            raise EvalError("Table.TransformColumnNames gives one name twice")
        return t.select(list(zip(names, [quoted(c) for c in t.cols], strict=True)))

    op("Table.TransformColumnNames", 2, 2, column_names)

    def replace_value(t: Table, old: Any, new: Any, replacer: Any, names: Any) -> Table:
        names, row = ev.names(names), t.row()
        made = {}
        for n in names:
            a, b = (ev.call(x, row) if isinstance(x, Fn) else x for x in (old, new))
            made[n] = as_col(ev.call(replacer, t.col(n), a, b)).c
        return t.select([(c, made.get(c, quoted(c))) for c in t.cols])

    op("Table.ReplaceValue", 5, 5, replace_value)

    def replace_text(v: Any, old: Any, new: Any) -> Any:
        if v is None:
            return None
        c, a, b = as_col(v), as_col(old), as_col(new)
        if any(x.kind.name not in ("text", "any") for x in (c, a, b)):
            raise EvalError("Replacer.ReplaceText needs texts")
        return Col(F.replace(c.c, a.c, b.c), V.TEXT, c.free and a.free and b.free)

    def replace_cell(v: Any, old: Any, new: Any) -> Any:
        from mlode.plans.evaluator import choose, equal

        same = equal(v, old)
        return (new if same else v) if isinstance(same, bool) else choose(same.c, new, v)

    fn("Replacer.ReplaceText", 3, 3, replace_text)
    fn("Replacer.ReplaceValue", 3, 3, replace_cell)

    # -- metadata
    def count_rows(t: Any) -> Any:
        if isinstance(t, Group):
            return Col(F.count(F.lit(1)) if t.cond is None else F.count_if(t.cond), V.NUMBER, False, True)
        if isinstance(t, (GroupColumn,)):
            return count_rows(t.group)
        if isinstance(t, Col) and t.kind.name in ("list", "any"):
            return Col(F.size(t.c).cast("long"), V.NUMBER, t.free, True)
        if isinstance(t, list):
            return len(t)
        return table(t, "Table.RowCount").df.count()

    fn("Table.RowCount", 1, 1, count_rows)

    def is_empty(t: Any) -> Any:
        if isinstance(t, (Group, Col)):
            return Col(count_rows(t).c == 0, LOGICAL)
        return table(t, "Table.IsEmpty").df.isEmpty()

    fn("Table.IsEmpty", 1, 1, is_empty)
    op("Table.ColumnCount", 1, 1, lambda t: len(t.cols))
    op("Table.ColumnNames", 1, 1, lambda t: list(t.cols))
    op("Table.HasColumns", 2, 2, lambda t, n: set(ev.names(n)) <= set(t.cols))
    fn("Table.Buffer", 1, 1, lambda t: t)

    def no_errors(t: Table, names: Any = None) -> Table:
        if names is not None:
            t.need(*ev.names(names))
        return t

    op("Table.RemoveRowsWithErrors", 1, 2, no_errors)
    op("Table.SelectRowsWithErrors", 1, 2, lambda t, names=None: t.keep(no_errors(t, names).df.limit(0)))

    def error_values(t: Table, changes: Any) -> Table:
        t.need(*[n for n, _ in pairs(changes, "Table.ReplaceErrorValues")])
        return t

    op("Table.ReplaceErrorValues", 2, 2, error_values)

    # -- order
    def criteria(t: Table, spec: Any) -> list[tuple[str, bool]]:
        if isinstance(spec, str):
            spec = [spec]
        if isinstance(spec, list) and len(spec) == 2 and isinstance(spec[0], str) and isinstance(spec[1], Enum):
            spec = [spec]
        out = []
        if not isinstance(spec, list):
            raise UnsupportedError("a sort by a function")
        for s in spec:
            name, direction = (s[0], s[1] if len(s) > 1 else 0) if isinstance(s, list) else (s, 0)
            if not isinstance(name, (str, Col)):
                raise UnsupportedError("a sort by a function")
            name = ev.text(name, "column name")
            t.need(name)
            d = direction.value if isinstance(direction, Enum) else ev.const(direction)
            if d not in (0, 1):
                raise EvalError("not a sort direction")
            out.append((name, d == 0))
        return out

    kit.criteria = criteria
    kit.enum("Order.Ascending", 0)
    kit.enum("Order.Descending", 1)

    def sort(t: Table, spec: Any) -> Table:
        keys = criteria(t, spec)
        df, order = t.df, []
        for name, up in keys:
            key = name
            if name in t.cols:
                key = P.fresh(Table(df, t.cols), "key")
                df = df.withColumn(key, quoted(name))
            order.append((key, up))
        return Table(df, t.cols, [*order, *[o for o in t.order]], True)

    op("Table.Sort", 2, 2, sort)
    op("Table.ReverseRows", 1, 1, lambda t: (t.need_order(), Table(t.df, t.cols, [(n, not up) for n, up in t.order], True))[1])
    count = lambda n, name: kit.plain(name, "count", n, False)
    op("Table.FirstN", 2, 2, lambda t, n: P.first_n(t, count(n, "Table.FirstN")))
    op("Table.LastN", 2, 2, lambda t, n: P.last_n(t, count(n, "Table.LastN")))

    def skip(t: Table, n: Any = 1) -> Table:
        if isinstance(n, Fn):
            return P.skip_while(t, predicate(t.row(), n, "Table.Skip"))
        k = count(1 if n is None else n, "Table.Skip")
        return P.keep_rows(t, lambda i: i >= k)

    op("Table.Skip", 1, 2, skip)

    def ranged(t: Table, at: Any, n: Any = None) -> Table:
        a, k = count(at, "Table.Range"), None if n is None else count(n, "Table.Range")
        rows = t.df.count()
        if a > rows or (k is not None and a + k > rows):
            raise EvalError("Table.Range reaches past the end")
        return P.keep_rows(t, lambda i: (i >= a) if k is None else (i >= a) & (i < a + k))

    op("Table.Range", 2, 3, ranged)

    def extreme(name: str, largest: bool) -> None:
        def call(t: Any, spec: Any, default: Any = None) -> Any:
            if isinstance(t, Group):
                t0 = Table(ev.ctx.spark.range(0), list(t.row))
                t0.need = lambda *n: [group_field(t, x) for x in n]  # type: ignore[method-assign]
                keys = criteria(t0, spec)
                if len({up for _, up in keys}) > 1 or any(not up for _, up in t.order):
                    kit.refuse(f"{name} of a group by keys in both directions")
                up = keys[0][1]
                by = F.struct(*[as_col(t.row[n]).c.alias(f"k{i}") for i, (n, _) in enumerate(keys)], *[quoted(n).alias(n) for n, _ in t.order] if up == largest else [])
                whole = as_col(t.row)
                pick = F.max_by if largest == up else F.min_by
                cond = t.cond if t.cond is not None else F.lit(True)
                return Col(pick(F.when(cond, whole.c), F.when(cond, by)), whole.kind)
            t = table(t, name)
            s = sort(t, spec)
            rows = (P.last_n if largest else P.first_n)(s, 1).df.collect()
            return P.record_of(t, rows[0]) if rows else default

        fn(name, 2, 3, call)

    extreme("Table.Max", True)
    extreme("Table.Min", False)

    def index_column(t: Table, name: Any, start: Any = 0, step: Any = 1) -> Table:
        name = ev.text(name, "column name")
        new_column(t, name)
        a, d = (default if v is None else ev.const(v) for v, default in ((start, 0), (step, 1)))
        return P.add_index(t, name, a, d)

    op("Table.AddIndexColumn", 2, 4, index_column)

    def fill(name: str, down: bool) -> None:
        def call(t: Table, names: Any) -> Table:
            names = ev.names(names)
            t.need(*names)
            return P.filled(t, names, down)

        op(name, 2, 2, call)

    fill("Table.FillDown", True)
    fill("Table.FillUp", False)

    # -- sets
    def combine(tables: Any, columns: Any = None) -> Table:
        if columns is not None:
            kit.refuse("the columns of Table.Combine")
        if not isinstance(tables, list) or not tables:
            raise EvalError("Table.Combine needs a list of tables")
        ts = [table(x, "Table.Combine") for x in tables]
        cols = list(dict.fromkeys(c for t in ts for c in t.cols))
        place = V.HIDDEN + "table"
        ordered = all(t.order and t.order[0][0] == P.ORDINAL and t.order[0][1] for t in ts)
        parts = [t.df.select(*[quoted(c) for c in t.cols], *([F.lit(k).alias(place), quoted(P.ORDINAL)["f"].alias(place + "f"), quoted(P.ORDINAL)["r"].alias(place + "r")] if ordered else [])) for k, t in enumerate(ts)]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if not ordered:
            return Table(df.select(*[quoted(c) for c in cols]), cols)
        one = F.struct(F.concat_ws("/", F.lpad(F.col(place).cast("string"), 9, "0"), F.col(place + "f")).alias("f"), F.col(place + "r").alias("r"))
        return Table(df.select(*[quoted(c) for c in cols], one.alias(P.ORDINAL)), cols, [(P.ORDINAL, True)])

    fn("Table.Combine", 1, 2, combine)

    def distinct(t: Table, names: Any = None) -> Table:
        keys = t.cols if names is None else ev.names(names)
        t.need(*keys)
        if not t.order:
            if names is None:
                return t.keep(t.df.dropDuplicates())
            raise UnsupportedError("Table.Distinct by columns needs a row order")
        if all(up for _, up in t.order):
            # the first row of each key: a partial aggregate, no window
            first = F.min_by(F.struct(*[quoted(c).alias(c) for c in t.df.columns]), F.struct(*[quoted(n).alias(n) for n, _ in t.order]))
            df = t.df.groupBy(*[quoted(k).alias(f"{V.HIDDEN}k{i}") for i, k in enumerate(keys)]).agg(first.alias(V.HIDDEN + "row"))
            return t.keep(df.select(*[F.col(V.HIDDEN + "row").getField(c).alias(c) for c in t.df.columns]))
        w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*t.order_by())
        n = V.HIDDEN + "n"
        return t.keep(t.df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n))

    op("Table.Distinct", 1, 2, distinct)

    def duplicates(t: Table, names: Any = None) -> Table:
        keys = t.cols if names is None else ev.names(names)
        t.need(*keys)
        n = V.HIDDEN + "n"
        many = t.df.groupBy(*[quoted(k).alias(f"{V.HIDDEN}k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1)
        cond = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"{V.HIDDEN}k{i}")) for i, k in enumerate(keys)])
        return t.keep(t.df.join(many, cond, "left_semi"))

    op("Table.SelectDuplicates", 1, 2, duplicates)

    def repeat(t: Table, n: Any) -> Table:
        k, place = count(n, "Table.Repeat"), V.HIDDEN + "rep"
        if not k:
            return t.keep(t.df.limit(0))
        place = P.fresh(t, "rep")
        return Table(t.df.withColumn(place, F.explode(F.sequence(F.lit(1), F.lit(k)))), t.cols, [(place, True), *t.order])

    op("Table.Repeat", 2, 2, repeat)
