"""Pivot, unpivot, transpose, splitting, headers, and tables from and to other values."""

from __future__ import annotations

from itertools import zip_longest
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.functions.kit import Kit
from mlode.operators import positional as P
from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import TEXT, Col, Enum, Fn, Group, GroupColumn, Kind, Rec, Table, TableColumn, as_col, quoted
from mlode.sources.literal import column_names, from_records, from_rows

#: Rows that become columns: a transposed table is built on the driver and has so many columns at most.
MOST_COLUMNS = 4096


def regex(text: str) -> str:
    return "".join("\\x{%X}" % ord(c) for c in text)


class Splitter(Fn):
    """A function of a text that gives a list of texts; as a column expression where it is one."""


def register(kit: Kit) -> None:
    ev, fn, op, table = kit.ev, kit.fn, kit.op, kit.table
    for name in ("QuoteStyle.Csv", "QuoteStyle.None", "ExtraValues.List", "ExtraValues.Error", "ExtraValues.Ignore"):
        kit.enum(name)

    # -- pivot and unpivot
    def melt(t: Table, names: list[str], attribute: Any, value: Any) -> Table:
        attribute, value = ev.text(attribute, "column name"), ev.text(value, "column name")
        rest = [c for c in t.cols if c not in names]
        if attribute in rest or value in rest or attribute == value:
            raise EvalError("the new columns need names of their own")
        if not names:
            raise EvalError("no columns to unpivot")
        kinds = {t.kinds[n].name for n in names}
        if len(kinds) > 1:
            raise UnsupportedError(f"unpivoting columns of {', '.join(sorted(kinds))}")
        place = P.fresh(t, "col")
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("a"), quoted(n).alias("v")) for k, n in enumerate(names)])
        item = V.HIDDEN + "item"
        df = t.df.select(*[quoted(c) for c in rest], *[quoted(h) for h in t.hidden()], F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias(item))
        out = df.select(*[quoted(c) for c in rest], F.col(item)["a"].alias(attribute), F.col(item)["v"].alias(value), *[quoted(h) for h in t.hidden()], F.col(item)["k"].alias(place))
        return Table(out, [*rest, attribute, value], [*t.order, (place, True)] if t.order else [], t.explicit)

    def unpivot(t: Table, names: Any, attribute: Any, value: Any) -> Table:
        names = ev.names(names)
        t.need(*names)
        return melt(t, names, attribute, value)

    def unpivot_others(t: Table, keep: Any, attribute: Any, value: Any) -> Table:
        keep = ev.names(keep)
        t.need(*keep)
        t = t.select([(c, quoted(c)) for c in [*keep, *[c for c in t.cols if c not in keep]]])
        return melt(t, [c for c in t.cols if c not in keep], attribute, value)

    op("Table.Unpivot", 4, 4, unpivot)
    op("Table.UnpivotOtherColumns", 4, 4, unpivot_others)

    def pivot(t: Table, values: Any, attribute: Any, value: Any, f: Any = None) -> Table:
        values = ev.const(values, "pivot values")
        attribute, value = ev.text(attribute, "column name"), ev.text(value, "column name")
        t.need(attribute, value)
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values) or len(set(values)) != len(values):
            raise EvalError("Table.Pivot: distinct texts are needed as values")
        keys = [c for c in t.cols if c not in (attribute, value)]
        if set(values) & set(keys):
            raise EvalError("a pivot value is also a column")
        col, row = t.col(value), t.row()
        made = []
        for v in values:
            here = quoted(attribute) == F.lit(v)
            g = Group(row, here, t.order)
            if f is None:
                n, one = F.count_if(here), F.max(F.when(here, col.c))
                cell = F.when(n > 1, F.raise_error(F.lit("Table.Pivot: several values for one cell")).cast(t.df.schema[value].dataType)).otherwise(one)
            else:
                cell = as_col(ev.call(f, GroupColumn(col, g))).c
            made.append(cell.alias(v))
        first = [F.min(F.struct(*[quoted(n).alias(n) for n, _ in t.order])).alias(P.ORDINAL + "_first")] if t.order and all(up for _, up in t.order) else []
        df = t.df.groupBy(*[quoted(k).alias(k) for k in keys]).agg(*made, *first)
        names = [*keys, *values]
        if not first:
            return Table(df, names)
        order = [(f"{V.HIDDEN}g{i}", True) for i in range(len(t.order))]
        return Table(df.select(*[quoted(n) for n in names], *[F.col(P.ORDINAL + "_first").getField(n).alias(a) for (n, _), (a, _) in zip(t.order, order, strict=True)]), names, order)

    op("Table.Pivot", 4, 5, pivot)

    def transpose(t: Table, columns: Any = None) -> Table:
        """Rows become columns, so the table must be small enough for a schema: it is built on the driver."""
        rows = (t.df.orderBy(*t.order_by()) if t.order else t.df).select(*[quoted(c) for c in t.cols]).limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise UnsupportedError(f"a transposed table of more than {MOST_COLUMNS} columns")
        records = [P.record_of(t, r) for r in rows]
        names = column_names(ev, columns, len(records), "Table.Transpose")
        return from_rows(ev, names, mixed([[r[c] for r in records] for c in t.cols]))

    def mixed(rows: list[list[Any]]) -> list[list[Any]]:
        """Columns of different kinds become text."""
        from mlode.plans.values import TypeValue

        width = len(rows[0]) if rows else 0
        for k in range(width):
            if len({V.kind_of_value(r[k]).name for r in rows} - {"null"}) > 1:
                for r in rows:
                    r[k] = r[k] if r[k] is None or isinstance(r[k], str) else ev.const(ev.convert(as_col(r[k]), TypeValue("text")))
        return rows

    op("Table.Transpose", 1, 2, transpose)

    # -- splitters
    def splitter(name: str, least: int, most: int, build: Any) -> None:
        def make(*args: Any) -> Splitter:
            cut = build(*args)

            def call(v: Any) -> Any:
                if v is None:
                    return None
                c = as_col(v)
                if c.kind.name not in ("text", "any"):
                    raise EvalError(f"{name} needs a text")
                made = Col(cut(c.c), Kind("list", TEXT), c.free)
                return ev.const(made) if isinstance(v, str) else made

            return Splitter(name, call, 1, 1)

        fn(name, least, most, make)

    def quoting(style: Any, default: bool) -> bool:
        if style is None:
            return default
        if not isinstance(style, Enum) or not style.name.startswith("QuoteStyle."):
            raise EvalError("a quote style is expected")
        return style.name == "QuoteStyle.Csv"

    def delimited(d: str, quotes: bool) -> Any:
        if not d:
            raise EvalError("an empty delimiter")
        if not quotes:
            return lambda c: F.split(c, regex(d), -1)
        # quoted stretches keep their delimiters; doubled quotes inside stand for one
        # a delimiter counts where an even number of quotes follows
        outside = regex(d) + '(?=(?:[^"]*"[^"]*")*[^"]*$)'
        bare = lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
        return lambda c: F.transform(F.split(c, outside, -1), bare)

    splitter("Splitter.SplitTextByDelimiter", 1, 2, lambda d, style=None: delimited(ev.text(d, "delimiter"), quoting(style, True)))

    def each(delimiters: Any, style: Any = None, from_end: Any = False) -> Any:
        many, back = ev.names(delimiters, "delimiters"), bool(ev.const(from_end))
        if any(not d for d in many):
            raise EvalError("an empty delimiter")
        if quoting(style, False):
            kit.refuse("quotes in Splitter.SplitTextByEachDelimiter")

        def cut(c: Column) -> Column:
            out, rest = [], F.reverse(c) if back else c
            left = F.lit(True)
            for d in many:
                d = d[::-1] if back else d
                at = F.locate(d, rest)
                hit = left & (at > 0)
                out.append(F.when(hit, F.substring(rest, F.lit(1), at - 1)))
                rest = F.when(hit, F.substring(rest, at + len(d), F.length(rest))).otherwise(rest)
                left = hit
            pieces = F.array_compact(F.array(*out, rest))
            return F.transform(F.reverse(pieces), lambda x: F.reverse(x)) if back else pieces

        return cut

    splitter("Splitter.SplitTextByEachDelimiter", 1, 3, each)

    def positions(places: Any, from_end: Any = False) -> Any:
        at = ev.const(places)
        if not isinstance(at, list) or not at or any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in at) or sorted(at) != at:
            raise EvalError("ascending positions from 0 are needed")
        back = bool(ev.const(from_end))

        def cut(c: Column) -> Column:
            x = F.reverse(c) if back else c
            made = [F.substring(x, F.lit(a + 1), F.lit(b - a)) if b is not None else F.substring(x, F.lit(a + 1), F.length(x)) for a, b in zip(at, [*at[1:], None], strict=True)]
            return F.transform(F.reverse(F.array(*made)), lambda p: F.reverse(p)) if back else F.array(*made)

        return cut

    splitter("Splitter.SplitTextByPositions", 1, 2, positions)

    def transition(before: Any, after: Any) -> Any:
        def test(side: Any) -> Any:
            if isinstance(side, Fn):
                return lambda x: F.coalesce(as_col(ev.call(side, Col(x, TEXT))).c, F.lit(False))
            chars = "".join(ev.names(side, "characters"))
            return lambda x: x.isin(list(chars))

        a, b = test(before), test(after)

        def cut(c: Column) -> Column:
            step = lambda s, x: F.struct(
                F.when((s["last"] != "") & a(s["last"]) & b(x), F.concat(s["out"], F.array(x))).otherwise(F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), x)))).alias("out"),
                x.alias("last"),
            )
            return F.aggregate(F.split(c, ""), F.struct(F.array(F.lit("")).alias("out"), F.lit("").alias("last")), step, lambda s: s["out"])

        return cut

    splitter("Splitter.SplitTextByCharacterTransition", 2, 2, transition)

    def slots(pieces: Column, width: int, extra: Any, default: Any, elem: T.DataType | None = None) -> list[Column]:
        """One column for each slot of a list of pieces."""
        style = "ExtraValues.Ignore" if extra is None else extra.name if isinstance(extra, Enum) else ""
        if not style.startswith("ExtraValues."):
            raise EvalError("an extra-values mode is expected")
        fill = as_col(default).c
        size = F.size(pieces)
        got = [F.when(pieces.isNull(), None).when(size > k, F.get(pieces, F.lit(k))).otherwise(fill) for k in range(width)]
        if style == "ExtraValues.Error":
            got[0] = F.when(size > width, F.raise_error(F.lit("more pieces than columns")).cast("string")).otherwise(got[0])
        if style == "ExtraValues.List":
            got[-1] = F.when(pieces.isNotNull(), F.slice(pieces, F.lit(width), F.greatest(size - width + 1, F.lit(0))))
        return got

    def pieces_of(f: Any, c: Col) -> Column:
        made = ev.call(f, c)
        got = as_col(made)
        if got.kind.name != "list":
            raise EvalError("a splitter must give a list")
        return got.c

    def split_column(t: Table, column: Any, f: Any, names: Any = None, default: Any = None, extra: Any = None) -> Table:
        column = ev.text(column, "column name")
        pieces = pieces_of(f, t.col(column))
        names = ev.const(names, "names")
        if names is None:
            width = t.df.agg(F.max(F.size(pieces))).first()[0] or 1
            names = [f"{column}.{k + 1}" for k in range(max(width, 1))]
        elif isinstance(names, (int, float)) and not isinstance(names, bool):
            names = [f"{column}.{k + 1}" for k in range(int(names))]
        if not isinstance(names, list) or not names or set(names) & (set(t.cols) - {column}):
            raise EvalError("Table.SplitColumn: new names are needed")
        cells = list(zip(names, slots(pieces, len(names), extra, default), strict=True))
        return t.select([x for c in t.cols for x in (cells if c == column else [(c, quoted(c))])])

    op("Table.SplitColumn", 3, 6, split_column)

    # -- headers
    def promote(t: Table, options: Any = None) -> Table:
        everything = False
        if options is not None:
            if not isinstance(options, Rec) or set(options) - {"PromoteAllScalars", "Culture"}:
                kit.refuse("those options of Table.PromoteHeaders")
            everything = bool(ev.const(options.get("PromoteAllScalars", False)))
            if ev.const(options.get("Culture")) not in (None, "", "en-US", "en"):
                kit.refuse("a culture of Table.PromoteHeaders")
        t.need_order()
        head = P.rows_at(t, 0)
        if head is None:
            return t
        names: list[str] = []
        for k, v in enumerate(head.values()):
            plain = isinstance(v, str) or (isinstance(v, (int, float)) and not isinstance(v, bool))
            if v is None or not (plain or everything):
                text = f"Column{k + 1}"
            else:
                text = v if isinstance(v, str) else ev.const(ev.convert(as_col(v), V.TypeValue("text")))
            base, n = text or f"Column{k + 1}", 1
            while text in names or not text:
                text, n = f"{base}.{n}" if text else base, n + 1 if text else n
            names.append(text)
        if len({n.lower() for n in names}) != len(names):
            raise EvalError("Table.PromoteHeaders gives one name twice")
        rest = drop_first(t)
        return rest.select(list(zip(names, [quoted(c) for c in t.cols], strict=True)))

    def drop_first(t: Table) -> Table:
        """All rows but the first: a comparison with its ordinal, which a scan can make anywhere."""
        row = t.df.orderBy(*t.order_by()).limit(1).select(*[quoted(n) for n, _ in t.order]).first()
        name, _ = t.order[0]
        if len(t.order) == 1 and isinstance(row[0], T.Row):
            f, r = row[0]["f"], row[0]["r"]
            return t.keep(t.df.filter(~((quoted(name)["f"] == F.lit(f)) & (quoted(name)["r"] == F.lit(r)))))
        return P.keep_rows(t, lambda i: i >= 1)

    op("Table.PromoteHeaders", 1, 2, promote)

    def demote(t: Table) -> Table:
        """The header as first row; columns become text unless they are text already."""
        names = [f"Column{k + 1}" for k in range(len(t.cols))]
        t.need_order()
        if t.order != [(P.ORDINAL, True)]:
            raise UnsupportedError("Table.DemoteHeaders of a sorted table")
        body = t.select([(n, ev.convert(t.col(c), V.TypeValue("text")).c) for n, c in zip(names, t.cols, strict=True)])
        head = from_rows(ev, names, [list(t.cols)])
        one = head.df.withColumn(P.ORDINAL, F.struct(F.lit("").alias("f"), F.lit(-1).cast("long").alias("r")))
        return Table(one.unionByName(body.df), names, [(P.ORDINAL, True)])

    op("Table.DemoteHeaders", 1, 1, demote)

    # -- from values
    def need_list(v: Any, name: str) -> list[Any]:
        v = ev.const(v) if isinstance(v, (TableColumn, Col)) else v
        if not isinstance(v, list):
            raise EvalError(f"{name} needs a list")
        return v

    def rows_table(rows: Any, columns: Any = None) -> Table:
        rows = [need_list(r, "Table.FromRows") for r in need_list(rows, "Table.FromRows")]
        names = column_names(ev, columns, max(map(len, rows), default=0), "Table.FromRows")
        return from_rows(ev, names, [[r[k] if k < len(r) else None for k in range(len(names))] for r in rows])

    fn("Table.FromRows", 1, 2, rows_table)
    fn("#table", 2, 2, lambda columns, rows: rows_table(rows, columns))

    def records_table(v: Any) -> Any:
        if isinstance(v, Table):
            return v
        rows = need_list(v, "Table.FromRecords")
        if not all(isinstance(r, Rec) for r in rows):
            raise EvalError("Table.FromRecords needs records")
        return from_records(ev, rows)

    fn("Table.FromRecords", 1, 1, records_table)

    def columns_table(lists: Any, columns: Any = None) -> Table:
        lists = [need_list(x, "Table.FromColumns") for x in need_list(lists, "Table.FromColumns")]
        names = column_names(ev, columns, len(lists), "Table.FromColumns")
        if len(names) != len(lists):
            raise EvalError("Table.FromColumns: as many names as lists are needed")
        return from_rows(ev, names, [list(r) for r in zip_longest(*lists)])

    fn("Table.FromColumns", 1, 2, columns_table)

    def list_table(v: Any, f: Any = None, columns: Any = None, default: Any = None, extra: Any = None) -> Table:
        items = need_list(v, "Table.FromList")
        rows = []
        for x in items:
            if x is None:
                rows.append(None)
            elif f is None:
                if not isinstance(x, str):
                    raise EvalError("Table.FromList needs texts or a splitter")
                rows.append(x.split(","))
            else:
                rows.append(need_list(ev.const(ev.call(f, x)), "Table.FromList"))
        width = max((len(r) for r in rows if r is not None), default=1)
        names = column_names(ev, columns, width, "Table.FromList")
        style = extra.name if isinstance(extra, Enum) else "ExtraValues.Ignore"
        out = []
        for r in rows:
            if r is None:
                out.append([None] * len(names))
                continue
            if len(r) > len(names) and style == "ExtraValues.Error":
                raise EvalError("Table.FromList: more pieces than columns")
            cells = [r[k] if k < len(r) else ev.const(default) for k in range(len(names))]
            if style == "ExtraValues.List":
                cells[-1] = r[len(names) - 1 :]
            out.append(cells)
        return from_rows(ev, names, out)

    fn("Table.FromList", 1, 5, list_table)

    def value_table(v: Any, options: Any = None) -> Table:
        name = "Value"
        if options is not None:
            if not isinstance(options, Rec) or set(options) - {"DefaultColumnName"}:
                kit.refuse("those options of Table.FromValue")
            name = ev.text(options["DefaultColumnName"], "column name")
        if isinstance(v, Table):
            return v
        if isinstance(v, Rec):
            return from_records(ev, [v])
        if isinstance(v, list) and v and all(isinstance(x, Rec) for x in v):
            return from_records(ev, v)
        return from_rows(ev, [name], [[x] for x in v] if isinstance(v, list) else [[v]])

    fn("Table.FromValue", 1, 2, value_table)

    # -- to values: lists of whole tables live on the driver, within the step budget
    def to_records(t: Any) -> Any:
        if isinstance(t, Group):
            return GroupColumn(as_col(t.row), t)
        return P.collect_records(ev, table(t, "Table.ToRecords"))

    fn("Table.ToRecords", 1, 1, to_records)

    def to_rows(t: Any) -> Any:
        if isinstance(t, Group):
            return GroupColumn(as_col(list(t.row.values())), t)
        return [list(r.values()) for r in P.collect_records(ev, table(t, "Table.ToRows"))]

    fn("Table.ToRows", 1, 1, to_rows)

    def to_columns(t: Table) -> list[list[Any]]:
        rows = P.collect_records(ev, t)
        return [[r[c] for r in rows] for c in t.cols]

    op("Table.ToColumns", 1, 1, to_columns)

    def to_list(t: Table, f: Any = None) -> list[Any]:
        rows = P.collect_records(ev, t)
        if f is not None:
            return [ev.const(ev.call(f, list(r.values()))) for r in rows]
        if len(t.cols) != 1:
            raise EvalError("Table.ToList of several columns needs a combiner")
        return [r[t.cols[0]] for r in rows]

    op("Table.ToList", 1, 2, to_list)
