"""Joins, nested tables and grouping."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlode.functions.kit import Kit
from mlode.operators import positional as P
from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import Enum, Fn, Group, Table, as_col, quoted

KINDS = ("Inner", "LeftOuter", "RightOuter", "FullOuter", "LeftAnti", "RightAnti")
R = V.HIDDEN + "r_"
KEY = V.HIDDEN + "jk"


class Nested:
    """A join whose matches are still to be nested in a column: Expand turns it into a flat join instead."""

    def __init__(self, left: Table, lk: list[str], right: Table, rk: list[str], column: str, kind: str):
        self.left, self.lk, self.right, self.rk, self.column, self.kind = left, lk, right, rk, column, kind

    @property
    def cols(self) -> list[str]:
        return [*self.left.cols, self.column]

    def keys(self) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with common key columns."""
        names = [f"{KEY}{i}" for i in range(len(self.lk))]
        left = self.left.df.select("*", *[quoted(k).alias(n) for k, n in zip(self.lk, names, strict=True)])
        right = self.right.df.select(*[quoted(c).alias(R + c) for c in [*self.right.cols, *self.right.hidden()]], *[quoted(k).alias(n) for k, n in zip(self.rk, names, strict=True)])
        return left, right, names

    def gathered(self, right: DataFrame, by: list[str]) -> DataFrame:
        keys = [quoted(R + n) for n, _ in self.right.order] if all(up for _, up in self.right.order) else []
        row = F.struct(*[quoted(R + c).alias(c) for c in self.right.cols])
        item = F.struct(F.struct(*keys).alias("o"), row.alias("v")) if keys else F.struct(row.alias("v"))
        rows = F.collect_list(item)
        return right.groupBy(*by).agg(F.transform(F.array_sort(rows) if keys else rows, lambda x: x["v"]).alias(V.HIDDEN + "rows"))

    def materialise(self) -> DataFrame:
        left, right, names = self.keys()
        present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        some = self.gathered(right.filter(present), names)
        rows = V.HIDDEN + "rows"
        visible = [quoted(c) for c in self.left.cols]
        hidden = [quoted(h) for h in self.left.hidden()]
        empty = F.array().cast(some.schema[rows].dataType)
        out = None
        if self.kind in ("Inner", "LeftOuter", "FullOuter"):
            joined = left.join(some, names, "inner" if self.kind == "Inner" else "left")
            out = joined.select(*visible, F.coalesce(rows, empty).alias(self.column), *hidden)
        elif self.kind == "LeftAnti":
            out = left.join(some.select(*names), names, "left_anti").select(*visible, empty.alias(self.column), *hidden)
        elif self.kind == "RightOuter":
            out = left.join(some, names).select(*visible, quoted(rows).alias(self.column), *hidden)
        if self.kind in ("RightOuter", "FullOuter", "RightAnti"):
            # rows of the right side without a partner stand in one row of nulls
            keys = left.select(*names).distinct()
            alone = self.gathered(right.join(keys, names, "left_anti"), []).filter(F.size(rows) > 0)
            types = {f.name: f.dataType for f in self.left.df.schema}
            last = alone.select(*[F.lit(None).cast(types[c]).alias(c) for c in self.left.cols], quoted(rows).alias(self.column), *[F.lit(None).cast(types[h]).alias(h) for h in self.left.hidden()])
            out = last if out is None else out.unionByName(last)
        return out


def collide(left: list[str], right: list[str]) -> dict[str, str]:
    """Names of the right side's columns in a flat join: taken ones get .1, .2, ..."""
    taken, out = set(left), {}
    for c in right:
        name, k = c, 1
        while name in taken:
            name, k = f"{c}.{k}", k + 1
        taken.add(name)
        out[c] = name
    return out


def flat_join(left: Table, lk: list[str], right: Table, rk: list[str], kind: str, names: dict[str, str]) -> Table:
    """Columns of the left side, then those of the right side under their names."""
    both = Nested(left, lk, right, rk, "", kind)
    l, r, _ = both.keys()
    l = l.drop(*[f"{KEY}{i}" for i in range(len(lk))])
    cond = reduce(lambda a, b: a & b, [quoted(a) == quoted(f"{KEY}{i}") for i, a in enumerate(lk)])
    lo = [(f"{V.HIDDEN}lo{i}", n, up) for i, (n, up) in enumerate(left.order)]
    ro = [(f"{V.HIDDEN}ro{i}", n, up) for i, (n, up) in enumerate(right.order)]
    types = {f.name: f.dataType for f in l.schema} | {f.name: f.dataType for f in r.schema}
    how = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "FullOuter": "full", "LeftAnti": "left_anti", "RightAnti": "left_anti"}[kind]
    joined = r.join(l, cond, how) if kind == "RightAnti" else l.join(r, cond, how)
    nothing = lambda c: F.lit(None).cast(types[c])
    has_l, has_r = kind != "RightAnti", kind != "LeftAnti"
    # the side that drives the order; in a full join rows of the left side come first
    driver = (ro, lo) if kind in ("RightOuter", "RightAnti") else (lo, ro)
    first = V.HIDDEN + "side"
    order = ([(first, True)] if kind == "FullOuter" and lo and ro else []) + [(a, up) for part in driver for a, _, up in part]
    cols = [*[(quoted(c) if has_l else nothing(c)).alias(c) for c in left.cols], *[(quoted(R + c) if has_r else nothing(R + c)).alias(n) for c, n in names.items()]]
    hidden = [*[(quoted(n) if has_l else nothing(n)).alias(a) for a, n, _ in lo], *[(quoted(R + n) if has_r else nothing(R + n)).alias(a) for a, n, _ in ro]]
    if kind == "FullOuter" and lo and ro:
        hidden.append(F.when(quoted(lo[0][1]).isNull(), 1).otherwise(0).alias(first))
    return Table(joined.select(*cols, *hidden), [*left.cols, *names.values()], order if (lo or ro) else [], left.explicit)


def register(kit: Kit) -> None:
    ev, fn, op, table = kit.ev, kit.fn, kit.op, kit.table
    for k in KINDS:
        kit.enum(f"JoinKind.{k}")
    for k in ("Global", "Local"):
        kit.enum(f"GroupKind.{k}")

    def join_kind(v: Any, default: str = "Inner") -> str:
        if v is None:
            return default
        if not isinstance(v, Enum) or not v.name.startswith("JoinKind."):
            raise EvalError("a join kind is expected")
        return v.name.removeprefix("JoinKind.")

    def key_pair(t1: Table, k1: Any, t2: Table, k2: Any) -> tuple[list[str], list[str]]:
        a, b = ev.names(k1, "keys"), ev.names(k2, "keys")
        if len(a) != len(b) or not a:
            raise EvalError("as many keys are needed on both sides")
        t1.need(*a)
        t2.need(*b)
        return a, b

    def comparable(t1: Table, a: list[str], t2: Table, b: list[str]) -> bool:
        """Keys of different kinds never match."""
        return all(t1.kinds[x].name == t2.kinds[y].name for x, y in zip(a, b, strict=True))

    def settled(t1: Table, a: list[str], t2: Table, b: list[str]) -> Table:
        if comparable(t1, a, t2, b):
            return t2
        kinds = {f.name: f.dataType for f in t1.df.schema}
        wrong = {y: x for x, y in zip(a, b, strict=True) if t1.kinds[x].name != t2.kinds[y].name}
        raise UnsupportedError(f"a join of {', '.join(f'{x} ({kinds[x].simpleString()}) and {y}' for y, x in wrong.items())}")

    def join(t1: Any, k1: Any, t2: Any, k2: Any, kind: Any = None, algorithm: Any = None, comparers: Any = None) -> Table:
        if algorithm is not None or comparers is not None:
            kit.refuse("a join algorithm or key comparers")
        left, right = table(t1, "Table.Join"), table(t2, "Table.Join")
        a, b = key_pair(left, k1, right, k2)
        return flat_join(left, a, settled(left, a, right, b), b, join_kind(kind), collide(left.cols, right.cols))

    fn("Table.Join", 4, 7, join)

    def nested_join(t1: Any, k1: Any, t2: Any, k2: Any, column: Any, kind: Any = None) -> Table:
        left, right = table(t1, "Table.NestedJoin"), table(t2, "Table.NestedJoin")
        a, b = key_pair(left, k1, right, k2)
        column = ev.text(column, "column name")
        if column in left.cols:
            raise EvalError(f"The column '{column}' exists already.")
        nested = Nested(left, a, settled(left, a, right, b), b, column, join_kind(kind))
        return Table(None, nested.cols, left.order, left.explicit, nested)

    fn("Table.NestedJoin", 5, 6, nested_join)

    def new_names(names: list[str], said: Any, t: Table, column: str) -> list[str]:
        out = names if said is None else ev.names(said, "new names")
        if len(out) != len(names) or len(set(out)) != len(out):
            raise EvalError("new names must be distinct and as many as the names")
        for n in out:
            if n in t.cols and n != column:
                raise EvalError(f"The column '{n}' exists already.")
        return out

    def expand_table(t: Any, column: Any, names: Any, said: Any = None) -> Table:
        t = table(t, "Table.ExpandTableColumn")
        column, names = ev.text(column, "column name"), ev.names(names)
        t.need(column)
        new = new_names(names, said, t, column)
        if t._df is None and t.nested.column == column and t.nested.kind in ("Inner", "LeftOuter"):
            n = t.nested
            made = flat_join(n.left, n.lk, n.right, n.rk, n.kind, {x: f"{V.HIDDEN}x{i}" for i, x in enumerate(n.right.cols)})
            at = {x: f"{V.HIDDEN}x{i}" for i, x in enumerate(n.right.cols)}
            cells = [(y, quoted(at[x]) if x in at else F.lit(None).cast("string")) for x, y in zip(names, new, strict=True)]
            return made.select([*[(c, quoted(c)) for c in n.left.cols], *cells])
        kind = t.kinds[column]
        if kind.name != "list" or not kind.elem or kind.elem.name != "record":
            raise EvalError(f"the column '{column}' holds no tables")
        fields = {n for n, _ in kind.elem.fields}
        rest = [c for c in t.cols if c != column]
        place, item = P.fresh(t, "pos"), V.HIDDEN + "item"
        df = t.df.select(*[quoted(c) for c in rest], *[quoted(h) for h in t.hidden()], F.posexplode_outer(quoted(column)).alias(place, item))
        cells = [(F.col(item).getField(x) if x in fields else F.lit(None).cast("string")).alias(y) for x, y in zip(names, new, strict=True)]
        out = df.select(*[quoted(c) for c in rest], *cells, *[quoted(h) for h in t.hidden()], quoted(place))
        return Table(out, [*rest, *new], [*t.order, (place, True)] if t.order else [], t.explicit)

    fn("Table.ExpandTableColumn", 3, 4, expand_table)

    def expand_record(t: Table, column: Any, names: Any, said: Any = None) -> Table:
        column, names = ev.text(column, "column name"), ev.names(names)
        t.need(column)
        new = new_names(names, said, t, column)
        kind = t.kinds[column]
        if kind.name != "record":
            raise EvalError(f"the column '{column}' holds no records")
        fields = {n for n, _ in kind.fields}
        cells = [(y, quoted(column).getField(x) if x in fields else F.lit(None).cast("string")) for x, y in zip(names, new, strict=True)]
        return t.select([*[(c, quoted(c)) for c in t.cols if c != column], *cells])

    op("Table.ExpandRecordColumn", 3, 4, expand_record)

    def expand_list(t: Table, column: Any) -> Table:
        column = ev.text(column, "column name")
        t.need(column)
        if t.kinds[column].name != "list":
            raise EvalError(f"the column '{column}' holds no lists")
        place, item = P.fresh(t, "pos"), V.HIDDEN + "item"
        df = t.df.select(*[quoted(c) for c in t.df.columns], F.posexplode_outer(quoted(column)).alias(place, item))
        out = df.select(*[F.col(item).alias(c) if c == column else quoted(c) for c in t.cols], *[quoted(h) for h in t.hidden()], quoted(place))
        return Table(out, t.cols, [*t.order, (place, True)] if t.order else [], t.explicit)

    op("Table.ExpandListColumn", 2, 2, expand_list)

    # -- grouping
    def specs(v: Any) -> list[tuple[str, Fn, Any]]:
        if isinstance(v, list) and v and not isinstance(v[0], list):
            v = [v]
        out = []
        for s in v:
            if not isinstance(s, list) or not 2 <= len(s) <= 3 or not isinstance(s[1], Fn):
                raise EvalError("Table.Group: {name, function} pairs are expected")
            out.append((ev.text(s[0], "column name"), s[1], s[2] if len(s) > 2 else None))
        return out

    def aggregate(f: Fn, group: Group) -> Column:
        made = ev.call(f, group)
        if isinstance(made, Group):
            return nested_rows(made)
        if isinstance(made, Table):
            raise UnsupportedError("a table made in a group")
        return as_col(made).c

    def nested_rows(g: Group) -> Column:
        if any(not up for _, up in g.order):
            kit.refuse("a nested table of a group in descending order")
        row = as_col(g.row).c
        item = F.struct(*[quoted(n).alias(n) for n, _ in g.order], row.alias("v"))
        rows = F.collect_list(item if g.cond is None else F.when(g.cond, item))
        return F.transform(F.array_sort(rows) if g.order else rows, lambda x: x["v"])

    def group(t: Table, keys: Any, aggregates: Any, kind: Any = None) -> Table:
        keys, wanted = ev.names(keys, "keys"), specs(aggregates)
        t.need(*keys)
        local = isinstance(kind, Enum) and kind.name == "GroupKind.Local"
        if kind is not None and not isinstance(kind, Enum):
            raise EvalError("a group kind is expected")
        names = [*keys, *[n for n, _, _ in wanted]]
        if len(set(names)) != len(names):
            raise EvalError("Table.Group gives one name twice")
        run = V.HIDDEN + "run"
        if local:
            t = P.with_runs(t, keys, run)
        g = Group(t.row(), None, t.order, modes=None if t.df.isStreaming else [])
        by = [quoted(k).alias(k) for k in keys]
        same = [quoted(run)] if local else by
        values = {n: aggregate(f, g) for n, f, _ in wanted}
        counted = modes(t, same, g)
        alone = {k: n for n, c in values.items() for k, (_, _, made, _) in enumerate(g.modes or []) if c is made}
        for k, best in enumerate(counted):
            if k not in alone:  # part of an expression with other aggregates: each row gets it
                t = Table(beside(t.df, same, best), t.cols, t.order, t.explicit)
        made = [c.alias(n) for n, c in values.items() if n not in alone.values()]
        first = []
        if t.order and all(up for _, up in t.order):
            first = [F.min(F.struct(*[quoted(n).alias(n) for n, _ in t.order])).alias(P.ORDINAL + "_first")]
        grouped = t.df.groupBy(*([quoted(run)] if local else []), *by)
        everything = [*made, *first]
        if not everything:
            df = grouped.agg(F.count(F.lit(1)).alias(V.HIDDEN + "rows")).drop(V.HIDDEN + "rows")
        else:
            df = grouped.agg(*everything)
        for k, n in alone.items():
            df = beside(df, same, counted[k]).withColumnRenamed(f"{V.HIDDEN}mode{k}", n)
        df = df.drop(run) if local else df
        if not first:
            return Table(df.select(*[quoted(n) for n in names]), names)
        inner = [(f"{V.HIDDEN}g{i}", up) for i, (_, up) in enumerate(t.order)]
        df = df.select(*[quoted(n) for n in names], *[F.col(P.ORDINAL + "_first").getField(n).alias(f"{V.HIDDEN}g{i}") for i, (n, _) in enumerate(t.order)])
        if len(inner) == 1 and t.order[0][0] == P.ORDINAL:
            return Table(df.withColumnRenamed(inner[0][0], P.ORDINAL), names, [(P.ORDINAL, True)])
        return Table(df, names, inner)

    op("Table.Group", 3, 4, group)

    def modes(t: Table, same: list[Column], g: Group) -> list[DataFrame]:
        """A row for each group and List.Mode: counts and first positions of the values, then the best one. Ties: the latest first position."""
        v, n, at = (V.HIDDEN + x for x in ("value", "times", "at"))
        out = []
        for k, (value, cond, _, shares) in enumerate(g.modes or []):
            rows, keys = t.df if cond is None else t.df.filter(cond), [f"{V.HIDDEN}key{k}_{i}" for i in range(len(same))]
            if shares is not None:
                out.append(percentiles(rows.select(*[c.alias(key) for c, key in zip(same, keys, strict=True)], value.alias(v)), keys, v, shares).withColumnRenamed(v, f"{V.HIDDEN}mode{k}"))
                continue
            place = [F.min(F.struct(*[quoted(x).alias(x) for x, _ in t.order])).alias(at)] if t.order else []
            per = rows.groupBy(*[c.alias(key) for c, key in zip(same, keys, strict=True)], value.alias(v)).agg(F.count(F.lit(1)).alias(n), *place)
            out.append(per.groupBy(*keys).agg(F.max_by(v, F.struct(n, *([at] if place else []), v)).alias(f"{V.HIDDEN}mode{k}")))
        return out

    def percentiles(rows: DataFrame, keys: list[str], v: str, shares: list[float] | float) -> DataFrame:
        """keys and a percentile, or an array of them, from the counts of distinct values: no task holds the values of a group."""
        n, upto, total = (V.HIDDEN + x for x in ("times", "upto", "total"))
        per = rows.filter(F.col(v).isNotNull()).groupBy(*keys, F.col(v).cast("double").alias(v)).agg(F.count(F.lit(1)).alias(n))
        w = Window.partitionBy(*keys)
        per = per.withColumn(upto, F.sum(n).over(w.orderBy(v).rowsBetween(Window.unboundedPreceding, 0))).withColumn(total, F.sum(n).over(w))
        made = []
        for p in shares if isinstance(shares, list) else [shares]:
            at = F.lit(p) * (F.col(total) - 1)
            low, high = F.floor(at), F.ceil(at)
            value = lambda i: F.max(F.when((F.col(upto) > i) & (F.col(upto) - F.col(n) <= i), F.col(v)))
            share = F.max(at - low)
            made.append(F.when(share == 0, value(low)).otherwise((1 - share) * value(low) + share * value(high)))
        return per.groupBy(*keys).agg((F.array(*made) if isinstance(shares, list) else made[0]).alias(v))

    def beside(df: DataFrame, same: list[Column], best: DataFrame) -> DataFrame:
        """df with the values of its groups; keys can be null."""
        keys = best.columns[:-1]
        match = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(k)) for c, k in zip(same, keys, strict=True)], F.lit(True))
        return df.join(best, match, "left").drop(*keys)
