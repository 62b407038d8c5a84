"""Row order: ordinals, dense row numbers and fills without a single-task window.

A positional operator asks for a dense index. Rows are cut into buckets that follow
the order: for the ordinal of a file, runs of ``BUCKET_ROWS`` rows; for sort keys,
ranges between rows sampled from all partitions, compared by the whole key, so that
one frequent value of a leading key is many buckets. Each bucket is numbered on its
own and gets the rows before it as an offset from a small table of bucket counts.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.plans.values import HIDDEN, Rec, Table, quoted

ORDINAL = HIDDEN + "ord"
BUCKET = HIDDEN + "bucket"
INDEX = HIDDEN + "index"
#: Rows of a bucket, and the most ranges of sort keys; PER_RANGE rows are sampled for each.
BUCKET_ROWS = 1 << 16
MOST_RANGES, PER_RANGE = 1024, 48
#: Ranges up to which a row finds its own by nested conditions.
MOST_NESTED = 128


def fresh(table: Table, stem: str) -> str:
    k, taken = 0, set(table.df.columns)
    while f"{HIDDEN}{stem}{k}" in taken:
        k += 1
    return f"{HIDDEN}{stem}{k}"


def file_ordinal(df: DataFrame) -> DataFrame:
    """The place of each row of a Parquet scan; filters still reach the scan."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias(ORDINAL))


def counted_ordinal(df: DataFrame) -> DataFrame:
    """The place of each row of any other DataFrame: partition, then row."""
    return df.select("*", F.struct(F.lit("").alias("f"), F.monotonically_increasing_id().alias("r")).alias(ORDINAL))


def in_file_order(t: Table) -> bool:
    return len(t.order) == 1 and t.order[0][0] == ORDINAL


def not_before(order: list[tuple[str, bool]], key: Any) -> Column:
    """Whether a row stands at or behind the place with the key values key(0), key(1), ..."""
    after = F.lit(True)
    for k in reversed(range(len(order))):
        n, up = order[k]
        x, y = quoted(n), key(k)
        beyond = (x > y) | (y.isNull() & x.isNotNull()) if up else (x < y) | (x.isNull() & y.isNotNull())
        after = F.coalesce(beyond, F.lit(False)) | (x.eqNullSafe(y) & after)
    return after


def bucketed(t: Table) -> tuple[DataFrame, bool]:
    """t's rows with a bucket, and whether buckets ascend (or descend) with the order."""
    t.need_order()
    if in_file_order(t):
        shift = BUCKET_ROWS.bit_length() - 1
        return t.df.withColumn(BUCKET, F.struct(quoted(ORDINAL)["f"].alias("f"), F.shiftright(quoted(ORDINAL)["r"], shift).alias("r"))), t.order[0][1]
    rows = t.df.count()
    ranges = min(MOST_RANGES, max(rows // BUCKET_ROWS, min(8, rows // 1000)))
    bucket = F.lit(0)
    order = comparable(t)
    if ranges > 1 and order:
        sample = t.df.select(*[quoted(n) for n, _ in t.order]).sample(min(1.0, PER_RANGE * ranges / rows), seed=7).orderBy(*t.order_by())
        # texts of other types cast back exactly
        plain = (T.StringType, T.BooleanType, T.NumericType, T.StructType)
        sample = sample.select(*[quoted(n) if isinstance(t.df.schema[n].dataType, plain) else quoted(n).cast("string") for n, _ in order]).collect()
        cuts = [sample[k] for k in range(len(sample) // ranges, len(sample), max(1, len(sample) // ranges))]
        # a place that isn't a file's can differ from one evaluation to the next: rows that it alone tells apart stay together
        for k, (n, _) in enumerate(order):
            if n == ORDINAL and any(not c[k]["f"] or c[k]["f"].endswith("/") for c in cuts):
                order = order[:k]
                break
        if cuts and order:
            bucket = cuts_before(t, order, cuts)
    return t.df.withColumn(BUCKET, bucket.cast("long")), True


def comparable(t: Table) -> list[tuple[str, bool]]:
    """The leading keys whose values can be written down."""
    out = []
    for n, up in t.order:
        kind = t.df.schema[n].dataType
        if n != ORDINAL and isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)):
            break
        out.append((n, up))
    return out


def cuts_before(t: Table, order: list[tuple[str, bool]], cuts: list[Any]) -> Column:
    """How many of the sorted cuts a row doesn't stand before: a binary search, by nested conditions (which are compiled) or, with many cuts, in a constant array."""

    def value(v: Any, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType) and v is not None:
            return F.struct(*[value(v[f.name], f.dataType).alias(f.name) for f in kind])
        return F.lit(v).cast(kind)

    if len(cuts) <= MOST_NESTED:

        def nested(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            up = not_before(order, lambda k: value(cuts[mid][k], t.df.schema[order[k][0]].dataType))
            return F.when(up, nested(mid + 1, high)).otherwise(nested(low, mid))

        return nested(0, len(cuts))
    held = F.array(*[F.struct(*[value(c[k], t.df.schema[n].dataType).alias(f"c{k}") for k, (n, _) in enumerate(order)]) for c in cuts])
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        # the cut is fetched once a step
        up = F.transform(F.array(F.get(held, middle(s))), lambda cut: not_before(order, lambda k: cut[f"c{k}"]))[0]
        return F.when(s["lo"] >= s["hi"], s).when(up, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"])


def within(t: Table, back: bool = False) -> Any:
    """The window of a bucket in t's order, or against it; rows of a file's bucket differ in the row number alone."""
    r = quoted(ORDINAL)["r"]
    order = [r.asc() if t.order[0][1] != back else r.desc()] if in_file_order(t) else t.order_by(back)
    return Window.partitionBy(BUCKET).orderBy(*order)


def along(up: bool) -> Any:
    """The window over the table of buckets, one row each."""
    return Window.orderBy(F.col(BUCKET).asc() if up else F.col(BUCKET).desc())


def offsets(df: DataFrame, up: bool) -> DataFrame:
    """Rows before each bucket: one row a bucket, so the global window stays small."""
    return df.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along(up).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(BUCKET, "before")


def indexed(t: Table) -> DataFrame:
    """t's rows with their dense 0-based number in INDEX."""
    df, up = bucketed(t)
    return df.join(offsets(df, up), BUCKET).withColumn(INDEX, F.row_number().over(within(t)) - 1 + F.col("before")).drop(BUCKET, "before")


def with_runs(t: Table, keys: list[str], run: str) -> Table:
    """A number for each run of rows with equal keys: changes are counted in buckets, and carried on by a table of the buckets' first and last keys and changes."""
    df, up = bucketed(t)
    key, w = F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]), within(t)
    own = {x: HIDDEN + "run_" + x for x in ("key", "before", "after", "new", "at", "first", "last", "n", "base")}
    df = df.withColumn(own["key"], key)
    df = df.withColumn(own["before"], F.lag(own["key"]).over(w)).withColumn(own["after"], F.lead(F.lit(1)).over(w))
    changed = F.col(own["before"]).isNotNull() & ~F.col(own["key"]).eqNullSafe(F.col(own["before"]))
    df = df.withColumn(own["new"], changed.cast("long"))
    ends = df.groupBy(BUCKET).agg(
        F.max(F.when(F.col(own["before"]).isNull(), F.col(own["key"]))).alias(own["first"]), F.max(F.when(F.col(own["after"]).isNull(), F.col(own["key"]))).alias(own["last"]), F.sum(own["new"]).alias(own["n"])
    )
    opens = (~F.col(own["first"]).eqNullSafe(F.lag(own["last"]).over(along(up)))).cast("long")
    ends = ends.withColumn(own["at"], opens)
    base = F.sum(F.col(own["n"]) + F.col(own["at"])).over(along(up).rowsBetween(Window.unboundedPreceding, 0)) - F.col(own["n"])
    ends = ends.withColumn(own["base"], base).select(BUCKET, own["base"])
    counted = F.sum(own["new"]).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(own["base"])
    return t.keep(df.join(ends, BUCKET).select(*[quoted(c) for c in t.df.columns], counted.alias(run)))


def keep_rows(t: Table, condition: Any) -> Table:
    """Rows whose dense number satisfies condition(number)."""
    return t.keep(indexed(t).filter(condition(F.col(INDEX))).drop(INDEX))


def first_n(t: Table, n: int) -> Table:
    t.need_order()
    return t.keep(t.df.orderBy(*t.order_by()).limit(n))


def last_n(t: Table, n: int) -> Table:
    t.need_order()
    flipped = [quoted(c).desc_nulls_last() if up else quoted(c).asc_nulls_first() for c, up in t.order]
    return t.keep(t.df.orderBy(*flipped).limit(n))


def skip_while(t: Table, test: Column) -> Table:
    """Drops leading rows while the test holds: one aggregate finds the first row that fails, one filter keeps what follows."""
    t.need_order()
    bad = t.df.filter(~F.coalesce(test, F.lit(False)))
    first = bad.orderBy(*t.order_by()).limit(1).select(*[quoted(n).alias(f"{HIDDEN}at{k}") for k, (n, _) in enumerate(t.order)])
    after = not_before(t.order, lambda k: F.col(f"{HIDDEN}at{k}"))
    return t.keep(t.df.crossJoin(F.broadcast(first)).filter(after).select(*t.df.columns))


def filled(t: Table, names: list[str], down: bool) -> Table:
    """Nulls from the last value before (or after): within buckets, then from the buckets around.

    To fill up, the windows run against the order: a frame that ends with the partition is evaluated anew for each row.
    """
    df, up = bucketed(t)
    w = within(t, not down)
    filling = w.rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.last(quoted(n), ignorenulls=True).over(filling).alias(f"{HIDDEN}fill{k}") for k, n in enumerate(names)])
    keys = F.struct(*[quoted(c).alias(c) for c, _ in t.order])
    by = F.max_by if down == t.order[0][1] else F.min_by
    if len({up for _, up in t.order}) > 1:
        keys, by = F.row_number().over(w), F.max_by
        df = df.withColumn(HIDDEN + "key", keys)
        keys = F.col(HIDDEN + "key")
    ends = df.groupBy(BUCKET).agg(*[by(F.when(quoted(n).isNotNull(), F.struct(quoted(n).alias("v"))), F.when(quoted(n).isNotNull(), keys)).alias(f"{HIDDEN}end{k}") for k, n in enumerate(names)])
    across = along(up == down).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(BUCKET, *[F.last(F.col(f"{HIDDEN}end{k}"), ignorenulls=True).over(across)["v"].alias(f"{HIDDEN}carry{k}") for k in range(len(names))])
    joined = local.join(carry, BUCKET)
    keep = [quoted(c) if c not in names else F.coalesce(F.col(f"{HIDDEN}fill{names.index(c)}"), F.col(f"{HIDDEN}carry{names.index(c)}")).alias(c) for c in t.df.columns]
    return t.keep(joined.select(*keep))


def distinct_values(t: Table, name: str) -> Table:
    """The values of a column, each where it comes first. NaN equals nothing, so each NaN stays."""
    value, alone, file, row = (HIDDEN + x for x in ("value", "alone", "file", "row"))
    place = F.struct(*[quoted(n).alias(n) for n, _ in t.order]) if t.order else F.monotonically_increasing_id()
    floating = isinstance(t.df.schema[name].dataType, (T.DoubleType, T.FloatType))
    lone = F.when(F.isnan(quoted(name)), place) if floating else F.lit(0)
    df, keys = t.df.select(quoted(name).alias(value), lone.alias(alone), *[quoted(n) for n, _ in t.order]), [value, alone]
    if not t.order:
        df = df.dropDuplicates(keys)
    elif in_file_order(t):
        # in each file, then in the first of them: what meets all rows keeps one number a value
        end = F.min if t.order[0][1] else F.max
        df = df.groupBy(*keys, quoted(ORDINAL)["f"].alias(file)).agg(end(quoted(ORDINAL)["r"]).alias(row))
        df = df.groupBy(*keys).agg(end(F.struct(F.col(file).alias("f"), F.col(row).alias("r"))).alias(ORDINAL))
    else:
        df = df.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*t.order_by()))).filter(F.col(row) == 1)
    return Table(df.select(F.col(value).alias(name), *[quoted(n) for n, _ in t.order]), [name], t.order)


def rows_at(t: Table, k: int) -> Rec | None:
    """Row k as a record of values: one job."""
    got = (first_n(t, k + 1) if t.order else t).result().limit(k + 1).collect()
    if not 0 <= k < len(got):
        return None
    return record_of(t, got[k])


def record_of(t: Table, row: Any) -> Rec:
    from mlode.plans.evaluator import to_python

    kinds = t.kinds
    return Rec((c, to_python(row[c], kinds[c])) for c in t.cols)


def collect_records(ev: Any, t: Table) -> list[Rec]:
    """All rows as plan-time records: for small tables that drive a query; each row costs a step of the budget."""
    df = t.df.orderBy(*t.order_by()) if t.order else t.df
    rows = df.select(*[quoted(c) for c in t.cols]).limit(ev.ctx.steps + 1).collect()
    ev.ctx.tick(len(rows))
    return [record_of(t, r) for r in rows]


def add_index(t: Table, name: str, start: float, step: float) -> Table:
    df = indexed(t)
    value = (F.col(INDEX) * F.lit(step) + F.lit(start)) if isinstance(start, float) or isinstance(step, float) else (F.col(INDEX) * F.lit(step) + F.lit(start)).cast("long")
    out = df.select(*[quoted(c) for c in t.cols], value.alias(name), *[quoted(h) for h in t.hidden()])
    return Table(out, [*t.cols, name], t.order, t.explicit)

