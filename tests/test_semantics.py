"""Edge tables: nulls, duplicates, empty tables, ragged rows, order."""

import datetime as dt

import pytest

from mlode.plans.errors import EvalError, UnsupportedError

SHIPS = [(7, "Alba"), (9, "Bora"), (7, "Cala"), (None, "Dune"), (4, "Esk"), (9, "Fjord")]
DOCKS = [(9, "north"), (7, "south"), (5, "east"), (None, "yard"), (9, "west"), (None, "slip")]


def m_table(names, rows):
    """#table(...) of plain rows."""
    cell = lambda v: "null" if v is None else f'"{v}"' if isinstance(v, str) else str(v)
    return "#table({" + ", ".join(f'"{n}"' for n in names) + "}, {" + ", ".join("{" + ", ".join(map(cell, r)) + "}" for r in rows) + "})"


LEFT, RIGHT = m_table(("port", "ship"), SHIPS), m_table(("harbour", "dock"), DOCKS)


def joined(kind):
    """The join by definition: every pair of equal keys that aren't null, then the lone rows that the kind keeps."""
    pairs = [(*a, *b) for a in SHIPS for b in DOCKS if a[0] is not None and a[0] == b[0]]
    left = [(*a, None, None) for a in SHIPS if not any(p[:2] == a for p in pairs)]
    right = [(None, None, *b) for b in DOCKS if not any(p[2:] == b for p in pairs)]
    return {"Inner": pairs, "LeftOuter": pairs + left, "RightOuter": pairs + right, "FullOuter": pairs + left + right, "LeftAnti": left, "RightAnti": right}[kind]


@pytest.mark.parametrize("kind", ["Inner", "LeftOuter", "RightOuter", "FullOuter", "LeftAnti", "RightAnti"])
def test_join_kinds(m, kind):
    got = [tuple(r.values()) for r in m(f'Table.Join({LEFT}, "port", {RIGHT}, "harbour", JoinKind.{kind})')]
    assert sorted(got, key=str) == sorted(joined(kind), key=str)


def test_nested_join_equals_join(m):
    nest = lambda kind: f'Table.NestedJoin({LEFT}, "port", {RIGHT}, "harbour", "docks", JoinKind.{kind})'
    flat = m(f'Table.ExpandTableColumn({nest("LeftOuter")}, "docks", {{"harbour", "dock"}})')
    assert sorted((tuple(r.values()) for r in flat), key=str) == sorted(joined("LeftOuter"), key=str)
    counted = lambda kind: m(f'Table.RemoveColumns(Table.AddColumn({nest(kind)}, "k", each Table.RowCount([docks])), {{"docks"}})')
    assert {r["ship"]: r["k"] for r in counted("LeftOuter")} == {"Alba": 1, "Bora": 2, "Cala": 1, "Dune": 0, "Esk": 0, "Fjord": 2}
    assert sorted(((r["ship"], r["k"]) for r in counted("FullOuter")), key=str) == sorted([("Alba", 1), ("Bora", 2), ("Cala", 1), ("Dune", 0), ("Esk", 0), ("Fjord", 2), (None, 3)], key=str)


def test_join_collisions(m):
    t = m_table(("code", "rate"), [(31, 0.5)])
    assert m(f'let t = {t} in Table.Join(t, "code", t, "code")') == [{"code": 31, "rate": 0.5, "code.1": 31, "rate.1": 0.5}]


RUNS = "#table({\"k\", \"v\"}, {{\"B\", 1}, {\"A\", 2}, {\"B\", 3}, {\"A\", 4}})"


def test_group_kinds(m):
    total = "{{\"s\", each List.Sum([v])}}"
    assert sorted((r["k"], r["s"]) for r in m(f"Table.Group({RUNS}, \"k\", {total})")) == [("A", 6), ("B", 4)]
    assert sorted((r["k"], r["s"]) for r in m(f"Table.Group({RUNS}, \"k\", {total}, GroupKind.Local)")) == [("A", 2), ("A", 4), ("B", 1), ("B", 3)]


def test_nulls_group_together(m):
    got = m("Table.Group(#table({\"k\", \"v\"}, {{null, 1}, {null, 2}, {\"a\", 3}}), \"k\", {{\"n\", each Table.RowCount(_)}})")
    assert {(r["k"], r["n"]) for r in got} == {(None, 2), ("a", 1)}


def test_strict_nulls(m):
    t = "#table({\"v\"}, {{1}, {null}})"
    assert [r["w"] for r in m(f"Table.AddColumn({t}, \"w\", each [v] + 1)")] == [2, None]
    for text in (f"Table.AddColumn({t}, \"w\", each [v] + 1)", f"Table.SelectRows({t}, each [v] > 0)", f"Table.Group({t}, {{}}, {{{{\"s\", each List.Sum([v])}}}})"):
        with pytest.raises(Exception):
            m(text, nulls="strict")


def test_fill_and_order(m):
    t = "#table({\"a\"}, {{1}, {null}, {null}, {3}, {null}})"
    assert sorted([r["a"] for r in m(f"Table.FillDown({t}, {{\"a\"}})")]) == [1, 1, 1, 3, 3]
    assert [r["a"] for r in m("Table.Sort(Table.FillUp(#table({\"a\", \"i\"}, {{null, 1}, {null, 2}, {3, 3}, {null, 4}, {5, 5}}), {\"a\"}), \"i\")")] == [3, 3, 3, 5, 5]
    assert [r["a"] for r in m("Table.Sort(Table.FirstN(#table({\"a\"}, {{3}, {1}, {2}}), 2), \"a\")")] == [1, 3]
    assert [r["a"] for r in m("Table.Sort(#table({\"a\"}, {{3}, {null}, {2}}), {\"a\", Order.Descending})")] == [3, 2, None]
    assert sorted(r["a"] for r in m("Table.LastN(#table({\"a\"}, {{3}, {1}, {2}}), 9)")) == [1, 2, 3]
    with pytest.raises(EvalError):
        m("Table.FirstN(#table({\"a\"}, {{3}}), -1)")


def test_distinct_keeps_the_first(m):
    got = m("Table.Distinct(#table({\"k\", \"v\"}, {{1, \"x\"}, {2, \"y\"}, {1, \"z\"}, {null, \"p\"}, {null, \"q\"}}), {\"k\"})")
    assert {(r["k"], r["v"]) for r in got} == {(1, "x"), (2, "y"), (None, "p")}
    assert len(m("Table.SelectDuplicates(#table({\"a\"}, {{1}, {2}, {1}, {3}, {1}}))")) == 3


def test_pivot_and_unpivot(m):
    t = "#table({\"Region\", \"Category\", \"Amount\"}, {{\"East\", \"A\", 10}, {\"East\", \"B\", 20}, {\"West\", \"A\", 30}})"
    assert {(r["Region"], r["A"], r["B"]) for r in m(f"Table.Pivot({t}, {{\"A\", \"B\"}}, \"Category\", \"Amount\")")} == {("East", 10, 20), ("West", 30, None)}
    twice = f"Table.Combine({{{t}, #table({{\"Region\", \"Category\", \"Amount\"}}, {{{{\"East\", \"A\", 15}}}})}})"
    with pytest.raises(Exception):
        m(f"Table.Pivot({twice}, {{\"A\"}}, \"Category\", \"Amount\")")
    assert {r["Region"]: r["A"] for r in m(f"Table.Pivot({twice}, {{\"A\"}}, \"Category\", \"Amount\", List.Sum)")}["East"] == 25
    melt = m("Table.UnpivotOtherColumns(#table({\"key\", \"a\", \"b\", \"c\"}, {{\"x\", 1, null, 3}, {\"y\", 2, 4, null}}), {\"key\"}, \"n\", \"v\")")
    assert {(r["key"], r["n"], r["v"]) for r in melt} == {("x", "a", 1), ("x", "c", 3), ("y", "a", 2), ("y", "b", 4)}


def test_transpose_split_headers(m):
    assert m("Table.Transpose(#table({\"Name\", \"Value\"}, {{\"width\", \"18 m\"}, {\"depth\", \"6 m\"}, {\"draft\", null}}))") == [{"Column1": "width", "Column2": "depth", "Column3": "draft"}, {"Column1": "18 m", "Column2": "6 m", "Column3": None}]
    got = m("Table.SplitColumn(#table({\"crew\"}, {{\"mate:deck:2\"}, {null}, {\"cook\"}, {\"pilot:bridge\"}}), \"crew\", Splitter.SplitTextByDelimiter(\":\"), 2)")
    assert [(r["crew.1"], r["crew.2"]) for r in got] == [("mate", "deck"), (None, None), ("cook", None), ("pilot", "bridge")]
    assert m("Table.PromoteHeaders(#table(null, {{\"a\", \"a\", null}, {\"1\", \"2\", \"3\"}}))") == [{"a": "1", "a.1": "2", "Column3": "3"}]
    assert m("Splitter.SplitTextByEachDelimiter({\",\", \";\"})(\"a,b;c;d\")") == ["a", "b", "c;d"]
    assert m("Splitter.SplitTextByDelimiter(\",\")(\"a,\"\"b,c\"\",d\")") == ["a", "b,c", "d"]
    assert m("Splitter.SplitTextByPositions({0, 2, 3})(\"abcdef\")") == ["ab", "c", "def"]


def test_empty_tables_keep_their_schema(spark):
    from mlode.api import run

    none = spark.createDataFrame([], "k string, v double")
    for body in (
        "Table.SelectRows(t, each [v] > 1)", "Table.Group(t, \"k\", {{\"s\", each List.Sum([v])}})", "Table.Sort(t, \"k\")", "Table.FillDown(t, {\"v\"})", "Table.AddIndexColumn(t, \"i\")",
        "Table.Distinct(t, {\"k\"})", "Table.Unpivot(t, {\"v\"}, \"a\", \"b\")", "Table.Skip(t, 1)", "Table.Combine({t, t})", "Table.Join(t, \"k\", Table.RenameColumns(t, {{\"k\", \"q\"}, {\"v\", \"w\"}}), \"q\")",
    ):
        out = run(spark, body, {"t": none})
        assert out.columns and out.count() == 0, body


@pytest.mark.parametrize(
    "text, value",
    [
        ("Text.AfterDelimiter(\"a-b-c\", \"-\", 1)", "c"), ("Text.BeforeDelimiter(\"abc\", \"-\")", "abc"), ("Text.AfterDelimiter(\"abc\", \"-\")", ""), ("Text.BetweenDelimiters(\"a(b)c\", \"(\", \")\")", "b"),
        ("Text.PadStart(\"abc\", 2)", "abc"), ("Text.End(\"abc\", 9)", "abc"), ("Text.Proper(\"o'neil the 2nd\")", "O'Neil The 2Nd"), ("Text.From(true)", "TRUE"), ("Text.From(2.0)", "2"), ("Text.From(0.0000001)", "1e-07"),
        ("Text.From(0.0001)", "0.0001"), ("Text.From(12345678901.5)", "12345678901.5"), ("Text.PositionOf(\"aXbX\", \"X\", Occurrence.Last)", 3), ("Text.PositionOfAny(\"hello\", {\"l\", \"o\"}, Occurrence.All)", [2, 3, 4]),
        ("Text.Trim(\"xxaxx\", \"x\")", "a"), ("Text.ToList(\"ab\")", ["a", "b"]), ("Number.From(\"0x1A\")", 26), ("Number.Round(2.5)", 2), ("Number.RoundAwayFromZero(-1.2)", -2), ("Number.Mod(-7, 3)", -1), ("Number.IntegerDivide(-7, 2)", -3),
        ("Number.Factorial(5)", 120), ("Number.Log(8, 2)", 3), ("List.Mode({1, 2, 2, 1})", 2), ("List.Percentile({1, 2, 3, 4}, 0.25)", 1.75), ("List.Difference({1, 1, 2}, {2})", [1, 1]), ("List.LastN({1, 2, 3}, 5)", [1, 2, 3]),
        ("List.Zip({{1, 2}, {3}})", [[1, 3], [2, None]]), ("List.FirstN({1, 2, 9, 1}, each _ < 5)", [1, 2]), ("List.Accumulate({1, 2, 3}, 0, (s, x) => s + x)", 6), ("Record.ReorderFields([a = 1, b = 2, c = 3], {\"c\", \"a\"})", {"c": 3, "b": 2, "a": 1}),
        ("Record.FieldOrDefault([a = 1], \"z\", 9)", 9), ("Date.AddMonths(#date(2024, 1, 31), 1)", dt.date(2024, 2, 29)), ("Date.WeekOfYear(#date(2024, 1, 7))", 2), ("Date.DayOfWeek(#date(2024, 1, 7), Day.Monday)", 6),
        ("Date.ToText(#date(2024, 3, 5), \"d/M/yy ddd\")", "5/3/24 Tue"), ("Date.From(45000)", dt.date(2023, 3, 15)), ("Duration.ToText(#duration(-1, -2, 0, 0))", "-1.02:00:00"), ("Duration.Hours(#duration(1, 30, 0, 0))", 6), ("Time.Hour(0.5)", 12),
        ("DateTime.ToText(#datetime(2024, 1, 2, 3, 4, 5))", "2024-01-02 03:04:05"), ("Time.ToText(#time(13, 5, 0), \"h:mm tt\")", "1:05 PM"), ("Duration.TotalHours(#duration(1, 12, 0, 0))", 36), ("Value.Compare(null, 1)", -1),
        ("Date.EndOfMonth(#datetime(2024, 2, 3, 4, 5, 6))", dt.datetime(2024, 2, 29)), ("Value.Is(1, Int64.Type)", True), ("Type.Is(Int64.Type, type number)", True), ("Binary.ToText(#binary({1, 255}), BinaryEncoding.Hex)", "01FF"), ("Json.Document(\"{\"\"a\"\": [1, null]}\")[a]", [1, None]),
    ],
)
def test_scalars(m, text, value):
    assert m(text) == value


def test_conversion_errors(m):
    with pytest.raises(Exception):
        m("Table.TransformColumnTypes(#table({\"a\"}, {{\"x\"}}), {{\"a\", Int64.Type}})")
    with pytest.raises(Exception):
        m("Table.TransformColumnTypes(#table({\"a\"}, {{\"300\"}}), {{\"a\", Byte.Type}})")
    assert m("Table.TransformColumnTypes(#table({\"a\"}, {{\" 12.5 \"}, {null}}), {{\"a\", Int64.Type}})") == [{"a": 12}, {"a": None}]
    with pytest.raises(UnsupportedError):
        m("Table.TransformColumnTypes(#table({\"a\"}, {{\"x\"}}), {{\"a\", type binary}})")
    with pytest.raises(UnsupportedError):
        m("Date.MonthName(#date(2024, 1, 1), \"fr-FR\")")


def test_mode_of_groups(spark):
    """Counts of values, not gathered lists; ties, nulls, conditions and expressions."""
    import random
    from collections import Counter

    from mlode.api import run

    r = random.Random(1)
    rows = [(k, r.choice([None, 1, 2, 3]), r.choice([None, "a", "b", "c"]), r.random()) for k in range(200)]

    def mode(v):
        count, first = Counter(v), {x: k for k, x in reversed(list(enumerate(v)))}
        return max(count, key=lambda x: (count[x], first[x])) if v else None

    sets = """{{"m", each List.Mode([v])}, {"n", each Table.RowCount(_)}, {"x", each Text.From(List.Mode([v])) & "/" & Text.From(Table.RowCount(_))},
      {"c", each List.Mode(Table.SelectRows(_, each [w] > 0.95)[v])}, {"s", each List.Mode(List.Select([v], each _ <> "a"))}}"""
    df = spark.createDataFrame(rows, "id long, g long, v string, w double").repartition(3)
    out = run(spark, "Table.Group(Table.Sort(t, {\"id\"}), {\"g\"}, " + sets + ")", {"t": df})
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["g", "m", "n", "x", "c", "s"]
    got = {x["g"]: tuple(x)[1:] for x in out.collect()}
    for g in (None, 1, 2, 3):
        mine = [x for x in rows if x[1] == g]
        v = [x[2] for x in mine]
        m = mode(v)
        assert got[g] == (m, len(v), None if m is None else f"{m}/{len(v)}", mode([x[2] for x in mine if x[3] > 0.95]), mode([x for x in v if x != "a"]))
    runs = run(spark, "Table.Group(Table.Sort(t, {\"id\"}), {\"g\"}, {{\"m\", each List.Mode([v])}}, GroupKind.Local)", {"t": df})
    assert runs.count() == 1 + sum(a[1] != b[1] for a, b in zip(rows, rows[1:]))
    assert [x["m"] for x in run(spark, "Table.Group(Table.Sort(t, {\"id\"}), {}, {{\"m\", each List.Mode([v])}})", {"t": df}).collect()] == [mode([x[2] for x in rows])]


JSON_ROWS = [(1, '{"a": "x", "n": 1.5, "t": true, "z": null, "o": {"h": [1, "q"]}}'), (2, '{"a": "7", "n": 7, "t": false, "o": {"h": []}}'), (3, None), (4, '{"a": 7}')]


def test_json_columns_keep_the_kind_of_values(spark):
    from mlode.api import run

    df = spark.createDataFrame(JSON_ROWS, "id long, j string")
    read = 'let d = Table.AddColumn(t, "v", each Json.Document([j])) in '

    def got(body, name="y"):
        return {r["id"]: r[name] for r in run(spark, read + body, {"t": df}).collect()}

    assert set(got('Table.SelectRows(d, each [v][a] = "x")', "id")) == {1}
    assert set(got("Table.SelectRows(d, each [v][a] = 7)", "id")) == {4}
    assert got('Table.AddColumn(d, "y", each [v][a]?, type text)') == {1: "x", 2: "7", 3: None, 4: "7"}
    assert got('Table.AddColumn(d, "y", each [v][z]? = null)') == {1: True, 2: True, 3: True, 4: True}
    assert got('Table.AddColumn(d, "y", each try Text.Upper([v][a]) otherwise "no text")') == {1: "X", 2: "7", 3: None, 4: "no text"}
    assert got('Table.AddColumn(d, "y", each try [v][n] + 1 otherwise -1)') == {1: 2.5, 2: 8.0, 3: None, 4: -1.0}
    assert got('Table.AddColumn(d, "y", each try (if [v][t] then "yes" else "no") otherwise "?")') == {1: "yes", 2: "no", 3: "no", 4: "?"}
    assert got('Table.AddColumn(d, "y", each try [v][o][h]{1} & "!" otherwise "none")') == {1: "q!", 2: "none", 3: None, 4: "none"}
    for body in ('Table.AddColumn(d, "y", each [v][none], type text)', "Table.SelectRows(d, each [v][a] > 3)", 'Table.AddColumn(d, "y", each Text.Upper([v][a]))'):
        with pytest.raises(Exception):
            run(spark, read + body, {"t": df}).collect()
    with pytest.raises(UnsupportedError):
        run(spark, read + "Table.SelectRows(d, each [v][a] = [v][n])", {"t": df})


def test_try_catches_failures_not_nulls(m):
    t = m_table(("a", "s"), [(1, "5"), (0, "x"), (None, None), (2, "")])
    col = lambda body: [r["y"] for r in m(f'Table.AddColumn({t}, "y", each {body})')]
    assert col('try Text.At([s], 0) otherwise "none"') == ["5", "x", None, None]
    assert col("try Number.From([s]) otherwise -1") == [5.0, -1.0, None, -1.0]
    assert col("try 6 / [a] otherwise -1") == [6.0, -1.0, None, 3.0]
    assert col("let q = 6 / [a] in try q otherwise -1") == [6.0, -1.0, None, 3.0]
    assert col("if [a] = 0 then 9 else try 6 / [a] otherwise -1") == [6.0, 9.0, None, 3.0]
    assert col("try (if [a] = 0 then 9 else 6 / [a]) otherwise -1") == [6.0, 9.0, None, 3.0]
    assert col("try ([a] = 0 or 6 / [a] > 3) otherwise false") == [True, True, None, False]
    assert col("try {10, 20}{[a]} otherwise -1") == [20, 10, None, -1]
    assert col("try (try 6 / [a] otherwise Number.From([s])) otherwise -1") == [6.0, -1.0, None, 3.0]


@pytest.mark.parametrize("text, value", [("Number.Round(2.675, 2)", 2.67), ("Number.Round(-2.675, 2)", -2.67), ("Number.Round(0.125, 2)", 0.12), ("Number.Round(1.005, 2)", 1.0), ("Number.Round(25, -1)", 20), ("Number.Round(35, -1)", 40), ("Number.Round(1e300, 3)", 1e300)])
def test_round_takes_the_binary_value(m, text, value):
    assert m(text) == value


def test_positions_by_any_order(spark):
    """Dense numbers, fills and runs over several buckets: reversed files, sorts with a hot leading key, nulls and both directions."""
    import random

    from mlode.api import run
    from mlode.operators import positional as P

    r = random.Random(3)
    rows = [(k, r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, None, 1, 2])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(4)
    low = lambda x: (x is not None, x)
    orders = {
        '{"id"}': sorted(rows), '{"g", "id"}': sorted(rows, key=lambda x: (low(x[1]), x[0])),
        '{{"g", Order.Descending}, {"id", Order.Ascending}}': sorted(sorted(rows), key=lambda x: low(x[1]), reverse=True),
    }
    orders['{{"g", Order.Descending}, {"id", Order.Ascending}}'] = [x for g in ("hot", "a", None) for x in sorted(rows) if x[1] == g]
    before = P.BUCKET_ROWS, P.MOST_NESTED
    P.BUCKET_ROWS = 256
    try:
        for keys, want in orders.items():
            for back in (False, True):
                P.MOST_NESTED = 0 if back else 128  # both ways to find a range
                t = f"Table.Sort(t, {keys})"
                t, seq = (f"Table.ReverseRows({t})", want[::-1]) if back else (t, want)
                got = run(spark, f'Table.AddIndexColumn({t}, "i")', {"t": df})
                assert f"hashpartitioning({P.BUCKET}" in got._jdf.queryExecution().executedPlan().toString()
                assert {x["id"]: x["i"] for x in got.collect()} == {x[0]: k for k, x in enumerate(seq)}
                last, filled = None, {}
                for x in seq:
                    last = x[2] if x[2] is not None else last
                    filled[x[0]] = last
                assert {x["id"]: x["v"] for x in run(spark, f'Table.FillDown({t}, {{"v"}})', {"t": df}).collect()} == filled
                runs = 1 + sum(a[1] != b[1] for a, b in zip(seq, seq[1:]))
                sizes = run(spark, f'Table.Group({t}, {{"g"}}, {{{{"n", each Table.RowCount(_)}}}}, GroupKind.Local)', {"t": df}).collect()
                assert len(sizes) == runs and sum(x["n"] for x in sizes) == len(rows)
    finally:
        P.BUCKET_ROWS, P.MOST_NESTED = before


def test_positions_of_files_in_both_directions(spark, tmp_path):
    from mlode.api import run
    from mlode.operators import positional as P

    path = str(tmp_path / "t.parquet")
    spark.range(5000).selectExpr("id", "id div 700 as g").coalesce(1).write.parquet(path)
    before, P.BUCKET_ROWS = P.BUCKET_ROWS, 512
    try:
        up = run(spark, 'Table.AddIndexColumn(t, "i")', {"t": path}).collect()
        down = run(spark, 'Table.AddIndexColumn(Table.ReverseRows(t), "i")', {"t": path}).collect()
        kept = run(spark, 'Table.AddIndexColumn(Table.SelectRows(t, each Number.Mod([id], 3) = 0), "i")', {"t": path}).collect()
        local = run(spark, 'Table.Group(Table.ReverseRows(t), {"g"}, {{"n", each Table.RowCount(_)}}, GroupKind.Local)', {"t": path}).collect()
    finally:
        P.BUCKET_ROWS = before
    assert all(x["i"] == x["id"] for x in up) and all(x["i"] == 4999 - x["id"] for x in down) and all(3 * x["i"] == x["id"] for x in kept)
    assert {x["g"]: x["n"] for x in local} == {g: min(700, 5000 - 700 * g) for g in range(8)}


def test_a_column_used_as_a_list_is_bounded(spark):
    from mlode.api import evaluate
    from mlode.plans import evaluator as E

    before, E.STEPS = E.STEPS, 100
    try:
        with pytest.raises(UnsupportedError):
            evaluate(spark, 'List.FirstN(t[id], each _ < 5)', {"t": spark.range(1000)})
    finally:
        E.STEPS = before


def test_percentiles_of_groups_come_from_counts(spark):
    import random

    from mlode.api import run

    r = random.Random(9)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, *range(20)])) for _ in range(300)] + [("lone", 4), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    body = """{{"m", each List.Median([v])}, {"p", each List.Percentile([v], {0, 0.3, 1})}, {"x", each List.Percentile([v], 0.9) + Table.RowCount(_)}}"""
    out = run(spark, 'Table.Group(t, {"g"}, ' + body + ")", {"t": df})
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()

    def share(v, p):
        at = p * (len(v) - 1)
        low = int(at)
        return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)

    for x in out.collect():
        v = sorted(b for a, b in rows if a == x["g"] and b is not None)
        n = sum(a == x["g"] for a, _ in rows)
        if v:
            assert abs(x["m"] - share(v, 0.5)) < 1e-9 and all(abs(a - share(v, p)) < 1e-9 for a, p in zip(x["p"], (0, 0.3, 1))) and abs(x["x"] - share(v, 0.9) - n) < 1e-9
        else:
            assert x["m"] is None and x["x"] is None


def test_distinct_values_of_groups_are_counted_without_a_list(spark):
    from mlode.api import run

    rows = [("a", x, k) for k, x in enumerate([0.0, -0.0, 1.5, None, None, 1.5, float("nan"), float("nan")])] + [("b", None, 8), (None, 2.0, 9), (None, 3.0, 10)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    body = """{{"n", each List.Count(List.Distinct([v]))}, {"some", each List.Count(List.Distinct(List.RemoveNulls([v]))) + Table.RowCount(_)}, {"med", each List.Median([v])}}"""
    for t in ("t", 'Table.Sort(t, {{"id", Order.Descending}})'):
        out = run(spark, f'Table.Group({t}, {{"g"}}, {body})', {"t": df})
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {x["g"]: (x["n"], x["some"]) for x in out.collect()} == {"a": (4, 11), "b": (1, 1), None: (2, 4)}
    listed = run(spark, 'Table.Group(t, {"g"}, {{"v", each List.Distinct([v])}, {"first", each List.First(List.Distinct([v]))}})', {"t": df.coalesce(1)}).collect()
    assert {x["g"]: x["v"] for x in listed if x["g"] != "a"} == {"b": [None], None: [2.0, 3.0]} and [x["first"] for x in listed if x["g"] == "a"] == [0.0]
    cells = run(spark, 'Table.Pivot(Table.SelectColumns(t, {"g", "v"}), {"a", "b"}, "g", "v", each List.Count(List.Distinct(_)))', {"t": df}).collect()
    assert [x.asDict() for x in cells] == [{"a": 4, "b": 1}]


def test_fill_up_takes_one_pass(spark, tmp_path):
    """Against the order of sorts and files, over several buckets; no frame that ends with its partition, which costs the square of a bucket."""
    import random

    from mlode.api import run
    from mlode.operators import positional as P

    r = random.Random(5)
    rows = [(k, r.choice(["hot", "hot", "a", None]), r.choice([None, None, None, 1, 2]), r.choice([None, "x", "y"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long, w string")
    path = str(tmp_path / "t.parquet")
    df.coalesce(1).write.parquet(path)
    low = lambda x: (x is not None, x)
    orders = {
        "t": rows, 'Table.Sort(t, {"id"})': rows, 'Table.Sort(t, {"g", "id"})': sorted(rows, key=lambda x: (low(x[1]), x[0])),
        'Table.Sort(t, {{"g", Order.Descending}, {"id", Order.Ascending}})': [x for g in ("hot", "a", None) for x in rows if x[1] == g],
    }
    before, P.BUCKET_ROWS = P.BUCKET_ROWS, 256
    try:
        for t, want in orders.items():
            for t, seq in ((t, want), (f"Table.ReverseRows({t})", want[::-1])):
                out = run(spark, f'Table.FillUp({t}, {{"v", "w"}})', {"t": path})
                assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
                last, filled = (None, None), {}
                for x in seq[::-1]:
                    last = tuple(a if a is not None else b for a, b in zip(x[2:], last))
                    filled[x[0]] = last
                assert {x["id"]: (x["v"], x["w"]) for x in out.collect()} == filled
    finally:
        P.BUCKET_ROWS = before


def test_distinct_values_of_a_column_cost_a_step_each(spark, tmp_path):
    """In the order of their first rows, whatever the number of rows."""
    from mlode.api import evaluate, run
    from mlode.plans import evaluator as E

    path, rows = str(tmp_path / "t.parquet"), [("c", 1.0), ("a", None), (None, 2.0), ("b", 1.0), ("a", 3.0), ("c", None), (None, 2.0)] * 200
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "id long, g string, v double")
    df.coalesce(1).write.parquet(path)
    nan = spark.createDataFrame([(0, float("nan")), (1, 1.0), (2, float("nan")), (3, 1.0), (4, -0.0), (5, 0.0)], "id long, v double").coalesce(1)
    before, E.STEPS = E.STEPS, 100
    try:
        wants = {"t": ["c", "a", None, "b"], "Table.ReverseRows(t)": [None, "c", "a", "b"], 'Table.Sort(t, {"g", "id"})': [None, "a", "b", "c"], 'Table.Sort(t, {{"v", Order.Descending}, {"id", Order.Ascending}})': ["a", None, "c", "b"]}
        for t, want in wants.items():
            assert evaluate(spark, f"List.Distinct({t}[g])", {"t": path}) == want
        assert evaluate(spark, "List.Distinct(t[v])", {"t": path}) == [1, None, 2, 3]
        assert evaluate(spark, "List.Distinct(t[v])", {"t": df.limit(0)}) == []
        for t in ("t", 'Table.Sort(t, {"id"})'):
            some = evaluate(spark, f"List.Distinct({t}[v])", {"t": nan})
            assert [str(x) for x in some] in (["nan", "1.0", "nan", "-0.0"], ["nan", "1.0", "nan", "0.0"])
        with pytest.raises(UnsupportedError):
            evaluate(spark, "List.Distinct(t[id])", {"t": path})
        text = 'let G = Table.Group(t, {"v", "g"}, {{"n", each Table.RowCount(_)}}) in Table.Pivot(G, List.RemoveNulls(List.Distinct(t[g])), "g", "n")'
        pivoted = run(spark, text, {"t": path})
        assert pivoted.columns == ["v", "c", "a", "b"]
        assert {x["v"]: (x["c"], x["a"], x["b"]) for x in pivoted.collect()} == {1: (200, None, 200), None: (200, 200, None), 2: (None, None, None), 3: (None, 200, None)}
    finally:
        E.STEPS = before
