"""End-to-end queries from files, containers and streams; plans."""

import base64
import io
import json
import struct
import zipfile
import zlib

import pytest

from mlode.plans.errors import EvalError, UnsupportedError


def test_clean_and_type_from_csv(m, tmp_path):
    rows = ["OrderID,Customer,Amount,OrderDate", "1,Ann,100.00,2024-01-05", "2,\"Bo, Jr\",250.50,2024-02-01", "3,Cy,99,2024-03-01", "4,Di,120,2024-04-01"]
    (tmp_path / "sales.csv").write_text("\n".join(rows) + "\n")
    got = m(f"""let Source = Csv.Document(File.Contents("{tmp_path}/sales.csv"), [Delimiter = ",", Encoding = 65001]), Head = Table.PromoteHeaders(Source),
      Typed = Table.TransformColumnTypes(Head, {{{{"OrderID", Int64.Type}}, {{"Amount", type number}}, {{"OrderDate", type date}}}}), Kept = Table.SelectRows(Typed, each [Amount] > 100),
      Named = Table.RenameColumns(Kept, {{{{"Customer", "CustomerName"}}}}), Tax = Table.AddColumn(Named, "WithTax", each [Amount] * 1.08), Out = Table.Sort(Tax, {{{{"Amount", Order.Descending}}}}) in Out""")
    assert [(r["OrderID"], r["CustomerName"], round(r["WithTax"], 6)) for r in got] == [(2, "Bo, Jr", 270.54), (4, "Di", 129.6)]


def test_csv_edges(m, tmp_path):
    (tmp_path / "a.csv").write_text("a#|#b#|#c\n1#|#2\n\"x#|#y\"#|#\"say \"\"hi\"\"\"#|#\n")
    got = m(f"Csv.Document(File.Contents(\"{tmp_path}/a.csv\"), [Delimiter = \"#|#\"])")
    assert [list(r.values()) for r in got] == [["a", "b", "c"], ["1", "2", None], ["x#|#y", "say \"hi\"", ""]]
    assert m("Csv.Document(\"a,b#(lf)\"\"p,q\"\",r\")") == [{"Column1": "a", "Column2": "b"}, {"Column1": "p,q", "Column2": "r"}]
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        m(f"Csv.Document(File.Contents(\"{tmp_path}/long.csv\"))")
    assert len(m(f"Csv.Document(File.Contents(\"{tmp_path}/long.csv\"), null, \",\", ExtraValues.Ignore)")) == 2
    (tmp_path / "w.csv").write_bytes("name\ncafé\n".encode("cp1252"))
    assert [r["Column1"] for r in m(f"Csv.Document(File.Contents(\"{tmp_path}/w.csv\"), [Encoding = 1252])")] == ["name", "café"]
    (tmp_path / "e.csv").write_bytes("price;note\n5 €;“so”\n7 €;Ž\n".encode("cp1252"))
    got = m(f"Csv.Document(File.Contents(\"{tmp_path}/e.csv\"), [Delimiter = \";\", Encoding = 1252])")
    assert [list(r.values()) for r in got] == [["price", "note"], ["5 €", "“so”"], ["7 €", "Ž"]]
    (tmp_path / "bad.csv").write_bytes(b"x\x81y\n")
    with pytest.raises(Exception):
        m(f"Csv.Document(File.Contents(\"{tmp_path}/bad.csv\"), [Encoding = 1252])")
    with pytest.raises(EvalError):
        m("Csv.Document(File.Contents(\"/nowhere.csv\"))")
    with pytest.raises(UnsupportedError):
        m("Csv.Document(\"a\", [Nope = 1])")


def test_inline_table(m):
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = packed.compress(json.dumps([["East", "100"], ["West", "200"]]).encode()) + packed.flush()
    text = base64.b64encode(raw).decode()
    got = m(f"Table.FromRows(Json.Document(Binary.Decompress(Binary.FromText(\"{text}\", BinaryEncoding.Base64), Compression.Deflate)), type table [Region = text, Amount = text])")
    assert got == [{"Region": "East", "Amount": "100"}, {"Region": "West", "Amount": "200"}]


def test_unpivot_dates(m):
    got = m("""let T = #table({"Region", "OrderDate", "A", "B"}, {{"East", #date(2024, 1, 5), 10, 0}, {"West", #date(2024, 2, 6), 5, 7}}), U = Table.UnpivotOtherColumns(T, {"Region", "OrderDate"}, "Category", "Revenue"),
      F = Table.SelectRows(U, each [Revenue] <> 0), Y = Table.AddColumn(F, "Year", each Date.Year([OrderDate])), N = Table.AddColumn(Y, "Month Name", each Date.MonthName([OrderDate])) in N""")
    assert {(r["Region"], r["Category"], r["Revenue"], r["Year"], r["Month Name"]) for r in got} == {("East", "A", 10, 2024, "January"), ("West", "A", 5, 2024, "February"), ("West", "B", 7, 2024, "February")}


def test_stored_queries(tmp_path, spark):
    from mlode.api import section_member
    from mlode.sources.containers import read_section

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Formulas/Section1.m", "section Section1; shared Q = let x = 2 in x * 21;")
    blob = struct.pack("<II", 0, len(inner.getvalue())) + inner.getvalue()
    with zipfile.ZipFile(tmp_path / "r.pbix", "w") as z:
        z.writestr("DataMashup", blob)
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("customXml/item1.xml", f"<DataMashup xmlns=\"x\">{base64.b64encode(blob).decode()}</DataMashup>")
    for name in ("r.pbix", "r.xlsx"):
        assert section_member(spark, read_section(str(tmp_path / name)), "Q") == 42


def test_streams(spark, tmp_path):
    from mlode.api import run
    from mlode.streaming import run_stream, windowed

    spark.createDataFrame([(1, "2024-01-01 00:00:10", 5.0), (2, "2024-01-01 00:07:00", 7.0)], "id long, ts string, v double").selectExpr("id", "cast(ts as timestamp) ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = run_stream(spark, "Table.AddColumn(Table.SelectRows(s, each [v] > 5), \"w\", each [v] * 2)", "s", stream)
    query = out.writeStream.format("memory").queryName("mstream").start()
    query.processAllAvailable()
    query.stop()
    assert [r["w"] for r in spark.sql("SELECT w FROM mstream").collect()] == [14.0]
    assert windowed(stream, "ts", "5 minutes", "10 minutes").isStreaming
    with pytest.raises(UnsupportedError):
        run(spark, "Table.FirstN(s, 1)", {"s": stream})


def test_plans(spark):
    """The flagship scans what it needs, filters in the scan, and runs no Python."""
    from mlode.plans.catalog import flagship

    plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "HashAggregate" in plan
    assert "l_comment" not in plan and "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<l_quantity" in plan


@pytest.mark.parametrize("name", ["flagship", "join_fullouter", "group_local", "fill_down", "index_column", "pivot_sum", "text_search", "date_parts", "list_sets", "split_each"])
def test_oracles(spark, name):
    """A few registered queries against their SQL; the driver compares all of them."""
    import duckdb

    from mlode.plans.catalog import CATALOG, TABLES, run_m

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    m, sql = CATALOG[name]
    df = run_m(spark, "/root/testdata/sf0.001", m)
    got = con.execute(sql)
    at = {d[0]: k for k, d in enumerate(got.description)}
    cols = sorted(df.columns)
    assert cols == sorted(at)
    norm = lambda v: repr(v) if isinstance(v, float) else str(v)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[at[c]]) for c in cols) for r in got.fetchall())


@pytest.mark.parametrize("name", ["agg_mode", "expand_list", "reverse_rows", "index_after_reverse", "index_after_sort", "join_inner", "join_leftouter", "join_rightouter", "json_fields", "json_missing_and_wrong", "try_legitimate_nulls"])
def test_whole_tables(spark, name):
    """Queries over whole tables against their SQL."""
    test_oracles(spark, name)
    from mlode.plans.catalog import CATALOG

    m, sql = CATALOG[name]
    assert " < " not in m + sql and "FirstN" not in m


def test_write_and_projects(spark, tmp_path, capsys):
    from mlode import cli

    (tmp_path / "q.pq").write_text('let t = #table({"k", "d"}, {{1, #date(2024, 5, 6)}, {2, null}}) in t')
    for to in ("parquet", "json", "csv"):
        assert cli.main(["eval", str(tmp_path / "q.pq"), "--write", str(tmp_path / to), "--to", to]) == 0
        back = spark.read.option("header", True).format(to).load(str(tmp_path / to))
        assert sorted(str(r["k"]) for r in back.collect()) == ["1", "2"] and back.columns == (["d", "k"] if to == "json" else ["k", "d"])
    assert cli.main(["parse", str(tmp_path / "q.pq")]) == 0 and '"KeywordLet"' in capsys.readouterr().out
    project = tmp_path / "p"
    (project / "m").mkdir(parents=True)
    (project / "a.pq").write_text("1 + 1")
    (project / "m" / "Sales.tmdl").write_text("table Sales\n\tpartition Sales = m\n\t\tsource =\n\t\t\t```\n\t\t\tlet x = 3 in x\n\t\t\t```\n")
    (project / "m" / "Two.tmdl").write_text("source =\n```\n1\n```\nsource =\n```\n2\n```\n")
    (project / "p.pbip").write_text("{}")
    assert cli.main(["list", str(project / "p.pbip")]) == 0 and capsys.readouterr().out.split() == ["a.pq", "m/Sales.tmdl"]
    assert cli.main(["eval", str(project), "--member", "m/Sales.tmdl"]) == 0 and capsys.readouterr().out.strip() == "3"
