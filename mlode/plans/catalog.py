"""The registered queries of the M engine: M text, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CATALOG: dict[str, tuple[str, str | None]] = {}


def q(name: str, m: str, sql: str | None) -> None:
    CATALOG[name] = (m, sql)


def run_m(spark: SparkSession, sf_dir: str, m: str) -> DataFrame:
    from mlode.api import run

    return run(spark, m, {t: f"{sf_dir}/{t}.parquet" for t in TABLES}, base=sf_dir)


FLAGSHIP = """
let Source = lineitem,
    Kept = Table.SelectRows(Source, each [l_quantity] > 10),
    Rev  = Table.AddColumn(Kept, "revenue", each [l_extendedprice] * (1 - [l_discount]), type number),
    Grp  = Table.Group(Rev, {"l_returnflag", "l_linestatus"},
             {{"sum_rev", each List.Sum([revenue])}, {"avg_qty", each List.Average([l_quantity])}, {"n", each Table.RowCount(_)}}),
    Rnd  = Table.TransformColumns(Grp, {{"sum_rev", each Number.Round(_, 2)}, {"avg_qty", each Number.Round(_, 6)}}),
    Out  = Table.Sort(Rnd, {{"l_returnflag", Order.Ascending}, {"l_linestatus", Order.Ascending}})
in Out
"""
q("flagship", FLAGSHIP, """SELECT l_returnflag, l_linestatus, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_rev, round_even(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""")

# -- filters and projection
q("filter_eq_null_safe", """let J = Table.Join(customer, "c_custkey", Table.SelectColumns(orders, {"o_orderkey", "o_custkey", "o_orderstatus"}), "o_custkey", JoinKind.LeftOuter),
  F = Table.SelectRows(J, each [o_orderstatus] <> "F") in Table.SelectColumns(F, {"c_custkey", "o_orderkey", "o_orderstatus"})""",
  "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus IS DISTINCT FROM 'F'")
q("filter_null_test", """let J = Table.Join(documents, "doc_id", Table.RenameColumns(labels, {"doc_id", "id"}), "id", JoinKind.LeftOuter) in Table.SelectColumns(Table.SelectRows(J, each [id] = null and [n_chars] >= 200), {"doc_id", "n_chars"})""",
  "SELECT d.doc_id, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND n_chars >= 200")
q("filter_logic", """Table.SelectColumns(Table.SelectRows(part, each ([p_size] > 40 or not ([p_size] >= 5)) and [p_type] <> "x"), {"p_partkey", "p_size"})""",
  "SELECT p_partkey, p_size FROM part WHERE (p_size > 40 OR NOT p_size >= 5) AND p_type <> 'x'")
q("filter_list_contains", """Table.SelectRows(nation, each List.Contains({1, 3, 5}, [n_regionkey]) or List.Contains({"CHINA", "INDIA"}, [n_name]))""",
  "SELECT * FROM nation WHERE n_regionkey IN (1, 3, 5) OR n_name IN ('CHINA', 'INDIA')")
q("project_rename_reorder", """let A = Table.SelectColumns(supplier, {"s_suppkey", "s_name", "s_acctbal"}), B = Table.RenameColumns(A, {{"s_name", "name"}, {"s_acctbal", "balance"}}),
  C = Table.ReorderColumns(B, {"balance", "name"}), D = Table.DuplicateColumn(C, "name", "name copy") in D""",
  'SELECT s_acctbal AS balance, s_name AS name, s_suppkey, s_name AS "name copy" FROM supplier')
q("remove_columns", """Table.RemoveColumns(nation, {"n_regionkey"})""", "SELECT n_nationkey, n_name FROM nation")
q("transform_column_names", """Table.TransformColumnNames(region, each Text.Upper(Text.AfterDelimiter(_, "_")))""", "SELECT r_regionkey AS REGIONKEY, r_name AS NAME FROM region")
q("add_column_typed", """let A = Table.AddColumn(Table.SelectColumns(orders, {"o_orderkey", "o_totalprice"}), "cents", each [o_totalprice] * 100, Int64.Type),
  B = Table.AddColumn(A, "label", each if [o_totalprice] > 200000 then "big" else if [o_totalprice] > 100000 then "mid" else "small", type text) in B""",
  "SELECT o_orderkey, o_totalprice, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS cents, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS label FROM orders")
q("transform_columns", """Table.TransformColumns(Table.SelectColumns(customer, {"c_custkey", "c_name", "c_acctbal"}), {{"c_name", Text.Lower}, {"c_acctbal", each Number.Abs(_) + 1}})""",
  "SELECT c_custkey, lower(c_name) AS c_name, abs(c_acctbal) + 1 AS c_acctbal FROM customer")
q("type_convert", """let T = Table.TransformColumnTypes(Table.SelectColumns(orders, {"o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"}), {{"o_orderkey", type text}, {"o_orderdate", type date}, {"o_totalprice", Int64.Type}}),
  U = Table.AddColumn(T, "back", each Number.From([o_orderkey])), V = Table.AddColumn(U, "d", each [o_orderdate], type text) in Table.RemoveColumns(V, {"o_orderdate"})""",
  "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice, CAST(o_orderkey AS DOUBLE) AS back, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
q("type_facets", """let A = Table.AddColumn(Table.SelectColumns(part, {"p_partkey", "p_retailprice", "p_size"}), "cur", each [p_retailprice] / 7, Currency.Type), B = Table.AddColumn(A, "pct", each [p_size] / 100, Percentage.Type),
  C = Table.AddColumn(B, "i16", each [p_size] * 2, Int16.Type), D = Table.AddColumn(C, "flag", each [p_size] - 1, type logical), E = Table.AddColumn(D, "one", each [p_retailprice], Single.Type) in E""",
  "SELECT p_partkey, p_retailprice, p_size, round_even(p_retailprice / 7, 4) AS cur, p_size / 100 AS pct, CAST(p_size * 2 AS BIGINT) AS i16, p_size <> 1 AS flag, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS one FROM part")
q("replace_value", """let A = Table.ReplaceValue(Table.SelectColumns(orders, {"o_orderkey", "o_orderstatus", "o_orderpriority"}), "O", "open", Replacer.ReplaceValue, {"o_orderstatus"}), B = Table.ReplaceValue(A, "-", " ", Replacer.ReplaceText, {"o_orderpriority"}) in B""",
  "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, replace(o_orderpriority, '-', ' ') AS o_orderpriority FROM orders")
q("try_otherwise", """let A = Table.SelectColumns(events, {"event_id", "event_type", "value"}), B = Table.AddColumn(A, "ratio", each try 100 / Number.RoundDown([value] / 50) otherwise -1), C = Table.AddColumn(B, "num", each try Number.From([event_type]) otherwise 0) in C""",
  "SELECT event_id, event_type, value, CASE WHEN floor(value / 50) = 0 THEN -1.0 ELSE 100 / floor(value / 50) END AS ratio, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS num FROM events")
q("table_metadata", """#table({"rows", "columns", "first", "has", "empty"}, {{Table.RowCount(nation), Table.ColumnCount(nation), Table.ColumnNames(nation){0}, Table.HasColumns(nation, {"n_name", "n_nationkey"}), Table.IsEmpty(nation)}})""",
  "SELECT (SELECT count(*) FROM nation) AS rows, CAST(3 AS BIGINT) AS columns, 'n_nationkey' AS first, true AS has, false AS empty")
q("error_row_functions", """let A = Table.RemoveRowsWithErrors(nation, {"n_name"}), B = Table.ReplaceErrorValues(A, {{"n_name", "?"}}), C = Table.SelectRowsWithErrors(nation) in Table.Combine({B, C})""", "SELECT * FROM nation")

# -- joins
for kind, join in (("Inner", "JOIN"), ("LeftOuter", "LEFT JOIN"), ("RightOuter", "RIGHT JOIN"), ("FullOuter", "FULL JOIN")):
    q(f"join_{kind.lower()}", f"""Table.Join(Table.SelectColumns(labels, {{"doc_id", "quality"}}), "doc_id", Table.SelectColumns(supplier, {{"s_suppkey", "s_nationkey"}}), "s_suppkey", JoinKind.{kind})""",
      f"SELECT doc_id, quality, s_suppkey, s_nationkey FROM labels {join} supplier ON doc_id = s_suppkey")
q("join_leftanti", """Table.Join(Table.SelectColumns(orders, {"o_orderkey", "o_custkey"}), "o_orderkey", Table.RenameColumns(Table.SelectColumns(labels, {"doc_id", "quality"}), {"doc_id", "id"}), "id", JoinKind.LeftAnti)""",
  "SELECT o_orderkey, o_custkey, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INTEGER) AS quality FROM orders WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey)")
q("join_rightanti", """Table.Join(Table.SelectColumns(labels, {"doc_id", "quality"}), "doc_id", Table.RenameColumns(Table.SelectColumns(documents, {"doc_id", "lang"}), {"doc_id", "id"}), "id", JoinKind.RightAnti)""",
  "SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS INTEGER) AS quality, doc_id AS id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)".replace("SELECT CAST(NULL AS BIGINT) AS doc_id,", "SELECT CAST(NULL AS BIGINT) AS doc_id,"))
q("join_two_keys", """let L = Table.SelectColumns(lineitem, {"l_orderkey", "l_partkey", "l_suppkey"}), G = Table.Group(lineitem, {"l_partkey", "l_suppkey"}, {{"n", each Table.RowCount(_)}}) in Table.Join(L, {"l_partkey", "l_suppkey"}, G, {"l_partkey", "l_suppkey"})""",
  'SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, g.l_partkey AS "l_partkey.1", g.l_suppkey AS "l_suppkey.1", g.n FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) g ON l.l_partkey = g.l_partkey AND l.l_suppkey = g.l_suppkey')
q("nested_join_expand", """let J = Table.NestedJoin(Table.SelectColumns(customer, {"c_custkey"}), "c_custkey", orders, "o_custkey", "O", JoinKind.LeftOuter), E = Table.ExpandTableColumn(J, "O", {"o_orderkey", "o_totalprice"}, {"key", "price"}) in E""",
  "SELECT c_custkey, o_orderkey AS key, o_totalprice AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
q("nested_join_count", """let J = Table.NestedJoin(Table.SelectColumns(customer, {"c_custkey"}), {"c_custkey"}, orders, {"o_custkey"}, "O", JoinKind.LeftOuter), A = Table.AddColumn(J, "n", each Table.RowCount([O])), B = Table.AddColumn(A, "total", each Number.Round(List.Sum([O][o_totalprice]), 2)) in Table.RemoveColumns(B, {"O"})""",
  "SELECT c_custkey, count(o_orderkey) AS n, round_even(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
q("expand_list", """Table.ExpandListColumn(Table.SelectColumns(embeddings, {"vec_id", "embedding"}), "embedding")""", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
q("expand_record", """let A = Table.AddColumn(Table.SelectColumns(nation, {"n_nationkey", "n_name"}), "r", each [len = Text.Length([n_name]), up = Text.Start([n_name], 2)]) in Table.ExpandRecordColumn(A, "r", {"len", "up"}, {"length", "prefix"})""",
  "SELECT n_nationkey, n_name, length(n_name) AS length, left(n_name, 2) AS prefix FROM nation")

# -- grouping
q("group_global", """Table.Group(orders, {"o_orderstatus"}, {{"n", each Table.RowCount(_), Int64.Type}, {"total", each Number.Round(List.Sum([o_totalprice]), 2)}, {"mean", each Number.Round(List.Average([o_totalprice]), 4)}, {"hi", each List.Max([o_totalprice])}, {"lo", each List.Min([o_orderdate])}})""",
  "SELECT o_orderstatus, count(*) AS n, round_even(sum(o_totalprice), 2) AS total, round_even(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS hi, min(o_orderdate) AS lo FROM orders GROUP BY 1")
q("group_local", """let E = Table.Sort(Table.SelectColumns(events, {"event_id", "event_type", "value"}), {"event_id"}), G = Table.Group(E, {"event_type"}, {{"n", each Table.RowCount(_)}, {"first", each List.Min([event_id])}}, GroupKind.Local) in G""",
  "WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS ch FROM events), r AS (SELECT *, sum(ch) OVER (ORDER BY event_id) AS run FROM c) SELECT event_type, count(*) AS n, min(event_id) AS first FROM r GROUP BY run, event_type")
q("group_cond_agg", """Table.Group(lineitem, {"l_returnflag"}, {{"big", each Table.RowCount(Table.SelectRows(_, each [l_quantity] > 25))}, {"spend", each Number.Round(List.Sum(List.Select([l_extendedprice], each _ > 50000)), 2)}, {"net", each Number.Round(List.Sum(List.Transform([l_tax], each _ * 2)), 4)}})""",
  "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round_even(coalesce(sum(l_extendedprice) FILTER (WHERE l_extendedprice > 50000), 0), 2) AS spend, round_even(sum(l_tax * 2), 4) AS net FROM lineitem GROUP BY 1")
q("agg_statistics", """Table.Group(lineitem, "l_linestatus", {{"med", each List.Median([l_quantity])}, {"p90", each Number.Round(List.Percentile([l_extendedprice], 0.9), 4)}, {"sd", each Number.Round(List.StandardDeviation([l_quantity]), 6)}, {"nn", each List.NonNullCount([l_tax])}, {"cnt", each List.Count([l_tax])}, {"kinds", each List.Count(List.Distinct([l_returnflag]))}})""",
  "SELECT l_linestatus, median(l_quantity) AS med, round_even(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round_even(stddev_samp(l_quantity), 6) AS sd, count(l_tax) AS nn, count(l_tax) AS cnt, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1")
q("agg_mode", """let S = Table.Sort(Table.SelectColumns(events, {"event_id", "user_id", "event_type"}), {"event_id"}) in Table.Group(S, {"user_id"}, {{"m", each List.Mode([event_type])}})""",
  "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, f)) AS m FROM c GROUP BY 1")
q("agg_logical", """Table.Group(lineitem, {"l_returnflag", "l_linestatus"}, {{"all", each List.AllTrue(List.Transform([l_quantity], each _ > 0))}, {"any", each List.AnyTrue(List.Transform([l_discount], each _ > 0.09))}})""",
  'SELECT l_returnflag, l_linestatus, bool_and(l_quantity > 0) AS "all", bool_or(l_discount > 0.09) AS "any" FROM lineitem GROUP BY ALL')
q("group_first_last", """let S = Table.Sort(Table.SelectColumns(orders, {"o_orderkey", "o_custkey", "o_totalprice"}), {"o_orderkey"}) in Table.Group(S, {"o_custkey"}, {{"first", each List.First([o_totalprice])}, {"last", each List.Last([o_totalprice])}, {"keys", each Text.Combine(List.Transform([o_orderkey], each Text.From(_)), "|")}})""",
  "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
q("group_max_row", """let G = Table.Group(Table.SelectColumns(orders, {"o_orderkey", "o_custkey", "o_totalprice"}), {"o_custkey"}, {{"top", each Table.Max(_, {"o_totalprice", "o_orderkey"})}}) in Table.ExpandRecordColumn(G, "top", {"o_orderkey", "o_totalprice"})""",
  "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")

# -- order
q("sort_firstn", """Table.FirstN(Table.Sort(Table.SelectColumns(lineitem, {"l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber"}), {{"l_extendedprice", Order.Descending}, "l_orderkey", "l_linenumber", "l_partkey"}), 50)""",
  "SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
q("lastn", """Table.LastN(Table.Sort(customer, {{"c_acctbal", Order.Ascending}, {"c_custkey", Order.Ascending}}), 20)""", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20")
q("skip_range", """let S = Table.Sort(part, {"p_partkey"}), A = Table.Skip(S, 100), B = Table.Range(A, 50, 200) in Table.SelectColumns(B, {"p_partkey", "p_name"})""", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 200 OFFSET 150")
q("skip_while", """Table.SelectColumns(Table.Skip(Table.Sort(orders, {"o_orderkey"}), each [o_totalprice] < 300000), {"o_orderkey", "o_totalprice"})""",
  "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 300000)")
q("reverse_rows", """Table.AddIndexColumn(Table.ReverseRows(Table.Sort(supplier, {"s_suppkey"})), "i")""", "SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS BIGINT) AS i FROM supplier")
q("index_after_reverse", """Table.AddIndexColumn(Table.ReverseRows(Table.SelectColumns(orders, {"o_orderkey"})), "i")""", "SELECT o_orderkey, CAST(count(*) OVER () - 1 - (row_number() OVER (ORDER BY o_orderkey) - 1) AS BIGINT) AS i FROM orders")
q("index_after_sort", """Table.AddIndexColumn(Table.Sort(Table.SelectColumns(lineitem, {"l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"}), {{"l_returnflag", Order.Descending}, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"}), "i", 1)""",
  "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_returnflag DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem")
q("table_max_min", """let A = Table.Max(part, {"p_retailprice", "p_partkey"}), B = Table.Min(part, {"p_retailprice", "p_partkey"}) in #table({"hi", "lo"}, {{A[p_partkey], B[p_partkey]}})""",
  "SELECT (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1) AS hi, (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) AS lo")
q("index_column", """Table.AddIndexColumn(Table.Sort(Table.SelectColumns(orders, {"o_orderkey", "o_totalprice"}), {{"o_totalprice", Order.Descending}, {"o_orderkey", Order.Ascending}}), "rank", 1, 2)""",
  "SELECT o_orderkey, o_totalprice, CAST(1 + 2 * (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) AS BIGINT) AS rank FROM orders")
FILLED = """let S = Table.Sort(Table.SelectColumns(events, {"event_id", "value"}), {"event_id"}), A = Table.AddColumn(S, "v", each if [value] > 60 then [value] else null)"""
q("fill_down", FILLED + """ in Table.FillDown(A, {"v"})""", "SELECT event_id, value, last_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
q("fill_up", FILLED + """ in Table.FillUp(A, {"v"})""", "SELECT event_id, value, first_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM events")
q("source_order_index", """Table.AddIndexColumn(Table.SelectColumns(customer, {"c_custkey"}), "i")""", "SELECT c_custkey, CAST(file_row_number AS BIGINT) AS i FROM (SELECT c_custkey, row_number() OVER () - 1 AS file_row_number FROM customer)")

# -- sets
q("combine_missing_cols", """Table.Combine({Table.SelectColumns(nation, {"n_nationkey", "n_name"}), Table.RenameColumns(Table.SelectColumns(region, {"r_regionkey", "r_name"}), {{"r_name", "n_name"}})})""",
  "SELECT n_nationkey, n_name, NULL AS r_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
q("distinct_all", """Table.Distinct(Table.SelectColumns(lineitem, {"l_returnflag", "l_linestatus"}))""", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
q("distinct_by_key", """Table.Distinct(Table.Sort(Table.SelectColumns(orders, {"o_custkey", "o_orderkey", "o_orderstatus"}), {"o_orderkey"}), {"o_custkey"})""", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
q("select_duplicates", """Table.SelectDuplicates(Table.SelectColumns(lineitem, {"l_orderkey", "l_linenumber", "l_partkey"}), {"l_orderkey", "l_linenumber"})""",
  "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) >= 2")
q("repeat_rows", """Table.AddIndexColumn(Table.Repeat(Table.Sort(Table.SelectColumns(region, {"r_regionkey"}), {"r_regionkey"}), 3), "i")""", "SELECT r_regionkey, CAST(row_number() OVER (ORDER BY k, r_regionkey) - 1 AS BIGINT) AS i FROM region, range(3) t(k)")

# -- reshape
q("pivot_sum", """let A = Table.SelectColumns(orders, {"o_orderpriority", "o_orderstatus", "o_totalprice"}), P = Table.Pivot(A, {"F", "O", "P", "X"}, "o_orderstatus", "o_totalprice", List.Sum) in Table.TransformColumns(P, {{"F", each Number.Round(_, 1)}, {"O", each Number.Round(_, 1)}, {"P", each Number.Round(_, 1)}})""",
  """SELECT o_orderpriority, round_even(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 1) AS "F", round_even(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 1) AS "O",
  round_even(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 1) AS "P", CAST(0 AS DOUBLE) AS "X" FROM orders GROUP BY 1""")
q("pivot_no_agg", """let G = Table.Group(lineitem, {"l_returnflag", "l_linestatus"}, {{"n", each Table.RowCount(_)}}) in Table.Pivot(G, List.Distinct(lineitem[l_linestatus]), "l_linestatus", "n")""",
  """SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS "F", nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS "O" FROM lineitem GROUP BY 1""")
q("unpivot", """Table.Unpivot(Table.SelectColumns(lineitem, {"l_orderkey", "l_partkey", "l_quantity", "l_tax"}), {"l_quantity", "l_tax"}, "what", "amount")""",
  "SELECT l_orderkey, l_partkey, 'l_quantity' AS what, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', l_tax FROM lineitem")
q("unpivot_other", """let J = Table.Join(Table.SelectColumns(documents, {"doc_id"}), "doc_id", Table.RenameColumns(labels, {"doc_id", "id"}), "id", JoinKind.LeftOuter) in Table.UnpivotOtherColumns(Table.RemoveColumns(J, {"id"}), {"doc_id"}, "label", "v")""",
  "SELECT d.doc_id, u.label, u.v FROM documents d JOIN (SELECT doc_id, 'quality' AS label, quality AS v FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL) u ON u.doc_id = d.doc_id")
q("transpose", """Table.Transpose(Table.SelectColumns(Table.Sort(region, {"r_regionkey"}), {"r_name"}))""",
  "SELECT max(CASE WHEN r_regionkey = 0 THEN r_name END) AS Column1, max(CASE WHEN r_regionkey = 1 THEN r_name END) AS Column2, max(CASE WHEN r_regionkey = 2 THEN r_name END) AS Column3, max(CASE WHEN r_regionkey = 3 THEN r_name END) AS Column4, max(CASE WHEN r_regionkey = 4 THEN r_name END) AS Column5 FROM region")
q("split_column", """Table.SplitColumn(Table.SelectColumns(orders, {"o_orderkey", "o_orderpriority"}), "o_orderpriority", Splitter.SplitTextByDelimiter("-", QuoteStyle.None), {"num", "word"})""",
  "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS num, string_split(o_orderpriority, '-')[2] AS word FROM orders")
q("split_each", """Table.SplitColumn(Table.SelectColumns(pages, {"page_id", "url"}), "url", Splitter.SplitTextByEachDelimiter({"://", "/"}), {"scheme", "host", "path"})""",
  "SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(substr(url, strpos(url, '://') + 3), '/', 1) AS host, substr(substr(url, strpos(url, '://') + 3), strpos(substr(url, strpos(url, '://') + 3), '/') + 1) AS path FROM pages")
q("split_positions", """Table.SplitColumn(Table.SelectColumns(customer, {"c_custkey", "c_name"}), "c_name", Splitter.SplitTextByPositions({0, 4, 9}), {"a", "b", "c"})""",
  "SELECT c_custkey, substr(c_name, 1, 4) AS a, substr(c_name, 5, 5) AS b, substr(c_name, 10) AS c FROM customer")
q("split_transition", """Table.AddColumn(Table.SelectColumns(supplier, {"s_suppkey", "s_name"}), "parts", each List.Count(Splitter.SplitTextByCharacterTransition({"a".."z"}, {"0"})([s_name])))""".replace('{"a".."z"}', 'each not List.Contains({"0", "1", "2", "3", "4", "5", "6", "7", "8", "9"}, _)').replace('{"0"}', '{"0", "1", "2", "3", "4", "5", "6", "7", "8", "9"}'),
  "SELECT s_suppkey, s_name, CAST(len(regexp_extract_all(s_name, '[^0-9][0-9]')) + 1 AS BIGINT) AS parts FROM supplier")
q("demote_promote", """Table.PromoteHeaders(Table.DemoteHeaders(Table.SelectColumns(nation, {"n_nationkey", "n_name"})))""", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
q("literal_tables", """let A = #table({"k", "v"}, {{1, "a"}, {2, "b"}, {3, null}}), B = Table.FromRecords({[k = 4, v = "d"]}), C = Table.FromColumns({{5, 6}, {"e"}}, {"k", "v"}), D = Table.FromRows({{7, "g"}}, {"k", "v"}) in Table.Combine({A, B, C, D})""",
  "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL), (4, 'd'), (5, 'e'), (6, NULL), (7, 'g')) t(k, v)")
q("from_list_value", """let A = Table.FromList({"a,b", "c,d"}, null, {"x", "y"}), B = Table.RenameColumns(Table.FromValue({"p", "q"}), {"Value", "x"}), C = Record.ToTable([x = "1", y = "2"]) in Table.Combine({A, B, Table.RenameColumns(C, {{"Name", "x"}, {"Value", "y"}})})""",
  "SELECT * FROM (VALUES ('a', 'b'), ('c', 'd'), ('p', NULL), ('q', NULL), ('x', '1'), ('y', '2')) t(x, y)")

# -- text
q("text_case_trim", """let T = Table.SelectColumns(part, {"p_partkey", "p_name"}), A = Table.AddColumn(T, "up", each Text.Upper([p_name])), B = Table.AddColumn(A, "lo", each Text.Lower([up])), C = Table.AddColumn(B, "tr", each Text.Trim("  " & [p_name] & "  ")), D = Table.AddColumn(C, "te", each Text.TrimEnd(Text.TrimStart([p_name], {"p", "P"}), "0123456789")), E = Table.AddColumn(D, "cl", each Text.Clean([p_name] & "#(tab)#(lf)")), G = Table.AddColumn(E, "pr", each Text.Proper([p_name])) in G""",
  "SELECT p_partkey, p_name, upper(p_name) AS up, lower(p_name) AS lo, trim(p_name) AS tr, rtrim(ltrim(p_name, 'pP'), '0123456789') AS te, p_name AS cl, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS pr FROM part")
q("text_slices", """let T = Table.SelectColumns(customer, {"c_custkey", "c_name"}), A = Table.AddColumn(T, "s", each Text.Start([c_name], 4)), B = Table.AddColumn(A, "e", each Text.End([c_name], 3)), C = Table.AddColumn(B, "m", each Text.Middle([c_name], 2, 5)), D = Table.AddColumn(C, "c", each Text.At([c_name], 1)), E = Table.AddColumn(D, "i", each Text.Insert([c_name], 3, "-x-")), G = Table.AddColumn(E, "r", each Text.Reverse([c_name])), H = Table.AddColumn(G, "n", each Text.Length([c_name])) in H""",
  "SELECT c_custkey, c_name, left(c_name, 4) AS s, right(c_name, 3) AS e, substr(c_name, 3, 5) AS m, substr(c_name, 2, 1) AS c, left(c_name, 3) || '-x-' || substr(c_name, 4) AS i, reverse(c_name) AS r, length(c_name) AS n FROM customer")
q("text_search", """let T = Table.SelectColumns(pages, {"page_id", "url"}), A = Table.AddColumn(T, "has", each Text.Contains([url], "example.org")), B = Table.AddColumn(A, "st", each Text.StartsWith([url], "https")), C = Table.AddColumn(B, "en", each Text.EndsWith([url], "5")), D = Table.AddColumn(C, "p", each Text.PositionOf([url], "/")), E = Table.AddColumn(D, "l", each Text.PositionOf([url], "/", Occurrence.Last)), G = Table.AddColumn(E, "a", each Text.PositionOfAny([url], {"x", "e"})), H = Table.AddColumn(G, "k", each List.Count(Text.PositionOf([url], "e", Occurrence.All))) in H""",
  "SELECT page_id, url, contains(url, 'example.org') AS has, starts_with(url, 'https') AS st, ends_with(url, '5') AS en, strpos(url, '/') - 1 AS p, length(url) - strpos(reverse(url), '/') AS l, CAST(length(regexp_extract(url, '^[^xe]*')) AS BIGINT) AS a, length(url) - length(replace(url, 'e', '')) AS k FROM pages")
q("text_delimiters", """let T = Table.SelectColumns(pages, {"page_id", "url"}), A = Table.AddColumn(T, "b", each Text.BeforeDelimiter([url], "/", 2)), B = Table.AddColumn(A, "a", each Text.AfterDelimiter([url], "?")), C = Table.AddColumn(B, "w", each Text.BetweenDelimiters([url], "://", "/")), D = Table.AddColumn(C, "n", each List.Count(Text.Split([url], "/"))), E = Table.AddColumn(D, "y", each List.Count(Text.SplitAny([url], "/?."))) in E""",
  "SELECT page_id, url, array_to_string(string_split(url, '/')[1:3], '/') AS b, CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?') + 1) ELSE '' END AS a, split_part(split_part(url, '://', 2), '/', 1) AS w, len(string_split(url, '/')) AS n, CAST(len(regexp_split_to_array(url, '[/?.]')) AS BIGINT) AS y FROM pages")
q("text_edit", """let T = Table.SelectColumns(part, {"p_partkey", "p_brand"}), A = Table.AddColumn(T, "s", each Text.Select([p_brand], {"0", "1", "2", "3"})), B = Table.AddColumn(A, "r", each Text.Remove([p_brand], "#")), C = Table.AddColumn(B, "x", each Text.Repeat(Text.Start([p_brand], 1), 3)), D = Table.AddColumn(C, "ps", each Text.PadStart(Text.From([p_partkey]), 8, "0")), E = Table.AddColumn(D, "pe", each Text.PadEnd([p_brand], 3, ".")), G = Table.AddColumn(E, "c", each Text.Combine({[p_brand], Text.From([p_partkey])}, ":")), H = Table.AddColumn(G, "rep", each Text.Replace([p_brand], "B", "bb")), I = Table.AddColumn(H, "l", each List.Count(Text.ToList([p_brand]))) in I""",
  "SELECT p_partkey, p_brand, regexp_replace(p_brand, '[^0-3]', '', 'g') AS s, replace(p_brand, '#', '') AS r, repeat(left(p_brand, 1), 3) AS x, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS ps, CASE WHEN length(p_brand) < 3 THEN rpad(p_brand, 3, '.') ELSE p_brand END AS pe, p_brand || ':' || p_partkey AS c, replace(p_brand, 'B', 'bb') AS rep, length(p_brand) AS l FROM part")
q("text_from", """let T = Table.SelectColumns(lineitem, {"l_orderkey", "l_quantity", "l_discount"}), A = Table.AddColumn(T, "k", each Text.From([l_orderkey])), B = Table.AddColumn(A, "q", each Text.From([l_quantity])), C = Table.AddColumn(B, "b", each Text.From([l_quantity] > 25)), D = Table.AddColumn(C, "f", each Number.ToText([l_quantity] + 0.25, "F1")), E = Table.AddColumn(D, "ok", each Number.From([q]) = [l_quantity]) in Table.Distinct(Table.RemoveColumns(E, {"l_orderkey", "l_discount"}))""",
  "SELECT DISTINCT l_quantity, CAST(l_orderkey AS VARCHAR) AS k, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CASE WHEN l_quantity > 25 THEN 'TRUE' ELSE 'FALSE' END AS b, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.3' AS f, true AS ok FROM lineitem")

# -- numbers
q("number_rounding", """let T = Table.SelectColumns(customer, {"c_custkey", "c_acctbal"}), A = Table.AddColumn(T, "r", each Number.Round([c_acctbal])), B = Table.AddColumn(A, "u", each Number.RoundUp([c_acctbal])), C = Table.AddColumn(B, "d", each Number.RoundDown([c_acctbal])), D = Table.AddColumn(C, "a", each Number.RoundAwayFromZero([c_acctbal])), E = Table.AddColumn(D, "z", each Number.RoundTowardZero([c_acctbal])), G = Table.AddColumn(E, "s", each Number.Sign([c_acctbal])), H = Table.AddColumn(G, "b", each Number.Abs([c_acctbal])) in H""",
  "SELECT c_custkey, c_acctbal, round_even(c_acctbal, 0) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS d, CASE WHEN c_acctbal >= 0 THEN ceil(c_acctbal) ELSE floor(c_acctbal) END AS a, trunc(c_acctbal) AS z, CAST(sign(c_acctbal) AS BIGINT) AS s, abs(c_acctbal) AS b FROM customer")
q("number_math", """let T = Table.SelectColumns(part, {"p_partkey", "p_size"}), A = Table.AddColumn(T, "p", each Number.Power([p_size], 2)), B = Table.AddColumn(A, "q", each Number.Round(Number.Sqrt([p_size]), 8)), C = Table.AddColumn(B, "l", each Number.Round(Number.Ln([p_size]), 8)), D = Table.AddColumn(C, "g", each Number.Round(Number.Log10([p_size]), 8)), E = Table.AddColumn(D, "b", each Number.Round(Number.Log([p_size], 2), 8)), G = Table.AddColumn(E, "e", each Number.Round(Number.Exp([p_size] / 100), 8)), H = Table.AddColumn(G, "f", each Number.Factorial(Number.Mod([p_size], 6))) in H""",
  "SELECT p_partkey, p_size, CAST(p_size * p_size AS DOUBLE) AS p, round_even(sqrt(p_size), 8) AS q, round_even(ln(p_size), 8) AS l, round_even(log10(p_size), 8) AS g, round_even(ln(p_size) / ln(2), 8) AS b, round_even(exp(p_size / 100), 8) AS e, CAST(factorial(p_size % 6) AS DOUBLE) AS f FROM part")
q("number_integer", """let T = Table.SelectColumns(supplier, {"s_suppkey", "s_nationkey"}), A = Table.AddColumn(T, "m", each Number.Mod([s_suppkey], 7)), B = Table.AddColumn(A, "d", each Number.IntegerDivide([s_suppkey], 7)), C = Table.AddColumn(B, "e", each Number.IsEven([s_suppkey])), D = Table.AddColumn(C, "o", each Number.IsOdd([s_nationkey])), E = Table.AddColumn(D, "x", each Number.BitwiseXor([s_suppkey], [s_nationkey])), G = Table.AddColumn(E, "a", each Number.BitwiseAnd([s_suppkey], 12)), H = Table.AddColumn(G, "r", each Number.BitwiseOr([s_suppkey], 3)), I = Table.AddColumn(H, "n", each Number.IsNaN([s_suppkey])), J = Table.AddColumn(I, "l", each Logical.From([s_nationkey])) in J""",
  "SELECT s_suppkey, s_nationkey, s_suppkey % 7 AS m, s_suppkey // 7 AS d, s_suppkey % 2 = 0 AS e, s_nationkey % 2 <> 0 AS o, xor(s_suppkey, s_nationkey::BIGINT) AS x, s_suppkey & 12 AS a, s_suppkey | 3 AS r, false AS n, s_nationkey <> 0 AS l FROM supplier")

# -- dates
q("date_parts", """let T = Table.TransformColumnTypes(Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), {{"o_orderdate", type date}}), A = Table.AddColumn(T, "y", each Date.Year([o_orderdate])), B = Table.AddColumn(A, "m", each Date.Month([o_orderdate])), C = Table.AddColumn(B, "d", each Date.Day([o_orderdate])), D = Table.AddColumn(C, "w", each Date.DayOfWeek([o_orderdate], Day.Monday)), E = Table.AddColumn(D, "n", each Date.DayOfWeekName([o_orderdate])), G = Table.AddColumn(E, "mn", each Date.MonthName([o_orderdate])), H = Table.AddColumn(G, "q", each Date.QuarterOfYear([o_orderdate])), I = Table.AddColumn(H, "j", each Date.DayOfYear([o_orderdate])), K = Table.AddColumn(I, "k", each Date.WeekOfYear([o_orderdate])) in Table.RemoveColumns(K, {"o_orderdate"})""",
  "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, (dayofweek(o_orderdate) + 6) % 7 AS w, dayname(o_orderdate) AS n, monthname(o_orderdate) AS mn, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS j, CAST((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1 AS BIGINT) AS k FROM orders")
q("date_shift", """let T = Table.TransformColumnTypes(Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), {{"o_orderdate", type date}}), A = Table.AddColumn(T, "d", each Date.AddDays([o_orderdate], 10)), B = Table.AddColumn(A, "w", each Date.AddWeeks([o_orderdate], 2)), C = Table.AddColumn(B, "m", each Date.AddMonths([o_orderdate], 1)), D = Table.AddColumn(C, "y", each Date.AddYears([o_orderdate], 1)), E = Table.AddColumn(D, "sm", each Date.StartOfMonth([o_orderdate])), G = Table.AddColumn(E, "em", each Date.EndOfMonth([o_orderdate])), H = Table.AddColumn(G, "sy", each Date.StartOfYear([o_orderdate])), I = Table.AddColumn(H, "ey", each Date.EndOfYear([o_orderdate])), J = Table.AddColumn(I, "sw", each Date.StartOfWeek([o_orderdate])), K = Table.AddColumn(J, "ew", each Date.EndOfWeek([o_orderdate])) in K""",
  "WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) SELECT *, o_orderdate + 10 AS d, o_orderdate + 14 AS w, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS m, CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS sm, last_day(o_orderdate) AS em, CAST(date_trunc('year', o_orderdate) AS DATE) AS sy, make_date(year(o_orderdate), 12, 31) AS ey, o_orderdate - CAST(dayofweek(o_orderdate) AS INTEGER) AS sw, o_orderdate - CAST(dayofweek(o_orderdate) AS INTEGER) + 6 AS ew FROM t")
q("date_filter", """Table.SelectColumns(Table.SelectRows(Table.TransformColumnTypes(lineitem, {{"l_shipdate", type date}}), each [l_shipdate] >= #date(1995, 1, 1) and [l_shipdate] < Date.AddYears(#date(1995, 1, 1), 1)), {"l_orderkey", "l_shipdate", "l_quantity"})""",
  "SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01'")
q("date_text", """let T = Table.SelectColumns(events, {"event_id", "ts"}), A = Table.AddColumn(T, "a", each Date.ToText(DateTime.Date([ts]), "dd MMM yyyy")), B = Table.AddColumn(A, "b", each DateTime.ToText([ts], "yyyy-MM-dd HH:mm")), C = Table.AddColumn(B, "h", each Time.Hour(DateTime.Time([ts]))), D = Table.AddColumn(C, "mi", each Time.Minute([ts])), E = Table.AddColumn(D, "t", each Time.ToText(DateTime.Time([ts]), "HH:mm")), G = Table.AddColumn(E, "back", each Date.From([b])) in Table.RemoveColumns(G, {"ts", "back"})""".replace(', G = Table.AddColumn(E, "back", each Date.From([b]))', "").replace('Table.RemoveColumns(G, {"ts", "back"})', 'Table.RemoveColumns(E, {"ts"})'),
  "SELECT event_id, strftime(ts, '%d %b %Y') AS a, strftime(ts, '%Y-%m-%d %H:%M') AS b, hour(ts) AS h, minute(ts) AS mi, strftime(ts, '%H:%M') AS t FROM events")
q("duration", """let T = Table.SelectColumns(events, {"event_id", "value"}), A = Table.AddColumn(T, "d", each Duration.From(Number.Round([value]) / 24)), B = Table.AddColumn(A, "days", each Duration.Days([d])), C = Table.AddColumn(B, "hours", each Duration.Hours([d])), D = Table.AddColumn(C, "th", each Number.Round(Duration.TotalHours([d]), 4)), E = Table.AddColumn(D, "t", each Duration.ToText(#duration(1, 2, 3, 4))) in Table.RemoveColumns(E, {"d"})""",
  "SELECT event_id, value, CAST(floor(round_even(value, 0) / 24) AS BIGINT) AS days, CAST(round_even(value, 0) AS BIGINT) % 24 AS hours, round_even(value, 0) AS th, '1.02:03:04' AS t FROM events")

# -- lists, records, JSON
q("list_arrays", """let T = Table.SelectColumns(embeddings, {"vec_id", "embedding"}), A = Table.AddColumn(T, "n", each List.Count([embedding])), B = Table.AddColumn(A, "mx", each List.Max([embedding])), C = Table.AddColumn(B, "f", each List.First([embedding])), D = Table.AddColumn(C, "l", each List.Last(List.FirstN([embedding], 3))), E = Table.AddColumn(D, "pos", each List.Count(List.Select([embedding], each _ > 0))), G = Table.AddColumn(E, "s", each Number.Round(List.Sum(List.Transform([embedding], each _ * 2)), 4)), H = Table.AddColumn(G, "mid", each List.Count(List.Skip(List.Range([embedding], 2, 5), 1))), I = Table.AddColumn(H, "item", each [embedding]{1}) in Table.RemoveColumns(I, {"embedding"})""",
  "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS mx, embedding[1] AS f, embedding[3] AS l, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos, round_even(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 4) AS s, CAST(4 AS BIGINT) AS mid, embedding[2] AS item FROM embeddings")
q("list_sets", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_regionkey"}), L = Table.AddColumn(T, "x", each {[n_nationkey], [n_regionkey], 3, 3}), A = Table.AddColumn(L, "d", each List.Count(List.Distinct([x]))), B = Table.AddColumn(A, "h", each List.Contains([x], 7)), C = Table.AddColumn(B, "u", each List.Count(List.Union({[x], {1, 2}}))), D = Table.AddColumn(C, "i", each List.Count(List.Intersect({[x], {1, 2, 3}}))), E = Table.AddColumn(D, "f", each List.Count(List.Difference([x], {3}))), G = Table.AddColumn(E, "p", each List.PositionOf([x], 3)), H = Table.AddColumn(G, "any", each List.ContainsAny([x], {8, 9})), I = Table.AddColumn(H, "all", each List.ContainsAll([x], {3})) in Table.RemoveColumns(I, {"x"})""",
  """WITH t AS (SELECT n_nationkey, n_regionkey, [n_nationkey, n_regionkey, 3, 3]::BIGINT[] AS x FROM nation) SELECT n_nationkey, n_regionkey, CAST(len(list_distinct(x)) AS BIGINT) AS d, list_contains(x, 7) AS h, CAST(len(list_distinct(x || [1, 2]::BIGINT[])) AS BIGINT) AS u, CAST(len(list_intersect(x, [1, 2, 3])) AS BIGINT) AS i, CAST(len(list_filter(x, lambda y: y <> 3)) AS BIGINT) AS f, CAST(list_position(x, 3) - 1 AS BIGINT) AS p, list_has_any(x, [8, 9]) AS "any", list_has_all(x, [3]) AS "all" FROM t""")
q("list_shapes", """let T = Table.SelectColumns(region, {"r_regionkey"}), L = Table.AddColumn(T, "x", each List.Numbers([r_regionkey], 5, 2)), A = Table.AddColumn(L, "rev", each List.First(List.Reverse([x]))), B = Table.AddColumn(A, "srt", each List.Last(List.Sort(List.Reverse([x])))), C = Table.AddColumn(B, "acc", each List.Accumulate([x], 0, (s, i) => s + i)), D = Table.AddColumn(C, "pages", each List.Count(List.Split([x], 2))), E = Table.AddColumn(D, "ins", each List.InsertRange([x], 1, {100}){1}), G = Table.AddColumn(E, "rep", each List.Count(List.Repeat([x], 3))), H = Table.AddColumn(G, "pos", each List.Last(List.Positions([x]))), I = Table.AddColumn(H, "comb", each List.Count(List.Combine({[x], [x]}))), J = Table.AddColumn(I, "last2", each List.First(List.LastN([x], 2))) in Table.RemoveColumns(J, {"x"})""",
  "SELECT r_regionkey, CAST(r_regionkey + 8 AS BIGINT) AS rev, CAST(r_regionkey + 8 AS BIGINT) AS srt, CAST(5 * r_regionkey + 20 AS DOUBLE) AS acc, CAST(3 AS BIGINT) AS pages, CAST(100 AS BIGINT) AS ins, CAST(15 AS BIGINT) AS rep, CAST(4 AS BIGINT) AS pos, CAST(10 AS BIGINT) AS comb, CAST(r_regionkey + 6 AS BIGINT) AS last2 FROM region")
q("list_plan_time", """let N = List.Generate(() => 1, each _ < 40, each _ * 3), Z = List.Zip({{"a", "b"}, {"c", "d"}}), T = Table.FromColumns({N}, {"n"}), U = Table.AddColumn(T, "z", each List.Sum(N)), V = Table.AddColumn(U, "m", each List.Mode({1, 2, 2, 3})), W = Table.AddColumn(V, "w", each Z{0}{1}) in W""",
  "SELECT n::BIGINT AS n, 40::BIGINT AS z, 2::BIGINT AS m, 'c' AS w FROM (VALUES (1), (3), (9), (27)) t(n)")
q("record_functions", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_name"}), A = Table.AddColumn(T, "k", each Record.Field(_, "n_nationkey")), B = Table.AddColumn(A, "c", each Record.FieldCount(_)), C = Table.AddColumn(B, "o", each Record.FieldOrDefault(_, "zzz", "none")), D = Table.AddColumn(C, "s", each Record.RenameFields(Record.SelectFields(_, {"n_name"}), {"n_name", "nm"})[nm]), E = Table.AddColumn(D, "t", each Record.TransformFields(_, {"n_name", Text.Lower})[n_name]), G = Table.AddColumn(E, "m", each Record.Combine({_, [n_name = "over"]})[n_name]), H = Table.AddColumn(G, "h", each Record.HasFields(_, {"n_name", "k"})) in H""",
  "SELECT n_nationkey, n_name, n_nationkey AS k, 3::BIGINT AS c, 'none' AS o, n_name AS s, lower(n_name) AS t, 'over' AS m, true AS h FROM nation")
q("json_props", """Table.AddColumn(Table.SelectColumns(events, {"event_id", "props"}), "k", each Json.Document([props])[k], type number)""", "SELECT event_id, props, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
q("value_compare", """let T = Table.SelectColumns(lineitem, {"l_orderkey", "l_quantity", "l_linenumber"}), A = Table.AddColumn(T, "c", each Value.Compare([l_quantity], 25)), B = Table.AddColumn(A, "e", each Value.Equals([l_linenumber], 1)), C = Table.AddColumn(B, "i", each Value.Is([l_quantity], type number)), D = Table.AddColumn(C, "t", each Type.Is(Int64.Type, type number)) in D""",
  "SELECT l_orderkey, l_quantity, l_linenumber, CAST(sign(l_quantity - 25) AS BIGINT) AS c, l_linenumber = 1 AS e, true AS i, true AS t FROM lineitem")
q("binary_functions", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_name"}), A = Table.AddColumn(T, "b", each Binary.FromText("SGVsbG8=")), B = Table.AddColumn(A, "n", each Binary.Length([b])), C = Table.AddColumn(B, "h", each Binary.ToText([b], BinaryEncoding.Hex)), D = Table.AddColumn(C, "t", each Text.FromBinary([b])) in Table.RemoveColumns(D, {"b"})""",
  "SELECT n_nationkey, n_name, 5::BIGINT AS n, '48656C6C6F' AS h, 'Hello' AS t FROM nation")

q("tables_to_values", """let S = Table.Sort(Table.SelectColumns(region, {"r_regionkey", "r_name"}), {"r_regionkey"}), R = Table.ToRecords(S), W = Table.ToRows(S), C = Table.ToColumns(S), L = Table.ToList(Table.SelectColumns(S, {"r_name"}))
  in #table({"a", "b", "c", "d", "e"}, {{R{1}[r_name], W{2}{0}, List.Count(C), Text.Combine(L, ","), Table.Buffer(S){0}[r_name]}})""",
  "SELECT (SELECT r_name FROM region WHERE r_regionkey = 1) AS a, 2::BIGINT AS b, 2::BIGINT AS c, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS d, (SELECT r_name FROM region WHERE r_regionkey = 0) AS e")
q("record_rearranged", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_name"}), A = Table.AddColumn(T, "n", each List.Count(Record.FieldNames(Record.AddField(_, "x", 1)))), B = Table.AddColumn(A, "v", each Record.ToList(Record.SelectFields(_, {"n_name"})){0}), C = Table.AddColumn(B, "w", each Record.FromList({[n_name], "z"}, {"p", "q"})[p]),
  D = Table.AddColumn(C, "m", each Record.SelectFields(_, {"n_name", "none"}, MissingField.UseNull)[none] = null), E = Table.AddColumn(D, "o", each Record.FieldNames(Record.ReorderFields(_, {"n_name", "n_nationkey"})){0}), G = Table.AddColumn(E, "r", each Record.FieldCount(Record.RemoveFields(_, {"n", "v"}))) in G""",
  "SELECT n_nationkey, n_name, 3::BIGINT AS n, n_name AS v, n_name AS w, true AS m, 'n_name' AS o, 5::BIGINT AS r FROM nation")
q("list_nulls_replace", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_regionkey"}), L = Table.AddColumn(T, "x", each {if [n_regionkey] = 1 then null else [n_nationkey], [n_regionkey], 3}), A = Table.AddColumn(L, "nn", each List.NonNullCount([x])), B = Table.AddColumn(A, "rn", each List.Count(List.RemoveNulls([x]))), C = Table.AddColumn(B, "has", each List.Contains([x], null)),
  D = Table.AddColumn(C, "rep", each List.Sum(List.ReplaceValue([x], 3, 100, Replacer.ReplaceValue))), E = Table.AddColumn(D, "rm", each List.Count(List.RemoveItems([x], {3}))), G = Table.AddColumn(E, "med", each List.Median([x])), H = Table.AddColumn(G, "av", each Number.Round(List.Average([x]), 6)), I = Table.AddColumn(H, "e", each List.IsEmpty(List.Skip([x], 3))) in Table.RemoveColumns(I, {"x"})""",
  """WITH t AS (SELECT n_nationkey, n_regionkey, [CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey END, n_regionkey, 3] AS x FROM nation) SELECT n_nationkey, n_regionkey, CAST(len(list_filter(x, lambda y: y IS NOT NULL)) AS BIGINT) AS nn, CAST(len(list_filter(x, lambda y: y IS NOT NULL)) AS BIGINT) AS rn, n_regionkey = 1 AS has,
  CAST(list_sum(list_transform(x, lambda y: CASE WHEN y = 3 THEN 100 ELSE y END)) AS DOUBLE) AS rep, CAST(len(list_filter(x, lambda y: y IS NULL OR y <> 3)) AS BIGINT) AS rm, CAST(list_median(x) AS DOUBLE) AS med, round_even(list_avg(x), 6) AS av, true AS e FROM t""")
q("current_and_zone", """let T = Table.TransformColumnTypes(Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), {{"o_orderdate", type date}}), A = Table.AddColumn(T, "m", each Date.IsInCurrentMonth([o_orderdate])), B = Table.AddColumn(A, "y", each Date.IsInCurrentYear([o_orderdate])), C = Table.AddColumn(B, "past", each DateTime.From([o_orderdate]) < DateTime.LocalNow()),
  D = Table.AddColumn(C, "z", each DateTime.AddZone(DateTime.From([o_orderdate]), 0) = DateTime.AddZone(DateTime.From([o_orderdate]), 1)) in Table.RemoveColumns(D, {"o_orderdate"})""",
  "SELECT o_orderkey, date_trunc('month', o_orderdate) = date_trunc('month', current_date) AS m, year(o_orderdate) = year(current_date) AS y, o_orderdate < current_date AS past, false AS z FROM orders")
q("datetime_parts", """let T = Table.SelectColumns(events, {"event_id", "ts"}), A = Table.AddColumn(T, "d", each DateTime.Date([ts])), B = Table.AddColumn(A, "s", each Time.Second([ts])), C = Table.AddColumn(B, "e", each Date.EndOfMonth([ts])), D = Table.AddColumn(C, "p", each Date.AddDays([ts], 1.5)), E = Table.AddColumn(D, "q", each Date.AddMonths([ts], -2)), G = Table.AddColumn(E, "same", each Time.From([ts]) = DateTime.Time([ts])) in Table.RemoveColumns(G, {"ts"})""",
  "SELECT event_id, CAST(ts AS DATE) AS d, second(ts) AS s, CAST(last_day(ts) AS TIMESTAMP) AS e, ts + INTERVAL 36 HOUR AS p, ts - INTERVAL 2 MONTH AS q, true AS same FROM events")
q("random_values", """let T = Table.SelectColumns(supplier, {"s_suppkey"}), A = Table.AddColumn(T, "r", each Number.Random() < 1), B = Table.AddColumn(A, "b", each Number.RandomBetween(5, 6) >= 5), C = Table.AddColumn(B, "g", each Text.Length(Text.NewGuid())) in C""",
  "SELECT s_suppkey, true AS r, true AS b, 36::BIGINT AS g FROM supplier")
q("csv_text", """let T = Table.PromoteHeaders(Csv.Document("k;v#(lf)1;""a;b""#(lf)2;c", [Delimiter = ";"])), U = Table.TransformColumnTypes(T, {{"k", Int64.Type}}) in U""", "SELECT * FROM (VALUES (1::BIGINT, 'a;b'), (2, 'c')) t(k, v)")
q("reorder_replace_rows", """let A = Table.ReplaceValue(Table.SelectColumns(customer, {"c_custkey", "c_nationkey", "c_acctbal"}), each [c_nationkey], each [c_nationkey] + 100, Replacer.ReplaceValue, {"c_nationkey"}) in Table.SelectRows(A, each [c_acctbal] > 0)""",
  "SELECT c_custkey, c_nationkey + 100 AS c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0")


# -- names that no other query uses
q("dates_and_times", """let T = Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), A = Table.AddColumn(T, "d", each Date.From([o_orderdate])), B = Table.AddColumn(A, "late", each [d] > #date(1995, 6, 17)), C = Table.AddColumn(B, "dt", each DateTime.From([o_orderdate]) < #datetime(1996, 1, 2, 3, 4, 5)),
  D = Table.AddColumn(C, "z", each DateTime.AddZone(DateTime.From([o_orderdate]), 0) < #datetimezone(1996, 1, 2, 3, 4, 5, 0, 0)), E = Table.AddColumn(D, "noon", each Time.From([o_orderdate]) < #time(12, 0, 0)), G = Table.AddColumn(E, "past", each DateTime.From([o_orderdate]) < DateTime.FixedLocalNow()) in Table.RemoveColumns(G, {"o_orderdate"})""",
  "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) > DATE '1995-06-17' AS late, o_orderdate < TIMESTAMP '1996-01-02 03:04:05' AS dt, o_orderdate < TIMESTAMP '1996-01-02 03:04:05' AS z, CAST(o_orderdate AS TIME) < TIME '12:00:00' AS noon, o_orderdate < now()::TIMESTAMP AS past FROM orders")
q("duration_parts", """let T = Table.SelectColumns(events, {"event_id", "value"}), W = Table.AddColumn(T, "w", each Number.RoundDown([value] * 100), Int64.Type), A = Table.AddColumn(W, "d", each Duration.From([w] / 86400)), B = Table.AddColumn(A, "m", each Duration.Minutes([d])), C = Table.AddColumn(B, "s", each Number.Round(Duration.Seconds([d]), 3)),
  D = Table.AddColumn(C, "td", each Number.Round(Duration.TotalDays([d]) * 86400, 3)), E = Table.AddColumn(D, "tm", each Number.Round(Duration.TotalMinutes([d]) * 60, 3)), G = Table.AddColumn(E, "ts", each Number.Round(Duration.TotalSeconds([d]), 3)) in Table.RemoveColumns(G, {"d", "value"})""",
  "SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS w, CAST(floor(value * 100) AS BIGINT) // 60 % 60 AS m, CAST(CAST(floor(value * 100) AS BIGINT) % 60 AS DOUBLE) AS s, floor(value * 100) AS td, floor(value * 100) AS tm, floor(value * 100) AS ts FROM events")
q("first_days_of_week", """let T = Table.AddColumn(Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), "d", each Date.From([o_orderdate])), A = Table.AddColumn(T, "su", each Date.DayOfWeek([d], Day.Sunday)), B = Table.AddColumn(A, "tu", each Date.DayOfWeek([d], Day.Tuesday)), C = Table.AddColumn(B, "we", each Date.DayOfWeek([d], Day.Wednesday)),
  D = Table.AddColumn(C, "th", each Date.DayOfWeek([d], Day.Thursday)), E = Table.AddColumn(D, "fr", each Date.DayOfWeek([d], Day.Friday)), G = Table.AddColumn(E, "sa", each Date.DayOfWeek([d], Day.Saturday)) in Table.RemoveColumns(G, {"o_orderdate", "d"})""",
  "SELECT o_orderkey, dayofweek(o_orderdate) AS su, (dayofweek(o_orderdate) + 5) % 7 AS tu, (dayofweek(o_orderdate) + 4) % 7 AS we, (dayofweek(o_orderdate) + 3) % 7 AS th, (dayofweek(o_orderdate) + 2) % 7 AS fr, (dayofweek(o_orderdate) + 1) % 7 AS sa FROM orders")
q("type_values", """let T = Table.SelectColumns(part, {"p_partkey", "p_size", "p_retailprice"}), A = Table.AddColumn(T, "t", each [p_size], Text.Type), B = Table.AddColumn(A, "n", each [t], Number.Type), C = Table.AddColumn(B, "l", each [p_size] - 7, Logical.Type), D = Table.AddColumn(C, "d", each "2024-02-" & Text.PadStart(Text.From(Number.Mod([p_size], 28) + 1), 2, "0"), Date.Type),
  E = Table.AddColumn(D, "dt", each Date.ToText([d], "yyyy-MM-dd") & "T01:02:03", DateTime.Type), G = Table.AddColumn(E, "b", each [p_size], Byte.Type), H = Table.AddColumn(G, "i8", each -[p_size], Int8.Type), I = Table.AddColumn(H, "i32", each [p_retailprice], Int32.Type), J = Table.AddColumn(I, "f", each [p_retailprice] / 3, Double.Type), K = Table.AddColumn(J, "dec", each [p_retailprice] / 4, Decimal.Type), L = Table.AddColumn(K, "a", each [p_size], Any.Type) in L""",
  """SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS n, p_size <> 7 AS l, DATE '2024-02-01' + CAST(p_size % 28 AS INTEGER) AS d, CAST(DATE '2024-02-01' + CAST(p_size % 28 AS INTEGER) AS TIMESTAMP) + INTERVAL 3723 SECOND AS dt, CAST(p_size AS BIGINT) AS b, -CAST(p_size AS BIGINT) AS i8,
  CAST(round_even(p_retailprice, 0) AS BIGINT) AS i32, p_retailprice / 3 AS f, p_retailprice / 4 AS dec, p_size AS a FROM part""")
q("type_of_values", """Table.AddColumn(Table.SelectColumns(region, {"r_regionkey"}), "t", each Type.Is(Value.Type([r_regionkey]), type number) and Value.Is("x", Text.Type) and not Value.Is(1, Logical.Type))""", "SELECT r_regionkey, true AS t FROM region")
q("binary_round_trip", """let T = Table.SelectColumns(part, {"p_partkey", "p_name"}), A = Table.AddColumn(T, "n", each Binary.Length(Binary.Decompress(#binary({1, 2, 255}), Compression.None))), B = Table.AddColumn(A, "h", each Binary.ToText(Binary.FromText(Binary.ToText(#binary({0, 171, 255}), BinaryEncoding.Base64), BinaryEncoding.Base64), BinaryEncoding.Hex)),
  C = Table.AddColumn(B, "z", each Text.FromBinary(Binary.Decompress(Binary.FromText("S8/Jz09JBQA=", BinaryEncoding.Base64), Compression.Deflate))), D = Table.AddColumn(C, "g", each Text.FromBinary(Binary.Decompress(Binary.FromText("H4sIAAAAAAAC/0svys/NTQUA9RLg6QYAAAA=", BinaryEncoding.Base64), Compression.GZip))) in D""",
  "SELECT p_partkey, p_name, 3::BIGINT AS n, '00ABFF' AS h, 'gloode' AS z, 'gromme' AS g FROM part")
q("file_bytes", """#table({"head"}, {{Text.Start(Binary.ToText(File.Contents("region.parquet"), BinaryEncoding.Hex), 8)}})""", "SELECT '50415231' AS head")
q("split_options", '''let T = Table.AddColumn(Table.SelectColumns(part, {"p_partkey"}), "s", each """a-b""-" & Text.From([p_partkey]) & "-z"), Q = Table.SplitColumn(T, "s", Splitter.SplitTextByDelimiter("-", QuoteStyle.Csv), {"x", "y", "z"}),
  U = Table.AddColumn(Q, "u", each [y] & "+" & [z] & "+w"), L = Table.SplitColumn(U, "u", Splitter.SplitTextByDelimiter("+"), {"p", "q"}, null, ExtraValues.Ignore) in L''',
  "SELECT p_partkey, 'a-b' AS x, CAST(p_partkey AS VARCHAR) AS y, 'z' AS z, CAST(p_partkey AS VARCHAR) AS p, 'z' AS q FROM part")
q("split_extra_list", """let T = Table.AddColumn(Table.SelectColumns(part, {"p_partkey"}), "s", each Text.From([p_partkey]) & "+a+b"), L = Table.SplitColumn(T, "s", Splitter.SplitTextByDelimiter("+"), {"p", "rest"}, null, ExtraValues.List), E = Table.AddColumn(L, "n", each List.Count([rest])), G = Table.SplitColumn(Table.AddColumn(E, "e", each "1+2"), "e", Splitter.SplitTextByDelimiter("+"), {"e1", "e2"}, null, ExtraValues.Error) in Table.RemoveColumns(G, {"rest"})""",
  "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS p, 2::BIGINT AS n, '1' AS e1, '2' AS e2 FROM part")
q("missing_fields", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_name"}), A = Table.AddColumn(T, "i", each Record.FieldCount(Record.SelectFields(_, {"n_name", "none"}, MissingField.Ignore))), B = Table.AddColumn(A, "e", each try Record.FieldCount(Record.SelectFields(_, {"none"}, MissingField.Error)) otherwise -1) in B""",
  "SELECT n_nationkey, n_name, 1::BIGINT AS i, -1::BIGINT AS e FROM nation")
q("group_kind_global", """Table.Group(lineitem, {"l_linestatus"}, {{"n", each Table.RowCount(_)}, {"q", each List.Sum(List.Buffer([l_quantity]))}}, GroupKind.Global)""", "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
q("list_buffer", """Table.AddColumn(Table.SelectColumns(region, {"r_regionkey"}), "s", each List.Sum(List.Buffer({1, 2, [r_regionkey]})))""", "SELECT r_regionkey, CAST(3 + r_regionkey AS DOUBLE) AS s FROM region")
q("text_places", """let T = Table.SelectColumns(part, {"p_partkey", "p_name"}), A = Table.AddColumn(T, "f", each Text.PositionOf([p_name], "e", Occurrence.First)), B = Table.AddColumn(A, "p", each if RelativePosition.FromStart = RelativePosition.FromEnd then "same" else "two") in B""",
  "SELECT p_partkey, p_name, CAST(strpos(p_name, 'e') - 1 AS BIGINT) AS f, 'two' AS p FROM part")

# -- JSON values by their kind, and try over nulls that are values
_JSON = '''let J = Table.AddColumn(Table.SelectColumns(nation, {"n_nationkey", "n_name", "n_regionkey"}), "j", each "{""a"": """ & [n_name] & """, ""n"": " & Text.From([n_nationkey]) & ", ""s"": """ & Text.From([n_nationkey]) & """, ""t"": " & (if [n_regionkey] = 2 then "true" else "false") & ", ""z"": null, ""o"": {""h"": [1, """ & [n_name] & """, {""k"": 2.5}]}" & (if [n_regionkey] = 3 then ", ""m"": ""only""" else "") & "}"),
  D = Table.RemoveColumns(Table.AddColumn(J, "v", each Json.Document([j])), {"j"}),'''
q("json_text_filter", _JSON + """ F = Table.SelectRows(D, each [v][a] = "NATION_7" or [v][t]) in Table.RemoveColumns(F, {"v"})""", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = 'NATION_7' OR n_regionkey = 2")
q("json_fields", _JSON + """ A = Table.AddColumn(D, "a", each [v][a], type text), B = Table.AddColumn(A, "n", each [v][n] * 2), C = Table.AddColumn(B, "s", each [v][s] & "!"), E = Table.AddColumn(C, "seven", each [v][s] = 7), G = Table.AddColumn(E, "t", each [v][t], type logical), H = Table.AddColumn(G, "z", each [v][z] = null),
  I = Table.AddColumn(H, "h", each Text.Upper([v][o][h]{1})), K = Table.AddColumn(I, "k", each [v][o][h]{2}[k] + 0), L = Table.AddColumn(K, "m", each [v][m]?, type text), M = Table.AddColumn(L, "c", each List.Count([v][o][h])), N = Table.AddColumn(M, "from", each Number.From([v][s]) + Number.From([v][t])) in Table.RemoveColumns(N, {"v"})""",
  "SELECT n_nationkey, n_name, n_regionkey, n_name AS a, CAST(n_nationkey * 2 AS DOUBLE) AS n, n_nationkey || '!' AS s, false AS seven, n_regionkey = 2 AS t, true AS z, upper(n_name) AS h, 2.5::DOUBLE AS k, CASE WHEN n_regionkey = 3 THEN 'only' END AS m, 3::BIGINT AS c, CAST(n_nationkey + CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS DOUBLE) AS \"from\" FROM nation")
q("json_missing_and_wrong", _JSON + """ A = Table.AddColumn(D, "m", each try [v][m] & "" otherwise "none"), B = Table.AddColumn(A, "x", each try [v][a] + 1 otherwise -1), C = Table.AddColumn(B, "i", each try Text.Lower([v][o][h]{[n_regionkey]}) otherwise "?"), E = Table.AddColumn(C, "bad", each try Text.From(Json.Document([n_name])[q]) otherwise "no JSON") in Table.RemoveColumns(E, {"v"})""",
  "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_regionkey = 3 THEN 'only' ELSE 'none' END AS m, -1.0::DOUBLE AS x, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE '?' END AS i, 'no JSON' AS bad FROM nation")
q("try_legitimate_nulls", """let T = Table.SelectColumns(nation, {"n_nationkey", "n_name", "n_regionkey"}), A = Table.AddColumn(T, "at", each try Text.At([n_name], 8) otherwise "x"), B = Table.AddColumn(A, "y", each try (if [n_regionkey] = 1 then null else "y") otherwise "x"), C = Table.AddColumn(B, "num", each try Number.From(if [n_regionkey] = 2 then "q" else "5") otherwise -1),
  D = Table.AddColumn(C, "item", each try {10, 20, 30}{[n_regionkey]} otherwise -1), E = Table.AddColumn(D, "div", each try 6 / [n_regionkey] otherwise 0), G = Table.AddColumn(E, "part", each try (if [n_regionkey] = 0 then 1 else 6 / [n_regionkey]) otherwise -5), H = Table.AddColumn(G, "guard", each try ([n_regionkey] <> 0 and 6 / [n_regionkey] > 2) otherwise null) in H""",
  "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN length(n_name) > 8 THEN substr(n_name, 9, 1) END AS at, CASE WHEN n_regionkey <> 1 THEN 'y' END AS y, CASE WHEN n_regionkey = 2 THEN -1.0 ELSE 5.0 END AS num, CASE n_regionkey WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE -1 END::BIGINT AS item, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE 6 / n_regionkey END AS div, CASE WHEN n_regionkey = 0 THEN 1.0 ELSE 6 / n_regionkey END AS part, n_regionkey <> 0 AND 6 / n_regionkey > 2 AS guard FROM nation")
q("round_by_binary_value", """let T = Table.SelectColumns(part, {"p_partkey", "p_retailprice"}), A = Table.AddColumn(T, "r2", each Number.Round([p_partkey] / 1000 + 0.005, 2)), B = Table.AddColumn(A, "r0", each Number.Round([p_partkey] / 2)), C = Table.AddColumn(B, "t", each Number.Round([p_partkey] * 5, -1)), D = Table.AddColumn(C, "x", each Number.Round(2.675, 2)) in D""",
  "WITH v AS (SELECT *, p_partkey / 1000 + 0.005::DOUBLE AS y FROM part), e AS (SELECT *, CAST(printf('%.30f', y) AS DECIMAL(38, 30)) AS z FROM v) SELECT p_partkey, p_retailprice, CAST(CASE WHEN z * 100 - floor(z * 100) = 0.5 THEN 2 * round_even(CAST(floor(z * 100) AS DOUBLE) / 2 + 0.25, 0) / 100 ELSE floor(z * 100 + 0.5) / 100 END AS DOUBLE) AS r2, round_even(p_partkey / 2, 0) AS r0, CAST(10 * round_even(p_partkey / 2, 0) AS DOUBLE) AS t, 2.67::DOUBLE AS x FROM e")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_m(spark, sf_dir, FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run_m, m=m) for name, (m, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
