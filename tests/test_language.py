import pytest

from mlode.lang.lint import dependencies, format_source, lint, rename
from mlode.lang.parser import parse, parse_section
from mlode.plans.errors import EvalError, ParseError, UnsupportedError


@pytest.mark.parametrize(
    "text, value",
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("let x = 1 + 1, y = 2 + 2, z = y + 1 in z", 5), ("let y = x, x = 3 in y", 3), ("if 1 = 1 then \"a\" else 1 / 0", "a"), ("[a = 1, b = 2][b]", 2),
        ("[a = 1][c]?", None), ("{1, 2, 3}{1}", 2), ("{1}{5}?", None), ("((x, y) => x - y)(5, 3)", 2), ("(each _ + 1)(2)", 3), ("try 1 / 0 otherwise -1", -1), ("null = null", True), ("1 = \"1\"", False),
        ("#nan = #nan", False), ("not true or true", True), ("false and (1 / 0 = 1)", False), ("0x1F", 31), ("\"a\"\"b#(lf)\"", "a\"b\n"), ("\"a\" & \"b\"", "ab"), ("{1, 2} = {1, 2}", True),
        ("[a = 1, b = 2] = [b = 2, a = 1]", True), ("List.Transform({1, 2}, each _ * 2)", [2, 4]), ("let f = (n) => n * 2 in List.Sum(List.Transform({1, 2, 3}, f))", 12),
    ],
)
def test_expressions(m, text, value):
    assert m(text) == value


@pytest.mark.parametrize("text", ["1 +", "let x = 1", "{1, 2", "[a = ]", "if 1 then 2", "(x, x) => 1", "[a = 1, a = 2]", "\"open"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["1 is number", "1 ?? 2", "error \"x\"", "try 1", "...", "{1..3}", "@x", "#shared", "[a = 1][[a]]", "(x as number) => x", "Sql.Database(\"a\", \"b\")", "Nope.Function(1)", "type {number}", "1 meta [a = 1]"])
def test_refusals(m, text):
    with pytest.raises(UnsupportedError):
        m(text)


@pytest.mark.parametrize("text", ["1 + null", "1 + \"a\"", "1 & 2", "1 < \"a\"", "null < 1", "if 1 then 2 else 3", "1 / 0", "let a = b, b = a in a", "[a = 1][b]", "{1}{3}", "{1}{-1}", "1 and true", "[x]", "Text.Length(null)"])
def test_evaluation_errors(m, text):
    with pytest.raises(EvalError):
        m(text)


def test_refusals_are_not_caught(m):
    with pytest.raises(UnsupportedError):
        m("try Web.Contents(\"x\") otherwise 1")


def test_unused_steps_are_not_evaluated(m):
    assert m("let bad = Web.Contents(\"x\"), good = 1 in good") == 1


def test_a_binding_replaces_a_step(m):
    assert m("let Source = Web.Contents(\"x\"), n = Table.RowCount(Source) in n", {"Source": [{"a": 1}, {"a": 2}]}) == 2


def test_registry_has_all_families(spark):
    from mlode.api import names

    found = names(spark)
    families = {f: sum(n.startswith(f + ".") for n in found) for f in ("Table", "List", "Text", "Number", "Record", "Date", "Duration", "DateTime")}
    assert len(found) == 299
    assert families == {"Table": 57, "List": 44, "Text": 36, "Number": 27, "Record": 15, "Date": 24, "Duration": 10, "DateTime": 8}


def test_sections(spark):
    from mlode.api import section_member

    text = "section Section1; shared A = 1; [ Doc = \"x\" ] shared #\"B c\" = A + 1;"
    assert list(parse_section(text)) == ["A", "B c"]
    assert section_member(spark, text, "B c") == 2


def test_lint_and_tools():
    text = "let a = Web.Contents(u), b = 1, c = \"password=hunter22\" in a"
    assert {f.code for f in lint(text)} == {"M002", "M003", "M004", "M006"}
    assert lint("let")[0].code == "M000"
    assert {f.code for f in lint("let x = 1, x = 2 in x")} >= {"M001"}
    assert dependencies(parse("let a = 1, b = a in b")) == {"a": [], "b": ["a"]}
    assert rename("let a = 1, b = a + 1 in b", "a", "new name") == "let #\"new name\" = 1, b = #\"new name\" + 1 in b"
    once = format_source("let a=1,b=each [x y]+a in if a=1 then b else {1,[q=2]}")
    assert format_source(once) == once


def test_tokens_and_analysis():
    from mlode.lang.tokens import replace_source, tokens, view

    text = 'let\n  #"a b" = 0x1F + 2.5, // note\n  c = each [x] & "q"\nin\n  Table.X(#"a b", c{0}?)'
    found = tokens(text)
    assert all(text[t["start"] : t["end"]] == t["text"] for t in found)
    assert [t["kind"] for t in found[:7]] == ["KeywordLet", "Identifier", "Equal", "HexLiteral", "Plus", "NumericLiteral", "Comma"]
    assert (found[1]["line"], found[1]["column"], found[1]["endColumn"]) == (2, 3, 9)
    steps = view(text)["analysis"]
    assert [(b["name"], b["line"]) for b in steps["bindings"]] == [("a b", 2), ("c", 3)] and {r["name"] for r in steps["resultReferences"]} == {"Table.X", "a b", "c"}
    assert "analysis" not in view("section S; shared A = 1;") and replace_source("1", "let a = 2 in a") == "let a = 2 in a"
    with pytest.raises(Exception):
        replace_source("1", "let a =")
