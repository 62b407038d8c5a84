"""Tokens of M source and what each step of a query names, as plain data (JSON-safe)."""

from __future__ import annotations

import re
from typing import Any

from mlode.lang import syntax as S
from mlode.lang.lint import unresolved
from mlode.lang.parser import _NAME, _NUMBER, _OPERATOR, _SKIP, _STRING, KEYWORDS, parse, parse_section, plain_name
from mlode.plans.errors import ParseError

#: fixed values: kinds of punctuation and operators
MARKS = {
    "(": "LeftParenthesis", ")": "RightParenthesis", "[": "LeftBracket", "]": "RightBracket", "{": "LeftBrace", "}": "RightBrace", ",": "Comma", ";": "Semicolon", "?": "QuestionMark", "@": "AtSign", "!": "Bang",
    "=": "Equal", "<>": "NotEqual", "<": "LessThan", "<=": "LessThanEqualTo", ">": "GreaterThan", ">=": "GreaterThanEqualTo", "+": "Plus", "-": "Minus", "*": "Asterisk", "/": "Division", "&": "Ampersand",
    "=>": "FatArrow", "..": "DotDot", "...": "Ellipsis", "??": "NullCoalescingOperator",
}
_PARTS = (("Text", _STRING), ("Name", _NAME), ("Number", _NUMBER), ("Mark", _OPERATOR), ("Mark", re.compile(r"[()\[\]{},;?@!]")))


def _kind(part: str, text: str) -> str:
    if part == "Mark":
        return MARKS[text]
    if part == "Text":
        return "TextLiteral"
    if part == "Number":
        return "HexLiteral" if text[:2].lower() == "0x" else "NumericLiteral"
    if text in ("true", "false"):
        return "LogicalLiteral"
    if text == "null":
        return "NullLiteral"
    return f"Keyword{text.lstrip('#').capitalize()}" if text in KEYWORDS or re.fullmatch(r"#[a-z]+", text) else "Identifier"


def tokens(text: str) -> list[dict[str, Any]]:
    """kind, text, line, column, endLine, endColumn, start and end of each token."""
    text, at, out = text.removeprefix("﻿"), 0, []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(k: int) -> tuple[int, int]:
        line = next((i for i in range(len(starts) - 1, -1, -1) if starts[i] <= k), 0)
        return line + 1, k - starts[line] + 1

    while True:
        skipped = _SKIP.match(text, at)
        at = skipped.end() if skipped else at
        if at >= len(text):
            return out
        part, m = next(((p, m) for p, r in _PARTS if (m := r.match(text, at))), (None, None))
        line, column = place(at)
        if m is None:
            raise ParseError(f"unexpected character {text[at]!r}", line=line, column=column)
        at = m.end()
        end_line, end_column = place(at)
        out.append({"kind": _kind(part, m[0]), "text": m[0], "line": line, "column": column, "endLine": end_line, "endColumn": end_column, "start": m.start(), "end": at})


def _named(node: S.Node) -> list[dict[str, Any]]:
    return [{"name": n.name, "line": n.line, "column": n.column} for n in unresolved(node, frozenset())]


def view(text: str) -> dict[str, Any]:
    """The tokens, and for a let its steps with the free names of each and of the result. A section document has tokens alone."""
    found = tokens(text)
    if found and found[0]["kind"] == "KeywordSection":
        parse_section(text)
        return {"tokens": found}
    node = parse(text)
    if not isinstance(node, S.Let):
        return {"tokens": found}
    keys = iter(found[1:])
    steps = []
    for name, body in node.bindings:
        at = next((t for t in keys if t["kind"] == "Identifier" and plain_name(t["text"]) == name), None)
        steps.append({"name": name, "line": at["line"] if at else None, "column": at["column"] if at else None, "references": _named(body)})
    return {"tokens": found, "analysis": {"bindings": steps, "resultReferences": _named(node.body)}}


def replace_source(text: str, replacement: str) -> str:
    """The replacement for the whole of a source, if it parses; never a part of it."""
    replacement.encode("utf-8", "strict")
    view(replacement)
    return replacement
