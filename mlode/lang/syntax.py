"""Syntax tree of the M language: the kinds that the evaluator takes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    line: int = field(default=0, kw_only=True)
    column: int = field(default=0, kw_only=True)


@dataclass
class Literal(Node):
    value: Any


@dataclass
class Name(Node):
    name: str


@dataclass
class Let(Node):
    bindings: list[tuple[str, Node]]
    body: Node


@dataclass
class If(Node):
    test: Node
    then: Node
    other: Node


@dataclass
class RecordLit(Node):
    fields: list[tuple[str, Node]]


@dataclass
class ListLit(Node):
    items: list[Node]


@dataclass
class Function(Node):
    params: list[str]
    body: Node
    each: bool = False


@dataclass
class Field(Node):
    target: Node | None
    name: str
    optional: bool


@dataclass
class Item(Node):
    target: Node
    index: Node
    optional: bool


@dataclass
class Call(Node):
    target: Node
    args: list[Node]


@dataclass
class Try(Node):
    body: Node
    otherwise: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Unary(Node):
    op: str
    operand: Node


@dataclass
class TypeLit(Node):
    name: str
    fields: list[str] | None = None


@dataclass
class Refused(Node):
    what: str


def children(node: Node) -> list[Node]:
    out: list[Node] = []
    for value in vars(node).values():
        if isinstance(value, Node):
            out.append(value)
        elif isinstance(value, list):
            for x in value:
                if isinstance(x, Node):
                    out.append(x)
                elif isinstance(x, tuple):
                    out += [y for y in x if isinstance(y, Node)]
    return out


def walk(node: Node):
    yield node
    for child in children(node):
        yield from walk(child)
