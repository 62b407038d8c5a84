"""Record functions. Field sets are known at plan time, so these only rearrange expressions."""

from __future__ import annotations

from typing import Any

from mlode.functions.kit import Kit
from mlode.plans import values as V
from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import JSON, Col, Enum, Rec, Table, as_rec


def register(kit: Kit) -> None:
    ev, fn = kit.ev, kit.fn
    for k, name in enumerate(("Error", "Ignore", "UseNull")):
        kit.enum(f"MissingField.{name}", k)

    def rec(v: Any, name: str) -> Rec:
        if isinstance(v, Col) and v.kind == JSON:
            raise UnsupportedError(f"{name} of a JSON value whose fields depend on rows; name a field")
        r = as_rec(v)
        if r is None:
            raise EvalError(f"{name}: null is not a record")
        return r

    def missing(v: Any) -> int:
        v = ev.const(v, "missing field mode")
        n = v.value if isinstance(v, Enum) else 0 if v is None else v
        if n not in (0, 1, 2):
            raise EvalError("not a missing-field mode")
        return n

    def lost(name: str) -> EvalError:
        return EvalError(f"The field '{name}' of the record wasn't found.")

    def field(r: Any, name: Any) -> Any:
        name = ev.text(name, "field name")
        if isinstance(r, Col) and r.kind == JSON:
            return ev.json_field(r, name)
        r = rec(r, "Record.Field")
        if name not in r:
            raise lost(name)
        return r[name]

    fn("Record.Field", 2, 2, field)

    def field_or(r: Any, name: Any, default: Any = None) -> Any:
        if r is None:
            return None
        name = ev.text(name, "field name")
        if isinstance(r, Col) and r.kind == JSON and default is None:
            return ev.json_field(r, name, True)
        return rec(r, "Record.FieldOrDefault").get(name, default)

    fn("Record.FieldOrDefault", 2, 3, field_or)
    fn("Record.FieldNames", 1, 1, lambda r: list(rec(r, "Record.FieldNames")))
    fn("Record.FieldCount", 1, 1, lambda r: len(rec(r, "Record.FieldCount")))
    fn("Record.HasFields", 2, 2, lambda r, n: set(ev.names(n, "fields")) <= set(rec(r, "Record.HasFields")))

    def add(r: Any, name: Any, value: Any) -> Rec:
        r, name = rec(r, "Record.AddField"), ev.text(name, "field name")
        if name in r:
            raise EvalError(f"The field '{name}' exists already.")
        return Rec(r | {name: value})

    fn("Record.AddField", 3, 3, add)

    def remove(r: Any, names: Any) -> Rec:
        r, gone = rec(r, "Record.RemoveFields"), ev.names(names, "fields")
        for n in gone:
            if n not in r:
                raise lost(n)
        return Rec((k, v) for k, v in r.items() if k not in gone)

    fn("Record.RemoveFields", 2, 2, remove)

    def select(r: Any, names: Any, mode: Any = None) -> Rec:
        r, mode = rec(r, "Record.SelectFields"), missing(mode)
        out = Rec()
        for n in ev.names(names, "fields"):
            if n in r:
                out[n] = r[n]
            elif mode == 0:
                raise lost(n)
            elif mode == 2:
                out[n] = None
        return out

    fn("Record.SelectFields", 2, 3, select)

    def pairs(v: Any, name: str) -> list[tuple[str, Any]]:
        if isinstance(v, list) and len(v) == 2 and isinstance(v[0], (str, Col)) and not isinstance(v[0], list):
            v = [v]
        if not isinstance(v, list) or not all(isinstance(p, list) and len(p) == 2 for p in v):
            raise EvalError(f"{name}: pairs are expected")
        return [(ev.text(p[0], "field name"), p[1]) for p in v]

    def rename(r: Any, changes: Any, mode: Any = None) -> Rec:
        r, mode = rec(r, "Record.RenameFields"), missing(mode)
        names = {k: k for k in r}
        for old, new in pairs(changes, "Record.RenameFields"):
            if old in names:
                names[old] = ev.text(new, "field name")
            elif mode == 0:
                raise lost(old)
        extra = [ev.text(new, "field name") for old, new in pairs(changes, "Record.RenameFields") if old not in r and mode == 2]
        if len({*names.values(), *extra}) != len(names) + len(extra):
            raise EvalError("Record.RenameFields gives one name twice")
        return Rec([(names[k], v) for k, v in r.items()] + [(n, None) for n in extra])

    fn("Record.RenameFields", 2, 3, rename)

    def reorder(r: Any, order: Any, mode: Any = None) -> Rec:
        r, mode = rec(r, "Record.ReorderFields"), missing(mode)
        wanted = []
        for n in ev.names(order, "fields"):
            if n in r or mode == 2:
                wanted.append(n)
            elif mode == 0:
                raise lost(n)
        # named fields fill the places that named fields hold, in the new order
        turn = iter([n for n in wanted if n in r])
        out = Rec()
        for k in r:
            n = next(turn) if k in wanted else k
            out[n] = r[n]
        for n in wanted:
            out.setdefault(n, None)
        return out

    fn("Record.ReorderFields", 2, 3, reorder)

    def transform(r: Any, changes: Any, mode: Any = None) -> Rec:
        r, mode = Rec(rec(r, "Record.TransformFields")), missing(mode)
        for n, f in pairs(changes, "Record.TransformFields"):
            if n in r:
                r[n] = ev.call(f, r[n])
            elif mode == 0:
                raise lost(n)
            elif mode == 2:
                r[n] = ev.call(f, None)
        return r

    fn("Record.TransformFields", 2, 3, transform)

    def combine(records: Any) -> Rec:
        out = Rec()
        for r in records:
            out |= rec(r, "Record.Combine")
        return Rec(out)

    fn("Record.Combine", 1, 1, combine)

    def from_list(values: Any, names: Any) -> Rec:
        values = ev.const(values) if not isinstance(values, list) else values
        if isinstance(names, V.TypeValue):
            kit.refuse("a record type")
        fields = ev.names(names, "fields")
        if len(values) != len(fields) or len(set(fields)) != len(fields):
            raise EvalError("Record.FromList: values and distinct names must be as many")
        return Rec(zip(fields, values, strict=True))

    fn("Record.FromList", 2, 2, from_list)
    fn("Record.ToList", 1, 1, lambda r: list(rec(r, "Record.ToList").values()))

    def to_table(r: Any) -> Table:
        from mlode.sources.literal import from_rows

        r = rec(r, "Record.ToTable")
        return from_rows(ev, ["Name", "Value"], [[k, v] for k, v in r.items()])

    fn("Record.ToTable", 1, 1, to_table)
