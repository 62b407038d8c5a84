"""The registry: one flat namespace of functions and constants."""

from __future__ import annotations

from typing import Any

from mlode.functions.kit import Kit


def registry(ev: Any) -> dict[str, Any]:
    from mlode.functions import lists, number, records, temporal, text, types
    from mlode.operators import joins, shape, tables
    from mlode.sources import files

    kit = Kit(ev)
    for module in (text, number, temporal, types, lists, records, tables, joins, shape, files):
        before = dict(kit.found)
        module.register(kit)
        twice = [n for n in before if kit.found[n] is not before[n]]
        if twice:
            raise ValueError(f"registered twice: {twice}")
    return kit.found
