"""try ... otherwise over rows.

Under ANSI rules a failing cell fails the job, so the attempt is compiled in a
flavour whose failures are nulls, and every step that can fail adds the condition
under which it does to the context: a conversion that doesn't convert, a check
that isn't met, a division by zero, an item that isn't there. Conditions of a
branch hold only where the branch is taken. A cell is failed if one of them holds;
a null that no step failed to make is a value like any other.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import functions as F

from mlode.lang import syntax as S
from mlode.plans.errors import UnsupportedError
from mlode.plans.values import Col, as_col


def without_errors(ev: Any, node: S.Try, scope: Any, value: Col) -> Col:
    outer, ev.ctx.failures = ev.ctx.failures, []
    try:
        soft = as_col(ev.eval(node.body, scope))
    finally:
        found, ev.ctx.failures = ev.ctx.failures, outer
    for f in found:
        if "namedlambdavariable" in str(f) and "lambdafunction" not in str(f):
            raise UnsupportedError("try around a list function whose steps can fail")
    if not found:
        return value
    failed = reduce(or_, [F.coalesce(f, F.lit(False)) for f in found])
    o = as_col(ev.typed_like(ev.where(failed, node.otherwise, scope), soft))
    soft = as_col(ev.typed_like(soft, o))
    return Col(F.when(failed, o.c).otherwise(soft.c), soft.kind if soft.kind.name != "null" else o.kind)
