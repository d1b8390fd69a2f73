"""Filter expressions as boolean columns that are never null.

A *resolver* says where a field lives: a promoted string or boolean column (pushed down
to the scan), a multi-valued array, or a key of the ``text`` / ``bools`` maps.  Every leaf
is null-free, so NOT is true for rows that lack the field.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.sqe import And, Expression, Group, Literal, Not, Or, Term, fold

#: Values of one field beyond which membership is tested in a literal array instead of IN.
WIDE = 10_000


@dataclass(frozen=True)
class Fields:
    """Where fields live: scalar columns, array columns, boolean columns; the rest in map columns if there are any."""

    scalars: Mapping[str, str] = field(default_factory=dict)
    arrays: Mapping[str, str] = field(default_factory=dict)
    booleans: Mapping[str, str] = field(default_factory=dict)
    text_map: str | None = None
    bool_map: str | None = None
    #: a struct that holds the fields, where they are no columns of their own (documents in an array)
    root: Column | None = None

    def _col(self, name: str) -> Column:
        return F.col(name) if self.root is None else self.root.getField(name.strip("`"))

    def text_in(self, name: str, values: Sequence[str]) -> Column:
        if not values:
            return F.lit(False)
        if name in self.scalars:
            col = self._col(self.scalars[name])
            if len(values) > WIDE:
                return F.coalesce(F.array_contains(F.lit(list(values)), col), F.lit(False))
            return (col.eqNullSafe(values[0])) if len(values) == 1 else F.coalesce(col.isin(*values), F.lit(False))
        if name in self.arrays:
            col = self._col(self.arrays[name])
        elif self.text_map and name not in self.booleans:
            col = self._col(self.text_map)[name]
        else:
            return F.lit(False)
        found = F.array_contains(col, values[0]) if len(values) == 1 else F.exists(col, lambda x: x.isin(*values))
        return F.coalesce(found, F.lit(False))

    def bool_is(self, name: str, value: bool) -> Column:
        if name in self.booleans:
            return self._col(self.booleans[name]).eqNullSafe(value)
        if self.bool_map and name not in self.scalars and name not in self.arrays:
            return F.coalesce(F.array_contains(self._col(self.bool_map)[name], value), F.lit(False))
        return F.lit(False)


def balanced(parts: Sequence[Column], op: Callable[[Column, Column], Column]) -> Column:
    """A tree of logarithmic depth: long chains overflow the planner's stack."""
    while len(parts) > 1:
        parts = [reduce(op, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _any(literals: dict[str, list[Literal]], rest: Sequence[Column], where: Fields) -> Column:
    """Disjunction with all values of a field in one test."""
    parts = []
    for name, values in literals.items():
        text = list(dict.fromkeys(v.value for v in values if v.boolean is None))
        if text:
            parts.append(where.text_in(name, text))
        parts += [where.bool_is(name, b) for b in (True, False) if any(v.boolean is b for v in values)]
    parts += rest
    return balanced(parts, lambda a, b: a | b) if parts else F.lit(False)


def compile_predicate(expr: Expression, where: Fields) -> Column:
    """One boolean column, never null, without recursion over the expression."""

    def one(node: Expression, kids: list) -> Column | dict:
        # A term stays a dict of its literals until its parent is known, so that an OR can group them.
        if isinstance(node, Term):
            return {node.field: list(node.values)}
        if isinstance(node, Group):
            return kids[0]
        if isinstance(node, Or):
            literals: dict[str, list[Literal]] = {}
            for k in kids:
                if isinstance(k, dict):
                    for name, values in k.items():
                        literals.setdefault(name, []).extend(values)
            return _any(literals, [k for k in kids if not isinstance(k, dict)], where)
        columns = [_any(k, (), where) if isinstance(k, dict) else k for k in kids]
        return ~columns[0] if isinstance(node, Not) else balanced(columns, lambda a, b: a & b)

    found = fold(expr, one)
    return _any(found, (), where) if isinstance(found, dict) else found
