"""Ordered rule tables compiled to column expressions.

A rule fires when ``include`` matches and ``exclude`` does not; the first rule
that fires wins.  A table is data, the compiler turns it into one ``CASE`` that
yields the rule number, and outputs are read from literal arrays by number, so
every regular expression is evaluated at most once per row and no join or
shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.text import edges


@dataclass(frozen=True)
class Rule:
    include: str
    out: Any
    exclude: str | None = None
    category: tuple[str, ...] | None = None
    scope: str = "text"  # "text" or "name": which of the two inputs is matched
    also: str | None = None  # second pattern that has to match as well

    def condition(self, text: Column, name: Column | None = None, category: Column | None = None) -> Column:
        target = name if self.scope == "name" and name is not None else text
        test = target.rlike(edges(self.include)) if self.include else F.lit(True)
        if self.also:
            test = test & target.rlike(edges(self.also))
        if self.exclude:
            test = test & ~target.rlike(edges(self.exclude))
        if self.category is not None and category is not None:
            test = category.isin(*self.category) & test
        return test


@dataclass(frozen=True)
class RuleTable:
    """``columns`` name the positions of each rule's ``out`` tuple (or the scalar)."""

    rules: Sequence[Rule]
    columns: tuple[str, ...] = ("label",)
    default: Any = None
    types: dict[str, str] = field(default_factory=dict)

    def first(self, text: Column, name: Column | None = None, category: Column | None = None) -> Column:
        """1-based number of the first rule that fires, else null."""
        out: Column | None = None
        for number, rule in enumerate(self.rules, start=1):
            test = rule.condition(text, name, category)
            out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
        assert out is not None
        return out

    def output(self, number: Column, column: str) -> Column:
        position = self.columns.index(column)
        values = [_cell(r.out, position) for r in self.rules]
        # The plain lookup is typed non-null under ANSI even where the number is null.
        found = F.try_element_at(F.array(*(F.lit(v) for v in values)), number)
        if self.default is not None:
            found = F.coalesce(found, F.lit(_cell(self.default, position)))
        kind = self.types.get(column)
        return found.cast(kind) if kind else found

    def all_labels(self, text: Column, name: Column | None = None, category: Column | None = None) -> Column:
        """Labels of every rule that fires, in rule order."""
        hits = [F.when(r.condition(text, name, category), F.lit(_cell(r.out, 0))) for r in self.rules]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _cell(out: Any, position: int) -> Any:
    return out[position] if isinstance(out, tuple) else out


def present(*items: Column) -> Column:
    """Array of the non-null items, order kept: the shape of every multi-valued check."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once: filters and further columns cannot be merged into a generator's output."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
