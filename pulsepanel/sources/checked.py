"""Checks in flight: counted by the write that happens anyway.

A guard that counts rows, null keys or classes is one more pass over its
input.  ``DataFrame.observe`` counts while the rows are written, so the guards
of a stage cost no job of their own.  The rows are checked after the write and
before they are used: a table that fails is never returned or published.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pulsepanel.sources.sinks import materialize


class CheckFailed(ValueError):
    """Written rows break a rule."""


#: Metrics of rows: name -> (aggregate, whether the value is right, complaint).
Rule = tuple[F.Column, Callable[[object], bool], str]


def has_rows(what: str = "input") -> dict[str, Rule]:
    return {"rows": (F.count(F.lit(1)), lambda n: n > 0, f"{what} has no rows")}


def no_nulls(columns, what: str = "input") -> dict[str, Rule]:
    return {f"null_{c}": (F.count(F.when(F.col(f"`{c}`").isNull(), 1)), lambda n: n == 0,
                          f"{what} has null values in {c}") for c in columns}


def two_classes(label: str, among=None, what: str = "training data") -> dict[str, Rule]:
    """Both classes of a 0/1 label occur (among the rows that ``among`` holds for)."""
    hit = F.col(label).isNotNull() & (F.lit(True) if among is None else among)
    return {f"classes_{label}": (
        F.struct(F.count(F.when(hit & (F.col(label) > 0), 1)).alias("pos"),
                 F.count(F.when(hit & (F.col(label) <= 0), 1)).alias("neg")),
        lambda c: c["pos"] > 0 and c["neg"] > 0, f"{what} has a single class")}


def total(name: str, column, expected: int, what: str = "input") -> dict[str, Rule]:
    """The sum of a column is what another table says."""
    return {name: (F.coalesce(F.sum(column), F.lit(0)), lambda n: n == expected,
                   f"{what}: {name} is not {expected}")}


def observed(df: DataFrame, rules: dict[str, Rule], write) -> dict:
    """Runs ``write`` on ``df`` and returns the metrics that it counted; raises
    :class:`CheckFailed` with every rule that is broken."""
    seen = Observation()
    result = write(df.observe(seen, *[agg.alias(name) for name, (agg, _, _) in rules.items()]))
    try:
        found = seen.get
    except Py4JJavaError:  # the optimizer has dropped the counting with the last row
        empty = df.sparkSession.createDataFrame([], df.schema)
        found = empty.agg(*[agg.alias(name) for name, (agg, _, _) in rules.items()]).first().asDict()
    broken = [said for name, (_, right, said) in rules.items() if not right(found[name])]
    if broken:
        raise CheckFailed("; ".join(broken))
    return {"result": result, **found}


def materialize_checked(df: DataFrame, name: str, rules: dict[str, Rule]) -> tuple[DataFrame, dict]:
    """:func:`materialize` with rules; (written table, metrics)."""
    found = observed(df, rules, lambda x: materialize(x, name))
    return found.pop("result"), found
