"""Funnels as rows, from a table with one count column per step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.functions import ratio


@dataclass(frozen=True)
class Step:
    """``name`` is shown, ``column`` holds the count, ``parent`` is the step it follows."""

    name: str
    column: str
    parent: str | None = None


def chain(*columns: str) -> list[Step]:
    """Steps that each follow the one before."""
    parents = (None, *columns[:-1])
    return [Step(c, c, parent) for c, parent in zip(columns, parents, strict=True)]


def funnel(
    df: DataFrame,
    steps: Sequence[Step],
    value: str,
    by: Sequence[str] = (),
    overall: bool = True,
    digits: int = 4,
) -> DataFrame:
    """Turn step columns into step rows with conversion from the parent and from the start.

    The counts of one funnel sit in one row, so the rates need no window or join.
    """
    column = {step.name: step.column for step in steps}
    rows = []
    for number, step in enumerate(steps, start=1):
        count = F.col(step.column)
        from_parent = (
            F.lit(None).cast("double")
            if step.parent is None
            else ratio(count, F.col(column[step.parent]), digits=digits)
        )
        fields = [
            F.lit(number).cast("bigint").alias("step_no"),
            F.lit(step.name).alias("step"),
            count.alias(value),
            from_parent.alias("step_cr"),
        ]
        if overall:
            from_start = ratio(count, F.col(steps[0].column), digits=digits)
            fields.append(from_start.alias("overall_cr"))
        rows.append(F.struct(*fields))
    return df.select(*by, F.inline(F.array(*rows)))
