"""Estimates over months of age when some entities are observed for less than all of them."""

from __future__ import annotations

from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitlens.functions import ratio


def converted(first: str, observed: str, users: str, months: int) -> Column:
    """Product-limit estimate of the part that has an event within ``months``.

    An aggregate over rows that count ``users`` by the month of their first event, NULL without one, and by
    the number of months observed. Someone is at risk in a month if it was observed and no event came before it.
    """
    event, seen, n = F.col(first), F.col(observed), F.col(users)
    stay = []
    for k in range(months):
        at_risk = F.sum(F.when((seen > k) & F.coalesce(event >= k, F.lit(True)), n).otherwise(0))
        had_it = F.sum(F.when((seen > k) & F.coalesce(event == k, F.lit(False)), n).otherwise(0))
        anyone = F.sum(F.when(seen > k, n).otherwise(0))
        # If all had their event earlier nobody is at risk and nothing changes; unobserved is unknown.
        rest = F.when((anyone > 0) & (at_risk == 0), F.lit(1.0)).otherwise(1 - ratio(had_it, at_risk))
        stay.append(rest)
    return 1 - reduce(mul, stay)


def mean_cumulative(sums: list[Column], at_risk: list[Column]) -> Column:
    """Sum over months of what one observed entity has in each."""
    return reduce(add, [ratio(s, r) for s, r in zip(sums, at_risk, strict=True)])
