"""Keys that hold many rows, found before a join so that it can treat them apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sample that say something about a key's size.
LEAST_COUNTED = 100


@dataclass(frozen=True)
class Skew:
    """A key with about ``rows_per_task`` rows or more is hot; at most ``most`` keys are.

    Keys are counted on a sample of their column. The sample only decides which way a key's rows take
    through the join: every row takes one of them, and both give the same result. Keys beyond ``most``
    take the usual way, where adaptive execution splits them as it sees their size.
    """

    rows_per_task: int = 1_000_000
    fraction: float = 0.001
    most: int = 1000

    def __post_init__(self):
        if self.fraction < 1 and self.rows_per_task * self.fraction < LEAST_COUNTED:
            raise ValueError(
                f"a hot key would have {self.rows_per_task * self.fraction:g} sampled rows;"
                f" at least {LEAST_COUNTED} are needed to tell it from others"
            )


def hot_keys(df: DataFrame, key: str, skew: Skew) -> list:
    """The hottest keys, at most ``skew.most`` whatever the data. The list is read here, once, so
    that all uses of it are the same."""
    column = df.select(key).where(F.col(key).isNotNull())
    if skew.fraction < 1:
        column = column.sample(skew.fraction, seed=1)
    counted = column.groupBy(key).agg(F.count("*").alias("n"))
    hot = counted.where(F.col("n") >= skew.rows_per_task * skew.fraction).orderBy(F.desc("n"), key)
    return [row[0] for row in hot.limit(skew.most).collect()]
