"""Approximate quantiles as sketches that are stored and merged (KLL)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

#: Accuracy parameter of the sketches, some 10 KB each.
K = 800
#: Ranks are meant to be off by at most this part of the values. A sketch of K has half of that, and less,
#: in 99 of 100 cases; the rest of the margin makes a rank beyond it a matter of one in 10 ** 9.
RANK_ERROR = 0.01
#: Tasks that merge the sketches of one group before they meet.
FAN = 32

SKETCH = "sketch"


def as_whole(df: DataFrame, value: str) -> tuple[Column, int]:
    """The value as a whole number and how many decimal places that shifts it."""
    kind = df.schema[value].dataType
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return (F.col(value).cast(DecimalType(38, kind.scale)) * F.lit(10**kind.scale)).cast("bigint"), kind.scale
    if isinstance(kind, IntegralType):
        return F.col(value).cast("bigint"), 0
    raise TypeError(f"a sketch of whole numbers or decimals of up to 18 digits; {value} is {kind.simpleString()}")


def sketches(df: DataFrame, value: str, by: Sequence[str | Column], k: int = K) -> DataFrame:
    """One sketch per group, built in the tasks that read the rows; NULLs are left out. A group of NULLs has none."""
    whole, _ = as_whole(df, value)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(whole, k).alias(SKETCH))


def merged(states: DataFrame, by: Sequence[str], salt: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups, in two steps: FAN tasks per group by the hash of ``salt``, then one."""
    parts = states.groupBy(*by, F.pmod(F.xxhash64(*salt), F.lit(FAN)).alias("fan")).agg(
        F.kll_merge_agg_bigint(SKETCH, k).alias(SKETCH)
    )
    return parts.groupBy(*by).agg(F.kll_merge_agg_bigint(SKETCH, k).alias(SKETCH))


def sketched_quantiles(states: DataFrame, probs: dict[str, float], scale: int = 0) -> DataFrame:
    """``states`` with ``n`` values and a decimal column per name, instead of the sketch."""
    found = {
        name: (F.kll_sketch_get_quantile_bigint(SKETCH, F.lit(float(p))).cast("decimal(38,0)") / F.lit(10**scale)).cast(f"decimal(38,{scale})")
        for name, p in probs.items()
    }
    return states.withColumns({"n": F.kll_sketch_get_n_bigint(SKETCH), **found}).drop(SKETCH)
