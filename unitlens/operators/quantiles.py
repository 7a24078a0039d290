"""Exact discrete quantiles of a numeric column."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType, LongType

#: Decimal digits that one level settles: at most a million bands of either sign. Amounts of twelve digits take two levels.
DIGITS = 6
SMALLEST_NORMAL = -1022
#: Digits that any BIGINT code has room for, together with the band that it is in.
LONG_DIGITS = 18


def band_of(code: Column, digits: int, level: int) -> Column:
    """The code without its last DIGITS * ``level`` digits, in the code's type."""
    if digits <= LONG_DIGITS:
        return code - F.pmod(code, F.lit(10 ** (DIGITS * level)).cast("bigint"))
    return (code - F.pmod(code, F.lit(Decimal(10) ** (DIGITS * level)))).cast("decimal(38,0)")


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """Rows per distinct non-NULL value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))


def ordered_code(value: Column, kind: DataType) -> tuple[Column, int]:
    """A whole number with the order of the values, and the digits that it has at most.

    It is a BIGINT where 18 digits are enough, a decimal otherwise. For DOUBLE it is made of the exponent
    and the fraction, as in the stored bits.
    """
    if isinstance(kind, DecimalType) and kind.precision <= LONG_DIGITS:
        return (value.cast(DecimalType(38, kind.scale)) * F.lit(Decimal(10) ** kind.scale)).cast("bigint"), kind.precision
    if isinstance(kind, IntegralType) and not isinstance(kind, LongType):
        return value.cast("bigint"), 10
    if isinstance(kind, DecimalType):
        if kind.scale == 0:
            return value.cast("decimal(38,0)"), kind.precision
        # Whole and fraction apart: a product of 38 digits would lose its last ones.
        unit = F.lit(Decimal(10) ** kind.scale)
        whole = F.floor(value)
        fraction = ((value - whole) * unit).cast("decimal(38,0)")
        return (whole.cast("decimal(38,0)") * unit + fraction).cast("decimal(38,0)"), kind.precision
    if isinstance(kind, IntegralType):
        return value.cast("decimal(38,0)"), 19
    if not isinstance(kind, (DoubleType, FloatType)):
        raise TypeError(f"quantiles need a numeric column, not {kind.simpleString()}")
    size = F.abs(value.cast("double"))
    two = F.lit(2.0)
    # The logarithm may miss a power of two by its last bit; one step corrects it.
    guess = F.greatest(F.floor(F.log2(size)), F.lit(SMALLEST_NORMAL))
    guess = F.when(size < F.pow(two, guess), guess - 1).when(size / 2 >= F.pow(two, guess), guess + 1).otherwise(guess)
    power = F.greatest(guess, F.lit(SMALLEST_NORMAL))
    whole = F.pow(two, F.lit(52.0))
    fraction = F.when(size >= F.pow(two, power), size / F.pow(two, power) - 1).otherwise(size / F.pow(two, power))
    level = F.when(size >= F.pow(two, power), power - SMALLEST_NORMAL + 1).otherwise(F.lit(0))
    bits = level.cast("decimal(38,0)") * F.lit(Decimal(2**52)) + (fraction * whole).cast("decimal(38,0)")
    finite = F.when(size == 0, F.lit(Decimal(0))).when(size == float("inf"), F.lit(Decimal(2047 * 2**52))).otherwise(bits)
    signed = F.when(value < 0, -finite).otherwise(finite)
    return F.when(F.isnan(value), F.lit(Decimal(2047 * 2**52 + 1))).otherwise(signed).cast("decimal(38,0)"), 19


def discrete_quantiles(freq: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """The smallest value with at least ``p * total`` rows at or below it, per name.

    Works on ``frequencies``. Values become whole numbers of the same order, which are found digit by
    digit: a level counts the rows of each band of DIGITS more digits, inside the bands that the level
    before found, and running counts tell the band that holds each rank. So a window has at most
    2 * 10 ** DIGITS rows per quantile, whatever the data and the type. NaN is above infinity.
    """
    code, digits = ordered_code(F.col(value), freq.schema[value].dataType)
    coded = freq.select(F.col(value).alias("value"), "n", code.alias("code"))
    levels = list(range(-(-digits // DIGITS) - 1, -1, -1))

    def band(level: int) -> Column:
        return F.col("code") if level == 0 else band_of(F.col("code"), digits, level)

    by_band = Window.orderBy("band")
    whole = by_band.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(whole)
    ranks = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("total") * p)).alias("rank"))
            for name, p in probs.items()
        )
    )

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "band").agg(F.sum("n").alias("n"), F.max("value").alias("value"))

    first = counted(coded.withColumn("band", band(levels[0])))
    first = first.select("band", "n", "value", F.sum("n").over(by_band).alias("upto"), total.alias("total"))
    hits = first.select("band", "n", "value", "upto", F.inline(ranks))
    for level in levels[1:]:
        hits = hits.where("rank > upto - n and rank <= upto").select(
            F.col("band").alias("hit_band"), "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")
        )
        # `hits` has one row per requested quantile, which is what bounds the broadcast. Bands are
        # never NULL; the null-safe comparison keeps a filter on them out of the scan, so that the
        # frequencies are computed once for all levels.
        inside = coded.withColumn("outer", band(level + 1)).withColumn("band", band(level))
        inside = inside.join(F.broadcast(hits), F.col("outer").eqNullSafe(F.col("hit_band")))
        in_band = Window.partitionBy("name").orderBy("band")
        hits = counted(inside, "name", "rank").withColumn("upto", F.sum("n").over(in_band))
    found = hits.where("rank > upto - n and rank <= upto")
    return found.agg(
        *(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in probs)
    )


def grouped_quantiles(freq: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``discrete_quantiles`` per group of ``by``, whose columns come first.

    The same bands, counted per group; a group of any size is spread over its bands, and a window has
    at most 2 * 10 ** DIGITS rows per group and quantile. What a level found joins by group and band.
    """
    code, digits = ordered_code(F.col(value), freq.schema[value].dataType)
    coded = freq.select(*by, F.col(value).alias("value"), "n", code.alias("code"))
    levels = list(range(-(-digits // DIGITS) - 1, -1, -1))

    def band(level: int) -> Column:
        return F.col("code") if level == 0 else band_of(F.col("code"), digits, level)

    group = Window.partitionBy(*by)
    ranks = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("total") * p)).alias("rank"))
            for name, p in probs.items()
        )
    )
    first = coded.groupBy(*by, band(levels[0]).alias("band")).agg(F.sum("n").alias("n"), F.max("value").alias("value"))
    first = first.withColumns({"upto": F.sum("n").over(group.orderBy("band")), "total": F.sum("n").over(group)})
    hits = first.select(*by, "band", "n", "value", "upto", F.inline(ranks))
    for level in levels[1:]:
        hits = hits.where("rank > upto - n and rank <= upto").select(
            *(F.col(c).alias(f"hit_{c}") for c in by), F.col("band").alias("hit_band"), "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")
        )
        same = F.col("outer") == F.col("hit_band")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"hit_{c}"))
        inside = coded.withColumn("outer", band(level + 1)).withColumn("band", band(level)).join(hits, same)
        hits = inside.groupBy(*by, "name", "rank", "band").agg(F.sum("n").alias("n"), F.max("value").alias("value"))
        hits = hits.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "name").orderBy("band")))
    found = hits.where("rank > upto - n and rank <= upto")
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in probs))


def quantiles_of(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with a column ``p25`` style name per probability."""
    named = {f"p{100 * p:g}".replace(".", "_"): p for p in probs}
    return discrete_quantiles(frequencies(df, value), value, named)
