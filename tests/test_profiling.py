from __future__ import annotations

import math
from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from fixtures import events_df, orders_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitlens.functions import mean, ratio, rounded
from unitlens.operators.profiling import table_schema
from unitlens.operators.quantiles import quantiles_of
from unitlens.plans import profiling


def test_schema_overview_counts_nulls(spark):
    events = events_df(spark, [(None, "install", "2024-01-01 00:00:00", "meta")])
    overview = rows(profiling.schema_overview(events, orders_df(spark, [])))
    assert overview[0] == ("orders", "user_id", "bigint", "YES", 0)
    assert overview[3][1:3] == ("amount", "decimal(12,2)")
    assert overview[4] == ("product_events", "user_id", "bigint", "YES", 1)


def test_coverage_counts_both_ends(spark):
    events = events_df(
        spark,
        [
            (1, "install", "2024-01-01 23:59:59", "meta"),
            (2, "install", "2024-01-03 00:00:00", "meta"),
        ],
    )
    result = rows(profiling.date_coverage(events, orders_df(spark, [])))
    assert result[0][3] == 3
    assert result[1] == ("orders", None, None, None)


def test_days_follow_the_calendar(spark):
    events = events_df(
        spark,
        [
            (1, "install", "2024-01-01 23:59:59", "meta"),
            (1, "like", "2024-01-01 00:00:00", "meta"),
            (2, "install", "2024-01-02 00:00:00", "meta"),
        ],
    )
    assert rows(profiling.daily_activity(events)) == [
        (date(2024, 1, 1), 2, 1),
        (date(2024, 1, 2), 1, 1),
    ]


def test_amount_distribution_skips_nulls_and_survives_none(spark):
    t = "2024-01-01 00:00:00"
    orders = orders_df(spark, [(1, "purchase", t, a) for a in (None, 1, 2, 2, 10)])
    assert rows(profiling.amount_distribution(orders)) == [
        (4, 4, 1.0, 10.0, 3.75, 1.0, 2.0, 2.0)
    ]
    assert rows(profiling.amount_distribution(orders.where("amount is null"))) == [
        (0, 0, None, None, None, None, None, None)
    ]


def test_averages_round_ties_up(spark):
    df = spark.createDataFrame([(Decimal("1145659.95"),)] + [(Decimal("0"),)] * 5, "a decimal(12,2)")
    from pyspark.sql import functions as F

    assert rows(df.agg(mean(F.col("a"), 2))) == [(190943.33,)]
    ties = spark.createDataFrame([(1.005,), (0.285,), (-2.675,), (None,)], "x double")
    assert [r[0] for r in ties.select(rounded(F.col("x"), 2)).collect()] == [
        1.01,
        0.29,
        -2.68,
        None,
    ]
    zero = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    assert rows(zero.select(ratio(F.col("a"), F.col("b")))) == [(None,), (None,)]


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(
            st.integers(-300, 300),
            st.integers(-(10**12) + 1, 10**12 - 1),
            st.sampled_from([4999, 2499, 2000]),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_quantiles_equal_sorted_ranks(spark, cents):
    values = [Decimal(c).scaleb(-2) for c in cents]
    df = spark.createDataFrame([(v,) for v in values], "amount decimal(12,2)").repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    ordered = sorted(values)
    expected = tuple(ordered[max(1, math.ceil(p * len(values))) - 1] for p in probs)
    assert rows(quantiles_of(df, "amount", probs)) == [expected]


@pytest.mark.parametrize("kind", ["decimal(18,2)", "bigint", "double", "decimal(38,6)", "int"])
def test_quantiles_of_any_numeric_type(spark, kind):
    whole = [0, 1, -1, 7, 7, 7, 10**4, -(10**4), 123456789, -(2**31), 2**31 - 1]
    values = {
        "decimal(18,2)": [Decimal(x) / 100 for x in [*whole, 10**18 - 1, 1 - 10**18, 10**17]],
        "bigint": [*whole, 2**63 - 1, -(2**63), 10**18],
        "double": [float(x) for x in whole] + [5e-324, -5e-324, 1e308, -1e308, 2.0**-1022, 1 / 3, 0.1, float("inf")],
        "decimal(38,6)": [Decimal(x) / 10**6 for x in whole] + [Decimal(10) ** 31, -(Decimal(10) ** 31)],
        "int": whole,
    }[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"amount {kind}").repartition(2)
    probs = [k / 20 for k in range(21)]
    ordered = sorted(values)
    expected = tuple(ordered[max(1, math.ceil(p * len(values))) - 1] for p in probs)
    assert rows(quantiles_of(df, "amount", probs)) == [expected]


def test_quantiles_refuse_text(spark):
    with pytest.raises(TypeError, match="numeric"):
        quantiles_of(spark.createDataFrame([("a",)], "amount string"), "amount", [0.5])


def test_table_schema_reads_nothing(spark):
    events = events_df(spark, []).where(F.raise_error(F.lit("read")) == 1)
    assert table_schema(events)[0][:2] == ("user_id", "bigint")
