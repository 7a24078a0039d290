"""Plans and results under skew: one user, ad-day or channel holds much of the data."""

from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitlens.catalog import QUERIES
from unitlens.operators.cohorts import cohort_window_join
from unitlens.operators.skew import Skew, hot_keys
from unitlens.plans import acquisition, data_quality, economics, profiling, revenue
from unitlens.sources import Tables, read_orders, read_product_events, write_mart

FOLDER = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    """Run the query and return the plan that adaptive execution ended with."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    text = execution.executedPlan().toString()
    return re.split(r"\n\+- == Initial Plan ==", text)[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in plan


def test_scans_read_only_the_columns_used(spark):
    plan = QUERIES["dq_snapshot_structure"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.fixture
def whole_plans(conf):
    with conf(spark__sql__maxMetadataStringLength="3000"):
        yield


def test_stored_tables_get_filters_and_columns_pushed(spark, tmp_path, whole_plans):
    tables = Tables(spark, FOLDER)
    for name in ("product_events", "orders"):
        write_mart(getattr(tables, name), str(tmp_path / name))
    events = read_product_events(spark, str(tmp_path / "product_events"))
    orders = read_orders(spark, str(tmp_path / "orders"))
    plan = revenue.ltv_by_channel(events, orders)._jdf.queryExecution().toString()
    pushed = set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan))
    assert any("EqualTo(event_type,registration)" in filters for filters in pushed)
    assert any("IsNotNull(user_id)" in f and "IsNotNull(timestamp)" in f for f in pushed), pushed
    plan = profiling.date_coverage(events, orders)._jdf.queryExecution().toString()
    assert plan.count("ReadSchema: struct<timestamp:timestamp_ntz>") == 2


def test_snapshots_are_limited_before_and_after_the_shuffle(spark):
    ads = Tables(spark, FOLDER).ads
    plan = acquisition.latest_ads(ads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cohort_shuffle_is_used_twice(spark):
    plan = executed_plan(QUERIES["ltv_by_channel"](spark, FOLDER))
    assert "ReusedExchange" in plan
    assert plan.count("FileScan parquet [c_custkey") == 1


def test_amounts_are_counted_once(spark):
    plan = executed_plan(QUERIES["amount_distribution"](spark, FOLDER))
    assert plan.count("FileScan") == 1


def hot_user_tables(spark, n=60_000):
    """A third of the payments belong to user 0, who registered in two channels."""
    ids = spark.range(0, n, numPartitions=8)
    minute = F.make_dt_interval(mins=(F.col("id") % 400_000).cast("int"))
    orders = ids.select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("user_id"),
        F.element_at(
            F.array(F.lit("purchase"), F.lit("rebill"), F.lit("upsell")),
            (F.col("id") % 7 % 3 + 1).cast("int"),
        ).alias("event"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minute).alias("timestamp"),
        (F.col("id") % 5000 / 100).cast("decimal(12,2)").alias("amount"),
    )
    users = spark.range(997).select(
        F.col("id").alias("user_id"),
        F.lit("registration").alias("event_type"),
        (
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval((F.col("id") % 30).cast("int"))
        ).alias("timestamp"),
        F.when(F.col("id") % 5 == 0, "google").otherwise("meta").alias("channel"),
    )
    second = users.where("user_id = 0").withColumn("channel", F.lit("tiktok"))
    return users.unionByName(second), orders


def plain_left_join(events, orders):
    """Users and revenue per channel, written as one left join."""
    joined = revenue.registrations(events).alias("r").join(
        orders.alias("o"),
        F.expr(
            "r.user_id = o.user_id and o.timestamp >= r.registration_ts"
            " and o.timestamp < r.registration_ts + interval 6 months"
        ),
        "left",
    )
    return {
        r.channel: (r.users, r.revenue)
        for r in joined.groupBy("r.channel")
        .agg(
            F.countDistinct("r.user_id").alias("users"),
            F.sum(F.coalesce("o.amount", F.lit(0))).alias("revenue"),
        )
        .collect()
    }


def found_in(components):
    return {r.channel: (r.registered_users, r.total_revenue) for r in components.collect()}


def test_adaptive_execution_may_split_the_join(spark, conf):
    events, orders = hot_user_tables(spark)
    with conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        components = revenue.channel_components(events, orders)
        plan = executed_plan(components)
        found = found_in(components)
    assert "SortMergeJoin(skew=true)" in plan
    assert found == plain_left_join(events, orders)


def test_hot_keys_are_few(spark):
    _, orders = hot_user_tables(spark)
    assert hot_keys(orders, "user_id", Skew(rows_per_task=500, fraction=1.0)) == [0]
    assert hot_keys(orders, "user_id", Skew(rows_per_task=2000, fraction=0.05)) == [0]
    # Every user has more than 30 payments and none more than 300 but the first: the bound holds.
    many = orders.withColumn("user_id", F.col("user_id") % 50)
    assert len(hot_keys(many, "user_id", Skew(100, 1.0, most=7))) == 7
    assert len(hot_keys(many, "user_id", Skew(100, 1.0))) == 50


def test_a_sample_that_tells_nothing_is_refused():
    with pytest.raises(ValueError, match="sampled rows"):
        Skew(1000, 0.0001)


def test_hot_user_is_spread_and_nothing_is_lost(spark, conf):
    events, orders = hot_user_tables(spark)
    first = orders.first()
    copies = spark.range(0, 5000, numPartitions=8).select(
        *(F.lit(first[f.name]).cast(f.dataType).alias(f.name) for f in orders.schema)
    )
    for facts in (orders, orders.unionByName(copies)):
        expected = plain_left_join(events, facts)
        with conf(spark__sql__autoBroadcastJoinThreshold="-1"):
            for skew in (Skew(500, 1.0), Skew(2000, 0.05), Skew()):
                components = revenue.channel_components(events, facts, skew=skew)
                assert found_in(components) == expected


def test_hot_user_is_not_shuffled(spark, conf):
    events, orders = hot_user_tables(spark)
    with conf(spark__sql__autoBroadcastJoinThreshold="-1"):
        components = revenue.channel_components(events, orders, skew=Skew(500, 1.0))
        plan = executed_plan(components)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_bucketed_payments_are_not_shuffled_and_only_their_period_is_read(spark, conf, tmp_path):
    events, orders = hot_user_tables(spark)
    for name, df in (("bucketed_events", events), ("bucketed_orders", orders)):
        writer = df.write.bucketBy(4, "user_id").sortBy("user_id").option("path", str(tmp_path / name))
        writer.mode("overwrite").saveAsTable(name)
    try:
        with conf(
            spark__sql__autoBroadcastJoinThreshold="-1",
            spark__sql__adaptive__enabled="false",
            spark__sql__sources__bucketing__enabled="true",
            spark__sql__maxMetadataStringLength="3000",
        ):
            stored = spark.table("bucketed_events"), spark.table("bucketed_orders")
            cohort = revenue.registrations(stored[0])
            paid = cohort_window_join(
                cohort, stored[1], "user_id", "registration_ts", "timestamp", 6,
                period=revenue.registration_period(stored[0]),
            )
            plan = paid._jdf.queryExecution().executedPlan().toString()
            assert found_in(revenue.channel_components(*stored)) == plain_left_join(*stored)
        join = plan[plan.index("SortMergeJoin") :]
        payments = join[: join.index("FileScan")]
        assert "Exchange hashpartitioning(user_id" not in payments
        scan = next(line for line in join.splitlines() if "amount" in line and "FileScan" in line)
        pushed = scan[scan.index("PushedFilters") :]
        assert "GreaterThanOrEqual(timestamp,2024-01-01" in pushed and "LessThan(timestamp,2024-07-30" in pushed
    finally:
        for name in ("bucketed_events", "bucketed_orders"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_shared_period_reaches_the_scan(spark, tmp_path, whole_plans):
    tables = Tables(spark, FOLDER)
    write_mart(tables.product_events, str(tmp_path / "e"))
    events = read_product_events(spark, str(tmp_path / "e"))
    report = economics.registration_reconciliation_shared_period(events, tables.ads)
    plan = report._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "event_type" in x]
    pushed = [x[x.index("PushedFilters") :] for x in scans]
    assert any("GreaterThanOrEqual(timestamp," in x and "LessThan(timestamp," in x for x in pushed), pushed


def test_verdicts_scan_each_table_little(spark):
    plan = QUERIES["dq_verdicts"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6


def test_hot_ad_day_is_reduced_before_the_shuffle(spark):
    """Before the shuffle each task keeps one snapshot of an ad-day."""
    ids = spark.range(0, 40_000, numPartitions=8)
    ads = ids.select(
        F.lit("meta").alias("source"),
        F.lit(1).cast("bigint").alias("campaign_id"),
        F.lit(1).cast("bigint").alias("adset_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("ad_id"),
        F.lit("2024-01-02").cast("date").alias("date"),
        F.col("id").cast("decimal(18,2)").alias("spend"),
        *(F.col("id").alias(m) for m in ("impressions", "clicks", "installs", "registrations")),
        F.lit("2024-01-02 08:00:00").alias("timestamp"),
    )
    latest = acquisition.latest_ads(ads)
    assert rows(latest.where("ad_id = 0").select("spend"))[0][0] == 39_999
    assert latest.count() == 50
    assert rows(data_quality.dq_snapshot_structure(ads).agg(F.sum("ad_day_groups"))) == [(50,)]

    lines = executed_plan(latest).splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert any("row_number(), 1, Partial" in line for line in lines[shuffle:])
