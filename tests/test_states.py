"""States that are stored and merged: bitmaps, sketches, last snapshots, and the marts that hold them."""

from __future__ import annotations

import hashlib
import itertools
import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from conftest import rows
from fixtures import ads_df
from pyspark.sql import functions as F

from unitlens.operators.distinct import distinct_counts, distinct_states, united
from unitlens.operators.quantiles import grouped_quantiles, quantiles_of
from unitlens.operators.sketches import RANK_ERROR, merged, sketched_quantiles, sketches
from unitlens.plans import acquisition, states
from unitlens.sources import Tables, forget_versions, publish, read_mart
from unitlens.sources.marts import Folder, manifest_of

FOLDER = "/root/testdata/sf0.001"


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "day string, n int")


def files_of(path):
    return sorted(hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).rglob("part-*.parquet"))


def test_partitions_are_replaced_and_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "mart")
    publish(table(spark, ("a", 1), ("b", 2), (None, 3)), path, "one", by="day")
    publish(table(spark, ("b", 20), ("b/c", 4)), path, "two", by="day", replaces=["b", "b/c"])
    assert sorted(rows(read_mart(spark, path)), key=str) == sorted([("a", 1), ("b", 20), (None, 3), ("b/c", 4)], key=str)
    assert sorted(rows(read_mart(spark, path, version=1)), key=str) == sorted([("a", 1), ("b", 2), (None, 3)], key=str)
    assert rows(read_mart(spark, path, parts=["b/c"])) == [("b/c", 4)]
    publish(table(spark), path, "three", by="day", replaces=["a", "none"])
    assert sorted(rows(read_mart(spark, path))) == [("b", 20), ("b/c", 4)]
    publish(table(spark), path, "four")
    assert rows(read_mart(spark, path)) == []
    assert manifest_of(spark, path).batch == "four"


def test_a_failed_write_leaves_the_mart(spark, tmp_path):
    path = str(tmp_path / "mart")
    publish(table(spark, ("a", 1), ("b", 2)), path, "one", by="day")
    many = spark.range(2000, numPartitions=8).select(
        F.lit("b").alias("day"), F.when(F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("n")
    )
    with pytest.raises(Exception, match="lost"):
        publish(many, path, "two", by="day", replaces=["b"])
    with pytest.raises(ValueError, match="not replaced"):
        publish(table(spark, ("c", 1)), path, "three", by="day", replaces=["b"])
    assert sorted(rows(read_mart(spark, path))) == [("a", 1), ("b", 2)]
    publish(table(spark, ("b", 3)), path, "two", by="day", replaces=["b"])
    assert sorted(rows(read_mart(spark, path))) == [("a", 1), ("b", 3)]


def test_a_failure_between_data_and_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "mart")
    publish(table(spark, ("a", 1)), path, "one", by="day")

    def lost(self, path, text):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Folder, "create", lost)
        with pytest.raises(OSError):
            publish(table(spark, ("a", 2)), path, "two", by="day", replaces=["a"])
    assert rows(read_mart(spark, path)) == [("a", 1)]
    # A manifest that broke off is no version either, and the next write doesn't touch it.
    (tmp_path / "mart" / "versions" / "00000002.json").write_text('{"version": 2')
    assert rows(read_mart(spark, path)) == [("a", 1)]
    assert publish(table(spark, ("a", 2)), path, "two", by="day", replaces=["a"]).version == 3
    assert rows(read_mart(spark, path)) == [("a", 2)]


def test_a_rerun_gives_equal_files_and_a_second_writer_fails(spark, tmp_path):
    rng = random.Random(1)
    data = [(f"d{rng.randrange(5)}", rng.randrange(100)) for _ in range(3000)]
    for name, parts in (("a", 3), ("b", 7)):
        rng.shuffle(data)
        publish(table(spark, *data).repartition(parts), str(tmp_path / name), "one", by="day", files=2)
    assert files_of(tmp_path / "a") == files_of(tmp_path / "b") != []
    with pytest.raises(Exception, match="exist"):
        Folder(spark, str(tmp_path)).create(str(tmp_path / "a" / "versions" / "00000001.json"), "x")


def test_forgotten_versions_free_their_data(spark, tmp_path):
    path = str(tmp_path / "mart")
    publish(table(spark, ("a", 1), ("b", 1)), path, "1", by="day")
    for n in (2, 3, 4):
        publish(table(spark, ("a", n)), path, str(n), by="day", replaces=["a"])
    assert forget_versions(spark, path, keep=1) == [1, 2, 3]
    assert sorted(rows(read_mart(spark, path))) == [("a", 4), ("b", 1)]
    assert len(list((tmp_path / "mart" / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        forget_versions(spark, path, keep=0)


def test_no_mart_and_other_schemas(spark, tmp_path):
    path = str(tmp_path / "mart")
    with pytest.raises(FileNotFoundError):
        read_mart(spark, path)
    publish(table(spark, ("a", 1)), path, "1", by="day")
    with pytest.raises(ValueError, match="schema"):
        publish(spark.createDataFrame([("a", "x")], "day string, n string"), path, "2", by="day", replaces=["a"])


def test_users_of_days_add_up_to_months(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.randrange(1, 40), rng.choice([None, 0, -1, 2**40, -(2**40), rng.randrange(-70_000, 70_000)])) for _ in range(4000)]
    df = spark.createDataFrame(data, "channel string, day int, user long").repartition(6)
    state = distinct_states(df, "user", ["channel", "day"], "n")
    for by in (["channel", "day"], ["channel"], ["day"], []):
        got = distinct_counts(united(state, by, "n"), by, "users", "n")
        want = df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("user").alias("users"))
        assert sorted(rows(got)) == sorted(rows(want))


def test_bitmaps_refuse_text_ids(spark):
    with pytest.raises(TypeError, match="whole-number"):
        distinct_states(spark.createDataFrame([("x",)], "user string"), "user", [])


def test_states_equal_the_direct_counts(spark):
    events = Tables(spark, FOLDER).product_events
    stored = states.user_states(events)
    by_day = distinct_counts(united(stored, ["day"], "events_count"), ["day"], "active_users", "events_count")
    direct = events.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    assert sorted(rows(by_day)) == sorted(rows(direct))


@pytest.mark.parametrize("shape", ["one value", "heavy tail", "two lumps"])
def test_sketched_ranks_are_within_the_bound(spark, shape):
    value = {
        "one value": F.lit(7).cast("long"),
        "heavy tail": (F.exp(F.rand(3) * 30)).cast("long"),
        "two lumps": F.when(F.col("id") % 3 == 0, F.lit(-5)).otherwise(F.col("id") % 100_000).cast("long"),
    }[shape]
    df = spark.range(300_000, numPartitions=12).select((F.col("id") % 2).alias("g"), (F.col("id") % 97).alias("day"), value.alias("v"))
    df = df.union(spark.createDataFrame([(0, 1, None), (5, 1, None)], "g long, day long, v long"))
    probs = {"p1": 0.01, "p50": 0.5, "p999": 0.999}
    found = sketched_quantiles(merged(sketches(df, "v", ["g", "day"]), ["g"], ["day"]), probs)
    got = {r.g: r for r in found.collect()}
    assert set(got) == {0, 1}
    for g, r in got.items():
        values = df.where((F.col("g") == g) & F.col("v").isNotNull())
        n = values.count()
        assert r.n == n
        for name, p in probs.items():
            below, upto = values.agg(F.count_if(F.col("v") < int(r[name])), F.count_if(F.col("v") <= int(r[name]))).first()
            assert below <= (p + RANK_ERROR) * n and upto >= (p - RANK_ERROR) * n


def test_grouped_quantiles_are_those_of_each_group(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), round(rng.uniform(-50, 5000), 2)) for _ in range(700)] + [("c", 1.5)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("v", F.col("v").cast("decimal(12,2)"))
    freq = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    found = grouped_quantiles(freq, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    for r in found.collect():
        own = df.where(F.col("g").eqNullSafe(F.lit(r.g)))
        assert tuple(r)[1:] == tuple(quantiles_of(own, "v", [0.25, 0.5, 0.99]).first())


def ad_loads(spark, seed):
    """Three loads of a few ad-days, with bad times, equal times, missing keys and a repeated row."""
    rng = random.Random(seed)
    loads = []
    for k in range(3):
        data = []
        for _ in range(30):
            day = date(2024, 1, 30) + timedelta(rng.randrange(4))
            at = rng.choice(["bad", f"{day} {rng.randrange(24):02d}:00:00", f"{day} 12:00:00"])
            m = [rng.randrange(3) for _ in range(5)]
            data.append((rng.choice(["meta", "google"]), rng.choice([1, 2, 3, None]), str(day), at, *m))
        loads.append(ads_df(spark, data + data[:1]).repartition(2))
    return loads


@pytest.mark.parametrize("period", ["yyyy-MM-dd", "yyyy-MM"])
def test_loads_in_any_order_give_the_state_of_all(spark, tmp_path, period):
    loads = ad_loads(spark, 7)
    everything = loads[0].unionByName(loads[1]).unionByName(loads[2])
    want = sorted(rows(acquisition.deduplicated_ads(everything)), key=str)
    orders = [(0, 1, 2), (2, 0, 1), (1, 2, 0, 1, 1)] if period == "yyyy-MM" else [(2, 1, 0, 2)]
    for n, order in enumerate(orders):
        path = str(tmp_path / f"state{n}")
        for k in order:
            acquisition.merge_ad_loads(loads[k], path, f"load{k}", period)
        got = acquisition.stored_ads(read_mart(spark, path))
        assert sorted(rows(got.select(acquisition.deduplicated_ads(everything).columns)), key=str) == want


def test_only_touched_dates_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "state")
    day = lambda d, hour, spend: ("meta", 1, d, f"{d} {hour}:00:00", spend, 1, 1, 1, 1)
    acquisition.merge_ad_loads(ads_df(spark, [day("2024-01-02", "08", 1), day("2024-01-03", "08", 1)]), path, "a")
    before = manifest_of(spark, path).partitions
    acquisition.merge_ad_loads(ads_df(spark, [day("2024-01-03", "09", 5), day("2024-01-03", "07", 9)]), path, "b")
    after = manifest_of(spark, path).partitions
    assert before["part=2024-01-02"] == after["part=2024-01-02"] and before["part=2024-01-03"] != after["part=2024-01-03"]
    assert sorted(float(r.spend) for r in read_mart(spark, path).collect()) == [1.0, 5.0]


def test_hierarchy_counts_what_branches_share_once(spark):
    at = lambda s, campaign, adset, ad, d: (s, campaign, adset, ad, date.fromisoformat(d), 100, 1, 1, 1, 2, f"{d} 08:00:00")
    from unitlens.sources import MARKETING_ADS_RAW

    data = [at("meta", 1, 1, 1, "2024-01-01"), at("meta", 1, 2, 2, "2024-01-01"), at("meta", 2, 3, 3, "2024-01-02"), at("meta", 2, 3, 1, "2024-01-05")]
    data += [at("google", 9, 9, 70_000, "2080-01-01"), at("google", 9, 9, 70_000, "1969-12-31")]
    df = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in data], MARKETING_ADS_RAW).withColumn("spend", F.lit(100).cast("decimal(18,2)"))
    found = {tuple(r)[:5]: (r.active_ads, r.active_days, r.total_spend, r.cac) for r in states.hierarchy_activity(df).collect()}
    assert found["source", "meta", None, None, None] == (3, 3, 4.0, 50.0)
    assert found["campaign", "meta", 2, None, None] == (2, 2, 2.0, 50.0)
    assert found["source", "google", None, None, None] == (1, 2, 2.0, 50.0)
    assert len(found) == 2 + 3 + 4 + 5


def test_permutations_of_versions_do_not_matter_to_readers(spark, tmp_path):
    """Whatever partitions a batch replaces, the latest version is the latest batch per partition."""
    for n, order in enumerate(itertools.permutations(["x", "y"])):
        path = str(tmp_path / f"m{n}")
        for k, name in enumerate(order):
            publish(table(spark, (name, k), ("z", k)), path, name, by="day", replaces=[name, "z"])
        assert sorted(rows(read_mart(spark, path))) == sorted([(order[0], 0), (order[1], 1), ("z", 1)])
