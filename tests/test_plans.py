"""Physical plans: what is pushed down, what is never there."""

import pytest

from strata.queries import load_all

QUERIES = load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name].run(spark, sf_dir))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("one_day_of_events", "GreaterThanOrEqual(ts,2024-01-12T00:00)"),
        ("incremental_orders", "GreaterThan(o_orderdate,2000-01-01T00:00)"),
        ("recent_executions", "GreaterThanOrEqual(o_orderdate,"),
        ("bookings_by_region", "GreaterThanOrEqual(l_shipdate,"),
        ("bookings_by_region", "EqualTo(l_returnflag,N)"),
        ("user_360_travellers", "LessThan(l_shipdate,2000-07-01T00:00)"),
        ("tour_by_id", "EqualTo(p_partkey,42)"),
    ],
)
def test_filter_reaches_the_scan(spark, sf_dir, name, pushed):
    assert pushed in plan(QUERIES[name].run(spark, sf_dir))


def test_hot_join_key_is_split(spark):
    """A third of the facts share one key and the dimension is too large to broadcast."""
    from pyspark.sql import functions as F

    from strata.operators.enrich import with_dimension
    from strata.session import tune

    tune(spark)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
        facts = spark.range(0, 200_000, 1, 8).select(key.alias("user_id"), F.xxhash64("id").alias("v"))
        users = spark.range(1000).select(F.col("id").alias("key"), F.xxhash64("id").alias("name"))
        joined = with_dimension(facts, users, "user_id", "key").groupBy("user_id").agg(F.count("name").alias("n"))
        counts = {r.user_id: r.n for r in joined.collect()}
        assert counts[7] > 66_666 and sum(counts.values()) == 200_000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["revenue_trend"].run(spark, sf_dir))
    assert "l_tax" not in text and "o_totalprice" not in text


@pytest.mark.parametrize(
    "name", ["recent_events_per_type", "dedup_by_key", "latest_changes"]
)
def test_ranked_keys_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(QUERIES[name].run(spark, sf_dir))


def test_long_rankings_are_salted(spark, sf_dir):
    assert plan(QUERIES["recent_events_per_type_long"].run(spark, sf_dir)).count("Window [") == 2
