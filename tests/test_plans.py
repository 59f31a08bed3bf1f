"""Plan-shape checks: pushdown, no cartesian products, partial aggregation."""

from pyspark.sql import functions as F

from basketry.operators import baskets, scans
from basketry.plans.queries import QUERIES, views
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_scan_pushes_filter(spark):
    orders = views(spark, SF_SMALL).sales()
    text = plan(scans.order_scan(orders, customer_id=7).select("order_id", "customer_id"))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)" in text
    # the sort needs the date; of a product nothing but its key is read
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:" in text
    assert "ReadSchema: struct<p_partkey:bigint>" in text


def test_no_cartesian_products(spark):
    for name in ("recommendations", "recommendation_attributions", "basket_pairs", "order_scoring",
                 "prompt_screening", "question_routing", "customer_snapshot"):
        text = plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_pairs_aggregate_partially_before_shuffle(spark):
    b = baskets.basket_sets(views(spark, SF_SMALL).sales())
    text = plan(baskets.pair_counts(b))
    assert "partial_count" in text


def test_per_customer_limits_use_group_limit(spark):
    from basketry.operators.accounts import order_profile
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(order_profile(views(spark, SF_SMALL).sales()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in text


def test_scans_newest_first(spark):
    v = views(spark, SF_SMALL)
    rows = scans.order_scan(v.sales(), customer_id=int(v.sales().first().customer_id)).collect()
    ts = [r.created_at for r in rows]
    assert ts == sorted(ts, reverse=True)


def test_basket_pair_aggregate_stays_hash_based(spark):
    b = baskets.basket_sets(views(spark, SF_SMALL).sales())
    text = plan(baskets.pair_counts(b))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_graph_nodes_do_not_multiply_rows(spark):
    from basketry.operators import graph
    v = views(spark, SF_SMALL)
    text = plan(graph.graph_nodes(graph.GraphInputs(v.sales(), v.views())))
    assert "Expand" not in text


def test_recommendations_do_not_meet_the_whole_catalog(spark):
    text = plan(QUERIES["recommendations"](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "WindowGroupLimit" in text
