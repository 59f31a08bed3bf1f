"""Edge cases (empty input, nulls, single points, zero denominators) and
k-means invariants."""

import datetime as dt

from pyspark.sql import functions as F

from basketry.operators import baskets, behavior, cleaning, forecasting, insights, segmentation
from basketry.plans.queries import views
from tests.conftest import SF_SMALL

SALES = ("order_id long, line int, customer_id long, product_id long, product_name string, category string, "
         "quantity int, price double, revenue double, discount double, created_at timestamp")
VIEWS = ("event_id long, event_type string, customer_id long, product_id long, product_name string, "
         "category string, dwell_seconds int, event_time timestamp, created_at timestamp")


def test_behavior_with_views_only(spark):
    t = dt.datetime(2024, 1, 1)
    sales = spark.createDataFrame([], SALES)
    v = spark.createDataFrame([(1, "product_view", 7, 3, "Lamp", "smart home", 5, t, t)], VIEWS)
    r = behavior.customer_behavior(sales, v, dt.datetime(2024, 2, 1)).collect()
    assert len(r) == 1 and r[0].orders == 0 and r[0].recency_days == 90
    assert r[0].behavior_segment == "smart home_affinity"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SALES)
    assert baskets.basket_analysis(empty).count() == 0
    assert forecasting.demand_forecast(forecasting.daily_quantity(empty)).count() == 0
    raw = cleaning.events_from_rows(spark, [])
    assert cleaning.clean_totals(raw).first().input_count == 0


def test_single_and_short_series(spark):
    rows = [("one", 1, 5.0), ("two", 1, 5.0), ("two", 2, 7.0), ("three", 1, 1.0), ("three", 2, 2.0), ("three", 3, 3.0)]
    s = spark.createDataFrame(rows, "series_id string, t int, value double")
    r = {x.series_id: x for x in forecasting.revenue_forecast(s).collect()}
    assert r["one"].prediction == 5.0 and r["three"].prediction == 4.0
    days = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0), ("s", dt.date(2024, 1, 2), 2.0)],
                                 "series_id string, day date, value double")
    assert forecasting.seasonal_forecast(days).count() == 0  # fewer than 3 points


def test_zero_mean_series_confidence(spark):
    s = spark.createDataFrame([("z", i, 0.0) for i in (1, 2, 3)], "series_id string, t int, value double")
    r = forecasting.revenue_forecast(s).first()
    assert (r.prediction, r.confidence) == (0.0, 0.93)
    w = forecasting.weighted_revenue_forecast(s).first()
    assert (w.prediction, w.confidence) == (0.0, 0.91)


def test_stream_normalisation_defaults(spark):
    df = spark.createDataFrame([(None, " PURCHASE ", "  ", None, None, None, "abc", None, 1)],
                               "event_id string, event_type string, customer_id string, product_id string, "
                               "product_name string, category string, revenue string, event_time timestamp, seq long")
    r = insights.normalize_stream(df).first()
    assert (r.event_id, r.event_type, r.customer_id, r.product_name, r.category, r.revenue) == \
        ("unknown", "purchase", "unknown", "unknown", "unknown", 0.0)


def test_kmeans_invariants(spark):
    f = segmentation.materialize(views(spark, SF_SMALL).features())
    model = segmentation.fit_kmeans(f, 4)
    a = segmentation.assign(model, f)
    assert a.count() == f.count()                       # every customer assigned
    assert segmentation.fit_kmeans(f.repartition(7), 4) == model   # however the rows lie
    # every customer is in the cluster of its nearest centre in the scaled space
    for r in a.collect():
        z = [(r[c] - m) / s for c, m, s in zip(segmentation.FEATURES, model.means, model.deviations)]
        d = [sum((x - y) ** 2 for x, y in zip(z, c)) for c in model.centers]
        assert d[r.cluster] <= min(d) + 1e-9
    prof = segmentation.cluster_profiles(a).collect()
    assert sum(p.members for p in prof) == a.count()


def test_incomplete_features_fall_back_to_rules(spark):
    rows = [(i, i % 9, i % 5, 10.0 * i) for i in range(20)] + [(90, None, 6, 5.0), (91, 100, None, None)]
    f = spark.createDataFrame(rows, "customer_id bigint, recency_days int, frequency int, monetary_value double")
    got = {r.customer_id: r for r in segmentation.segments(f, 3).collect()}
    assert (got[90].cluster, got[90].kmeans_segment, got[90].segment) == (None, None, "loyal_growth")
    assert (got[91].cluster, got[91].segment) == (None, "winback_risk")
    assert all(got[i].segment == got[i].kmeans_segment for i in range(20))


def test_constant_features_and_saved_models(spark, tmp_path):
    f = spark.createDataFrame([(i, 5, 1, float(i // 4)) for i in range(8)], "customer_id bigint, recency_days int, frequency int, monetary_value double")
    model = segmentation.fit_kmeans(f, 2)
    assert model.deviations[:2] == [1.0, 1.0]
    model.save(spark, str(tmp_path / "model"))
    assert segmentation.SegmentModel.load(spark, str(tmp_path / "model")) == model
    assert {r.customer_id // 4: r.cluster for r in segmentation.assign(model, f).collect()}.keys() == {0, 1}


def test_support_floor_pruning_is_exact_on_skewed_baskets(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for b in range(300):
        items = {f"hot{rnd.randint(0, 4)}" for _ in range(3)} | {f"p{rnd.randint(0, 400):03d}" for _ in range(4)}
        rows += [(f"b{b:03d}", p) for p in items]
    orders = spark.createDataFrame(rows, "customer_id string, product_id string")
    b = baskets.basket_sets(orders)
    pc = b.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    floor = spark.range(1).select(baskets.support_floor(b, pc, 5, 10).alias("f")).first().f
    assert floor > 1 and pc.filter(F.col("n") >= floor).count() < pc.count()   # pruning really cuts
    plain = [tuple(r) for r in baskets.basket_analysis(orders, limit=5, prune_candidates=None).orderBy("rank").collect()]
    pruned = [tuple(r) for r in baskets.basket_analysis(orders, limit=5, prune_candidates=10).orderBy("rank").collect()]
    assert plain == pruned and len(plain) == 5
