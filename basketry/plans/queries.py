"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the fixture tables (or views Spark derives from them) in
full.  Nested results are rendered to flat, aliased columns so they can be
compared with an SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.timefn import iso_utc
from basketry.session import shuffles_removed
from basketry.sources.tables import TableSet
from basketry.sources.views import EVENTS_AS_OF, ORDERS_AS_OF, Views, prop_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(TableSet(spark, sf_dir))


def render_top(col: str) -> F.Column:
    """array<struct<name,count>> -> 'name:count,name:count'."""
    return F.array_join(F.transform(col, lambda x: F.concat(x["name"].cast("string"), F.lit(":"),
                                                            x["count"].cast("string"))), ",")


# ---- cleaning ---------------------------------------------------------------
from basketry.operators import cleaning as _clean  # noqa: E402


@query("clean_events")
def q_clean_events(spark, sf_dir):
    c = _clean.clean_events(views(spark, sf_dir).raw_events())
    return c.select("event_id", "customer_id", "product_id", "event_type",
                    iso_utc(F.col("event_time")).alias("event_time"), "quantity", "price", "revenue",
                    "lat", "lon", "region")


@query("event_type_counts")
def q_event_type_counts(spark, sf_dir):
    return _clean.event_type_counts(_clean.clean_events(views(spark, sf_dir).raw_events()))


@query("region_revenue")
def q_region_revenue(spark, sf_dir):
    return _clean.region_revenue(_clean.clean_events(views(spark, sf_dir).raw_events()))


@query("clean_totals")
def q_clean_totals(spark, sf_dir):
    return _clean.clean_totals(views(spark, sf_dir).raw_events())


# ---- behaviour --------------------------------------------------------------
from basketry.operators import behavior as _beh  # noqa: E402


def _behavior(spark, sf_dir):
    v = views(spark, sf_dir)
    return _beh.customer_behavior(v.sales(), v.views(), ORDERS_AS_OF)


@query("customer_behavior")
def q_customer_behavior(spark, sf_dir):
    b = _behavior(spark, sf_dir)
    return b.select("customer_id", "orders", "browse_events", "purchase_frequency", "monetary_value",
                    "recency_days", render_top("preferred_categories").alias("preferred_categories"),
                    render_top("top_products").alias("top_products"), "behavior_segment")


@query("order_features")
def q_order_features(spark, sf_dir):
    v = views(spark, sf_dir)
    return _beh.order_feature_record(v.sales(), ORDERS_AS_OF)


@query("behavior_features")
def q_behavior_features(spark, sf_dir):
    return _beh.behavior_feature_record(_behavior(spark, sf_dir))


# ---- churn and segments -----------------------------------------------------
from basketry.operators import churn as _churn  # noqa: E402


@query("churn_scores")
def q_churn_scores(spark, sf_dir):
    return _churn.flatten_drivers(_churn.churn_scores(views(spark, sf_dir).features()))


@query("customer_churn")
def q_customer_churn(spark, sf_dir):
    v = views(spark, sf_dir)
    b = _beh.customer_behavior(v.sales(), v.views(), ORDERS_AS_OF)
    return _churn.flatten_drivers(_churn.customer_churn(b, v.features()))


@query("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return _churn.rfm_segments(views(spark, sf_dir).features())


def _feature_lookup(spark, sf_dir):
    v = views(spark, sf_dir)
    b = _beh.customer_behavior(v.sales(), v.views(), ORDERS_AS_OF)
    stored = _beh.behavior_feature_record(b)
    return _churn.features_with_precedence([("mongodb", stored), ("redis", v.features())])


@query("feature_lookup")
def q_feature_lookup(spark, sf_dir):
    return _feature_lookup(spark, sf_dir)


@query("feature_store_segments")
def q_feature_store_segments(spark, sf_dir):
    f = _feature_lookup(spark, sf_dir)
    return _churn.rfm_segments(f).join(f.select("customer_id", "source"), "customer_id")


# ---- baskets ----------------------------------------------------------------
from basketry.operators import baskets as _bask  # noqa: E402
from basketry.operators.lookup import with_product_name  # noqa: E402


@query("basket_pairs")
def q_basket_pairs(spark, sf_dir):
    v = views(spark, sf_dir)
    top = _bask.basket_analysis(v.sales(), limit=10)
    top = with_product_name(top, v.products(), "left", "left_name", small_side=True)
    return with_product_name(top, v.products(), "right", "right_name", small_side=True)


@query("basket_pairs_pruned")
def q_basket_pairs_pruned(spark, sf_dir):
    """The same top pairs with a bound from more of the frequent products."""
    v = views(spark, sf_dir)
    top = _bask.basket_analysis(v.sales(), limit=10, prune_candidates=500)
    top = with_product_name(top, v.products(), "left", "left_name", small_side=True)
    return with_product_name(top, v.products(), "right", "right_name", small_side=True)


@query("basket_product_counts")
def q_basket_product_counts(spark, sf_dir):
    b = _bask.basket_sets(views(spark, sf_dir).sales())
    return b.groupBy("product").agg(F.count(F.lit(1)).alias("baskets"))


@query("frequent_pairs")
def q_frequent_pairs(spark, sf_dir):
    """Every pair bought together by at least 8 customers (support filter)."""
    return _bask.frequent_pairs(_bask.basket_sets(views(spark, sf_dir).sales()), min_support=8)


# ---- forecasting ------------------------------------------------------------
from basketry.operators import forecasting as _fc  # noqa: E402


@query("demand_forecast")
def q_demand_forecast(spark, sf_dir):
    v = views(spark, sf_dir)
    f = _fc.demand_forecast(_fc.daily_quantity(v.sales()), periods=7)
    return with_product_name(f, v.products(), "product_id", "product")


@query("revenue_forecast")
def q_revenue_forecast(spark, sf_dir):
    return _fc.revenue_forecast(_fc.revenue_series(views(spark, sf_dir).sales()))


@query("weighted_revenue_forecast")
def q_weighted_revenue_forecast(spark, sf_dir):
    return _fc.weighted_revenue_forecast(_fc.revenue_series(views(spark, sf_dir).sales()))


def _seasonal(spark, sf_dir, frequency, periods):
    hist = views(spark, sf_dir).sales().select(F.col("product_id").alias("series_id"), F.to_date("created_at").alias("day"), F.col("revenue").alias("value"))
    return _fc.seasonal_forecast(hist, periods, frequency).withColumn("ds", F.col("ds").cast("string"))


@query("seasonal_forecast")
def q_seasonal_forecast(spark, sf_dir):
    return _seasonal(spark, sf_dir, "D", 7)


@query("seasonal_forecast_weekly")
def q_seasonal_forecast_weekly(spark, sf_dir):
    return _seasonal(spark, sf_dir, "W", 4)


@query("seasonal_forecast_monthly")
def q_seasonal_forecast_monthly(spark, sf_dir):
    return _seasonal(spark, sf_dir, "M", 3)


# ---- recommendations --------------------------------------------------------
from basketry.operators import recommend as _rec  # noqa: E402
from basketry.sources.views import segment_text_of  # noqa: E402


def _rec_customers(spark, sf_dir):
    """Every customer with its segment text and top-3 recent categories."""
    v = views(spark, sf_dir)
    cats = (_beh.ranked_categories(_beh.order_category_counts(v.sales()), v.views(), 3)
            .groupBy("customer_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("_c"))
            .select("customer_id", F.transform("_c", lambda x: x["item"]).alias("recent_categories")))
    c = v.t.customer.select(F.col("c_custkey").alias("customer_id"),
                            segment_text_of(F.col("c_mktsegment")).alias("segment"))
    return c.join(cats, "customer_id", "left")


@query("recommendations")
def q_recommendations(spark, sf_dir):
    v = views(spark, sf_dir)
    return _rec.recommend(_rec_customers(spark, sf_dir), v.catalog(), k=3)


def _attribution_features(v):
    feats = v.features()
    churn = _churn.churn_scores(feats).select("customer_id", F.col("probability").alias("churn_risk"))
    return feats.join(churn, "customer_id")


@query("recommendation_attributions")
def q_recommendation_attributions(spark, sf_dir):
    v = views(spark, sf_dir)
    cust = _rec.with_default_categories(_rec_customers(spark, sf_dir))
    top = _rec.recommend(cust, v.catalog(), k=1, keep=["segment", "recent_categories"])
    return _rec.attributions(top, _attribution_features(v))


@query("recommendation_insight")
def q_recommendation_insight(spark, sf_dir):
    v = views(spark, sf_dir)
    return _rec.recommendation_insight(_rec_customers(spark, sf_dir), v.catalog(), _attribution_features(v), k=3)


# ---- reviews ----------------------------------------------------------------
from basketry.operators import reviews as _rev  # noqa: E402
from basketry.sources.views import (FIXTURE_NEGATIVE_EXTRA, FIXTURE_POSITIVE_EXTRA, NEGATIVE_WORDS,  # noqa: E402
                                    POSITIVE_WORDS)

FIXTURE_POSITIVE = POSITIVE_WORDS + FIXTURE_POSITIVE_EXTRA
FIXTURE_NEGATIVE = NEGATIVE_WORDS + FIXTURE_NEGATIVE_EXTRA


def _scored_reviews(spark, sf_dir):
    return _rev.score_reviews(views(spark, sf_dir).reviews(), FIXTURE_POSITIVE, FIXTURE_NEGATIVE)


@query("review_sentiment")
def q_review_sentiment(spark, sf_dir):
    s = _scored_reviews(spark, sf_dir)
    return s.select("review_id", "product_id", "score", "label",
                    F.array_join("positive_terms", " ").alias("positive_terms"),
                    F.array_join("negative_terms", " ").alias("negative_terms"))


@query("review_mix")
def q_review_mix(spark, sf_dir):
    return _rev.sentiment_mix(_scored_reviews(spark, sf_dir), "product_id")


@query("recent_reviews")
def q_recent_reviews(spark, sf_dir):
    v = views(spark, sf_dir)
    r = _rev.recent_reviews(_scored_reviews(spark, sf_dir), 20)
    r = with_product_name(r, v.products(), "product_id", "product", small_side=True)
    return r.select("review_id", "product_id", "product", "rating", "score", "label",
                    iso_utc(F.col("created_at")).alias("created_at"))


# ---- accounts ---------------------------------------------------------------
from basketry.operators import accounts as _acct  # noqa: E402
from basketry.operators import scans as _scans  # noqa: E402


def _users_with_ids(v):
    return v.users().withColumn("customer_id", F.col("customer_key"))


@query("customer_accounts")
def q_customer_accounts(spark, sf_dir):
    v = views(spark, sf_dir)
    a = _scans.account_scan(v.users())
    return a.select("email", "role", "customer_key", iso_utc(F.col("created_at")).alias("created_at"))


@query("account_profiles")
def q_account_profiles(spark, sf_dir):
    v = views(spark, sf_dir)
    p = _acct.account_profiles(_users_with_ids(v), v.sales(), v.catalog())
    return p.select("id", "label", "email", "email_customer_id", "segment",
                    F.array_join("recent_categories", ",").alias("recent_categories"),
                    F.array_join(F.transform("revenue_history", lambda x: x.cast("string")), ",").alias("revenue_history"),
                    "recent_order_count", F.array_join("latest_recommendations", ",").alias("latest_recommendations"))


# ---- graph ------------------------------------------------------------------
from basketry.operators import graph as _graph  # noqa: E402


@query("purchase_edges")
def q_purchase_edges(spark, sf_dir):
    e = _graph.purchase_edges(views(spark, sf_dir).sales())
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


@query("view_edges")
def q_view_edges(spark, sf_dir):
    e = _graph.view_edges(views(spark, sf_dir).views())
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


def _stored_edges(sales, seen):
    p = _graph.purchase_edges(sales).select("customer_id", "target", "target_name", "category")
    w = _graph.view_edges(seen).select("customer_id", "target", "target_name", "category")
    return p.unionByName(w)


def _graph_inputs(v, stored=True):
    return _graph.GraphInputs(v.sales(), v.views(), _stored_edges(v.sales(), v.views()) if stored else None)


@query("graph_nodes")
def q_graph_nodes(spark, sf_dir):
    return _graph.graph_nodes(_graph_inputs(views(spark, sf_dir)))


@query("graph_edges")
def q_graph_edges(spark, sf_dir):
    v = views(spark, sf_dir)
    sales, seen = v.sales(), v.views()
    with shuffles_removed(spark):
        parts = _graph.by_customer(sales, seen, _stored_edges, v.t.tasks())
    made = [_graph.positioned_edges(_graph.graph_edges(g, prefs=prefs), _graph.graph_nodes(g, prefs=prefs)) for g, prefs in parts]
    return reduce(DataFrame.unionByName, made)


@query("relationship_summary")
def q_relationship_summary(spark, sf_dir):
    return _graph.relationship_summary(_graph_inputs(views(spark, sf_dir), stored=False))


@query("customer_profiles")
def q_customer_profiles(spark, sf_dir):
    v = views(spark, sf_dir)
    feats = v.features()
    churn = _churn.churn_scores(feats).select("customer_id", F.col("probability").alias("churn_risk"))
    feats = feats.join(churn, "customer_id")
    return _graph.customer_profiles(_graph_inputs(v, stored=False), feats)


@query("graph_source")
def q_graph_source(spark, sf_dir):
    v = views(spark, sf_dir)
    snaps = v.t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.lit("mongodb_seed_snapshot").alias("snapshot_source"),
        F.col("c_nationkey").cast("bigint").alias("snapshot_edges"))
    return _graph.live_else_snapshot(_graph.relationship_summary(_graph_inputs(v, stored=False)), snaps)


# ---- live insights (batch) ---------------------------------------------------
from basketry.operators import insights as _ins  # noqa: E402


def _stream_norm(spark, sf_dir):
    return _ins.normalize_stream(views(spark, sf_dir).stream_events(), "stream")


def _counted(spark, sf_dir):
    return _ins.with_counters(_stream_norm(spark, sf_dir))


@query("stream_insights")
def q_stream_insights(spark, sf_dir):
    return _ins.detect_insights(_counted(spark, sf_dir)).select("event_id", "insight_ordinal", "kind", "title",
                                                                  "detail", "severity")


@query("insight_kind_counts")
def q_insight_kind_counts(spark, sf_dir):
    i = _ins.detect_insights(_counted(spark, sf_dir))
    return i.groupBy("kind").agg(F.count(F.lit(1)).alias("insights"))


@query("replay_totals")
def q_replay_totals(spark, sf_dir):
    return _ins.replay_totals(_counted(spark, sf_dir))


@query("live_top_categories")
def q_live_top_categories(spark, sf_dir):
    return _ins.top_categories(_stream_norm(spark, sf_dir), 5)


@query("live_revenue_by_category")
def q_live_revenue_by_category(spark, sf_dir):
    return _ins.revenue_by_category(_stream_norm(spark, sf_dir))


@query("live_customer_purchases")
def q_live_customer_purchases(spark, sf_dir):
    return _ins.purchases_per_customer(_stream_norm(spark, sf_dir))


@query("recent_stream_events")
def q_recent_stream_events(spark, sf_dir):
    r = _ins.recent(_stream_norm(spark, sf_dir), 30)
    return r.select("event_id", "event_type", "customer_id", "product_name", "category", "quantity", "revenue",
                    iso_utc(F.col("event_time")).alias("event_time"), "source")


@query("recent_insights")
def q_recent_insights(spark, sf_dir):
    r = _ins.recent(_ins.detect_insights(_counted(spark, sf_dir)), 30)
    return r.select("event_id", "insight_ordinal", "kind", "detail")


# ---- screening and routing --------------------------------------------------
from basketry.operators import screening as _scr  # noqa: E402
from basketry.sources.views import FIXTURE_ALIASES  # noqa: E402

# fixture permissions of the three fixture intents
FIXTURE_ALLOWED = {"admin": ["a", "b", "c"], "marketing_analyst": ["b", "c"], "viewer": []}


@query("prompt_screening")
def q_prompt_screening(spark, sf_dir):
    d = views(spark, sf_dir).t.documents.select(
        "doc_id", F.col("text").alias("question"),
        F.element_at(F.array(F.lit("marketing_analyst"), F.lit("admin"), F.lit("viewer")),
                     (F.col("doc_id") % 3 + 1).cast("int")).alias("role"))
    s = _scr.screen_prompts(d)
    return s.select("doc_id", "role", "allowed", "reason", F.array_join("checks", ",").alias("checks"))


@query("question_routing")
def q_question_routing(spark, sf_dir):
    q = _scr.route_intents(views(spark, sf_dir).questions(), list(FIXTURE_ALIASES))
    a = _scr.authorize(q, FIXTURE_ALLOWED)
    return a.select("conv_id", "turn", "role", F.array_join("requested", ",").alias("requested"),
                    F.array_join("authorized", ",").alias("authorized"))


# ---- k-means segmentation ----------------------------------------------------
from basketry.operators import segmentation as _seg  # noqa: E402


@query("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    return _seg.segments(views(spark, sf_dir).features(), k=4)


@query("kmeans_segments_fallback")
def q_kmeans_segments_fallback(spark, sf_dir):
    """The same where some customers lack a feature."""
    f = views(spark, sf_dir).features()
    gaps = f.withColumn("recency_days", F.when(F.col("customer_id") % 7 != 0, F.col("recency_days"))) \
            .withColumn("monetary_value", F.when(F.col("customer_id") % 11 != 0, F.col("monetary_value")))
    return _seg.segments(gaps, k=4)


def _assigned(spark, sf_dir):
    f = _seg.materialize(views(spark, sf_dir).features())
    return _seg.assign(_seg.fit_kmeans(f, 4), f)


def _rounded_profiles(assigned):
    p = _seg.cluster_profiles(assigned)
    return p.select("cluster", "members", F.round("avg_recency", 1).alias("avg_recency"), F.round("avg_frequency", 1).alias("avg_frequency"),
                    F.round("avg_monetary", 1).alias("avg_monetary"), "label")


@query("kmeans_cluster_profiles")
def q_kmeans_cluster_profiles(spark, sf_dir):
    return _rounded_profiles(_assigned(spark, sf_dir))


# ---- streaming (drained with availableNow; compared with the batch oracle) ---
from basketry.plans import live as _live  # noqa: E402
from basketry.streaming import topics as _topics  # noqa: E402


def _insights_of(spark, base):
    ins = _live.sink(spark, base, "insights")
    return ins.select("event_id", "insight_ordinal", "kind", "title", "detail", "severity")


@query("streaming_insights")
def q_streaming_insights(spark, sf_dir):
    return _insights_of(spark, _live.streaming_insights(spark, sf_dir))


@query("streaming_insights_keyed_state")
def q_streaming_insights_keyed_state(spark, sf_dir):
    """The events themselves, without messages, through the same state."""
    return _insights_of(spark, _live.direct_insights(spark, sf_dir))


@query("live_snapshot")
def q_live_snapshot(spark, sf_dir):
    """ST4 over the sinks of the stream."""
    base = _live.streaming_insights(spark, sf_dir)
    return _live.snapshot_rows(_live.live_snapshot(_live.sink(spark, base, "events"), _live.sink(spark, base, "insights")))


@query("streaming_hourly_revenue")
def q_streaming_hourly_revenue(spark, sf_dir):
    h = _live.streaming_hourly_revenue(spark, sf_dir)
    return h.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "revenue", "events")


@query("streaming_clean_events")
def q_streaming_clean_events(spark, sf_dir):
    c = _live.streaming_clean(spark, sf_dir)
    return c.select("event_id", "customer_id", "product_id", "event_type",
                    iso_utc(F.col("event_time")).alias("event_time"), "quantity", "price", "revenue",
                    "lat", "lon", "region")


@query("topic_decode")
def q_topic_decode(spark, sf_dir):
    """S8 over the fixture topic table."""
    ev = views(spark, sf_dir).stream_events()
    enc = _topics.encode(ev, ["ecommerce", "purchase"], only_purchases_for={"purchase"})
    d = _topics.decode(enc)
    return d.select("event_id", "event_type", "customer_id", "category", "revenue", "raw", "source", "offset")


# ---- shop jobs ---------------------------------------------------------------
from basketry.operators import commerce as _shop  # noqa: E402
from basketry.operators import featurejson as _fj  # noqa: E402
from basketry.operators import kpis as _kpi  # noqa: E402
from basketry.operators import upserts as _ups  # noqa: E402


def _order_requests(v):
    """One order request per order line; every 97th asks for an unknown product."""
    s = v.sales()
    return s.select(F.concat_ws("-", F.col("order_id").cast("string"), F.col("line").cast("string"),
                                F.col("product_id").cast("string")).alias("request_id"),
                    "customer_id",
                    F.when(F.col("order_id") % 97 == 0, F.col("product_id") + 1000000).otherwise(F.col("product_id")).alias("product_id"),
                    "quantity", F.col("created_at").alias("event_time"))


@query("order_events")
def q_order_events(spark, sf_dir):
    v = views(spark, sf_dir)
    ev, _ = _shop.order_events(_order_requests(v), v.products())
    return ev.select("request_id", "customer_id", "product_id", "product_name", "category", "quantity", "revenue")


@query("rejected_order_requests")
def q_rejected_order_requests(spark, sf_dir):
    v = views(spark, sf_dir)
    _, rej = _shop.order_events(_order_requests(v), v.products())
    return rej.select("request_id", "customer_id", "product_id")


@query("order_request_validation")
def q_order_request_validation(spark, sf_dir):
    from basketry.operators.cleaning import validate_orders
    v = views(spark, sf_dir)
    r = _order_requests(v).withColumn("customer_id", F.concat(F.lit("c"), F.col("customer_id").cast("string")))
    chk = validate_orders(r)
    return chk.select("request_id", "is_valid", F.array_join("reasons", ",").alias("reasons"))


@query("browse_event_build")
def q_browse_event_build(spark, sf_dir):
    v = views(spark, sf_dir)
    req = v.t.events.filter(F.col("event_type") == "view").select(
        F.col("event_id").cast("string").alias("request_id"), F.col("user_id").alias("customer_id"),
        (prop_k(F.col("props")) * 23).alias("product_id"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("int")).otherwise(F.floor("value").cast("int")).alias("dwell_seconds"),
        F.col("ts").cast("timestamp").alias("event_time"))
    b = _shop.browse_events(req, v.products())
    return b.select("request_id", "customer_id", "product_id", "product_name", "category", "dwell_seconds")


@query("order_scoring")
def q_order_scoring(spark, sf_dir):
    v = views(spark, sf_dir)
    o = _shop.order_scoring(v.sales(), v.catalog(), k=3)
    return o.select("order_id", "line", "customer_id", "product_id", "segment",
                    F.array_join(F.transform("recommended", lambda x: x.cast("string")), ",").alias("recommended"),
                    "churn_percent")


@query("order_repair")
def q_order_repair(spark, sf_dir):
    s = views(spark, sf_dir).sales()
    shaped = s.select("order_id", "line",
                      F.when(F.col("order_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("revenue")).alias("revenue"),
                      F.when(F.col("order_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("revenue")).alias("total"),
                      F.when(F.col("order_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("price")).alias("price"),
                      F.struct(F.when(F.col("order_id") % 11 == 0, F.lit(None).cast("double"))
                               .otherwise(F.col("price")).alias("price")).alias("product"))
    return _shop.repair_orders(shaped).select("order_id", "line", "revenue", "price")


# ---- stored tables (two batches of orders or views, the second one sent twice) ----
from basketry.sources.keyed_table import KeyedTable  # noqa: E402

#: orders and views before and from this day on are the two batches
SECOND_BATCH = {"sales": "1998-01-01", "views": "2024-01-16"}


def _merged(spark, name, keys, changes_of, rows, cut, combine, schema):
    """A new stored table with both batches of ``rows`` merged into it."""
    table = KeyedTable(spark, _topics.fresh_dir(spark, name), keys, schema)
    late = F.col("created_at") >= F.lit(cut).cast("timestamp")
    for batch, part in ((0, rows.where(~late)), (1, rows.where(late)), (1, rows.where(late))):
        table.merge(changes_of(part), batch, combine)
    return table.read()


@query("stored_purchase_edges")
def q_stored_purchase_edges(spark, sf_dir):
    keys = ["customer_id", "target", "relationship", "order_id"]
    schema = ("customer_id bigint, target bigint, relationship string, order_id bigint, target_name string, category string, quantity int, "
              "revenue double, event_time timestamp, churn_percent double")
    newest = lambda old, new: _ups.merge_last_write(old, new, keys, "event_time")
    e = _merged(spark, "purchase-edges", keys, _graph.purchase_edges, views(spark, sf_dir).sales(), SECOND_BATCH["sales"], newest, schema)
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


@query("stored_view_edges")
def q_stored_view_edges(spark, sf_dir):
    keys = ["customer_id", "target", "relationship"]
    schema = ("customer_id bigint, target bigint, relationship string, target_name string, category string, dwell_seconds int, event_time timestamp, "
              "view_count bigint")
    counted = lambda old, new: _ups.merge_counter(old, new, keys, "event_time", "view_count")
    e = _merged(spark, "view-edges", keys, _graph.view_edges, views(spark, sf_dir).views(), SECOND_BATCH["views"], counted, schema)
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


@query("stored_first_listing")
def q_stored_first_listing(spark, sf_dir):
    """Per product: name as listed first, first and last day of a listing."""
    schema = "id bigint, name string, created_at timestamp, updated_at timestamp"
    once = lambda old, new: _ups.merge_insert_once(old, new, ["id"], "created_at", "updated_at")
    changes = lambda part: part.groupBy(F.col("product_id").alias("id")).agg(
        F.min("product_name").alias("name"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    t = _merged(spark, "listings", ["id"], changes, views(spark, sf_dir).sales(), SECOND_BATCH["sales"], once, schema)
    return t.select("id", "name", iso_utc(F.col("created_at")).alias("created_at"), iso_utc(F.col("updated_at")).alias("updated_at"))


@query("product_first_listing")
def q_product_first_listing(spark, sf_dir):
    s = views(spark, sf_dir).sales()
    versions = s.select(F.col("product_id").alias("id"), F.col("product_name").alias("name"),
                        F.round(F.col("revenue") / F.col("quantity"), 2).alias("unit_price"),
                        F.struct("created_at", "order_id", "line", "quantity", "revenue").alias("updated_at"))
    f = _shop.first_listing(versions)
    return f.select("id", "name", "unit_price",
                    F.col("created_at.order_id").alias("first_order"), F.col("updated_at.order_id").alias("last_order"))


@query("duplicate_order_lines")
def q_duplicate_order_lines(spark, sf_dir):
    return _ups.duplicate_keys(views(spark, sf_dir).sales().select("order_id", "line"), ["order_id", "line"])


@query("unique_order_lines")
def q_unique_order_lines(spark, sf_dir):
    s = views(spark, sf_dir).sales().select("order_id", "line", "product_id", "quantity", "revenue")
    acc, rej = _ups.enforce_unique(s, ["order_id", "line"], F.struct("product_id", "quantity", "revenue"))
    return acc.select("order_id", "line", "product_id").withColumn("status", F.lit("accepted")) \
              .unionByName(rej.select("order_id", "line", "product_id").withColumn("status", F.lit("rejected")))


@query("table_row_counts")
def q_table_row_counts(spark, sf_dir):
    v = views(spark, sf_dir)
    return _scans.table_counts({"orders": v.sales(), "browse_events": v.views(), "product_reviews": v.reviews()})


@query("stored_orders")
def q_stored_orders(spark, sf_dir):
    v = views(spark, sf_dir)
    rows = v.sales().withColumn("event_type", F.lit("purchase"))
    orders, events = _shop.store_orders(rows, _topics.fresh_dir(spark, "orders-store"))
    o = orders.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    e = events.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return o.select(F.lit("orders").alias("table_name"), "n", "revenue").unionByName(
        e.select(F.lit("ecommerce_events").alias("table_name"), "n", "revenue"))


@query("feature_json_roundtrip")
def q_feature_json_roundtrip(spark, sf_dir):
    f = views(spark, sf_dir).features()
    enc = _fj.encode_features(f)
    schema = f.drop("customer_id").schema
    return _fj.decode_features(enc, schema)


@query("scalar_features")
def q_scalar_features(spark, sf_dir):
    f = views(spark, sf_dir).features()
    doc = f.select("customer_id", F.to_json(F.struct(
        "recency_days", "frequency", "monetary_value",
        F.array(F.lit("vip")).alias("tags"), F.struct(F.col("frequency").alias("x")).alias("meta"),
        F.when(F.col("customer_id") % 2 == 1, F.lit("ok")).alias("note")), {"ignoreNullFields": "false"}).alias("features_json"))
    s = _fj.scalar_only(doc)
    return s.select("customer_id", F.array_join(F.sort_array(F.map_keys("features")), ",").alias("kept_keys"),
                    F.col("features")["frequency"].alias("frequency"))


@query("region_heat")
def q_region_heat(spark, sf_dir):
    r = _clean.region_revenue(_clean.clean_events(views(spark, sf_dir).raw_events()))
    return _kpi.region_heat(r.select("region", "revenue"))


@query("hourly_revenue")
def q_hourly_revenue(spark, sf_dir):
    h = _kpi.hourly_revenue(views(spark, sf_dir).stream_events())
    return h.select(F.col("hour").cast("string").alias("hour"), "revenue", "purchases")


@query("daily_kpis")
def q_daily_kpis(spark, sf_dir):
    d = _kpi.daily_kpis(views(spark, sf_dir).stream_events())
    return d.withColumn("day", F.col("day").cast("string"))


@query("revenue_history_forecast")
def q_revenue_history_forecast(spark, sf_dir):
    s = _fc.revenue_series(views(spark, sf_dir).sales())
    return _kpi.history_with_forecast(s, _fc.revenue_forecast(s))


# ---- snapshot and centroid assignment ---------------------------------------
from basketry.plans import snapshot as _snap  # noqa: E402

@query("customer_snapshot")
def q_customer_snapshot(spark, sf_dir):
    v = views(spark, sf_dir)
    return _snap.customer_snapshot(v.sales(), v.views(), v.features(), ORDERS_AS_OF)


# ---- jobs with several outputs -------------------------------------------------
from basketry.plans import jobs as _jobs  # noqa: E402


def _order_job(spark, sf_dir, name):
    v = views(spark, sf_dir)
    base = _topics.fresh_dir(spark, "order-pipeline")
    _jobs.order_pipeline(v.sales(), v.catalog(), base)
    return _jobs.output(spark, base, name)


@query("order_pipeline_events")
def q_order_pipeline_events(spark, sf_dir):
    e = _order_job(spark, sf_dir, "events")
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


@query("order_pipeline_edges")
def q_order_pipeline_edges(spark, sf_dir):
    e = _order_job(spark, sf_dir, "edges")
    return e.withColumn("event_time", iso_utc(F.col("event_time")))


@query("order_pipeline_orders")
def q_order_pipeline_orders(spark, sf_dir):
    o = _order_job(spark, sf_dir, "orders")
    return o.select("order_id", "line", "customer_id", "product_id", "segment",
                    F.array_join(F.transform("recommended", lambda x: x.cast("string")), ",").alias("recommended"), "churn_percent")


def _snapshot_job(spark, sf_dir, name):
    v = views(spark, sf_dir)
    base = _topics.fresh_dir(spark, "snapshot")
    _jobs.intelligence_snapshot(v.sales(), v.views(), v.features_of, v.products(), _scored_reviews(spark, sf_dir), ORDERS_AS_OF, base)
    return _jobs.output(spark, base, name)


@query("snapshot_customers")
def q_snapshot_customers(spark, sf_dir):
    return _snapshot_job(spark, sf_dir, "customers")


@query("snapshot_baskets")
def q_snapshot_baskets(spark, sf_dir):
    return _snapshot_job(spark, sf_dir, "baskets")


@query("snapshot_demand")
def q_snapshot_demand(spark, sf_dir):
    return _snapshot_job(spark, sf_dir, "demand")


@query("snapshot_reviews")
def q_snapshot_reviews(spark, sf_dir):
    r = _snapshot_job(spark, sf_dir, "reviews")
    return r.select("review_id", "product_id", "product", "rating", "score", "label", iso_utc(F.col("created_at")).alias("created_at"))


@query("nearest_centroid")
def q_nearest_centroid(spark, sf_dir):
    """Customers placed by a model that was saved and loaded."""
    f = _seg.materialize(views(spark, sf_dir).features())
    path = _topics.fresh_dir(spark, "segment-model")
    _seg.fit_kmeans(f, 4).save(spark, path)
    return _seg.assign(_seg.SegmentModel.load(spark, path), f).select("customer_id", "cluster")


@query("centroid_cluster_labels")
def q_centroid_cluster_labels(spark, sf_dir):
    """Clusters of a coarser model."""
    f = _seg.materialize(views(spark, sf_dir).features())
    return _rounded_profiles(_seg.assign(_seg.fit_kmeans(f, 3), f))


# ---- scans ------------------------------------------------------------------
@query("order_scan")
def q_order_scan(spark, sf_dir):
    s = _scans.order_scan(views(spark, sf_dir).sales())
    return s.select("order_id", "line", "customer_id", "product_id", "quantity", "revenue",
                    iso_utc(F.col("created_at")).alias("created_at"))


@query("browse_scan")
def q_browse_scan(spark, sf_dir):
    s = _scans.browse_scan(views(spark, sf_dir).views())
    return s.select("event_id", "customer_id", "product_id", "product_name", "category", "dwell_seconds")


@query("review_scan")
def q_review_scan(spark, sf_dir):
    return _scans.review_scan(views(spark, sf_dir).reviews()).select("review_id", "product_id", "customer_id", "rating")


@query("catalog_scan")
def q_catalog_scan(spark, sf_dir):
    return _scans.catalog_scan(views(spark, sf_dir).products())


@query("latest_activity")
def q_latest_activity(spark, sf_dir):
    a = _beh.latest_activity(views(spark, sf_dir).sales())
    return a.select("customer_id", iso_utc(F.col("last_activity")).alias("last_activity"))


@query("daily_product_quantity")
def q_daily_product_quantity(spark, sf_dir):
    d = _fc.daily_quantity(views(spark, sf_dir).sales())
    return d.withColumn("day", F.col("day").cast("string"))


@query("segment_category_match")
def q_segment_category_match(spark, sf_dir):
    """M17 for every customer: segment text against the top preferred category."""
    from basketry.functions.scoring import normalize_segment, segment_category_match
    c = _rec_customers(spark, sf_dir)
    top = F.coalesce(F.col("recent_categories")[0], F.lit(""))
    return c.select("customer_id", "segment", top.alias("category"),
                    segment_category_match(normalize_segment(F.col("segment")), top).alias("match"))


@query("review_validation")
def q_review_validation(spark, sf_dir):
    """P9 over every review: customer id 3-80 chars, rating 1-5, text 3-1000 chars."""
    from basketry.operators.cleaning import validate_reviews
    r = views(spark, sf_dir).reviews().withColumn("customer_id", F.concat(F.lit("cust-"), F.col("customer_id").cast("string")))
    return validate_reviews(r).select("review_id", "is_valid", F.array_join("reasons", ",").alias("reasons"))


@query("browse_validation")
def q_browse_validation(spark, sf_dir):
    """P9 over every browse event: customer id 3-80 chars, dwell 0-3600 s."""
    from basketry.operators.cleaning import validate_browse
    b = views(spark, sf_dir).views().withColumn("customer_id", F.col("customer_id").cast("string"))
    return validate_browse(b).select("event_id", "is_valid", F.array_join("reasons", ",").alias("reasons"))


@query("latest_orders")
def q_latest_orders(spark, sf_dir):
    """Each customer's newest order line (full tie-breaks)."""
    from basketry.operators.topk import newest_per_key
    s = views(spark, sf_dir).sales()
    n = newest_per_key(s, ["customer_id"], _scans.sales_newest_first(), 1)
    return n.select("customer_id", "order_id", "line", "product_id", "quantity", "revenue")
