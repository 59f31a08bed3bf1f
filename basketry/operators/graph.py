"""Customer-product graph for all customers at once (G1-G6, U2, W7, J8,
J10, A13, P15-P18, M19, S17).

Edges are ordered PURCHASED (newest order first), VIEWED (newest first),
PREFERS (top categories).  All are returned unless ``max_edges`` is given
(trap T24); relationship_count counts all of them in any case.  The edges of a
customer with very many are numbered over ranges (``operators.ranking``), so
that they are spread over tasks; ``max_edges`` is a rank filter, planned as a
WindowGroupLimit that keeps as many rows per customer in every map task.

Edges, nodes and their match are made customer by customer.  ``by_customer``
stores the inputs that way, after which none of these steps is a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scoring import churn_components, churn_probability, graph_segment_label
from basketry.functions.text import currency_label, display_name, initials, percent_label, short_label
from basketry.operators.ranking import GROUP_ROWS, numbered
from basketry.operators.topk import rank_counted
from basketry.session import materialize as write_and_read
from basketry.session import materialize_by
from basketry.operators.upserts import last_write_wins, upsert_with_counter


# fixed values: churn inputs used when an order is placed (recency 0,
# frequency 1, monetary = the order revenue, discount .3, engagement .35)


def order_time_churn(revenue: Column) -> Column:
    comps = churn_components(F.lit(0.0), F.lit(1.0), revenue, F.lit(0.3), F.lit(0.35))
    return churn_probability(comps)


def purchase_edges(orders: DataFrame) -> DataFrame:
    """G1: one edge per (customer, product, order); the newest line wins;
    the order-time churn percent is attached."""
    prob = order_time_churn(F.col("revenue").cast("double"))
    rows = orders.filter(F.col("product_id").isNotNull()).select(
        "customer_id", F.col("product_id").alias("target"), F.lit("PURCHASED").alias("relationship"), "order_id",
        F.col("product_name").alias("target_name"), "category", "quantity", "revenue",
        F.col("created_at").alias("event_time"), F.round(prob * 100, 1).alias("churn_percent"),
        F.struct("created_at", "line", "quantity", "revenue").alias("_version"))
    latest = last_write_wins(rows, ["customer_id", "target", "relationship", "order_id"], "_version")
    return latest.drop("_version")


def view_edges(views: DataFrame) -> DataFrame:
    """One edge per (customer, product) with the newest attributes and
    the number of views (S13)."""
    rows = views.filter(F.col("product_id").isNotNull()).select(
        "customer_id", F.col("product_id").alias("target"), F.lit("VIEWED").alias("relationship"),
        F.col("product_name").alias("target_name"), "category", "dwell_seconds",
        F.col("created_at").alias("event_time"), F.struct("created_at", "event_id").alias("_version"))
    return upsert_with_counter(rows, ["customer_id", "target", "relationship"], "_version", "view_count").drop("_version")


# First-seen key: a flat struct (source, newest first, ids) with the name as
# its last field.  Encounter order is decided by the leading fields; the name
# only separates identical rows.  Rows tying on the ids are the same product,
# so the key is exact for first-seen per product and per category.
FIRST_TYPE = "struct<src:int,t:bigint,id:bigint,line:bigint,pid:bigint,name:string>"


def _order_first() -> Column:
    return F.struct(F.lit(0).alias("src"), (-F.unix_micros("created_at")).alias("t"),
                    (-F.col("order_id").cast("bigint")).alias("id"), F.col("line").cast("bigint").alias("line"),
                    F.col("product_id").cast("bigint").alias("pid"),
                    F.col("product_name").cast("string").alias("name")).cast(FIRST_TYPE)


def _view_first() -> Column:
    return F.struct(F.lit(1).alias("src"), (-F.unix_micros("created_at")).alias("t"),
                    (-F.col("event_id").cast("bigint")).alias("id"), F.lit(0).cast("bigint").alias("line"),
                    F.lit(0).cast("bigint").alias("pid"),
                    F.col("product_name").cast("string").alias("name")).cast(FIRST_TYPE)


def order_grain(orders: DataFrame) -> DataFrame:
    """One pass over the order rows: (customer, product, category) counts,
    revenue and the first-seen row key with its name.  Every per-customer
    graph output except the edge list is derived from this smaller table."""
    return orders.groupBy("customer_id", "product_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("revenue").cast("decimal(18,2)")).alias("rev"),
        F.min(_order_first()).alias("first"))


def view_grain(views: DataFrame) -> DataFrame:
    return views.groupBy("customer_id", "product_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(_view_first()).alias("first"))


def order_rows(orders: DataFrame) -> DataFrame:
    """The order rows in the form of ``order_grain``, each counted once."""
    return orders.select("customer_id", "product_id", "category", F.lit(1).cast("bigint").alias("n"),
                         F.col("revenue").cast("decimal(18,2)").alias("rev"), _order_first().alias("first"))


def view_rows(views: DataFrame) -> DataFrame:
    return views.select("customer_id", "product_id", "category", F.lit(1).cast("bigint").alias("n"), _view_first().alias("first"))


class GraphInputs:
    """Orders, views and (optionally) stored edges in the form that nodes,
    preferences, counts and the last event are aggregated from.

    With ``materialize`` these are the grains, written once as tables in the
    shared checkpoint folder and read back, so the order table is read once for
    all outputs (plus once for the first-14 edge list).  Worth it when customers
    re-buy products (the grain is then much smaller than the order table).
    Otherwise they are the rows themselves: every output adds up its own few
    columns before its one shuffle, where a grain as large as its input
    (599,351 of 600,000 rows at sf0.1) would be shuffled first."""

    def __init__(self, orders: DataFrame, views: DataFrame, stored_edges: DataFrame | None = None,
                 materialize: bool = False):
        self.orders, self.views, self.stored = orders, views, stored_edges
        if materialize:
            self.og = write_and_read(order_grain(orders), "order-grain")
            self.vg = write_and_read(view_grain(views), "view-grain")
        else:
            self.og, self.vg = order_rows(orders), view_rows(views)


ORDER_COLUMNS = ["order_id", "line", "customer_id", "product_id", "product_name", "category", "quantity", "revenue", "created_at"]
VIEW_COLUMNS = ["event_id", "customer_id", "product_id", "product_name", "category", "dwell_seconds", "created_at"]


def by_customer(orders: DataFrame, views: DataFrame, stored_edges: Callable[[DataFrame, DataFrame], DataFrame], tasks: int,
                k: int = 3, group_rows: int = GROUP_ROWS) -> list[tuple[GraphInputs, DataFrame]]:
    """The inputs and preferences of all customers, joined once and stored in
    ``tasks`` buckets by customer: what is made from them is not shuffled.

    Customers of more than ``group_rows`` rows are a second pair, if there are any,
    stored without buckets: their steps are dealt by all their columns.
    ``stored_edges`` makes the stored edges from the stored rows."""
    # the shuffles that join orders are gone from disk before the one by customer
    joined = write_and_read(orders.select(ORDER_COLUMNS), "graph-rows")
    tables = [materialize_by(joined, "customer_id", tasks, "graph_orders"),
              materialize_by(views.select(VIEW_COLUMNS), "customer_id", tasks, "graph_views")]
    sizes = tables[0].select("customer_id").unionByName(tables[1].select("customer_id")).groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    large = write_and_read(sizes.where(F.col("_n") > group_rows).select(F.col("customer_id").alias("_large")), "large-customers")
    found = []
    if not large.isEmpty():
        apart = lambda t, how: t.join(F.broadcast(large), t["customer_id"].eqNullSafe(large["_large"]), how)
        few = [write_and_read(apart(t, "left_semi"), "large-rows") for t in tables]
        g = GraphInputs(*few, stored_edges(*few))
        found = [(g, write_and_read(preference_edges(g, k), "preferences"))]
        tables = [apart(t, "left_anti") for t in tables]
    g = GraphInputs(*tables, stored_edges(*tables))
    return [(g, materialize_by(preference_edges(g, k), "customer_id", tasks, "preferences")), *found]


def category_counts(g: GraphInputs) -> DataFrame:
    """Per (customer, category) counts over orders and views with a product,
    nulls kept (they are dropped after ranking, trap T17), first seen."""
    o = g.og.filter(F.col("product_id").isNotNull()).groupBy("customer_id", "category") \
            .agg(F.sum("n").alias("n"), F.min("first").alias("seen"))
    v = g.vg.filter(F.col("product_id").isNotNull()).groupBy("customer_id", "category") \
            .agg(F.sum("n").alias("n"), F.min("first").alias("seen"))
    return o.unionByName(v).groupBy("customer_id", "category").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))


def preference_edges(g: GraphInputs, k: int = 3) -> DataFrame:
    """Top-k categories, weight = count, target = 'category-<slug>'."""
    ranked = rank_counted(category_counts(g), ["customer_id"], "category", "n", "seen", k)
    return ranked.select("customer_id", "rank", F.col("item").alias("category"),
                         F.lower(F.regexp_replace(F.concat(F.lit("category-"), F.col("item")), " ", "-")).alias("target"),
                         F.col("item_count").alias("weight"))


def _edge_rows(orders: DataFrame, views: DataFrame, prefs: DataFrame) -> DataFrame:
    """The three edge kinds in one frame with flat assembly-order columns
    (kind, then newest first with full tie-breaks, then preference rank)."""
    z = F.lit(0).cast("bigint")
    p = orders.filter(F.col("product_id").isNotNull()).select(
        "customer_id", F.lit("PURCHASED").alias("type"), F.col("product_id").cast("string").alias("target"),
        F.col("revenue").cast("double").alias("weight"), F.lit(0).alias("k0"),
        (-F.unix_micros("created_at")).alias("k1"), (-F.col("order_id").cast("bigint")).alias("k2"),
        F.col("line").cast("bigint").alias("k3"), F.col("product_id").cast("bigint").alias("k4"),
        F.col("quantity").cast("bigint").alias("k5"), F.col("revenue").cast("double").alias("k6"))
    v = views.filter(F.col("product_id").isNotNull()).select(
        "customer_id", F.lit("VIEWED").alias("type"), F.col("product_id").cast("string").alias("target"),
        F.col("dwell_seconds").cast("double").alias("weight"), F.lit(1).alias("k0"),
        (-F.unix_micros("created_at")).alias("k1"), (-F.col("event_id").cast("bigint")).alias("k2"),
        z.alias("k3"), z.alias("k4"), z.alias("k5"), F.lit(0.0).alias("k6"))
    c = prefs.select(
        "customer_id", F.lit("PREFERS").alias("type"), "target", F.col("weight").cast("double").alias("weight"),
        F.lit(2).alias("k0"), F.col("rank").cast("bigint").alias("k1"), z.alias("k2"), z.alias("k3"), z.alias("k4"),
        z.alias("k5"), F.lit(0.0).alias("k6"))
    return p.unionByName(v).unionByName(c)


EDGE_ORDER = ["k0", "k1", "k2", "k3", "k4", "k5", "k6"]


def relationship_summary(g: GraphInputs, k: int = 3, prefs: DataFrame | None = None) -> DataFrame:
    """Edges per customer (all kinds) and order revenue (LTV)."""
    prefs = prefs if prefs is not None else preference_edges(g, k)
    o = g.og.groupBy("customer_id").agg(
        F.sum(F.when(F.col("product_id").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("o_edges"),
        F.sum("rev").cast("double").alias("revenue"), F.sum("n").alias("orders"))
    v = g.vg.filter(F.col("product_id").isNotNull()).groupBy("customer_id").agg(F.sum("n").alias("v_edges"))
    c = prefs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("c_edges"),
                                         F.max(F.when(F.col("rank") == 1, F.col("category"))).alias("top_category"))
    j = o.join(v, "customer_id", "full_outer").join(c, "customer_id", "full_outer")
    return j.select(
        "customer_id",
        (F.coalesce("o_edges", F.lit(0)) + F.coalesce("v_edges", F.lit(0)) + F.coalesce("c_edges", F.lit(0)))
        .cast("bigint").alias("relationship_count"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        "top_category")


def graph_edges(g: GraphInputs, k: int = 3, max_edges: int | None = None, prefs: DataFrame | None = None) -> DataFrame:
    """G5 + W7: all edges of every customer, or the first ``max_edges``, with their
    0-based ordinal and id 'edge-<n>'."""
    prefs = prefs if prefs is not None else preference_edges(g, k)
    edges = _edge_rows(g.orders, g.views, prefs)
    if max_edges is None:
        ranked = numbered(edges, ["customer_id"], EDGE_ORDER, "_rn")
    else:
        w = Window.partitionBy("customer_id").orderBy(*EDGE_ORDER)
        ranked = edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_edges)
    return ranked.select("customer_id", (F.col("_rn") - 1).cast("bigint").alias("edge_ordinal"),
                         F.concat(F.lit("edge-"), (F.col("_rn") - 1).cast("string")).alias("edge_id"),
                         "type", F.col("customer_id").cast("string").alias("source"), "target", "weight")


def graph_nodes(g: GraphInputs, k: int = 3, prefs: DataFrame | None = None) -> DataFrame:
    """Customer node, product nodes (first name seen wins: orders, then
    views, then stored edges not already present, J8) and category nodes.

    One aggregation: every candidate carries a source rank (orders 0, views 1,
    stored edges 2, preferred categories 3), so the minimum per (customer,
    node) is the first-seen product and drops a stored or category candidate
    whose id is already present; the customers of the result give the
    customer nodes."""
    prefs = prefs if prefs is not None else preference_edges(g, k)

    def firsts(grain):
        return (grain.filter(F.col("product_id").isNotNull())
                     .select("customer_id", F.col("product_id").cast("string").alias("node_id"),
                             F.struct(F.col("first").alias("s"), F.col("first.name").alias("name"),
                                      F.col("category").alias("category"), F.lit("product").alias("kind")).alias("x")))

    def fixed(src, name, category, kind):
        key = F.struct(F.lit(src).alias("src"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("id"),
                       F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("pid"),
                       name.cast("string").alias("name")).cast(FIRST_TYPE)
        return F.struct(key.alias("s"), name.cast("string").alias("name"), category.cast("string").alias("category"),
                        F.lit(kind).alias("kind"))
    cand = firsts(g.og).unionByName(firsts(g.vg))
    if g.stored is not None:
        cand = cand.unionByName(g.stored.filter(F.col("target").isNotNull()).select(
            "customer_id", F.col("target").cast("string").alias("node_id"),
            fixed(2, F.col("target_name"), F.col("category"), "product").alias("x")))
    cand = cand.unionByName(prefs.select(
        "customer_id", F.col("target").alias("node_id"),
        fixed(3, F.substring_index("category", " ", 1), F.lit(None), "segment").alias("x")))
    agg = cand.groupBy("customer_id", "node_id").agg(F.min("x").alias("x"))
    label = (F.when(F.col("x.kind") == "segment", F.col("x.name"))
              .otherwise(short_label(F.coalesce(F.col("x.name"), F.col("node_id")))))
    others = agg.select("customer_id", "node_id", label.alias("label"), F.col("x.kind").alias("kind"), F.col("x.category").alias("category"))
    own = F.col("customer_id").cast("string")
    # the filter keeps this the same aggregate, whose exchange is then reused
    customers = agg.filter(F.col("x").isNotNull()).select("customer_id").distinct().select(
        "customer_id", own.alias("node_id"), short_label(own).alias("label"), F.lit("customer").alias("kind"), F.lit(None).cast("string").alias("category"))
    return others.unionByName(customers)


def positioned_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with the attributes of its source and target nodes.

    The source of every edge is the customer node, whose attributes follow
    from the id, so only the target side needs the node table.  Targets are
    matched on id and kind, so a product id equal to a customer id (plain
    integer ids) cannot pick up the customer node."""
    kind = F.when(F.col("type") == "PREFERS", F.lit("segment")).otherwise(F.lit("product"))
    rows = edges.withColumn("source_label", short_label(F.col("source"))).withColumn("source_kind", F.lit("customer")).withColumn("target_kind", kind)
    tgt = nodes.filter(F.col("kind") != "customer").select("customer_id", F.col("node_id").alias("target"), F.col("kind").alias("target_kind"),
                                                           F.col("label").alias("_label"), F.lit(True).alias("_node"))
    # a node is one row: beside its edges, rows that lie by customer stay where they are, which a join would not leave them
    met = Window.partitionBy("customer_id", "target", "target_kind")
    label = F.when(F.col("customer_id").isNotNull(), F.max("_label").over(met))
    keys = ["customer_id", "target", "target_kind"]
    return (rows.unionByName(tgt, allowMissingColumns=True).withColumn("target_label", label).filter(F.col("_node").isNull())
                .select(*keys, *(c for c in rows.columns if c not in keys), "target_label"))


def last_event(g: GraphInputs) -> DataFrame:
    """P18: 'Purchased <newest order product>', else 'Viewed <newest view>'."""
    o = g.og.groupBy("customer_id").agg(F.min("first").alias("o"))
    v = g.vg.groupBy("customer_id").agg(F.min("first").alias("v"))
    j = o.join(v, "customer_id", "full_outer")
    return j.select("customer_id",
                    F.when(F.col("o").isNotNull(), F.concat(F.lit("Purchased "), F.coalesce("o.name", F.lit("product"))))
                    .when(F.col("v").isNotNull(), F.concat(F.lit("Viewed "), F.coalesce("v.name", F.lit("product"))))
                    .otherwise(F.lit("No recent activity")).alias("last_event"))


def customer_profiles(g: GraphInputs, features: DataFrame, k: int = 3) -> DataFrame:
    """Name, initials, segment label, LTV, churn label, last event and
    relationship count of every customer with graph activity."""
    summ = relationship_summary(g, k)
    f = features.select("customer_id", F.col("monetary_value").alias("f_monetary"),
                        (F.col("churn_risk") if "churn_risk" in features.columns else F.lit(None).cast("double")).alias("f_churn"),
                        F.lit(True).alias("has_features"))
    j = summ.join(last_event(g), "customer_id", "left").join(f, "customer_id", "left")
    name = display_name(F.col("customer_id").cast("string"))
    ltv_value = F.coalesce(F.nullif(F.col("revenue"), F.lit(0.0)), F.col("f_monetary"))
    churn = (F.when(F.col("f_churn").isNotNull(), percent_label(F.col("f_churn")))
              .when(F.col("has_features"), F.lit("Calculated")).otherwise(F.lit("Unknown")))
    return j.select(
        "customer_id", name.alias("name"), initials(name).alias("initials"),
        graph_segment_label(F.col("orders"), F.col("top_category")).alias("segment"),
        F.when(ltv_value.isNull(), F.lit("$0")).otherwise(currency_label(ltv_value)).alias("ltv"),
        churn.alias("churn_risk"), F.coalesce("last_event", F.lit("No recent activity")).alias("last_event"),
        "relationship_count")


def live_else_snapshot(summary: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The live graph where it has edges, else the stored snapshot,
    else an empty graph."""
    j = summary.join(snapshots, "customer_id", "full_outer")
    live = F.coalesce(F.col("relationship_count"), F.lit(0)) > 0
    return j.select(
        "customer_id",
        F.when(live, F.lit("mongodb_graph")).when(F.col("snapshot_source").isNotNull(), F.col("snapshot_source"))
         .otherwise(F.lit("empty")).alias("source"),
        F.when(live, F.col("relationship_count")).when(F.col("snapshot_source").isNotNull(), F.col("snapshot_edges"))
         .otherwise(F.lit(0)).cast("bigint").alias("relationship_count"))
