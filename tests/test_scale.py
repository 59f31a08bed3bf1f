"""What tasks hold and send as tables grow."""

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import baskets


def test_runs_of_pairs_are_packed():
    pick = np.random.default_rng(5)
    for numbers in (np.array([0], np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64), np.unique(pick.integers(0, 1 << 42, 100_000).astype(np.uint64))):
        packed = baskets._pack(numbers)
        assert (baskets._unpack(packed) == numbers).all()
    assert len(packed) < 4.5 * len(numbers)
    counts = np.array([1, 1, 7, 1, 300])
    assert (baskets._unpack_counts(5, *baskets._pack_counts(counts)) == counts).all()


def test_frequent_pairs_are_not_joined_rows(spark):
    """Pairs leave tasks counted and packed, not as a row each."""
    rows = [(b, 1 << 40 | p) for b in range(20) for p in range(30) if (b + p) % 3]
    table = spark.createDataFrame(rows, "basket bigint, product bigint")
    got = baskets.frequent_pairs(table, 6)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text
    want = baskets.pair_counts(table).filter(F.col("pair_count") >= 6)
    told = lambda df: sorted((r.left, r.right, r.pair_count) for r in df.collect())
    assert told(got) == told(want) and got.count() > 0


def test_unique_rows_come_from_one_shuffle(spark):
    from basketry.operators import upserts
    rows = [(1, 1, 5), (1, 1, 4), (1, 1, 4), (2, None, 1), (2, None, 2), (None, 3, 9), (4, 4, None), (4, 4, 2)]
    table = spark.createDataFrame(rows, "a int, b int, v int").repartition(3)
    accepted, rejected = upserts.enforce_unique(table, ["a", "b"], "v")
    told = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert told(accepted) == sorted([(1, 1, 4), (2, None, 1), (None, 3, 9), (4, 4, 2)], key=str)
    assert told(rejected) == sorted([(1, 1, 4), (1, 1, 5), (2, None, 2), (4, 4, None)], key=str)
    for df in (accepted, rejected):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in text and "Aggregate" not in text and "WindowGroupLimit" not in text


def test_tasks_are_dealt_by_bytes(spark):
    from basketry.session import TASK_BYTES, bound_tasks
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    for name in names:
        spark.conf.unset(name)
    spark.conf.set(names[1], "1m")
    try:
        bound_tasks(spark, 100 * TASK_BYTES)
        assert [spark.conf.get(n) for n in names] == [str(TASK_BYTES), "1m", "400"]
        bound_tasks(spark, TASK_BYTES)  # never fewer
        assert spark.conf.get(names[2]) == "400"
    finally:
        for name in names:
            spark.conf.unset(name)


def test_preferences_of_graph_edges_are_made_once(spark):
    from basketry.plans.queries import QUERIES
    from tests.conftest import SF_SMALL
    text = QUERIES["graph_edges"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in text


def test_order_grain_sends_no_product_twice(spark):
    from basketry.operators import behavior
    from basketry.plans.queries import views
    from tests.conftest import SF_SMALL
    sales = views(spark, SF_SMALL).sales()
    text = behavior.sales_grain(sales)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(t" in text
    want = sales.groupBy("customer_id", "product_id", "category").agg(F.min(behavior.order_seen_key()).alias("seen"))
    got = behavior.sales_grain(sales).select("customer_id", "product_id", "category", "seen")
    assert got.schema["seen"].dataType == want.schema["seen"].dataType and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def _sales_and_views(spark):
    import datetime as dt
    at = lambda i: dt.datetime(2001, 1, 1 + i % 9)
    sales = [(i // 3, i % 3, None if i % 11 == 0 else i % 4, None if i % 7 == 0 else i % 5, f"name {i % 2}", ("a", "b c", "", None)[i % 4],
              2, 1.5 + i, 0.1, at(i)) for i in range(90)]
    seen = [(i, "product_view", i % 6, None if i % 13 == 0 else i % 5, f"name {i % 3}", ("a", None, "b c")[i % 3], 4, at(i), at(i)) for i in range(60)]
    return (spark.createDataFrame(sales + sales[:30], "order_id bigint, line int, customer_id bigint, product_id bigint, product_name string, category string, "
                                  "quantity int, revenue double, discount double, created_at timestamp"),
            spark.createDataFrame(seen, "event_id bigint, event_type string, customer_id bigint, product_id bigint, product_name string, category string, "
                                  "dwell_seconds int, event_time timestamp, created_at timestamp"))


def _same(one, two):
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_customer_totals_shuffle_no_grain(spark):
    """Nothing is first grouped by product and category, which is as many rows as orders."""
    from basketry.operators import behavior, graph
    from basketry.sources.views import ORDERS_AS_OF
    sales, seen = _sales_and_views(spark)
    rows, stored = graph.GraphInputs(sales, seen), graph.GraphInputs(sales, seen, materialize=True)
    features = sales.groupBy("customer_id").agg(F.sum("revenue").alias("monetary_value"))
    for make in (lambda g: graph.customer_profiles(g, features), graph.graph_nodes, graph.preference_edges):
        assert _same(make(rows), make(stored)) and make(rows).count() > 0
    plans = [df._jdf.queryExecution().optimizedPlan().toString()
             for df in (graph.customer_profiles(rows, features), behavior.customer_behavior(sales, seen, ORDERS_AS_OF))]
    for text in plans:
        assert not [line for line in text.splitlines() if "Aggregate [customer_id" in line and "product_id" in line.split("]")[0] and "category" in line.split("]")[0]]
    # the same ranks as from the grain
    grain = behavior.sales_grain(sales)
    assert _same(behavior.ranked_categories(behavior.order_category_counts(sales), seen), behavior.ranked_categories(grain, seen))


def test_snapshot_makes_features_once(spark):
    from basketry.plans.snapshot import customer_snapshot
    from basketry.sources.views import ORDERS_AS_OF
    sales, seen = _sales_and_views(spark)
    features = sales.groupBy("customer_id").agg(F.sum("revenue").alias("monetary_value"), F.max("discount").alias("discount_sensitivity"),
                                                F.count(F.lit(1)).alias("frequency"), F.lit(3).alias("recency_days"), F.lit(0.5).alias("engagement_depth"))
    got = customer_snapshot(sales, seen, features, ORDERS_AS_OF)
    assert "max(discount" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert _same(got, customer_snapshot(sales, seen, features, ORDERS_AS_OF, materialize=False))


def test_runs_of_pairs_take_the_bits_they_need():
    """Steps in whole bytes took 2.8 bytes a pair here."""
    numbers = np.unique(np.random.default_rng(6).integers(0, 1 << 32, 62_000).astype(np.uint64))
    packed = baskets._pack(numbers)
    assert (baskets._unpack(packed) == numbers).all()
    assert len(packed) < 2.5 * len(numbers)


def test_pairs_of_given_products(spark):
    """The left products need no stored copy of the baskets."""
    rows = [(b, f"p{p}") for b in range(30) for p in range(25) if (b * p + b) % 3 == 0]
    table = spark.createDataFrame(rows, "basket bigint, product string")
    left = table.select("product").distinct().filter("product < 'p2'")
    kept = table.join(left, "product", "left_semi")
    for block in (4, 1000):
        got = baskets.frequent_pair_counts(table, 5, block, products=left)
        assert got.count() > 0 and _same(got, baskets.pair_counts(kept).filter(F.col("pair_count") >= 5))


def test_new_keys_of_a_stream_tell_nothing():
    """a row is told only of keys that have a total before the batch."""
    import pandas as pd
    from basketry.streaming import counters

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    told = lambda *adds: list(counters.totals(("category", "a"), iter([pd.DataFrame({"add": [a]}) for a in adds]), state))
    assert told(2, 3) == [] and state.get == (5,)
    assert told(4)[0]["before"].tolist() == [5] and state.get == (9,)


def test_top_pairs_store_few_pairs(spark, monkeypatch):
    """where no bound is found all pairs were stored and named for the top few."""
    pick = np.random.default_rng(7)
    rows = [(b, int(p)) for b in range(80) for p in pick.choice(60, 12, replace=False)]
    table = spark.createDataFrame(rows, "customer_id bigint, product_id bigint")
    stored, write = {}, baskets.materialize

    def written(df, name):
        stored[name] = write(df, name)
        return stored[name]

    monkeypatch.setattr(baskets, "materialize", written)
    got = baskets.basket_analysis(table, limit=3, prune_candidates=None)
    counts = baskets.pair_counts(baskets.basket_sets(table))
    assert stored["pairs"].count() < counts.count() / 2
    want = counts.orderBy(F.desc("pair_count"), "left", "right").limit(3)
    told = lambda df, n: [(r.left, r.right, r[n]) for r in df.collect()]
    assert told(got.orderBy("rank"), "basket_count") == told(want, "pair_count")
    least = min(n for *_, n in told(want, "pair_count"))
    assert _same(stored["pairs"].where(F.col("pair_count") >= least), counts.where(F.col("pair_count") >= least))


def test_pairs_that_tie_are_all_told(spark):
    """a limit drops no pair of the limit-th count."""
    rows = [(b, p) for b in range(6) for p in range(10 * b, 10 * b + 8)]
    table = spark.createDataFrame(rows, "basket bigint, product bigint")
    assert _same(baskets.frequent_pair_counts(table, 1, limit=2), baskets.pair_counts(table))
    assert baskets.frequent_pair_counts(table, 1, limit=2).count() == 6 * 28


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return blocks.getAllFiles().mkString("\n").count("/shuffle_")  # listed once, as files go meanwhile


def test_snapshot_job_joins_once_and_removes_shuffles(spark, tmp_path):
    """features came from a second join of the tables; shuffle files stayed until the driver's memory was collected."""
    import time
    from basketry.plans import jobs
    from basketry.sources.views import ORDERS_AS_OF
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    sales, seen = _sales_and_views(spark)
    products = spark.createDataFrame([(i, f"name {i}") for i in range(5)], "id bigint, name string")
    scored = spark.createDataFrame([(1, 2, 5, 0.5, "positive")], "review_id bigint, product_id bigint, rating int, score double, label string") \
        .withColumn("created_at", F.lit(ORDERS_AS_OF).cast("timestamp"))
    told = []

    def features(orders, views):
        told.extend([orders, views, spark.conf.get(name)])
        return orders.groupBy("customer_id").agg(F.sum("revenue").alias("monetary_value"), F.max("discount").alias("discount_sensitivity"),
                                                 F.count(F.lit(1)).alias("frequency"), F.lit(3).alias("recency_days"), F.lit(0.5).alias("engagement_depth"))

    before, earlier = _shuffle_files(spark), spark.conf.get(name, None)
    jobs.intelligence_snapshot(sales, seen, features, products, scored, ORDERS_AS_OF, str(tmp_path / "job"))
    end = time.time() + 20  # the files go in the background
    while _shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.5)
    assert _shuffle_files(spark) <= before and spark.conf.get(name, None) == earlier
    assert all("Relation" in df._jdf.queryExecution().optimizedPlan().toString() for df in told[:2]) and told[2] == "true"
    assert _same(told[0], sales) and _same(told[1], seen)
    assert {jobs.output(spark, str(tmp_path / "job"), t).count() > 0 for t in ("customers", "baskets", "demand", "reviews")} == {True}


def _graph_tables(base, spark):
    """Customer 1 has most rows; some rows have no customer, some events no product."""
    import datetime as dt
    at = lambda i: dt.datetime(2001, 1, 1 + i % 9)
    orders = [(i, None if i % 13 == 0 else 1 if i % 2 else i % 7, at(i)) for i in range(60)]
    lines = [(i % 60, i // 60, i % 10, float(1 + i % 4), 10.5 + i, 0.1) for i in range(240)]
    part = [(i, f"name{i} of it", ("ECONOMY", "PROMO", "LARGE", "other")[i % 4], 1.0 + i) for i in range(10)]
    events = [(i, at(i), None if i % 17 == 0 else i % 8, ("view", "click", "error")[i % 3], 2.5 + i, "{}" if i % 11 == 0 else f'{{"k": {i % 12}}}') for i in range(120)]
    for name, rows, columns in (("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
                                ("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double"),
                                ("part", part, "p_partkey bigint, p_name string, p_type string, p_retailprice double"),
                                ("events", events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")):
        spark.createDataFrame(rows, columns).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def test_graph_edges_are_made_customer_by_customer(spark, tmp_path):
    """orders are joined and shuffled to their customer once; the result is no shuffle."""
    from basketry.operators import graph
    from basketry.plans import queries
    base = _graph_tables(tmp_path, spark)
    got = queries.QUERIES["graph_edges"](spark, base)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("graph_", "preferences_"))]

    # edges and nodes from rows as they come, matched by a join
    v = queries.views(spark, base)
    g = graph.GraphInputs(v.sales(), v.views(), queries._stored_edges(v.sales(), v.views()))
    tgt = graph.graph_nodes(g).filter("kind <> 'customer'").selectExpr("customer_id", "node_id as target", "label as target_label", "kind as target_kind")
    edges = graph.graph_edges(g).selectExpr("*", "source as source_label", "'customer' as source_kind", "if(type = 'PREFERS', 'segment', 'product') as target_kind")
    want = edges.join(tgt, ["customer_id", "target", "target_kind"], "left")
    told = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    rows = told(want)
    assert got.columns == want.columns and told(got) == rows
    assert {r[-1] for r in rows if r[0] is None} == {None} and len({r[-1] for r in rows}) > 3

    # a customer of very many rows stands apart, in the same form
    parts = graph.by_customer(v.sales(), v.views(), queries._stored_edges, 3, group_rows=50)
    made = [graph.positioned_edges(graph.graph_edges(g, prefs=p), graph.graph_nodes(g, prefs=p)) for g, p in parts]
    assert len(made) == 2 and "Exchange hash" not in made[0]._jdf.queryExecution().executedPlan().toString()
    few = told(made[1])
    assert {r[0] for r in few} == {1} and sorted(told(made[0]) + few, key=str) == rows
