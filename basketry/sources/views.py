"""Derived inputs over the driver's tables (FIXTURES.md section 2).

Each view is a lazy DataFrame; joins are left to Catalyst/AQE.  Small
vocabularies are literal map expressions, so they need no join at all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.sources.tables import TableSet

# ---- fixed values: fixture vocabularies -----------------------------------
# p_type -> category
CATEGORY_OF_TYPE = {
    "ECONOMY": "wellness",
    "PROMO": "smart home",
    "LARGE": "commuter",
    "MEDIUM": "travel",
    "STANDARD": "productivity",
    "SMALL": "sleep",
}
# c_mktsegment -> segment text
SEGMENT_TEXT = {
    "HOUSEHOLD": "Premium home accounts",
    "MACHINERY": "Productivity teams",
    "BUILDING": "Urban commuter cohort",
    "AUTOMOBILE": "Dormant winback wellness",
    "FURNITURE": "Active shopper",
}
# review lexicon of the reference, plus fixture words (see FIXTURES.md)
POSITIVE_WORDS = ("great", "love", "excellent", "fast", "easy", "useful", "quality",
                  "perfect", "recommend", "happy")
NEGATIVE_WORDS = ("bad", "slow", "broken", "poor", "return", "expensive", "late",
                  "hard", "issue", "problem")
FIXTURE_POSITIVE_EXTRA = ("the", "and", "is")
FIXTURE_NEGATIVE_EXTRA = ("of", "to", "a")
# fixture intent aliases for routing over conversations
FIXTURE_ALIASES = (("a", ("with", "from")), ("b", ("for", "are")), ("c", ("this",)))

ORDERS_AS_OF = dt.datetime(2001, 8, 2)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
FIXTURE_EPOCH = dt.datetime(2024, 1, 1)


def literal_map(mapping: dict) -> Column:
    items = []
    for key, value in mapping.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def category_of(p_type: Column) -> Column:
    return F.element_at(literal_map(CATEGORY_OF_TYPE), p_type)


def segment_text_of(mktsegment: Column) -> Column:
    return F.element_at(literal_map(SEGMENT_TEXT), mktsegment)


def prop_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def _memo(fn):
    """Build each view once per Views object (the plan is lazy either way)."""
    def wrapper(self, *args):
        key = (fn.__name__,) + args
        if key not in self._memo:
            self._memo[key] = fn(self, *args)
        return self._memo[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


class Views:
    """The derived views of FIXTURES.md over one TableSet."""

    def __init__(self, tables: TableSet):
        self.t = tables
        self._memo: dict = {}

    # orders ------------------------------------------------------------
    @_memo
    def sales(self) -> DataFrame:
        """One row per line item: the reference's one-product order."""
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                    "l_extendedprice", "l_discount")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        p = self.t.part.select("p_partkey", "p_name", "p_type", "p_retailprice")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(p, li.l_partkey == p.p_partkey)
                  .select(F.col("l_orderkey").alias("order_id"),
                          F.col("l_linenumber").alias("line"),
                          F.col("o_custkey").alias("customer_id"),
                          F.col("l_partkey").alias("product_id"),
                          F.col("p_name").alias("product_name"),
                          category_of(F.col("p_type")).alias("category"),
                          F.col("l_quantity").cast("int").alias("quantity"),
                          F.col("p_retailprice").alias("price"),
                          F.col("l_extendedprice").alias("revenue"),
                          F.col("l_discount").alias("discount"),
                          F.col("o_orderdate").cast("timestamp").alias("created_at")))

    # events ------------------------------------------------------------
    def _events_with_part(self, how: str) -> DataFrame:
        e = self.t.events.withColumn("k", prop_k(F.col("props")))
        p = self.t.part.select("p_partkey", "p_name", "p_type")
        return e.join(p, e.k == p.p_partkey, how)

    @_memo
    def views(self) -> DataFrame:
        """Browse events: view and click events joined to the product."""
        e = self.t.events.filter(F.col("event_type").isin("view", "click")) \
            .withColumn("k", prop_k(F.col("props")))
        p = self.t.part.select("p_partkey", "p_name", "p_type")
        return (e.join(p, e.k == p.p_partkey, "left")
                 .select(F.col("event_id"),
                         F.lit("product_view").alias("event_type"),
                         F.col("user_id").alias("customer_id"),
                         F.col("k").alias("product_id"),
                         F.col("p_name").alias("product_name"),
                         category_of(F.col("p_type")).alias("category"),
                         F.floor("value").cast("int").alias("dwell_seconds"),
                         F.col("ts").cast("timestamp").alias("event_time"),
                         F.col("ts").cast("timestamp").alias("created_at")))

    @_memo
    def stream_events(self) -> DataFrame:
        """All events as shop stream events (one unit, revenue = value)."""
        return (self._events_with_part("inner")
                .select(F.col("event_id").cast("string").alias("event_id"),
                        F.col("event_type"),
                        F.col("user_id").cast("string").alias("customer_id"),
                        F.col("k").cast("string").alias("product_id"),
                        F.col("p_name").alias("product_name"),
                        category_of(F.col("p_type")).alias("category"),
                        F.lit(1).alias("quantity"),
                        F.col("value").alias("revenue"),
                        F.col("ts").cast("timestamp").alias("event_time"),
                        F.col("event_id").alias("seq")))

    @_memo
    def raw_events(self) -> DataFrame:
        """Dirty string events for the cleaning operators."""
        e = self.t.events
        i, u = F.col("event_id"), F.col("user_id")
        k = prop_k(F.col("props"))
        iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return e.select(
            F.when(i % 97 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" EVT-"), i.cast("string"), F.lit(" "))).alias("event_id"),
            F.when(i % 53 == 0, F.lit("")).when(i % 59 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit(" Cust-"), u.cast("string"))).alias("customer_id"),
            F.concat(F.lit(" SKU-"), k.cast("string"), F.lit(" ")).alias("product_id"),
            F.concat(F.lit(" "), F.upper("event_type")).alias("event_type"),
            F.when(i % 41 == 0, F.lit("bad-timestamp")).otherwise(iso).alias("event_time"),
            F.when(i % 31 == 0, F.lit(-1)).when(i % 7 == 0, F.lit(None).cast("int"))
             .otherwise((i % 5).cast("int")).alias("quantity"),
            F.when(i % 37 == 0, F.lit(-10.0)).when(i % 11 == 0, F.lit(None).cast("double"))
             .otherwise(F.col("value")).alias("price"),
            F.when(i % 13 == 0, F.lit(None).cast("double")).otherwise((25 + u % 24).cast("double")).alias("lat"),
            F.when(i % 17 == 0, F.lit(None).cast("double")).otherwise((-125 + (7 * u) % 60).cast("double")).alias("lon"),
        )

    # text ----------------------------------------------------------------
    @_memo
    def reviews(self) -> DataFrame:
        d = self.t.documents.select("doc_id", "text")
        return d.select(
            F.col("doc_id").alias("review_id"),
            (F.col("doc_id") % 200).alias("product_id"),
            (F.col("doc_id") % 150).alias("customer_id"),
            (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
            F.col("text"),
            (F.lit(FIXTURE_EPOCH).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id"))).alias("created_at"),
        )

    @_memo
    def users(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_name", "c_mktsegment")
        return c.select(
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_custkey") % 10 == 0, F.lit("admin")).otherwise(F.lit("customer")).alias("role"),
            F.col("c_custkey").alias("customer_key"),
            (F.lit(FIXTURE_EPOCH).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("c_custkey"))).alias("created_at"),
        )

    @_memo
    def catalog(self) -> DataFrame:
        """Scoring catalog: every part with categories, keywords and a base score."""
        p = self.t.part
        words = F.split("p_name", " ")
        cat = category_of(F.col("p_type"))
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_partkey").alias("ordinal"),
            F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("product"),
            F.array_distinct(F.array(cat, F.element_at(words, 1))).alias("categories"),
            F.array_distinct(F.array(F.element_at(words, 2), F.lower("p_brand"),
                                     F.element_at(F.split(cat, " "), 1))).alias("keywords"),
            F.round(F.lit(0.50) + F.lit(0.01) * (F.col("p_partkey") % 25), 2).alias("base_score"),
        )

    @_memo
    def products(self) -> DataFrame:
        """Shop product table (id, name, category, price, active)."""
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            category_of(F.col("p_type")).alias("category"),
            F.col("p_retailprice").alias("price"),
            F.when(F.col("p_partkey") % 9 == 0, F.lit(False))
             .when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("boolean"))
             .otherwise(F.lit(True)).alias("active"),
        )

    @_memo
    def features(self, as_of=ORDERS_AS_OF) -> DataFrame:
        """Scaled customer feature table (one row per customer)."""
        return self.features_of(self.sales(), self.views(), as_of)

    def features_of(self, sales: DataFrame, views: DataFrame, as_of=ORDERS_AS_OF) -> DataFrame:
        """The feature table from given order rows and browse events (stored ones, say)."""
        per_order = (sales.groupBy("customer_id")
                          .agg(F.max("created_at").alias("last_at"),
                               F.count_distinct("order_id").alias("orders"),
                               F.sum(F.col("revenue").cast("decimal(18,2)")).alias("revenue"),
                               (F.sum(F.col("discount").cast("decimal(18,2)")).cast("double")
                                / F.count(F.lit(1))).alias("avg_discount")))
        v = views.groupBy("customer_id").agg(F.count(F.lit(1)).alias("views"))
        c = self.t.customer.select(F.col("c_custkey").alias("customer_id"))
        from basketry.functions.timefn import whole_days
        j = c.join(per_order, "customer_id", "left").join(v, "customer_id", "left")
        return j.select(
            "customer_id",
            F.coalesce(whole_days(F.col("last_at"), F.lit(as_of).cast("timestamp")), F.lit(90)).cast("bigint").alias("recency_days"),
            F.when(F.col("customer_id") % 2 == 0, F.coalesce("orders", F.lit(0)))
             .otherwise(F.floor(F.coalesce("orders", F.lit(0)) / 3)).cast("bigint").alias("frequency"),
            F.round(F.coalesce(F.col("revenue"), F.lit(0)).cast("double") / 100, 2).alias("monetary_value"),
            F.round(10 * F.coalesce("avg_discount", F.lit(0.0)), 4).alias("discount_sensitivity"),
            F.least(F.coalesce("views", F.lit(0)) / 12, F.lit(1.0)).alias("engagement_depth"),
        )

    @_memo
    def questions(self) -> DataFrame:
        c = self.t.conversations
        return c.filter(F.col("role") == "user").select(
            "conv_id", "turn", F.col("text").alias("question"),
            F.when(F.col("conv_id") % 3 == 0, F.lit("admin"))
             .when(F.col("conv_id") % 3 == 1, F.lit("marketing_analyst"))
             .otherwise(F.lit("viewer")).alias("role"))

    def aliases(self) -> DataFrame:
        spark = self.t.spark
        rows = [(intent, pos, alias) for pos, (intent, names) in enumerate(FIXTURE_ALIASES) for alias in names]
        return spark.createDataFrame(rows, "intent string, intent_ordinal int, alias string")
