"""Recommendations against scoring every product for every customer."""

import random

from pyspark.sql import functions as F

from basketry.operators import recommend

CATALOG = "product_id string, ordinal bigint, product string, categories array<string>, keywords array<string>, base_score double"
CUSTOMERS = "customer_id bigint, segment string, recent_categories array<string>"


def segment_fit(ns, cats):
    for word, names in (("wellness", {"wellness", "fitness", "sleep"}), ("commuter", {"commuter", "travel"}), ("home", {"smart home"}), ("productivity", {"productivity"})):
        if word in ns and names & cats:
            return 1.0
    return 0.5 if "active shopper" in ns else 0.0


def half_up(x, digits=3):
    """Rounds like Spark: half up on the decimal text."""
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def brute(catalog, customers, k):
    out = []
    for cid, segment, recent in customers:
        ns = (segment or "").lower().replace("_", " ")
        rc = {c.lower().replace("_", " ") for c in recent or [] if c}
        rows = []
        for pid, ordinal, _, cats, kws, base in catalog:
            cats, kws = set(cats), set(kws)
            score = (base * 0.22 + len(rc & cats) / max(len(cats), 1) * 0.34 + segment_fit(ns, cats) * 0.24
                     + len(set(ns.split()) & kws) / max(len(kws), 1) * 0.12 + (0.08 if "winback" in ns and "sleep" in cats else 0))
            rows.append((-half_up(min(score, 0.99)), ordinal, pid, min(rc & cats or cats)))
        out += [(cid, rank, pid, category, -score) for rank, (score, _, pid, category) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def random_catalog(pick, n):
    cats = ["wellness", "fitness", "sleep", "commuter", "travel", "smart home", "productivity", "garden", "toys", *(f"c{i}" for i in range(40))]
    words = ["active", "home", "urban", "gift", "premium", "winback", *(f"w{i}" for i in range(30))]
    return [(f"p{i}", i, f"product {i}", pick.sample(cats, pick.randint(1, 3)), pick.sample(words, pick.randint(1, 4)),
             pick.choice([0.5, 0.9, 1.0, 2.5, 4.0, round(pick.random(), 2), pick.random()])) for i in range(n)]


def test_equals_scoring_everything(spark):
    pick = random.Random(11)
    catalog = random_catalog(pick, 700)
    pick.shuffle(catalog)
    segments = ["High-LTV wellness buyer", "Active shopper", "urban_commuter gift", "Premium Home accounts", "Dormant winback wellness", "Productivity active shopper", "", "nothing fits", None]
    customers = [(i, pick.choice(segments), pick.choice([None, [], ["Garden", None, ""], ["smart_home", "toys"], pick.sample([c for r in catalog for c in r[3]], 3)])) for i in range(80)]
    for k in (1, 3):
        got = recommend.recommend(spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(catalog, CATALOG), k)
        told = [(r.customer_id, r["rank"], r.product_id, r.category, r.score) for r in got.collect()]
        assert sorted(told) == brute(catalog, customers, k)


def test_few_products_reach_the_scoring(spark):
    """What inputs are joined with grows with profiles, not with the catalog."""
    pick = random.Random(5)
    customers = spark.createDataFrame([(i, "Active shopper", [f"cat{i % 7}"]) for i in range(30)], CUSTOMERS)
    ns = recommend.normalize_segment(F.col("segment"))
    inputs = customers.select(recommend.input_keys(ns, F.col("recent_categories"), F.split(ns, " ")).alias("keys")).distinct()
    for n in (2000, 8000):
        rows = [(f"p{i}", i, f"p {i}", [f"cat{pick.randint(0, 50)}"], ["word"], pick.random()) for i in range(n)]
        lists = recommend._lists(spark.createDataFrame(rows, CATALOG), inputs, 3)
        assert lists.count() < 400


def test_no_products_or_no_customers(spark):
    nobody, nothing = spark.createDataFrame([], CUSTOMERS), spark.createDataFrame([], CATALOG)
    one = spark.createDataFrame([(1, "Active shopper", ["toys"])], CUSTOMERS)
    assert recommend.recommend(one, nothing).count() == 0
    assert recommend.recommend(nobody, spark.createDataFrame(random_catalog(random.Random(1), 5), CATALOG)).count() == 0


def test_explanations_assume_default_categories(spark):
    customers = spark.createDataFrame([(1, "Active shopper", None), (2, "Active shopper", []), (3, "Active shopper", ["toys"])], CUSTOMERS)
    got = {r.customer_id: r.recent_categories for r in recommend.with_default_categories(customers).collect()}
    assert got == {1: ["wellness", "smart home"], 2: ["wellness", "smart home"], 3: ["toys"]}
