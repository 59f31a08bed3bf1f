"""Transparent product recommendations and their attributions
(M7, M8, W8, J6, J9, M16, M17, M23).

A score depends on a customer's segment and set of recent categories alone, so
the distinct inputs are scored, and customers are joined back to theirs.  No
input meets the whole catalog:

* An input has keys, the categories and keywords that can raise a score for it
  (``input_keys``).  Products with the same keys among those of any input and
  equally many categories and keywords form a profile; within it the score
  grows with the base score alone.  A product goes if k products of its
  profile have no smaller base score and come earlier in the catalog, since
  they precede it for every input (``leading``).
* What stays is listed under each of its keys, and those products that no k of
  the whole catalog precede so under a key that every input has.  An input is
  joined with its lists; a product in none of them cannot be among its k best.

Scores are exact and the catalog may have any size.  Formula weights are fixed
values equal to the reference's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.numeric import clamp
from basketry.functions.scoring import normalize_segment, segment_category_match, segment_fit
from basketry.session import materialize

#: Parts of a profile that are reduced on their own before they meet.
SALTS = 64
#: The list that every input visits.
EVERY = "*"

# ---- fixed values: recommendation weights ----------------------------------
# base .22, recent category overlap .34, segment fit .24, keyword overlap .12,
# winback+sleep boost .08, score cap .99, rounded to 3


def _norm_categories(recent: Column) -> Column:
    cleaned = F.transform(F.coalesce(recent, F.array().cast("array<string>")),
                          lambda c: F.regexp_replace(F.lower(c), "_", " "))
    return F.array_distinct(F.filter(cleaned, lambda c: c.isNotNull() & (c != "")))


def _components(p: Column, ns: Column, recent: Column, tokens: Column) -> Column:
    """Raw score parts of one catalog entry for one customer."""
    cats, kws = p["categories"], p["keywords"]
    matched = F.array_intersect(recent, cats)
    return F.struct(
        p["ordinal"].alias("ordinal"), p["product_id"].alias("product_id"), p["product"].alias("product"),
        F.array_min(F.when(F.size(matched) > 0, matched).otherwise(cats)).alias("category"),
        (p["base_score"] * 0.22).alias("b"),
        (F.size(matched) / F.greatest(F.size(cats), F.lit(1)) * 0.34).alias("cc"),
        (segment_fit(ns, cats) * 0.24).alias("sc"),
        (F.size(F.array_intersect(tokens, kws)) / F.greatest(F.size(kws), F.lit(1)) * 0.12).alias("kc"),
        F.when(ns.contains("winback") & F.array_contains(cats, "sleep"), F.lit(0.08)).otherwise(F.lit(0.0)).alias("wc"))


def _ranked(c: Column) -> Column:
    score = F.round(F.least(c["b"] + c["cc"] + c["sc"] + c["kc"] + c["wc"], F.lit(0.99)), 3)
    return F.struct((-score).alias("neg_score"), c["ordinal"].alias("ordinal"), c["product_id"].alias("product_id"),
                    c["product"].alias("product"), c["category"].alias("category"),
                    F.round(c["b"], 3).alias("base_product_fit"), F.round(c["cc"], 3).alias("recent_category_match"),
                    F.round(c["sc"], 3).alias("segment_fit"), F.round(c["kc"], 3).alias("keyword_match"),
                    F.round(c["wc"], 3).alias("winback_sleep_boost"))


# fixed values: categories that a word in the segment makes fit, as in segment_fit
# and the winback boost
SEGMENT_KEYS = (("wellness", ("wellness", "fitness", "sleep")), ("commuter", ("commuter", "travel")), ("home", ("smart home",)),
                ("productivity", ("productivity",)), ("winback", ("sleep",)))


def _keyed(prefix: str, values: Column) -> Column:
    known = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
    return F.transform(known, lambda v: F.concat(F.lit(prefix), v))


def input_keys(ns: Column, recent: Column, tokens: Column) -> Column:
    """Keys of products whose score for the input can exceed what their base score
    and the segment alone give: category ``c:...`` or keyword ``k:...``."""
    fits = [F.when(ns.contains(word), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for word, names in SEGMENT_KEYS]
    return F.array_distinct(F.concat(_keyed("c:", recent), _keyed("k:", tokens), *(_keyed("c:", f) for f in fits)))


def leading(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``rows`` (ordinal, product_id, base_score, salt, ...) without those that k or
    more rows of their group precede for certain: rows of no smaller base score
    and an earlier place.  What is left may include a few more.

    Layer by layer: a row whose base score exceeds all earlier ones' belongs to the
    first layer, and so on without that one; a row past layer k has at least
    one such predecessor in each of the k layers.  Salted parts first, so that no
    group is reduced in one task."""
    for keys in ([*by, "salt"], by):
        before = Window.partitionBy(*keys).orderBy("ordinal", "product_id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_layer", F.lit(0))
        for n in range(1, k + 1):
            left = F.col("_layer") == 0
            rows = rows.withColumn("_most", F.max(F.when(left, F.col("base_score"))).over(before))
            first = left & (F.col("_most").isNull() | (F.col("base_score") > F.col("_most")))
            rows = rows.withColumn("_layer", F.when(first, F.lit(n)).otherwise(F.col("_layer")))
        rows = rows.where(F.col("_layer") > 0).drop("_layer", "_most")
    return rows


def _lists(catalog: DataFrame, inputs: DataFrame, k: int) -> DataFrame:
    """(key, keys, p): the products to look at under each key of any input."""
    wanted = inputs.select(F.explode("keys").alias("key")).distinct().withColumn("wanted", F.lit(True))
    products = catalog.select(F.monotonically_increasing_id().alias("row"), F.struct(
        F.col("ordinal").cast("bigint").alias("ordinal"), "product_id", "product", "categories", "keywords",
        F.coalesce(F.col("base_score").cast("double"), F.lit(0.0)).alias("base_score")).alias("p"))
    words = products.select("row", "p", F.explode_outer(F.array_distinct(F.concat(_keyed("c:", F.col("p.categories")), _keyed("k:", F.col("p.keywords"))))).alias("key"))
    told = words.join(wanted, "key", "left").groupBy("row", "p").agg(
        F.sort_array(F.collect_set(F.when(F.col("wanted"), F.col("key")))).alias("keys"))
    rows = told.select(
        "p", "keys", F.col("p.ordinal").alias("ordinal"), F.col("p.product_id").alias("product_id"), F.col("p.base_score").alias("base_score"),
        F.size("p.categories").alias("categories"), F.size("p.keywords").alias("keywords"),
        F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), F.lit(EVERY).alias("every"))
    front = leading(rows, ["keys", "categories", "keywords"], k)
    listed = front.select(F.explode("keys").alias("key"), "keys", "p")
    return listed.unionByName(leading(front, ["every"], k).select(F.col("every").alias("key"), "keys", "p"))


def recommend(customers: DataFrame, catalog: DataFrame, k: int = 3, key: str = "customer_id",
              keep: list[str] | None = None) -> DataFrame:
    """M7 for every row of ``customers`` (key, segment, recent_categories).

    Ranks by rounded score, ties by catalog order (trap T14), keeps k (W8).
    Output: key, [keep...], rank, product_id, product, category, score, five
    drivers.  ``keep`` carries customer columns through (no join back).  A null
    base score counts as 0.
    """
    keep = list(keep or [])
    ns = normalize_segment(F.col("segment"))
    prepared = materialize(customers.select(
        key, *keep, ns.alias("_ns"), F.sort_array(_norm_categories(F.col("recent_categories"))).alias("_recent")), "recommend-inputs")
    tokens = F.array_distinct(F.filter(F.split(F.coalesce("_ns", F.lit("")), r"\s+"), lambda w: w != ""))
    inputs = prepared.select("_ns", "_recent").distinct().withColumn("_tokens", tokens).withColumn(
        "keys", input_keys(F.coalesce("_ns", F.lit("")), F.col("_recent"), F.col("_tokens")))
    lists = _lists(catalog, inputs, k).withColumnRenamed("keys", "listed")
    visits = inputs.withColumn("key", F.explode(F.concat("keys", F.array(F.lit(EVERY)))))
    shared = F.array_intersect("listed", "keys")
    # a product that has several of the input's keys is taken from one list
    once = F.when(F.col("key") == EVERY, F.size(shared) == 0).otherwise(F.col("key") == F.array_min(shared))
    scored = visits.join(lists, "key").where(once).select(
        "_ns", "_recent", _ranked(_components(F.col("p"), F.col("_ns"), F.col("_recent"), F.col("_tokens"))).alias("x"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("_ns", "_recent").orderBy("x"))).filter(F.col("rank") <= k)
    same = prepared._ns.eqNullSafe(best._ns) & prepared._recent.eqNullSafe(best._recent)
    return prepared.join(best, same).select(
        key, *keep, F.col("rank").cast("bigint").alias("rank"),
        *[F.col("x")[c].alias(c) for c in ("product_id", "product", "category")],
        (-F.col("x")["neg_score"]).alias("score"),
        *[F.col("x")[c].alias(c) for c in ("base_product_fit", "recent_category_match", "segment_fit",
                                            "keyword_match", "winback_sleep_boost")])


# fixed values: categories assumed in an explanation for customers without any
DEFAULT_CATEGORIES = ("wellness", "smart home")


def with_default_categories(customers: DataFrame) -> DataFrame:
    """Customers whose ``recent_categories`` are null or empty get the default ones."""
    none = F.size(F.coalesce("recent_categories", F.array().cast("array<string>"))) == 0
    return customers.withColumn("recent_categories", F.when(none, F.array(*map(F.lit, DEFAULT_CATEGORIES))).otherwise(F.col("recent_categories")))


# ---- attributions (M16) -------------------------------------------------------
ATTRIBUTION_NAMES = ("Recommendation score", "Recent category match", "Bundle affinity", "Purchase frequency",
                     "Segment fit", "Product keyword match", "Base product fit", "Discount sensitivity",
                     "Churn risk")


def _num(df: DataFrame, *names: str) -> Column:
    cols = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*cols, F.lit(0.0)) if cols else F.lit(0.0)


def attributions(top: DataFrame, features: DataFrame, key: str = "customer_id") -> DataFrame:
    """Nine signed impacts for each row of ``top`` (key, segment,
    recent_categories, product, category, score, drivers...), ordered by
    absolute impact with ties in list order (T4o).  Output is long:
    key, position, name, impact, value (text)."""
    j = top.join(features, key, "left")
    score = clamp(F.col("score").cast("double"), 0.0, 1.0)
    category = F.lower(F.regexp_replace(F.coalesce(F.col("category"), F.lit("")), "_", " "))
    recent = _norm_categories(F.col("recent_categories"))
    cat_overlap = F.when((category != "") & F.array_contains(recent, category), F.lit(1.0)).otherwise(F.lit(0.0))
    bundle = clamp(_num(features, "bundle_affinity", "engagement_depth"), 0.0, 1.0)
    freq_raw = _num(features, "frequency")
    freq = clamp(freq_raw / 10, 0.0, 1.0)
    disc = clamp(_num(features, "discount_sensitivity"), 0.0, 1.0)
    churn_raw = _num(features, "churn_risk")
    churn = clamp(F.when(churn_raw > 1, churn_raw / 100).otherwise(churn_raw), 0.0, 1.0)
    seg_match = segment_category_match(normalize_segment(F.col("segment")), category)
    txt = lambda c: c.cast("string")
    items = [
        (F.round(score * 0.24, 3), txt(F.round(score, 3))),
        (F.round(F.coalesce(F.col("recent_category_match"), cat_overlap * 0.34), 3),
         F.when(category != "", category).otherwise(F.lit("unknown"))),
        (F.round(bundle * 0.16, 3), txt(F.round(bundle, 3))),
        (F.round(freq * 0.12, 3), txt(freq_raw)),
        (F.round(F.coalesce(F.col("segment_fit"), seg_match * 0.24), 3), F.col("segment")),
        (F.round(F.coalesce(F.col("keyword_match"), F.lit(0.0)), 3), txt(F.round(F.coalesce(F.col("keyword_match"), F.lit(0.0)), 3))),
        (F.round(F.coalesce(F.col("base_product_fit"), F.lit(0.0)), 3), txt(F.round(F.coalesce(F.col("base_product_fit"), F.lit(0.0)), 3))),
        (F.round(disc * -0.12, 3), txt(F.round(disc, 3))),
        (F.round(churn * -0.14, 3), txt(F.round(churn, 3))),
    ]
    arr = F.array(*[F.struct((-F.abs(imp)).alias("neg_abs"), F.lit(i).alias("ordinal"), F.lit(name).alias("name"),
                             imp.alias("impact"), val.alias("value"))
                    for i, (name, (imp, val)) in enumerate(zip(ATTRIBUTION_NAMES, items))])
    ranked = j.select(key, "product", F.posexplode(F.sort_array(arr)).alias("pos", "a"))
    return ranked.select(key, "product", (F.col("pos") + 1).cast("bigint").alias("position"), F.col("a.name").alias("name"),
                         F.col("a.impact").alias("impact"), F.col("a.value").alias("value"))


def explanation_text(product: Column, name: Column, impact: Column) -> Column:
    """'<product> is recommended primarily because <name> contributed +0.23. ...'"""
    return F.concat(product, F.lit(" is recommended primarily because "), F.lower(name), F.lit(" contributed "),
                    F.format_string("%+.2f", F.round(impact, 2)),
                    F.lit(". Positive values increase recommendation confidence; negative values reduce it."))


def recommendation_insight(customers: DataFrame, catalog: DataFrame, features: DataFrame, k: int = 3, key: str = "customer_id") -> DataFrame:
    """Each customer's recommendations with the explanation of the top one
    (its strongest attribution).  The explanation assumes the default
    categories for customers without any, the recommendations do not: both are
    ranked by one call of ``recommend``, for two inputs of such a customer."""
    cust = customers.select(key, "segment", "recent_categories")
    plain = cust.select("*", F.lit(False).alias("assumed"))
    some = F.size(F.coalesce("recent_categories", F.array().cast("array<string>"))) > 0
    assumed = with_default_categories(cust.where(~some)).select("*", F.lit(True).alias("assumed"))
    found = recommend(plain.unionByName(assumed), catalog, k, key, keep=["segment", "recent_categories", "assumed"])
    found = materialize(found, "recommend-insight")
    top = found.where((F.col("rank") == 1) & (F.col("assumed") | some))
    strongest = attributions(top, features, key).filter(F.col("position") == 1).select(
        key, explanation_text(F.col("product"), F.col("name"), F.col("impact")).alias("explanation"),
        F.col("name").alias("strongest_feature"), F.col("impact").alias("strongest_impact"))
    return found.where(~F.col("assumed")).select(key, "rank", "product_id", "score").join(strongest, key, "left")


def exclude_bought(recs: DataFrame, bought_col: str = "bought_product_id") -> DataFrame:
    """Drop a recommended product equal to the bought one, after top-k
    (so fewer than k may remain, trap T15)."""
    return recs.filter(~F.col("product_id").eqNullSafe(F.col(bought_col)))
