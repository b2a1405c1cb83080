"""Association rules and outliers over all listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe.functions.specs import capacity_gb, labelled_bins
from souqframe.operators import outliers, rules
from souqframe.plans.cleaning_queries import _capacity_sql
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import Workspace, read_table

_A = f"WITH {ADS} "
_RAM, _PRICE = [-1, 4, 8, 16, 1e9], [0, 40_000, 80_000, 160_000, 1_000_000]
_RAM_L, _PRICE_L = ["ram<=4", "ram<=8", "ram<=16", "ram>16"], ["price1", "price2", "price3", "price4"]


def _baskets(spark, sf):
    a = ads(spark, sf)
    items = F.array_compact(F.array(
        labelled_bins(capacity_gb(F.col("RAM_SIZE")), _RAM, _RAM_L), labelled_bins(F.col("price"), _PRICE, _PRICE_L),
        F.when(F.col("DEDICATED_GPU").isNotNull(), "dedicated").otherwise("integrated"), F.concat(F.lit("res:"), "SCREEN_RESOLUTION_STD"), F.concat(F.lit("brand:"), "brand"),
    ))
    return a.select("listing_id", F.array_sort(items).alias("items")).distinct()


def _bin_sql(expr: str, edges: list, labels: list) -> str:
    return "CASE " + " ".join(f"WHEN {expr} > {a} AND {expr} <= {b} THEN '{l}'" for a, b, l in zip(edges[:-1], edges[1:], labels, strict=True)) + " END"


_BASKETS = _A + f", r AS (SELECT *, {_capacity_sql('RAM_SIZE', 15)} AS ram FROM a), k AS (SELECT DISTINCT listing_id, list_sort(list_filter([{_bin_sql('ram', _RAM, _RAM_L)}, {_bin_sql('price', _PRICE, _PRICE_L)}, CASE WHEN DEDICATED_GPU IS NOT NULL THEN 'dedicated' ELSE 'integrated' END, 'res:' || SCREEN_RESOLUTION_STD, 'brand:' || brand], lambda x: x IS NOT NULL)) AS items FROM r)"
_SETS = _BASKETS.replace("k AS (", "k AS MATERIALIZED (") + """, b AS MATERIALIZED (SELECT items, count(*) AS w FROM k GROUP BY items), n AS (SELECT count(*) AS n FROM k),
m AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) % 2 = 1) AS items, w FROM (SELECT items, w, unnest(range(1, CAST(pow(2, len(items)) AS INT))) AS mask FROM b)),
s AS MATERIALIZED (SELECT items, CAST(sum(w) AS BIGINT) AS c, sum(w) / any_value(n) AS support FROM m, n GROUP BY items HAVING sum(w) >= 0.05 * any_value(n))"""
_RULES = _SETS + """, sp AS (SELECT items, support, unnest(range(1, CAST(pow(2, len(items)) AS INT) - 1)) AS m FROM s WHERE len(items) >= 2),
pr AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 1) AS antecedent, list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 0) AS consequent, support FROM sp),
ru AS MATERIALIZED (SELECT antecedent, consequent, pr.support AS support, a1.support AS sa, c1.support AS sc, pr.support / a1.support AS confidence, pr.support / a1.support / c1.support AS lift FROM pr JOIN s a1 ON antecedent = a1.items JOIN s c1 ON consequent = c1.items),
hit AS MATERIALIZED (SELECT items, antecedent, consequent, confidence FROM b JOIN ru ON confidence >= 0.8 AND lift >= 1.0 AND list_has_all(b.items, antecedent) AND NOT list_has_all(b.items, consequent))"""


def basket_items(spark, sf):
    return _baskets(spark, sf).select("listing_id", F.array_join("items", ",").alias("items"))


def frequent_itemsets(spark, sf):
    s = rules.frequent_itemsets(_baskets(spark, sf), "items", 0.05)
    return s.select(F.array_join("items", ",").alias("items"), "n", r6("support").alias("support"))


def _mined(spark, sf, confidence=0.5, lift=1.05):
    return rules.rules(rules.frequent_itemsets(_baskets(spark, sf), "items", 0.05), confidence, lift)


def association_rules(spark, sf):
    """Rules with confidence from 0.5 and lift from 1.05, all metrics."""
    cols = ["support", "antecedent_support", "consequent_support", "confidence", "lift", "leverage", "conviction", "zhang", "jaccard", "certainty", "kulczynski"]
    return _mined(spark, sf).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *[r6(c).alias(c) for c in cols])


def spec_consistency(spark, sf):
    """Listings that break rules of confidence from 0.8."""
    b = _baskets(spark, sf)
    ws = Workspace(spark)
    v = rules.violations(b, "listing_id", "items", ws.stage(_mined(spark, sf, 0.8, 1.0), "rules"))
    return v.select("listing_id", "violations", r6("best_confidence").alias("best_confidence"), F.array_join("labels", "; ").alias("labels"))


def violation_summary(spark, sf):
    """The rules most often broken."""
    b = _baskets(spark, sf)
    v = rules.violations(b, "listing_id", "items", Workspace(spark).stage(_mined(spark, sf, 0.8, 1.0), "rules"))
    return v.select(F.explode("labels").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(10)


def top_rules(spark, sf):
    """The 20 rules of highest lift, then confidence."""
    r = _mined(spark, sf).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), r6("lift").alias("lift"), r6("confidence").alias("confidence"))
    return r.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(20)


def one_hot_baskets(spark, sf):
    """A 0/1 column per item but those of brand and resolution."""
    b = _baskets(spark, sf).select("listing_id", rules.without(F.col("items"), ("brand:", "res:")).alias("items"))
    return rules.one_hot(b, "listing_id", "items")


def experiment_itemsets(spark, sf):
    """Itemsets mined without brands and without the item almost every listing has."""
    b = _baskets(spark, sf).select("listing_id", rules.without(F.col("items"), ("brand:",), ("integrated",)).alias("items"))
    return rules.frequent_itemsets(b, "items", 0.05).select(F.array_join("items", ",").alias("items"), "n")


def parsed_itemsets(spark, sf):
    """Written sets read back."""
    s = _baskets(spark, sf).select("listing_id", F.concat(F.lit("frozenset({'"), F.array_join("items", "', '"), F.lit("'})")).alias("written"))
    return s.select("listing_id", F.array_join(rules.parse_itemset(F.col("written")), ",").alias("items"))


_DIMS = ["price", "cpu_mark", "gpu_g3d_mark", "cores"]


def tail_outliers(spark, sf):
    """Empirical tail scores over four measures, and which listings are in the top 2 %."""
    a = ads(spark, sf).select("listing_id", *_DIMS).distinct()
    s = Workspace(spark).stage(outliers.tail_scores(a, "listing_id", _DIMS), "scores")
    t = s.agg(F.percentile("score", F.lit(0.98)).alias("t"))
    return s.crossJoin(F.broadcast(t)).select("listing_id", F.round("left", 5).alias("left"), F.round("right", 5).alias("right"), F.round("auto", 5).alias("auto"))


def _flags(spark, sf):
    a = ads(spark, sf).select("listing_id", *_DIMS).distinct()
    st = a.agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.percentile("cpu_mark", F.lit(0.98)).alias("c"))
    j = a.crossJoin(F.broadcast(st))
    iqr = F.element_at("q", 2) - F.element_at("q", 1)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select("listing_id", flag((F.col("price") - F.col("m")) / F.col("s") > 2).alias("z"), flag(F.col("price") > F.element_at("q", 2) + 1.5 * iqr).alias("iqr"), flag(F.col("cpu_mark") > F.col("c")).alias("mark"))


def detector_ensemble(spark, sf):
    """How many detectors flag a listing, majority and union counts."""
    f = _flags(spark, sf)
    k = sum((F.col(c).cast("int") for c in ("z", "iqr", "mark")), F.lit(0))
    return f.agg(F.sum(F.col("z").cast("bigint")).alias("z"), F.sum(F.col("iqr").cast("bigint")).alias("iqr"), F.sum(F.col("mark").cast("bigint")).alias("mark"), F.sum((k >= 2).cast("bigint")).alias("majority"), F.sum((k >= 1).cast("bigint")).alias("any"))


def detector_agreement(spark, sf):
    """Jaccard agreement of each pair of detectors; 1 where neither flags anything."""
    f = _flags(spark, sf)
    pairs = [("z", "iqr"), ("z", "mark"), ("iqr", "mark")]
    both = lambda x, y: F.sum((F.col(x) & F.col(y)).cast("int")) / F.nullif(F.sum((F.col(x) | F.col(y)).cast("int")), F.lit(0))
    one = f.agg(*[r6(F.coalesce(both(x, y), F.lit(1.0))).alias(f"{x}-{y}") for x, y in pairs])
    return one.unpivot([], [f"{x}-{y}" for x, y in pairs], "pair", "jaccard")


def listing_detectors(spark, sf):
    """Per listing which of isolation forest, skew-directed tails and both-sided tails put it in the top 2 %, and how many do.

    Isolation sees odd combinations of measures that no single tail shows."""
    ws = Workspace(spark)
    a = ws.stage(ads(spark, sf).groupBy("listing_id").agg(*[F.max(c).alias(c) for c in _DIMS]), "measures")
    tails = outliers.tail_scores(a, "listing_id", _DIMS).select("listing_id", F.col("auto").alias("directed"), F.col("score").alias("both"))
    s = ws.stage(outliers.isolation_scores(a, "listing_id", _DIMS, trees=300).withColumnRenamed("score", "isolation").join(tails, "listing_id"), "scores")
    names = ("isolation", "directed", "both")
    ends = s.agg(*[F.percentile_approx(n, 0.98, 10_000).alias(f"_{n}") for n in names])
    flagged = s.crossJoin(F.broadcast(ends)).select("listing_id", *[(F.col(n) > F.col(f"_{n}")).cast("int").alias(n) for n in names])
    return flagged.withColumn("n_flagged", sum((F.col(n) for n in names), F.lit(0)))


def isolation_forest(spark, sf):
    a = ads(spark, sf).select("listing_id", *_DIMS).distinct()
    return outliers.isolation_scores(a, "listing_id", _DIMS, trees=300)


def local_outliers(spark, sf):
    """Local outlier factors of all vectors."""
    lof = outliers.local_outlier_factor(read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return lof.select("vec_id", F.round("lof", 3).alias("lof"))


def gower_nearest(spark, sf):
    """The five listings nearest to every listing whose id is divisible by 20, by Gower distance over all listings."""
    a = Workspace(spark).stage(ads(spark, sf).groupBy("listing_id").agg(*[F.min(c).alias(c) for c in ("price", "cpu_mark", "brand", "SCREEN_RESOLUTION_STD")]), "features")
    return outliers.gower_nearest(a, a.where("listing_id % 20 = 0"), "listing_id", ["price", "cpu_mark"], ["brand", "SCREEN_RESOLUTION_STD"], 5)


QUERIES = {f.__name__: f for f in (basket_items, frequent_itemsets, association_rules, spec_consistency, violation_summary, parsed_itemsets, tail_outliers, detector_ensemble, detector_agreement, isolation_forest, listing_detectors, local_outliers, gower_nearest, top_rules, one_hot_baskets, experiment_itemsets)}
_TAILS = _A + ", d AS (SELECT DISTINCT listing_id, price, cpu_mark, gpu_g3d_mark, cores FROM a), " + ", ".join(
    f"t{i} AS (SELECT {c} AS v, -ln(sum(count(*)) OVER (ORDER BY {c}) / sum(count(*)) OVER ()) AS l, -ln(sum(count(*)) OVER (ORDER BY {c} DESC) / sum(count(*)) OVER ()) AS r FROM d WHERE {c} IS NOT NULL GROUP BY {c})" for i, c in enumerate(_DIMS)
) + ", w AS (SELECT " + ", ".join(f"skewness({c}) AS k{i}" for i, c in enumerate(_DIMS)) + " FROM d)"
_FLAGS = _A + ", d AS (SELECT DISTINCT listing_id, price, cpu_mark, gpu_g3d_mark, cores FROM a), st AS (SELECT avg(price) AS m, stddev_pop(price) AS s, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, quantile_cont(cpu_mark, 0.98) AS c FROM d), f AS (SELECT coalesce((price - m) / s > 2, false) AS z, coalesce(price > q3 + 1.5 * (q3 - q1), false) AS iqr, coalesce(cpu_mark > c, false) AS mark FROM d, st)"
ORACLE = {
    "basket_items": _BASKETS + " SELECT listing_id, array_to_string(items, ',') AS items FROM k",
    "frequent_itemsets": _SETS + " SELECT array_to_string(items, ',') AS items, c AS n, round(support, 6) AS support FROM s",
    "association_rules": _RULES + " SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, round(support, 6) AS support, round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support - sa * sc, 6) AS leverage, round(CASE WHEN confidence < 1 THEN (1 - sc) / (1 - confidence) END, 6) AS conviction, round((support - sa * sc) / nullif(greatest(support * (1 - sa), sa * (sc - support)), 0), 6) AS zhang, round(support / (sa + sc - support), 6) AS jaccard, round((confidence - sc) / nullif(1 - sc, 0), 6) AS certainty, round((support / sa + support / sc) / 2, 6) AS kulczynski FROM ru WHERE confidence >= 0.5 AND lift >= 1.05",
    "spec_consistency": _RULES + " SELECT listing_id, violations, best_confidence, labels FROM k JOIN (SELECT items, count(*) AS violations, round(max(confidence), 6) AS best_confidence, array_to_string(list_sort(list(array_to_string(antecedent, '+') || ' -> ' || array_to_string(consequent, '+'))), '; ') AS labels FROM hit GROUP BY 1) USING (items)",
    "violation_summary": _RULES + " SELECT array_to_string(antecedent, '+') || ' -> ' || array_to_string(consequent, '+') AS rule, CAST(sum(w) AS BIGINT) AS n FROM hit JOIN b USING (items) GROUP BY 1 ORDER BY n DESC, rule LIMIT 10",
    "top_rules": _RULES + " SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, round(lift, 6) AS lift, round(confidence, 6) AS confidence FROM ru WHERE confidence >= 0.5 AND lift >= 1.05 ORDER BY round(ru.lift, 6) DESC, round(ru.confidence, 6) DESC, 1, 2 LIMIT 20",
    "one_hot_baskets": _BASKETS + " SELECT listing_id, CAST(list_contains(items, 'dedicated') AS INT) AS dedicated, CAST(list_contains(items, 'integrated') AS INT) AS integrated, " + ", ".join(f"CAST(list_contains(items, '{x}') AS INT) AS \"{x}\"" for x in ("price1", "price2", "price3", "price4", "ram<=16", "ram<=4", "ram<=8", "ram>16")) + " FROM k",
    "experiment_itemsets": _SETS + " SELECT array_to_string(items, ',') AS items, c AS n FROM s WHERE len(list_filter(items, lambda x: starts_with(x, 'brand:') OR x = 'integrated')) = 0",
    "parsed_itemsets": _BASKETS + " SELECT listing_id, array_to_string(items, ',') AS items FROM k",
    "tail_outliers": _TAILS + " SELECT listing_id, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in (('"left"', " + ".join(f"coalesce(t{i}.l, 0)" for i in range(4))), ('"right"', " + ".join(f"coalesce(t{i}.r, 0)" for i in range(4))), ("auto", " + ".join(f"coalesce(CASE WHEN k{i} < 0 THEN t{i}.l ELSE t{i}.r END, 0)" for i in range(4))))) + " FROM d CROSS JOIN w " + " ".join(f"LEFT JOIN t{i} ON t{i}.v = d.{c}" for i, c in enumerate(_DIMS)),
    "detector_ensemble": _FLAGS + ' SELECT count(*) FILTER (z) AS z, count(*) FILTER (iqr) AS iqr, count(*) FILTER (mark) AS mark, count(*) FILTER (CAST(z AS INT) + CAST(iqr AS INT) + CAST(mark AS INT) >= 2) AS majority, count(*) FILTER (z OR iqr OR mark) AS "any" FROM f',
    "detector_agreement": _FLAGS + " " + " UNION ALL ".join(f"SELECT '{x}-{y}' AS pair, round(coalesce(count(*) FILTER ({x} AND {y}) / nullif(count(*) FILTER ({x} OR {y}), 0), 1), 6) AS jaccard FROM f" for x, y in (("z", "iqr"), ("z", "mark"), ("iqr", "mark"))),
    "gower_nearest": _A + ", d AS (SELECT listing_id, min(price) AS price, min(cpu_mark) AS cpu_mark, min(brand) AS brand, min(SCREEN_RESOLUTION_STD) AS r FROM a GROUP BY 1), w AS (SELECT max(price) - min(price) AS wp, max(cpu_mark) - min(cpu_mark) AS wc FROM d), j AS (SELECT x.listing_id AS listing_id, y.listing_id AS neighbour, coalesce(abs(x.price - y.price) / wp, 0) + coalesce(abs(x.cpu_mark - y.cpu_mark) / wc, 0) + coalesce(CAST(x.brand <> y.brand AS INT), 0) + coalesce(CAST(x.r <> y.r AS INT), 0) AS num, CAST(x.price + y.price IS NOT NULL AS INT) + CAST(x.cpu_mark + y.cpu_mark IS NOT NULL AS INT) + CAST(x.brand || y.brand IS NOT NULL AS INT) + CAST(x.r || y.r IS NOT NULL AS INT) AS den FROM d x JOIN d y ON x.listing_id <> y.listing_id AND x.listing_id % 20 = 0, w), g AS (SELECT listing_id, neighbour, round(CASE WHEN den > 0 THEN num / den ELSE 1 END, 6) AS distance FROM j) SELECT listing_id, neighbour, distance, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY distance, neighbour) AS INT) AS place FROM g QUALIFY place <= 5",
    "local_outliers": "WITH p AS (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id), n AS (SELECT i, j, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 35), k AS (SELECT i, max(d) AS kd FROM n GROUP BY 1), r AS (SELECT n.i, 1 / greatest(avg(greatest(n.d, k.kd)), 1e-10) AS lrd FROM n JOIN k ON n.j = k.i GROUP BY 1) SELECT n.i AS vec_id, round(avg(b.lrd) / any_value(a.lrd), 3) AS lof FROM n JOIN r a ON n.i = a.i JOIN r b ON n.j = b.i GROUP BY 1",
}
