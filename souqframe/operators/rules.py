"""Association rules over baskets of items.

A basket is a small array of distinct items (one per described property), so the subsets of a basket are bounded by its
own size; supports are counts of subsets, combined before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subsets(items: Column, size: int) -> Column:
    """All sorted subsets of ``size`` items of a sorted array."""
    one = F.transform(items, lambda a: F.array(a))
    if size == 1:
        return one
    out = one
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda s: F.transform(F.filter(items, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
    return out


def frequent_itemsets(baskets: DataFrame, items: str, least_support: float, longest: int | None = None) -> DataFrame:
    """``items, n, support`` of every itemset with enough support, up to ``longest`` items or the largest basket."""
    own = F.array_sort(F.array_distinct(F.array_compact(F.col(items))))
    seen = baskets.agg(F.count("*").alias("n"), F.max(F.size(own)).alias("most")).first()
    n, most = seen.n, max(seen.most or 0, 1)
    longest = most if longest is None else min(longest, most)
    every = F.flatten(F.array(*[subsets(F.col("_b"), k) for k in range(1, longest + 1)]))
    counted = baskets.select(own.alias("_b")).groupBy("_b").agg(F.count("*").alias("_w")).select(F.explode(every).alias("items"), "_w").groupBy("items").agg(F.sum("_w").alias("n"))
    return counted.where(F.col("n") >= least_support * n).withColumn("support", F.col("n") / F.lit(float(max(n, 1))))


def metrics(s: Column, sa: Column, sc: Column) -> dict[str, Column]:
    """Rule metrics from the supports of both sides together, of the antecedent and of the consequent."""
    conf = s / sa
    lever = s - sa * sc
    zero = F.lit(0.0)
    return {
        "confidence": conf,
        "lift": conf / sc,
        "leverage": lever,
        "conviction": F.when(conf < 1, (1 - sc) / (1 - conf)),
        "zhang": lever / F.nullif(F.greatest(s * (1 - sa), sa * (sc - s)), zero),
        "jaccard": s / (sa + sc - s),
        "certainty": (conf - sc) / F.nullif(1 - sc, zero),
        "kulczynski": (s / sa + s / sc) / 2,
    }


def rules(itemsets: DataFrame, least_confidence: float, least_lift: float) -> DataFrame:
    """``antecedent, consequent`` (arrays; consequents of any size) and all metrics.

    Every proper non-empty subset of an itemset, by bit mask, is an antecedent; supports come by equi-joins."""
    sup = itemsets.select("items", "support")
    masks = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)).alias("mask")
    part = lambda keep: F.filter("items", lambda x, i: (F.floor(F.col("mask") / F.pow(F.lit(2), i)).cast("int") % 2) == keep)
    split = itemsets.where(F.size("items") >= 2).select("items", "support", masks).select(part(1).alias("antecedent"), part(0).alias("consequent"), "support")
    a = sup.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    c = sup.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    full = split.join(a, "antecedent").join(c, "consequent")
    m = metrics(F.col("support"), F.col("antecedent_support"), F.col("consequent_support"))
    return full.withColumns(m).where((F.col("confidence") >= least_confidence) & (F.col("lift") >= least_lift))


def violations(baskets: DataFrame, id_column: str, items: str, mined: DataFrame) -> DataFrame:
    """Baskets that have all of an antecedent but not all of its consequent, with how often and the best confidence.

    Rules meet each distinct basket once, on their first antecedent item; what it breaks then goes to all rows that have it."""
    keyed = mined.select("antecedent", "consequent", "confidence", F.element_at("antecedent", 1).alias("_item"))
    rows = baskets.select(id_column, F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("_b")).distinct()
    kinds = rows.select("_b").distinct()
    hit = kinds.select("_b", F.explode("_b").alias("_item")).join(keyed, "_item").where((F.size(F.array_except("antecedent", "_b")) == 0) & (F.size(F.array_except("consequent", "_b")) > 0))
    label = F.concat(F.array_join("antecedent", "+"), F.lit(" -> "), F.array_join("consequent", "+"))
    broken = hit.groupBy("_b").agg(F.count("*").alias("violations"), F.max("confidence").alias("best_confidence"), F.sort_array(F.collect_list(label)).alias("labels"))
    return rows.join(broken, "_b").drop("_b")


def one_hot(baskets: DataFrame, id_column: str, items: str) -> DataFrame:
    """``id`` and a 0/1 column per item that occurs, in order of name: the pivot names its columns first."""
    names = [r.i for r in baskets.select(F.explode(items).alias("i")).where("i IS NOT NULL").distinct().orderBy("i").collect()]
    return baskets.select(id_column, *[F.coalesce(F.array_contains(items, n), F.lit(False)).cast("int").alias(n) for n in names])


def without(items: Column, prefixes: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> Column:
    """Items but those that start with a prefix or bear a name."""
    bad = lambda x: x.isin(*names) if names else F.lit(False)
    starts = lambda x: F.coalesce(*[F.when(x.startswith(p), F.lit(True)) for p in prefixes], F.lit(False)) if prefixes else F.lit(False)
    return F.filter(items, lambda x: ~(bad(x) | starts(x)))


def parse_itemset(c: Column) -> Column:
    """The quoted members of a written set, sorted; none if it cannot be read."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("""['"]([^'"]*)['"]"""), F.lit(1))))
