"""The pN_ queries of the operators in this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souqframe.functions.dates import instant
from souqframe.llm import canonical_list, formatting_duplicates, groups_split, mixing, packing, percentiles, text_quality, tokens
from souqframe.llm.signatures import configuration
from souqframe.operators.text_classes import small
from souqframe.session import Workspace, read_table, spread_out

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
LATE = "2025-01-01T00:00:00Z"
QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _signature_keys() -> list:
    sig = F.col("spec_signature")
    return [sig, F.when(sig.isNotNull(), configuration(sig))]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Listings from 2025 on whose configuration was already listed before. Every spelling of a signature is read and linked once;
    its listings then take its component."""
    ads = read_table(spark, sf, "listings").where("spec_signature IS NOT NULL").select("listing_id", "spec_signature", instant(F.col("created_at")).alias("at")).where("at IS NOT NULL")
    ws = Workspace(spark)
    spellings = ws.stage(ads.select("spec_signature").distinct(), "spellings")
    member = ws.stage(groups_split.components(spellings, "spec_signature", _signature_keys()).select(F.col("record_id").alias("spec_signature"), "component"), "members")
    when = ws.stage(ads.join(small(member, "spec_signature"), "spec_signature").select("listing_id", "component", "at"), "dated")
    late = F.lit(LATE).cast("timestamp")
    old = ws.stage(when.where(F.col("at") < late).select("component").distinct(), "old")
    return when.where(F.col("at") >= late).join(small(old), "component", "left_semi").select("listing_id").distinct()


def p1_split(spark: SparkSession, sf: str) -> DataFrame:
    ads = read_table(spark, sf, "listings")
    return groups_split.grouped_split(ads, "listing_id", _signature_keys(), SHARES).select(F.col("record_id").alias("listing_id"), "split")


def p1_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    ads = read_table(spark, sf, "listings")
    split = groups_split.grouped_split(ads, "listing_id", _signature_keys(), SHARES)
    per = split.groupBy("split").agg(F.count("*").alias("listings"), F.countDistinct("component").alias("configurations"))
    per = Workspace(spark).stage(per, "shares")
    total = per.agg(F.coalesce(F.sum("listings"), F.lit(0)).alias("total")).first().total
    want = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in SHARES.items()])
    return per.select("split", "listings", "configurations", want.alias("target_share"), (F.col("listings") / F.lit(max(total, 1))).alias("share"))


def _mapped_parts(spark: SparkSession, sf: str) -> DataFrame:
    cpus = read_table(spark, sf, "cpus").select("name")
    gpus = read_table(spark, sf, "gpus").select(F.col("gpu_name").alias("name"))
    a = canonical_list.map_values(read_table(spark, sf, "cpu_corrections"), cpus, canonical_list.CPU, "normalized_query", "canonical_cpu_name")
    b = canonical_list.map_values(read_table(spark, sf, "gpu_queries"), gpus, canonical_list.GPU, "gpu_text")
    return a.select("query_id", F.lit("cpus").alias("list"), F.col("normalized_query").alias("typed"), "canonical_name").unionByName(b.select("query_id", F.lit("gpus").alias("list"), F.col("gpu_text").alias("typed"), "canonical_name"))


def p3_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every processor within the Levenshtein distance of a name entered by hand, whole or from some word on."""
    return canonical_list.candidates(read_table(spark, sf, "cpu_corrections"), read_table(spark, sf, "cpus").select("name"), canonical_list.CPU, "canonical_cpu_name", swaps=False)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped_parts(spark, sf).select("query_id", "canonical_name").distinct()


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no single entry, with how often each was typed."""
    return _mapped_parts(spark, sf).where(F.col("canonical_name") == canonical_list.UNMATCHED).groupBy("list", "typed").agg(F.count("*").alias("n"))


def _price_percentiles(spark: SparkSession, sf: str, relative_error: float | None, by_day: bool) -> DataFrame:
    ads = read_table(spark, sf, "listings").select("listing_id", "city_grouped", "brand", "price_corrected", F.to_date("scraped_at").alias("day"))
    kinds = F.explode(F.array(F.struct(F.lit("city_grouped").alias("dimension"), F.col("city_grouped").alias("grp")), F.struct(F.lit("brand").alias("dimension"), F.col("brand").alias("grp"))))
    long = ads.select("price_corrected", "day", kinds.alias("k")).select("price_corrected", "day", "k.*")
    by = ["dimension", "grp"]
    if by_day:
        summary = percentiles.merge(percentiles.summarise(long, ["day", *by], "price_corrected", relative_error), by)
    else:
        summary = percentiles.summarise(long, by, "price_corrected", relative_error)
    return percentiles.multi_select(summary, by, QUANTILES)


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of price per city and per brand over all deliveries."""
    return _price_percentiles(spark, sf, None, False)


def p4_percentiles_of_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same from summaries of separate days, combined."""
    return _price_percentiles(spark, sf, None, True)


def p4_percentiles_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Within 0.5 % from summaries of bounded size, combined over the days."""
    return _price_percentiles(spark, sf, 0.005, True)


_SAME = ("scraped_at",)


def _ad_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_duplicates.encode(read_table(spark, sf, "listings"), "listing_id", _SAME, ("created_at",))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_duplicates.copies(_ad_tuples(spark, sf))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct ad with its number of copies."""
    return formatting_duplicates.collapse(_ad_tuples(spark, sf)).select(F.col("first_id").alias("listing_id"), "n_copies")


def _packs(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r.pack_name: r.capacity_tokens for r in read_table(spark, sf, "pack_sizes").orderBy("pack_name").collect()}


def _sizes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return Workspace(spark).stage(tokens.with_token_counts(spread_out(read_table(spark, sf, "documents").select("doc_id", "text", *columns)), "text", ["doc_id", *columns]), "sizes")


def p7_packs(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf), _packs(spark, sf))


def p7_fill_report(spark: SparkSession, sf: str) -> DataFrame:
    packs = _packs(spark, sf)
    return packing.fill_report(packing.pack(_sizes(spark, sf), packs), packs)


#: The domain of each source (parameter of the mixture; others form a domain of their own).
DOMAINS = {
    "market": ("ad_text", "shop_page", "price_bulletin", "catalog_dump"),
    "talk": ("forum_thread", "chat_export", "review_blog", "seller_faq"),
    "technical": ("spec_sheet", "repair_notes", "user_manual"),
}
#: Share of all there is (repeats included) that the large mixture asks for: more than keeps every share.
LARGE = 0.8


def _mixed(spark: SparkSession, sf: str, share_of_supply: float | None = None) -> tuple[DataFrame, DataFrame, list, list]:
    targets = read_table(spark, sf, "mix_targets").where("source IS NOT NULL AND target_share IS NOT NULL").collect()
    domain_of = {s: d for d, names in DOMAINS.items() for s in names}
    domain = F.coalesce(*[F.when(F.col("source").isin(*names), F.lit(d)) for d, names in DOMAINS.items()], F.lit("other")).alias("domain")
    language = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und")).alias("language")
    sizes = _sizes(spark, sf, "source", "lang").select("doc_id", domain, "source", language, "n_tokens")
    weights = {(domain_of.get(r.source, "other"), r.source): r.target_share for r in targets}
    repeats = {r.source: r.max_repeats for r in targets}
    drawn, plan = mixing.mix(sizes, ["domain", "source", "language"], weights, repeats, "source", share_of_supply=share_of_supply)
    return drawn, sizes, targets, plan


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0].select("doc_id", "source", "language", "n_tokens", "repeats")


def p8_large_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture larger than keeps every share: per node of the tree what its share came to, what it has, what it was given after
    shortages went to siblings first and up only then, and what was drawn."""
    drawn, _, _, plan = _mixed(spark, sf, LARGE)
    rows = [(p[0], p[1] if len(p) > 1 else None, share, wanted, supply, budget, max(wanted - supply, 0.0), max(budget - wanted, 0.0)) for p, share, wanted, supply, budget in plan]
    nodes = spark.createDataFrame(rows, "domain string, source string, share_of_parent double, wanted double, supply double, budget double, shortage double, taken_over double")
    got = drawn.withColumn("tokens", F.col("n_tokens") * F.col("repeats"))
    per = got.groupBy("domain", "source").agg(F.sum("tokens").alias("drawn")).unionByName(got.groupBy("domain").agg(F.sum("tokens").alias("drawn")).withColumn("source", F.lit(None).cast("string")))
    same = (nodes["domain"] == per["domain"]) & nodes["source"].eqNullSafe(per["source"])
    return nodes.join(per, same, "left").select(nodes["domain"], nodes["source"], *nodes.columns[2:], F.coalesce("drawn", F.lit(0)).alias("drawn"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every source, targeted or seen."""
    drawn, sizes, targets, _ = _mixed(spark, sf)
    want = spark.createDataFrame([(r.source, r.target_share, r.max_repeats) for r in targets], "source string, target_share double, max_repeats int")
    seen = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    got = Workspace(spark).stage(got, "drawn")
    total = got.agg(F.coalesce(F.sum("drawn_tokens"), F.lit(0)).alias("total")).first().total
    full = seen.join(want, "source", "full").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return full.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), (F.coalesce("drawn_tokens", F.lit(0)) / F.lit(max(total, 1))).alias("share"), zero("documents"), zero("tokens"), zero("drawn_tokens"), "max_repeats", zero("most_repeats"))


def p9_quality(spark: SparkSession, sf: str) -> DataFrame:
    words = [r.word for r in read_table(spark, sf, "common_words").select("word").distinct().orderBy("word").collect()]
    return text_quality.text_quality(spread_out(read_table(spark, sf, "documents").select("doc_id", "text")), words)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_quality(spark, sf).where("NOT is_prose").select("doc_id").distinct()


# -- what must hold of each result, counted over all of it ---------------------------------------------


def _checks(spark: SparkSession, rows: dict[str, DataFrame]) -> DataFrame:
    """``check_name, violations``: one row a check, from frames with a single count."""
    out = None
    for name, df in rows.items():
        one = df.toDF("n").select(F.lit(name).alias("check_name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    """Documents with the keys that chain: texts of one author or about one listing belong together."""
    return read_table(spark, sf, "documents").select("doc_id", "author_id", "listing_id"), [F.col("author_id"), F.col("listing_id")]


def p1_document_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents linked through authors and listings, over any number of steps, in one split each."""
    docs, keys = _keys(spark, sf)
    return groups_split.grouped_split(docs, "doc_id", keys, SHARES).select(F.col("record_id").alias("doc_id"), "split")


def p1_document_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest document of each document's linked set."""
    docs, keys = _keys(spark, sf)
    member = Workspace(spark).stage(groups_split.components(docs, "doc_id", keys), "members")
    first = member.groupBy("component").agg(F.min("record_id").alias("first_id"))
    return member.join(first, "component").select(F.col("record_id").alias("doc_id"), "first_id").distinct()


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    ws = Workspace(spark)
    split = ws.stage(p1_split(spark, sf), "split")
    ads = read_table(spark, sf, "listings").select("listing_id", configuration(F.col("spec_signature")).alias("c")).distinct()
    j = ads.join(split, "listing_id", "left")
    torn = j.where("c IS NOT NULL").groupBy("c").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")))
    n = split.count()
    off = split.groupBy("split").agg(F.count("*").alias("n")).agg(F.count_if(F.abs(F.col("n") / F.lit(max(n, 1)) - F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in SHARES.items()])) > 0.02))
    return _checks(spark, {"configurations in two splits": torn, "listings without a split": j.agg(F.count_if(F.col("split").isNull())), "shares off by more than 0.02": off})


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from summaries of bounded size against the exact ones."""
    exact = p4_percentiles(spark, sf).select("dimension", "grp", "quantile", F.col("value").alias("exact"))
    same = (F.col("a.dimension") == F.col("b.dimension")) & F.col("a.grp").eqNullSafe(F.col("b.grp")) & (F.col("a.quantile") == F.col("b.quantile"))
    j = exact.alias("a").join(p4_percentiles_bounded(spark, sf).alias("b"), same, "full")
    bad = F.coalesce(F.abs(F.col("b.value") - F.col("a.exact")) > 0.005 * F.abs(F.col("a.exact")) + 1e-9, F.lit(True))
    return _checks(spark, {"percentiles off by more than 0.5 %": j.agg(F.count_if(bad))})


def p7_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Packs by characters instead of tokens: documents, characters and pieces packed, and containers too full."""
    packs = _packs(spark, sf)
    sizes = read_table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n_tokens"))
    packed = Workspace(spark).stage(packing.pack(sizes, packs), "packed")
    capacity = F.coalesce(*[F.when(F.col("pack_name") == p, F.lit(c)) for p, c in packs.items()])
    full = packed.groupBy("pack_name", "container_id").agg(F.sum("piece_tokens").alias("t")).groupBy("pack_name").agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    per = packed.groupBy("pack_name").agg(F.count_distinct("doc_id").alias("documents"), F.sum("piece_tokens").alias("characters"), F.count("*").alias("pieces"))
    return per.join(full, "pack_name")


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    drawn, sizes, targets, _ = _mixed(spark, sf)
    most = spark.createDataFrame([(r.source, r.target_share, r.max_repeats) for r in targets], "source string, target double, most int")
    present = sizes.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("longest")).join(most, "source")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"))
    total = got.agg(F.sum("t").alias("all"))
    j = present.join(got, "source", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(present.agg(F.sum("target").alias("whole"), F.sum("longest").alias("slack"))))
    off = F.abs(F.coalesce("t", F.lit(0)) - F.col("all") * F.col("target") / F.col("whole")) > F.col("slack")
    return _checks(spark, {
        "documents drawn too often": drawn.join(most, "source").agg(F.count_if(F.col("repeats") > F.col("most"))),
        "documents drawn twice": drawn.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1)),
        "untargeted documents": drawn.join(most, "source", "left_anti").agg(F.count("*")),
        "shares off by more than rounding": j.agg(F.count_if(off)),
    })


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return p9_quality(spark, sf).select("doc_id", "n_words", r6("mean_word_length"), r6("ended_line_share"), r6("common_word_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_split": p1_split,
    "p1_split_shares": p1_split_shares,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p3_candidates": p3_candidates,
    "p4_percentiles_of_days": p4_percentiles_of_days,
    "p4_percentiles": p4_percentiles,
    "p4_percentiles_bounded": p4_percentiles_bounded,
    "p6_found": p6_found,
    "p6_records": p6_records,
    "p7_packs": p7_packs,
    "p7_fill_report": p7_fill_report,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_large_budgets": p8_large_budgets,
    "p9_found": p9_found,
    "p9_quality": p9_quality,
    **{f.__name__: f for f in (p1_document_split, p1_document_groups, p1_checks, p4_checks, p7_characters, p8_checks, p9_statistics)},
}

_CONFIGURATION = r"""array_to_string(list_transform(string_split(spec_signature, '|'), lambda x: CASE WHEN try_cast(replace(replace(x, ',', ''), ' ', '') AS DOUBLE) IS NULL OR isnan(try_cast(replace(replace(x, ',', ''), ' ', '') AS DOUBLE)) THEN '?' ELSE CAST(try_cast(replace(replace(x, ',', ''), ' ', '') AS DOUBLE) AS VARCHAR) END), '|')"""
_INSTANT = r"""try_strptime(regexp_replace(upper(trim(created_at)), '(\+00:00|\.000Z|Z)$', ''), ['%Y %m %dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%H:%M:%S %Y.%m.%d', '%d/%m/%Y %H:%M:%S', '%Y%m%dT%H%M%S'])"""
_NAME = r"regexp_replace(lower(regexp_replace({}, '\s*@.*$', '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')"


def _none(*checks: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS check_name, 0 AS violations" for c in checks)


_PERCENTILES = """WITH l AS (SELECT 'city_grouped' AS dimension, city_grouped AS grp, price_corrected AS v FROM listings
 UNION ALL SELECT 'brand', brand, price_corrected FROM listings),
r AS (SELECT dimension, grp, v, row_number() OVER (PARTITION BY dimension, grp ORDER BY v) AS k, count(*) OVER (PARTITION BY dimension, grp) AS n FROM l WHERE v IS NOT NULL AND NOT isnan(v)),
q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS quantile)
SELECT dimension, grp, quantile, v AS value, k AS rank, n AS n_values FROM r JOIN q ON k = greatest(CAST(ceil(quantile * n) AS BIGINT), 1)"""
_TEXTS = ["city", "city_grouped", "spec_Etat", "brand", "model_name", "CPU", "DEDICATED_GPU", "RAM_SIZE", "RAM_TYPE", "SSD_SIZE", "HDD_SIZE", "SCREEN_RESOLUTION_STD", "mapped_cpu_name", "cpu_mark", "gpu_name", "gpu_g3d_mark", "gpu_g2d_mark", "price", "spec_signature"]
_NUMBERS = ["SCREEN_SIZE_SNAPPED", "SCREEN_RESOLUTION_ENC", "cores", "tdp", "gpu_tdp", "price_preview", "price_corrected"]
# copies in SQL: texts by their sorted letters and digits, which no two different values of these tables share
_RECORD = ", ".join(
    [rf"coalesce(array_to_string(list_sort(string_split(regexp_replace(lower(CAST({c} AS VARCHAR)), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')), ''), '-null-')" for c in _TEXTS]
    + [f"coalesce(CAST({c} AS VARCHAR), '-null-')" for c in _NUMBERS]
    + [rf"coalesce(CAST({_INSTANT} AS VARCHAR), array_to_string(list_sort(string_split(regexp_replace(lower(created_at), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')), ''), '-null-')"]
)

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH l AS (SELECT listing_id, {_CONFIGURATION} AS c, {_INSTANT} AS posted FROM listings WHERE spec_signature IS NOT NULL)
SELECT DISTINCT listing_id FROM l WHERE posted >= TIMESTAMP '2025-01-01' AND c IN (SELECT c FROM l WHERE posted < TIMESTAMP '2025-01-01')""",
    "p3_candidates": rf"""WITH n AS (SELECT DISTINCT name, string_split(trim({_NAME.format("name")}), ' ') AS w FROM cpus WHERE name IS NOT NULL),
paths AS (SELECT name, array_to_string(w[i:], '') AS path FROM (SELECT name, w, unnest(range(1, len(w) + 1)) AS i FROM n)),
q AS (SELECT DISTINCT canonical_cpu_name, replace({_NAME.format("canonical_cpu_name")}, ' ', '') AS g FROM cpu_corrections WHERE canonical_cpu_name IS NOT NULL),
d AS (SELECT canonical_cpu_name, name, min(levenshtein(g, path)) AS distance FROM q, paths WHERE g <> '' AND abs(len(g) - len(path)) <= 2 GROUP BY 1, 2, g)
SELECT canonical_cpu_name, name, CAST(distance AS INTEGER) AS distance FROM d WHERE distance <= CASE WHEN len(replace({_NAME.format("canonical_cpu_name")}, ' ', '')) <= 3 THEN 0 WHEN len(replace({_NAME.format("canonical_cpu_name")}, ' ', '')) <= 5 THEN 1 ELSE 2 END""",
    "p4_percentiles": _PERCENTILES,
    "p4_percentiles_of_days": _PERCENTILES,
    "p6_found": f"""WITH r AS (SELECT DISTINCT listing_id, md5(concat_ws('|', {_RECORD})) AS k FROM listings),
g AS (SELECT k, min(listing_id) AS first_id FROM r GROUP BY k HAVING count(*) > 1)
SELECT first_id, listing_id AS copy_id FROM r JOIN g USING (k) WHERE listing_id > first_id""",
    "p6_records": f"""WITH r AS (SELECT DISTINCT listing_id, md5(concat_ws('|', {_RECORD})) AS k FROM listings)
SELECT min(listing_id) AS listing_id, count(*) AS n_copies FROM r GROUP BY k""",
    "p1_checks": _none("configurations in two splits", "listings without a split", "shares off by more than 0.02"),
    "p1_document_groups": """WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM (SELECT doc_id, 'a' || author_id AS k FROM documents WHERE author_id IS NOT NULL UNION ALL SELECT doc_id, 'l' || listing_id FROM documents WHERE listing_id IS NOT NULL) a JOIN (SELECT min(doc_id) AS doc_id, k FROM (SELECT doc_id, 'a' || author_id AS k FROM documents WHERE author_id IS NOT NULL UNION ALL SELECT doc_id, 'l' || listing_id FROM documents WHERE listing_id IS NOT NULL) GROUP BY k) b USING (k)),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.y, r.m FROM r JOIN s ON s.x = r.doc_id AND r.m < s.y)
SELECT doc_id, min(m) AS first_id FROM r GROUP BY 1""",
    "p4_checks": _none("percentiles off by more than 0.5 %"),
    "p7_characters": "SELECT pack_name, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(greatest(ceil(n_chars / capacity_tokens), 1)) AS BIGINT) AS pieces, 0 AS overfull FROM documents, pack_sizes GROUP BY 1",
    "p8_checks": _none("documents drawn too often", "documents drawn twice", "untargeted documents", "shares off by more than rounding"),
    "p9_statistics": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+$', '')), lambda x: x <> '') AS lines FROM documents),
c AS (SELECT list(DISTINCT word) AS common FROM common_words)
SELECT doc_id, coalesce(len(words), 0) AS n_words, round(list_sum(list_transform(words, lambda x: len(x))) / nullif(len(words), 0), 6) AS mean_word_length,
 round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?؟…;:]$'))) / nullif(len(lines), 0), 6) AS ended_line_share, round(len(list_filter(words, lambda x: list_contains(common, x))) / nullif(len(words), 0), 6) AS common_word_share FROM w, c""",
}
