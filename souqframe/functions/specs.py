"""Column expressions that read hardware specifications typed as free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souqframe import constants as K


def lookup(c: Column, table: dict) -> Column:
    """The table's value for ``c``, NULL if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def blank(c: Column) -> Column:
    """NULL for NULL and the empty text."""
    return F.nullif(c, F.lit(""))


# -- capacities -----------------------------------------------------------------------------


def is_memory_size(c: Column) -> Column:
    bare = F.regexp_replace(F.replace(F.upper(F.trim(c)), F.lit("GB"), F.lit("")), " ", "")
    return F.coalesce(bare.isin(*K.MEMORY_SIZES), F.lit(False))


def is_storage_size(c: Column) -> Column:
    t = F.upper(F.trim(c))
    n = F.regexp_replace(F.replace(t, F.lit("GB"), F.lit("")), " ", "").try_cast("double")
    return F.coalesce(t.contains("+") | t.contains("TB") | (F.floor(n) >= K.LEAST_STORAGE), F.lit(False))


def cells_swapped(memory: Column, storage: Column) -> Column:
    """Memory and storage stand in each other's column, and exchanging them helps."""
    empty_m, empty_s = F.coalesce(F.trim(memory), F.lit("")) == "", F.coalesce(F.trim(storage), F.lit("")) == ""
    m_stores, m_fits, s_fits = is_storage_size(memory), is_memory_size(memory), is_memory_size(storage)
    return (empty_m & s_fits) | (m_stores & s_fits) | (m_stores & ~m_fits & empty_s)


def drive_pair(c: Column) -> tuple[Column, Column]:
    """The two drives of "a+b"; otherwise the text itself and NULL."""
    parts = F.split(c, r"\+")
    two = F.size(parts) == 2
    return F.when(two, F.trim(parts[0])).otherwise(c), F.when(two, F.trim(parts[1]))


def storage_label(c: Column) -> Column:
    """The first capacity as "nGB", with 1 TB = 1000 GB; what is no number stays as it is."""
    t = F.trim(c)
    units = F.filter(F.split(t, r"\s+"), lambda p: F.upper(p).rlike("GB|TB"))
    first = F.upper(F.when(t.contains(" ") & (F.size(units) > 0), units[0]).otherwise(t))
    whole = lambda x: F.concat(F.floor(x).cast("bigint").cast("string"), F.lit("GB"))
    tera = F.replace(first, F.lit("TB"), F.lit("")).try_cast("double")
    return (
        F.when(blank(c).isNull(), c)
        .when(first.contains("TB"), F.coalesce(whole(tera * 1000), first))
        .when(first.contains("GB"), first)
        .otherwise(F.coalesce(whole(first.try_cast("double")), t))
    )


def _one_gb(t: Column, tera: float) -> Column:
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(t.contains("TB"), n * tera).when(t.contains("MB"), n / 1024).otherwise(n)


def capacity_gb(c: Column) -> Column:
    """Gigabytes with 1 TB = 1000 GB: "+" adds drives, of choices ("/", "|", ",") and of two
    capacities separated by a blank the first counts; 0 for nothing."""
    t = F.upper(F.trim(c))

    def part(p: Column) -> Column:
        first = F.split(p, r"[/|,]")[0]
        units = F.regexp_count(first, F.lit("GB|TB"))
        return _one_gb(F.when((units > 1) & F.trim(first).contains(" "), F.split(F.trim(first), r"\s+")[0]).otherwise(first), 1000.0)

    return F.coalesce(F.aggregate(F.split(t, r"\+"), F.lit(0.0), lambda acc, p: acc + part(p)), F.lit(0.0))


def capacity_gb_binary(c: Column) -> Column:
    """Gigabytes with 1 TB = 1024 GB, all digits of a part read as one number; 0 for nothing."""

    def part(p: Column) -> Column:
        n = F.coalesce(F.regexp_replace(p, r"[^0-9.]", "").try_cast("double"), F.lit(0.0))
        return F.when(p.contains("TB"), n * 1024).when(p.contains("MB"), n / 1024).otherwise(n)

    return F.coalesce(F.aggregate(F.split(F.upper(c), r"\+"), F.lit(0.0), lambda acc, p: acc + part(p)), F.lit(0.0))


def memory_rank(c: Column) -> Column:
    """Rank of the memory generation: the exact name, else the longest name contained, else NULL."""
    t = F.regexp_replace(F.upper(F.trim(c)), " ", "")
    names = sorted(K.RAM_TYPE_ORDINAL, key=lambda n: (-len(n), n))
    inside = F.coalesce(*[F.when(t.contains(n), F.lit(K.RAM_TYPE_ORDINAL[n])) for n in names])
    return F.coalesce(lookup(t, K.RAM_TYPE_ORDINAL), inside)


# -- screens --------------------------------------------------------------------------------


def screen_size(c: Column) -> Column:
    """The first number (comma or point) if it can be a screen."""
    n = F.nullif(F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when(n.between(*K.SCREEN_RANGE), n)


def snapped_screen(size: Column) -> Column:
    """The nearest common size if near enough (the smaller of two equally near), else the size itself."""
    options = F.array(*[F.struct(F.round(F.abs(size - s), 2).alias("d"), F.lit(s).alias("s")) for s in K.SCREEN_SIZES])
    best = F.array_min(options)
    return F.when(size.isNotNull(), F.when(best["d"] <= K.SNAP_WITHIN, best["s"]).otherwise(size))


def resolution_tier(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")
    return lookup(t, {s: tier for tier, spelled in K.RESOLUTION_SPELLINGS.items() for s in spelled})


def resolution_rank(tier: Column) -> Column:
    return lookup(tier, K.RESOLUTION_RANK)


def pixels(tier: Column) -> Column:
    return lookup(tier, {t: w * h for t, (w, h) in K.RESOLUTION_PIXELS.items()})


def pixels_per_inch(tier: Column, size: Column) -> Column:
    return lookup(tier, {t: (w * w + h * h) ** 0.5 for t, (w, h) in K.RESOLUTION_PIXELS.items()}) / F.nullif(size, F.lit(0.0))


# -- processors, conditions, numbers ----------------------------------------------------------


def cpu_key(c: Column) -> Column:
    """A processor text without clock, vendor noise and punctuation; empty for NULL."""
    t = F.regexp_replace(F.lower(c), r"\s*@.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, "intel|processor|core|cpu", ""), r"[^a-z0-9]+", " ")
    return F.coalesce(F.trim(t), F.lit(""))


def model_number(c: Column) -> Column:
    """Digits and suffix of a processor's model: ``struct<number BIGINT, suffix STRING>``."""
    t = F.upper(F.regexp_replace(c, r"\s*@.*$", ""))
    n = F.nullif(F.regexp_extract(t, r"(\d{3,5})([A-Z]{0,2}\d?)\b", 1), F.lit(""))
    return F.struct(n.try_cast("bigint").alias("number"), F.when(n.isNotNull(), F.regexp_extract(t, r"(\d{3,5})([A-Z]{0,2}\d?)\b", 2)).alias("suffix"))


def generation(number: Column, lowest: int = 1, highest: int = 14) -> Column:
    """The thousands of a model number, clamped; NULL for NULL."""
    return F.when(number.isNotNull(), F.greatest(F.least(F.floor(number / 1000).cast("int"), F.lit(highest)), F.lit(lowest)))


def condition_rank(c: Column) -> Column:
    return lookup(F.upper(F.trim(c)), K.CONDITION_RANK)


def joke_number(c: Column) -> Column:
    """One digit repeated at least three times, or counting up; text that is no number is no joke."""
    n = F.abs(c.cast("string").try_cast("double"))
    d = F.when(n < 1e18, n.cast("bigint").cast("string"))
    same = (F.length(d) >= 3) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) == "")
    return F.coalesce(same | d.isin(*[str(x) for x in K.JOKE_NUMBERS]), F.lit(False))


def performance_tier(cpu: Column, gpu: Column) -> Column:
    """1 entry, 2 middle, 3 high, 0 unknown or between; higher tiers win."""
    g = F.coalesce(gpu, F.lit(0.0))
    return F.when((cpu >= 25_000) | (g >= 18_000), 3).when(cpu.between(10_000, 25_000) & g.between(4_000, 18_000), 2).when((cpu < 10_000) & (g < 4_000), 1).otherwise(0)


def first_contained(c: Column, table: dict[str, str]) -> Column:
    """The value of the first key that ``c`` contains, in the table's order."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(v)) for k, v in table.items()])


def labelled_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals (a, b]; NULL outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def search_all(c: Column, query: str) -> Column:
    """All words of the query occur in the text; hyphens count as blanks."""
    t = F.replace(F.lower(c), F.lit("-"), F.lit(" "))
    out = F.lit(True)
    for w in query.lower().replace("-", " ").split():
        out = out & t.contains(w)
    return F.coalesce(out, F.lit(False))
