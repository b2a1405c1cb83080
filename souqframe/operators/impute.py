"""Filling missing values from similar records, with k-prototypes clusters and a ladder of parents.

Records are clustered on their observed numeric and categorical features (k-prototypes: squared distance
on standardised numbers plus ``gamma`` per differing category; what is missing takes no part and the
distance is divided by the number of features seen). A missing cell is filled from the narrowest set that has values:

    group_cluster  same group (model) and cluster
    group          same group
    parent_cluster same parent (brand) and cluster
    cluster        same cluster
    all            all records

with the median of a numeric and the mode of a categorical target (lower median; ties take the smallest value). The part of
a group or parent in one cluster is asked only if it has ``least`` values.
Every cell that was filled carries the name of its step.

Medians and modes come from counts of distinct values per set, combined before they shuffle, so a set may hold
any share of the rows. Clusters are fitted and applied on all rows; what a fitting pass moves is one
partial sum per partition.

Defined results: a cell counts as missing if its observed column is NULL; a target nobody has stays missing with
method NULL; NULL group or parent skips its steps; an empty table stays empty; repeated rows count as often as they
occur; ids need not be unique.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souqframe.operators.ranking import weighted_quantile
from souqframe.session import Workspace

#: Rows looked at for each starting prototype.
STARTS = 32
#: The code of a missing category; what is there has the 64-bit hash of its text, however many categories there are.
SEEN_NOT = -(1 << 63)
#: Category counts a fitting task holds before it passes them on.
HELD = 1 << 18

STEPS = ("group_cluster", "group", "parent_cluster", "cluster", "all")


@dataclass(frozen=True)
class Prototypes:
    """``numbers``: k x n means in standard units; ``codes``: k x c category codes, ``SEEN_NOT`` where a cluster has none."""

    numbers: np.ndarray
    codes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    gamma: float

    def nearest(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nearest prototype of each row; -1 where no feature is seen. Ties go to the lowest."""
        z = ((x - self.mean) / self.scale).astype(np.float32)
        there = ~np.isnan(z)
        z[~there] = 0
        p = self.numbers.astype(np.float32)
        w = there.astype(np.float32)
        # sum over seen features of (z - p)^2, as three products
        d = (z * z).sum(1)[:, None] - 2 * z @ p.T + w @ (p * p).T
        seen = there.sum(1)
        for j in range(codes.shape[1]):
            c = codes[:, j]
            known = c != SEEN_NOT
            d += self.gamma * ((c[:, None] != self.codes[None, :, j]) & known[:, None])
            seen = seen + known
        d /= np.maximum(seen, 1)[:, None]
        out = d.argmin(1)
        out[seen == 0] = -1
        return out


def _arrays(b: pd.DataFrame, numbers: list[str], cats: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return b[numbers].to_numpy(dtype=float, na_value=np.nan), b[cats].to_numpy(dtype=np.int64)


def fit(rows: DataFrame, numbers: list[str], cats: list[str], k: int, passes: int, gamma: float, seed: int) -> Prototypes:
    """``cats`` hold 64-bit codes. Up to ``passes`` full passes over all rows follow the start, fewer if nothing moves any more;
    an emptied cluster keeps its prototype."""
    stats = rows.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m_{i}"] or 0.0 for i in range(len(numbers))], dtype=float)
    scale = np.array([stats[f"s_{i}"] or 1.0 for i in range(len(numbers))], dtype=float)
    # k rows far from each other among STARTS * k of lowest seeded hash, the most complete first: every task keeps its lowest
    gaps = sum((F.col(c).isNull().cast("int") for c in numbers), F.lit(0)) + sum(((F.col(c) == SEEN_NOT).cast("int") for c in cats), F.lit(0))
    start = rows.select(gaps.alias("_gaps"), F.xxhash64(F.lit(seed), "id", *numbers, *cats).alias("_h"), *numbers, *cats).orderBy("_gaps", "_h").limit(STARTS * k).toPandas().drop_duplicates([*numbers, *cats])
    if not len(start):
        return Prototypes(np.zeros((1, len(numbers))), np.full((1, len(cats)), SEEN_NOT), mean, scale, gamma)
    x, c = _arrays(start, numbers, cats)
    z = np.nan_to_num((x - mean) / scale)
    chosen, gap = [0], np.full(len(z), np.inf)
    while len(chosen) < min(k, len(z)):
        last = chosen[-1]
        gap = np.minimum(gap, ((z - z[last]) ** 2).sum(1) + gamma * (c != c[last]).sum(1))
        chosen.append(int(gap.argmax()))
    protos = Prototypes(z[chosen], c[chosen], mean, scale, gamma)
    n = len(numbers)

    for _ in range(passes):
        held = protos

        def sums(batches: Iterator[pd.DataFrame], held: Prototypes = held) -> Iterator[pd.DataFrame]:
            """Per cluster: sums and counts of each number (part 0..n-1), and counts of each category (part n..)."""
            kk = len(held.numbers)
            s, w = np.zeros((kk, n)), np.zeros((kk, n))
            counts: Counter[tuple[int, int, int]] = Counter()

            def told() -> pd.DataFrame:
                rows = [(i, n + j, code, 0.0, float(m)) for (i, j, code), m in counts.items()]
                return pd.DataFrame(rows, columns=["cluster", "part", "code", "s", "w"])

            for b in batches:
                x, c = _arrays(b, numbers, cats)
                at = held.nearest(x, c)
                ok = at >= 0
                z = (x - held.mean) / held.scale
                for j in range(n):
                    seen = ok & ~np.isnan(z[:, j])
                    s[:, j] += np.bincount(at[seen], z[seen, j], kk)
                    w[:, j] += np.bincount(at[seen], minlength=kk)
                for j in range(len(cats)):
                    seen = ok & (c[:, j] != SEEN_NOT)
                    codes, where = np.unique(c[seen, j], return_inverse=True)
                    per = np.bincount(at[seen] * len(codes) + where, minlength=kk * len(codes)) if len(codes) else np.zeros(0, int)
                    for p in np.flatnonzero(per):
                        counts[int(p // len(codes)), j, int(codes[p % len(codes)])] += int(per[p])
                if len(counts) > HELD:
                    yield told()
                    counts.clear()
            if counts:
                yield told()
            i, j = np.indices((kk, n)).reshape(2, -1)
            yield pd.DataFrame({"cluster": i, "part": j, "code": 0, "s": s.ravel(), "w": w.ravel()})

        parts = rows.select(*numbers, *cats).mapInPandas(sums, "cluster int, part int, code bigint, s double, w double")
        added = parts.groupBy("cluster", "part", "code").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
        # the sums of each number and the most frequent category: k rows a feature
        best = added.groupBy("cluster", "part").agg(F.max_by(F.struct("code", "s", "w"), F.struct("w", -F.col("code"))).alias("b")).select("cluster", "part", "b.*").collect()
        numbers_now, codes_now = protos.numbers.copy(), protos.codes.copy()
        for r in best:
            if r.w > 0 and r.part < n:
                numbers_now[r.cluster, r.part] = r.s / r.w
            elif r.w > 0:
                codes_now[r.cluster, r.part - n] = r.code
        moved = np.abs(numbers_now - protos.numbers).max(initial=0) > 1e-3 or (codes_now != protos.codes).any()
        protos = Prototypes(numbers_now, codes_now, mean, scale, gamma)
        if not moved:
            break
    return protos


def assign(rows: DataFrame, protos: Prototypes, numbers: list[str], cats: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``cluster``."""
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("cluster", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, c = _arrays(b, [f"_n{i}" for i in range(len(numbers))], [f"_c{i}" for i in range(len(cats))])
            yield b[keep].assign(cluster=protos.nearest(x, c).astype("int32"))

    src = rows.select(*keep, *[F.col(c).alias(f"_n{i}") for i, c in enumerate(numbers)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cats)])
    return src.mapInPandas(place, schema)


def category_code(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(SEEN_NOT)).otherwise(F.xxhash64(c.cast("string")))


def _pick(counts: DataFrame, by: list[str], numeric: bool, name: str) -> DataFrame:
    """Lower median or mode of ``value`` with counts ``n`` per ``by``."""
    per = counts.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    if numeric:
        return weighted_quantile(per, by, "value", "n", 0.5, name)
    # the most frequent, of equally frequent ones the smallest
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))["value"].alias(name)
    return per.groupBy(*by).agg(top) if by else per.agg(top)


def fill(df: DataFrame, id_column: str, targets: dict[str, tuple[Column, bool]], group: Column, parent: Column, numbers: dict[str, Column], cats: dict[str, Column], k: int = 12, passes: int = 5, gamma: float = 0.6, seed: int = 17, least: int = 8) -> DataFrame:
    """``id, field_name, value, filled, method`` for every record and target.

    ``targets``: field -> (observed value or NULL, numeric?). ``value`` is text; for missing cells it is the
    filled one. Numeric targets are written as DOUBLE text.
    """
    ws = Workspace(df.sparkSession)
    codes = {c: category_code(e) for c, e in cats.items()}
    number_names, cat_names = [f"n{i}" for i in range(len(numbers))], [f"c{i}" for i in range(len(cats))]
    target_names = [f"t{i}" for i in range(len(targets))]
    rows = ws.stage(
        df.select(
            F.col(f"`{id_column}`").alias("id"), group.alias("grp"), parent.alias("par"),
            *[c.cast("float").alias(a) for a, c in zip(number_names, numbers.values(), strict=True)],
            *[c.alias(a) for a, c in zip(cat_names, codes.values(), strict=True)],
            *[(c.cast("double") if numeric else c.cast("string")).alias(a) for a, (c, numeric) in zip(target_names, targets.values(), strict=True)],
        ),
        "features",
    )
    protos = fit(rows, number_names, cat_names, k, passes, gamma, seed)
    placed = ws.stage(assign(rows, protos, number_names, cat_names, ["id", "grp", "par", *target_names]), "placed")
    ws.drop(rows)
    out: DataFrame | None = None
    for (name, (_, numeric)), t in zip(targets.items(), target_names, strict=True):
        counts = ws.stage(placed.where(F.col(t).isNotNull()).groupBy("grp", "par", "cluster", F.col(t).alias("value")).agg(F.count("*").alias("n")), f"counts-{t}")
        cells = placed.where(F.col(t).isNull()).select("id", "grp", "par", "cluster")
        whole = _pick(counts, [], numeric, "v_all").first()
        filled = cells.withColumn("v_all", F.lit(whole.v_all if whole else None).cast(counts.schema["value"].dataType))
        for step, by in (("group_cluster", ["grp", "cluster"]), ("group", ["grp"]), ("parent_cluster", ["par", "cluster"]), ("cluster", ["cluster"])):
            have = counts
            for b in by:
                have = have.where(F.col(b).isNotNull())
            if "cluster" in by and len(by) > 1:  # a few values of a cluster say less than all of its group
                have = have.join(have.groupBy(*by).agg(F.sum("n").alias("_all")).where(F.col("_all") >= least).drop("_all"), by, "left_semi")
            filled = filled.join(_pick(have, by, numeric, f"v_{step}"), by, "left")
        method = F.coalesce(*[F.when(F.col(f"v_{s}").isNotNull(), F.lit(s)) for s in STEPS])
        value = F.coalesce(*[F.col(f"v_{s}") for s in STEPS]).cast("string")
        missing = filled.select("id", F.lit(name).alias("field_name"), value.alias("value"), F.lit(True).alias("filled"), method.alias("method"))
        there = placed.where(F.col(t).isNotNull()).select("id", F.lit(name).alias("field_name"), F.col(t).cast("string").alias("value"), F.lit(False).alias("filled"), F.lit(None).cast("string").alias("method"))
        both = missing.unionByName(there)
        out = both if out is None else out.unionByName(both)
    return out.withColumnRenamed("id", id_column)
