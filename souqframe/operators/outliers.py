"""Outlier scores: empirical tails, isolation forest, local outlier factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souqframe.operators.ranking import cumulative_counts
from souqframe.operators.text_classes import BROADCAST_ENTRIES
from souqframe.session import Workspace


def tail_scores(df: DataFrame, id_column: str, dims: list[str]) -> DataFrame:
    """``id, left, right, auto, score``: sums over dimensions of -log of the empirical tail probabilities.

    ``auto`` takes the left tail where a dimension is skewed to the left, else the right one. Missing values add nothing.
    """
    skews = df.agg(*[F.skewness(c).alias(c) for c in dims]).first()
    out = df.select(id_column, *dims)
    for c in dims:
        t = cumulative_counts(df, [], c).select(c, (-F.log(F.col("upto") / F.col("total"))).alias(f"l_{c}"), (-F.log((F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))).alias(f"r_{c}"))
        # distinct values of a measure: broadcast only if few
        if t.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
            t = F.broadcast(t)
        out = out.join(t, c, "left")
    total = lambda names: sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    left, right = total([f"l_{c}" for c in dims]), total([f"r_{c}" for c in dims])
    auto = total([f"l_{c}" if (skews[c] or 0) < 0 else f"r_{c}" for c in dims])
    return out.select(id_column, left.alias("left"), right.alias("right"), auto.alias("auto"), F.greatest(left, right, auto).alias("score"))


# -- isolation forest ---------------------------------------------------------------------------


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return ("leaf", len(x))
    spread = np.flatnonzero(x.max(0) > x.min(0))
    j = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
    left = x[:, j] < cut
    return ("cut", j, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng))


def _rest(n: int) -> float:
    """The mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray, at: np.ndarray, depth: float, out: np.ndarray) -> None:
    if tree[0] == "leaf":
        out[at] = depth + _rest(tree[1])
        return
    left = x[at, tree[1]] < tree[2]
    _depths(tree[3], x, at[left], depth + 1, out)
    _depths(tree[4], x, at[~left], depth + 1, out)


def isolation_scores(df: DataFrame, id_column: str, dims: list[str], trees: int = 100, sample: int = 256, seed: int = 17) -> DataFrame:
    """``id, score`` in (0, 1]; higher is more isolated. Trees grow on ``sample`` rows each (a bounded sample is the
    method's own definition), every row is scored. Missing values take the dimension's median."""
    med = df.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in dims]).first()
    full = df.select(id_column, *[F.coalesce(c, F.lit(float(med[c]))).alias(c) for c in dims])
    rng = np.random.default_rng(seed)
    # a sample of its own for each tree: about 4 * sample rows by the tree's hash, of which the lowest are kept
    n = full.count()
    each = full.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "_tree", F.col(id_column), *dims))
    few = each.where(F.pmod(F.col("_h"), F.lit(1 << 20)) < F.lit(int(min(4 * sample / max(n, 1), 1.0) * (1 << 20)) + 1))
    kept = few.withColumn("_r", F.row_number().over(Window.partitionBy("_tree").orderBy(F.pmod(F.col("_h"), F.lit(1 << 20)), "_h"))).where(F.col("_r") <= sample).select("_tree", "_h", *dims).toPandas()
    groups = [g.sort_values("_h")[dims].to_numpy(dtype=float) for _, g in kept.groupby("_tree", sort=True)]
    size = min(sample, n)
    forest = [_grow(x, int(np.ceil(np.log2(max(size, 2)))), rng) for x in groups]
    norm = max(_rest(size), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b[dims].to_numpy(dtype=float)
            d = np.zeros(len(v))
            for t in forest:
                one = np.empty(len(v))
                _depths(t, v, np.arange(len(v)), 0.0, one)
                d += one
            yield pd.DataFrame({id_column: b[id_column], "score": 2.0 ** (-d / max(len(forest), 1) / norm)})

    schema = T.StructType([full.schema[id_column], T.StructField("score", T.DoubleType())])
    return full.mapInPandas(score, schema)


# -- neighbours: every row against all rows, block by block on the executors ----------------------

#: Rows of a block: a pair of blocks is one small matrix.
BLOCK = 4096


def block_pairs(queries: DataFrame, rows: DataFrame, compare, schema: T.StructType | str, block: int = BLOCK) -> DataFrame:
    """``compare(query block, row block)`` for every pair of blocks, as pandas frames, with no block larger than about ``block``.

    Both sides are cut by hash; the work is every query against every row, the memory of a task one pair of blocks."""
    nq, nr = max(-(-queries.count() // block), 1), max(-(-rows.count() // block), 1)

    def cut(df: DataFrame, n: int, m: int, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[c for c in df.columns if c in rows.columns and c in queries.columns][:1]), F.lit(n)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = cut(queries, nq, nr, "_i", "_j").groupBy("_i", "_j"), cut(rows, nr, nq, "_j", "_i").groupBy("_i", "_j")
    return left.cogroup(right).applyInPandas(compare, schema)


def _vectors(d: pd.DataFrame, vector: str) -> np.ndarray:
    return np.array(d[vector].tolist(), dtype=float).reshape(len(d), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0))


def nearest_neighbours(df: DataFrame, id_column: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """``id, neighbour, distance``: the exact ``k`` nearest others of every row; ties go to the smaller id."""
    v = df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        b = b.sort_values("id")
        d = _distances(_vectors(a, "v"), _vectors(b, "v"))
        ids = b["id"].to_numpy()
        d[a["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), at.shape[1]), "neighbour": ids[at].ravel(), "distance": np.take_along_axis(d, at, 1).ravel()})
        return out[np.isfinite(out["distance"])]

    kind = v.schema["id"].dataType.simpleString()
    pairs = block_pairs(v, v, near, f"id {kind}, neighbour {kind}, distance double", block)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # k rows a block and id
    return pairs.withColumn("place", place).where(F.col("place") <= k).select(F.col("id").alias(id_column), "neighbour", "distance")


def local_outlier_factor(df: DataFrame, id_column: str, vector: str, k: int = 35) -> DataFrame:
    """``id, lof`` by the exact ``k`` nearest neighbours (fewer if there are fewer rows). A single row has 1."""
    ws = Workspace(df.sparkSession)
    near = ws.stage(nearest_neighbours(df, id_column, vector, k).withColumnRenamed(id_column, "id"), "neighbours")
    reach = near.groupBy("id").agg(F.max("distance").alias("reach")).withColumnRenamed("id", "neighbour")
    density = near.join(reach, "neighbour").groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("distance", "reach")), F.lit(1e-10))).alias("density"))
    density = ws.stage(density, "density")
    theirs = near.join(density.select(F.col("id").alias("neighbour"), F.col("density").alias("d2")), "neighbour").groupBy("id").agg(F.avg("d2").alias("around"))
    known = density.join(theirs, "id").select("id", (F.col("around") / F.col("density")).alias("lof"))
    return df.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id")).join(known, "id", "left").select(F.col("id").alias(id_column), F.coalesce("lof", F.lit(1.0)).alias("lof"))


# -- Gower neighbours: rows in small boxes, a query meets only the boxes that can hold one of its nearest --

#: Most rows of a box, most queries that are held against all boxes together, and that ask a box together.
LEAF, ASKING, TOGETHER = 512, 256, 512
#: A box of several categories has at most a so many-th of that; boxes searched for a first bound, besides those that promise one.
MIXED, LIKELY = 16, 6
#: Most cells of a matrix of queries and boxes, most hits handed on at once, queries of a task.
CELLS, HITS, TASK = 1 << 18, 1 << 16, 8192
#: More than any distance, in millionths.
BEYOND = 1_000_001
#: A set of features that at least one query in so many sees gets boxes of its own.
COMMON = 200


def _cut(at: np.ndarray, dims: list[np.ndarray], widths: list[float | None], most: int, mixed: int) -> list[np.ndarray]:
    """Positions cut in two, at the change nearest the middle of the widest dimension, until no part has more than ``most``,
    or ``mixed`` if it has several categories, which its ends say little about.

    A dimension without a width is a category: any difference is wider than all numbers."""
    todo, out = [at], []
    while todo:
        p = todo.pop()
        if len(p) <= mixed or len(p) <= most and all(w is not None or (d[p] == d[p[0]]).all() for d, w in zip(dims, widths, strict=True)):
            out.append(p)
            continue
        ends = [(d[p].min(), d[p].max()) for d in dims]
        spans = [(2.0 if w is None else (hi - lo) / w if w > 0 else 0.0) if hi > lo else 0.0 for (lo, hi), w in zip(ends, widths, strict=True)]
        middle = len(p) // 2
        if max(spans, default=0.0) > 0:
            d = dims[int(np.argmax(spans))]
            p = p[np.argsort(d[p], kind="stable")]
            changes = np.flatnonzero(d[p[1:]] != d[p[:-1]]) + 1
            middle = int(changes[np.argmin(np.abs(changes - middle))])
        todo += [p[:middle], p[middle:]]
    return out


def _millionths(num: np.ndarray, den: np.ndarray | int) -> np.ndarray:
    """Distances rounded to six digits, halves up as SQL does, as whole millionths; 1 where nothing is seen on both sides.

    Every step up to here only grows with the differences, so bounds of them give bounds of distances that rounding can't break."""
    y = np.where(np.asarray(den) > 0, num / np.maximum(den, 1), 1.0) * 1e6
    low = np.floor(y)
    return (low + (y - low >= 0.5)).astype(np.int64)


def gower_nearest(rows: DataFrame, queries: DataFrame, id_column: str, numbers: list[str], cats: list[str], k: int, block: int = LEAF) -> DataFrame:
    """``id, neighbour, distance, place``: the ``k`` rows nearest to each query, itself left out, by the mean over features
    seen on both sides of the range-scaled difference or mismatch; 1 where nothing is seen on both sides. Distances are
    rounded to six digits, ties go to the smaller id.

    Exact, without comparing all with all. Of rows alike in all features only the ``k + 1`` smallest ids can be among anyone's
    nearest; queries alike in all features ask once. Rows that see the same features are packed in boxes of at most ``block``.
    A query first searches the box that promises the least largest distance and a few likely ones, which bounds how far its nearest can be and, among
    those as far, how large their ids; then every box whose least possible distance and smallest id are within that bound.
    Queries that lack a number which others see would meet a box for each of its values: if there are many of them,
    they have boxes of rows that are alike but for what they lack."""
    ws = Workspace(rows.sparkSession)
    kind, most, m = rows.schema[id_column].dataType.simpleString(), k + 1, len(numbers)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ends = rows.agg(*[(F.max(value(c)) - F.min(value(c))).alias(f"w{j}") for j, c in enumerate(numbers)], *[F.approx_count_distinct(value(c)).alias(f"d{j}") for j, c in enumerate(numbers)], F.count("*").alias("n")).first()
    widths = [ends[f"w{j}"] or 0.0 for j in range(m)]
    dims, scales = [*[f"n{j}" for j in range(m)], *[f"c{j}" for j in range(len(cats))]], [*widths, *[None] * len(cats)]
    # coarse numbers first, so that neighbours in this order are near in all dimensions
    coarse = sorted(range(m), key=lambda j: ends[f"d{j}"])
    keys = ["seen", *dims[m:], *[dims[j] for j in coarse]]

    def coded(df: DataFrame) -> DataFrame:
        seen = sum((F.when(s, F.lit(1 << i)).otherwise(0).cast("bigint") for i, s in enumerate([*[value(c).isNotNull() for c in numbers], *[F.col(c).isNotNull() for c in cats]])), F.lit(0).cast("bigint"))
        return df.select(F.col(id_column).alias("id"), *[F.coalesce(value(c), F.lit(0.0)).alias(f"n{j}") for j, c in enumerate(numbers)], *[F.xxhash64(c).alias(f"c{j}") for j, c in enumerate(cats)], seen.alias("seen"))

    def arrays(b: pd.DataFrame) -> list[np.ndarray]:
        return [b[c].to_numpy() for c in dims]

    def flat(values: list[np.ndarray], p) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0), *[v[p] for v in values[:m]]]), np.concatenate([np.empty(0, "int64"), *[v[p] for v in values[m:]]])

    def parts(b: pd.DataFrame, values: list[np.ndarray], size: int, mixed: int) -> Iterator[tuple[int, np.ndarray]]:
        seen = b["seen"].to_numpy()
        for s in np.unique(seen):
            for p in _cut(np.flatnonzero(seen == s), values, scales, size, mixed):
                yield int(s), p

    facts = ["box", "serves", "theirs", "n", "least", *[f"low{i}" for i in range(len(dims))], *[f"high{i}" for i in range(len(dims))]]
    kinds = ["bigint", "bigint", "bigint", "int", kind, *["double" if i < m else "bigint" for i in range(len(dims))] * 2]

    def packed(df: DataFrame, serves: int, place: int) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name = place << 52 | TaskContext.get().partitionId() << 28
            for b in batches:
                values, ids, out = arrays(b), b["id"].to_numpy(), []
                for s, p in parts(b, values, block, block // MIXED):
                    p = p[np.argsort(ids[p], kind="stable")]
                    out.append((name, serves, s, len(p), ids[p[0]], *[v[p].min() for v in values], *[v[p].max() for v in values], ids[p], *flat(values, p)))
                    name += 1
                yield pd.DataFrame(out, columns=[*facts, "ids", "xs", "cs"])

        alike = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        kept = df.repartitionByRange(*keys).withColumn("alike", alike).where(F.col("alike") <= most).drop("alike").sortWithinPartitions(*keys)
        return kept.mapInPandas(pack, ", ".join(f"{c} {t}" for c, t in zip(facts, kinds, strict=True)) + f", ids array<{kind}>, xs array<double>, cs array<bigint>")

    members, asks = ws.stage_counted(coded(queries).withColumn("q", F.min("id").over(Window.partitionBy(*keys))), "queries")
    ANY = (1 << len(dims)) - 1
    # masks that lack a number by which rows are laid out before another number
    own = [r["seen"] for r in members.groupBy("seen").count().orderBy(F.desc("count"), "seen").collect() if r["count"] * COMMON >= asks and any(not r["seen"] >> j & 1 and any(r["seen"] >> i & 1 for i in coarse[at + 1 :]) for at, j in enumerate(coarse))]
    told = coded(rows)

    def as_seen(s: int) -> DataFrame:
        return told.select("id", *[c if s >> i & 1 else F.lit(0.0 if i < m else 0).cast("double" if i < m else "bigint").alias(c) for i, c in enumerate(dims)], F.col("seen").bitwiseAND(F.lit(s).cast("bigint")).alias("seen"))

    boxes = ws.stage(packed(told, ANY, 0), "boxes")
    for at, s in enumerate(own):
        boxes = boxes.unionByName(ws.stage(packed(as_seen(s), s, at + 1), "boxes"))
    known = boxes.select(*facts).toArrow()
    known = {c: known[c].to_numpy() for c in facts}
    by_least = np.argsort(known["least"], kind="stable")
    known = {c: v[by_least] for c, v in known.items()}
    served = {}
    for s in (ANY, *own):
        at = known["serves"] == s
        served[s] = (known["box"][at], known["theirs"][at], known["n"][at].astype("int64"), known["least"][at], *[[known[f"{end}{i}"][at] for i in range(len(dims))] for end in ("low", "high")])
    del known
    held = rows.sparkSession.sparkContext.broadcast(served)

    def bounds(own: int, lows: list[np.ndarray], highs: list[np.ndarray], at, far: bool) -> np.ndarray:
        """The least, or the largest, distance of queries between ``lows`` and ``highs`` from rows of the boxes ``at``."""
        _, theirs, _, _, low, high = held.value.get(own) or held.value[ANY]
        both = theirs[at] & own
        num, den = np.zeros(np.broadcast_shapes(lows[0].shape if lows else (1,), both.shape)), np.zeros(both.shape, "int64")
        for i, w in enumerate(scales):
            s, lo, hi = (both >> i) & 1, low[i][at], high[i][at]
            den += s
            if w is None:
                num += s * ((lo != hi) | (lows[i] != highs[i]) | (lo != lows[i]) if far else (lo > highs[i]) | (hi < lows[i]))
            elif w > 0:
                num += s * (np.maximum(np.abs(hi - lows[i]), np.abs(highs[i] - lo)) if far else np.maximum(np.maximum(lo - highs[i], lows[i] - hi), 0.0)) / w
        return _millionths(num, den)

    def lowest(key: np.ndarray, n: int) -> np.ndarray:
        return np.sort(np.partition(key, n - 1, axis=1)[:, :n] if n < key.shape[1] else key, axis=1)

    def wanted(own: int, v: list[np.ndarray], reach: np.ndarray | None, last: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """Positions of queries and of boxes that they must search, with bounds of their nearest: distances and, for those as far, ids."""
        _, _, n, least, _, _ = held.value.get(own) or held.value[ANY]
        lows, highs = [x.min(keepdims=True) for x in v], [x.max(keepdims=True) for x in v]
        near = bounds(own, lows, highs, slice(None), False)
        if reach is None:
            far = bounds(own, lows, highs, slice(None), True)
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(n[order]), most)
            at = np.flatnonzero(near <= (far[order[enough]] if enough < len(order) else 1_000_000))
        else:
            at = np.flatnonzero(near <= reach.max())
        if not len(at):
            return
        nq, few = len(v[0]) if v else 0, min(most, len(at))
        for i in range(0, nq, max(CELLS // len(at), 1)):
            c = slice(i, i + max(CELLS // len(at), 1))
            one = [x[c, None] for x in v]
            if reach is None:
                # boxes by their largest distance, then by their smallest id; and some in whose midst the query is
                far = bounds(own, one, one, at, True)
                key = lowest(far * len(at) + np.arange(len(at)), few)
                box = key % len(at)
                before = np.cumsum(n[at][box], axis=1) - n[at][box]
                cap = key[:, -1] // len(at) if few == most else np.full(len(key), BEYOND)
                want = np.zeros(far.shape, bool)
                np.put_along_axis(want, box, before < most, 1)
                likely = lowest((far + bounds(own, one, one, at, False)) * len(at) + np.arange(len(at)), min(LIKELY, len(at)))
                np.put_along_axis(want, likely % len(at), True, 1)
                q, j = np.nonzero(want)
                yield q + i, at[j], cap[q], least[at[box[:, -1]]][q]
            else:
                near, end = bounds(own, one, one, at, False), reach[c, None]
                q, j = np.nonzero((near < end) | (near == end) & (least[at] <= last[c, None]))
                yield q + i, at[j], reach[c][q], last[c][q]

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each box with the queries that must search it: those for a first bound, or all within a bound that is known."""
        for b in batches:
            values, ids, out, pairs = arrays(b), b["id"].to_numpy(), [], {}
            reach, last = (b["reach"].to_numpy(), b["last"].to_numpy()) if "reach" in b else (None, None)
            for s, p in parts(b, values, ASKING, ASKING):
                for q, *x in wanted(s, [v[p] for v in values], *[None if r is None else r[p] for r in (reach, last)]):
                    pairs.setdefault(s, []).append((p[q], *x))
            for s, found in pairs.items():
                q, box, end, name = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(box, kind="stable")
                starts = np.flatnonzero(np.r_[True, box[order[1:]] != box[order[:-1]]]) if len(order) else []
                for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
                    for g in range(i, j, TOGETHER):
                        o = order[g : min(g + TOGETHER, j)]
                        out.append(((held.value.get(s) or held.value[ANY])[0][box[o[0]]], s, ids[q[o]], *flat(values, q[o]), end[o], name[o]))
            yield pd.DataFrame(out, columns=["box", "own", "q", "qx", "qc", "reach", "last"])

    def nearest(own: int, theirs: int, q: tuple, r: tuple, reach: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and row positions with their distances: of each query the ``k + 1`` nearest of the box, as far as within its bound."""
        nq, nr, ids = len(reach), len(r[2]), r[2]
        num, both = np.zeros((nq, nr)), own & theirs
        for i, w in enumerate(scales):
            if both >> i & 1 and w != 0:
                j = i if w is not None else i - m
                x, y = (part[w is None][j * size : (j + 1) * size] for part, size in ((q, nq), (r, nr)))
                if w is None and (y == y[0]).all():
                    y = y[:1]
                num += (x[:, None] != y) if w is None else np.abs(x[:, None] - y) / w
        # rounding is left to those that may be within the bound
        i, c = np.nonzero(num <= ((reach + 1) * (both.bit_count() / 1e6) + 1e-6)[:, None])
        d = _millionths(num[i, c], both.bit_count())
        within = (d < reach[i]) | (d == reach[i]) & (ids[c] <= last[i])
        i, c, d = i[within], c[within], d[within]
        if len(i) and (count := np.bincount(i)).max() > most:
            order = np.lexsort((c, d, i))
            order = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) < most]
            i, c, d = i[order], c[order], d[order]
        return i, c, d

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], hits)
        for b in batches:
            own, theirs = b["own"].to_numpy(), b["theirs"].to_numpy()
            lists = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in (b[c] for c in ("q", "qx", "qc", "xs", "cs", "ids", "reach", "last"))]
            out, n = [], 0
            for row in range(b.num_rows):
                q, qx, qc, xs, cs, ids, reach, last = (v[o[row] : o[row + 1]] for o, v in lists)
                i, c, d = nearest(int(own[row]), int(theirs[row]), (qx, qc), (xs, cs, ids), reach, last)
                out.append((q[i], d, ids[c], reach[i], last[i]))
                n += len(i)
                if n > HITS:
                    yield told(out)
                    out, n = [], 0
            if out:
                yield told(out)

    hits = ["q", "d", "neighbour", "reach", "last"]

    def found(asking: DataFrame) -> DataFrame:
        dealt = asking.repartitionByRange(max(4 * asking.sparkSession.sparkContext.defaultParallelism, -(-asks // TASK)), *keys).sortWithinPartitions(*keys)
        pairs = dealt.mapInPandas(asked, f"box bigint, own bigint, q array<{kind}>, qx array<double>, qc array<bigint>, reach array<bigint>, last array<{kind}>")
        met = pairs.join(boxes.select("box", "theirs", "ids", "xs", "cs").hint("merge"), "box").mapInArrow(search, f"q {kind}, d bigint, neighbour {kind}, reach bigint, last {kind}")
        return met.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour"))), 1, most).alias("near"), F.min(F.struct(F.col("reach").alias("d"), F.col("last").alias("neighbour"))).alias("cap"))

    asking = members.where("id = q").drop("q")
    end = F.when(F.size("near") >= most, F.least(F.col("near")[k], F.col("cap"))).otherwise(F.col("cap"))
    first = found(asking).select(F.col("q").alias("id"), end.alias("end"))
    asking = ws.stage(asking.join(first.hint("merge"), "id", "left").select(*asking.columns, F.coalesce("end.d", F.lit(BEYOND)).cast("bigint").alias("reach"), F.coalesce("end.neighbour", "id").alias("last")), "asking")
    top = found(asking)
    out = members.select("id", "q").join(top.hint("merge"), "q").select("id", F.posexplode(F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, k)).alias("place", "s"))
    return out.select(F.col("id").alias(id_column), F.col("s.neighbour").alias("neighbour"), (F.col("s.d") / 1e6).alias("distance"), (F.col("place") + 1).alias("place"))
