"""Splits that keep related records together.

Records are linked if they share a value of any key column (NULL links nothing). The linked sets are
found by random-mate contraction: in each round every vertex tosses a seeded coin, each "tail" with a
"head" neighbour collapses into its smallest such neighbour, edges are relabelled, and loops and
repeated edges vanish; when none are left, the rounds' collapse maps are unwound from the last to the
first. Components then go to the splits by cumulative weight.

Defined results: records without any key are components of their own; an empty table gives an empty
result; a record given twice under one id is one record. Components heavier than ``heavy`` of
all rows (at most 1/heavy of them) are dealt first: in seeded order, each to a split drawn by the shares among those that
still have room for it (the emptiest if none has), so a heavy component may land in any split. The rest fills what is
left of each share in seeded order, so a share is missed by at most half the weight of the component at its border.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqframe.operators.running import running_sum
from souqframe.session import Workspace


def vertex(*parts: Column) -> Column:
    """A 128-bit vertex name."""
    return F.unhex(F.md5(F.concat_ws("\x01", *[p.cast("string") for p in parts])))


def contract(edges: DataFrame, ws: Workspace, seed: int = 17) -> DataFrame:
    """Edges ``u, v`` (any order, repeats allowed) -> ``v, root`` for every vertex but the roots."""
    both = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    current, left_over = ws.stage_counted(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    round_no = 0
    while left_over:
        head = lambda c: (F.xxhash64(F.lit(seed + round_no), c) % 2) == 0  # noqa: B023, E731
        mates = current.select(F.explode(both).alias("e")).select("e.*").where(~head(F.col("a")) & head(F.col("b"))).groupBy("a").agg(F.min("b").alias("b"))
        mates = ws.stage(mates, f"mates{round_no}")
        maps.append(mates)
        left = current.join(mates.select(F.col("a").alias("u"), F.col("b").alias("u2")), "u", "left").select(F.coalesce("u2", "u").alias("u"), "v")
        right = left.join(mates.select(F.col("a").alias("v"), F.col("b").alias("v2")), "v", "left").select("u", F.coalesce("v2", "v").alias("v"))
        following, left_over = ws.stage_counted(right.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"edges{round_no}")
        ws.drop(current)
        current = following
        round_no += 1
    ws.drop(current)
    return unwind(maps, ws, edges)


def unwind(maps: list[DataFrame], ws: Workspace, edges: DataFrame) -> DataFrame:
    """From the last round back: a vertex takes the root of the vertex it collapsed into."""
    if not maps:
        return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).limit(0)
    labels = maps[-1].select(F.col("a").alias("v"), F.col("b").alias("root"))
    for k, m in enumerate(reversed(maps[:-1]), 1):
        later = labels.select(F.col("v").alias("b"), "root")
        own = m.join(later, "b", "left").select(F.col("a").alias("v"), F.coalesce("root", "b").alias("root"))
        labels = labels.unionByName(own)
        if k % 4 == 0:
            labels = ws.stage(labels, f"labels{k}")
    labels = ws.stage(labels, "labels")
    return labels


def components(records: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """``record_id, component`` (binary) for every record, joined through ``keys``.

    Records with equal keys are one vertex set from the start: only distinct key tuples make edges.
    """
    ws = Workspace(records.sparkSession)
    named = [F.when(k.isNotNull(), vertex(F.lit(i), k)) for i, k in enumerate(keys)]
    flat = records.select(F.col(f"`{id_column}`").alias("record_id"), *[k.alias(f"k{i}") for i, k in enumerate(named)])
    # the first key there is anchors its records, so it need not be kept beside the anchor
    places = [F.col(f"k{i}") for i in range(len(keys))]
    flat = flat.withColumn("anchor", F.coalesce(*places, vertex(F.lit("record"), F.col("record_id"))))
    flat = flat.withColumn("first", F.coalesce(*[F.when(p.isNotNull(), F.lit(i)) for i, p in enumerate(places)], F.lit(-1)))
    flat = ws.stage(flat.select("record_id", "anchor", "first", *[F.when(F.col("first") < i, F.col(f"k{i}")).alias(f"k{i}") for i in range(1, len(keys))]), "keys")
    rest = [f"k{i}" for i in range(1, len(keys))]
    tuples = ws.stage(flat.select("anchor", "first", *rest).distinct(), "tuples")
    edges = None
    for i in range(1, len(keys)):
        k = f"k{i}"
        # a value that only one tuple has links nothing; it may be another tuple's anchor
        own = tuples.where(F.col(k).isNotNull()).select(F.col("anchor").alias("u"), F.col(k).alias("v"))
        shared = own.select("v").unionByName(tuples.where(F.col("first") == i).select(F.col("anchor").alias("v"))).groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        e = own.join(shared, "v", "left_semi").select("u", "v")
        edges = e if edges is None else edges.unionByName(e)
    if edges is None:  # one key: its values are the components
        return flat.select("record_id", F.col("anchor").alias("component"))
    labels = contract(edges, ws)
    found = flat.select("record_id", "anchor").join(labels.select(F.col("v").alias("anchor"), "root"), "anchor", "left")
    return found.select("record_id", F.coalesce("root", "anchor").alias("component"))


def deal(heavy: list[tuple[bytes, int]], shares: dict[str, float], total: int, seed: int) -> dict[bytes, str]:
    """A split for each heavy component, in seeded order, by the shares among the splits with room."""
    room = {k: v * total for k, v in shares.items()}
    toss = lambda c: int.from_bytes(hashlib.md5(bytes([seed % 256]) + bytes(c)).digest()[:8]) / 2**64
    out = {}
    for c, w in sorted(heavy, key=lambda x: (toss(bytes(x[0]) + b"order"), bytes(x[0]))):
        fits = [k for k in shares if room[k] >= w] or [max(room, key=lambda k: (room[k], k))]
        at, u = 0.0, toss(c) * sum(shares[k] for k in fits)
        for k in fits:
            at += shares[k]
            if u <= at:
                break
        out[bytes(c)] = k
        room[k] -= w
    return out


def assign(weights: DataFrame, shares: dict[str, float], seed: int = 17, heavy: float = 0.001) -> DataFrame:
    """``component BINARY, weight`` -> ``component, weight, split`` by cumulative weight."""
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("t")).first().t
    whole = sum(shares.values())
    shares = {k: v / whole for k, v in shares.items()}
    # at most 1/heavy rows
    big = [(bytes(r.component), r.weight) for r in weights.where(F.col("weight") > heavy * total).collect()]
    dealt = deal(big, shares, total, seed)
    used = dict.fromkeys(shares, 0)
    for c, w in big:
        used[dealt[c]] += w
    left = {k: max(v * total - used[k], 0) for k, v in shares.items()}
    names, borders, acc, rest = list(shares), [], 0.0, max(sum(left.values()), 1e-9)
    for n in names:
        acc += left[n] / rest
        borders.append(acc)
    small = weights.where(F.col("weight") <= heavy * total)
    ranked = running_sum(small.withColumn("_order", F.xxhash64(F.lit(seed), "component")).withColumn("_all", F.lit(0)), ["_all"], "_order", "weight", "_upto", tie=["component"])
    middle = (F.col("_upto") - F.col("weight") / 2) / F.lit(max(total - sum(used.values()), 1))
    label = F.lit(names[-1])
    for n, b in reversed(list(zip(names[:-1], borders[:-1], strict=True))):
        label = F.when(middle <= b, n).otherwise(label)
    placed = ranked.select("component", "weight", label.alias("split"))
    if not big:
        return placed
    rows = [(bytearray(c), w, dealt[c]) for c, w in big]
    return placed.unionByName(weights.sparkSession.createDataFrame(rows, "component binary, weight bigint, split string"))


def grouped_split(records: DataFrame, id_column: str, keys: list[Column], shares: dict[str, float], seed: int = 17) -> DataFrame:
    """``record_id, component, split`` for every distinct record."""
    ws = Workspace(records.sparkSession)
    member = ws.stage(components(records, id_column, keys), "members")
    weights = member.groupBy("component").agg(F.count("*").alias("weight"))
    return member.join(assign(ws.stage(weights, "weights"), shares, seed), "component").select("record_id", "component", "split").distinct()
