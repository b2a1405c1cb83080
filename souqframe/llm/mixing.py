"""Mixing sources to target weights by hierarchical budgeting.

Weights and supplies (tokens times allowed repeats) form a tree, for instance domain - source - language. A
budget flows down by weight; a child that cannot supply its part gives the rest to its siblings, and only
what all siblings together cannot supply goes back to the level above. The upper levels carry weights, which come as
parameters, so the driver plans over as many nodes as it was given weights; the levels below take part by their supply.
Each weighted leaf takes whole seeded epochs of its documents and a token-prefix of one more. The prefix runs over its
parts (languages) side by side, by each document's place within its own part, so every part is drawn in proportion and
the leaf is rounded to whole documents once, not once per part.

Defined results: documents of a NULL or untargeted source, and empty documents, are not drawn; a node without
documents gets nothing and its share goes to its siblings; shares reached are reported for every
target and every source seen. A document whose middle token lies within the leaf's budget is taken, so a leaf
misses its budget by at most half a document. No document is used more than its source allows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.operators.running import running_sum
from souqframe.session import Workspace


@dataclass
class Node:
    weight: float | None = None
    supply: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def share_out(budget: float, weights: list[float], supplies: list[float]) -> list[float]:
    """Split a budget by weight; whoever runs dry passes its rest on to the others by their weights."""
    given = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and supplies[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        whole = sum(weights[i] for i in open_)
        dry = [i for i in open_ if left * weights[i] / whole >= supplies[i]]
        if not dry:
            for i in open_:
                given[i] = left * weights[i] / whole
            break
        for i in dry:
            given[i] = supplies[i]
        left -= sum(supplies[i] for i in dry)
        open_ = [i for i in open_ if i not in dry]
    return given


def flow(node: Node, budget: float) -> None:
    """Children without a weight of their own count by their supply."""
    node.budget = min(budget, node.supply)
    kids = list(node.children.values())
    for kid, part in zip(kids, share_out(node.budget, [k.supply if k.weight is None else k.weight for k in kids], [k.supply for k in kids]), strict=True):
        flow(kid, part)


def feasible_total(root: Node) -> float:
    """The largest budget at which every weighted node that has any supply reaches its share exactly."""
    kids = [k for k in root.children.values() if k.supply > 0 and (k.weight or 0) > 0]
    if not kids:
        return root.supply
    whole = sum(k.weight for k in kids)
    return min(feasible_total(k) * whole / k.weight for k in kids)


def nodes(root: Node, path: tuple[str, ...] = (), wanted: float | None = None) -> list[tuple[tuple[str, ...], float, float, float, float]]:
    """``path, share of its parent, wanted, supply, budget`` of every node below: what its share of its parent's wish comes to,
    and what it was given after shortages were passed on."""
    out = []
    wanted = root.budget if wanted is None else wanted
    whole = sum(k.weight or 0 for k in root.children.values())
    for name, kid in root.children.items():
        share = (kid.weight or 0) / whole if whole else 0.0
        out.append(((*path, name), share, wanted * share, kid.supply, kid.budget))
        out += nodes(kid, (*path, name), wanted * share)
    return out


def mix(sizes: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], repeats: dict[str, int], repeat_level: str, total_tokens: float | None = None, seed: int = 17, id_column: str = "doc_id", share_of_supply: float | None = None) -> tuple[DataFrame, list[tuple]]:
    """``sizes``: id, the levels, ``n_tokens``. ``weights`` by path from the root for the upper levels, all of one depth and
    their prefixes (a prefix without a weight weighs what its children with documents do); levels below count by supply.
    ``total_tokens``: what is asked for, ``share_of_supply`` the same as a share of what there is, else the most that keeps
    every share exact. -> (id, levels, n_tokens, repeats) and :func:`nodes`."""
    spark = sizes.sparkSession
    ws = Workspace(spark)
    depth = max(map(len, weights), default=1)
    upper = levels[:depth]
    assert repeat_level in upper
    base = sizes.select(id_column, *levels, "n_tokens").where("n_tokens > 0")
    for c in levels:
        base = base.where(F.col(c).isNotNull())
    targets = [(*p, w) for p, w in weights.items() if len(p) == depth and w > 0]
    wanted = F.broadcast(spark.createDataFrame(targets, ", ".join([*[f"`{c}` string" for c in upper], "_weight double"])))  # a row a parameter
    base = base.join(wanted, upper)
    root, tokens = Node(), {}
    for r in base.groupBy(*upper).agg(F.sum("n_tokens").alias("tokens")).collect():
        path = tuple(r[c] for c in upper)
        tokens[path] = r.tokens
        supply, node = float(r.tokens * repeats[r[repeat_level]]), root
        node.supply += supply
        for k in range(depth):
            fresh = path[k] not in node.children
            node = node.children.setdefault(path[k], Node(weight=weights.get(path[: k + 1], 0.0)))
            if path[: k + 1] not in weights:
                node.weight += weights[path]
            elif fresh:
                node.weight = weights[path[: k + 1]]
            node.supply += supply
    total = total_tokens if total_tokens is not None else root.supply * share_of_supply if share_of_supply is not None else feasible_total(root)
    flow(root, total)
    rows = []
    for path, n in tokens.items():
        node = root
        for p in path:
            node = node.children[p]
        most = repeats[path[upper.index(repeat_level)]]
        whole = min(int(node.budget // n), most)
        rows.append((*path, whole, 0.0 if whole == most else node.budget - whole * n))
    schema = ", ".join([*[f"`{c}` string" for c in upper], "_whole int", "_rest double"])
    plan = F.broadcast(spark.createDataFrame(rows, schema))  # at most a row a parameter
    drawn = base.drop("_weight").join(plan, upper).withColumn("_order", F.xxhash64(F.lit(seed), F.col("_whole") + 1, F.col(id_column)))
    ranked = running_sum(drawn, levels, "_order", "n_tokens", "_upto", tie=[id_column])
    parts = drawn.groupBy(*levels).agg(F.sum("n_tokens").alias("_part"))
    place = (F.col("_upto") - F.col("n_tokens") / 2) / F.col("_part")
    placed = ranked.join(parts, levels).withColumn("_place", ((place - 0.5) * 1.8e19).cast("bigint"))
    prefix = running_sum(placed, upper, "_place", "n_tokens", "_prefix", tie=[*levels, id_column])
    taken = (F.col("_prefix") - F.col("n_tokens") / 2 <= F.col("_rest")) & (F.col("_rest") > 0)
    out = prefix.withColumn("repeats", F.col("_whole") + taken.cast("int")).where("repeats > 0").select(id_column, *levels, "n_tokens", "repeats")
    return ws.stage(out, "mixture"), nodes(root)
