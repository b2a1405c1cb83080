"""Core operators against brute force, and their edge cases."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from souqframe.functions import fuzzy
from souqframe.operators import clusters, contracts, impute, outliers, ranking, rules, units
from souqframe.operators.running import running_sum
from souqframe.operators.text_classes import arrangeable, text_classes
from souqframe.session import Workspace


def test_running_sum(spark):
    random.seed(1)
    rows = [(g, random.randrange(-(1 << 63), 1 << 63), random.randrange(1, 9)) for g in ("a", "b", None) for _ in range(200)]
    got = {(r.g, r.o): r.s for r in running_sum(spark.createDataFrame(rows, "g string, o bigint, w bigint"), ["g"], "o", "w", "s").collect()}
    for g in ("a", "b", None):
        acc = 0
        for _, o, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            acc += w
            assert got[(g, o)] == acc


def test_cumulative_counts_and_bins(spark):
    random.seed(2)
    x = [random.choice([1.0, 2.0, 2.5, 7.0, 11.0]) for _ in range(300)] + [None]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    seen = [v for v in x if v is not None]
    for r in ranking.cumulative_counts(df, [], "v", slices=4).collect():
        assert r.upto == sum(v <= r.v for v in seen) and r.total == len(seen)
    assert ranking.cumulative_counts(df.limit(0), [], "v").count() == 0
    edges = sorted(set(np.quantile(seen, np.linspace(0, 1, 6))))
    for r in ranking.quantile_bins(df, "v", 5, "b").collect():
        assert r.b == (None if r.v is None else max(sum(e < r.v for e in edges) - 1, 0))


def test_text_classes(spark):
    words = ["AB C1", "ab-c1", "C1 AB", "ABC1", "a BC1", "c1ab", "X 1", "1x", "", "!!", None]
    df = spark.createDataFrame([(0, w) for w in words], "field int, value string")
    label = {r.value: r.label for r in text_classes(df, Workspace(spark)).collect()}
    assert len({label[w] for w in words[:6]}) == 1
    assert label["X 1"] == label["1x"] != label["AB C1"]
    assert label[""] == label["!!"] and None not in label
    assert text_classes(df.limit(0), Workspace(spark)).count() == 0


def test_text_classes_of_many_words(spark):
    same = [
        ["Corvane Ion 9-11715HS @ 1.30GHz", "Corvane Ion 9-11715 HS @ 1.30GHz"],
        ["one two three four five six seven8", "seven 8 one two three four five six", "six five four threetwo one seven8"],
        ["p q r s t u x1 b 2", "1 b2 x p q r s t u"],
    ]
    other = ["one two three four five six seven9", "eno two three four five six seven8", "p q r s t u x2 b 1"]
    df = spark.createDataFrame([(0, w) for ws in [*same, other] for w in ws], "field int, value string")
    label = {r.value: r.label for r in text_classes(df, Workspace(spark)).collect()}
    assert all(len({label[w] for w in ws}) == 1 for ws in same) and len(set(label.values())) == len(same) + len(other)


def test_arrangeable_is_exact():
    random.seed(8)
    cut = lambda t: " ".join(sorted("".join(p) for p in _pieces(t)))
    yes = 0
    for _ in range(1500):
        t = [random.choice("aab") for _ in range(random.randint(2, 9))]
        s, u = cut(t), cut(random.sample(t, len(t)) if random.random() < 0.7 else t)
        texts = [{"".join(p) for p in itertools.permutations(w.split(" "))} for w in (s, u)]
        assert arrangeable(s, u) == bool(texts[0] & texts[1]), (s, u)
        yes += bool(texts[0] & texts[1])
    assert 300 < yes < 1400


def _pieces(t):
    at = [0, *sorted(random.sample(range(1, len(t)), min(len(t) - 1, random.randint(0, 4)))), len(t)]
    return [t[i:j] for i, j in itertools.pairwise(at)]


def _fill(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, model string, brand string, size double, kind string, price double, value string")
    return {(r.id, r.field_name): (r.value, r.method) for r in impute.fill(df, "id", {"size": (F.col("size"), True), "kind": (F.col("kind"), False)}, F.col("model"), F.col("brand"), {"price": F.log10("price")}, {"brand": F.col("brand")}, **kw).collect()}


def test_fill_uses_the_narrowest_set(spark):
    rows = [(i, "m1", "b1", 15.6, "D4", 100.0, None) for i in range(5)] + [(i, "m2", "b1", 14.0, "D5", 900.0, None) for i in range(5, 9)]
    rows += [(20, "m1", "b1", None, None, 100.0, "x"), (21, "m3", "b1", None, "D5", 900.0, None), (22, None, None, None, None, None, None), (23, "m2", "b1", None, "D5", None, None)]
    got = _fill(spark, rows, k=2, least=1)
    assert got[(20, "size")] == ("15.6", "group_cluster") and got[(20, "kind")] == ("D4", "group_cluster")
    assert got[(21, "size")][0] == "14.0" and got[(21, "size")][1] == "parent_cluster"
    assert got[(22, "size")][1] == "all"
    assert got[(23, "size")][0] == "14.0" and got[(23, "size")][1] in ("group", "group_cluster")
    assert got[(0, "size")] == ("15.6", None)


def test_fill_edges(spark):
    assert _fill(spark, []) == {}
    nobody = _fill(spark, [(1, "m", "b", None, None, 1.0, None), (1, "m", "b", None, None, 1.0, None)])
    assert nobody[(1, "size")] == (None, None)
    tie = _fill(spark, [(1, "m", "b", 10.0, "x", 1.0, None), (2, "m", "b", 20.0, "a", 1.0, None), (3, "m", "b", None, None, 1.0, None)], k=1)
    assert tie[(3, "size")][0] == "10.0" and tie[(3, "kind")][0] == "a"


def _brute_path(costs, penalty):
    n, k = costs.shape
    return min(sum(costs[i, u] for i, u in enumerate(p)) + penalty * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(k), repeat=n))


def test_segmentation_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        costs, penalty = rng.uniform(0, 5, (7, 3)), float(rng.uniform(0, 4))
        path = units.best_path(costs, np.full(3, penalty))
        cost = sum(costs[i, u] for i, u in enumerate(path)) + penalty * sum(a != b for a, b in itertools.pairwise(path))
        assert cost == pytest.approx(_brute_path(costs, penalty))
        whole = units.transfer(costs, np.full(3, penalty))
        parts = [units.transfer(costs[:3], np.full(3, penalty)), units.transfer(costs[3:], np.full(3, penalty))]
        assert np.allclose((parts[0][:, :, None] + parts[1][None, :, :]).min(1), whole)


PRICES = {0: units.Units(("dinar", "centime", "thousand", "dirham"), (1.0, 0.01, 1e3, 13.3), 10_000.0, 1_000_000.0)}
CELLS = "series string, kind int, at bigint, id bigint, value double, told int"


def test_segments_find_level_shifts_whatever_the_chunks(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(1200):
        source, unit = f"s{i % 3}", 0
        v = float(np.clip(round(10 ** rng.normal((4.9, 5.6, 4.6)[i % 3], 0.12)), 12_000, 900_000))
        if source == "s0" and 300 <= i < 420:
            v, unit = v * 100, 1
        if source == "s1" and 600 <= i < 800:  # dear machines in dirham: bare numbers that could be dinars
            v, unit = round(v / 13.3), 3
        # half of the rows at one instant
        rows.append((source, 0, min(i, 900) * 600, i, v + i / 4096, None))
        want[i] = unit
    rows += [("s0", 0, 5, 5000, 90_000.0, 0), ("s0", 0, 5, 5001, 90.0, 2)]
    df = spark.createDataFrame(rows, CELLS)
    assert sum(10_000 <= r[4] <= 1_000_000 for r in rows if want.get(r[3]) == 3) == 67
    told = units.segment(df, PRICES)
    of = {r[4]: r[3] for r in rows}
    one = {of[r.value]: r.unit for r in told.collect()}
    cut = units.segment(df, PRICES, chunk_rows=97)
    many = {of[r.value]: r.unit for r in cut.collect()}
    assert one == many
    assert {k: (one.get(k), u) for k, u in want.items() if one.get(k) != u} == {}
    assert units.segment(df.limit(0), PRICES).count() == 0
    for t in (told, cut):
        got = sorted((r.series, r.unit, r.cells) for r in units.stretches(t).where("unit > 0").collect())
        assert got == [("s0", 1, 40), ("s1", 3, 67)]
        assert sorted((r.series, r.cells) for r in units.stretches(t, "island").where("foreign = 1").collect()) == [("s0", 40), ("s1", 67)]


def test_a_source_that_only_writes_thousands(spark):
    rng = np.random.default_rng(5)
    rows = [("a", 0, i, i, float(round(10 ** rng.normal(4.9, 0.2))), None) for i in range(300)] + [("b", 0, i, 1000 + i, float(round(10 ** rng.normal(1.9, 0.2))), None) for i in range(100)]
    got = {(r.series, r.at): r.unit for r in units.segment(spark.createDataFrame(rows, CELLS), PRICES).collect()}
    assert got == {(r[0], r[2]): 2 * (r[0] == "b") for r in rows}


def test_planted_shifts_of_stretches_match_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        costs = rng.choice([0.0, 1.0, 4.0, 9.0], (8, 3))
        starts, sums = units.runs(costs)
        assert np.allclose(sums.sum(0), costs.sum(0)) and starts[0] == 0
        enter = units.entering(3, 3.0, 0)
        total = lambda p: sum(costs[i, u] for i, u in enumerate(p)) + enter[p[0]] + sum(enter[b] for a, b in itertools.pairwise(p) if a != b)  # noqa: B023, E731
        assert total(units.best_path(costs, enter)) == pytest.approx(min(map(total, itertools.product(range(3), repeat=8))))


def test_rules(spark):
    random.seed(5)
    baskets = [sorted(random.sample("abcde", random.randint(1, 4))) for _ in range(80)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "id int, items array<string>")
    sets = rules.frequent_itemsets(df, "items", 0.1)
    want = {}
    for k in (1, 2, 3):
        for c in itertools.combinations("abcde", k):
            n = sum(set(c) <= set(b) for b in baskets)
            if n >= 8:
                want[c] = n
    assert {tuple(r["items"]): r.n for r in sets.collect()} == want
    for r in rules.rules(sets, 0.3, 0.0).collect():
        s, sa, sc = (want[tuple(sorted(x))] / 80 for x in ([*r.antecedent, *r.consequent], r.antecedent, r.consequent))
        assert r.confidence == pytest.approx(s / sa) and r.lift == pytest.approx(s / sa / sc)
    texts = spark.createDataFrame([("frozenset({'b', 'a'})",), ("{'x'}",), ("nothing",), (None,)], "x string")
    assert [r.y for r in texts.select(rules.parse_itemset(F.col("x")).alias("y")).collect()] == [["a", "b"], ["x"], [], None]


def test_itemsets_up_to_whole_baskets(spark):
    baskets = [list("abcde")] * 6 + [list("abcd")] * 2 + [["a", "x"], ["b", None], [], None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "id int, items array<string>")
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations("abcdex", k):
            n = sum(set(c) <= set(b or []) for b in baskets)
            if n >= 6:
                want[c] = n
    sets = rules.frequent_itemsets(df, "items", 0.5)
    assert {tuple(r["items"]): r.n for r in sets.collect()} == want and tuple("abcde") in want
    assert {tuple(r["items"]) for r in rules.frequent_itemsets(df, "items", 0.5, longest=3).collect()} == {c for c in want if len(c) <= 3}
    mined = rules.rules(sets, 0.7, 0.0)
    confidence = {(*r.antecedent, "->", *r.consequent): r.confidence for r in mined.collect()}
    assert confidence[("a", "b", "c", "d", "->", "e")] == pytest.approx(6 / 8)
    labels = {r.id: r.labels for r in rules.violations(df, "id", "items", mined).collect()}
    assert "a+b+c+d -> e" in labels[6] and 0 not in labels
    assert rules.frequent_itemsets(df.limit(0), "items", 0.5).count() == 0


def test_planted_outliers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 2))
    x[:4] += 12
    df = spark.createDataFrame([(i, float(a), float(b), [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id bigint, a double, b double, v array<double>")
    top = lambda d, c: {r.id for r in d.orderBy(F.desc(c), "id").limit(4).collect()}
    assert top(outliers.tail_scores(df, "id", ["a", "b"]), "score") == {0, 1, 2, 3}
    assert top(outliers.isolation_scores(df, "id", ["a", "b"], trees=50), "score") == {0, 1, 2, 3}
    assert top(outliers.local_outlier_factor(df, "id", "v", 20), "lof") == {0, 1, 2, 3}


def test_gower(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 10.0, "x"), (3, None, "y"), (4, None, None)], "id bigint, n double, c string")
    d = {(r.id, r.neighbour): r.distance for r in outliers.gower_nearest(df, df, "id", ["n"], ["c"], 3, block=2).collect()}
    want = {(1, 2): 0.5, (1, 3): 1.0, (1, 4): 1.0, (2, 3): 1.0, (2, 4): 1.0, (3, 4): 1.0}
    assert d == want | {(b, a): v for (a, b), v in want.items()}
    assert outliers.gower_nearest(df.limit(0), df, "id", ["n"], ["c"], 3).count() == 0


def _by_hand(rows, queries, widths, k):
    """Nearest by comparing all with all, rounded as SQL does."""
    out = {}
    for i, *x in queries:
        ranked = []
        for j, *y in rows:
            both = [n for n in range(len(x)) if x[n] is not None and y[n] is not None]
            num = sum((abs(x[n] - y[n]) / widths[n] if n < len(widths) else float(x[n] != y[n])) for n in both if n >= len(widths) or widths[n])
            v = (num / len(both) if both else 1.0) * 1e6
            ranked.append(((math.floor(v) + (v - math.floor(v) >= 0.5)) / 1e6, j))
        out[i] = sorted(r for r in ranked if r[1] != i)[:k]
    return out


def test_gower_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    some = lambda v, p: None if rng.random() < p else v
    # coarse values tie a lot, fine ones fall on half millionths, categories of one row have their nearest elsewhere
    table = [(i, some(float(rng.integers(0, 6)) * 100_000 + float(rng.integers(0, 3)), 0.15), some(float(rng.normal() * 50), 0.1), 7.0, some(f"c{min(int(rng.exponential(3)), 40)}", 0.1), some("xyz"[int(rng.integers(0, 3))], 0.1)) for i in range(700)]
    table += [(700, 0.0, None, None, "c0", None), (701, 1_000_000.0, None, None, "c0", None), (702, None, None, None, None, None), (703, None, None, None, None, None)]
    df = spark.createDataFrame(table, "id bigint, a double, b double, same double, c string, d string")
    ends = [[t[n] for t in table if t[n] is not None] for n in (1, 2, 3)]
    widths = [max(e) - min(e) for e in ends]
    asked = [t for t in table if t[0] % 3 == 0 or t[0] >= 700]
    strangers = [(9_000, -5_000_000.0, 0.0, None, "nobody", "x"), (9_001, 300_000.0, None, 7.0, "c1", "nothing")]  # among the queries only
    q = spark.createDataFrame(asked + strangers, df.schema)
    want = _by_hand(table, asked + strangers, widths, 5)
    for block in (4, 512):
        got = {}
        for r in outliers.gower_nearest(df, q, "id", ["a", "b", "same"], ["c", "d"], 5, block=block).orderBy("id", "place").collect():
            got.setdefault(r.id, []).append((r.distance, r.neighbour))
            assert r.place == len(got[r.id])
        assert got == want


def test_gower_rounds_halves_as_sql(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 1.0, "x"), (3, 1_000_000.0, "x")], "id bigint, n double, c string")
    assert outliers.gower_nearest(df, df.where("id = 1"), "id", ["n"], ["c"], 1).first().distance == 1e-6


def test_gower_work_grows_with_the_rows_not_their_square(spark):
    def seconds(n):
        df = spark.range(n).select("id", (F.rand(1) * 1e6).alias("a"), F.floor(F.rand(2) * 500).cast("double").alias("b"), F.floor(F.rand(3) * F.rand(4) * 20).cast("string").alias("c"))
        began = time.perf_counter()
        outliers.gower_nearest(df, df, "id", ["a", "b"], ["c"], 5).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    small = seconds(4_000)
    assert seconds(80_000) < 8 * small  # 400 times the pairs


def test_gower_queries_that_lack_a_number_search_few_boxes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    table = [(i, float(rng.integers(0, 1_000_000)), float(rng.integers(0, 200)), "xyz"[i % 3]) for i in range(6_000)]
    table += [(i, float(rng.integers(0, 1_000_000)), None, "xyz"[i % 3]) for i in range(6_000, 6_080)]
    df = spark.createDataFrame(table, "id bigint, a double, b double, c string")
    widths = [max(t[n] for t in table if t[n] is not None) - min(t[n] for t in table if t[n] is not None) for n in (1, 2)]
    kind, passes = type(df), []
    original = kind.mapInPandas

    def spy(self, f, schema, *more):
        out = original(self, f, schema, *more)
        if not schema.startswith("box bigint, own"):
            return out
        passes.append(Observation())
        return out.observe(passes[-1], F.sum(F.size("q")).alias("n"))

    monkeypatch.setattr(kind, "mapInPandas", spy)
    got = {}
    for r in outliers.gower_nearest(df, df.where("id >= 6000"), "id", ["a", "b"], ["c"], 5, block=4).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    assert got == _by_hand(table, table[6_000:], widths, 5)
    assert [p.get["n"] < 12 * 80 for p in passes] == [True, True]


def test_fuzzy_match_without_a_shared_word(spark):
    t = spark.createDataFrame([("alpha beta",), ("alphaa betaa",), ("zzz",), ("",), (None,)], "t string")
    r = spark.createDataFrame([("alpha beta",), ("gamma",), (None,)], "n string")
    got = {x.t: x.matched for x in fuzzy.best_match(t, "t", r, "n", 70.0).collect()}
    assert got == {"alpha beta": "alpha beta", "alphaa betaa": "alpha beta", "zzz": None}
    assert fuzzy.best_match(t.limit(0), "t", r, "n", 70.0).count() == 0


def test_neighbours_and_silhouette_in_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (30, 2))]
    df = spark.createDataFrame([(i, [float(a), float(b)], int(i >= 40)) for i, (a, b) in enumerate(x)], "id bigint, v array<double>, l int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in outliers.nearest_neighbours(df, "id", "v", 3, block=16).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert got == {i: set(np.argsort(d[i])[:3].tolist()) for i in range(70)}
    np.fill_diagonal(d, 0)
    a = np.array([d[i, (np.arange(70) >= 40) == (i >= 40)].sum() / ((30 if i >= 40 else 40) - 1) for i in range(70)])
    b = np.array([d[i, (np.arange(70) >= 40) != (i >= 40)].mean() for i in range(70)])
    assert clusters.silhouette(df, "id", "v", "l") == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()))
    assert clusters.silhouette(df.where("l = 0"), "id", "v", "l") is None


def test_contracts(spark):
    df = spark.createDataFrame([(5.0, "a"), (None, None), (50.0, "b")], "x double, c string")
    found = {(r.column_name, r.rule): r.violations for r in contracts.check(df, [contracts.in_range("x", 0, 10), contracts.required("x"), contracts.one_of("c", "a")]).collect()}
    assert list(found.values()) == [1, 1, 1]
    with pytest.raises(ValueError, match="no_such, other"):
        contracts.check(df, [contracts.required("other"), contracts.required("no_such")])


def test_staged_tables(spark):
    from souqframe import session

    ws = Workspace(spark)
    kept, n = ws.stage_counted(spark.range(5), "five")
    gone = ws.stage(spark.range(3), "three")
    assert n == 5 and kept.count() == 5 and ws.stage_counted(spark.range(0), "none")[1] == 0
    path = gone._staged_path.removeprefix("file://")
    ws.drop(gone, None)
    import os

    assert not os.path.exists(path) and kept._staged_path.startswith(session.shared_dir(spark))
    assert session.clean_up(spark) >= 1 and session.clean_up(spark) == 0
