"""The training-data operators against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from souqframe.llm import canonical_list as cl
from souqframe.llm import formatting_duplicates, groups_split, mixing, packing, percentiles, text_quality, tokens
from souqframe.llm.signatures import configuration
from souqframe.session import Workspace

# -- 1: splits ------------------------------------------------------------------------------------


def _brute_components(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, *keys in rows:
        find(("id", i))
        for k, v in enumerate(keys):
            if v is not None:
                root[find((k, v))] = find(("id", i))
    return {i: find(("id", i)) for i, *_ in rows}


def _groups(labels):
    g = defaultdict(set)
    for i, c in labels.items():
        g[c].add(i)
    return sorted(map(sorted, g.values()))


def test_components_match_union_find(spark):
    random.seed(1)
    rows = [(i, random.choice([None, *"abcdefghijklmnop"]), random.choice([None, *map(str, range(25))])) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string").withColumn("component", F.lit("clash"))
    got = {r.record_id: bytes(r.component) for r in groups_split.components(df, "id", [F.col("a"), F.col("b")]).collect()}
    assert _groups(got) == _groups(_brute_components(rows))


def test_long_chain_and_hub(spark):
    chain = [(i, f"k{i}", f"k{i + 1}") for i in range(40)]
    hub = [(100 + i, "hub", f"x{i}") for i in range(60)]
    df = spark.createDataFrame(chain + hub, "id bigint, a string, b string")
    long = df.select("id", F.explode(F.array("a", "b")).alias("k"))
    assert long.count() == 200
    # both columns are one kind of key here: a shared vertex name links them
    edges = df.select(groups_split.vertex(F.lit("k"), F.col("a")).alias("u"), groups_split.vertex(F.lit("k"), F.col("b")).alias("v"))
    labels = {bytes(r.v): bytes(r.root) for r in groups_split.contract(edges, Workspace(spark)).collect()}
    assert len(labels) == 40 + 60 and len(set(labels.values())) == 2


def test_split_keeps_groups_and_shares(spark):
    random.seed(2)
    rows = [(i, f"g{random.randrange(300)}" if i % 10 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = groups_split.grouped_split(df, "id", [F.col("g")], shares).collect()
    part = {r.record_id: r.split for r in got}
    of = defaultdict(set)
    for i, g in rows:
        of[g].add(part[i])
    assert len(got) == 3000 and all(len(s) == 1 for s in of.values())
    n = Counter(part.values())
    assert all(abs(n[k] / 3000 - v) < 0.02 for k, v in shares.items())
    assert {r.record_id: r.split for r in groups_split.grouped_split(df, "id", [F.col("g")], shares).collect()} == part


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, None), (2, None), (3, "x")], "id bigint, g string")
    got = {r.record_id: r.component for r in groups_split.grouped_split(df, "id", [F.col("g")], {"a": 1.0}).collect()}
    assert len(got) == 3 and len(set(map(bytes, got.values()))) == 3
    assert groups_split.grouped_split(df.limit(0), "id", [F.col("g")], {"a": 1.0}).count() == 0


def test_configurations(spark):
    same = ["8.0|256.0|0.0|32283|36358|15.6|3.0", "8|256|0|32283|36358|15.6|3", " 8.00 | 256.0 | 0.0 | 32,283 | 36358.0 | 15.60 | 3.00 "]
    gone = ["NA|256|0|1|2|nan|3", "nan|256|0|1|2||3", "|256.0|0|1|2|NA|3.0"]
    df = spark.createDataFrame([(s,) for s in [*same, *gone, None]], "s string")
    out = [r.c for r in df.select(configuration(F.col("s")).alias("c")).collect()]
    assert len(set(out[:3])) == 1 and len(set(out[3:6])) == 1 and out[0] != out[3] and out[6] is None


# -- 3: mapping -------------------------------------------------------------------------------------


def _edits(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_returns_all_within_distance():
    random.seed(3)
    words = ["".join(random.choices("ab12", k=random.randint(1, 7))) for _ in range(150)]
    trie = cl.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(150):
        q = "".join(random.choices("ab12", k=random.randint(0, 8)))
        for k in (0, 1, 2):
            assert trie.within(q, k) == {i: d for i, w in enumerate(words) if (d := _edits(q, w)) <= k}


NAMES = ["Corvane Ion 9-11715HS @ 1.30GHz", "Corvane Ion 9-11715G4 @ 1.71GHz", "Zephyra Flux 7 7190G7 @ 2.30GHz", "Pomelo Kappa 2 12435U @ 1.10GHz", "Corvane Atomix J 6490U @ 2.00GHz"]
CARDS = ["Helion VX 9760", "Helion VX 9760 Ti", "Aurex Strata 8820", "Corvane Prism 340"]


@pytest.mark.parametrize(
    ("typed", "means"),
    [
        ("corvane ion 9 l1715g4", 1), ("ion911715hs", 0), ("9 11715hs ion", 0), ("zephyra fulx 7 71 90g7", 2), ("7190g7", 2), ("2 1243u5 kaappa", 3), ("j 640uu", 4), ("proc kappa 2 12435u 8 threads", 3), ("ion 9 11715", None), ("kappa 2 12435", 3), ("ion 9 11715q", None), ("corvane", None), ("ion 9", None), ("8713zk", None), ("16go ddr4", None), ("", None), ("?", None), ("atomix j 6490u @ 2.00ghz", 4),
    ],
)
def test_processors(typed, means):
    assert cl.Matcher(NAMES, cl.CPU).match(typed) == (cl.UNMATCHED if means is None else NAMES[means])


@pytest.mark.parametrize(("typed", "means"), [("VX 9760 TI", 1), ("helion vx9760", 0), ("976o ti", 1), ("Strata8802", 2), ("PRISM34", 3), ("CG VX 9760 Max", None), ("carte graphique", None), ("16GB", None), ("Strata 9760", None), ("46556k", None)])
def test_cards(typed, means):
    assert cl.Matcher(CARDS, cl.GPU).match(typed) == (cl.UNMATCHED if means is None else CARDS[means])


def test_entered_names_override_and_edges(spark):
    rows = [(1, "ion 9 11715hs", "ion 9 11715g4", "c"), (2, "ion 9 11715hs", "Ion 9-99999ZK", "c"), (3, None, None, None), (4, "7190g7 " + "x" * 50_000, None, "c"), (5, "ion 9 11715hs", None, None), (5, "ion 9 11715hs", None, None)]
    df = spark.createDataFrame(rows, "query_id bigint, q string, hand string, canonical_name string")
    got = sorted((r.query_id, r.canonical_name) for r in cl.map_values(df, NAMES, cl.CPU, "q", "hand").collect())
    assert got == [(1, NAMES[1]), (2, cl.UNMATCHED), (3, cl.UNMATCHED), (4, cl.UNMATCHED), (5, NAMES[0]), (5, NAMES[0])]
    assert cl.map_values(df.limit(0), NAMES, cl.CPU, "q").count() == 0
    assert {r.canonical_name for r in cl.map_values(df, [], cl.CPU, "q").collect()} == {cl.UNMATCHED}


def test_a_list_in_several_tries_gives_the_same(spark):
    typed = ["corvane ion 9 l1715g4", "7190g7", "2 1243u5 kaappa", "ion 9 11715", "kappa 2 12435", "ion 9 11715q", "corvane", "atomix j 6490u", None]
    df = spark.createDataFrame([(t,) for t in typed], "q string")
    one, many = (sorted((r.q or "", r.canonical_name) for r in cl.map_values(df, NAMES, cl.CPU, "q", entries_a_trie=n).collect()) for n in (50_000, 1))
    assert one == many and dict(one)["ion 9 11715"] == cl.UNMATCHED and dict(one)["7190g7"] == NAMES[2]
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    a, b = (sorted(map(tuple, cl.candidates(df, names, cl.CPU, "q", n).collect())) for n in (50_000, 2))
    assert a == b and ("7190g7", NAMES[2], 0) in a


# -- 4: percentiles ----------------------------------------------------------------------------------


def _percentile(values, q):
    v = sorted(values)
    return v[max(int(np.ceil(q * len(v))), 1) - 1]


def test_percentiles_exact_merged_and_bounded(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), d, random.choice([random.lognormvariate(11, 1), 5000.0, None, float("nan"), -3.5, 0.0]), "x") for d in range(5) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, day int, v double, n string")
    qs = [0.01, 0.5, 0.9, 1.0]
    whole = percentiles.multi_select(percentiles.summarise(df, ["g"], "v"), ["g"], qs)
    days = percentiles.multi_select(percentiles.merge(percentiles.summarise(df, ["day", "g"], "v"), ["g"]), ["g"], qs)
    near = percentiles.multi_select(percentiles.merge(percentiles.summarise(df, ["day", "g"], "v", 0.01), ["g"]), ["g"], qs)
    want = {(g, q): _percentile([v for x, _, v, _ in rows if x == g and v is not None and v == v], q) for g in ("a", "b", None) for q in qs}
    assert {(r.g, r.quantile): r.value for r in whole.collect()} == want
    assert {(r.g, r.quantile): r.value for r in days.collect()} == want
    for r in near.collect():
        w = want[(r.g, r.quantile)]
        assert abs(r.value - w) <= 0.0101 * abs(w)


def test_percentile_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", float("inf")), ("b", 7.0), ("b", 7.0)], "g string, v double")
    got = {(r.g, r.quantile): (r.value, r.n_values) for r in percentiles.multi_select(percentiles.summarise(df, ["g"], "v"), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert got == {("b", 0.0): (7.0, 3), ("b", 0.5): (7.0, 3), ("b", 1.0): (float("inf"), 3)}
    assert percentiles.multi_select(percentiles.summarise(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


# -- 6: duplicates by formatting ---------------------------------------------------------------------


def test_copies(spark):
    rows = [
        (5, "DAILOU LEKIWING Z15", "2021 10 01T18:01:44.000Z", 1.0, None), (3, "z15-dailou-lekiwing..", "01/10/2021 18:01:44", 1.0, None), (9, "DailouLekiwingZ15", "20211001T180144Z", 1.0, None), (9, "DailouLekiwingZ15", "20211001T180144Z", 1.0, None),
        (4, "DAILOU LEKIWING Z51", "2021 10 01T18:01:44.000Z", 1.0, None), (6, "DAILOU LEKIWING Z15", "2021 10 01T18:01:45.000Z", 1.0, None), (7, "DAILOU LEKIWING Z15", "2021 10 01T18:01:44.000Z", None, None), (8, "DAILOU LEKIWING Z15", "2021 10 01T18:01:44.000Z", float("nan"), None),
        (10, None, "bad date", float("nan"), "x" * 60_000), (11, None, "Date, BAD", float("nan"), "X" * 60_000), (12, "", None, None, ""), (13, "--", None, None, " "), (14, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, model string, at string, price double, d1 string").withColumn("seen", F.monotonically_increasing_id())
    t = formatting_duplicates.encode(df, "id", ("seen",), ("at",))
    assert sorted((r.first_id, r.copy_id) for r in formatting_duplicates.copies(t).collect()) == [(3, 5), (3, 9), (10, 11), (12, 13)]
    n = {r.first_id: r.n_copies for r in formatting_duplicates.collapse(t).collect()}
    assert n == {3: 3, 4: 1, 6: 1, 7: 1, 8: 1, 10: 2, 12: 2, 14: 1}
    empty = formatting_duplicates.encode(df.limit(0), "id", ("seen",), ("at",))
    assert formatting_duplicates.copies(empty).count() == 0 and formatting_duplicates.collapse(empty).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Same Thing")).otherwise(F.concat(F.lit("t"), "id")).alias("t"))
    t = formatting_duplicates.encode(df, "id")
    assert formatting_duplicates.copies(t).count() == 999
    assert formatting_duplicates.collapse(t).agg(F.max("n_copies")).first()[0] == 1000


# -- 7: packing ---------------------------------------------------------------------------------------


def _best_fit(items, capacity):
    free = []
    for n in sorted(items, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


def test_plan_equals_best_fit_decreasing():
    random.seed(7)
    for _ in range(60):
        cap = random.randint(5, 40)
        items = [random.randint(1, cap) for _ in range(random.randint(0, 200))]
        plan, opened = packing.best_fit_plan(Counter(items), cap)
        load = Counter()
        for length, a, b, first, each in plan:
            for r in range(a, b + 1):
                load[first + (r - a) // each] += length
        assert sorted(cap - load[c] for c in range(opened)) == _best_fit(items, cap)


def test_packs(spark):
    random.seed(8)
    sizes = [random.choice([0, 1, 7, 7, 7, 50, 99, 100, 101, 350]) for _ in range(400)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(1000, None, None)], "doc_id bigint, n_tokens bigint, length string")
    packs = {"a": 100, "b": 1000}
    got = packing.pack(df, packs).collect()
    for p, cap in packs.items():
        load, seen = Counter(), Counter()
        for r in got:
            if r.pack_name == p:
                load[r.container_id] += r.piece_tokens
                seen[r.doc_id] += r.piece_tokens
                assert sizes[r.doc_id] > cap or r.piece_tokens == sizes[r.doc_id] if r.doc_id < 1000 else r.piece_tokens == 0
        assert max(load.values()) <= cap and dict(seen) == {**dict(enumerate(sizes)), 1000: 0}
        rest = [s % cap if s > cap else s for s in sizes]
        whole = sum(s // cap for s in sizes if s > cap)
        assert len([c for c, n in load.items() if n]) == whole + len(_best_fit([r for r in rest if r], cap))
    assert packing.pack(df.limit(0), packs).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")
    texts = ["the fan is quiet", "", None, "<|endoftext|>", "سعر الحاسوب " * 3000]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, "text", ["doc_id"]).collect()}
    t.encode_special_tokens = True
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


# -- 8: mixing -----------------------------------------------------------------------------------------


def test_shares_of_siblings():
    assert mixing.share_out(100, [1, 1, 2], [10, 100, 100]) == pytest.approx([10, 30, 60])
    assert mixing.share_out(100, [1, 1], [10, 20]) == [10, 20]
    assert mixing.share_out(100, [0, 1], [50, 200]) == [0, 100]


def test_siblings_before_ancestors():
    root = mixing.Node()
    for path, w, supply in ((("web", "fr"), 1, 5.0), (("web", "en"), 1, 100.0), (("books", "fr"), 1, 100.0)):
        root.supply += supply
        d = root.children.setdefault(path[0], mixing.Node(weight=1))
        d.supply += supply
        d.children[path[1]] = mixing.Node(weight=w, supply=supply)
    mixing.flow(root, 80)
    assert root.children["web"].children["en"].budget == 35 and root.children["books"].budget == 40


def test_mixture(spark):
    random.seed(9)
    rows = [(i, random.choice(["a", "a", "a", "b", "c", None]), random.choice(["fr", "en"]), random.randint(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, language string, n_tokens bigint").withColumn("repeats", F.lit("clash"))
    weights, most = {("a",): 0.5, ("b",): 0.3, ("none",): 0.2}, {"a": 1, "b": 3, "none": 5}
    drawn, _ = mixing.mix(df, ["source", "language"], weights, most, "source")
    got = drawn.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= most[r.source] for r in got)
    total = Counter()
    for r in got:
        total[r.source] += r.n_tokens * r.repeats
    share = {s: n / sum(total.values()) for s, n in total.items()}
    assert share == pytest.approx({"a": 0.625, "b": 0.375}, abs=0.005)
    again, _ = mixing.mix(df, ["source", "language"], weights, most, "source")
    assert {(r.doc_id, r.repeats) for r in again.collect()} == {(r.doc_id, r.repeats) for r in got}
    few, _ = mixing.mix(df, ["source", "language"], weights, most, "source", total_tokens=1000)
    assert few.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] == pytest.approx(1000, abs=100)
    assert mixing.mix(df.limit(0), ["source", "language"], weights, most, "source")[0].count() == 0


# -- 9: text quality -----------------------------------------------------------------------------------

COMMON = ["the", "is", "a", "to", "of", "and", "in", "la", "le", "de", "et", "est", "un", "في", "من", "هذا"]
PROSE = ["The fan is quiet and the screen is easy to clean in the evening. The price of this one is a little too high.", "le ventilateur est bruyant et la batterie de ce portable est faible alors que le prix est correct", "THE SELLER IS IN A HURRY AND THE BATTERY IS OLD, SO THE PRICE IS LOW.", "The fan is quiet and the screen is easy to clean\nin the evening of a long day, and the price is the\nonly thing that is a little too high."]
OTHER = ["", None, "- 8 GB\n- wifi 6\n- the bag\n- 512 GB", "a | b | c\n1 | 2 | 3\n4 | 5 | 6", "best price best price best price best price best price", "the of and to in a is the of and to in a is to and", "qwe rtz uio pas dfg hjk lyx cvb nmq wer tzu iop", "Home > Menu > Login > Menu > Home"]


def test_prose_or_not(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PROSE + OTHER)], "doc_id bigint, text string, words int")
    got = {r.doc_id: r.is_prose for r in text_quality.text_quality(df, COMMON).collect()}
    assert got == {i: i < len(PROSE) for i in range(len(PROSE + OTHER))}


@pytest.mark.parametrize("piece", [64, 333])
def test_pieces_merge_to_the_whole(piece):
    random.seed(10)
    words = ["the", "fan", "is", "64 GB", "wifi", "قرص", "été", "l'écran", "x" * 30]
    for _ in range(150):
        t = "".join(random.choice(words) + random.choice([" ", " ", ". ", ", ", "\n", "\n- ", " / ", "!!! ", "\n\n"]) for _ in range(random.randint(0, 120)))
        whole = text_quality.piece_state("", t, "", True, True, frozenset(COMMON))
        cut = range(0, max(len(t), 1), piece)
        parts = [text_quality.piece_state(t[max(0, a - text_quality.LEFT) : a], t[a : a + piece], t[a + piece : a + piece + text_quality.RIGHT], a == 0, a + piece >= len(t), frozenset(COMMON)) for a in cut]
        assert reduce(text_quality.merge_states, parts) == whole


def test_huge_documents_go_through_the_tree(spark):
    t = "The fan is quiet and the screen is easy to clean. " * 4000
    df = spark.createDataFrame([(1, t), (2, "x" * 100_000), (3, None), (4, "The end is in sight.")], "doc_id bigint, text string")
    a = sorted(text_quality.text_quality(df, COMMON, piece=1000).collect())
    b = sorted(text_quality.text_quality(df, COMMON, piece=1 << 20).collect())
    assert [r.doc_id for r in a] == [1, 2, 3, 4]
    assert [(r.doc_id, r.is_prose, r.n_words) for r in a if r.doc_id != 2] == [(r.doc_id, r.is_prose, r.n_words) for r in b if r.doc_id != 2]
    assert a[0] == b[0] and a[1].n_words == 1
    assert text_quality.text_quality(df.limit(0), COMMON).count() == 0


def test_cutting_is_linear_and_the_same_apart_or_not(spark):
    text = "The machine works, and the price is fair.\n- one\n" * 4000
    n = [sum(len(left) + len(body) + len(right) for _, left, body, right, _ in text_quality.pieces(text * k, 1 << 12)) for k in (1, 2, 4)]
    assert n[2] <= 2.1 * n[1] <= 4.3 * n[0]
    df = spark.createDataFrame([(1, "a", text), (2, "b", "short text"), (3, "c", None)], "doc bigint, id string, text string")
    near, far = (sorted(map(tuple, text_quality.partial_states(df, ["the"], 1 << 12, apart).collect())) for apart in (1 << 30, 0))
    assert near == far and len(near) > 40


def test_ids_of_any_type_and_repeated(spark):
    text = "The machine works, and the price is fair.\n" * 4000
    df = spark.createDataFrame([("a", text), ("a", text), (None, "short text"), ("b", "")], "doc_id string, text string")
    got = sorted(((r.doc_id or "", r.n_words) for r in text_quality.text_quality(df, ["the"], piece=1 << 12).collect()))
    assert got == [("", 2), ("a", 32_000), ("a", 32_000), ("b", 0)]
