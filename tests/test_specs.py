"""Golden cases of the expressions that read typed specifications."""

import pytest
from pyspark.sql import functions as F

from souqframe.functions import capacity, dates, fuzzy, specs
from souqframe.functions.listing import memory_type, real_screen
from souqframe.functions.scale import rescaled
from souqframe.functions.text import glued, word_key


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_jokes(spark):
    yes = ["111", "999", "4444", "111111", "999999", "22222", "123", "1234", "12345", "123456", "12345678"]
    no = ["95000", "120000", "45500", "1250000", "11", None, "NaN", "", "abc"]
    assert values(spark, yes + no, specs.joke_number(F.col("x"))) == [True] * len(yes) + [False] * len(no)


def test_binary_capacity(spark):
    cases = {"16GB": 16, "8 GB": 8, "512MB": 0.5, "32": 32, "1TB": 1024, "2TB": 2048, "256GB+1TB": 1280, "": 0, None: 0}
    assert values(spark, list(cases), specs.capacity_gb_binary(F.col("x"))) == list(cases.values())


def test_capacity(spark):
    cases = {"256GB+1TB": 1256, "256GB/512GB": 256, "1TB 128GB": 1000, "512MB": 0.5, "512": 512, None: 0, "": 0, "abc": 0}
    assert values(spark, list(cases), specs.capacity_gb(F.col("x"))) == list(cases.values())


def test_memory_and_storage_sizes(spark):
    assert values(spark, ["4GB", "8GB", "16 GB", "32gb", "128GB", "256GB", None], specs.is_memory_size(F.col("x"))) == [True] * 5 + [False] * 2
    assert values(spark, ["256GB", "512GB", "1TB", "256GB+1TB", "128GB", None], specs.is_storage_size(F.col("x"))) == [True] * 4 + [False] * 2


def test_swaps(spark):
    cases = [(("512GB", "16GB"), True), (("16GB", "512GB"), False), (("", "16GB"), True), (("16GB", ""), False), (("256GB", "512GB"), False), ((None, None), False)]
    assert values(spark, [c for c, _ in cases], specs.cells_swapped(F.col("a"), F.col("b")), "a string, b string") == [e for _, e in cases]


def test_storage_labels_and_pairs(spark):
    assert values(spark, ["1TB", "256", "1TB 512GB", "512GB", None], specs.storage_label(F.col("x"))) == ["1000GB", "256GB", "1000GB", "512GB", None]
    assert values(spark, ["1TB+240GB", "1TB"], specs.drive_pair(F.col("x"))[0]) == ["1TB", "1TB"]
    assert values(spark, ["1TB+240GB", "1TB"], specs.drive_pair(F.col("x"))[1]) == ["240GB", None]


def test_screens(spark):
    assert values(spark, ["15,6", '14"', "3.5", "27", "0", "abc", None], specs.screen_size(F.col("x"))) == [15.6, 14.0, None, None, None, None, None]
    assert values(spark, [15.5, 13.4, 18.4, None], specs.snapped_screen(F.col("x")), "x double") == [15.6, 13.3, 18.4, None]
    assert values(spark, ["1920 x 1200", "FullHD", "991x123", None], specs.resolution_tier(F.col("x"))) == ["WUXGA", "FHD", None, None]


def test_processors(spark):
    assert values(spark, ["Intel Core i5-1135G7 @ 2.40GHz", "11TH GEN INTEL CORE I5 1135G7", "", None], specs.cpu_key(F.col("x"))) == ["i5 1135g7", "11th gen i5 1135g7", "", ""]


@pytest.mark.parametrize(
    ("raw", "expected", "value", "method", "ambiguous"),
    [
        (95_000.0, None, 95_000, "unchanged", False), (75.0, None, 75_000, "price_only", False), (9.5e6, None, 950_000, "price_only", False), (9.5e6, 900_000.0, 950_000, "price_only", False),
        (9.5e6, 20_000.0, 95_000, "component", True), (6e6, 55_000.0, 60_000, "component", True), (6e6, None, 600_000, "price_only", False), (1e-30, None, 1e-30, "unresolved", False), (0.0, None, 0, "unresolved", False), (-5.0, None, -5, "unresolved", False), (None, None, None, "unresolved", False),
    ],
)
def test_decimal_scale(spark, raw, expected, value, method, ambiguous):
    r = values(spark, [(raw, expected)], rescaled(F.col("a"), 1e4, 1e6, F.col("b")), "a double, b double")[0]
    assert (r.method, r.ambiguous) == (method, ambiguous)
    assert r.value == pytest.approx(value) if value is not None else r.value is None


def test_text_keys(spark):
    same = ["DAILOU LEKIWING Z15", "z15-dailou-lekiwing..", "Lekiwing Z15 (DAILOU)", "[dailou] LEKIWING Z15", "DAILOU / LEKIWING / Z15", "Dailou\tLekiwing\tZ15"]
    assert len(set(values(spark, same, word_key(F.col("x"))))) == 1
    assert values(spark, ["Dailou Lekiwing Z15!!", "DailouLekiwingZ15", None], glued(F.col("x"))) == ["dailoulekiwingz15"] * 2 + [None]


def test_instants(spark):
    same = ["2021 10 01T18:01:44.000Z", "2021-10-01T18:01:44.000Z", "2021-10-01 18:01:44+00:00", "2021/10/01 18:01:44", "18:01:44 2021.10.01", "01/10/2021 18:01:44", " 2021 10 01t18:01:44.000z ", "20211001T180144Z", "2021-10-01 19:01:44+01:00"]
    assert len(set(values(spark, same, F.unix_seconds(dates.instant(F.col("x")))))) == 1
    assert values(spark, ["0000 00 00T00:00:00.000Z", "2025 20 29T13:53:16.000Z", "il y a quelques jours", "", None], dates.instant(F.col("x"))) == [None] * 5


def test_written_units(spark):
    q = values(spark, ["8 192 MB", "256GB+1TB", "500 Go et 1 To", "0,25 To", "8 جيغا", "-", None], capacity.quantities(F.col("x")))
    plain = [None if x is None else [(y.n, y.unit) for y in x] for x in q]
    assert plain == [[(8192.0, "mb")], [(256.0, "gb"), (1.0, "tb")], [(500.0, "gb"), (1.0, "tb")], [(0.25, "tb")], [(8.0, "gb")], [], None]
    assert values(spark, ["49.500 DZD", "8250000 centimes", "1,3 millions", "98 mille", "36k", "313 €", "Dh 23380", "prix ferme 53000", None], capacity.dinar_unit(F.col("x"))) == ["dinar", "centime", "million", "thousand", "thousand", "euro", "dirham", None, None]


def test_real_values(spark):
    assert values(spark, ["DDR 3L", "lpddr-4x", "DDR4 SODIMM", "inconnu", "?", "", None, "nan"], memory_type(F.col("x"))) == ["DDR3L", "LPDDR4X", "DDR4", None, None, None, None, None]
    assert values(spark, [15.6, 0.0, -1.0, 999.0, float("nan"), None], real_screen(F.col("x")), "x double") == [15.6, None, None, None, None, None]


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("i5 1135g7", "11th gen i5 1135g7") == 100
    assert fuzzy.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert fuzzy.token_set_ratio("", "x") == 0
