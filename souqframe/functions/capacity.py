"""Capacities and prices as typed: numbers, written units, joke prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of units, lower case (fixed values of the data).
KILO = ("kb", "ko", "k", "kilo")
MEGA = ("mb", "mo", "m", "mega", "megas", "méga", "mégas", "ميغا")
GIGA = ("gb", "go", "g", "giga", "gigas", "جيغا")
TERA = ("tb", "to", "t", "tera", "teras", "téra", "téras", "تيرا")

_QUANTITY = r"(\d+(?:[   ]\d{3})*(?:[.,]\d+)?)[   ]*([\p{L}\p{M}]*)"


def quantities(c: Column) -> Column:
    """``array<struct<n DOUBLE, unit STRING>>``: each number and its unit (kb, mb, gb, tb; '' if none is written)."""
    t = F.lower(F.translate(c, "  ", "  "))
    numbers, words = F.regexp_extract_all(t, F.lit(_QUANTITY), F.lit(1)), F.regexp_extract_all(t, F.lit(_QUANTITY), F.lit(2))

    def one(n: Column, w: Column) -> Column:
        unit = F.when(w.isin(*KILO), "kb").when(w.isin(*MEGA), "mb").when(w.isin(*GIGA), "gb").when(w.isin(*TERA), "tb").otherwise("")
        return F.struct(F.replace(F.replace(n, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias("n"), unit.alias("unit"))

    return F.filter(F.zip_with(numbers, words, one), lambda q: q["n"] > 0)


#: Words that name a unit of price, lower case without digits, blanks and punctuation (fixed values of the data).
PRICE_WORDS = {
    "dinar": ("da", "dzd", "دج", "dinar", "dinars", "دينار"),
    "centime": ("cts", "ct", "centime", "centimes", "سنتيم"),
    "thousand": ("mille", "k", "الف", "ألف"),
    "million": ("million", "millions", "m", "مليون"),
    "euro": ("€", "euro", "euros", "eur"),
    "dirham": ("mad", "dh", "dhs", "dirham", "dirhams"),
}


def dinar_unit(price: Column) -> Column:
    """The unit a price text names: dinar, centime, thousand, million (of centimes), euro, dirham; NULL if none.

    What is left of the text without digits and blanks is looked up, so no pattern is matched."""
    word = F.translate(F.lower(price), "0123456789.,'-  \t", "")
    return F.coalesce(*[F.when(word.isin(*words), F.lit(u)) for u, words in PRICE_WORDS.items()])


def joke_price(v: Column) -> Column:
    """1, one digit repeated at least three times, or at least three digits counting up from 1."""
    d = F.abs(v).cast("decimal(20,4)").cast("bigint").cast("string")
    whole = v == F.floor(v)
    same = (F.length(d) >= 3) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) == "")
    up = (F.length(d) >= 3) & F.startswith(F.lit("123456789"), d)
    return whole & ((v == 1) | same | up)
