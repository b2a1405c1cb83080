"""Classes of spellings: values that differ in case, white space, punctuation or order of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, groupby, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.functions.text import glued, word_key
from souqframe.session import Workspace

#: A table is broadcast only if it has at most so many rows and bytes; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 100_000
BROADCAST_BYTES = 8 << 20
#: Arrangements of up to so many words are listed; values of more words are compared in pairs, with the same result.
LISTED_WORDS = 6


def small(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` marked for broadcast if its measured size is within the bounds."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.octet_length(t) for t in texts), F.lit(16))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size.n <= BROADCAST_ENTRIES and size.b <= BROADCAST_BYTES else df


def _arrangements(t: str, written: list[str]) -> set[str]:
    words = t.split(" ")
    return {*written, *("".join(p) for p in permutations(words))} if len(words) <= LISTED_WORDS else set(written)


@dataclass(frozen=True)
class _Shape:
    """The words of a key, how often letters stand together within them, and what the words end and start with."""

    words: Counter[str]
    within: dict[str, int]
    ends: dict[str, int]
    starts: dict[str, int]


@lru_cache(maxsize=1024)
def _shape(t: str) -> _Shape:
    words = t.split(" ")
    within: dict[str, int] = {}
    ends: dict[str, int] = {}
    starts: dict[str, int] = {}
    for w in words:
        for k in range(len(w) - 1):
            within[w[k : k + 2]] = within.get(w[k : k + 2], 0) + 1
        ends[w[-1:]] = ends.get(w[-1:], 0) + 1
        starts[w[:1]] = starts.get(w[:1], 0) + 1
    return _Shape(Counter(words), within, ends, starts)


def _joints_fit(x: _Shape, y: _Shape) -> bool:
    """False if letters that stand together within words of ``x`` cannot all meet within or between words of ``y``."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for pair, n in x.within.items():
        more = n - y.within.get(pair, 0)
        if more > 0:
            first[pair[0]] = first.get(pair[0], 0) + more
            last[pair[1]] = last.get(pair[1], 0) + more
    return all(n <= y.ends.get(c, 0) for c, n in first.items()) and all(n <= y.starts.get(c, 0) for c, n in last.items())


def _spell_alike(x: Counter[str], y: Counter[str]) -> bool:
    """Searches for a text that the words of ``x`` spell and those of ``y`` too, word by word; remembers where it has been.

    Wherever words of both end together the rest may follow in any order, so such pieces are tried by their first word of ``x``."""
    a, b = sorted(x), sorted(y)
    fits = lambda v, w: v.startswith(w) or w.startswith(v)
    inner = [any(fits(v[k:], w) for v in b for k in range(1, len(v))) for w in a]
    todo = [(tuple(x[w] for w in a), tuple(y[w] for w in b), "", True, 0)]
    seen = set(todo)
    while todo:
        left, right, ahead, by_x, at = todo.pop()
        if not ahead and not any(left) and not any(right):
            return True
        less = lambda counts, i: (*counts[:i], counts[i] - 1, *counts[i + 1 :])
        found = []
        if not ahead:
            for i in range(at, len(a)):
                if left[i]:
                    found.append((less(left, i), right, a[i], True, i))
                    if not inner[i]:
                        break
        else:
            for i, w in enumerate(b if by_x else a):
                if (right if by_x else left)[i] and fits(ahead, w):
                    rest, turn = (ahead[len(w) :], by_x) if len(w) <= len(ahead) else (w[len(ahead) :], not by_x)
                    found.append((left, less(right, i), rest, turn, at) if by_x else (less(left, i), right, rest, turn, at))
        for state in reversed(found):
            if state not in seen:
                seen.add(state)
                todo.append(state)
    return False


def arrangeable(s: str, t: str) -> bool:
    """Whether the words of ``s`` and those of ``t``, each in some order, give the same text without white space.

    Exact for any number of words: what both have in common is tried as such first, then all words are searched."""
    a, b = _shape(s), _shape(t)
    if not s or not t or not _joints_fit(a, b) or not _joints_fit(b, a):
        return s == t
    x, y = a.words, b.words
    return _spell_alike(x - y, y - x) or _spell_alike(x, y)


def classes_of(keys: list[tuple[str, str]]) -> dict[str, str]:
    """``(word key, glued text)`` of values with the same letters -> the least word key of each key's class.

    Two keys are one class if an arrangement of their words gives the same text without white space."""
    written: dict[str, list[str]] = {}
    for t, g in keys:
        written.setdefault(t, []).append(g)
    root = {t: t for t in written}

    def find(t: str) -> str:
        while root[t] != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    seen: dict[str, str] = {}
    for t in sorted(written):
        for a in _arrangements(t, written[t]):
            x, y = find(seen.setdefault(a, t)), find(t)
            if x != y:
                root[max(x, y)] = min(x, y)
    many = {t for t in written if t.count(" ") >= LISTED_WORDS}
    for s, t in combinations(sorted(written), 2) if many else ():
        if (s in many or t in many) and (x := find(s)) != (y := find(t)) and arrangeable(s, t):
            root[max(x, y)] = min(x, y)
    return {t: find(t) for t in written}


def _name_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by ``field, letters``; a set of equal letters may go on in the next batch."""
    rows = ((f, b, t, g) for d in batches for f, b, t, g in zip(d["field"], d["letters"], d["t"], d["g"], strict=True))
    out: list[tuple[int, str, str]] = []
    for (field, _), members in groupby(rows, key=lambda r: (r[0], r[1])):
        out += [(field, t, label) for t, label in classes_of([(t, g) for _, _, t, g in members]).items() if label < t]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["field", "t", "label"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["field", "t", "label"])


def text_classes(values: DataFrame, ws: Workspace) -> DataFrame:
    """``field INT, value STRING`` (distinct) -> ``field, value, label``; equal labels are one class.

    A class is named by its smallest word key, so classes of separate inputs agree. Keys of one class have the same
    letters and digits, so only values that share those, under different keys ("AB 1" and "A B1", or anagrams),
    meet in one place to be told apart. A NULL value has no class.
    """
    t, g = word_key(F.col("value")), glued(F.col("value"))
    keyed = values.where("value IS NOT NULL").select("field", "value", t.alias("t"), g.alias("g"))
    sorted_letters = F.array_join(F.sort_array(F.split("g", "")), "")
    keyed = ws.stage(keyed.withColumn("h", F.xxhash64(sorted_letters)), "keys")
    # hashes find what may be tied (never too little); whole letters and keys decide in the next step
    key = F.xxhash64("t")
    tied = keyed.groupBy("field", "h").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high").select("field", "h")
    tied = small(ws.stage(tied, "tied"))
    suspects = keyed.join(tied, ["field", "h"], "left_semi").select("field", "t", "g", sorted_letters.alias("letters")).distinct()
    together = suspects.repartition("field", "letters").sortWithinPartitions("field", "letters")
    names = ws.stage(together.mapInPandas(_name_classes, "field int, t string, label string"), "names")
    return keyed.join(small(names, "t", "label"), ["field", "t"], "left").select("field", "value", F.coalesce("label", "t").alias("label"))
