"""Mapping free-entered part names to a canonical list: a trie searched with a Levenshtein automaton.

A reference entry is entered in the trie under several alias paths (with and without its tier, for
instance); the search walks the trie and a lazily determinised Damerau-Levenshtein automaton of the query
together and returns *all* entries within a distance that depends on the query's length. What a value means
is then decided on those: the nearest entry if it is the only one nearest, else nothing.

Before the search a text is read into family words, a variant and a code: words near a vocabulary word
(brand, family, variant) are taken out, noise words and capacities dropped, the rest joined.

Defined results: NULL, empty and wordless texts are unmatched; ties are unmatched; repeated rows give repeated
rows. A text's case, accents of spacing and punctuation do not count. A list of more than ``ENTRIES_A_TRIE`` entries is cut
into as many tries as it takes; every query meets each of them and the nearest over all is taken, with the
same result. Queries are made distinct before the search.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.session import Workspace

UNMATCHED = "UNMATCHED"
ENTRIES_A_TRIE = 50_000


class Automaton:
    """Accepts what lies within ``k`` edits (insert, delete, replace and, with ``swaps``, exchange of neighbours) of ``word``.

    A state is the last two sparse rows of distances and the last letter; transitions are
    computed once and remembered, so the automaton turns deterministic as it is used.
    """

    def __init__(self, word: str, k: int, swaps: bool = True):
        self.word, self.k, self.swaps = word, k, swaps
        first = tuple((i, i) for i in range(min(len(word), k) + 1))
        self.states: list[tuple] = [(first, (), "")]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], int] = {}

    def step(self, state: int, letter: str) -> int:
        """The next state, -1 if nothing can be accepted any more."""
        key = (state, letter)
        to = self.moves.get(key)
        if to is None:
            to = self.moves[key] = self._move(state, letter)
        return to

    def _move(self, state: int, letter: str) -> int:
        row, before, last = self.states[state]
        word, k = self.word, self.k
        old, older = dict(row), dict(before)
        new: dict[int, int] = {}
        reach = [i for i, _ in row]
        low, high = (min(reach), max(reach) + 1) if reach else (0, -1)
        if older:
            high = max(high, max(older) + 2)
        for i in range(low, min(high, len(word)) + 1):
            d = old.get(i, k + 1) + 1
            if i:
                d = min(d, old.get(i - 1, k + 1) + (word[i - 1] != letter), new.get(i - 1, k + 1) + 1)
                if self.swaps and i > 1 and last == word[i - 1] and letter == word[i - 2]:
                    d = min(d, older.get(i - 2, k + 1) + 1)
            if d <= k:
                new[i] = d
        i = max(new, default=-1)
        while 0 <= i < len(word) and new[i] < k:  # letters of the word left out at the end of the row
            new[i + 1] = min(new.get(i + 1, k + 1), new[i] + 1)
            i += 1
        if not new:
            return -1
        made = (tuple(new.items()), row, letter)
        if made not in self.ids:
            self.ids[made] = len(self.states)
            self.states.append(made)
        return self.ids[made]

    def distance(self, state: int) -> int | None:
        return dict(self.states[state][0]).get(len(self.word))


class Trie:
    """Alias paths to entries."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]

    def add(self, path: str, entry: int) -> None:
        at = 0
        for letter in path:
            to = self.next[at].get(letter)
            if to is None:
                to = self.next[at][letter] = len(self.next)
                self.next.append({})
                self.ends.append([])
            at = to
        if entry not in self.ends[at]:
            self.ends[at].append(entry)

    def within(self, word: str, k: int, swaps: bool = True) -> dict[int, int]:
        """Every entry within ``k`` of ``word`` on any path, with its least distance."""
        auto = Automaton(word, k, swaps)
        found: dict[int, int] = {}
        stack = [(0, 0)]
        while stack:
            node, state = stack.pop()
            if self.ends[node] and (d := auto.distance(state)) is not None:
                for e in self.ends[node]:
                    if d < found.get(e, k + 1):
                        found[e] = d
            for letter, to in self.next[node].items():
                s = auto.step(state, letter)
                if s >= 0:
                    stack.append((to, s))
        return found


@dataclass(frozen=True)
class Style:
    """How the names of a list are built (fixed by the kind of list, not by its rows)."""

    entry: str  # regex with groups family, tier (may be empty), number, variant
    noise: frozenset[str]
    variants: tuple[str, ...] = ()  # words that are variants; () if the variant is part of the code
    drop: tuple[str, ...] = ()  # regexes of what is no part of a name


CPU = Style(
    entry=r"(?P<family>[a-z ]+?) (?P<tier>[0-9a-z])[- ](?P<number>\d+)(?P<variant>[a-z]+\d?)$",
    noise=frozenset("processeur proc cpu معالج nouveau gen generation eme vpro turbo octa quad dual core coeur coeurs cores thread threads boost ghz go gb ram ddr ssd".split()),
    drop=(r"@.*$", r"\b(?:boost )?\d[ .,]\d+ ?ghz\b", r"\b\d+ ?(?:eme|th|e|nd|rd) ?gen(?:eration)?\b", r"\bgen(?:eration)? ?\d+\b", r"\b\d+ ?(?:threads?|coeurs?|cores?|go|gb)\b", r"\bddr\d\b"),
)
GPU = Style(
    entry=r"(?P<family>[a-z ]+?) (?P<tier>)(?P<number>\d+)(?: (?P<variant>[a-z]+))?$",
    noise=frozenset("carte graphique graphics gpu cg كارت dédiée dediee double go gb g".split()),
    variants=("ti", "max", "super", "laptop"),
    drop=(r"\b\d{1,2} ?(?:gb|go|g)\b",),
)

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
#: Letters typed or read for digits (fixed values).
_LOOKALIKE = {"o": "0", "l": "1", "i": "1", "z": "2", "s": "5", "b": "8", "q": "9"}


@dataclass
class Matcher:
    names: list[str]
    style: Style
    codes: Trie = field(default_factory=Trie)
    numbers: Trie = field(default_factory=Trie)  # paths without variant, for codes that give none
    vocabulary: Trie = field(default_factory=Trie)
    written: Trie = field(default_factory=Trie)  # whole names, and what is left of them without their first words
    known: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())  # family words and code letters of the other tries

    def __post_init__(self) -> None:
        self.parts: list[dict[str, str] | None] = []
        self.words: list[str] = []
        letters: set[str] = set(self.known[1])
        for w in sorted(self.known[0]):
            self.vocabulary.add(w, len(self.words))
            self.words.append(w)
        for e, name in enumerate(self.names):
            m = _parsed(name, self.style)
            self.parts.append(m)
            words = re.findall(r"[^\W_]+", _plain(name))
            for i in range(len(words)):
                self.written.add("".join(words[i:]), 2 * e + (i > 0))
            if not m:
                continue
            p = m
            code = p["number"] + ("" if self.style.variants else p["variant"])
            letters |= set(code)
            lead = f"{p['variant']}:" if self.style.variants else ""
            # a path's mark: 2 e if it says all it can, 2 e + 1 if it leaves the tier out
            for tier, mark in ((p["tier"], 2 * e), ("", 2 * e + 1)):
                self.codes.add(lead + tier + code, mark)
                self.numbers.add(tier + p["number"], mark)
            for w in p["family"].split():
                if w not in self.words:
                    self.vocabulary.add(w, len(self.words))
                    self.words.append(w)
        for v in self.style.variants:
            if v not in self.words:
                self.vocabulary.add(v, len(self.words))
                self.words.append(v)
        self.letters = letters
        self.lookalike = {a: b for a, b in _LOOKALIKE.items() if a not in letters}
        self._near = lru_cache(maxsize=65536)(self._nearest_word)

    def _nearest_word(self, token: str) -> str | None:
        """The vocabulary word a token is a spelling of, if there is just one nearest."""
        k = 0 if len(token) <= 2 else 1 if len(token) <= 4 else 2
        hits = self.vocabulary.within(token, k)
        # very short words only as typed
        hits = {w: d for w, d in hits.items() if d == 0 or len(self.words[w]) >= 3}
        if not hits:
            return None
        best = min(hits.values())
        near = [w for w, d in hits.items() if d == best]
        return self.words[near[0]] if len(near) == 1 else None

    def read(self, text: str) -> tuple[set[str], str, str]:
        """Family words, variant and code of a text."""
        t = " ".join(re.sub(r"[-_/,;:()\[\]\"']", " ", text.lower()).split())
        for r in self.style.drop:
            t = re.sub(r, " ", t)
        families, variant, rest = set(), "", []
        for chunk in re.findall(r"[^\W_]+", t):
            if chunk in self.style.noise:
                continue
            tokens = _TOKEN.findall(chunk)
            kept = []
            for i, tok in enumerate(tokens):
                if tok.isdigit() or tok in self.style.noise and len(tokens) == 1:
                    kept.append(tok if tok.isdigit() else "")
                    continue
                word = self._near(tok)
                # "atomixj", "strataxyz": a word with something stuck to it
                stuck = ""
                if word is None and len(tok) > 3:
                    for cut in (1, 2):
                        if (w := self._near(tok[:-cut])) and len(w) >= 4 and (self._exactish(tok[:-cut], w)):
                            word, stuck = w, tok[-cut:]
                            break
                if word is None or (len(tok) <= 2 and not self.style.variants):
                    kept.append(tok)
                elif word in self.style.variants:
                    variant = variant or word
                else:
                    families.add(word)
                    kept.append(stuck)
            rest.append("".join(kept))
        return families, variant, "".join(rest)

    @staticmethod
    def _exactish(a: str, b: str) -> bool:
        return a == b or (len(a) >= 5 and len(set(a) ^ set(b)) <= 1)

    def reach(self, code: str) -> int:
        """The distance within which entries are returned for a code of this length."""
        n = len(code)
        if self.style.variants:
            return 0 if n <= 1 else 1
        return 0 if n <= 3 else 1 if n <= 5 else 2

    def candidates(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """entry -> (family words that contradict it, distance, tier left out?, letters read as digits?) for all entries
        within reach; of equal distances the reading with the fewest of these liberties is the nearest."""
        families, variant, code = self.read(text)
        if not any(c.isdigit() for c in code):
            return {}
        lead = f"{variant}:" if self.style.variants else ""
        found: dict[int, tuple[int, int, int]] = {}

        def note(marks: dict[int, int], more: int = 0, read_as_digits: int = 0) -> None:
            for mark, d in marks.items():
                e = mark // 2
                if not self.style.variants or self.parts[e]["variant"] == variant:
                    found[e] = min((d + more, mark % 2, read_as_digits), found.get(e, (99, 0, 0)))

        if not self.style.variants and re.fullmatch(r"[a-z]?\d+[a-z]", code) and code[-1] not in self.letters:
            code = code[:-1]  # a last letter that ends no code of the list says as little as none
        digits = "".join(self.lookalike.get(c, c) for c in code)
        k = self.reach(code)
        bare = not self.style.variants and re.fullmatch(r"[a-z]?\d+", digits) is not None
        if bare:
            note(self.numbers.within(digits, 0))
        if not found:
            note(self.codes.within(lead + code, k))
            if digits != code:
                note(self.codes.within(lead + digits, k), 0, 1)
            if bare:  # a number nearly right, and its variant left out besides
                note(self.numbers.within(digits, k), 1)
        return {e: (len(families - set(self.parts[e]["family"].split())), *d) for e, d in found.items()}

    def near_names(self, name: str, k: int | None = None, swaps: bool = True) -> dict[int, int]:
        """Entries whose name, or the end of it from some word on, is within ``k`` (by length) of ``name``, with the distance."""
        g = _glue(name)
        found: dict[int, int] = {}
        for mark, d in self.written.within(g, self.reach(g) if k is None else k, swaps).items() if g else ():
            found[mark // 2] = min(d, found.get(mark // 2, 99))
        return found

    def ranked(self, text: str | None, entered: str | None = None) -> list[tuple[tuple[int, ...], str]]:
        """What a value may mean, each with its rank; the lowest rank means it if only one entry has it.

        A name entered by hand overrides the text and counts as written, whole or from some word on: another number is
        another part, however near, so only distance 0 is taken."""
        if isinstance(entered, str) and entered.strip():
            return [((0, 0, 0, 0, 0), self.names[e]) for e in self.near_names(entered, 0)]
        if not isinstance(text, str) or not text:
            return []
        exact = {mark // 2 for mark in self.written.within(_glue(text), 0) if mark % 2 == 0}
        if len(exact) == 1:
            return [((0, 0, 0, 0, 0), self.names[e]) for e in exact]
        return [((1, *rank[1:]), self.names[e]) for e, rank in self.candidates(text).items() if not rank[0]]

    def match(self, text: str | None, entered: str | None = None) -> str:
        best = nearest(self.ranked(text, entered))
        return best[0][1] if len(best) == 1 else UNMATCHED


def nearest(ranked: list[tuple[tuple[int, ...], str]]) -> list[tuple[tuple[int, ...], str]]:
    low = min((r for r, _ in ranked), default=())
    return [(r, n) for r, n in ranked if r == low]


def _plain(name: str) -> str:
    return re.sub(r"\s*@.*$", "", name.lower())


def _parsed(name: str, style: Style) -> dict[str, str] | None:
    m = re.match(style.entry, _plain(name))
    return {k: v or "" for k, v in m.groupdict().items()} if m else None


def _glue(t: str) -> str:
    return "".join(re.findall(r"[^\W_]+", _plain(t)))


_built: dict[int, Matcher] = {}


def _matcher(names: Broadcast, style: Style) -> Matcher:
    """Built once a worker process from the list that was sent to its machine once."""
    if names.value[0] not in _built:
        _built.clear()
        _built[names.value[0]] = Matcher(names.value[1], style, known=names.value[2])
    return _built[names.value[0]]


def _known(reference: DataFrame, style: Style) -> tuple[frozenset[str], frozenset[str]]:
    """The family words and code letters of a whole list: as many as its language has, not as it has entries."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps = [p for n in b["name"] if (p := _parsed(n, style))]
            out = {(0, w) for p in ps for w in p["family"].split()} | {(1, c) for p in ps for c in p["number"] + ("" if style.variants else p["variant"])}
            yield pd.DataFrame(sorted(out), columns=["kind", "word"])

    rows = reference.mapInPandas(words, "kind int, word string").distinct().collect()
    return frozenset(r.word for r in rows if r.kind == 0), frozenset(r.word for r in rows if r.kind == 1)


def tries(reference: DataFrame, style: Style, entries_a_trie: int = ENTRIES_A_TRIE) -> list[Broadcast]:
    """The list ``name``, cut by hash into parts that one worker holds; each is sent to every machine once."""
    names = reference.select("name").where("name IS NOT NULL").distinct()
    parts = max(-(-names.count() // entries_a_trie), 1)
    known = _known(names, style) if parts > 1 else (frozenset(), frozenset())
    sc = reference.sparkSession.sparkContext
    out = []
    for k in range(parts):
        # at most about ``entries_a_trie`` names at a time
        part = sorted(r.name for r in names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect())
        out.append(sc.broadcast((uuid.uuid4().int, part, known)))
    return out


def candidates(queries: DataFrame, reference: DataFrame, style: Style, text: str, entries_a_trie: int = ENTRIES_A_TRIE, swaps: bool = True) -> DataFrame:
    """Distinct ``text`` with every entry within the length-dependent distance of it as a name: ``text, name, distance``."""
    distinct = queries.select(text).where(F.col(text).isNotNull()).distinct()
    spread = max(2 * queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out: DataFrame | None = None
    for names in tries(reference, style, entries_a_trie):

        def search(batches: Iterator[pd.DataFrame], names: Broadcast = names) -> Iterator[pd.DataFrame]:
            m = _matcher(names, style)
            for b in batches:
                yield pd.DataFrame([(t, m.names[e], d) for t in b[text] for e, d in m.near_names(t, None, swaps).items()], columns=[text, "name", "distance"])

        found = distinct.repartition(spread).mapInPandas(search, f"`{text}` string, name string, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def map_values(queries: DataFrame, reference: DataFrame | list[str], style: Style, text: str, entered: str | None = None, entries_a_trie: int = ENTRIES_A_TRIE) -> DataFrame:
    """``queries`` with ``canonical_name``: what ``text`` means, or the hand-``entered`` name, which overrides it."""
    cols = [text] + ([entered] if entered else [])
    spark = queries.sparkSession
    if isinstance(reference, list):
        reference = spark.createDataFrame([(n,) for n in reference], "name string")
    # few rows but slow ones: spread them whatever their bytes
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = queries.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(cols, ("_text", "_entered"))]).distinct()
    if not entered:
        distinct = distinct.withColumn("_entered", F.lit(None).cast("string"))
    lists = tries(reference, style, entries_a_trie)
    if len(lists) > 1:
        distinct = Workspace(spark).stage(distinct, "queries")
    every: DataFrame | None = None
    for names in lists:

        def search(batches: Iterator[pd.DataFrame], names: Broadcast = names) -> Iterator[pd.DataFrame]:
            m = _matcher(names, style)
            for b in batches:
                # two entries of equal rank are as good as all to see that none is meant
                rows = [(t, h, list(r), n) for t, h in zip(b["_text"], b["_entered"], strict=True) for r, n in (nearest(m.ranked(t, h))[:2] or [((9,), UNMATCHED)])]
                yield pd.DataFrame(rows, columns=["_text", "_entered", "rank", "name"])

        found = distinct.repartition(spread).mapInPandas(search, "_text string, _entered string, rank array<int>, name string")
        every = found if every is None else every.unionByName(found)
    best = every.groupBy("_text", "_entered").agg(F.min("rank").alias("low"), F.min_by("name", "rank").alias("name"), F.array_agg("rank").alias("ranks"))  # two rows a trie at most
    alone = F.size(F.filter("ranks", lambda r: r == F.col("low"))) == 1
    mapped = best.select("_text", "_entered", F.when(alone, F.col("name")).otherwise(F.lit(UNMATCHED)).alias("canonical_name"))
    on = queries[text].eqNullSafe(F.col("m._text"))
    if entered:
        on = on & queries[entered].eqNullSafe(F.col("m._entered"))
    kept = [queries[c] for c in queries.columns if c != "canonical_name"]  # such a column is replaced
    return queries.join(mapped.alias("m"), on, "left").select(*kept, F.col("m.canonical_name"))
