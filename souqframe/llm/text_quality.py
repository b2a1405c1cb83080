"""Per-document text statistics from associative partial counts, and whether a text is natural prose.

Texts are cut into pieces of ``PIECE`` characters by position; a piece carries as boundary state what lies
left of it (``LEFT`` characters) and a little of what follows, so that every event (start of a word, break
between fragments, end of a line) is counted in exactly one piece, by its position. Runs that cross
pieces (the fragment and the line a piece begins or ends in) are kept open in the partial state and
closed when neighbours merge. States merge in a tree, ``FAN`` neighbours at a time.

Fragments are what breaks separate: sentence ends, commas, slashes, bars, tabs, and line ends except those of
wrapped text (a line of 40 characters or more that does not end in punctuation).

Defined results: NULL and empty texts have 0 words, NULL ratios and are not prose; every id gets
a row for each of its records; extra columns are ignored; a table without rows gives none. Words beyond
``RIGHT`` characters are counted once and never as common or repeated ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souqframe.session import Workspace

PIECE, LEFT, RIGHT, FAN = 1 << 16, 512, 80, 32
LAGS = 6

#: Rule thresholds.
MAX_REPEATED = 0.5  # share of words equal to the word 1 to 6 places back
MAX_COMMON = 0.7  # beyond it, common words without content
MAX_GARBLED = 0.02  # share of letters in wrongly decoded pairs
#: Least share of common words and least mean fragment, and the same where most lines end in punctuation.
MIN_COMMON, MIN_COMMON_ENDED, MIN_COMMON_ARABIC = 0.08, 0.03, 0.015
MIN_FRAGMENT, MIN_FRAGMENT_ENDED = 6.8, 4.9
MIN_FRAGMENT_ARABIC, MIN_FRAGMENT_ARABIC_ENDED = 4.3, 3.6
MAX_HASHES = 0.05  # hash signs per word
MAX_BULLETED = 0.5  # share of words in lines that start with a list marker
MIN_DELIMITED_FRAGMENT = 7.5  # for texts whose fragments are mostly cut by slashes

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[.!?؟;؛,،/|\t•>…]+|\n")
_RUN = re.compile(r"[.!?؟;؛,،/|\t•>…]")
_BULLET = re.compile(r"[ \t]*(?:[-*•✅✓►▪–>]|\d{1,3}[.)](?=\s)|[a-zA-Z][.)](?=\s))")
_GARBLED = re.compile("[ÂÃ][\u0080-¿]")
_ENDS = ".!?؟…;:"
_SOFT_LINE = 40

ADDED = ["chars", "letters", "digits", "symbols", "spaces", "words", "word_chars", "common", "arabic", "garbled", "hashes", "slashes", "breaks", "soft", "lines", "ended_lines", *[f"lag{k}" for k in range(1, LAGS + 1)]]
OPEN = ["frag_n", "frag_sq", "head_frag", "tail_frag", "closed", "bullet_words", "head_line", "tail_line", "tail_bullet", "has_line"]
STATE = ADDED + OPEN


def _state_type(id_type: T.DataType) -> T.StructType:
    """``doc`` numbers the records, so that a repeated id stays several records; ``id`` is what they came with."""
    head = [T.StructField("doc", T.LongType()), T.StructField("id", id_type), T.StructField("piece", T.IntegerType())]
    return T.StructType([*head, *[T.StructField(c, T.LongType()) for c in STATE]])


def piece_state(left: str, body: str, right: str, first: bool, last: bool, common: frozenset[str]) -> dict[str, int]:
    """The partial state of one piece. ``left`` is what precedes it, ``right`` what follows."""
    s = dict.fromkeys(STATE, 0)
    text, a = left + body + right, len(left)
    b = a + len(body)
    s["chars"] = len(body)
    alnum = 0
    for c, n in Counter(body).items():
        s["letters"] += n * c.isalpha()
        s["digits"] += n * c.isdigit()
        s["spaces"] += n * c.isspace()
        alnum += n * c.isalnum()
    s["symbols"] = s["chars"] - alnum - s["spaces"]
    s["hashes"] = body.count("#")
    s["garbled"] = 2 * sum(1 for m in _GARBLED.finditer(text) if a <= m.start() < b)
    starts, words = [], []
    before: list[str] = []
    for m in _WORD.finditer(text):
        if m.start() >= b:
            break
        w = m.group().lower()
        if m.start() < a:
            before.append(w)
            continue
        starts.append(m.start())
        words.append(w if len(w) < RIGHT else f"\0{m.start()}")
    # a word that began in the piece before shows its rest here; it was counted there
    s["words"] = len(words)
    s["word_chars"] = alnum
    s["common"] = sum(w in common for w in words)
    s["arabic"] = sum("؀" <= w[0] <= "ۿ" for w in words)
    chain = before[-LAGS:] + words
    at = len(chain) - len(words)
    for k in range(1, LAGS + 1):
        s[f"lag{k}"] = sum(map(eq, chain[max(at, k) :], chain[max(at, k) - k :]))
    # fragments: words between breaks
    frag, n_breaks, i = 0, 0, 0
    sq = n = 0
    head = None
    for m in _BREAK.finditer(text, a, b):
        p = m.start()
        if p == a and text[p] != "\n" and p and _RUN.match(text[p - 1]):
            continue  # the rest of a run that the piece before has counted
        if text[p] == "\n" and p >= _SOFT_LINE and "\n" not in text[p - _SOFT_LINE : p] and text[p - 1] not in _ENDS:
            s["soft"] += 1
            continue
        while i < len(starts) and starts[i] < p:
            frag, i = frag + 1, i + 1
        s["breaks"] += 1
        s["slashes"] += text[p] in "/|>"
        n_breaks += 1
        if head is None:
            head = frag
        elif frag:
            sq, n = sq + frag * frag, n + 1
        frag = 0
    tail = len(starts) - i + frag
    s.update(frag_sq=sq, frag_n=n, closed=int(n_breaks > 0), head_frag=tail if head is None else head, tail_frag=tail)
    # lines: a line's words belong to the line's start
    bullet, line_words, j = None, 0, 0
    if first:
        bullet, s["has_line"] = bool(_BULLET.match(text, a)), 1
    p = a
    while True:
        q = text.find("\n", p, b)
        end = b if q < 0 else q
        while j < len(starts) and starts[j] < end:
            line_words, j = line_words + 1, j + 1
        if q < 0:
            break
        line = text[text.rfind("\n", 0, q) + 1 : q].rstrip()
        if line:
            s["lines"] += 1
            s["ended_lines"] += line[-1] in _ENDS
        if bullet is None:
            s["head_line"] = line_words
        elif bullet:
            s["bullet_words"] += line_words
        bullet, line_words, p, s["has_line"] = bool(_BULLET.match(text, q + 1)), 0, q + 1, 1
    if last:
        line = text[text.rfind("\n", 0, b) + 1 : b].rstrip()
        if line:
            s["lines"] += 1
            s["ended_lines"] += line[-1] in _ENDS
    s["tail_line"], s["tail_bullet"] = line_words, int(bool(bullet))
    if not s["has_line"]:
        s["head_line"] = line_words
    return s


def merge_states(x: dict[str, int], y: dict[str, int]) -> dict[str, int]:
    """The state of two neighbours as one; associative."""
    s = {c: x[c] + y[c] for c in ADDED}
    n, sq = x["frag_n"] + y["frag_n"], x["frag_sq"] + y["frag_sq"]
    if x["closed"] and y["closed"]:
        middle = x["tail_frag"] + y["head_frag"]
        n, sq = n + (middle > 0), sq + middle * middle
        head, tail = x["head_frag"], y["tail_frag"]
    elif x["closed"]:
        head, tail = x["head_frag"], x["tail_frag"] + y["tail_frag"]
    elif y["closed"]:
        head, tail = x["head_frag"] + y["head_frag"], y["tail_frag"]
    else:
        head = tail = x["head_frag"] + y["head_frag"]
    s.update(frag_n=n, frag_sq=sq, head_frag=head, tail_frag=tail, closed=int(x["closed"] or y["closed"]))
    bullets = x["bullet_words"] + y["bullet_words"]
    if x["has_line"] and y["has_line"]:
        bullets += x["tail_bullet"] * (x["tail_line"] + y["head_line"])
        s.update(head_line=x["head_line"], tail_line=y["tail_line"], tail_bullet=y["tail_bullet"])
    elif x["has_line"]:
        s.update(head_line=x["head_line"], tail_line=x["tail_line"] + y["head_line"], tail_bullet=x["tail_bullet"])
    elif y["has_line"]:
        s.update(head_line=x["head_line"] + y["head_line"], tail_line=y["tail_line"], tail_bullet=y["tail_bullet"])
    else:
        s.update(head_line=x["head_line"] + y["head_line"], tail_line=0, tail_bullet=0)
    s.update(bullet_words=bullets, has_line=int(x["has_line"] or y["has_line"]))
    return s


def pieces(text: str, piece: int) -> Iterator[tuple[int, str, str, str, bool]]:
    """``number, left, body, right, last`` of each piece, every letter sliced once (and its surroundings once more)."""
    n = max(len(text), 1)
    for k, at in enumerate(range(0, n, piece)):
        yield k, text[max(at - LEFT, 0) : at], text[at : at + piece], text[at + piece : at + piece + RIGHT], at + piece >= n


def partial_states(docs: DataFrame, common_words: list[str], piece: int = PIECE, apart: int | None = None) -> DataFrame:
    """``doc BIGINT, id, text`` -> one state per document and piece.

    Texts of up to ``apart`` characters (default: 16 pieces) are cut and counted where they lie, in one pass. Pieces of longer ones
    are first dealt over the cluster, so that one huge document does not keep one task busy.
    """
    apart = 16 * piece if apart is None else apart
    words = frozenset(common_words)
    texts = docs.select("doc", "id", F.coalesce("text", F.lit("")).alias("text"))
    schema = _state_type(docs.schema["id"].dataType)
    cut_type = T.StructType([*schema.fields[:3], *[T.StructField(c, T.StringType()) for c in ("left", "body", "right")], T.StructField("last", T.BooleanType())])

    def states(keys: list[tuple], rows: list[dict[str, int]]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame(keys, columns=["doc", "id", "piece"]), pd.DataFrame(rows, columns=STATE)], axis=1)

    def count_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, rows = [], []
            for doc, own, text in zip(b["doc"], b["id"], b["text"], strict=True):
                for k, left, body, right, last in pieces(text, piece):
                    keys.append((doc, own, k))
                    rows.append(piece_state(left, body, right, k == 0, last, words))
            if keys:
                yield states(keys, rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, own, text in zip(b["doc"], b["id"], b["text"], strict=True):
                run, chars = [], 0
                for p in pieces(text, piece):
                    run.append((doc, own, *p))
                    chars += len(p[2])
                    if chars > 1 << 22 or p[4]:
                        yield pd.DataFrame(run, columns=cut_type.names)
                        run, chars = [], 0

    def count_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [piece_state(l, t, r, p == 0, e, words) for p, l, t, r, e in zip(b["piece"], b["left"], b["body"], b["right"], b["last"], strict=True)]
            yield states(list(zip(b["doc"], b["id"], b["piece"], strict=True)), rows)

    whole = texts.where(F.length("text") <= apart).mapInPandas(count_whole, schema)
    long = texts.where(F.length("text") > apart)
    chars = long.agg(F.sum(F.length("text").cast("bigint")).alias("n")).first().n
    if not chars:
        return whole
    spread = long.mapInPandas(cut, cut_type).repartition(-(-chars // (8 * piece)), "doc", "piece")
    return whole.unionByName(spread.mapInPandas(count_pieces, schema))


def _merge_group(d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("piece")
    rows = d[STATE].to_dict("records")
    head = d[["doc", "id", "piece"]].head(1).reset_index(drop=True)
    return pd.concat([head, pd.DataFrame([reduce(merge_states, rows)], columns=STATE)], axis=1)


def document_states(docs: DataFrame, common_words: list[str], piece: int = PIECE) -> DataFrame:
    """One state per document; only documents of several pieces pass through the tree."""
    ws = Workspace(docs.sparkSession)
    states = ws.stage(partial_states(docs, common_words, piece), "pieces")
    many = states.groupBy("doc").agg(F.max("piece").alias("top")).where("top > 0")
    top = many.agg(F.max("top").alias("t")).first().t
    if not top:
        return states
    single = states.join(many, "doc", "left_anti")
    tree = states.join(many.select("doc"), "doc", "left_semi")
    while top > 0:
        grouped = tree.withColumn("_g", F.floor(F.col("piece") / FAN).cast("int"))
        tree = grouped.groupBy("doc", "_g").applyInPandas(_merge_group, states.schema).withColumn("piece", F.floor(F.col("piece") / FAN).cast("int"))
        top //= FAN
    return single.unionByName(tree)


def ratios(state: DataFrame) -> DataFrame:
    """Ratios, rule outcomes and ``is_prose``."""
    n = F.col("words")

    def share(c: Column, of: Column) -> Column:
        return F.when(of > 0, c / of)

    end = (F.col("head_frag") > 0).cast("int") + F.when((F.col("closed") == 1) & (F.col("tail_frag") > 0), 1).otherwise(0)
    sq = F.col("frag_sq") + F.col("head_frag") * F.col("head_frag") + F.when(F.col("closed") == 1, F.col("tail_frag") * F.col("tail_frag")).otherwise(0)
    bullets = F.col("bullet_words") + F.when(F.col("has_line") == 1, F.col("tail_bullet") * F.col("tail_line")).otherwise(0)
    s = state.select(
        "id",
        n.alias("n_words"),
        share(F.col("word_chars"), n).alias("mean_word_length"),
        share(F.col("symbols"), F.col("chars")).alias("symbol_ratio"),
        share(F.col("ended_lines"), F.col("lines")).alias("ended_line_share"),
        share(F.col("ended_lines"), F.col("lines") - F.col("soft")).alias("ended_unwrapped_share"),
        share(F.col("hashes"), n).alias("hash_share"),
        share(F.col("common"), n).alias("common_word_share"),
        share(F.col("arabic"), n).alias("arabic_share"),
        share(F.col("garbled"), F.col("letters")).alias("garbled_share"),
        share(F.greatest(*[F.col(f"lag{k}") for k in range(1, LAGS + 1)]), n).alias("repeated_share"),
        share(sq, n).alias("mean_fragment"),
        share(F.col("slashes"), F.col("breaks")).alias("slash_share"),
        share(bullets, n).alias("bulleted_share"),
        (F.col("frag_n") + end).alias("fragments"),
    )
    arabic = F.coalesce(F.col("arabic_share") >= 0.3, F.lit(False))
    ended = F.coalesce(F.col("ended_unwrapped_share") > 0.5, F.lit(False))
    least_common = F.when(arabic, MIN_COMMON_ARABIC).when(ended, MIN_COMMON_ENDED).otherwise(MIN_COMMON)
    least_fragment = F.when(arabic & ended, MIN_FRAGMENT_ARABIC_ENDED).when(arabic, MIN_FRAGMENT_ARABIC).when(ended, MIN_FRAGMENT_ENDED).otherwise(MIN_FRAGMENT)
    rules = {
        "empty": F.col("n_words") == 0,
        "garbled": F.col("garbled_share") > MAX_GARBLED,
        "repeated": F.col("repeated_share") >= MAX_REPEATED,
        "only_common_words": F.col("common_word_share") > MAX_COMMON,
        "few_common_words": F.col("common_word_share") < least_common,
        "short_fragments": F.col("mean_fragment") < least_fragment,
        "hashtags": F.col("hash_share") > MAX_HASHES,
        "bulleted": F.col("bulleted_share") >= MAX_BULLETED,
        "delimited": (F.col("slash_share") > 0.5) & (F.col("mean_fragment") < MIN_DELIMITED_FRAGMENT),
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return s.withColumn("failed_rules", failed).withColumn("is_prose", F.size("failed_rules") == 0)


def text_quality(docs: DataFrame, common_words: list[str], id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per record: ids of any type, repeated or NULL, keep a row each."""
    named = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return ratios(document_states(named, common_words, piece)).withColumnRenamed("id", id_column)
