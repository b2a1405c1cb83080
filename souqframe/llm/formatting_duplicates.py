"""Duplicates hidden by formatting: dictionary-encode, rewrite as integer tuples, group the tuples.

Each text column gets a dictionary: every distinct value is canonicalised once, values that differ only
in case, white space, punctuation or order of words share a class, and the classes of a column are numbered 1, 2, 3 ...
without gaps (0 is NULL). A record becomes the tuple of its columns' integers in field order; numbers and instants are
integers already. Neighbouring small integers of a tuple are packed into one word as digits of a mixed-radix number,
which loses nothing because the dictionaries' sizes are known. Equal tuples are copies: a 64-bit digest only
selects the few records that may have a copy, and those are grouped by the tuples themselves.

Two spellings share a class if they have the same words in any order, or the same letters once
white space and punctuation are gone, or both share a class with a third.

Defined results: NULL agrees with NULL and NaN with NaN, but not with each other; texts without any
letter or digit agree with each other only; ``instant_columns`` agree by the instant they name,
unreadable ones as text. An empty table gives an empty result. A record whose key occurs twice
(the same ``id_column``) counts once. Columns of other types compare by value; arrays, maps and
structs compare by their JSON text, decimals and binaries by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souqframe.functions.dates import instant
from souqframe.operators.text_classes import BROADCAST_BYTES, BROADCAST_ENTRIES, small, text_classes
from souqframe.session import Workspace

#: Batches a partition gathers before it passes its distinct values on.
GATHER = 64


def distinct_values(columns: DataFrame) -> DataFrame:
    """``field INT, value STRING``: the distinct non-NULL values of text columns named ``c<field>``.

    Arrow finds the distinct values of each run of batches, column by column, in one pass over the rows.
    """
    fields = [int(c[1:]) for c in columns.columns]

    def flush(held: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        for f, parts in zip(fields, held, strict=True):
            values = pc.drop_null(pc.unique(pa.concat_arrays(parts)))
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(values), pa.int32()), values.cast(pa.string())], ["field", "value"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = [[] for _ in fields]
        n = 0
        for b in batches:
            for k, col in enumerate(b.columns):
                held[k].append(pc.unique(col))
            n += 1
            if n == GATHER:
                yield from flush(held)
                held, n = [[] for _ in fields], 0
        if n:
            yield from flush(held)

    return columns.mapInArrow(gather, "field int, value string").groupBy("field", "value").agg(F.lit(1).alias("one")).select("field", "value")


def text_dictionary(values: DataFrame, ws: Workspace, exact: tuple[int, ...] = (), bins: int = 4096) -> DataFrame:
    """``field INT, value STRING`` (distinct) -> ``field, value, id BIGINT``, staged. The ids of a field are 1..n; values of
    one class share theirs; every value of an ``exact`` field is a class of its own.

    Classes are ranked within hash slices of their field and the slices' sizes added up, so no task ranks a whole field.
    """
    named = text_classes(values.where(~F.col("field").isin(*exact)) if exact else values, ws)
    if exact:
        named = named.unionByName(values.where(F.col("field").isin(*exact)).select("field", "value", F.col("value").alias("label")))
    sliced = named.withColumn("slice", F.pmod(F.xxhash64("label"), F.lit(bins)).cast("int"))
    ranked = ws.stage(sliced.withColumn("rank", F.dense_rank().over(Window.partitionBy("field", "slice").orderBy("label"))).drop("label"), "ranked")
    sizes = ranked.groupBy("field", "slice").agg(F.max("rank").cast("bigint").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("field").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most ``bins`` rows a field
    starts = sizes.select("field", "slice", before.alias("before"))
    return ranked.join(F.broadcast(starts), ["field", "slice"]).select("field", "value", (F.col("before") + F.col("rank")).alias("id"))


def _whole(c: Column) -> Column:
    """Whether a double is a whole number that a BIGINT holds exactly; false for NULL and NaN."""
    return F.coalesce((F.abs(c) < F.lit(float(1 << 52))) & (c == F.floor(c)), F.lit(False))


def _own_integer(c: Column, kind: T.DataType) -> Column | None:
    """The BIGINT a value is already, None if it needs a dictionary. Whole doubles are that number; the 64 bits of others go
    through a 64-bit mix that is one to one, so different numbers stay different (a digit of the tuple tells the two apart)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(_whole(c), c.try_cast("bigint")).otherwise(F.xxhash64(F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return c.cast("bigint")
    return None


def _packed(digits: list[tuple[Column, int]]) -> list[Column]:
    """Words of as many neighbouring digits (a value below its size) as 62 bits hold."""
    words, word, room = [], None, 1
    for value, size in digits:
        if word is not None and room * size <= 1 << 62:
            word, room = word * F.lit(size) + value, room * size
        else:
            words += [word] if word is not None else []
            word, room = value, size
    return words + ([word] if word is not None else [])


def encode(df: DataFrame, id_column: str, exclude: tuple[str, ...] = (), instant_columns: tuple[str, ...] = ()) -> DataFrame:
    """``record_id``, the words ``w0, w1 ...`` of each record's tuple and their ``digest``, staged."""
    ws = Workspace(df.sparkSession)
    skip = {id_column, *exclude}
    fields = [f for f in df.schema.fields if f.name not in skip]
    # positional names keep clashing or odd column names out of every expression below
    plain = df.select(F.col(f"`{id_column}`").alias("record_id"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)])
    texts, exact, numbers, digits = [], [], [], []
    for i, f in enumerate(fields):
        c = F.col(f"c{i}")
        if isinstance(f.dataType, T.StringType):
            texts.append(i)
        elif (own := _own_integer(c, f.dataType)) is not None:
            numbers.append(f"c{i}")
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                plain = plain.withColumn(f"d{i}", F.when(c.isNull(), 2).when(_whole(c), 0).otherwise(1).cast("bigint"))
                digits.append((F.col(f"d{i}"), 3))
            else:
                digits.append((c.isNull().cast("bigint"), 2))
            plain = plain.withColumn(f"c{i}", own if f.nullable is False else F.when(c.isNotNull(), own))
        else:
            texts.append(i)
            exact.append(i)
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
            written = F.to_json(F.struct(c.alias("v"))) if nested else F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
            plain = plain.withColumn(f"c{i}", F.when(c.isNotNull(), written))
    for i in [i for i in texts if fields[i].name in instant_columns]:
        plain = plain.withColumn(f"t{i}", F.unix_micros(instant(F.col(f"c{i}"))))
        plain = plain.withColumn(f"c{i}", F.when(F.col(f"t{i}").isNull(), F.col(f"c{i}")))
        numbers.append(f"t{i}")
        digits.append((F.col(f"t{i}").isNull().cast("bigint"), 2))
    # numbers are words of their own; which of them are NULL (or no whole numbers) are digits like any other
    whole = [F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in numbers]
    large: list[tuple[int, int, DataFrame]] = []
    if texts:
        words = ws.stage(text_dictionary(distinct_values(plain.select(*[f"c{i}" for i in texts])), ws, tuple(exact)), "dictionary")
        sizes = {r.field: r for r in words.groupBy("field").agg(F.count("*").alias("n"), F.max("id").alias("top"), F.sum(F.octet_length("value") + 16).alias("b")).collect()}
        for i in [i for i in texts if i in sizes]:
            d = words.where(F.col("field") == i).select(F.col("value").alias(f"c{i}"), F.col("id").alias(f"i{i}"))
            if sizes[i].n > BROADCAST_ENTRIES or sizes[i].b > BROADCAST_BYTES:
                large.append((i, sizes[i].top, d))
            else:
                plain = plain.join(F.broadcast(d), f"c{i}", "left")
                digits.append((F.coalesce(F.col(f"i{i}"), F.lit(0).cast("bigint")), sizes[i].top + 1))
    # what is known is packed first, so a join with a large dictionary moves few words and the value
    out = plain.select("record_id", *[w.alias(f"w{k}") for k, w in enumerate([*whole, *_packed(digits)])], *[f"c{i}" for i, _, _ in large])
    for i, _, d in large:
        out = out.join(d, f"c{i}", "left").drop(f"c{i}")
    known = [c for c in out.columns if c.startswith("w")]
    more = _packed([(F.coalesce(F.col(f"i{i}"), F.lit(0).cast("bigint")), top + 1) for i, top, _ in large])
    out = out.select("record_id", *known, *[w.alias(f"w{len(known) + k}") for k, w in enumerate(more)])
    tuple_words = [c for c in out.columns if c != "record_id"]
    return ws.stage(out.withColumn("digest", F.xxhash64(*tuple_words)), "tuples")


def _words(tuples: DataFrame) -> list[str]:
    return [c for c in tuples.columns if c not in ("record_id", "digest")]


def _suspects(tuples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests with one id (``digest, first_id``), and the records of the others."""
    per = tuples.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
    several = small(Workspace(tuples.sparkSession).stage(per.where("first_id < last_id").select("digest"), "suspects"))
    return per.where("first_id = last_id").select("digest", "first_id"), tuples.join(several, "digest", "left_semi")


def collapse(tuples: DataFrame) -> DataFrame:
    """One row per distinct record: ``first_id`` and ``n_copies`` (different ids).

    Ids are made distinct first, then counted: both steps combine before they shuffle, so one group may
    hold any share of the rows.
    """
    single, several = _suspects(tuples)
    words = _words(tuples)
    ids = several.groupBy(*words, "record_id").agg(F.lit(1).alias("one"))
    groups = ids.groupBy(*words).agg(F.min("record_id").alias("first_id"), F.count("*").alias("n_copies"))
    return groups.select("first_id", "n_copies").unionByName(single.select("first_id", F.lit(1).cast("bigint").alias("n_copies")))


def copies(tuples: DataFrame) -> DataFrame:
    """``first_id, copy_id`` for every other id of each set of copies."""
    words = _words(tuples)
    several = _suspects(tuples)[1].drop("digest")
    firsts = several.groupBy(*words).agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")).where("last_id > first_id").drop("last_id")
    return several.join(firsts, words).where("record_id > first_id").select("first_id", F.col("record_id").alias("copy_id")).distinct()
