"""Sinks: tables, JSON documents, versioned model folders, reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, kind: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def arrays_as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays written as sets of quoted members, for CSV."""
    return df.withColumns({c: F.concat(F.lit("{'"), F.array_join(c, "', '"), F.lit("'}")) for c in columns})


def extend_map(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``known`` plus the rows of ``new`` with keys it lacks, sorted by key."""
    return known.unionByName(new.join(known.select(key), key, "left_anti").dropDuplicates([key])).orderBy(key)


def json_document(sections: dict[str, DataFrame], limit: int = 10_000) -> str:
    """One compact JSON text of small aggregate tables; a section beyond ``limit`` rows is an error."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"), default=str)


def new_version() -> str:
    return time.strftime("v%Y%m%dT%H%M%S", time.gmtime())


def _file(path: str):
    """The file system of a path, shared or local, and the path in it."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(path: str, text: str) -> None:
    fs, p = _file(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(path: str) -> str | None:
    """The whole text of a small file, None if there is none."""
    fs, p = _file(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save_model(model, metadata: dict, root: str, version: str | None = None) -> str:
    """A model, its metadata and a card under a new version; ``latest`` then names it."""
    version = version or new_version()
    folder = f"{root}/{version}"
    model.write().overwrite().save(f"{folder}/model")
    write_text(f"{folder}/metadata.json", json.dumps(metadata, ensure_ascii=False, indent=1, default=str))
    write_text(f"{folder}/card.md", f"# Model {version}\n\n" + "".join(f"- {k}: {v}\n" for k, v in metadata.items()))
    write_text(f"{root}/latest", version)
    return version


def latest_version(root: str) -> str | None:
    """What ``latest`` names, else the newest version folder."""
    fs, p = _file(root)
    if not fs.exists(p):
        return None
    folders = {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()}
    named = (read_text(f"{root}/latest") or "").strip()
    return named if named in folders else max((f for f in folders if f.startswith("v")), default=None)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    cols = list(rows[0])
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(str(r[c]) for c in cols) + " |" for r in rows]])
