"""Session building, the shared working folder and staged tables."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "souqframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without: it gets a temporary folder. A cluster session without
    the setting is an error, because a machine-local folder would be lost with its machine.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="souqframe-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


_local: str | None = None


class Workspace:
    """Staged Parquet tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/souqframe-{uuid.uuid4().hex}"
        self._n = 0
        _bases.append(self.base)

    def stage(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return it as read back, with the schema it was written with."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_path = path
        return back

    def stage_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As :meth:`stage`, with the number of rows written, counted while writing."""
        seen = Observation()
        back = self.stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return back, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_staged_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


_bases: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Delete the staged tables of all queries of this process, once their results are written elsewhere."""
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _bases:
        p = spark._jvm.org.apache.hadoop.fs.Path(_bases.pop())
        gone += int(p.getFileSystem(conf).delete(p, True))
    return gone


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """Rows that are slow to work on, over enough tasks: inputs of fewer tasks than twice the cores are dealt out anew.

    Large inputs have more tasks than that and are left as they lie, so nothing large is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give every worker this package as a zip file, once per application: workers start in other folders, on other machines."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in sorted(os.walk(package)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    with open(path, "rb") as h:
                        z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(package))), h.read())
    data = held.getvalue()
    at = f"{shared_dir(spark)}/souqframe-{hashlib.md5(data).hexdigest()}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{at}.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(part, target):
            fs.delete(part, False)
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
