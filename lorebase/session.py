"""Session settings, the shared scratch folder, and cutting of lineage."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    spark = builder.config(map=LOCAL_CONF).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Applications that have this code on their workers.
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, unless their path has it anyway."""
    root = str(Path(__file__).resolve().parents[1])
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = f"{tempfile.mkdtemp(prefix='lorebase-code-')}/lorebase.zip"
    # sources only: nothing is compiled into the installed package, which may be read-only
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(Path(root, "lorebase").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests), a temporary folder of this machine is used.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lorebase-")
    return _own[app]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Milliseconds that the events of past jobs may take to be dealt with; behind that, what they hold stays until the next time.
EVENTS_MS = 30_000


def free_plans(spark: SparkSession) -> None:
    """Gives back the driver's memory that the plans of past jobs took, and the disk that their shuffles took; a loop of many small jobs would else hold all the heap it may have.

    The end of a query is an event that holds its plan, and so its shuffles. Queues of events keep the last one they dealt with, so two empty ones are sent after it and waited for.
    """
    context = spark.sparkContext._jsc
    context.emptyRDD().count()  # a job without tasks: it starts and ends
    try:
        context.sc().listenerBus().waitUntilEmpty(EVENTS_MS)
    except Py4JJavaError:  # not in time
        pass
    gc.collect()  # what Python still refers to is kept alive in the JVM
    spark._jvm.java.lang.System.gc()


#: Spark's setting for the text of a plan, and the characters that a loop of many small jobs needs of it.
PLAN_TEXT, PLAN_CHARS = "spark.sql.maxPlanStringLength", 1000


@contextmanager
def short_plan_texts(spark: SparkSession) -> Iterator[None]:
    """Within it Spark keeps the beginning of each plan's text only. It keeps these texts for a thousand jobs, for its UI, and those of a loop's jobs fill the driver's heap."""
    before = spark.conf.get(PLAN_TEXT, None)
    spark.conf.set(PLAN_TEXT, PLAN_CHARS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PLAN_TEXT)
        else:
            spark.conf.set(PLAN_TEXT, before)


class Scratch:
    """Tables written to the shared folder so that later stages start from files.

    ``keep`` computes a frame once and gives it back as a scan: a lost executor then costs a re-read, never
    a recomputation of the whole lineage. ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # results are lazy and may be read until the session ends
        atexit.register(self._forget)
        self._at: dict[int, str] = {}
        self._n = 0

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes the frame, laid down in one folder per value of ``by`` (of few values) if asked for, and reads it again."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path, partitionBy=by, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Kept frames of one schema as one scan."""
        return self.spark.read.schema(frames[0].schema).parquet(*(self._at[id(f)] for f in frames))

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = self._at.pop(id(df), None)
            if path:
                _remove(self.spark, path)

    def remove(self, name: str) -> None:
        """Removes what was written below the root under a name of its own."""
        _remove(self.spark, f"{self.root}/{name}")

    def _forget(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session has ended before
            pass

    def clear(self) -> None:
        self._at.clear()
        _remove(self.spark, self.root)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def spread_last(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last ``value`` that is not null before each row, per ``keys`` in the order (bucket, *order), without one task per key.

    ``bucket`` must rise with the order. The last value of each bucket (one row each) is carried over first; each bucket then runs on its own. Null keys and buckets are
    keys and buckets of their own, nulls first.
    """
    from pyspark.sql import Window

    seen = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = df.groupBy(*keys, bucket).agg(F.max_by(value, seen).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, bucket]
    last = last.select(*(F.col(c).alias(f"_{c}") for c in at), F.last("_last", ignorenulls=True).over(w).alias("_before"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at))
    inner = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(last, same).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inner), "_before"))
    return joined.drop("_before", *(f"_{c}" for c in at))


def spread_cumsum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str, kind: str = "long") -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in the order (bucket, *order), without one task per key.

    ``bucket`` must rise with the order. Bucket totals (few rows) are summed first; each bucket then runs on
    its own, so a key that holds a third of all rows is spread over its buckets.
    Null values count as 0; ties in ``order`` get an arbitrary but fixed order of their own.
    """
    from pyspark.sql import Window

    v = F.coalesce(F.col(value), F.lit(0)).cast(kind)
    before = "_before_bucket"
    totals = df.groupBy(*keys, bucket).agg(F.sum(v).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias(before))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, [*keys, bucket])
    return joined.withColumn(out, F.col(before) + F.coalesce(F.sum(v).over(inner), F.lit(0))).drop(before)
