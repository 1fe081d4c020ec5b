"""References to records that do not exist, kept up incrementally.

State, in a folder of the shared file system, all of it written once and never rewritten:

* ``index``: per batch, one row per record id of that batch (when it first arrived, its newest version and that version's status). The batches so far are merged now and then
  into a base, bucketed by id, whenever as many batches have come as it holds; so a row is merged a logarithm of times, and probes of the base shuffle the probing side only.
* ``judged``: per batch, the references that were judged in it, with their standing and the one they had before. A reference counts with its last judgement.

A batch touches its own keys only: new references probe the index; arriving parents call up the references that wait for them, deletions those that had been settled;
all these are judged and appended. Counts over time are running sums of what each batch changed.

Standing of a reference: ``absent`` (no such record so far), ``deleted`` (its newest version is deleted), ``late`` (the record came
after the reference, which had waited for it), ``ok``.

Defined results: null, empty and blank references name nothing and have no row; a reference that is no UUID is absent;
repeated rows each count (they have their own ``line_no``); a null ``loaded_at`` is never late and makes no other late;
null or odd ``status`` is not deleted; batches may come in any order of time; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.ids import canonical_id, said
from lorebase.session import Scratch, exists, free_plans, short_plan_texts

#: (table, field that names a memory)
REFERENCES = (
    ("memories", "supersedes"),
    ("memory_edges", "src"),
    ("memory_edges", "dst"),
    ("memory_refs", "memory_id"),
)
REF_COLUMNS = ["src_table", "line_no", "ref_field", "target", "loaded_at"]
REF_KEY = ["src_table", "line_no", "ref_field", "target"]
INDEX = "id string, first_loaded timestamp, newest struct<updated_at:timestamp,line_no:bigint,status:string>, batch int"
JUDGED = "src_table string, line_no long, ref_field string, target string, loaded_at timestamp, was string, batch int, standing string"
#: Months of arrivals that one batch takes, the period of the reports.
MONTHS = 1


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """All references of the given tables in one narrow frame: REF_COLUMNS."""
    parts = []
    for name, field in REFERENCES:
        if name in tables:
            parts.append(
                tables[name].select(
                    F.lit(name).alias("src_table"),
                    F.col("line_no").cast("long").alias("line_no"),
                    F.lit(field).alias("ref_field"),
                    canonical_id(field).alias("target"),
                    "loaded_at",
                )
            )
    return reduce(DataFrame.unionByName, parts).filter("target is not null")


def parent_rows(memories: DataFrame) -> DataFrame:
    """The versions of records, narrow: id, first_loaded, newest (updated_at, line_no, status)."""
    return memories.select(
        canonical_id("id").alias("id"),
        F.col("loaded_at").alias("first_loaded"),
        F.struct("updated_at", F.col("line_no").cast("long").alias("line_no"), said("status").alias("status")).alias("newest"),
    ).filter("id is not null")


def _merge_parents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min("first_loaded").alias("first_loaded"), F.max("newest").alias("newest"))


def _standing() -> Column:
    return (
        F.when(F.col("newest").isNull(), "absent")
        .when(F.col("newest.status") == "deleted", "deleted")
        .when(F.col("first_loaded") > F.col("loaded_at"), "late")
        .otherwise("ok")
    )


class OrphanTracker:
    """Keyed orphan state over a sequence of batches; see the module text.

    With a ``folder`` the state outlives the session: each batch ends with a note of its number, a tracker on the same folder takes up behind the last note, and
    a batch that comes again under a number that is done changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "orphans")
        self.folder = folder or self.scratch.root
        self.lasting = folder is not None
        self.n = 0
        self._base: tuple[str, int] | None = None  # table of the merged index, the batch it goes up to
        if self.lasting and exists(spark, f"{folder}/done"):
            self._take_up()

    def advance(self, tables: dict[str, DataFrame], batch_no: int | None = None) -> None:
        """Takes one batch of arrivals; ``tables`` may hold any of memories, memory_edges and memory_refs."""
        parents = parent_rows(tables["memories"]) if "memories" in tables else None
        self.take(parents, references(tables), batch_no)

    def take(self, parents: DataFrame | None, refs: DataFrame, batch_no: int | None = None) -> None:
        """parents: as :func:`parent_rows`, refs: as :func:`references` gives them."""
        if batch_no is not None and batch_no <= self.n:
            return
        n = self.n + 1
        judge = refs.select(*REF_COLUMNS, F.lit(None).cast("string").alias("was"))
        keys = refs.select(F.col("target").alias("id"))
        if parents is not None:
            self._append(_merge_parents(parents), "index", n)
            arrived = self._index().filter(F.col("batch") == n)
            if self.n:
                judge = judge.unionByName(self._called_up(arrived))
                # what is called up names a parent that arrived
                keys = keys.unionByName(arrived.select("id"))
        # a hot target is looked up once
        found = self._lookup(keys.distinct(), n).withColumnRenamed("id", "target")
        judged = judge.join(found, "target", "left").select(*REF_COLUMNS, "was", _standing().alias("standing"))
        self._append(judged.hint("rebalance"), "judged", n, by="standing")
        self.n = n
        if self.lasting:
            self.spark.range(1).select(F.lit(n).alias("n")).write.mode("overwrite").json(f"{self.folder}/done/{n:09d}")
        if n - self._upto >= max(1, self._upto):
            self._merge_index()

    def refs(self) -> DataFrame:
        """All references as they stand: REF_COLUMNS + standing."""
        log = self._log()
        return self._current(log, log).select(*REF_COLUMNS, "standing")

    def orphans(self) -> DataFrame:
        """Those that are absent, deleted or late; settled ones are not read."""
        log = self._log()
        return self._current(log.filter("standing <> 'ok'"), log).select(*REF_COLUMNS, "standing")

    def snapshots(self) -> DataFrame:
        """(batch_no, src_table, standing, n_orphans): open counts after each batch, from what each batch changed."""
        log = self._log()
        came = log.groupBy("batch", "src_table", "standing").agg(F.count("*").alias("d"))
        went = log.filter("was is not null").groupBy("batch", "src_table", F.col("was").alias("standing")).agg((-F.count("*")).alias("d"))
        # from here on a row per batch, table and standing
        by = came.unionByName(went).filter("standing <> 'ok'").groupBy("src_table", "standing", "batch").agg(F.sum("d").alias("d"))
        w = Window.partitionBy("src_table", "standing").orderBy("batch")
        run = by.withColumn("n_orphans", F.sum("d").over(w)).withColumn("until", F.lead("batch", 1, self.n + 1).over(w) - 1)
        each = run.select(F.explode(F.sequence("batch", "until")).alias("batch_no"), "src_table", "standing", "n_orphans")
        return each.filter("n_orphans > 0")

    # ---- state

    @property
    def _upto(self) -> int:
        return self._base[1] if self._base else 0

    def _append(self, df: DataFrame, kind: str, n: int, by: str | None = None) -> None:
        # a batch that was broken off leaves files that its repetition replaces
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={n}", partitionBy=by)

    def _index(self) -> DataFrame:
        at = f"{self.folder}/index"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(at)

    def _log(self) -> DataFrame:
        at = f"{self.folder}/judged"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], JUDGED)
        return self.spark.read.schema(JUDGED).parquet(at).filter(F.col("batch") <= self.n)

    @staticmethod
    def _current(rows: DataFrame, log: DataFrame) -> DataFrame:
        """Of rows of the log those that no later batch judged again."""
        again = log.filter("was is not null").select(*(F.col(c).alias(f"_{c}") for c in REF_KEY), F.col("was").alias("_was"), F.col("batch").alias("_later"))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REF_KEY))
        return rows.join(again, same & (F.col("standing") == F.col("_was")) & (F.col("_later") > F.col("batch")), "left_anti")

    def _called_up(self, arrived: DataFrame) -> DataFrame:
        """The references that these parents may change: those that wait for one, and settled ones of a deleted one."""
        ids = arrived.select(F.col("id").alias("_id"), (F.col("newest.status") == "deleted").alias("_gone"))
        log = self._log()
        touched = log.join(ids, (F.col("target") == F.col("_id")) & ((F.col("standing") != "ok") | F.col("_gone")), "left_semi")
        return self._current(touched, log).select(*REF_COLUMNS, F.col("standing").alias("was"))

    def _lookup(self, keys: DataFrame, n: int) -> DataFrame:
        """The index rows of some ids (id) as of batch n."""
        rows = self._index().filter((F.col("batch") > self._upto) & (F.col("batch") <= n)).drop("batch")
        rows = rows.join(keys, "id", "left_semi")
        if self._base:
            rows = rows.unionByName(self.spark.table(self._base[0]).join(keys, "id", "left_semi"))
        return _merge_parents(rows)

    def _merge_index(self) -> None:
        """Merges all batches so far into a new base. Its buckets are those of the session's shuffles."""
        rows = self._index().filter((F.col("batch") > self._upto) & (F.col("batch") <= self.n)).drop("batch")
        if self._base:
            rows = rows.unionByName(self.spark.table(self._base[0]))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"orphan_index_{uuid.uuid4().hex}"
        merged = _merge_parents(rows.repartition(buckets, "id"))
        merged.write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        old, self._base = self._base, (name, self.n)
        if old:
            self.spark.sql(f"DROP TABLE {old[0]}")
            self.scratch.remove(old[0])

    def _take_up(self) -> None:
        self.n = self.spark.read.schema("n int").json(f"{self.folder}/done/*").agg(F.max("n")).first()[0] or 0
        if self.n:
            self._merge_index()


def orphans(refs: DataFrame) -> DataFrame:
    """Of tracked references those that are orphans (absent, deleted or late)."""
    return refs.filter("standing <> 'ok'")


def count_by_period(refs: DataFrame, unit: str = "month") -> DataFrame:
    """Orphans per table, field, standing and period of ``loaded_at`` (null: unknown)."""
    period = F.date_format(F.date_trunc(unit, "loaded_at"), "yyyy-MM-dd").alias("period")
    keys = ["src_table", "ref_field", period, "standing"]
    return orphans(refs).groupBy(*keys).agg(F.count("*").alias("n_orphans"))


def arrival_batches(tables: dict[str, DataFrame], months: int = MONTHS) -> tuple[Column, list[str]]:
    """The number of the batch (from 1) that a ``loaded_at`` falls into, and the first day of each batch: periods of so many months between the first and the
    last arrival, which alone come to the driver. What has no time comes with the last."""
    times = reduce(DataFrame.unionByName, (t.select("loaded_at") for t in tables.values()))
    lo, hi = times.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    if lo is None:
        return F.lit(1), [""]
    first, last = ((t.year * 12 + t.month - 1) // months for t in (lo, hi))
    number = F.floor((F.year("loaded_at") * 12 + F.month("loaded_at") - 1) / months).cast("int") - first + 1
    days = [f"{k * months // 12:04d}-{k * months % 12 + 1:02d}-01" for k in range(first, last + 1)]
    return F.coalesce(number, F.lit(len(days))), days


def track(spark: SparkSession, tables: dict[str, DataFrame], months: int = MONTHS) -> tuple[OrphanTracker, list[str]]:
    """Runs the tables through an OrphanTracker in order of arrival. Gives the tracker and the first day of each batch.

    The narrow columns of all rows are laid down by batch first, so a batch reads its own rows only.
    """
    tracker = OrphanTracker(spark)
    number, days = arrival_batches(tables, months)
    at = number.alias("batch")
    parents = parent_rows(tables["memories"]).withColumn("loaded_at", F.col("first_loaded")).select("id", "first_loaded", "newest", at)
    refs = references(tables).select(*REF_COLUMNS, at)
    parents, refs = (tracker.scratch.keep(x.hint("rebalance", F.col("batch")), by="batch") for x in (parents, refs))
    with short_plan_texts(spark):
        for n in range(1, len(days) + 1):
            own = F.col("batch") == n
            tracker.take(parents.filter(own).drop("batch"), refs.filter(own).drop("batch"))
            free_plans(spark)
    return tracker, days
