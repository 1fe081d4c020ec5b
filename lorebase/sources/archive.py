"""Snapshots as JSON lines: a header, records, edges and references, and an end line with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import hierarchy
from lorebase.session import Scratch

FORMAT = "lorebase-archive-1"
MEMORY = "id string, mem_type string, scope string, content string, attrs string, source_agent string, source_session string, evidence_uri string, trust string, confidence double, status string, supersedes string, created_at string"
EDGE = "src string, dst string, relation string, weight double, created_at string"
REF = "memory_id string, path string, symbol string, scope string, state string, anchor_hash string, anchor_commit string"
END = "memories bigint, edges bigint, refs bigint"
LINE = f"header struct<format:string>, memory struct<{MEMORY.replace(' ', ':').replace(',:', ',')}>, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>, ref struct<{REF.replace(' ', ':').replace(',:', ',')}>, end struct<{END.replace(' ', ':').replace(',:', ',')}>"


def _fields(ddl: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in ddl.split(",")]


def _stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")) if "created_at" in df.columns else df


def export_lines(m: DataFrame, edges: DataFrame, refs: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, value): lines of a snapshot of the records m; only edges with both ends and references with their record go along. The lines are computed once, the end line
    counts them."""
    ids = m.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    r = refs.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi")

    def lines(df: DataFrame, kind: str, ddl: str) -> DataFrame:
        return _stamp(df).select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.struct(*_fields(ddl)).alias(kind))).alias("value"))

    body = scratch.keep(lines(m, "memory", MEMORY).unionByName(lines(e, "edge", EDGE)).unionByName(lines(r, "ref", REF)))
    end = body.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("memory", "memories"), ("edge", "edges"), ("ref", "refs"))))
    head = m.sparkSession.createDataFrame([(FORMAT,)], "format string")
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.struct(*df.columns).alias(kind))).alias("value"))
    return one(head, "header").unionByName(body).unionByName(one(end, "end"))


def write_archive(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(value, header, memory, edge, ref, end): parsed lines; all null where a line is no archive line."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.from_json("value", LINE).alias("l")).select("value", "l.*")


def check(parsed: DataFrame) -> DataFrame:
    """(rule, n): what is wrong with an archive: lines that are not exactly one record, unknown fields, counts that the end line belies."""
    kinds = ("header", "memory", "edge", "ref", "end")
    present = sum((F.col(k).isNotNull().cast("int") for k in kinds), F.lit(0))
    keys = F.json_object_keys("value")
    known = F.coalesce(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in kinds)))) == 0, F.lit(False))
    got = parsed.agg(
        F.count_if(present != 1).alias("not_one_record"),
        F.count_if(~known).alias("unknown_field"),
        F.count_if((F.col("header").isNotNull()) & (F.col("header.format") != FORMAT)).alias("wrong_format"),
        F.abs(F.count("header") - 1).alias("headers"),
        F.abs(F.count("end") - 1).alias("ends"),
        F.abs(F.coalesce(F.max("end.memories"), F.lit(0)) - F.count("memory")).alias("memories_miscounted"),
        F.abs(F.coalesce(F.max("end.edges"), F.lit(0)) - F.count("edge")).alias("edges_miscounted"),
        F.abs(F.coalesce(F.max("end.refs"), F.lit(0)) - F.count("ref")).alias("refs_miscounted"),
    )
    return got.select(F.explode(F.create_map(*(x for c in got.columns for x in (F.lit(c), F.col(c).cast("long"))))).alias("rule", "n"))


def import_plan(parsed: DataFrame, stored: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, outcome): what importing the records does to a store (id): inserted, present, or cycle (the records that name each other in a ring, and those that hang on
    one, are refused). ``inserted_without_parent``: what it supersedes is in neither and is dropped. Chains of any depth are followed by pointer doubling."""
    m = scratch.keep(parsed.filter("memory is not null").select("memory.id", "memory.supersedes"))
    here = stored.select("id").withColumn("present", F.lit(True))
    new = m.join(stored.select("id"), "id", "left_anti")
    links = new.filter("supersedes is not null").join(new.select(F.col("id").alias("supersedes")), "supersedes", "left_semi")
    _, stuck = hierarchy.resolve(m.sparkSession, scratch.keep(links.select("id", F.col("supersedes").alias("parent"))), scratch=scratch)
    ring = stuck.select("id").withColumn("ring", F.lit(True))
    ids = stored.select("id").unionByName(m.select("id")).distinct().select(F.col("id").alias("supersedes"), F.lit(True).alias("known"))
    j = m.join(here, "id", "left").join(ids, "supersedes", "left").join(ring, "id", "left")
    orphan = F.col("supersedes").isNotNull() & F.col("known").isNull()
    outcome = F.when(F.col("present"), "present").when(F.col("ring"), "cycle").when(orphan, "inserted_without_parent").otherwise("inserted")
    return j.select("id", outcome.alias("outcome"))


def import_links(parsed: DataFrame, plan: DataFrame, stored: DataFrame, stored_edges: DataFrame, stored_refs: DataFrame) -> DataFrame:
    """(kind, outcome, n): what becomes of the edges and references of an archive after its records: inserted, present, or without_ends where a record they name is in no store."""
    ids = stored.select("id").unionByName(plan.filter("outcome <> 'cycle'").select("id")).distinct()
    e = parsed.filter("edge is not null").select("edge.src", "edge.dst", "edge.relation").distinct()
    ends = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.join(ends.withColumn("whole", F.lit(True)), ["src", "dst", "relation"], "left")
    e = e.join(stored_edges.select("src", "dst", "relation").distinct().withColumn("present", F.lit(True)), ["src", "dst", "relation"], "left").withColumn("kind", F.lit("edge"))
    r = parsed.filter("ref is not null").select("ref.memory_id", "ref.path", "ref.symbol").distinct()
    r = r.join(ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("whole")), "memory_id", "left")
    keys = ["memory_id", "path", "symbol"]
    r = r.join(stored_refs.select(*keys).distinct().withColumn("present", F.lit(True)), keys, "left").withColumn("kind", F.lit("ref"))
    outcome = F.when(F.col("whole").isNull(), "without_ends").when(F.col("present"), "present").otherwise("inserted").alias("outcome")
    return e.select("kind", outcome).unionByName(r.select("kind", outcome)).groupBy("kind", "outcome").agg(F.count("*").alias("n"))
