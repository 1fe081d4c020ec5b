"""Readers of public question-answering corpora (conversations and haystacks) and of session logs.

Each takes a frame with one JSON text per row, so files of any number are read in parallel, and gives flat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.hashing import log_name
from lorebase.functions.time import parse_slashed, parse_spoken

USER_CHARS, ASSISTANT_CHARS = 2500, 5000
# fixed values: names of question categories
CATEGORIES = ("multi-hop", "temporal", "open-domain", "single-hop")
_TURN = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"


def conversation_turns(samples: DataFrame) -> DataFrame:
    """(sample_id, session_no, at, said_at, speaker, turn_id, text) of JSON samples (value): sessions in numeric order, picture captions after the text."""
    s = samples.select(F.from_json("value", "sample_id string, conversation map<string,string>").alias("j")).select("j.*")
    each = s.select("sample_id", "conversation", F.explode("conversation").alias("k", "v"))
    no = F.regexp_extract("k", r"^session_(\d+)$", 1)
    sess = each.filter(no != "").select("sample_id", no.cast("int").alias("session_no"), F.try_element_at("conversation", F.concat("k", F.lit("_date_time"))).alias("when"), F.from_json("v", _TURN).alias("turns"))
    t = sess.select("sample_id", "session_no", parse_spoken(F.col("when")).alias("said_at"), F.posexplode("turns").alias("at", "t"))
    caption = F.when(F.coalesce(F.col("t.blip_caption"), F.lit("")) != "", F.concat(F.lit(" [picture: "), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    return t.select("sample_id", "session_no", "at", "said_at", F.col("t.speaker").alias("speaker"), F.col("t.dia_id").alias("turn_id"), F.concat(F.coalesce("t.text", F.lit("")), caption).alias("text"))


def conversation_questions(samples: DataFrame) -> DataFrame:
    """(sample_id, at, question, answer, category, evidence): categories 1 to 4; of a category 3 answer what stands before the semicolon."""
    s = samples.select(F.from_json("value", "sample_id string, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>").alias("j")).select("j.*")
    q = s.select("sample_id", F.posexplode("qa").alias("at", "q")).filter("q.category between 1 and 4 and q.answer is not null")
    answer = F.when(F.col("q.category") == 3, F.trim(F.substring_index("q.answer", ";", 1))).otherwise(F.col("q.answer"))
    return q.select("sample_id", "at", "q.question", answer.alias("answer"), "q.category", "q.evidence")


def haystack_turns(questions: DataFrame) -> DataFrame:
    """(question_id, session_id, session_at, said_at, at, role, text) of JSON questions (value). Parallel arrays of different length give session_id null."""
    kind = "question_id string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    j = questions.select(F.from_json("value", kind).alias("j")).select("j.*")
    even = (F.size("haystack_dates") == F.size("haystack_sessions")) & (F.size("haystack_session_ids") == F.size("haystack_sessions"))
    z = j.select("question_id", even.alias("even"), F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_at", "s"))
    t = z.select("question_id", "even", "session_at", "s.*").select("question_id", F.when(F.col("even"), F.col("haystack_session_ids")).alias("session_id"), "session_at", parse_slashed(F.col("haystack_dates")).alias("said_at"), F.posexplode("haystack_sessions").alias("at", "t"))
    return t.select("question_id", "session_id", "session_at", "said_at", "at", F.col("t.role").alias("role"), F.col("t.content").alias("text"))


def pair_turns(turns: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """keys, pair, user, assistant: role turns folded into pairs. A user turn after an assistant's opens a pair; runs of one role are joined."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = (F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("assistant")) != "user")
    t = turns.filter(F.col("role").isin("user", "assistant")).withColumn("pair", F.sum(opens.cast("int")).over(w))

    def side(role: str, most: int):
        parts = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(order, "text"))))
        return F.substring(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), 1, most)

    return t.groupBy(*keys, "pair").agg(side("user", USER_CHARS).alias("user"), side("assistant", ASSISTANT_CHARS).alias("assistant"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(session, at, kind, project, body) of session logs (JSON lines); corrupt lines and those without a kind are left out."""
    raw = spark.read.schema("t timestamp, k string, p string, b string, x string").json(path)
    return raw.filter("k is not null").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1).alias("session"), F.col("t").alias("at"), F.col("k").alias("kind"), F.col("p").alias("project"), F.col("b").alias("body"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends events (session_id, t, k, p, b) as JSON lines, a folder ``log=...`` per session named by a digest of its id. A session's rows go to one file a task."""
    rows.withColumn("log", log_name(F.col("session_id"))).drop("session_id").write.mode("append").partitionBy("log").json(path)


def category_label(c: Column) -> Column:
    """The name of a question category, other for any other."""
    return F.coalesce(*(F.when(c == n + 1, name) for n, name in enumerate(CATEGORIES)), F.lit("other"))
