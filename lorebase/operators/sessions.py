"""Session logs: binding to projects, neighbours in time, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import spread_last


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.dropDuplicates(["session_no"])


def bind_projects(sessions: DataFrame) -> DataFrame:
    """(session_no, project, bound): a session without a project takes the last one its agent worked on before."""
    s = sessions.select("session_no", "agent", F.nullif(F.trim("project"), F.lit("")).alias("project"), "started_at").distinct()
    # an agent's sessions are filled day by day, each day from the last project of the days before
    s = spread_last(s.withColumn("day", F.to_date("started_at")), ["agent"], "day", ["started_at", "session_no"], "project", "before")
    return s.select("session_no", "project", F.coalesce("project", "before").alias("bound"))


def neighbours(sessions: DataFrame, hits: Column, radius: int) -> DataFrame:
    """(hit, neighbour, offset): sessions within ``radius`` places of each hit in the same session id's sequence, itself included."""
    s = sessions.filter("session_id is not null").select("session_id", "session_no", "started_at").distinct()
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("started_at", "session_no"))
    n = s.withColumn("at", at)
    h = n.filter(hits).select("session_id", F.col("session_no").alias("hit"), F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius)).alias("at"), F.col("at").alias("hit_at"))
    return h.join(n, ["session_id", "at"]).select("hit", F.col("session_no").alias("neighbour"), (F.col("at") - F.col("hit_at")).alias("offset"))


PROMPTS_FIRST, PROMPTS_LAST, RESPONSE_CHARS, TOTAL_CHARS = 3, 5, 1200, 4000


def parse(sessions: DataFrame) -> DataFrame:
    """(session_no, requests, response, n_requests_said, branch): the parts of a session text."""
    text = F.regexp_replace(F.col("session"), r"\r\n?", "\n")
    said = F.regexp_extract(text, r"Session summary: (\d+) requests", 1)
    asked = F.regexp_extract(text, r"(?s)\nRequests:\n(.*?)(?:\nFinal response:|$)", 1)
    requests = F.transform(F.filter(F.split(asked, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.regexp_replace(x, "^- ", "")))
    return distinct_sessions(sessions).filter("session is not null").select(
        "session_no",
        requests.alias("requests"),
        F.regexp_extract(text, r"(?s)\nFinal response:\n(.*)$", 1).alias("response"),
        said.try_cast("int").alias("n_requests_said"),
        F.nullif(F.regexp_extract(text, r"on branch ([^,\s]+)", 1), F.lit("")).alias("branch"),
    )


def summarise(sessions: DataFrame) -> DataFrame:
    """(session_no, summary): the first and last requests without repeats of the one before, and the start of the response; TOTAL_CHARS at most."""
    p = parse(sessions)
    fresh = F.filter(
        F.transform("requests", lambda x, i: F.when((i == 0) | (x != F.element_at("requests", F.greatest(i, F.lit(1)))), x)), lambda x: x.isNotNull()
    )
    p = p.withColumn("fresh", fresh)
    n = F.size("fresh")
    many = n > PROMPTS_FIRST + PROMPTS_LAST
    shown = F.when(
        many,
        F.concat(
            F.slice("fresh", 1, PROMPTS_FIRST),
            F.array(F.concat(F.lit("... "), (n - PROMPTS_FIRST - PROMPTS_LAST).cast("string"), F.lit(" more"))),
            F.slice("fresh", -PROMPTS_LAST, PROMPTS_LAST),
        ),
    ).otherwise(F.col("fresh"))
    whole = F.concat_ws("\n", F.array_join(F.transform(shown, lambda x: F.concat(F.lit("- "), x)), "\n"), F.substring("response", 1, RESPONSE_CHARS))
    return p.select("session_no", F.substring(whole, 1, TOTAL_CHARS).alias("summary"), n.alias("n_fresh"))
