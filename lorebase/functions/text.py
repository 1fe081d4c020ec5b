"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"


def collapse(c: Column) -> Column:
    """White space runs as one blank, none outside."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def content_key(c: Column) -> Column:
    """The key of exact duplicates: collapsed, lower case, no full stops or exclamation marks at the end."""
    return F.lower(F.trim(F.regexp_replace(collapse(c), r"[.!\x{3002}]+$", "")))


def truncate(c: Column, n: int) -> Column:
    """At most n code points, the last of them an ellipsis where the text is longer."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("\u2026"))).otherwise(c)


def clip_bytes(c: Column, n: int) -> Column:
    """The longest start of at most n bytes that ends at a character: whole characters are counted by their own bytes."""
    chars = F.split(F.substring(c, 1, n), "")
    kept = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")),
        lambda s, ch: F.when(s["b"] + F.octet_length(ch) <= n, F.struct((s["b"] + F.octet_length(ch)).alias("b"), (s["k"] + F.when(ch != "", 1).otherwise(0)).alias("k"))).otherwise(
            F.struct(F.lit(n + 1).alias("b"), s["k"].alias("k"))
        ),
        lambda s: s["k"],
    )
    return F.when(F.octet_length(c) <= n, c).otherwise(F.substring(c, F.lit(1), kept))


def first_line(c: Column) -> Column:
    """The first line that is not blank, collapsed."""
    return collapse(F.get(F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != ""), 0))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters or digits of at least two characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def sanitize_agent(c: Column) -> Column:
    """A name of lower-case letters, digits, dots, underscores and hyphens, 64 at most; unknown where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9._-]+", "-"), r"^[._-]+", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 64), F.lit("")), F.lit("unknown"))


def normalize_project(c: Column) -> Column:
    """A remote as host/path: no scheme, login, port, query or .git, lower case; null for local paths and what is no remote."""
    s = F.trim(c)
    local = s.rlike(r"^(/|\.|~|file:|[A-Za-z]:[\\/])")
    s = F.regexp_replace(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"^[^@/]*@", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^([^/:]+):\d+/", "$1/"), r"^([^/:]+):(?!\d+/)", "$1/")
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "/+", "/"), r"/$", ""), r"(?i)\.git$", ""))
    return F.when(~local & s.rlike(r"^[a-z0-9.-]+\.[a-z0-9-]+/[^/\s]"), s)


def split_list(c: Column) -> Column:
    """The items of a list set apart by commas, without outer blanks; empty ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: collapse(x)), lambda x: x != "")


# a line of a conversation as it is written into a record: [date, session n, Dn:m] speaker: text
TURN_LINE = r"(?s)^\[([^\]\n]+), session (\d+), (D\d+:\d+)\] ([^:\n]+): (.*)$"


def turn_line(c: Column) -> Column:
    """(said, session, turn, speaker, text) of such a line, null for anything else."""
    at = [F.regexp_extract(c, TURN_LINE, n) for n in range(1, 6)]
    return F.when(c.rlike(TURN_LINE), F.struct(at[0].alias("said"), at[1].try_cast("int").alias("session"), at[2].alias("turn"), at[3].alias("speaker"), at[4].alias("text")))


def scope_label(c: Column) -> Column:
    return F.regexp_replace(c, "^(project|repo):", "")


def normalize_answer(c: Column) -> Column:
    """Tokens of an answer: no commas, lower case, no ASCII punctuation, no articles."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, ",", "")), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~t.isin("a", "an", "the", "and"))


def semver(c: Column) -> Column:
    """(major, minor, patch) of a strict version, null for anything else and for numbers beyond 64 bits."""
    at = [F.regexp_extract(c, r"^v?(\d+)\.(\d+)\.(\d+)$", n).try_cast("long") for n in (1, 2, 3)]
    return F.when(at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull(), F.struct(*(a.alias(n) for a, n in zip(at, ("major", "minor", "patch")))))


def neutralize_fence(c: Column, tag: str = "session") -> Column:
    """The text with closing tags of a fence made harmless."""
    return F.regexp_replace(c, rf"(?i)</\s*{tag}\s*>", f"<\\\\/{tag}>")
