"""Spelling of record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column | str) -> Column:
    """A UUID in any spelling as lower-case 8-4-4-4-12; null, empty and blank give null.

    Accepted: upper case, outer white space, braces, ``urn:uuid:``, no hyphens. Anything that is no UUID stays, trimmed
    and in lower case, so that it still names something (which then does not exist).
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    hexes = F.regexp_replace(plain, r"^\{?(urn:uuid:)?\{?|[-}]", "")
    return (
        F.when(c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), c)
        .when(hexes.rlike("^[0-9a-f]{32}$"), F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .otherwise(F.nullif(plain, F.lit("")))
    )


def said(c: Column | str) -> Column:
    """A word compared without regard to letter case and outer blanks (status, trust)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))
