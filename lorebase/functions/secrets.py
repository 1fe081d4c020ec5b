"""Secrets in text: rules, redaction and reports. The rules are this project's own."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: (rule, pattern); group 1 is what stays before the secret
RULES = (
    ("private-key", r"()-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)"),
    ("github-token", r"()\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b"),
    ("cloud-key", r"()\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("provider-key", r"()\b(?:sk|pk|rk)[-_](?:live|test|proj|ant)?[-_]?[A-Za-z0-9_-]{20,}\b"),
    ("chat-token", r"()\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", r"()\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("url-password", r"(\b[a-z][a-z0-9+.-]*://[^\s:/@]+:)[^\s@/]{3,}(?=@)"),
    ("assignment", r"((?i)\b(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)[\"']?\s*[:=]\s*[\"']?)[A-Za-z0-9+/_.~-]{12,}"),
)


def findings(c: Column) -> Column:
    """The rules that a text breaks, in their order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(r)) for r, p in RULES)))


def redact(c: Column) -> Column:
    """The text with ``[REDACTED:rule]`` for each secret."""
    return reduce(lambda t, rp: F.regexp_replace(t, rp[1], f"$1[REDACTED:{rp[0]}]"), RULES, c)


# ---- nested JSON: what hides in values, under keys, and behind names that only say what they hold

# fixed values: names whose value is a secret whatever it looks like, if it is long enough
SECRET_NAMES = ("password", "passwd", "secret", "api_key", "apikey", "access_token", "auth_token", "private_key", "client_secret")
LEAST = 8


def _rules() -> list[tuple[str, re.Pattern]]:
    return [(name, re.compile(p.replace("(?i)", ""), re.I if "(?i)" in p else 0)) for name, p in RULES]


def walk(value, found: set[str], under: bool = False):
    """A JSON value with its secrets redacted, keys kept; the rules are added to ``found``. Keys are looked at too, and what stands under a secret's name."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            found.update(name for name, p in _compiled() if p.search(k))
            out[k] = walk(v, found, under or k.lower().replace("-", "_") in SECRET_NAMES)
        return out
    if isinstance(value, list):
        return [walk(v, found, under) for v in value]
    if not isinstance(value, str):
        return value
    for name, p in _compiled():
        value, n = p.subn(lambda m, name=name: f"{m.group(1)}[REDACTED:{name}]", value)
        if n:
            found.add(name)
    if under and len(value) >= LEAST and "[REDACTED:" not in value:
        found.add("named")
        return "[REDACTED:named]"
    return value


_cache: list = []


def _compiled() -> list[tuple[str, re.Pattern]]:
    if not _cache:
        _cache.extend(_rules())
    return _cache


def redact_json(rows: DataFrame, key: str, json_column: str) -> DataFrame:
    """(key, redacted, found): a JSON text with the secrets of all nested strings redacted, and the rules they break; a text that is no JSON is null. Rows without a secret keep their text."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            texts, rules = [], []
            for t in b.column(1).to_pylist():
                found: set[str] = set()
                try:
                    clean = None if t is None else walk(json.loads(t), found)
                    texts.append(t if not found else json.dumps(clean, ensure_ascii=False))
                except ValueError:
                    texts.append(None)
                rules.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(rules, pa.list_(pa.string()))], [key, "redacted", "found"])

    return rows.select(key, json_column).mapInArrow(run, f"{key} {kind}, redacted string, found array<string>")
