"""References to code in text: paths and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings that make a token a file of a repository
EXTENSIONS = ("go", "py", "ts", "tsx", "js", "jsx", "java", "rs", "rb", "c", "h", "cc", "cpp", "cs", "kt", "swift", "php", "sql", "sh", "yaml", "yml", "toml", "json", "md", "proto", "html", "css")
# fixed values: call-like or code-like words that name nothing of a repository
STOP_WORDS = ("true", "false", "null", "nil", "none", "main", "init", "test", "todo", "print", "len", "make", "append", "string", "int", "error", "self", "this", "return", "func", "def")
MAX_PATHS = MAX_SYMBOLS = 6

_SYMBOL = r"^[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|#)[A-Za-z_][A-Za-z0-9_]*)*$"


def valid_target(path: str, symbol: str, anchor: str) -> Column:
    """Whether a reference can be looked up: a path inside the repository in its plainest form, a plain symbol, a commit hash."""
    p, s, a = F.col(path), F.coalesce(F.col(symbol), F.lit("")), F.col(anchor)
    good_path = (F.coalesce(p, F.lit("")) != "") & ~p.rlike(r"(^/|\.\.|//|^\./|\\|/$|^~)")
    return good_path & ((s == "") | s.rlike(r"^[A-Za-z_][A-Za-z0-9_.]{0,99}$")) & (a.isNull() | a.rlike("^[0-9a-f]{7,64}$"))


def paths(text: Column, limit: int | None = MAX_PATHS) -> Column:
    """Repository paths a text names, in order of mention, without line suffixes; at most ``limit``."""
    tokens = F.split(text, r"[^A-Za-z0-9_./#:~@+-]+")
    plain = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r"(#L?\d+.*|:\d+(:\d+)?:?)$", ""), r"^(\./)+|[.:,]+$", ""))
    good = F.filter(
        plain,
        lambda t: t.rlike(rf"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*\.({'|'.join(EXTENSIONS)})$") & ~t.rlike(r"(://|\.\.|^/|^~|^www\.|^[A-Za-z0-9-]+\.(com|org|net|io|dev|example)/)"),
    )
    found = F.array_distinct(good)
    return F.slice(found, 1, limit) if limit else found


def strong_symbols(text: Column, limit: int | None = MAX_SYMBOLS) -> Column:
    """Symbols in backticks or before an empty call, at most ``limit``."""
    quoted = F.regexp_extract_all(text, F.lit(r"`([^`\s]{3,100})`"), F.lit(1))
    called = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_.:#]{2,99})\(\)"), F.lit(1))
    plain = F.transform(F.concat(quoted, called), lambda t: F.regexp_replace(t, r"\(\)$", ""))
    return _symbols(plain, limit)


def weak_symbols(text: Column, limit: int | None = MAX_SYMBOLS) -> Column:
    """Words written like symbols: two humps, or Type.member."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_./])([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+(?:\.[A-Za-z_]\w*)?|[A-Z]\w+\.[A-Z]\w+)"), F.lit(1))
    return _symbols(words, limit)


def _symbols(candidates: Column, limit: int | None) -> Column:
    good = F.filter(
        candidates,
        lambda t: t.rlike(_SYMBOL) & (F.length(t) >= 3) & ~F.lower(t).isin(*STOP_WORDS) & ~t.rlike(rf"\.({'|'.join(EXTENSIONS)})$"),
    )
    found = F.array_distinct(good)
    return F.slice(found, 1, limit) if limit else found


def code_references(text: Column) -> Column:
    """Array of (path, symbol): files first; symbols belong to the single path where there is one, else they stand alone. Weak symbols count only then."""
    p = paths(text)
    one = F.size(p) == 1
    symbols = F.slice(F.array_distinct(F.concat(strong_symbols(text), F.when(one, weak_symbols(text)).otherwise(F.array().cast("array<string>")))), 1, MAX_SYMBOLS)
    at = F.when(one, F.element_at(p, 1)).otherwise(F.lit(""))
    return F.concat(
        F.transform(p, lambda x: F.struct(x.alias("path"), F.lit("").alias("symbol"))),
        F.transform(symbols, lambda s: F.struct(at.alias("path"), s.alias("symbol"))),
    )


def split_symbol(symbol: Column) -> Column:
    """(qualifier, name) of A::B, A#B and A.B."""
    return F.struct(
        F.regexp_extract(symbol, r"^(.*?)(?:::|#|\.)([^:#.]+)$", 1).alias("qualifier"), F.regexp_extract(symbol, r"([^:#.]+)$", 1).alias("name")
    )
