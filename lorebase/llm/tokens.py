"""Encoding of a corpus with a public tokenizer, its character offsets, and decoding.

Byte-level BPE never joins text across the start of a word that one blank sets apart (a blank between two characters that are no white space opens a new
piece). A text is therefore cut there, the distinct pieces of an Arrow batch are encoded at once by the tokenizers library, and
the ids of a text are those of its pieces in order. Pieces come again far more often than texts do, so a worker keeps the ids of
those it has seen, up to a bound.

Decoding reverses the byte table: each token is the bytes behind its characters, and a character may be split over tokens, so bytes are joined before they are
read as text.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; a null ``doc_id`` stays; repeated
rows are encoded each; texts of any length are encoded whole; ids that are not in the table decode to nothing; broken bytes decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

VOCABULARY_FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Distinct pieces a worker remembers; beyond it starts anew.
REMEMBERED = 400_000
#: Texts whose pieces are held at a time.
SLICE = 256
#: A piece longer than this is encoded but not remembered.
LONG = 64

# \S is narrower than in the vocabulary's own pattern, never wider: fewer cuts, the same ids
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def cuts(path: str) -> bool:
    """Whether a text may be cut at blanks: only a byte-level vocabulary with the usual pattern and no normalizer begins a new piece there. Others encode each text whole."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, bytes]:
    return {}


def _packed(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text as 32-bit integers in a row: pieces are joined as bytes, no id becomes an object of its own."""
    known = _known(path)
    for at in range(0, len(texts), SLICE):
        if len(known) > REMEMBERED:
            known.clear()
        cut = [(_CUT.split(t) if cuts(path) else [t]) if t else [] for t in texts[at : at + SLICE]]
        new = list(set().union(*cut) - known.keys())
        if new:
            for p, e in zip(new, tokenizer(path).encode_batch_fast(new, add_special_tokens=False)):
                known[p] = np.array(e.ids, np.int32).tobytes()
        for pieces in cut:
            yield b"".join(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > LONG:
                del known[p]


def encode_batch(texts: list[str | None], path: str) -> list[list[int]]:
    """The ids of each text."""
    return [np.frombuffer(b, np.int32).tolist() for b in _packed(texts, path)]


def encode_arrow(texts: list[str | None], path: str) -> pa.ListArray:
    """The ids of each text as an Arrow array."""
    packed = list(_packed(texts, path))
    ends = np.cumsum([0, *(len(b) // 4 for b in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """How many ids each text has."""
    return [len(b) // 4 for b in _packed(texts, path)]


def byte_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others are moved up past 255 in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id."""
    table = byte_table()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in vocabulary.items()}


def decode_ids(ids: list[int] | None, path: str) -> str:
    """The text of ids: bytes first, then characters, so that split ones come together again."""
    table = token_bytes(path)
    return b"".join(table.get(i, b"") for i in (ids if ids is not None else ())).decode("utf-8", errors="replace")


def char_spans(ids: list[int], text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of each token. A token of part of a character spans that character."""
    table = token_bytes(path)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
    return at[starts], at[ends - 1] + 1


def _arrow(batch: pa.RecordBatch, lists: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.list_(pa.int32())) for v in lists.values())], ["doc_id", *lists])


def encode(documents: DataFrame, folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_arrow(b.column(1).to_pylist(), path)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encode_with_spans(documents: DataFrame, folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids, starts, ends): characters [start, end) of the text for each id."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_batch(texts, path)
            spans = [char_spans(i, t or "", path) for i, t in zip(ids, texts)]
            yield _arrow(b, {"ids": ids, "starts": [s.astype(np.int32) for s, _ in spans], "ends": [e.astype(np.int32) for _, e in spans]})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([decode_ids(i, path) for i in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(documents: DataFrame, columns: list[str], folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """``columns`` of the documents, without the text, and n_tokens."""
    path = f"{folder}/{name}"

    # a map and not a function of a column: that would run again in every filter on the count
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_batch(b.column(b.num_columns - 1).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*columns, "n_tokens"])

    rows = documents.select(*columns, F.col("text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("n_tokens", LongType())]))


def round_trip(documents: DataFrame, folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, n_split, same): whether a text comes back as it was, and how many tokens hold only a part of a character."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = encode_batch(texts, path)
            split = [0 if t.isascii() else sum(_is_part(table[i]) for i in x) for t, x in zip(texts, ids)]
            same = [decode_ids(x, path) == t for t, x in zip(texts, ids)]
            cells = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(split, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_tokens", "n_split", "same"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_split long, same boolean")


def _is_part(b: bytes) -> bool:
    try:
        b.decode("utf-8")
        return False
    except UnicodeDecodeError:
        return True
