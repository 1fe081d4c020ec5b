"""Duplicates hidden by formatting differences.

Records get a canonical fingerprint (words without case, punctuation, white space; named fields in any order) and a 64-bit hash of it. The hash names a segment of a
Bloom filter and two bits in it. Every partition notes the bits of the hashes it saw once and of those it saw repeatedly; the partitions' segments are merged where
they meet, and a bit is *repeated* when one partition saw it repeatedly or two saw it at all. Only rows whose bits are both repeated may have a
copy: they alone are shuffled and grouped exactly. All others are singletons.

Size: the filter has 16 bits a row at any number of rows (:func:`segments_for`, no upper bound), so about 1.4 % of singletons are shuffled in vain, few rows or many. Its
segments are rows of a table in the shared folder. Segments come in ranges of RANGE_SEGMENTS (64 MB): fingerprints are laid down by range, and one range at a time is merged and joined
with its own rows as a broadcast. Nothing larger than one range is ever in one place, and every fingerprint is read once for its bits and once for its mark.

Defined results: null and blank contents have no copies and are singletons; a null scope has no words; null types are equal to each other; contents
of punctuation alone have the same (empty) word sequence; a repeated ``line_no`` counts as often as it comes; the smallest ``line_no`` stands for the
group; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import Scratch

SEGMENT_BITS = 1 << 20
BITS_A_ROW = 16
#: Segments that are merged and broadcast at once: 64 MB of bits, whatever the number of rows.
RANGE_SEGMENTS = 512
#: Hashes a task holds before it hands on its bits.
FLUSH_ROWS = 1 << 21

_BLANK = r"^[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*$"


def words(c: Column) -> Column:
    """Runs of letters or digits in lower case, set apart by one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def canonical_content(c: Column) -> Column:
    """The form of a content in which copies are equal; null for null and blank contents.

    A JSON object and two or more ``name=value`` items (set apart by semicolons or line ends) become their fields as words, in order of
    names; anything else becomes its words.
    """
    fields = F.map_entries(F.from_json(F.when(c.rlike(r"^\s*\{"), c), "map<string,string>"))
    as_json = F.array_join(
        F.array_sort(F.transform(fields, lambda e: F.concat(words(e["key"]), F.lit("="), words(F.coalesce(e["value"], F.lit("null")))))), ";"
    )
    # only a text that is items throughout is cut into items
    items = F.filter(F.split(c, r"[;\r\n]+"), lambda x: F.trim(x) != "")
    # each class excludes what follows it, so that the match takes one pass
    named = F.forall(items, lambda x: x.rlike(r"^[^=\w]*\w[^=]*="))
    as_items = F.array_join(
        F.array_sort(
            F.transform(
                items, lambda x: F.concat(words(F.substring_index(x, "=", 1)), F.lit("="), words(F.regexp_replace(x, "^[^=]*=", "")))
            )
        ),
        ";",
    )
    return (
        F.when(c.isNull() | c.rlike(_BLANK), F.lit(None).cast("string"))
        .when(as_json.isNotNull(), F.concat(F.lit("j:"), as_json))
        .when(F.when(c.contains("="), (F.size(items) >= 2) & named).otherwise(False), F.concat(F.lit("i:"), as_items))
        .otherwise(F.concat(F.lit("t:"), words(c)))
    )


def fingerprints(memories: DataFrame) -> DataFrame:
    """line_no, fp (128-bit digest of type, scope and content in canonical form, null where there are no copies), h (64 bits of another hash)."""
    canon = canonical_content(F.col("content"))
    key = F.concat_ws("\x01", F.coalesce("mem_type", F.lit("\x02")), words(F.coalesce("scope", F.lit(""))), canon)
    rows = memories.select(F.col("line_no").cast("long").alias("line_no"), F.when(canon.isNotNull(), key).alias("key"))
    return rows.select("line_no", F.unhex(F.md5("key")).alias("fp"), F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("h"))


def segments_for(rows: int) -> int:
    """Segments of the filter: BITS_A_ROW bits a row."""
    return max(1, -(-rows * BITS_A_ROW // SEGMENT_BITS))


def segment_of(h: Column, segments: int) -> Column:
    return F.pmod(h, F.lit(segments).cast("long"))


def bit_positions(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, counted over all segments: both in its segment, from its upper 40 bits."""
    u = h.astype(np.int64).view(np.uint64)
    base = (h.astype(np.int64) % segments) * SEGMENT_BITS
    return base + ((u >> np.uint64(24)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64), base + (u >> np.uint64(44)).astype(np.int64)


def _payload(positions: np.ndarray) -> bytes:
    """Positions within a segment: as a list where they are few, else as bits."""
    if len(positions) * 4 < SEGMENT_BITS // 8:
        return positions.astype(np.uint32).tobytes()
    dense = np.zeros(SEGMENT_BITS, bool)
    dense[positions] = True
    return np.packbits(dense).tobytes()


def _bits(payload: bytes) -> np.ndarray:
    if len(payload) == SEGMENT_BITS // 8:
        return np.unpackbits(np.frombuffer(payload, np.uint8)).view(bool)
    dense = np.zeros(SEGMENT_BITS, bool)
    dense[np.frombuffer(payload, np.uint32)] = True
    return dense


def _partition_bits(segments: int):
    def cut(positions: np.ndarray) -> dict[int, np.ndarray]:
        positions = np.unique(positions)
        at = positions // SEGMENT_BITS
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(positions) else []
        ends = [*starts[1:], len(positions)]
        return {int(at[a]): positions[a:b] % SEGMENT_BITS for a, b in zip(starts, ends)}

    def emit(parts: list[np.ndarray]) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        seen = cut(np.concatenate(bit_positions(keys, segments)))
        again = cut(np.concatenate(bit_positions(keys[counts > 1], segments)))
        return pd.DataFrame({"segment": list(seen), "seen": [_payload(p) for p in seen.values()], "again": [_payload(again.get(s, np.empty(0, np.int64))) for s in seen]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for pdf in batches:
            parts.append(pdf["h"].to_numpy(np.int64))
            n += len(pdf)
            if n >= FLUSH_ROWS:
                yield emit(parts)
                parts, n = [], 0
        if n:
            yield emit(parts)

    return run


def _merge_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by segment; one segment is held at a time. A segment without a repeated bit has no row."""
    at, seen, again = None, None, None

    def done() -> pd.DataFrame:
        words = np.packbits(again, bitorder="little").view(np.int64)
        return pd.DataFrame({"segment": [at], "words": [words]} if again.any() else {"segment": [], "words": []})

    for pdf in batches:
        for segment, s, a in pdf[["segment", "seen", "again"]].itertuples(index=False):
            if segment != at:
                if at is not None:
                    yield done()
                at, seen, again = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            new = _bits(s)
            again |= _bits(a) | (seen & new)
            seen |= new
    if at is not None:
        yield done()


def repeated_bits(hashes: DataFrame, segments: int) -> DataFrame:
    """hashes: (h). (segment, words): the merged bits that may be repeated, as 64-bit words."""
    tasks = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_partition = hashes.mapInPandas(_partition_bits(segments), "segment long, seen binary, again binary")
    merged = per_partition.repartition(tasks, "segment").sortWithinPartitions("segment")
    return merged.mapInPandas(_merge_segments, "segment long, words array<long>")


def _is_set(place: Column) -> Column:
    """Whether the bit at this place of the joined segment is set."""
    word = F.get("words", F.shiftrightunsigned(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def mark_possible_repeats(scratch: Scratch, prints: DataFrame, rows: int) -> DataFrame:
    """prints: (line_no, fp, h), rows: how many there are at most. (line_no, fp, maybe): maybe is false where the fingerprint certainly comes once."""
    segments = segments_for(rows)
    ranges = -(-segments // RANGE_SEGMENTS)
    at = F.floor(segment_of(F.col("h"), segments) / RANGE_SEGMENTS).cast("int")
    # null hashes go with the first range
    laid = scratch.keep(prints.withColumn("range", F.coalesce(at, F.lit(0))), by="range" if ranges > 1 else None)
    first = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit((1 << 44) - 1)), 24)
    second = F.shiftrightunsigned("h", 44)
    marked = []
    for n in range(ranges):
        own = laid.filter(F.col("range") == n)
        bits = scratch.keep(repeated_bits(own.select("h").filter("h is not null"), segments))
        hit = own.withColumn("segment", segment_of(F.col("h"), segments)).join(F.broadcast(bits), "segment", "left")
        maybe = F.coalesce(_is_set(first) & _is_set(second), F.lit(False))
        marked.append(scratch.keep(hit.select("line_no", "fp", maybe.alias("maybe"))))
        scratch.drop(bits)
    return scratch.together(marked)


def _grouped(spark: SparkSession, memories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "formatting")
    marked = mark_possible_repeats(scratch, fingerprints(memories), memories.count())
    repeats = marked.filter("maybe").select("line_no", "fp")
    groups = repeats.groupBy("fp").agg(F.min("line_no").alias("first_line_no"), F.count("*").alias("n_copies"))
    return marked, repeats, groups


def copies(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """(first_line_no, line_no): one row for each row that is a copy of an earlier line."""
    _, repeats, groups = _grouped(spark, memories)
    of = groups.filter("n_copies > 1").select("fp", "first_line_no")
    return repeats.join(of, "fp").filter("line_no <> first_line_no").select("first_line_no", "line_no")


def collapsed(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """(first_line_no, n_copies): one row for each distinct record. Rows without a possible copy never meet the shuffle."""
    marked, _, groups = _grouped(spark, memories)
    singles = marked.filter("not maybe").select(F.col("line_no").alias("first_line_no"), F.lit(1).cast("long").alias("n_copies"))
    return groups.select("first_line_no", "n_copies").unionByName(singles)
