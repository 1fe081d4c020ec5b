"""The best records of each query by shared terms, ranked where the records lie: no pair of a query and a record is shuffled unless it is among the best of its part.

The records of a scope are cut into parts of bounded size and its queries into blocks; a task holds one part as postings and ranks one block against it. Only the k best of each query
and part leave the task, so what is shuffled grows with the rows of both sides and not with the places where they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lorebase.session import Scratch

#: Bytes of the texts of a part, and queries of a block: every block takes the texts of a scope once more.
PART_BYTES, BLOCK = 24 << 20, 8192
#: A term that this share of a part's records has is added up for a whole block at once, for so many terms at most.
COMMON, COMMON_MOST = 0.1, 32
#: Scores held at a time.
CELLS = 1 << 22


def best(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, lex): the k best of each query and part, ties to the larger id; the k best of all are among them. queries: query_id, scope, ts; docs: id, scope, ts: terms set apart by
    blanks, those of a query distinct. lex: the sum of 1 / j**2 over the occurrences of each of the query's terms, over their number, to nine places. Other columns of docs come along."""
    parts = docs.groupBy("scope").agg(F.greatest(F.ceil(F.sum(F.octet_length("ts")) / PART_BYTES), F.lit(1)).alias("_parts"))
    blocks = queries.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    # one row a scope, from files: so its size is known, and where it is small no text is shuffled to meet it
    cells = Scratch(docs.sparkSession, "cells").keep(parts.join(blocks, "scope"))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    d = docs.join(cells, "scope").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).withColumn("_block", F.explode(to("_blocks")))
    q = queries.join(cells, "scope").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks"))).withColumn("_part", F.explode(to("_parts")))
    at = ["scope", "_part", "_block"]
    along = [c for c in docs.columns if c not in ("id", "scope", "ts")]
    kind = StructType([queries.schema["query_id"], docs.schema["id"], StructField("lex", DoubleType()), *(docs.schema[c] for c in along)])
    each = q.select(*at, "query_id", "ts").groupBy(*at).cogroup(d.select(*at, "id", "ts", *along).groupBy(*at))
    return each.applyInArrow(lambda asked, rows: _ranked(asked, rows, k, along), kind)


def _split(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, and how many each has."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms; where the postings of each begin; their records; their gains."""
    terms, lengths = _split(texts)
    coded = terms.dictionary_encode()
    n = len(texts)
    key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    del terms
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    key = key[first]
    starts = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * n)
    gain = np.cumsum(1.0 / np.arange(1, times.max() + 1) ** 2.0)[times - 1]
    return coded.dictionary, starts, (key % n).astype(np.int32), gain


def _ranked(asked: pa.Table, rows: pa.Table, k: int, along: list[str]) -> pa.Table:
    query_ids, ids, others = _whole(asked["query_id"]), _whole(rows["id"]), [_whole(rows[c]) for c in along]
    out_q, out_d, out_s = [], [], []
    if len(query_ids) and len(ids):
        order = pc.sort_indices(ids)  # so that a larger place is a larger id
        ids, others = ids.take(order), [x.take(order) for x in others]
        terms, starts, where, gain = _postings(_whole(rows["ts"]).take(order))
        wanted, lengths = _split(_whole(asked["ts"]))
        codes = pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy()
        ends = np.cumsum(lengths)
        itself = pc.fill_null(pc.index_in(query_ids.cast(ids.type), value_set=ids), -1).to_numpy()
        n, df = len(ids), np.diff(starts)
        common = np.argsort(-df)[:COMMON_MOST]
        common = common[df[common] >= max(COMMON * n, 2)]
        dense = np.zeros((len(common), n))
        column = np.full(len(terms) + 1, -1)  # the last place is that of code -1
        column[common] = np.arange(len(common))
        for c, t in enumerate(common):
            dense[c, where[starts[t] : starts[t + 1]]] = gain[starts[t] : starts[t + 1]]
        step = max(1, CELLS // n)
        for low in range(0, len(query_ids), step):
            mine = range(low, min(low + step, len(query_ids)))
            each = [codes[ends[i] - lengths[i] : ends[i]] for i in mine]
            has = np.zeros((len(each), len(common)))
            for i, ts in enumerate(each):
                has[i, column[ts][column[ts] >= 0]] = 1.0
            scores = has @ dense
            for i, ts, row in zip(mine, each, scores):
                for t in ts[(ts >= 0) & (column[ts] < 0)]:
                    row[where[starts[t] : starts[t + 1]]] += gain[starts[t] : starts[t + 1]]
                if itself[i] >= 0:
                    row[itself[i]] = 0.0
                at, lex = _top(row, int(lengths[i]), k)
                out_q.append(np.full(len(at), i))
                out_d.append(at)
                out_s.append(lex)
    flat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    at = pa.array(flat(out_d, np.int64))
    got = [query_ids.take(pa.array(flat(out_q, np.int64))), ids.take(at), pa.array(flat(out_s, np.float64), pa.float64()), *(x.take(at) for x in others)]
    return pa.table(got, names=["query_id", "id", "lex", *along])


def _top(row: np.ndarray, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best above 0, ties to the larger place. Sums that differ by less than nine places show are ties, so all bounds leave room for them."""
    most, room = len(row) // 8, n_terms * 2e-9
    # the k-th best of some is at most the k-th best of all
    bound = np.partition(row[:most], most - k)[most - k] - room if most > k else 0.0
    at = np.flatnonzero(row >= bound) if bound > 0 else np.flatnonzero(row)
    lex = np.round(row[at] / n_terms, 9)
    if len(at) > k:
        keep = lex >= np.partition(lex, len(lex) - k)[len(lex) - k]
        at, lex = at[keep], lex[keep]
        keep = np.lexsort((at, lex))[-k:]
        at, lex = at[keep], lex[keep]
    return at, lex
