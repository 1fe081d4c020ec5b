"""Pairs of texts that share enough trigrams, counted within one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A trigram that this share of the sets has is counted for many sets at once, for so many trigrams at most; sets of such a step.
COMMON, COMMON_MOST, STEP = 0.02, 512, 128


def pairs(rows: pa.Table, threshold: float) -> pa.Table:
    """(x, y, n_both, n_all): shared trigrams and all trigrams of the pairs that may reach the threshold. rows: rep, ws (distinct words set apart by blanks), first.

    A pair is one of first with one that is not, or any two where all are first. A trigram stands in two blanks, a word and a blank.
    """
    rep, first = rows["rep"].combine_chunks(), rows["first"].to_numpy()
    doc, gram, n_grams = _sets(rows["ws"].combine_chunks())
    size = np.bincount(doc, minlength=len(rep))
    one = bool(first.all())
    left = np.flatnonzero(first)
    left = left[np.argsort(size[left], kind="stable")]
    right = left if one else np.flatnonzero(~first)
    right = right if one else right[np.argsort(size[right], kind="stable")]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if len(left) and len(right):
        begins = np.r_[0, np.cumsum(size)]
        place = np.full(len(rep), -1)
        place[right] = np.arange(len(right))
        # postings of the right side
        there = place[doc] >= 0
        order = np.argsort(gram[there], kind="stable")
        where, df = place[doc[there]][order], np.bincount(gram[there], minlength=n_grams)
        starts = np.r_[0, np.cumsum(df)]
        common = np.argsort(-df)[:COMMON_MOST]
        common = common[df[common] >= max(COMMON * len(right), 2)]
        column = np.full(n_grams, -1)
        column[common] = np.arange(len(common))
        dense = np.zeros((len(common), len(right)), np.float32)
        for c, g in enumerate(common):
            dense[c, where[starts[g] : starts[g + 1]]] = 1
        sizes = size[right]
        for low in range(0, len(left), STEP):
            mine = left[low : low + STEP]
            # sizes too far apart can't reach it; of two in one part, the later is the right one
            begin = low if one else int(np.searchsorted(sizes, size[mine[0]] * threshold - 1e-3))
            end = int(np.searchsorted(sizes, size[mine[-1]] / threshold + 1e-3, "right"))
            if begin >= end:
                continue
            has = np.zeros((len(mine), len(common)), np.float32)
            rare = []
            for k, d in enumerate(mine):
                gs = gram[begins[d] : begins[d + 1]]
                has[k, column[gs][column[gs] >= 0]] = 1
                rare.append([where[starts[g] : starts[g + 1]] for g in gs[(column[gs] < 0) & (df[gs] > 0)]])
            both = has @ dense[:, begin:end]
            for k, lists in enumerate(rare):
                if lists:
                    both[k] += np.bincount(np.concatenate(lists), minlength=len(right))[begin:end]
            most = size[mine][:, None] + sizes[None, begin:end]
            k, c = np.nonzero(both + 1e-3 >= threshold * (most - both))
            if one:
                k, c = k[c > k], c[c > k]
            n = both[k, c].astype(np.int64)
            found.append((mine[k], right[begin + c], n, most[k, c] - n))
    x, y, n, m = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(4))
    return pa.table({"x": rep.take(pa.array(x)), "y": rep.take(pa.array(y)), "n_both": pa.array(n, pa.int64()), "n_all": pa.array(m, pa.int64())})


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of texts and numbers of their trigrams, each pair once and in order; how many trigrams there are."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    padded = [f"  {w} " for w in coded.dictionary.to_pylist()]
    times = np.array([len(w) - 2 for w in padded], np.int64)
    known: dict[str, int] = {}
    of = np.array([known.setdefault(w[i : i + 3], len(known)) for w in padded for i in range(len(w) - 2)], np.int64)
    begins = np.cumsum(times) - times
    word = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    n = times[word]
    at = np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = np.unique(np.repeat(doc, n) * len(known) + of[at]) if len(known) else np.empty(0, np.int64)
    return key // max(1, len(known)), key % max(1, len(known)), len(known)
