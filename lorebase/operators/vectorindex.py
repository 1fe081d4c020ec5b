"""An approximate index for vectors: every row is assigned to its nearest centroid, a query looks into the cells of its nearest centroids.

The centroids are fitted on a sample of at most SAMPLE rows; all rows are indexed. Cells are an equi-join key, so a search shuffles rows by cell and
compares each query with the cells it asks for instead of with all. Recall against the exact search is measured by :func:`recall`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.similarity import cosine, dot, norm

SAMPLE = 20_000
ROUNDS = 8


def fit(vectors: DataFrame, cells: int, seed: int = 1) -> list[list[float]]:
    """Unit centroids by k-means on the sphere over a bounded sample (the rows of the smallest hashes)."""
    import numpy as np

    rows = vectors.select("vec").filter("vec is not null").orderBy(F.xxhash64("vec", F.lit(seed))).limit(SAMPLE).collect()
    x = np.array([r.vec for r in rows], np.float64)
    if not len(x):
        return []
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                c[k] = x[own == k].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.tolist()


def assign(vectors: DataFrame, centroids: list[list[float]], probes: int = 1) -> DataFrame:
    """Rows with cell: the nearest cell, or one row for each of the ``probes`` nearest."""
    v = F.col("vec")
    scored = F.array(*(F.struct((-dot(v, F.array(*(F.lit(x) for x in c))) / norm(v)).alias("d"), F.lit(k).alias("cell")) for k, c in enumerate(centroids)))
    return vectors.withColumn("_c", F.slice(F.array_sort(scored), 1, probes)).withColumn("cell", F.explode(F.transform("_c", lambda s: s["cell"]))).drop("_c")


def search(queries: DataFrame, rows: DataFrame, centroids: list[list[float]], k: int, probes: int) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest among the cells asked. queries: query_id, vec; rows: id, vec."""
    q = assign(queries.filter("vec is not null"), centroids, probes).select("query_id", F.col("vec").alias("qv"), "cell")
    r = assign(rows.filter("vec is not null"), centroids).select("id", "vec", "cell")
    near = q.join(r, "cell").filter("id <> query_id").select("query_id", "id", F.round(1 - cosine(F.col("qv"), F.col("vec")), 9).alias("dist"))
    w = Window.partitionBy("query_id").orderBy("dist", F.desc("id"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall) of (query_id, id) pairs."""
    e = exact.select("query_id", "id")
    hit = e.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("n_found"))
    total = e.agg(F.count("*").alias("n_exact"))
    both = total.withColumn("k", F.lit(0)).join(hit.withColumn("k", F.lit(0)), "k")
    return both.select("n_exact", "n_found", F.round(F.col("n_found") / F.greatest("n_exact", F.lit(1)), 6).alias("recall"))
