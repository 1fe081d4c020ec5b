"""Hooks for models: a batch function over texts, run on partitions, with a row-by-row second try where a batch fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[str, list[str]], list[float]]
BATCH = 64


def embed(rows: DataFrame, model: Embed, name: str, batch: int = BATCH) -> DataFrame:
    """(id, vec, embedding_model) of (id, content): rows a model refuses get no vector; a vector that is not finite is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = ["" if t is None else t for t in part["content"]]
                try:
                    vectors = list(model(texts))
                    if len(vectors) != len(texts):
                        raise ValueError("as many vectors as texts are needed")
                except Exception:
                    vectors = [_alone(model, t) for t in texts]
                good = [v if v is not None and np.isfinite(v).all() else None for v in vectors]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": good, "embedding_model": name})

    return rows.select("id", "content").mapInPandas(run, "id string, vec array<float>, embedding_model string").filter("vec is not null")


RERANK_QUERY, RERANK_TEXT = 500, 600


def rerank(rows: DataFrame, score: Score) -> DataFrame:
    """(query_id, id, rerank) of (query_id, id, text, content): a reranker's scores, a few rows a query. It gets the first RERANK_QUERY and RERANK_TEXT characters, as the models take no more.

    Where any score of a query lies outside 0..1 they are raw and all of them go through the logistic function. A query that fails, gives another number of scores or a
    score that is no number has no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        none = pdf[["query_id", "id"]].iloc[:0].assign(rerank=np.empty(0))
        try:
            got = np.asarray(score((pdf["text"].iloc[0] or "")[:RERANK_QUERY], [(t or "")[:RERANK_TEXT] for t in pdf["content"]]), float)
        except Exception:
            return none
        if got.shape != (len(pdf),) or not np.isfinite(got).all():
            return none
        return pd.DataFrame({"query_id": pdf["query_id"].to_numpy(), "id": pdf["id"].to_numpy(), "rerank": scaled(got)})

    return rows.groupBy("query_id").applyInPandas(run, "query_id string, id string, rerank double")


def scaled(scores):
    """Scores as they are where all lie in 0..1, else through the logistic function."""
    import numpy as np

    return scores if ((scores >= 0) & (scores <= 1)).all() else 1 / (1 + np.exp(-np.clip(scores, -700, 700)))


def _alone(model: Embed, text: str):
    try:
        return model([text])[0]
    except Exception:
        return None
