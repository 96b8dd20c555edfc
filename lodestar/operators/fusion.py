"""Fusing ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scores import sigmoid
from lodestar.functions.text import truncate_runes

RRF_K = 60


def ranked(hits: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """The hits of one list with their rank from 1. A list is a query's result and so of bounded length."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *keys)))


def fuse(lists: Sequence[DataFrame], keys: Sequence[str], limit: int = 10, method: str = "rrf") -> DataFrame:
    """Reciprocal-rank fusion of lists that hold the keys and a rank: the votes 1 / (60 + rank) are summed."""
    if method != "rrf":
        raise ValueError(f"fusion method {method!r} is not supported")
    votes = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        votes = votes.unionByName(other.select(*keys, "rank"))
    out = votes.groupBy(*keys).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(limit)


# Parts of model names whose scores are probabilities, or logits.
_PROBABILITY, _LOGIT = ("jina", "cohere"), ("bge-reranker", "qwen3-reranker")


def score_mode(model: str, low: float, high: float) -> str:
    """"probability" or "logit": by the model's name, else by whether all scores lie between 0 and 1."""
    name = model.lower()
    if any(x in name for x in _PROBABILITY):
        return "probability"
    if any(x in name for x in _LOGIT):
        return "logit"
    return "probability" if low >= 0 and high <= 1 else "logit"


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], keys: Sequence[str], limit: int = 10, model: str = "", query_chars: int = 0, doc_chars: int = 0) -> DataFrame:
    """Score the hits (already limited) anew with a model and keep the best; logits become probabilities. A failing scorer is an error."""
    asked = query if query_chars <= 0 or len(query) <= query_chars else query[:query_chars] + "…"

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(asked, texts.fillna("").tolist()), dtype="float64")

    raw = hits.withColumn("_raw", run(truncate_runes(F.col("text"), doc_chars)))
    bounds = raw.agg(F.min("_raw").alias("low"), F.max("_raw").alias("high")).first()
    if bounds["low"] is None:
        return hits.limit(0)
    mode = score_mode(model, bounds["low"], bounds["high"])
    score = F.col("_raw") if mode == "probability" else sigmoid(F.col("_raw"))
    return raw.withColumn("score", score).drop("_raw").orderBy(F.desc("score"), *keys).limit(limit)


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """An offline scorer: the share of the query's words that a text has."""
    words = set(query.lower().split())
    return [len(words & set(t.lower().split())) / len(words) if words else 0.0 for t in texts]
