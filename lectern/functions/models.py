"""Models that operators can be given: embedders, rerankers, chat. The ones here need no network and always say the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A unit vector from the text's words; texts with common words point alike."""
    v = np.zeros(size)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
        v[h % size] += 1 if h >> 63 else -1
    norm = float(np.sqrt((v * v).sum())) or 1.0
    return (v / norm).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: hashed_vector(t or ""))


def word_overlap_reranker(query: str, text: str = "text", most: int = 1200):
    """For retrieval.rerank: the share of the query's words that a text has, through a sigmoid."""
    asked = [w for w in dict.fromkeys(query.lower().split())]

    def score(rows: DataFrame) -> DataFrame:
        low = F.lower(F.substring(text, 1, most))
        share = sum((F.when(low.contains(w), 1.0).otherwise(0.0) for w in asked), F.lit(0.0)) / max(1, len(asked))
        return rows.withColumn("model_score", 1 / (1 + F.exp(-(8 * share - 4))))

    return score


def sse_deltas(lines: list[str]) -> list[str]:
    """The pieces of text of a streamed completion, up to [DONE]; what isn't data or doesn't parse is passed over."""
    out = []
    for line in lines:
        data = line.strip().removeprefix("data:").strip() if line.strip().startswith("data:") else ""
        if data == "[DONE]":
            break
        try:
            piece = json.loads(data)["choices"][0]["delta"].get("content")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            continue
        if piece:
            out.append(piece)
    return out
