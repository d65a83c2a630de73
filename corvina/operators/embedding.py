"""Vectors of texts: hashed ones, and those of an external model behind a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_vector(c: str | Column, dims: int = 384) -> Column:
    """A deterministic vector with components from -1 to 1, made of hashes of the text; for tests without a model."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    part = lambda i: F.conv(F.left(F.md5(F.concat_ws(":", i.cast("string"), text)), F.lit(8)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (part(i) % 2001).cast("double") / 1000.0 - 1.0)


def embed_missing(
    chunks: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[list[float]]], key: str = "content_hash", text: str = "content", batch: int = 100,
    attempts: int = 3, tokens: str | None = None, most_tokens: int = 8192, made_at: str | None = None, keep_for: str = "INTERVAL 7 DAYS", wait: float = 0.0,
) -> DataFrame:
    """(key, embedding, from_cache, error) of each distinct chunk: cached vectors are reused, only the others reach the model.

    The model gets at most ``batch`` texts at a time; a failing call is repeated after ``wait``, 2 * ``wait``, ... seconds, then its rows
    have a null vector and the error. Chunks whose column ``tokens`` is above ``most_tokens`` are not sent and say so in ``error``.
    Cached vectors whose time ``made_at`` is older than ``keep_for`` count as not there.
    """
    fresh = cache if made_at is None else cache.where(F.col(made_at) >= F.expr(f"current_timestamp() - {keep_for}"))
    size = F.max(tokens) if tokens else F.lit(0)
    wanted = chunks.groupBy(key).agg(F.min(text).alias("_t"), size.alias("_size"))
    kept = fresh.where(F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<float>").alias("embedding"))
    error = F.lit(None).cast("string").alias("error")
    old = kept.join(wanted.select(key), key, "left_semi").select("*", F.lit(True).alias("from_cache"), error)
    kind = chunks.schema[key].dataType.simpleString()

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors: Sequence[list[float] | None] = [None] * len(part)
                problem = None
                for attempt in range(attempts):
                    try:
                        vectors, problem = model(part["_t"].fillna("").tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001  a model may fail in any way
                        problem = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**attempt)
                yield pd.DataFrame({key: part[key].tolist(), "embedding": list(vectors), "error": [problem] * len(part)})

    missing = wanted.join(kept.select(key), key, "left_anti")
    small = F.coalesce(F.col("_size") <= most_tokens, F.lit(True))
    made = missing.where(small).select(key, "_t").mapInPandas(embedded, f"{key} {kind}, embedding array<float>, error string")
    large = missing.where(~small).select(key, F.lit(None).cast("array<float>").alias("embedding"), F.lit(f"more than {most_tokens} tokens").alias("error"))
    return old.unionByName(made.unionByName(large).withColumn("from_cache", F.lit(False)))


def stored(chunks: DataFrame, vectors: DataFrame, key: str = "content_hash") -> DataFrame:
    """Each chunk with whether its vector was there: id, status ('ok', 'missing')."""
    there = vectors.where(F.col("embedding").isNotNull()).select(key).distinct().withColumn("_ok", F.lit(True))
    return chunks.select("id", key).join(there, key, "left").select("id", F.when(F.col("_ok"), "ok").otherwise("missing").alias("status"))


def share_tokens(chunks: DataFrame, total: str, key: str) -> DataFrame:
    """Tokens of a call spread over its chunks, at least 1 each."""
    counted = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return chunks.join(counted, key).withColumn("tokens_used", F.greatest(F.lit(1), F.floor(F.col(total) / F.col("_n")))).drop("_n")
