"""Fills containers of fixed capacity with whole texts by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.tokens import DEFAULT_TOKENIZER, token_count


class SumOfSquares:
    """Online packing: an item goes where the sum of squared counts of partly filled containers grows least."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at = np.zeros(capacity + 1, dtype=np.int64)  # containers by level; none are counted as empty or full
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of 1 to ``capacity`` units."""
        c, at = self.capacity, self.at
        # From level h to h + size the sum changes by 2 * (at[h + size] - at[h]) + 2; a full container leaves the sum.
        change = 2 * (at[1 + size : c + 1] - at[1 : c + 1 - size]) + 2
        best, least = 0, (2 * at[size] + 1 if size < c else 0)
        if len(change):
            change[-1] = 1 - 2 * at[c - size]
            change[at[1 : c + 1 - size] == 0] = np.iinfo(np.int64).max
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
            if change[k] <= least:
                best = k + 1
        if best:
            number = self.open[best].pop()
            at[best] -= 1
        else:
            number, self.made = self.made, self.made + 1
        level = best + size
        if level < c:
            self.open[level].append(number)
            at[level] += 1
        return number


def pack_texts(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    tokenizer: str = DEFAULT_TOKENIZER,
    partitions: int | None = None,
) -> DataFrame:
    """The container of every text, or of each part of a text larger than a container.

    Result: id, part_no (from 1), n_parts, start_token (from 0), n_tokens, container_id. No container holds more
    than ``capacity`` tokens; only texts above it have several parts, all but the last filling a container alone.

    Items are spread by a hash of the id; each task packs its share, large items first, with its own level array of
    ``capacity`` counts. The order is fixed by size and id, so a repeated task gives the same containers. A task
    leaves a few containers part-full, so ``partitions`` (default: the session's number of shuffle partitions)
    trades parallel work against that waste.

    Edge cases: empty texts take no room and, like null texts, get one row with 0 tokens and a null container; equal
    texts under several ids are packed each; rows delivered twice (same id and text) are packed once.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_type = df.schema[id_column].dataType.simpleString()
    sizes = df.select(F.col(id_column).alias("id"), F.coalesce(token_count(text_column, tokenizer), F.lit(0)).alias("n"))
    schema = f"id {key_type}, part_no int, n_parts int, start_token int, n_tokens int, container_id string"

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = SumOfSquares(capacity)
        last = None
        for batch in batches:
            rows = []
            for key, n in zip(batch["id"], batch["n"], strict=True):
                if (key, n) == last:
                    continue
                last = (key, n)
                whole, left = divmod(n, capacity)
                sizes_of_parts = [capacity] * whole + ([left] if left or not whole else [])
                for i, size in enumerate(sizes_of_parts):
                    number = f"{task}-{bins.place(size)}" if size else None
                    rows.append((key, i + 1, len(sizes_of_parts), i * capacity, size, number))
            yield pd.DataFrame(rows, columns=["id", "part_no", "n_parts", "start_token", "n_tokens", "container_id"])

    # The rest of a text above the capacity is an item like others, hence the order by the size of the last part.
    last_part = F.when(F.col("n") % capacity == 0, F.least("n", F.lit(capacity))).otherwise(F.col("n") % capacity)
    return sizes.repartition(parts, "id").sortWithinPartitions(last_part.desc(), F.xxhash64("id"), "id", "n").mapInPandas(packed, schema)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Items, tokens and fill of each container."""
    return (
        packed.where(F.col("container_id").isNotNull())
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("fill", F.col("n_tokens") / F.lit(float(capacity)))
    )
