"""Retrieval: vector, keyword and fused search, selections with keys, near-duplicate classes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.text import tokens
from corvina.operators.ranking import falling, page
from corvina.operators.skew import meet
from corvina.session import cut

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: The constant of reciprocal rank fusion.
RRF_K = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of equal length in double precision; 0 if one is all zero, null if one is null
    or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(length == 0, 0.0).otherwise(dot / length))


def vector_scores(df: DataFrame, vector: str, query: Sequence[float]) -> DataFrame:
    """``df`` with the column ``similarity`` to one query vector; rows without a usable vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(F.col(vector), q)).where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))


def vector_top_k(df: DataFrame, id_column: str, vector: str, query: Sequence[float], k: int, least: float | None = None, one_per: str | None = None) -> DataFrame:
    """The ``k`` rows most similar to the query (ties: smaller id), optionally at least ``least`` and one per value of ``one_per``.

    Filters belong before this: the top rows are taken after them, so a filter never costs results. Each task keeps
    its best ``k`` rows; only these meet.
    """
    scored = vector_scores(df, vector, query)
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    if one_per is not None:
        best = scored.groupBy(one_per).agg(F.max_by(F.struct(*scored.columns), F.struct("similarity", falling(scored, id_column))).alias("_x"))
        scored = best.select("_x.*")
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def text_scores(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Rows that hold every term, with ``text_score``: uses of the terms per 1 + ln(1 + number of terms in the row), at most 1.

    Terms are lower case without accents. The score is our own definition of a rank; the set of matches does not
    depend on it.
    """
    own = tokens(text)

    def uses(term: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == F.lit(term)))

    counts = [uses(term) for term in terms]
    matched = df.withColumn("_t", own).where(F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains("_t", t)))
    score = sum(counts[1:], counts[0]) / (1 + F.log(1.0 + F.size("_t")))
    return matched.withColumn("text_score", F.least(F.lit(1.0), score / 10.0)).drop("_t")


def text_top_k(df: DataFrame, id_column: str, text: str, terms: Sequence[str], k: int) -> DataFrame:
    return text_scores(df, text, terms).orderBy(F.desc("text_score"), id_column).limit(k)


def filtered_vectors(
    df: DataFrame, query: Sequence[float], k: int, id_column: str = "id", vector: str = "embedding", one_per: str | None = "question_id",
    chunk_type: str | None = None, subject: str | None = None, year: int | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to the query among those of a chunk type, subject (without regard to case) and year, one per
    value of ``one_per``; filters that are null do not apply. All filters come before the top rows, so none costs results."""
    wanted = df.where(F.col(vector).isNotNull())
    if chunk_type is not None:
        wanted = wanted.where(F.col("chunk_type") == chunk_type)
    if subject is not None:
        wanted = wanted.where(F.lower("subject") == subject.lower())
    if year is not None:
        wanted = wanted.where(F.col("year") == year)
    return vector_top_k(wanted, id_column, vector, query, k, one_per=one_per)


def text_page(df: DataFrame, id_column: str, text: str, terms: Sequence[str], year: str, number: int, size: int) -> DataFrame:
    """One page of the rows that hold every term, best first (ties: latest year, then smallest id), each with ``total_rows``."""
    return page(text_scores(df, text, terms), [F.desc("text_score"), F.desc_nulls_last(year), F.col(id_column)], number, size)


def fuse(left: DataFrame, right: DataFrame, id_column: str, pool: int, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank from 1) of at most ``pool`` rows.

    A missing rank counts as ``pool`` + 1; scores are divided by the best possible one and rounded to 6; ties: smaller id.
    With one list empty the other keeps its order.
    """
    both = left.select(F.col(id_column), F.col("rank").alias("rank_a")).join(
        right.select(F.col(id_column), F.col("rank").alias("rank_b")), id_column, "full_outer"
    )
    part = lambda r: 1.0 / (RRF_K + F.coalesce(F.col(r), F.lit(pool + 1)))
    score = F.round((part("rank_a") + part("rank_b")) / (2.0 / (RRF_K + 1)), 6)
    return both.withColumn("score", score).orderBy(F.desc("score"), id_column).limit(k)


def ranked(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Ranks from 1 of a list that a top-k has already made short."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(
    df: DataFrame, id_column: str, text: str, vectors: DataFrame, vector: str, query: Sequence[float], terms: Sequence[str], k: int = 10, mode: str = "hybrid"
) -> DataFrame:
    """The ``k`` best rows by vector ('semantic'), words ('text') or both fused by rank (any other mode)."""
    pool = 3 * k
    near = ranked(
        vector_top_k(vectors, id_column, vector, query, pool if mode not in ("semantic", "text") else k).select(id_column, "similarity"), [F.desc("similarity"), F.col(id_column)]
    )
    if mode == "semantic":
        return near
    worded = ranked(text_top_k(df, id_column, text, terms, k if mode == "text" else pool).select(id_column, "text_score"), [F.desc("text_score"), F.col(id_column)])
    return worded if mode == "text" else fuse(near, worded, id_column, pool, k)


def pick_with_keys(ranked_rows: DataFrame, keys: DataFrame, on: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows numbered from 1, each with its key row if there is one (``answered`` tells).

    ``keys`` must have one row per ``on``.
    """
    chosen = ranked(ranked_rows.orderBy(*order).limit(n), order).withColumnRenamed("rank", "order_no")
    return chosen.join(keys.withColumn("answered", F.lit(True)), list(on), "left").fillna(False, ["answered"])


def missing_numbers(picked: DataFrame) -> DataFrame:
    """One row on a selection of ``pick_with_keys``: n_selected, missing_answers (the order numbers without a key)."""
    return picked.agg(F.count(F.lit(1)).alias("n_selected"), F.array_sort(F.collect_list(F.when(~F.col("answered"), F.col("order_no")))).alias("missing_answers"))


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """``df`` if it has at least ``n`` rows, else an error when it runs."""
    enough = df.agg(F.count(F.lit(1)) >= n).scalar()
    return df.where(F.when(enough, True).otherwise(F.raise_error(F.lit(f"fewer than {n} rows"))))


# ---------------------------------------------------------------- near duplicates


#: Sets of up to so many words meet by parts of their words, larger ones by single rare words.
PAIRED_WORDS = 400
#: So many of the most used words of larger sets count as the least rare ones; all others are ordered by their hash.
COMMON_WORDS = 256


def _bags(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, words, digest): the distinct words of each text as sorted hashes, and a digest of the set. Texts without words are there,
    too: a filter here would be pushed below the words and cut each text once more."""
    words = F.sort_array(F.transform(F.array_distinct(tokens(text)), lambda w: F.xxhash64(w)))
    bags = df.select(F.col(id_column).alias("id"), words.alias("words"))
    return bags.withColumn("digest", F.md5(F.array_join(F.col("words").cast("array<string>"), " ")))


def _most_apart(total: int, least: float) -> int:
    """In how many words two sets of ``total`` words together may differ at most."""
    return total - 2 * math.ceil(total * least / (1 + least) - 1e-6)


def _meeting_keys(least: float, most: int, common: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (rid, words) to (k, v, n, s0, s1): the keys on which similar sets meet, the number of words and 128 parity bits of the set.

    Sizes fall into classes, each reaching from a size to that divided by ``least``. Two sets that differ in at most h words agree
    wholly in one of h + 1 parts, so a set has a key for each part, by its class and by the class above if that is in reach; pairs
    meet in the class of the larger set. v is rid in the own class, -1 - rid in the one above. Sets of more than ``most`` words
    have keys of single words instead, those of more than ``most`` * ``least`` have both.
    """
    import numpy as np
    import pyarrow as pa

    def mixed(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        x = (x ^ np.uint64(salt) if isinstance(salt, int) else x ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    low = [1]  # the smallest size of each class
    while low[-1] <= most:
        low.append(max(low[-1] + 1, math.floor(low[-1] / least + 1e-6)))
    parts = [max(_most_apart(t, least) for t in (2 * b - 2, 2 * b - 3) if t > 0) + 1 for b in low[1:]]
    lows, n_parts = np.array(low), np.array(parts)
    usual, places = np.array(sorted(common), dtype=np.int64), np.array([i for _, i in sorted((w, i) for i, w in enumerate(common, 1))], dtype=np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            rid, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            n, flat = np.diff(words.offsets.to_numpy()).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False)
            row, h = np.repeat(np.arange(len(n)), n), mixed(flat.view(np.uint64), 0)
            sketch = np.zeros(2 * len(n), np.uint64)
            np.bitwise_xor.at(sketch, 2 * row + ((h >> np.uint64(6)) & np.uint64(1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
            out = []
            own = np.searchsorted(lows, n, "right") - 1
            for up in (0, 1):
                level = np.minimum(own + up, len(n_parts) - 1)
                here = (n <= most) & (own + up < len(n_parts)) & (lows[level] * least <= n + 1e-6 if up else True)
                size = np.where(here, n_parts[level], 0)
                start = np.cumsum(size) - size
                of = np.repeat(np.arange(len(n)), size)
                key = mixed((level[of] << 32 | (np.arange(len(of)) - start[of])).astype(np.uint64), 1)
                inside = here[row]
                r, x = row[inside], h[inside]
                np.add.at(key, start[r] + ((x >> np.uint64(7)) % size[r].astype(np.uint64)).astype(np.int64), mixed(x, 2))
                out.append((key, of, -1 - rid[of] if up else rid[of]))
            inside = (n > most * least)[row]
            if inside.any():
                r, w = row[inside], flat[inside]
                at = np.minimum(np.searchsorted(usual, w), max(0, len(usual) - 1))
                order = np.lexsort((w, np.where(usual[at] == w, places[at], 0) if len(usual) else w, r))
                r, w = r[order], w[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                first = nth <= n[r] - np.ceil(n[r] * least - 1e-6).astype(np.int64)
                out.append((mixed(w[first].view(np.uint64), 3), r[first], rid[r[first]]))
            k, of, v = (np.concatenate(x) for x in zip(*out, strict=True))
            table = [k.view(np.int64), v, n[of].astype(np.int32), sketch[2 * of].view(np.int64), sketch[2 * of + 1].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["k", "v", "n", "s0", "s1"])

    return keys


def word_set_classes(df: DataFrame, id_column: str, text: str, least: float = 0.8) -> DataFrame:
    """Pairs of different word sets with a Jaccard similarity of at least ``least`` (0.5 or more).

    Result: id_a, id_b (id_a < id_b, the smallest ids of their word sets), similarity. Texts with equal word sets are
    one representative (``word_set_members`` has the membership). Texts are cut into words once; from then on a word is its
    64-bit hash and a set its digest. Candidates are exact: sets of up to ``PAIRED_WORDS`` words meet where they agree in one of more
    parts than similar sets can differ in words; a part of three or four words is far rarer than a word, also where texts are
    made of the same phrases. Larger sets meet on single ones of their first (1 - least) * size + 1 words, the ``COMMON_WORDS``
    most used ones last. Parity bits of the sets rule out nearly all that are not similar while they meet, so what is
    written and compared word by word is little more than the result.
    """
    bags = _bags(df, id_column, text).groupBy("digest").agg(F.min("id").alias("id"), F.any_value("words").alias("words")).where(F.size("words") > 0)
    sets = cut(bags.select(F.monotonically_increasing_id().alias("rid"), "id", "words"))
    used = sets.where(F.size("words") > PAIRED_WORDS * least).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    common = [r.w for r in sorted(used.orderBy(F.desc("df"), "w").limit(COMMON_WORDS).collect(), key=lambda r: (r.df, r.w))]
    keyed = sets.select("rid", "words").mapInArrow(_meeting_keys(least, PAIRED_WORDS, common), "k long, v long, n int, s0 long, s1 long")
    a, b = (keyed.select("k", *[F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "s0", "s1")]) for side in "ab")
    total = F.col("n_a") + F.col("n_b")
    apart = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    near_size = (F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))
    met = a.where("v_a >= 0").join(b, "k").where((F.col("v_b") < F.col("v_a")) & near_size & (apart <= total - 2 * F.ceil(total * (least / (1 + least)) - 1e-6)))
    rid_b = F.when(F.col("v_b") < 0, -1 - F.col("v_b")).otherwise(F.col("v_b"))
    pairs = met.select(F.least("v_a", rid_b).alias("rid_a"), F.greatest("v_a", rid_b).alias("rid_b")).distinct()
    side = lambda x: sets.select(*[F.col(c).alias(f"{c}_{x}") for c in sets.columns])
    full = pairs.join(side("a"), "rid_a").join(side("b"), "rid_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    similarity = shared / (F.size("words_a") + F.size("words_b") - shared)
    found = full.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), similarity.alias("similarity"))
    return found.where(F.col("similarity") >= least)


def word_set_members(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, representative): the smallest id with the same word set. A set that very many texts share meets them in a broadcast."""
    bags = cut(_bags(df, id_column, text).select("id", "digest")).where(F.col("digest") != F.md5(F.lit("")))
    return meet(bags, bags.groupBy("digest").agg(F.min("id").alias("representative")), "digest").select("id", "representative")
