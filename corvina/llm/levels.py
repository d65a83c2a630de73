"""Reading level of texts from the grades at which their words are acquired."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.session import cut

LEVELS = ("basico", "medio", "avancado")

#: Syllables per word at which the first grading passes from one level to the next, for Portuguese.
SYLLABLE_BOUNDS = (1.77, 2.4)
#: Grades of the scale on which words are acquired; each level spans a third of it.
GRADES = 12
#: Share of a word's uses (each grade's rate counting alike) that a grade must reach with those below for the word to be acquired.
ACQUIRED = 0.25
#: Quantiles of a text's word grades from which its level is predicted.
QUANTILES = (0.5, 0.65, 0.8, 0.9)
#: A word must be used at least so often to get a grade.
LEAST_USES = 5
#: Words are known by a hash of so many places, whatever the size of the vocabulary; words that fall
#: on one place share its uses and grade. This bounds what is broadcast: a byte for each place.
PLACES = 1 << 22

#: Fixed value: what counts as a word that can be known; fragments with foreign letters cannot.
PLAIN_WORD = re.compile("[aeoéà]|[a-záàâãéêíóôõúüç]{2,}")

_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^ \t\r\n]+")
_VOWELS = re.compile(r"[aeiouáàâãéêíóôõúüy]+")
_HIATUS = re.compile(r"[aeo][aeo]|[íú]")


def syllables(word: str) -> int:
    """Syllables of a lower-case Portuguese word, by its groups of vowels and the commonest splits within them."""
    groups = _VOWELS.findall(word)
    return max(1, len(groups) + sum(len(g) > 1 and bool(_HIATUS.search(g)) for g in groups))


def first_grade(mean: np.ndarray, bounds: tuple[float, float] = SYLLABLE_BOUNDS) -> np.ndarray:
    """Grades from 0 from the mean syllables of texts' words; they only start the estimate."""
    low, high = bounds
    third = GRADES // 3
    # The bounds fall on the edges of the thirds; beyond them the scale goes on at the same steps.
    return np.clip(np.floor(third + (mean - low) / (high - low) * third), 0, GRADES - 1).astype(np.int64)


class _Words(dict):
    """Place and syllables of each lower-case word; place -1: no plain word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 400_000:  # bounds a worker's memory; only speed depends on it
            self.clear()
        found = self[word] = (crc32(word.encode()) % PLACES if PLAIN_WORD.fullmatch(word) else -1, syllables(word))
        return found


def tokenised(df: DataFrame) -> DataFrame:
    """The texts (id, text) as numbers, written once: id, n_words (pieces between blanks), syllables (mean), places (of its words)."""
    key_type = df.schema["id"].dataType.simpleString()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            pieces, means, places, ends = [], [], [], [0]
            for t in batch.column(1).to_pylist():
                words = [known[w] for w in _WORD.findall(t.lower())]
                pieces.append(len(_PIECE.findall(t)))
                means.append(sum(n for _, n in words) / len(words) if words else None)
                places += [p for p, _ in words]
                ends.append(len(places))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int32()), pa.array(means, pa.float64()), column], ["id", "n_words", "syllables", "places"])

    return cut(df.select("id", "text").mapInArrow(numbers, f"id {key_type}, n_words int, syllables double, places array<int>"))


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all words of a batch, the row of each, and the mean syllables of the rows (NaN: no words)."""
    lists = batch.column(batch.schema.get_field_index("places"))
    sizes = np.diff(lists.offsets.to_numpy())
    means = batch.column(batch.schema.get_field_index("syllables")).to_numpy(zero_copy_only=False).astype(float)
    return lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), means


def text_quantiles(counts: np.ndarray) -> np.ndarray:
    """Linear quantiles of each row of counts per grade; those of a row without any mean nothing."""
    upto = counts.cumsum(axis=1)
    last = np.maximum(upto[:, -1:] - 1, 0)
    at = np.array(QUANTILES) * last
    low = np.floor(at)
    grade = lambda k: (upto[:, None, :] <= k[:, :, None]).sum(axis=2).clip(0, GRADES - 1)  # noqa: E731  grade of the k-th word
    below, above = grade(low), grade(np.minimum(low + 1, last))
    return below + (at - low) * (above - below)


class Scale:
    """The grades of places (-1: unknown) and the calibration from quantiles of a text's grades to a place on the scale."""

    def __init__(self, known: np.ndarray, weights: np.ndarray) -> None:
        self.known, self.weights = known, weights

    def features(self, places: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Quantiles of ``n`` texts and how many known words each has."""
        grades = np.where(places < 0, -1, self.known[places])
        seen = grades >= 0
        counts = np.bincount(rows[seen] * GRADES + grades[seen], minlength=n * GRADES).reshape(n, GRADES)
        return text_quantiles(counts), counts.sum(axis=1)

    def grade(self, features: np.ndarray) -> np.ndarray:
        return np.clip(features @ self.weights[:-1] + self.weights[-1], 0.0, GRADES - 1e-6)


def _grader(bounds: tuple[float, float], scale: Scale | None) -> Callable:
    """A function of a batch that gives whole grades of its texts (-1: none): by syllables, or by a scale."""

    def grades(places: np.ndarray, rows: np.ndarray, means: np.ndarray) -> np.ndarray:
        if scale is None:
            return np.where(np.isnan(means), -1, first_grade(np.nan_to_num(means), bounds))
        features, n = scale.features(places, rows, len(means))
        return np.where(n > 0, scale.grade(features).astype(np.int64), -1)

    return grades


def _known(texts: DataFrame, bounds: tuple[float, float], scale: Scale | None) -> np.ndarray:
    """The grade at which the words of each place are acquired, by how their uses are spread over the graded texts."""
    shared = texts.sparkSession.sparkContext.broadcast(scale)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = _grader(bounds, shared.value)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            places, rows, means = _batch(batch)
            # Words that are not plain count in a grade's total under place -1.
            of_text = grades(places, rows, means)[rows]
            new, n = np.unique((places.astype(np.int64) * GRADES + of_text)[of_text >= 0], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    uses = texts.select("syllables", "places").where("syllables IS NOT NULL").mapInArrow(counted, "key long, n long")
    place, grade = F.floor(F.col("key") / GRADES), F.pmod("key", F.lit(GRADES))
    uses = cut(uses.groupBy("key").agg(F.sum("n").alias("n")).select(place.cast("int").alias("place"), grade.cast("int").alias("grade"), "n"))
    total = {r[0]: float(r[1]) for r in uses.groupBy("grade").agg(F.sum("n")).collect()}
    rate = [F.coalesce(F.max(F.when(F.col("grade") == g, F.col("n"))), F.lit(0)) / F.lit(max(total.get(g, 0.0), 1.0)) for g in range(GRADES)]
    by_place = uses.where("place >= 0").groupBy("place").agg(F.sum("n").alias("uses"), *[r.alias(f"r{g}") for g, r in enumerate(rate)])
    rates = [F.col(f"r{g}") for g in range(GRADES)]
    whole = sum(rates[1:], rates[0])
    found: Column = F.lit(GRADES - 1)
    for g in range(GRADES - 2, -1, -1):
        found = F.when(sum(rates[1 : g + 1], rates[0]) >= whole * ACQUIRED, g).otherwise(found)
    table = by_place.where(F.col("uses") >= LEAST_USES).select("place", found.cast("tinyint").alias("grade")).toArrow()
    out = np.full(PLACES, -1, np.int8)
    out[table.column("place").to_numpy()] = table.column("grade").to_numpy()
    return out


def _calibrated(texts: DataFrame, known: np.ndarray, bounds: tuple[float, float], scale: Scale | None) -> np.ndarray:
    """Least-squares weights from quantiles to the present grades, from sums that each task makes over all texts."""
    size = len(QUANTILES) + 1
    shared = texts.sparkSession.sparkContext.broadcast((known, scale))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, grades = Scale(shared.value[0], np.zeros(size)), _grader(bounds, shared.value[1])
        # Each of the three levels counts alike, as their shares of the corpus differ.
        sums = np.zeros((3, size + 1, size + 1))
        for batch in batches:
            places, rows, means = _batch(batch)
            features, n = fresh.features(places, rows, len(means))
            y = grades(places, rows, means)
            use = (n > 0) & (y >= 0)
            x = np.column_stack([features, np.ones(len(y)), y + 0.5])[use]
            for level in range(3):
                own = x[np.minimum(2, y[use] * 3 // GRADES) == level]
                sums[level] += own.T @ own
        flat = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    total = np.zeros(3 * (size + 1) ** 2)
    parts = texts.select("syllables", "places").where("syllables IS NOT NULL").mapInArrow(summed, "i int, x double")
    for i, x in parts.groupBy("i").agg(F.sum("x")).collect():  # three small matrices
        total[i] = x
    total = total.reshape(3, size + 1, size + 1)
    joint = sum((t / t[size - 1, size - 1] for t in total if t[size - 1, size - 1] > 0), np.zeros((size + 1, size + 1)))
    return np.linalg.solve(joint[:size, :size] + 1e-3 * np.eye(size), joint[:size, size])


def fit_scale(texts: DataFrame, bounds: tuple[float, float] = SYLLABLE_BOUNDS) -> Scale:
    """A scale from all ``tokenised`` texts, graded at first by the syllables of their words (``bounds``: mean syllables at which one
    level passes into the next).

    The grade at which a word is acquired comes from how its uses are spread over the graded texts; quantiles of the
    grades of a text's words then grade the text anew, and the words are graded a second time from that. Counts cover
    all texts and are summed in the tasks before anything is shuffled.
    """
    known = _known(texts, bounds, None)
    scale = Scale(known, _calibrated(texts, known, bounds, None))
    again = _known(texts, bounds, scale)
    return Scale(again, _calibrated(texts, again, bounds, scale))


def reading_levels(
    df: DataFrame, id_column: str = "id", text_column: str = "question_text", least_words: int = 40, scale: Scale | None = None
) -> DataFrame:
    """The reading level of each text.

    Result, one row per id: id, n_words (pieces between blanks, tabs and line breaks), known_share (of its words),
    grade (0 to ``GRADES``), level ('basico', 'medio', 'avancado'; null below ``least_words`` or without a known word).

    ``scale`` is fitted on all texts of ``df`` unless given. The level is that of the words as a whole: quantiles of
    word grades, so neither long sentences nor single learned words decide it.

    Edge cases: null and empty texts have 0 words and no level; rows delivered twice (same id) give one row; unknown
    words, numbers and damaged words do not count; equal texts get equal levels; extra columns are ignored.
    """
    texts = tokenised(df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    shared = df.sparkSession.sparkContext.broadcast(scale or fit_scale(texts))

    def levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows, means = _batch(batch)
            features, known = shared.value.features(places, rows, len(means))
            grade, n_words = shared.value.grade(features), batch.column(1).to_numpy()
            size = np.bincount(rows, minlength=len(means))
            level = np.array(LEVELS)[np.minimum(2, (grade * 3 / GRADES).astype(int))]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(known / np.maximum(size, 1), mask=size == 0),
                pa.array(grade, mask=known == 0),
                pa.array(level, pa.string(), mask=(known == 0) | (n_words < least_words)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "known_share", "grade", "level"])

    key_type = df.schema[id_column].dataType.simpleString()
    schema = f"id {key_type}, n_words int, known_share double, grade double, level string"
    return texts.mapInArrow(levelled, schema).dropDuplicates(["id"])


def level_profile(levels: DataFrame, subjects: DataFrame, id_column: str = "id", subject_column: str = "subject") -> DataFrame:
    """Texts and mean grade per subject (compared without regard to case, accents and separators) and level."""
    plain = F.translate(F.lower(F.col(subject_column)), "áàâãéêíóôõúüç", "aaaaeeiooouuc")
    name = F.regexp_replace(F.regexp_replace(plain, r"^subject\.", ""), r"[^a-z0-9]+", " ")
    named = subjects.select(F.col(id_column).alias("id"), F.trim(name).alias("subject")).dropDuplicates(["id"])
    return (
        levels.where(F.col("level").isNotNull())
        .join(named, "id")
        .groupBy("subject", "level")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.avg("grade").alias("mean_grade"))
    )
