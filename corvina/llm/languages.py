"""Language of texts and of their passages by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANGUAGES = ("pt", "es", "en", "fr", "it")

#: Spellings of each language in labels, after lower-casing and cutting off region and script.
SPELLINGS = {
    "pt": ("pt", "por", "ptb", "portugues", "português", "portuguese", "portugais", "portoghese"),
    "es": ("es", "spa", "esp", "espanol", "español", "espanhol", "spanish", "castellano", "espagnol", "spagnolo"),
    "en": ("en", "eng", "ing", "ingles", "inglês", "inglés", "english", "anglais", "inglese"),
    "fr": ("fr", "fra", "fre", "frances", "francês", "francés", "french", "français", "francais", "francese"),
    "it": ("it", "ita", "italiano", "italian", "italien"),
}

BUCKETS = 1 << 16
#: Characters are in several n-grams each, so margins are divided by about that number.
OVERLAP = 4.0
#: Cost of a change of language between sentences, in units of the scores.
SWITCH = 16.0
#: The confidence is that of so many words of average evidence in the segment, as all its words together are nearly always sure.
STRETCH = 1
#: Passages of fewer words do not count as a language of the text.
LEAST_WORDS = 10
#: A lead over the second language of less than this per word marks a segment as ambiguous.
CLOSE = 1.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE_END = re.compile(r"(?:[.!?…;:]+[\"'»”’)]*\s+|\s*\n\s*|\s*[«»“”]\s*)")


def label_language(column: str | Column) -> Column:
    """The language that a label names, whatever its spelling; null for fillers and all other languages."""
    c = F.col(column) if isinstance(column, str) else column
    base = F.regexp_extract(F.lower(c), r"^\s*([^\s\-_,;.()]+)", 1)
    out = F.lit(None).cast("string")
    for language, names in SPELLINGS.items():
        out = F.when(base.isin(*names), language).otherwise(out)
    return out


def codewords(classes: int) -> np.ndarray:
    """All splits of the classes into two sides, as columns of +1 and -1 (the first class is always on the + side)."""
    columns = [c for c in product((1, -1), repeat=classes - 1) if -1 in c]
    return np.array([(1, *c) for c in columns], dtype=np.float32).T


def grams(word: str) -> list[int]:
    """Hashed n-grams of 1 to 4 characters of a padded word, and the word."""
    padded = f"^{word}$"
    parts = [padded] + [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)] + list(word)
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of the sentences of a text, in order; those without words join the one before."""
    out: list[tuple[int, int, list[str]]] = []
    at = 0
    cuts = [m.end() for m in _SENTENCE_END.finditer(text)]
    for end in [*cuts, len(text)]:
        if end <= at:
            continue
        words = _WORD.findall(text[at:end].lower())
        if words or not out:
            out.append((at, end, words))
        else:
            out[-1] = (out[-1][0], end, out[-1][2])
        at = end
    return out


class Model:
    """Binary n-gram classifiers, one per bit of the codewords, and their weights in decoding."""

    def __init__(self, weights: np.ndarray, trust: np.ndarray) -> None:
        self.weights, self.trust = weights, trust
        self.code = codewords(len(LANGUAGES))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((1024, self.code.shape[1]), dtype=np.float32)

    def _learn(self, word: str) -> int:
        n = self.place[word] = len(self.place)
        if n == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[n] = self.weights[grams(word)].sum(axis=0) / OVERLAP
        return n

    def margins(self, parts: list[list[str]]) -> np.ndarray:
        """Margins of each list of words: the sums over its words, each of which is worked out once per worker."""
        if len(self.place) > 300_000:  # bounds a worker's memory; only speed depends on it
            self._forget()
        place = self.place.get
        at = [i if (i := place(w)) is not None else self._learn(w) for words in parts for w in words]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        out = np.zeros((len(parts), self.code.shape[1]), dtype=np.float32)
        if at:
            full = np.flatnonzero(sizes)
            out[full] = np.add.reduceat(self.known[at], (np.cumsum(sizes) - sizes)[full])
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: minus the logistic losses of each codeword's bits, weighted by the trust in each bit."""
        z = margins[:, None, :] * self.code[None]
        return -(np.logaddexp(0, -z) * self.trust[None]).sum(axis=2)


def fit(texts: Iterable[tuple[str, str]], rounds: int = 3) -> Model:
    """A model from (text, language) pairs whose labels may be partly wrong.

    Each bit's classifier weighs n-grams by the log-odds of the two sides, every language counting alike. After each
    round the sentences take the language that the model gives them, as wrong labels and mixed texts would spoil it.
    """
    docs = [(parts, LANGUAGES.index(label)) for text, label in texts if (parts := [w for _, _, w in sentences(text) if w])]
    units = [words for parts, _ in docs for words in parts]
    edges = np.cumsum([0] + [len(parts) for parts, _ in docs])
    code = codewords(len(LANGUAGES))
    cache: dict[str, list[int]] = {}
    labels = np.repeat([label for _, label in docs], np.diff(edges)).astype(int)
    model = Model(np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones_like(code) / code.shape[1])
    for _ in range(rounds):
        share = np.zeros((len(LANGUAGES), BUCKETS))
        # Every distinct sentence counts once, in the language it has most often; so copies have no more weight.
        votes: dict[tuple[str, ...], Counter] = {}
        for words, label in zip(units, labels, strict=True):
            votes.setdefault(tuple(words), Counter())[int(label)] += 1
        for c in range(len(LANGUAGES)):
            used: Counter = Counter()
            for words, counted in votes.items():
                if max(counted, key=lambda x, counted=counted: (counted[x], -x)) == c:
                    used.update(words)
            for word, n in used.items():
                if word not in cache:
                    cache[word] = grams(word)
                np.add.at(share[c], cache[word], n)
            share[c] = (share[c] + 0.05) / (share[c].sum() + 0.05 * BUCKETS)
        plus, minus = (code > 0).astype(float), (code < 0).astype(float)
        weights = np.log(plus.T @ share / plus.sum(axis=0)[:, None]) - np.log(minus.T @ share / minus.sum(axis=0)[:, None])
        trust = np.ones_like(code) / code.shape[1]
        model = Model(weights.T.astype(np.float32), trust)
        if not len(units):
            break
        margins = model.margins(units)
        scores = model.scores(margins)
        guess = np.concatenate([_path(scores[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        right = np.array([[((margins[guess == c] * code[c]) > 0)[:, b].mean() if (guess == c).any() else 1.0 for b in range(code.shape[1])] for c in range(len(code))])
        model.trust = (right / np.maximum(right.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32) * code.shape[1] / 4
        labels = guess
    return model


def _path(scores: np.ndarray) -> np.ndarray:
    """The best sequence of languages over sentences, a change costing ``SWITCH``."""
    n, k = scores.shape
    if n == 1 or (scores.argmax(axis=1) == scores[0].argmax()).all():
        return scores.argmax(axis=1)
    total, back = scores[0].copy(), np.zeros((n, k), dtype=int)
    for i in range(1, n):
        best = int(total.argmax())
        stay = total >= total[best] - SWITCH
        back[i] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] - SWITCH) + scores[i]
    path = np.empty(n, dtype=int)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label_text(text: str | None, model: Model) -> tuple[str | None, float | None, bool | None, list[dict]]:
    """Main language, its confidence, whether it is ambiguous, and the passages of a text."""
    parts = sentences(text) if text else []
    if not any(words for _, _, words in parts):
        return None, None, None, []
    scores = model.scores(model.margins([words for _, _, words in parts]))
    path = _path(scores)

    def runs(path: np.ndarray) -> list[list[int]]:
        edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        return [[int(a), int(b), sum(len(parts[i][2]) for i in range(a, b))] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    # Passages that are too short take the language of the longer neighbour, the shortest first.
    while len(found := runs(path)) > 1:
        short = min((r for r in found if r[2] < LEAST_WORDS), key=lambda r: r[2], default=None)
        if short is None:
            break
        i = found.index(short)
        near = [found[j] for j in (i - 1, i + 1) if 0 <= j < len(found)]
        path[short[0] : short[1]] = path[max(near, key=lambda r: r[2])[0]]
    segments, words_of = [], Counter()
    for a, b, n in found:
        s = scores[a:b].sum(axis=0)
        c = int(path[a])
        other = np.delete(s, c).max()
        odds = np.exp((s - s.max()) * min(1.0, STRETCH / max(1, n)))
        segments.append(
            {
                "start": parts[a][0],
                "end": parts[b - 1][1],
                "n_words": n,
                "language": LANGUAGES[c],
                "confidence": float(odds[c] / odds.sum()),
                "ambiguous": bool((s[c] - other) / max(1, n) < CLOSE),
            }
        )
        words_of[LANGUAGES[c]] += n
    main = max(LANGUAGES, key=lambda x: words_of[x])
    own = [s for s in segments if s["language"] == main]
    weight = sum(s["n_words"] for s in own)
    confidence = sum(s["confidence"] * s["n_words"] for s in own) / weight if weight else own[0]["confidence"]
    return main, float(confidence), all(s["ambiguous"] for s in own), segments


def training_sample(df: DataFrame, id_column: str, text_column: str, label_column: str, per_label: int) -> list[tuple[str, str]]:
    """Up to ``per_label`` texts per language that a label names, chosen by a hash of the id."""
    label = label_language(label_column)
    counts = {r[0]: r[1] for r in df.groupBy(label.alias("l")).agg(F.count(F.lit(1))).collect() if r[0] is not None}
    span = 1 << 40
    # Tasks keep the share of each language that gives twice the bound, so a large table sends no more than a small one.
    cutoff: Column = F.lit(0)
    for language, n in counts.items():
        cutoff = F.when(F.col("l") == language, int(min(1.0, 2 * (per_label + 20) / n) * span)).otherwise(cutoff)
    hashed = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(span))
    labelled = df.select(hashed.alias("h"), F.col(text_column).alias("t"), label.alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = labelled.where(F.col("h") <= cutoff).withColumn("r", first).where(F.col("r") <= per_label).select("t", "l").collect()
    return sorted((r[0], r[1]) for r in rows)


def label_languages(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    per_label: int = 150,
    model: Model | None = None,
) -> DataFrame:
    """The language of each text and of each of its passages, whatever the label says.

    Result, one row per row of ``df``: id, label (the language the label names, null if none of ours), language (of
    most words), confidence (0 to 1), ambiguous, segments (array of start, end, n_words, language, confidence,
    ambiguous, which cover the text in order).

    Without ``model`` one is fitted on at most ``per_label`` labelled texts per language, wrong labels among them. The
    texts are then labelled in place, sentence by sentence with a cost for changing the language, without a shuffle.

    Edge cases: null texts and texts without words have no language and no segments; texts of fewer than ten words get
    one language; equal texts get equal results; rows delivered twice appear twice; extra columns are ignored.
    """
    key_type = df.schema[id_column].dataType.simpleString()
    fitted = model or fit(training_sample(df, id_column, text_column, label_column, per_label))
    shared = df.sparkSession.sparkContext.broadcast((fitted.weights, fitted.trust))
    segment = "struct<start:int, `end`:int, n_words:int, language:string, confidence:double, ambiguous:boolean>"

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            rows = [label_text(t, model) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["language", "confidence", "ambiguous", "segments"])
            yield pd.concat([batch[["id", "label"]].reset_index(drop=True), out], axis=1)

    narrow = df.select(F.col(id_column).alias("id"), label_language(label_column).alias("label"), F.col(text_column).alias("text"))
    schema = f"id {key_type}, label string, language string, confidence double, ambiguous boolean, segments array<{segment}>"
    return narrow.mapInPandas(labelled, schema)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """(id, language) of texts whose label is missing or names another language, or that have passages in several."""
    kinds = F.array_distinct(F.transform("segments", lambda s: s["language"]))
    cases = labelled.select("id", "label", "language", kinds.alias("kinds")).where(
        F.col("language").isNotNull() & (F.col("label").isNull() | (F.col("label") != F.col("language")) | (F.size("kinds") > 1))
    )
    return cases.select("id", F.explode("kinds").alias("language"))
