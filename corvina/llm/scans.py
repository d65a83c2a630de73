"""Repairs text extracted from scanned pages: divided words, misread characters, running headers, page numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.operators.ranking import smallest_last
from corvina.operators.skew import meet
from corvina.session import cut

# Glyphs that recognition takes for one another. Wide letters are spelt as the pairs they are taken
# for, so that both readings have one skeleton.
WIDE = [("m", "rn"), ("d", "cl"), ("u", "ii"), ("h", "li"), ("ç", "c,"), ("ã", "a~"), ("õ", "o~"), ("ﬁ", "fi"), ("ﬂ", "fl")]
ALIKE = {ord(k): v for k, v in {"0": "o", "@": "a", "5": "s", "$": "s", "!": "i", "1": "l", "|": "l", "9": "g"}.items()}
MERGED = {ord("c"): "e", ord("f"): "t"}
#: Signs that stand for letters only in misread words.
ODD = "0159!|@~,$ﬁﬂ"

# Small words of running headers and page numbers.
PAGE_WORDS = {"dia", "p", "pp", "pag", "pg", "pgina", "pagina", "fl", "fls", "folha", "caderno", "cad", "prova", "versão", "v"}

#: Bits of the filter that is broadcast, whatever the size of the vocabulary. It only tells which words, pairs and lines need a
#: look; what passes it by chance is found out in the join with the facts.
FILTER_BITS = 1 << 24
#: A form is misread if the usual form of its skeleton is at least so many times as frequent, and used so often.
RATIO, LEAST_USES = 15, 8
#: Words are spread over so many groups where they meet their pairs.
SALTS = 16
#: A header's line, its digits masked, must stand in so many places.
LEAST_LINES = 3
#: A line goes on from the one before if the pair of words over the break has at least this share of the uses of either word.
JOINED = 0.2

# Fixed value: first parts of compounds whose hyphen stays when they are divided there.
COMPOUND = "guarda|bem|bem-te|pós|pré|ex|vice|recém|beija|couve|arco|segunda|terça|quarta|quinta|sexta"

_EDGES = ".,;:?!…\"'“”‘’«»()[]{}—–-‐¬­*_/"
_HEADING = re.compile(r"(?i)^\s*(?:\*\*)?quest[ãa]o\s*\d+")
_OPTION = re.compile(r"^\s*\(?[A-E]\)\s")
_ROMAN = re.compile(r"^(?=[ivxlc]{2,}$|[vx]$)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_STRANGE = re.compile(r"[^\w" + re.escape(ODD + "-'’") + "]")
_LETTER_WORD = re.compile(r"[^\W\d_ªº]+")
# A small word within a line that only prose has; such lines are no headers.
_PROSE = re.compile(r"(?<!\S)(?!dia\s|caderno\s|folha\s|prova\s)[a-záàâãéêíóôõúç]{2,}[,;]?\s+\w|^\s*$")


def skeleton(word: str) -> str:
    """What a lower-case word looks like: equal for words that differ by confusable glyphs only."""
    word = word.translate(ALIKE)
    for one, two in WIDE:
        word = word.replace(one, two)
    return word.translate(MERGED)


class _Plain(dict):
    """Words without the marks around them, by the pieces between blanks; numbers become one word."""

    def __missing__(self, piece: str) -> str:
        if len(self) > 400_000:  # bounds a worker's memory; only speed depends on it
            self.clear()
        w = piece.strip(_EDGES)
        w = self[piece] = "#" if w and w[0].isdigit() and not any(c.isalpha() for c in w) else w
        return w


_plain = _Plain()


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w for piece in text.lower().split() if (w := _plain[piece])]


def pair_key(one: str, two: str) -> int:
    data = f"{one}\x1f{two}".encode()
    return (crc32(data) << 31) ^ crc32(data[::-1])


def squash(line: str) -> str:
    """ASCII characters only, so that a header is the same line with and without encoding damage."""
    return line.encode("ascii", "ignore").decode().replace("?", "")


def mask(line: str) -> str:
    """A squashed line with its digits masked."""
    return re.sub(r"\d+", "#", " ".join(squash(line).split()))


def divided_at(line: str) -> str:
    """The letter and the mark of division at the end of a line, or nothing."""
    end = line.rstrip(" \t\r")[-2:]
    return end if len(end) == 2 and end[1] in "-‐¬\xad" and end[0].isalpha() else ""


def header_shape(line: str) -> int:
    """2: surely page furniture by its form, 1: perhaps, 0: not. Only lines that are frequent can be headers."""
    if len(line) > 120 or _PROSE.search(line):
        return 0
    text = squash(line).strip()
    if not text or _PROSE.search(text) or _HEADING.match(line) or _OPTION.match(text):
        return 0
    last = line.rstrip()[-2:]
    if last[-1] in ".,;:!?" or last[-1] in "-‐¬\xad" and last[0].isalpha():
        return 0
    words = _LETTER_WORD.findall(text)
    digits = any(c.isdigit() for c in text)
    if _ROMAN.match(text):
        return 2
    if not words:
        return 2 if digits and re.fullmatch(r"[\W_]*\d+(?:\s*/\s*\d+)?[\W_]*", text) and not re.search(r"[%$€°²³=+×÷√≤≥½π]", line) else 0
    if digits and re.search(r"\w_\w.*\.\w{3,4}\b", text):
        return 2  # the name of a typesetter's file
    if any(w[0].islower() and w.lower() not in PAGE_WORDS for w in words):
        return 0
    if digits:
        paged = any(w.lower() in PAGE_WORDS for w in words)
        if paged or re.fullmatch(r"\*\d+[A-Z]+\d+\*", text):
            return 2
        # The start of a sentence, several sentences, or a misread word are prose.
        return 1 if sum(map(len, words)) > 3 and not re.search(r"[A-Za-z]{3}[.!?] |[a-z]\d", text) else 0
    return 1 if len(words) > 1 and all(w.isupper() for w in words) and not re.search(r"[.!?] ", text) else 0


def shaped_lines(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text and the ``header_shape`` of each; a single line is no header."""
    raw = [line.rstrip("\r") for line in text.split("\n")] if "\r" in text else text.split("\n")
    prose = _PROSE.search
    return raw, [0 if len(line) > 120 or prose(line) else header_shape(line) for line in raw] if len(raw) > 1 else [0]


def may_end_in_header(line: str) -> bool:
    """A quick look at the last word of a line."""
    last = line.rpartition(" ")[2]
    return not last or last[-1] not in ".,;:!?" and (last[-1].isdigit() or last[0].isupper() or last[0] == "*" or last[-1].isspace())


def header_ends(line: str) -> Iterator[tuple[int, str]]:
    """The last words of a line of text that may be a header of two words or more: how many, and masked; the longest first."""
    last = line.rsplit(None, 1)[-1:]
    if not last or last[0][-1] in ".,;:!?-‐¬\xad" or not (last[0][-1].isdigit() or last[0][0].isupper() or last[0][0] == "*"):
        return
    words = line.split()
    if len(words) < 3:
        return
    for k in range(min(14, len(words) - 1), 0, -1):
        m = mask(" ".join(words[-k:]))
        if sum(map(str.isalpha, m)) > 2 and (" " in m or not m[0].isalnum() and not m[-1].isalnum()):
            yield k, m


def without_end(line: str, words: int) -> str:
    """A line without its last words."""
    return re.match(rf"(?s).*?(?=(?:\s+\S+){{{words}}}\s*$)", line).group()


def joined_word(line: str, following: str) -> str:
    """The last piece of a line and the first one of the next, as a word."""
    tail, head = re.search(r"(\S*?)[-‐¬­]?\s*$", line.rstrip()), re.match(r"\S*", following.lstrip())
    return (tail.group(1) + head.group()).lower().strip(_EDGES)


class _Places(dict):
    """A number for the word of each piece between blanks; -1 where there is none."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        word = _plain[piece]
        n = self[piece] = self.words.setdefault(word, len(self.words)) if word else -1
        return n


class Counts:
    """Counts that a task sums before anything leaves it. Words are numbered, so that those of many texts are counted at once."""

    def __init__(self) -> None:
        self.places = _Places()
        self.waiting: list[int] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.lines: Counter = Counter()

    def add(self, text: str) -> None:
        self.waiting += map(self.places.__getitem__, text.lower().split())
        self.waiting.append(-2)  # pairs end with the text
        if "\n" in text:
            self.lines.update({mask(line) for line, shape in zip(*shaped_lines(text), strict=True) if shape})
        if len(self.waiting) > 1_000_000:
            self.sum()

    def sum(self) -> None:
        ids = np.array(self.waiting, dtype=np.int64)
        ids = ids[ids != -1]
        self.waiting = []
        one, two = ids[:-1], ids[1:]
        inside = (one >= 0) & (two >= 0)
        for found, new in ((self.words, ids[ids >= 0]), (self.pairs, one[inside] << 32 | two[inside])):
            keys, n = np.unique(new, return_counts=True)
            if found:
                old = found.pop()
                keys, back = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                n = np.bincount(back, np.concatenate([old[1], n]), len(keys)).astype(np.int64)
            found.append((keys, n))

    def size(self) -> int:
        return len(self.places) + len(self.lines) + sum(len(k) for k, _ in self.pairs)

    def rows(self) -> pd.DataFrame:
        self.sum()
        names = np.array(list(self.places.words) or [""], dtype=object)
        (words, n), (pairs, m) = self.words[0], self.pairs[0]
        lines = list(self.lines.items())
        return pd.DataFrame(
            {
                "kind": ["w"] * len(words) + ["p"] * len(pairs) + ["l"] * len(lines),
                "a": np.concatenate([names[words], names[pairs >> 32], np.array([x for x, _ in lines], dtype=object)]),
                "b": np.concatenate([np.full(len(words), "", object), names[pairs & 0xFFFFFFFF], np.full(len(lines), "", object)]),
                "n": np.concatenate([n, m, np.array([x for _, x in lines], dtype=np.int64)]).astype(np.int64),
            }
        )


class Known:
    """What reading one text looks up, by keys with a letter for the table.

    r: the right form of a misread word; b, a: pairs of a misread word of letters alone with the word before or after it, of which
    the right form supports; l: header lines; w, p: uses of words and pairs; k: the usual form of a skeleton and its uses.
    """

    def __init__(self, found: str | None) -> None:
        """``found``: keys and values, each after the ``_GAP`` that ends the one before."""
        parts = found.split(_GAP) if found else []
        self.found = dict(zip(parts[::2], parts[1::2], strict=True))
        self.misread_words = {k[1:] for k in self.found if k[0] == "r"}
        self.lines = {k[1:] for k in self.found if k[0] == "l"}

    def uses(self, word: str) -> int:
        return int(self.found.get("w" + word, 0))

    def misread(self, before: str, word: str, after: str) -> str | None:
        """The right form of a misread word, or null. Letters alone need support from a word beside it."""
        right = self.found.get("r" + word)
        if right is None or is_odd(word) or "b" + pair(before, word) in self.found or "a" + pair(word, after) in self.found:
            return right
        return None

    def joined(self, word: str) -> str | None:
        """The right form of a word put together from two pieces, whether it is used elsewhere or not."""
        usual, _, n = self.found.get("k" + skeleton(word), "").partition(_SEP)
        return usual if n and usual != word and may_be_misread(word) and len(usual) >= least_length(word) and int(n) >= max(LEAST_USES, RATIO * self.uses(word)) else None

    def continues(self, one: str, two: str) -> bool:
        """Whether two words belong together so often that a line break between them is within a text."""
        n = int(self.found.get("p" + pair(one, two), 0))
        return n > 2 and (n >= JOINED * (self.uses(one) or 1) or n >= JOINED * (self.uses(two) or 1))


#: Between the words of a pair, and between the keys and values of one text.
_SEP, _GAP = "\x1f", "\x1d"


def pair(one: str, two: str) -> str:
    return one + _SEP + two


def is_odd(word: str) -> bool:
    """Whether a word has a sign among its letters that stands for a letter only in misread words."""
    return any(c in ODD for c in word) and any(c.isalpha() for c in word)


def least_length(word: str) -> int:
    return 2 if any(c in ODD for c in word) else 3


def may_be_misread(word: str) -> bool:
    return any(c.isalpha() for c in word) and not _STRANGE.search(word)


class Filter:
    """A set of keys in bits, one for each hash: what is not in it is surely not a key."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits
        self.fine: set[str] = set()  # pieces between blanks whose word is in no fact

    def maybe(self, key: str) -> bool:
        at = crc32(key.encode("utf-8", "replace")) % (len(self.bits) << 3)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def suspects(self, text: str) -> set[str]:
        """Words that may be misread."""
        out = set()
        if len(self.fine) > 400_000:  # bounds a worker's memory; only speed depends on it
            self.fine.clear()
        for piece in set(text.lower().split()) - self.fine:
            word = _plain[piece]
            if word and self.maybe("r" + word):
                out.add(word)
            else:
                self.fine.add(piece)
        return out

    def asks(self, text: str) -> set[str] | None:
        """The keys that ``read_lines`` of this text looks up, as far as they may be there; null if it is surely undamaged."""
        suspects = self.suspects(text)
        keys = self._misread_keys(text, suspects) if suspects else set()
        raw, shapes = shaped_lines(text)
        headers = [i for i, shape in enumerate(shapes) if shape and self.maybe("l" + mask(raw[i]))]
        ends = [
            [(k, m) for k, m in header_ends(line) if self.maybe("l" + m)] if not shape and may_end_in_header(line) else []
            for shape, line in zip(shapes, raw, strict=True)
        ]
        if not keys and not headers and not any(ends) and not any(map(divided_at, raw[:-1])):
            return None
        for i in headers:
            keys.add("l" + mask(raw[i]))
            for one, two in neighbours(raw, i) if shapes[i] == 1 else ():
                keys |= {"p" + pair(one, two), "w" + one, "w" + two}
            keys |= {"w" + w for w in rests(raw, i)}
        keys |= {"l" + m for found in ends for _, m in found}
        cuts = [[line, *(without_end(line, k) for k, _ in found)] for line, found in zip(raw, ends, strict=True)]  # with and without headers at the end
        for i, forms in enumerate(cuts):
            for line in forms:
                if divided_at(line):
                    for j in range(i + 1, len(raw)):
                        if raw[j].strip():
                            word = joined_word(line, raw[j])
                            if may_be_misread(word):
                                keys |= {"w" + word, "k" + skeleton(word)}
                            if j not in headers:  # else it may stand between the pieces
                                break
        return keys

    def _misread_keys(self, text: str, suspects: set[str]) -> set[str]:
        keys = set()
        for line in text.split("\n"):
            plain = [_plain[t] for t in line.lower().split()]
            for k, word in enumerate(plain):
                if word in suspects:
                    before, after = plain[k - 1] if k else "", plain[k + 1] if k + 1 < len(plain) else ""
                    beside = {x for x in ("b" + pair(before, word), "a" + pair(word, after)) if self.maybe(x)}
                    if beside or is_odd(word):
                        keys |= beside | {"r" + word}
        return keys


def _first(line: str) -> str:
    words = words_of(line[:60])
    return words[0] if words else ""


def _last(line: str) -> str:
    words = words_of(line[-60:])
    return words[-1] if words else ""


def read_lines(text: str, known: Known) -> tuple[list[dict], int, int, int]:
    """The lines of a text with their kinds and repairs, and how many words are divided, misread and lines are headers.

    Kinds: header, blank, heading, option, body. ``text`` of a line has its misread words replaced; ``divided`` tells
    that its last word goes on in the next body line, ``marked`` that a mark for that is to be dropped.
    """
    raw, shapes = shaped_lines(text)
    tails = [0 if shape else next((k for k, m in header_ends(line) if m in known.lines), 0) if known.lines else 0 for shape, line in zip(shapes, raw, strict=True)]
    kinds = []
    for i, line in enumerate(raw):
        shape = shapes[i]
        if shape and mask(line) in known.lines and not (shape == 1 and _inside(raw, i, known)) and not any(known.uses(w) for w in rests(raw, i)):
            kinds.append("header")
        elif not line.strip():
            kinds.append("blank")
        else:
            kinds.append("heading" if _HEADING.match(line) else "option" if _OPTION.match(line) else "body")
    for i, k in enumerate(tails):
        if k:
            raw[i] = without_end(raw[i], k)
    divided = [False] * len(raw)
    text_lines = [i for i, k in enumerate(kinds) if k not in ("header", "blank")]
    for i, j in zip(text_lines, text_lines[1:], strict=False):
        start = raw[j].lstrip()
        end = divided_at(raw[i])
        if not end or kinds[j] in ("heading", "option"):
            continue
        # Capitals go on in capitals; the marks that only division has may be followed by any letter.
        divided[i] = start[:1].islower() or start[:1].isalpha() and (end[1] in "¬\xad" or end[0].isupper() and start[:2].isupper())
    n_misread = 0
    after_piece = {j for i, j in zip(text_lines, text_lines[1:], strict=False) if divided[i]}
    out = []
    for i, line in enumerate(raw):
        fixed = line
        if known.misread_words and kinds[i] not in ("header", "blank") and any(_plain[t] in known.misread_words for t in line.lower().split()):
            fixed, n = _fix(line, known, i in after_piece, divided[i])
            n_misread += n
        out.append({"kind": kinds[i], "text": fixed.strip(), "divided": divided[i]})
    # Pieces of a divided word are judged together.
    for i, j in zip(text_lines, text_lines[1:], strict=False):
        if divided[i]:
            word = joined_word(raw[i], raw[j])
            if (any(c in ODD for c in word) or len(word) > 4) and known.joined(word) is not None:
                n_misread += 1
    return out, sum(divided), n_misread, kinds.count("header") + sum(map(bool, tails))


def _around(raw: list[str], i: int) -> tuple[str, str]:
    """The lines with text before and after a line; question headings count as none."""
    before = next((x for x in reversed(raw[:i]) if x.strip()), "")
    after = next((x for x in raw[i + 1 :] if x.strip()), "")
    before, after = ("" if _HEADING.match(x) else x for x in (before, after))
    return before, after


def neighbours(raw: list[str], i: int) -> list[tuple[str, str]]:
    """Pairs of words that meet at the breaks around a line, or would without it."""
    before, after = _around(raw, i)
    return [(_last(before), _first(raw[i])), (_last(raw[i]), _first(after)), (_last(before), _first(after))]


def _inside(raw: list[str], i: int, known: Known) -> bool:
    """Whether a line that looks like a header reads on from its neighbours."""
    before, after = _around(raw, i)
    into, out_of, past = neighbours(raw, i)
    capitals = lambda w: len(w) > 1 and w.isupper()
    words = _LETTER_WORD.findall(raw[i])
    if words and all(w.isupper() for w in words) and not any(c.isdigit() for c in raw[i]):
        near = [*_LETTER_WORD.findall(before)[-2:], *_LETTER_WORD.findall(after)[:2]]
        return any(map(capitals, near)) and (known.continues(*into) or known.continues(*out_of))
    if any(c.isdigit() or c == "#" for c in into[1]) or before.rstrip()[-1:] in ".!?:":
        return False
    return known.continues(*into) and not known.continues(*past)


def rests(raw: list[str], i: int) -> list[str]:
    """What a line of small letters (like a Roman number) may be the end of: a word divided in the line before."""
    if i == 0 or not raw[i].strip()[:1].islower() or not divided_at(raw[i - 1]):
        return []
    tail = re.search(r"(\S*?)([-‐¬­])\s*$", raw[i - 1]).group(1).lower().strip(_EDGES)
    rest = raw[i].strip()
    return [tail + rest, f"{tail}-{rest}"]


def _fix(line: str, known: Known, after_piece: bool, piece: bool) -> tuple[str, int]:
    """A line with its misread words replaced, and how many; pieces of divided words at its ends are left alone."""
    tokens = [(m.start(), m.group()) for m in re.finditer(r"\S+", line)]
    plain = [_plain[t.lower()] for _, t in tokens]
    out, at, n = [], 0, 0
    for k, ((start, token), word) in enumerate(zip(tokens, plain, strict=True)):
        if word not in known.misread_words or (k == 0 and after_piece) or (k == len(tokens) - 1 and piece):
            continue
        right = known.misread(plain[k - 1] if k else "", word, plain[k + 1] if k + 1 < len(plain) else "")
        if right is None:
            continue
        i = token.lower().find(word)
        new = right.capitalize() if token[i : i + 1].isupper() else right
        if len(word) > 2 and token[i : i + len(word)].isupper() and word.isalpha():
            new = right.upper()
        out += [line[at:start], token[:i], new, token[i + len(word) :]]
        at, n = start + len(token), n + 1
    return "".join(out) + line[at:], n


def count_uses(texts: DataFrame) -> DataFrame:
    """Uses over a column ``text`` of all records, written once: kind (w words, p pairs, l texts with a line), a, b, n.

    Tasks sum their own texts first.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for batch in batches:
            for t in batch["text"]:
                counts.add(t)
            if counts.size() > 600_000:  # a task's memory stays bounded; the rest is summed later
                yield counts.rows()
                counts = Counts()
        yield counts.rows()

    return cut(texts.mapInPandas(counted, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))


def skeleton_of(word: Column) -> Column:
    """``skeleton`` as a column."""
    out = F.translate(word, "".join(map(chr, ALIKE)), "".join(ALIKE.values()))
    for one, two in WIDE:
        out = F.replace(out, F.lit(one), F.lit(two))
    return F.translate(out, "".join(map(chr, MERGED)), "".join(MERGED.values()))


class Facts:
    """All that reading texts may look up, in tables: ``table`` (key, value; see ``Known``), and ``bits`` of a filter of those keys
    that decide whether a text needs a look."""

    def __init__(self, table: DataFrame, bits: bytes) -> None:
        self.table, self.bits = table, bits


def learn(texts: DataFrame, filter_bits: int = FILTER_BITS) -> Facts:
    """The facts of a column ``text`` of all records.

    Words are grouped by their skeleton; the usual form is the most frequent one (ties: alphabetical). A word is misread if the
    usual form of its skeleton is at least ``RATIO`` times as frequent. All of it are aggregates and joins over the vocabulary, which
    may have any size; only the filter's bits (a multiple of 64) reach the driver.
    """
    uses = count_uses(texts)
    kind = lambda k, least=1: uses.where((F.col("kind") == k) & (F.col("n") >= least))
    odd = F.col("a").rlike("[" + ODD + "]")
    words = kind("w").where(F.col("a").rlike(r"(?U)\p{Alpha}")).select("a", "n", skeleton_of(F.col("a")).alias("s"), odd.alias("odd"))
    best = F.max_by(F.struct("a", "n"), F.struct("n", smallest_last(F.col("a"))))
    usual = words.where("NOT odd").groupBy("s").agg(best.alias("u")).select("s", F.col("u.a").alias("right"), F.col("u.n").alias("m"))
    strange = F.col("a").rlike(r"(?U)[^\w\p{N}" + re.escape(ODD + "-'’") + "]")
    misread = cut(
        words.join(usual, "s")
        .where((F.col("a") != F.col("right")) & ~strange & (F.length("right") >= F.when(F.col("odd"), 2).otherwise(3)))
        .where(F.col("m") >= F.greatest(F.lit(LEAST_USES), RATIO * F.col("n")))
        .select("a", "right", "odd")
    )
    # Pairs of a misread word of letters alone that the right form has too. Much used words are in very many pairs, hence the salt.
    alone = misread.where("NOT odd").select(F.col("a").alias("wrong"), "right", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs, often = kind("p"), kind("p", 3)
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    before = pairs.select("a", F.col("b").alias("wrong"), salt("a")).join(alone, ["wrong", "salt"]).join(often.select("a", F.col("b").alias("right")), ["a", "right"])
    after = pairs.select("b", F.col("a").alias("wrong"), salt("b")).join(alone, ["wrong", "salt"]).join(often.select("b", F.col("a").alias("right")), ["b", "right"])
    key = lambda k, *c: F.concat(F.lit(k), *c).alias("key")
    sep, none, n = F.lit(_SEP), F.lit("").alias("value"), F.col("n").cast("string").alias("value")
    deciding = cut(
        misread.select(key("r", "a"), F.col("right").alias("value"))
        .unionByName(before.select(key("b", "a", sep, "wrong"), none))
        .unionByName(after.select(key("a", "wrong", sep, "b"), none))
        .unionByName(kind("l", LEAST_LINES).select(key("l", "a"), none))
    )
    at = F.pmod(F.crc32("key"), F.lit(filter_bits))
    long = F.shiftright(at, 6).cast("int").alias("i")
    masks = deciding.groupBy(long).agg(F.expr("bit_or(shiftleft(1L, CAST(pmod(crc32(key), 64) AS INT)))").alias("x")).toArrow()
    bits = np.zeros(filter_bits >> 6, dtype="<i8")
    bits[masks.column("i").to_numpy()] = masks.column("x").to_numpy()
    table = (
        deciding.unionByName(kind("w").select(key("w", "a"), n))
        .unionByName(often.select(key("p", "a", sep, "b"), n))
        .unionByName(usual.select(key("k", "s"), F.concat_ws(_SEP, "right", F.col("m").cast("string")).alias("value")))
    )
    return Facts(table, bits.tobytes())


def suspicious(df: DataFrame, facts: Facts, id_column: str, text_column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose text may be damaged, written once: ``keep``, id, _text, _keys (what the text looks up, in one string), _h (digest of the text)."""
    key_type = df.schema[id_column].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(facts.bits)
    narrow = df.select(*keep, F.col(id_column).alias("id"), F.col(text_column).alias("_text")).where(F.length("_text") > 0)

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(shared.value)
        for batch in batches:
            keys = [known.asks(t) for t in batch["_text"]]
            at = [i for i, k in enumerate(keys) if k is not None]
            yield batch.iloc[at].assign(_keys=pd.Series([_GAP.join(keys[i]) for i in at], batch.index[at], object))

    head = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    return cut(narrow.mapInPandas(asking, f"{head}id {key_type}, _text string, _keys string").withColumn("_h", F.md5("_text")))


def answers(asked: DataFrame, table: DataFrame) -> DataFrame:
    """What the texts (_h, _keys) look up and is in ``table`` (key, value), one row per text that finds any: _h, _answers.

    Only keys that are asked for meet the table, each once; a key that very many texts ask for meets them in a broadcast.
    """
    keys = cut(asked.where("_keys != ''").select("_h", F.explode(F.split("_keys", _GAP)).alias("key")).distinct())
    found = cut(keys.select("key").distinct().join(table, "key"))
    one = F.concat_ws(_GAP, "key", "value")
    return cut(meet(keys, found, "key").groupBy("_h").agg(F.array_join(F.collect_list(one), _GAP).alias("_answers")))


#: Lines travel to the windows as one string: a letter for the kind, one for how the line ends, and the text.
_END, _KINDS = "\x1e", {"body": "b", "heading": "h", "option": "o"}


def pack_lines(lines: list[dict]) -> str:
    """Lines of text as one string, without headers and blank lines."""
    kept = (x for x in lines if x["kind"] in _KINDS)
    return _END.join(f"{_KINDS[x['kind']]}{'-' if x['divided'] else ' '}{x['text'].replace(_END, ' ')}" for x in kept)


def find_damage(df: DataFrame, facts: Facts, id_column: str = "id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Damaged texts only: ``keep``, id, n_divided, n_misread, n_headers, and ``lines`` as ``reflow`` needs them.

    Every text is read once against the filter; those that need a look are written, meet the facts they ask for in joins and
    are decided.
    """
    key_type = df.schema[id_column].dataType.simpleString()
    asked = suspicious(df, facts, id_column, text_column, keep)
    met = meet(asked.drop("_keys"), answers(asked, facts.table), "_h", "left").drop("_h")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = [], []
            for i, (text, facts) in enumerate(zip(batch["_text"], batch["_answers"], strict=True)):
                lines, divided, misread, headers = read_lines(text, Known(facts))
                if divided or misread or headers:
                    at.append(i)
                    rows.append((divided, misread, headers, pack_lines(lines)))
            head = batch.iloc[at].drop(columns=["_text", "_answers"]).reset_index(drop=True)
            yield pd.concat([head, pd.DataFrame(rows, columns=["n_divided", "n_misread", "n_headers", "lines"])], axis=1)

    head = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    return met.mapInPandas(found, f"{head}id {key_type}, n_divided int, n_misread int, n_headers int, lines string")


def reflow(damaged: DataFrame, *keys: str) -> DataFrame:
    """The repaired text of each damaged record, in continuous paragraphs: keys, repaired.

    Windows over a record's lines, without headers, decide how a line follows the one before: without a break in a
    divided word, after a blank within a paragraph, else as a new paragraph. A paragraph ends at a sentence end in a
    line clearly shorter than the longest of the record, before headings, options and dialogue, and where short lines that
    begin with capitals follow each other as in verse. A mark of division is dropped but in a compound.
    """
    record = Window.partitionBy(*keys)  # what is left of one text
    ordered = record.orderBy("pos")
    rows = (
        damaged.select(*keys, F.posexplode(F.split("lines", _END)).alias("pos", "_l"))
        .select(*keys, "pos", F.left("_l", F.lit(1)).alias("kind"), F.substring("_l", 2, 1).alias("_end"), F.expr("substring(_l, 3)").alias("text"))
        .withColumn("_width", F.max(F.length("text")).over(record))
        .withColumn("_before", F.lag("text").over(ordered))
        .withColumn("_kind", F.lag("kind").over(ordered))
        .withColumn("_divided", F.lag("_end").over(ordered) != " ")
    )
    ended = F.col("_before").rlike(r"[.!?:…][\"'»”’)]*$")
    short = F.length("_before") < F.col("_width") * 0.8
    capital = F.col("text").rlike(r"^[^\p{Ll}]*\p{Lu}")
    verse = capital & ~ended & (F.length("_before") < F.col("_width") * 0.6) & (F.length("text") < F.col("_width") * 0.6)
    apart = (F.col("kind") != "b") | (F.col("_kind") == "h") | F.col("text").rlike("^[—–] ") | (ended & short & capital) | verse
    gap = F.when(F.col("_before").isNull() | F.col("_divided"), "").when(apart, "\n").otherwise(" ")
    marked = (F.col("_end") == "-") & ~F.col("text").rlike(rf"(?i)\b({COMPOUND})-\s*$")
    body = F.when(marked, F.regexp_replace("text", r"[-‐¬­]\s*$", "")).otherwise(F.col("text"))
    return (
        rows.select(*keys, "pos", F.concat(gap, body).alias("_part"))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_part"))), lambda x: F.coalesce(x["_part"], F.lit(""))), "").alias("repaired"))
    )


def repair_scans(df: DataFrame, facts: Facts | None = None, id_column: str = "id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts damaged by scanning, with the repaired text.

    Result, one row per damaged id (and ``keep``): id, n_divided (words at line ends), n_misread (words), n_headers (lines of
    running headers and page numbers), repaired.

    Without ``facts`` they are learnt from all texts of ``df``: words are grouped by the skeleton of their confusable glyphs,
    the form that is far more frequent and supported by the words beside it wins; lines are counted with digits
    masked; the lines that are left are reflowed with window functions.

    Edge cases: null and empty texts are no case; headings, option letters, verse, dialogue dashes, formulas and texts cut
    short are no damage; a text of one line has no headers; equal texts get equal results; rows delivered twice (same
    id) give one row; extra columns are ignored.
    """
    narrow = df.select(*keep, F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = facts or learn(narrow.where(F.length("text") > 0).select("text"))
    damaged = find_damage(narrow, known, keep=keep)
    # The counts travel as keys, as a join back to them would read all texts twice.
    return reflow(damaged.dropDuplicates([*keep, "id"]), *keep, "id", "n_divided", "n_misread", "n_headers")
