"""Finds and restores text that was decoded with a wrong encoding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.ranking import bounded_sample
from corvina.operators.skew import meet
from corvina.session import cut

#: Chains of (encoding written, encoding read) that turn right text into garbled text.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>mac": (("utf-8", "mac_roman"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1253": (("utf-8", "cp1253"),),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>cp850": (("cp1252", "cp850"),),
    "cp1252>cp1250": (("cp1252", "cp1250"),),
    "cp1252>cp1251": (("cp1252", "cp1251"),),
    "cp1252>cp1253": (("cp1252", "cp1253"),),
    "cp1252>koi8": (("cp1252", "koi8_r"),),
    "cp1252>mac": (("cp1252", "mac_roman"),),
    "mac>cp1252": (("mac_roman", "cp1252"),),
    "cp850>cp1252": (("cp850", "cp1252"),),
    "utf8>cp1252>cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>latin1>latin1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>latin1>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    "utf8>latin1>mac": (("utf-8", "latin-1"), ("utf-8", "mac_roman")),
    "utf8>cp1252>mac": (("utf-8", "cp1252"), ("utf-8", "mac_roman")),
    "utf8>mac>mac": (("utf-8", "mac_roman"), ("utf-8", "mac_roman")),
    "utf8>cp1252>cp850": (("utf-8", "cp1252"), ("utf-8", "cp850")),
    "utf8>cp850>cp850": (("utf-8", "cp850"), ("utf-8", "cp850")),
    "utf8>cp1252>cp1252>cp1252": (("utf-8", "cp1252"),) * 3,
}
CLEAN, LOST = "clean", "lost"
CLASSES = (CLEAN, LOST, *CHAINS)

#: Letters and signs of undamaged Portuguese text beyond ASCII.
LETTERS = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇñÑ"
SIGNS = "ºª°–—“”‘’«»…€×÷½²³≤≥√θπ•§¿¡­‐¬ﬁﬂ"
#: Of these the ones that may touch letters.
TOUCHING = "ºª–—“”‘’«»…¿¡ﬁﬂ"

BUCKETS = 1 << 14
#: A word is damaged if its chain is likelier than no damage by at least so much (natural log), or half of that
#: where other words of the record have the same damage.
MARGIN = 4.0
#: What restoring must add to the log-likelihood of an undamaged word.
GAIN = 3.0
#: A word seen in several texts is damaged all the same if the restored word is so many times as frequent.
RATIO = 15

REPLACED = "�"
_TOKEN = re.compile(r"[^ \t\r\n]*(?:[^\x00-\x7f]|\?)[^ \t\r\n]*")
_LOST = re.compile(r"[^\W\d_]\?+[^\W\d_]|^\W*\?+[^\W\d_]|^\?{1,2}$|[^\W\d_]\?{2,}[^\W\d_]")
#: A word before a question mark after which the sentence goes on: its last letter may be lost.
_GOES_ON = re.compile(r"[^\W\d_]+\?(?=[ \r\n]+[a-záàâãéêíóôõúç0-9]|[,;])")
_LINE_END_MARKS = "­‐¬-…"


@lru_cache(maxsize=32)
def _table(codec: str) -> tuple[str, dict[str, int]]:
    """Characters by byte and bytes by character; bytes that a code page leaves open stand for themselves."""
    chars = "".join(c if len(c := bytes([b]).decode(codec, "ignore")) == 1 else chr(b) for b in range(256))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def _write(text: str, codec: str) -> bytes | None:
    if codec == "utf-8":
        try:
            return text.encode()
        except UnicodeEncodeError:
            return None
    table = _table(codec)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _read(data: bytes, codec: str) -> str | None:
    if codec == "utf-8":
        try:
            return data.decode("utf-8", "strict")
        except UnicodeDecodeError:
            return None
    chars = _table(codec)[0]
    return "".join(chars[b] for b in data)


def garble(text: str, chain: str) -> str | None:
    for written, read in CHAINS[chain]:
        data = _write(text, written)
        if data is None:
            return None
        text = _read(data, read)
    return text


def invert(text: str, chain: str) -> str | None:
    """``text`` before the chain; null unless every step can be undone strictly."""
    for written, read in reversed(CHAINS[chain]):
        data = _write(text, read)
        text = None if data is None else _read(data, written)
        if text is None:
            return None
    return text


def buckets(token: str) -> np.ndarray:
    """Hashed byte bigrams of a word between blanks."""
    data = np.frombuffer(f" {token} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    return ((data[:-1] << 8 | data[1:]) * np.uint32(40503) >> np.uint32(3)) % BUCKETS


#: Characters that cannot be seen; cleaning steps often drop them from garbled text.
_UNSEEN = "\xad\xa0" + "".join(map(chr, range(0x80, 0xA0)))
_UNSEEN_TABLE = {ord(c): None for c in _UNSEEN}
_GAP = re.compile(r"[ÃÂ](?=[A-Za-zÃÂ]|\W*$)")
# An unseen blank after this letter that has become an ordinary one.
_BLANK = re.compile(r"(?<!\S)Ã (?= |s\b)")


_BEYOND = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")


def _core(token: str) -> str:
    return re.sub(r"^\W+|\W+$", "", token).lower()


def _bones(token: str) -> str:
    """What is left of a word, garbled or not, without characters beyond ASCII: equal for a word and its garbled forms."""
    return re.sub(r"^\W+|\W+$", "", _RUN.sub("?", token.lower()))


def _plain(core: str) -> str:
    """A word with question marks for its letters beyond ASCII."""
    return "".join(c if c < "\x80" else "?" for c in core)


def looks_clean(text: str) -> bool:
    """Whether a text may serve as an example of undamaged text: its signs are known and stand where they should."""
    for m in _BEYOND.finditer(text):
        i, c = m.start(), m.group()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c in LETTERS:
            if c.isupper() and before.islower():
                return False
        elif c not in SIGNS:
            return False
        elif c in "­‐¬":
            if after not in ("\n", "\r", ""):
                return False
        elif c not in TOUCHING and ((before.isalpha() and c != "°") or after.isalpha() and c != "°"):
            return False
    return True


def _outside(marks: str, chain: str) -> str | None:
    """The marks beside a word before the chain; of one beyond ASCII unseen characters may have been dropped."""
    right = marks if marks.isascii() else invert(marks, chain)
    if right is None and (m := _RUN.search(marks)):
        signs = (c for c in SIGNS if (wrong := garble(c, chain)) and wrong.translate(_UNSEEN_TABLE) == m.group())
        right = (c := next(signs, None)) and marks[: m.start()] + c + marks[m.end() :]
    return right


def _after(text: str, end: int) -> str:
    """The word after a place."""
    return _core(text[end : end + 40].lstrip().partition(" ")[0])


def _bare(token: str) -> str:
    """Without marks of a word that is divided at a line end or cut off, which are no part of the word."""
    return token.rstrip(_LINE_END_MARKS) or token


class Model:
    """Multinomial classifier on hashed byte bigrams: log-likelihoods of each bucket in each class.

    ``forms`` maps a word whose letters beyond ASCII are question marks to its most frequent form, ``follows`` the
    word after a lone letter to that letter; ``usual`` are words seen in several undamaged texts. ``words`` has the known
    words of the same ``_bones``. Of a large table these hold what one text asks for (``asks``), as ``answered`` sets them.
    """

    def __init__(self, table: np.ndarray, forms: dict[str, str], follows: dict[str, str], usual: set[str]) -> None:
        self.table, self.forms, self.follows, self.usual = table, forms, follows, usual
        self.known = set(forms.values()) | {c for t in usual if (c := _core(t))}
        self.words: dict[str, list[str]] = {}
        for word in sorted(self.known):
            self.words.setdefault(_bones(word), []).append(word)
        self.uses: dict[str, int] = {}  # of usual (texts) and known words, by their keys; empty for a sample
        self.memo: dict[str, np.ndarray | None] = {}

    def likelihoods(self, token: str) -> np.ndarray:
        return self.table[:, buckets(token)].sum(axis=1)

    def suspicious(self, token: str) -> np.ndarray | None:
        """Leads of all classes over no damage if any may be damage; null for the usual undamaged word."""
        if token in self.memo:
            return self.memo[token]
        if len(self.memo) > 200_000:  # bounds a worker's memory; only speed depends on it
            self.memo.clear()
        bare = _bare(token)
        found = None
        if REPLACED in bare or any(c > "\x7f" for c in bare) or _LOST.search(bare):
            scores = self.likelihoods(bare)
            lead = scores - scores[0]
            if REPLACED in bare or lead[1:].max() > 0:
                found = lead
        self.memo[token] = found
        return found

    def ended(self, text: str) -> list[re.Match]:
        """Words before a question mark after which the sentence goes on that the classifier finds likelier to have lost a letter there."""
        if "?" not in text:
            return []
        found = []
        for m in _GOES_ON.finditer(text):
            scores = self.likelihoods(m.group())
            if scores[1] - scores[0] > 0:
                found.append(m)
        return found

    def _undo(self, token: str, chain: str) -> tuple[str, bool] | None:
        """The word before the chain, all of whose characters may stand in undamaged text, and whether it is not the strict
        inverse but the known word that gives the token where unseen characters were dropped."""

        def fine(right: str | None, wrong: str) -> bool:
            return right is not None and right != wrong and all(" " <= c < "\x80" or c in LETTERS or c in SIGNS or c == "\xa0" for c in right)

        bare = _bare(token)
        for form in dict.fromkeys((bare, token)):
            right = invert(form, chain)
            if fine(right, form):
                return right + token[len(form) :], False
        if _GAP.search(bare) and CHAINS[chain][0][0] == "utf-8":  # unseen characters may have been dropped there
            seen = bare.translate(_UNSEEN_TABLE)
            for word in self.words.get(_bones(bare), ()):
                for right in dict.fromkeys((word[:1].upper() + word[1:], word, word.upper())):  # capitals lose more second characters
                    wrong = garble(right, chain)
                    wrong = wrong and wrong.translate(_UNSEEN_TABLE)
                    if not wrong or wrong == right or (at := seen.find(wrong)) < 0:
                        continue
                    ends = [_outside(x, chain) for x in (seen[:at], seen[at + len(wrong) :])]
                    if None not in ends and _core(whole := right.join(ends)) == word and fine(whole, bare):
                        # A mark at the end may be the last character of a garbled one.
                        return (whole if whole[-1] in _LINE_END_MARKS and whole[-1] == token[-1] else whole + token[len(bare) :]), True
        return None

    def asks(self, text: str) -> set[str]:
        """What ``repair`` of this text may look up, each with a letter for the table; empty if it is surely undamaged."""
        if "Ã " in text:
            text = _BLANK.sub("Ã\xa0", text)
        out = {"f" + m.group().lower() for m in self.ended(text)}
        for m in _TOKEN.finditer(text):
            token = m.group()
            lead = self.suspicious(token)
            if lead is None:
                continue
            bare = _bare(token)
            if REPLACED in bare or _LOST.search(bare):
                form = self._form(bare)[1]
                out.add("s" + _after(text, m.end()) if form == "?" else "f" + form)
            out.add("u" + token)
            if REPLACED in bare:
                continue
            if _GAP.search(bare):
                out.add("g" + _bones(bare))
            for k in np.flatnonzero(lead > MARGIN / 2):
                if CLASSES[k] in CHAINS and (undone := self._undo(token, CLASSES[k])) is not None:
                    out.add("k" + _core(undone[0]))
        return out

    def answered(self, found: Iterable[tuple[str, str]]) -> Model:
        """Has the answers (key with its letter, value) as all it knows."""
        self.forms, self.follows, self.usual, self.known, self.words, self.uses = {}, {}, set(), set(), {}, {}
        for key, value in sorted(found):
            if key[0] in "uk":
                self.uses[key] = int(value)
            kind, key = key[0], key[1:]
            if kind == "f":
                self.forms[key] = value
            elif kind == "s":
                self.follows[key] = value
            elif kind == "u":
                self.usual.add(key)
            elif kind == "k":
                self.known.add(key)
            else:
                self.known.add(value)
                self.words.setdefault(key, []).append(value)
        return self

    def restore(self, token: str, lead: np.ndarray, evidence: np.ndarray, strict: float, seen: set[str], after: str) -> tuple[str, str | None, bool] | None:
        """(class, restored word or null, whether filled in from known words) of a damaged word; null if it is undamaged.

        Any byte is a letter in a one-byte encoding, so chains between two of these also need a known word, or another
        word of the record with the same damage (``seen``). A usual word is damaged only along with others.
        """
        bare = _bare(token)
        if REPLACED in bare:
            return LOST, self._fill(bare, token[len(bare) :], after), True
        base = self.likelihoods(bare)[0]
        for k in np.argsort(-(lead + evidence), kind="stable"):
            name = CLASSES[k]
            if name == CLEAN or lead[k] <= strict:
                continue
            if name == LOST:
                if _LOST.search(bare) and "://" not in bare:
                    return LOST, self._fill(bare, token[len(bare) :], after), True
                continue
            usual = token in self.usual
            if name not in seen and usual and not self.uses:
                continue
            undone = self._undo(token, name)
            if undone is None or self.likelihoods(_bare(undone[0]))[0] < base + GAIN:
                continue
            right = undone[0]
            known = _core(right) in self.known
            written = CHAINS[name][0][0]
            if usual and (written == "utf-8" or len(_core(right)) > 3):  # short words are each other's garbled forms in one-byte encodings
                usual = self.uses.get("k" + _core(right), 0) < RATIO * self.uses.get("u" + token, 1)
            if usual and name not in seen:
                continue
            if written == "utf-8" or known and not usual or name in seen and (known or not usual):
                return name, *undone
        return None

    def _fill(self, bare: str, tail: str, after: str) -> str | None:
        """The most frequent known word that fits between the lost letters; a lone letter goes by the word after it."""
        (lead, core, end), form = self._form(bare)
        found = self.follows.get(after) if form == "?" else self.forms.get(form)
        if found is None:
            return None
        return lead + (found.capitalize() if core[:1].isupper() else found) + end + tail

    @staticmethod
    def _form(bare: str) -> tuple[tuple[str, str, str], str]:
        """A word with what is around it, and how it is looked up."""
        parts = re.match(r"^([^\w?�]*)(.*?)([^\w?�]*)$", bare, re.S).groups()
        return parts, parts[1].replace(REPLACED, "?").lower()

    def repair(self, text: str) -> tuple[str, int, int, str | None] | None:
        """Class of the damage, damaged words, how many of them are filled in from known words, restored text (null where a
        word can't be restored); null if undamaged."""
        if "Ã " in text:
            text = _BLANK.sub("Ã\xa0", text)
        leads = [(m, lead) for m in _TOKEN.finditer(text) if (lead := self.suspicious(m.group())) is not None]
        ended = [m for m in self.ended(text) if m.group().lower() in self.forms]
        if not leads and not ended:
            return None
        evidence = np.sum([np.maximum(lead, 0) for _, lead in leads], axis=0) / 2 if leads else np.zeros(len(CLASSES))
        damaged: dict[int, tuple[re.Match, str, str | None, bool]] = {}
        for m in ended:
            found = self.forms[m.group().lower()]
            damaged[m.start()] = (m, LOST, found.capitalize() if m.group()[0].isupper() else found, True)
        for strict in (MARGIN, MARGIN / 2):
            seen = {name for _, name, *_ in damaged.values()}
            if strict < MARGIN and not seen:
                break
            for m, lead in leads:
                if not any(m.start() <= at < m.end() for at in damaged):
                    found = self.restore(m.group(), lead, evidence, strict, seen, _after(text, m.end()))
                    if found is not None and (strict == MARGIN or found[0] in seen):
                        damaged[m.start()] = (m, *found)
        if not damaged:
            return None
        name = Counter(x[1] for x in damaged.values()).most_common(1)[0][0]
        filled = sum(x[3] for x in damaged.values())
        if any(x[2] is None for x in damaged.values()):
            return name, len(damaged), filled, None
        out, at = [], 0
        for _, (m, name_of, word, _) in sorted(damaged.items()):
            if name_of == LOST and len(_core(m.group()).strip("?�")) == 0 and re.search(r"(?:^|[.!?:]|\n)\s*[\"“«—]?\s*$", text[: m.start()]):
                word = word.upper()  # a lone letter that begins a sentence
            out += [text[at : m.start()], word]
            at = m.end()
        return name, len(damaged), filled, "".join(out) + text[at:]


def fit(texts: Iterable[str]) -> Model:
    """A model from texts of which most are undamaged: the undamaged ones are garbled along every chain."""
    tokens: Counter = Counter()
    spread: Counter = Counter()
    pairs: dict[str, Counter] = {}
    for text in texts:
        if looks_clean(text):
            words = text.split()
            tokens.update(_bare(t) for t in words)
            spread.update({t for t in words if not t.isascii()})
            for one, two in zip(words, words[1:], strict=False):
                if len(c := _core(one)) == 1 and c in LETTERS:
                    pairs.setdefault(_core(two), Counter())[c] += 1
    counts = np.zeros((len(CLASSES), BUCKETS))
    forms: dict[str, str] = {}
    for token, n in tokens.most_common():
        plain = token.isascii()
        if plain and "?" not in token:
            continue  # ASCII words without a question mark are never looked at
        np.add.at(counts[0], buckets(token), n)
        if plain:
            continue
        for k, chain in enumerate(CHAINS, 2):
            wrong = garble(token, chain)
            if wrong is not None and wrong != token:
                np.add.at(counts[k], buckets(wrong), n)
                if (less := wrong.translate(_UNSEEN_TABLE)) != wrong:
                    np.add.at(counts[k], buckets(less), n)
        if "?" not in token:
            np.add.at(counts[1], buckets(token.encode("ascii", "replace").decode()), n)
            np.add.at(counts[1], buckets("".join(c if c < "\x80" else REPLACED for c in token)), n)
        core = _core(token)
        if core and not core.isascii():
            forms.setdefault(_plain(core), core)
    table = np.log((counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * BUCKETS))
    follows = {word: c.most_common(1)[0][0] for word, c in pairs.items()}
    return Model(table, forms, follows, {t for t, n in spread.items() if n > 1})


def vocabulary(texts: DataFrame) -> DataFrame:
    """What ``Model.asks`` may ask, counted over a column ``text`` of all records: key with the letter of its table, value.

    Only undamaged texts count. Tasks sum their own texts first; nothing is cut, and nothing reaches the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        cores: dict[str, str] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "a", "b", "n"])

        for batch in batches:
            for text in batch["text"]:
                if text.isascii() or not looks_clean(text):
                    continue
                words = text.split()
                at = [i for i, t in enumerate(words) if not t.isascii()]
                for i in at:
                    core = cores.get(words[i])
                    if core is None:
                        core = cores[words[i]] = _core(_bare(words[i]))
                    if not core.isascii():
                        counts["f", core, ""] += 1
                    if len(core) == 1 and core in LETTERS and i + 1 < len(words):
                        counts["s", _core(words[i + 1]), core] += 1
                counts.update(("u", t, "") for t in {words[i] for i in at})
            if len(counts) + len(cores) > 400_000:  # a task's memory stays bounded; the rest is summed later
                yield rows()
                counts.clear()
                cores.clear()
        yield rows()

    total = cut(texts.mapInPandas(counted, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    kind = lambda k: total.where(F.col("kind") == k)
    core = F.lower(F.regexp_replace("a", r"(?U)^\W+|\W+$", ""))
    bones = F.regexp_replace(F.regexp_replace(F.lower("a"), r"[^\x00-\x7f]+", "?"), r"^\W+|\W+$", "")
    key = lambda k, c: F.concat(F.lit(k), c).alias("key")
    uses = F.coalesce("n", F.lit(0)).cast("string").alias("value")
    forms = kind("f").groupBy(F.regexp_replace("a", r"[^\x00-\x7f]", "?").alias("p")).agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a"))
    usual = kind("u").where("n > 1")
    known = forms.select("a").unionByName(usual.select(core.alias("a"))).where("a != ''").distinct().join(kind("f").select("a", "n"), "a", "left")
    follows = kind("s").groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("value"))
    return (
        forms.select(key("f", F.col("p")), F.col("a").alias("value"))
        .unionByName(follows.select(key("s", F.col("a")), "value"))
        .unionByName(usual.select(key("u", F.col("a")), uses))
        .unionByName(known.select(key("k", F.col("a")), uses))
        .unionByName(known.select(key("g", bones), F.col("a").alias("value")))
    )


def training_sample(df: DataFrame, id_column: str, text_columns: list[str], bound: int) -> list[str]:
    """The texts of up to ``bound`` rows per column, chosen by a hash of the id."""
    total = df.count()  # of a plain Parquet table this reads footers only
    out: list[str] = []
    for column in text_columns:
        some = df.where(F.length(column) > 0).select(F.col(id_column).alias("id"), F.col(column).alias("t"))
        out += [r[0] for r in bounded_sample(some, "id", bound, total).select("t").collect()]
    return out


def repair_encoding(
    df: DataFrame, model: Model, id_column: str = "id", text_column: str = "text", keep: tuple[str, ...] = (), words: DataFrame | None = None
) -> DataFrame:
    """The garbled texts of ``df``, each with what happened to it.

    Result, one row per garbled row: the columns ``keep``, id, chain (of CHAINS, or 'lost' where letters became
    replacement signs), n_damaged (words), n_filled (of them restored as known words that fit, as letters were lost or unseen
    characters dropped; the others by inverting the chain), restored (null where lost letters can't be told).

    Every word beyond ASCII, or with a question mark inside, is classified; the likeliest chain is inverted and
    counts only if every step decodes strictly to known letters that read better than before. Words undamaged
    elsewhere in the same text stay as they are. There is no shuffle without ``words``, the ``vocabulary`` of all texts: texts with
    suspicious words are then written once and meet what they ask for in a join, in place of what the model knows of its sample.

    Edge cases: null and empty texts are no case; correct capitals, quotation marks and symbols are no case; equal
    texts get equal results; rows delivered twice appear twice; extra columns are ignored.
    """
    key_type = df.schema[id_column].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.forms, model.follows, model.usual))
    narrow = df.select(*keep, F.col(id_column).alias("id"), F.col(text_column).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7f]|\?"))

    head = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    result = f"{head}id {key_type}, chain string, n_damaged int, n_filled int, restored string"

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            answers = batch["_answers"] if "_answers" in batch else None
            found = []
            for i, t in enumerate(batch["_text"]):
                if answers is not None:
                    parts = answers[i].split("\n") if answers[i] else []
                    model.answered(zip(parts[::2], parts[1::2], strict=True))
                if (r := model.repair(t)) is not None:
                    found.append((i, *r))
            rows = batch.iloc[[f[0] for f in found]].drop(columns=["_text", "_answers"], errors="ignore").reset_index(drop=True)
            yield pd.concat([rows, pd.DataFrame([f[1:] for f in found], columns=["chain", "n_damaged", "n_filled", "restored"])], axis=1)

    if words is None:
        return narrow.mapInPandas(repaired, result)
    bare = df.sparkSession.sparkContext.broadcast(model.table.astype(np.float32))

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(bare.value, {}, {}, set())
        for batch in batches:
            # No word holds a line break, so keys travel as lines of one string.
            keys = ["\n".join(k for k in model.asks(t) if "\n" not in k) for t in batch["_text"]]
            at = [i for i, k in enumerate(keys) if k]
            yield batch.iloc[at].assign(_keys=pd.Series([keys[i] for i in at], batch.index[at], object))

    asked = cut(narrow.mapInPandas(asking, f"{head}id {key_type}, _text string, _keys string").withColumn("_h", F.md5("_text")))

    # A key or a text that very many rows have meets them in a broadcast. A key may have several values, hence the lists.
    keys = cut(asked.select("_h", F.explode(F.split("_keys", "\n")).alias("key")).distinct())
    found = cut(keys.select("key").distinct().join(words, "key").groupBy("key").agg(F.collect_list("value").alias("values")))
    one = F.concat_ws("\n", "key", "value")
    by_text = meet(keys, found, "key").select("_h", "key", F.explode("values").alias("value")).groupBy("_h").agg(F.array_join(F.collect_list(one), "\n").alias("_answers"))
    met = meet(asked.drop("_keys"), cut(by_text), "_h", "left").drop("_h")
    return met.mapInPandas(repaired, result)
