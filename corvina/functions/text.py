"""Text functions over columns: normalising, sanitising, measuring. All run inside the JVM but ``nfc``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal repairs of garbled sequences, then of signs, in this order.
GARBLED = [
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"),
    ("Ã ", "à"), ("Ãª", "ê"), ("Ã´", "ô"), ("Ã§", "ç"), ("Ã£", "ã"),
    ("Ã¢", "â"), ("Ã®", "î"), ("Ã¹", "ù"), ("Ã¨", "è"), ("Ã¼", "ü"),
    ("â€™", "'"), ("â€œ", '"'), ("â€¢", "•"), ("â€¦", "..."), ("â€", '"'),
    ("Ã—", "×"), ("Ã·", "÷"), ("âˆš", "√"), ("âˆž", "∞"),
]
SIGNS = [
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("„", '"'), ("‚", "'"), ("«", '"'), ("»", '"'),
    ("—", "-"), ("–", "-"), ("―", "-"), (" ", " "), (" ", " "), ("​", ""), ("…", "..."), ("◦", "•"),
]

# Page artefacts; patterns of Java and RE2 alike.
ARTEFACTS = [
    (r"[ \t\r\f\x0b]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^[ \t]+|[ \t]+$", ""),
    (r"\*\d+[A-Z]+\d+\*", ""),
    (r"LC\s*-\s*\d+°?\s*dia\s*\|\s*Caderno\s*\d+.*?Página\s*\d+", ""),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
]

_COLOURS = "(AZUL|AMARELO|AMARELA|BRANCO|BRANCA|VERDE|ROSA|CINZA)"
# What contaminates extracted text, by kind, in the order of removal.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
REPLACEMENT = "�+"
TYPESETTER = [
    r"PP\d{2}__\d{2}__.*?\.\.iinndd[db]\w*\s*\d*",
    r"([A-Za-z]{2}){3,}\.\.iinndd[db]\w*\s*\d*",
    r"\.\.iinndd[db]\w*\s*\d*",
    r"\d{4}//\d{4}//\d{8}\s+\d{4}::\d{4}::\d{4,6}",
]
CID = r"\(cid:\d+\)"
HEADERS = [
    r"(?iu)\d+[°ºo]?\s*DIA\s*[•·.]\s*CADERNO\s*\d+\s*[•·.].*?(LIN|MAT|HUM|NAT|RED)\w*",
    r"(?iu)DERNO\s*\d+\s*[.\s]+" + _COLOURS + r"\w*\s*-?",
    r"(?iu)(LC|MT|CN|CH)\s*-\s*\d+[°ºo]?\s*dia\s*\|\s*Caderno\s*\d+.*?(Página|Pagina)\s*\d+",
    r"(?iu)\d+\s+(LC|MT|CN|CH)\s*-\s*\d+[°ºo]?\s*dia\s*\|\s*Caderno\s*\d+\s*-\s*" + _COLOURS + r"\s*-\s*\d*[aª°ºo]?\s*(Aplicação|Aplicacao)",
    r"(?iu)\d+\s*-\s*" + _COLOURS + r"\s*-\s*\d*[aª]?\s*(Aplicação|Aplicacao)",
    r"(?iu)(Página|Pagina)\s*\d+",
    r"(NEM|ENEM)\d{4}\s*\d*",
    r"ENEM20[A-Z]\s*\d*",
    r"4202\s*MENE",
    r"MENE\s*\d{4}",
    r"enenn?m[^\w]*\d+/?",
    r"enem\d*o+\d*/?",
]
AREAS = [
    r"(?iu)LINGUAGENS,?\s*C[OÓ]DIGOS\s+E\s+SUAS\s+TECNOLOGIAS",
    r"(?iu)CI[EÊ]NCIAS\s+(HUMANAS|DA\s+NATUREZA)\s+E\s+SUAS\s+TECNOLOGIAS",
    r"(?iu)MATEM[AÁ]TICA\s+E\s+SUAS\s+TECNOLOGIAS",
    r"(?iu)(^|\s)E\d\s+TEM[AÁ]TICA(\s+E\s+SUAS\s+TECNOLOGIAS)?",
    r"(?iu)Quest[oõ]es\s+de\s+\d+\s+a\s+\d+",
    r"(?iu)(^|\s)REDA[CÇ][AÃ]O(\s|$)",
]
AREA_TAIL = r"(?iu)(UAS|AS)\s+TECNOLOGIAS\s*([•·.].*)?$"
MARKDOWN = [r"(?m)[ \t]*#{1,3}\s*\*{1,2}\s*$", r"(?m)^\*{1,2}\s*$"]

#: Latin letters and their plain forms, position by position.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def fold_accents(c: str | Column) -> Column:
    return F.translate(_col(c), ACCENTED, PLAIN)


def normalise_encoding(c: str | Column) -> Column:
    """Known garbled sequences and typographic signs replaced, in order."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), GARBLED + SIGNS, _col(c))


def clean_artefacts(c: str | Column) -> Column:
    """Page artefacts removed and white space squeezed."""
    return strip(reduce(lambda x, pair: F.regexp_replace(x, pair[0], pair[1]), ARTEFACTS, _col(c)))


def nfc(c: str | Column) -> Column:
    """Canonical composition; Spark has no built-in for it, hence Arrow batches."""
    import unicodedata

    @F.pandas_udf("string")
    def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed(_col(c))


def encoding_issues(c: str | Column) -> Column:
    """Runs of question marks and counts of the three tell-tale sequences, as an array of 'name=count'; null text has none."""
    text = F.coalesce(_col(c), F.lit(""))
    found = {"question_marks": r"\?{2,}", "A_tilde": "Ã", "quotes": "â€", "A_circumflex": "Â"}
    counts = [F.when(F.regexp_count(text, F.lit(p)) > 0, F.concat(F.lit(f"{n}="), F.regexp_count(text, F.lit(p)))) for n, p in found.items()]
    return F.array_compact(F.array(*counts))


def normalise_full(c: str | Column) -> Column:
    """Struct of the normalised text, the steps that changed it, issues before and after, and the improvement.

    The improvement is the share of issues that went, never below 0, and 1 where there was none.
    """
    raw = _col(c)
    first = normalise_encoding(raw)
    second = clean_artefacts(first)
    before, after = F.size(encoding_issues(raw)), F.size(encoding_issues(second))
    steps = F.array_compact(F.array(F.when(first != raw, "encoding"), F.when(second != first, "artefacts")))
    better = F.when(before == 0, 1.0).otherwise(F.greatest(F.lit(0.0), (before - after) / before))
    return F.struct(second.alias("text"), steps.alias("steps"), before.alias("issues_before"), after.alias("issues_after"), better.alias("improvement"))


def sanitise(c: str | Column) -> Column:
    """Contamination removed in eight steps: control and replacement characters, typesetter's marks, glyph codes,
    running headers, area headings, markdown remains, white space."""
    x = F.regexp_replace(_col(c), CONTROL, "")
    x = F.regexp_replace(x, REPLACEMENT, " ")
    for pattern in TYPESETTER:
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(x, CID, " ")
    for pattern in [*HEADERS, *AREAS, AREA_TAIL, *MARKDOWN]:
        x = F.regexp_replace(x, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def sanitise_option(c: str | Column) -> Column:
    """As ``sanitise``, and without a page number or dash at the end."""
    x = F.regexp_replace(sanitise(c), r"\s+\d{1,3}\s*$", "")
    return strip(F.regexp_replace(x, r"\s+-\s*$", ""))


def garble_ratio(c: str | Column) -> Column:
    """Runs of replacement characters plus control characters, per character; 0 for null and empty text."""
    text = F.coalesce(_col(c), F.lit(""))
    marks = F.regexp_count(text, F.lit(REPLACEMENT)) + F.regexp_count(text, F.lit(CONTROL))
    return F.when(F.length(text) == 0, 0.0).otherwise(marks / F.length(text))


#: Fixed value: control characters and the replacement character.
BAD_CHARACTER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f\x{fffd}]"


def garbled_whole(c: str | Column, most: float = 0.05) -> Column:
    """Struct (ratio of bad characters, each counted; whether it is above ``most``), for whole documents; 0 for null and empty text."""
    text = F.coalesce(_col(c), F.lit(""))
    ratio = F.regexp_count(text, F.lit(BAD_CHARACTER)) / F.greatest(F.lit(1), F.length(text))
    return F.struct(ratio.alias("ratio"), (ratio > most).alias("garbled"))


def is_contaminated(c: str | Column) -> Column:
    """Whether any contamination is found; false for null text."""
    text = F.coalesce(_col(c), F.lit(""))
    # One pattern for all the ones that do not regard case, one for the others.
    loose = "(?iu)" + "|".join(f"(?:{p[5:]})" for p in HEADERS + AREAS if p.startswith("(?iu)"))
    exact = "|".join(f"(?:{p})" for p in [CID, *TYPESETTER, *(h for h in HEADERS if not h.startswith("(?iu)"))])
    return (garble_ratio(text) > 0.10) | text.rlike(exact) | text.rlike(loose)


def garble_grade(c: str | Column) -> Column:
    """'poor' above 50 marks of bad text, 'fair' above 10, else 'good'."""
    text = F.coalesce(_col(c), F.lit(""))
    marks = sum((F.regexp_count(text, F.lit(p)) for p in (REPLACEMENT, CID, r"[|¦]{2,}", "[\U00010000-\U0010ffff]")), F.lit(0))
    return F.when(marks > 50, "poor").when(marks > 10, "fair").otherwise("good")


def is_repetitive(c: str | Column, least_chars: int = 100, least_words: int = 10, least_ratio: float = 0.3) -> Column:
    """Too short to judge, or with too few different words."""
    text = strip(F.coalesce(_col(c), F.lit("")))
    words = F.split(F.lower(text), r"\s+")
    return (F.length(text) < least_chars) | (F.size(words) < least_words) | (F.size(F.array_distinct(words)) / F.size(words) < least_ratio)


def plain_words(c: str | Column) -> Column:
    """Lower case, only letters, digits, underscores and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\p{N}\s]", " "), r"(?U)\s+", " "))


def tokens(c: str | Column) -> Column:
    """Search terms: lower case without accents, cut at everything but letters and digits."""
    return F.filter(F.split(fold_accents(F.lower(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+"), lambda t: t != "")


def content_hash(text: str | Column, *scope: str | Column) -> Column:
    """16 hex digits of the text and its scope, without regard to case, white space and the question's number."""
    plain = strip(F.lower(F.coalesce(_col(text), F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(plain, r"quest[ãa]o\s*\d+", ""), r"\s+", " ")
    return F.left(F.sha2(F.concat_ws(":", *[_col(s).cast("string") for s in scope], plain), 256), F.lit(16))


def text_windows(c: str | Column, size: int = 2000) -> Column:
    """Array of (start, piece) of at most ``size`` characters; empty for null and empty text."""
    text = F.coalesce(_col(c), F.lit(""))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))


def image_refs(c: str | Column) -> Column:
    """Targets of markdown images in order."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def salvage_json(c: str | Column) -> Column:
    """From the first opening to the last closing brace, else the first bracketed list; null if neither is there."""
    text = F.coalesce(_col(c), F.lit(""))
    braces, brackets = F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*?\]", 0)
    return F.coalesce(F.nullif(braces, F.lit("")), F.nullif(brackets, F.lit("")))
