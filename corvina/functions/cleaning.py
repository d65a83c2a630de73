"""Clean-up chains for whole questions and options, and estimates for records that lack a number or a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.text import clean_artefacts, normalise_encoding, sanitise, strip

# What is cut from question texts, in this order.
QUESTION_CUTS = [
    (r"(?i)(?:ENEM2024)+", ""),
    (r"(?i)(?:4202MENE)+", ""),
    (r"(?i)ENEM20E4", ""),
    (r"(?:\d{4}){3,}", ""),
    (r"(?:\d{2}::\d{2}::\d{2})+", ""),
    (r"(?:CD\d+\s*)+", ""),
    (r"(?:REDAÇÃO\s*1100//0099//\d{8}\s*\d{2}::\d{2}::\d{2})+", ""),
    (r"(?iu)\s+(?:LINGUAGENS,\s*CÓDIGOS|CIÊNCIAS\s*HUMANAS|MATEMÁTICA).*$", ""),
    (r"(?iu)\s+\d+\s+(?:LINGUAGENS|CÓDIGOS|TECNOLOGIAS|CIÊNCIAS|HUMANAS|NATUREZA|MATEMÁTICA).*$", ""),
    (r"\s+[A-Z0-9]\s*$", ""),
    (r"[A-Z0-9]{8,}$", ""),
    (r"\s+\d{1,2}\s*$", ""),
    (r"\s+", " "),
    (r"(?iu)LC\s*-\s*\d+°?\s*dia\s*\|\s*Caderno\s*\d+.*?Página\s*\d+", ""),
    (r"\*\d+[A-Z]+\d+\*", ""),
    (r"([A-Z0-9])\1{5,}$", ""),
]

# What is cut from single options, in this order.
OPTION_CUTS = [
    (r"(?iu)(?:ENEM2024|4202MENE|ENEM20E4|REDAÇÃO).*$", ""),
    (r"(?iu)(?:LINGUAGENS,\s*CÓDIGOS|CIÊNCIAS\s*HUMANAS|MATEMÁTICA).*$", ""),
    (r"([A-Z0-9])\1{3,}$", ""),
    (r"\d{2}::\d{2}::\d{2}.*$", ""),
    (r"\s+\d{8,}.*$", ""),
    (r"\s+\d{1,2}\s*$", ""),
    (r"\s+", " "),
    (r"\s*\.$", "."),
    (r"(?:^|\s)\p{Lu}{1,2}\s*$", ""),
]

# Separators that the layouts of two years print across the text.
SEPARATORS = [r"(?i)[23]202\s*MENE\s*", r"(?i)MENE\s*[23]202\s*", r"(?i)enem\s*202[23]\s*", r"\*\d{6}[A-Z]{2}\d?\*"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cut(c: Column, steps: list[tuple[str, str]]) -> Column:
    return strip(reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, c))


def clean_question(c: str | Column) -> Column:
    """A question's text normalised, sanitised and cut as ``QUESTION_CUTS`` say; null becomes empty."""
    return _cut(sanitise(clean_artefacts(normalise_encoding(F.coalesce(_col(c), F.lit(""))))), QUESTION_CUTS)


def clean_option(c: str | Column) -> Column:
    """An option's text without what pages add at its end."""
    return _cut(_col(c), OPTION_CUTS)


def drop_separators(c: str | Column) -> Column:
    return _cut(_col(c), [*[(p, " ") for p in SEPARATORS], (r"\s+", " ")])


def area_of(number: str | Column, day: str | Column) -> Column:
    """The area of a number on its day: 1 to 45 and 46 to 90 on the first, 91 to 135 and 136 to 180 on the second; the first area for all else."""
    n, d = _col(number), _col(day)
    return (
        F.when((d == 1) & n.between(46, 90), "ciencias_humanas")
        .when((d == 2) & n.between(91, 135), "ciencias_natureza")
        .when((d == 2) & n.between(136, 180), "matematica")
        .otherwise("linguagens")
    )


def page_range(number: str | Column, pages: str | Column) -> Column:
    """Pages 'from-to' around half the question's number within the document; '1-5' if its pages are unknown."""
    n, p = _col(number), _col(pages)
    at = F.greatest(F.lit(1), F.least(p, F.floor(n / 2).cast("int")))
    span = F.concat_ws("-", F.greatest(F.lit(1), at - 1).cast("string"), F.least(p, at + 1).cast("string"))
    return F.when(p > 0, span).otherwise("1-5")


def estimated_number(c: str | Column) -> Column:
    """The number in a heading, else 95 for mathematical, 15 for literary, 50 for other content."""
    t = F.coalesce(_col(c), F.lit(""))
    heading = F.nullif(F.regexp_extract(t, r"(?iu)quest[ãa]o\s*(\d+)", 1), F.lit("")).cast("int")
    low = F.lower(t)
    return F.coalesce(heading, F.when(low.rlike("[∫√∑∞≤≥≠±]|função|equação"), 95).when(low.rlike("texto|literatura|poema|linguagem|autor"), 15).otherwise(50))


def prompt(template: str, *columns: str | Column) -> Column:
    """A template with ``%s`` in place of each column, nulls as empty text."""
    return F.format_string(template, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns])
