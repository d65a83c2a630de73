"""Parsing and extraction over columns: file names, answer keys, question blocks, options, hints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.text import strip

LETTERS = "ABCDE"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- file names


def filename_metadata(c: str | Column) -> Column:
    """Struct read from names like 2024_PV_impresso_D1_CD1.pdf; null below four parts or without a year.

    Fields: year, kind, day, booklet, application_type, accessibility, language, exam_type.
    """
    stem = F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    has = lambda p: F.array_contains(parts, p)
    day = F.element_at(F.filter(parts, lambda p: p.rlike(r"^D\d$")), -1)
    booklet = F.element_at(F.filter(parts, lambda p: p.rlike(r"^CD\d+$")), -1)
    number = F.coalesce(F.substring(booklet, 3, 9).cast("int"), F.lit(1))
    again, special = has("reaplicacao"), has("PPL")
    reader = stem.contains("braile_e_ledor") | number.isin(9, 11)
    return F.when(
        (F.size(parts) >= 4) & parts[0].rlike(r"^\d+$"),
        F.struct(
            parts[0].cast("int").alias("year"),
            parts[1].alias("kind"),
            F.coalesce(F.substring(day, 2, 1).cast("int"), F.lit(1)).alias("day"),
            F.coalesce(booklet, F.lit("CD1")).alias("booklet"),
            F.when(again, "reaplicacao_PPL").otherwise("regular").alias("application_type"),
            F.when(reader, "braille_ledor").when(number.isin(10, 12), "libras").when(special & ~again, "PPL").alias("accessibility"),
            F.when(F.lower(stem).contains("espanhol"), "spanish").when(F.lower(stem).contains("ingles"), "english").otherwise("portuguese").alias("language"),
            F.when(special, "PPL").when(has("digital"), "ENEM_DIGITAL").otherwise("ENEM").alias("exam_type"),
        ),
    )


def file_kind(c: str | Column) -> Column:
    """'key' or 'booklet' by the mark in a file's name; null for other files."""
    return F.when(F.contains(_col(c), F.lit("_GB_")), "key").when(F.contains(_col(c), F.lit("_PV_")), "booklet")


def scanned_files(pages: DataFrame, file: str, text: str, least: int = 50) -> DataFrame:
    """Per file: n_pages, and whether any page has fewer than ``least`` characters, as scanned pages have."""
    few = F.length(F.coalesce(F.col(text), F.lit(""))) < least
    return pages.groupBy(file).agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.bool_or(few), F.lit(False)).alias("scanned"))


def area_of_number(c: str | Column) -> Column:
    """The knowledge area of a question number, in four ranges of 45; the first one for all others."""
    n = _col(c)
    return (
        F.when(n.between(46, 90), "ciencias_humanas").when(n.between(91, 135), "ciencias_natureza").when(n.between(136, 180), "matematica").otherwise("linguagens")
    )


# ---------------------------------------------------------------- answer keys


def answer_key_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Rows (question_number, correct_answer, language_option) of key lines like '1 C D 46 B', with the columns ``keep``.

    The two letters after the first number are the English and the Spanish answer; a second number with its
    letter is one more row without a language.
    """
    p = r"^(\d+)\s+([A-E])\s*([A-E])?\s*(\d+)?\s*([A-E])?"
    part = lambda i: F.nullif(F.regexp_extract("_line", p, i), F.lit(""))
    lines = df.select(*keep, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("_line")).withColumn("_line", strip("_line"))
    entry = lambda n, a, lang: F.struct(n.cast("int").alias("question_number"), a.alias("correct_answer"), F.lit(lang).cast("string").alias("language_option"))
    rows = F.array(entry(part(1), part(2), "ingles"), entry(part(1), part(3), "espanhol"), entry(part(4), part(5), None))
    return lines.where(F.col("_line").rlike(p)).select(*keep, F.inline(F.filter(rows, lambda r: r["question_number"].isNotNull() & r["correct_answer"].isNotNull())))


def loose_answers(c: str | Column, most: int = 180) -> Column:
    """Map of number to letter from pairs like '12 C' anywhere in the text; the last pair of a number wins."""
    pairs = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?:^|[^\d])(\d{1,3}\s+[A-E])(?![A-Za-z])"), F.lit(1))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("a")))
    good = F.filter(entries, lambda e: e["n"].between(1, most))
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda later: later["n"] == e["n"]))
    return F.map_from_entries(last)


# ---------------------------------------------------------------- question blocks

# Fixed value: the heading of a question, plain or bold.
HEADING = r"(?iu)(?:\*\*)?quest[ãa]o\s*(\d+)(?:\*\*)?"


def question_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Question blocks of each document: key, number, block; a later block of the same number replaces the earlier.

    A block goes from its heading to the next one; empty blocks are left out.
    """
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), HEADING, "\x1e$1\x1f")
    parts = df.select(F.col(key), F.posexplode(F.split(marked, "\x1e")).alias("_i", "_p")).where("_i > 0")
    blocks = parts.select(
        key, "_i", F.substring_index("_p", "\x1f", 1).cast("int").alias("number"), strip(F.expr("substring(_p, instr(_p, '\x1f') + 1)")).alias("block")
    ).where("block != ''")
    last = Window.partitionBy(key, "number").orderBy(F.desc("_i"))
    return blocks.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_i")


def statement(c: str | Column) -> Column:
    """The statement of a block: what stands before the first option, without images; the first 500 characters if that is too short."""
    text = F.coalesce(_col(c), F.lit(""))
    head = F.element_at(F.split(text, r"(?m)^\s*(?:\*{0,2}\(?[A-E]\)\*{0,2}\s|-\s+[A-E]\s)"), 1)
    head = strip(F.regexp_replace(head, r"!\[[^\]]*\]\([^)]*\)", ""))
    head = strip(F.element_at(F.split(head, r"\s-\s+[A-E]\s+(?=\S)"), 1))
    return F.when(F.length(head) >= 10, head).otherwise(F.substring(text, 1, 500))


def context_block(c: str | Column) -> Column:
    """From a marker such as 'TEXTO I' or 'Leia o texto' to the first option; null without marker or option."""
    found = F.regexp_extract(
        F.coalesce(_col(c), F.lit("")),
        r"(?isu)((?:TEXTO\s+[IVX]+|Texto\s+para\s+as?\s+quest|Leia\s+o\s+texto|Observe\s+a\s+figura|Analise\s+o\s+gráfico).*?)(?-i:\(?[A-E]\)\s)",
        1,
    )
    return F.nullif(strip(found), F.lit(""))


def question_hints(c: str | Column) -> Column:
    """Array of (method, number, confidence): headings 0.9, three or more option letters 0.6, loose numbers 1 to 180 0.3."""
    text = F.coalesce(_col(c), F.lit(""))
    hint = lambda m, n, conf: F.struct(F.lit(m).alias("method"), n.cast("int").alias("number"), F.lit(conf).alias("confidence"))
    headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)quest[ãa]o\s*(\d+)"), F.lit(1)), lambda n: hint("heading", n, 0.9))
    letters = F.regexp_count(text, F.lit(r"\b[A-E]\s*\)"))
    orphans = F.when(letters >= 3, F.array(hint("options", F.lit(None), 0.6))).otherwise(F.array().cast("array<struct<method:string,number:int,confidence:double>>"))
    loose = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\d{1,3})(?![\p{L}\p{N}_])"), F.lit(1)), lambda n: n.cast("int")), lambda n: n.between(1, 180))
    return F.concat(headings, orphans, F.transform(loose, lambda n: hint("number", n, 0.3)))


# ---------------------------------------------------------------- options


def simple_options(c: str | Column) -> Column:
    """Map of letter to text of options like 'A) text', one per line; the first of a letter wins."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?m)^\s*(?:-\s+)?\*{0,2}\(?([A-E]\)[^\n]*)"), F.lit(1))
    entries = F.transform(found, lambda x: F.struct(F.left(x, F.lit(1)).alias("k"), strip(F.regexp_replace(x, r"^[A-E]\)\*{0,2}", "")).alias("v")))
    entries = F.filter(entries, lambda e: e["v"] != "")
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, F.greatest(i, F.lit(1))), lambda x: (i > 0) & (x["k"] == e["k"])))
    return F.map_from_entries(first)


def is_cascade(options: str | Column) -> Column:
    """Whether at least two options of an array contain the one after them."""
    o = _col(options)
    hits = F.transform(F.sequence(F.lit(1), F.greatest(F.size(o) - 1, F.lit(1))), lambda i: F.when((F.size(o) > 1) & (F.element_at(o, i + 1) != "") & F.contains(F.element_at(o, i), F.element_at(o, i + 1)), 1).otherwise(0))
    return (F.size(o) >= 3) & (F.aggregate(hits, F.lit(0), lambda a, x: a + x) >= 2)


def undo_cascade(options: str | Column) -> Column:
    """Each option cut where the next one begins in it, if something is left; the last one stays."""
    o = _col(options)

    def cut(x: Column, i: Column) -> Column:
        after = F.get(o, i + 1)
        head = strip(F.substring(x, 1, F.instr(x, after) - 1))
        return F.when(after.isNotNull() & (after != "") & (F.instr(x, after) > 0) & (head != ""), head).otherwise(strip(x))

    return F.transform(o, cut)


# The strategies below depend on the order of lines and on back-references, so they run in Arrow batches.
_LINE_OPTION = re.compile(r"^(?:-\s+)?\(?([A-E])\s*[).\-]\s*(\S.*)$")
_BARE_OPTION = re.compile(r"^(?:-\s+)?([A-E])\s+(\S.*)$")
_DOUBLED = re.compile(r"^(?:([A-E])\1|([A-E])\s+\2)\s*[).\-]?\s+(\S.*)$")
_STOP = re.compile(r"(?i)^(quest[ãa]o\b|lc\s*-|página|\*\d+)")


def _by_lines(text: str, pattern: re.Pattern, follow: int) -> dict[str, str]:
    """Options that begin lines, each with up to ``follow`` lines that go on with it; the first of a letter wins."""
    out: dict[str, str] = {}
    current, left = None, 0
    for line in (x.strip() for x in text.split("\n")):
        if not line or _STOP.match(line):
            current = None
            continue
        m = pattern.match(line)
        if m:
            letter, value = [g for g in m.groups() if g][-2:]
            current, left = (letter, follow) if letter not in out else (None, 0)
            if current:
                out[letter] = value.strip()
        elif current and left:
            out[current] += " " + line
            left -= 1
    return {k: v for k, v in out.items() if len(v) <= 500}


def _inline(text: str) -> dict[str, str]:
    flat = re.sub(r"\s+", " ", text)
    found = re.findall(r"(?:^|\s)-\s+([A-E])\s+(.+?)(?=\s+-\s+[A-E]\s|$)", flat)
    return {k: v.strip() for k, v in reversed(found)}


def _options(text: str) -> tuple[dict[str, str], float, str]:
    """Options, confidence and strategy: the best of several, filled up letter by letter from the others."""
    results = []
    for name, got in (
        ("marked", _by_lines(text, _LINE_OPTION, 3)),
        ("bare", _by_lines(text, _BARE_OPTION, 3)),
        ("inline", _inline(text)),
        ("doubled", _by_lines(text, _DOUBLED, 3)),
    ):
        fit = sum(1 <= len(v.split()) <= 50 for v in got.values())
        results.append((0.7 * len(got) / 5 + 0.3 * min(1.0, 0.2 * fit) if got else 0.0, name, got))
        if len(got) == 5 and results[-1][0] > 0.9:
            break
    best = max(results, key=lambda r: r[0])
    options, confidence, name = dict(best[2]), best[0], best[1]
    if len(options) < 5:
        for conf, _, got in sorted(results, key=lambda r: -r[0]):
            for letter, value in got.items():
                if letter not in options:
                    options[letter], confidence, name = value, min(confidence, conf), "merged"
    for _ in range(3):  # an option that holds the next one on the same line
        for letter, following in zip(LETTERS, LETTERS[1:], strict=False):
            m = re.match(rf"^(.+?)\s+{following}\)?\s+(\S.*)$", options.get(letter, ""))
            word = m.group(2).split()[0] if m else ""
            if m and following not in options and not (len(word) > 8 and word[0].islower()):
                options[letter], options[following] = m.group(1).strip(), m.group(2).strip()
    texts = [options[x] for x in LETTERS if x in options]
    if len(texts) >= 3 and sum(b in a for a, b in zip(texts, texts[1:], strict=False) if b) >= 2:
        kept = [x for x in LETTERS if x in options]
        for here, after in zip(kept[-2::-1], kept[:0:-1], strict=True):
            head = options[here].partition(options[after])[0].strip() if options[after] in options[here] else ""
            options[here] = head or options[here]
        confidence *= 0.9
    return {k: options[k] for k in sorted(options)}, round(confidence, 4), name if options else "none"


def extract_options(c: str | Column) -> Column:
    """Struct (options, confidence, strategy) by several strategies for lines, single lines and doubled letters."""

    @F.pandas_udf("struct<options:map<string,string>, confidence:double, strategy:string>")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_options(t or "") for t in texts], columns=["options", "confidence", "strategy"])

    return extracted(_col(c))


def relabel_options(c: str | Column) -> Column:
    """Runs of three to five lines that begin with the same letter get the letters A to E in order; short lines
    within a run are dropped."""

    @F.pandas_udf("string")
    def relabelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else _relabel(t))

    return relabelled(_col(c))


def _relabel(text: str) -> str:
    lines, out, i = text.split("\n"), [], 0
    start = re.compile(r"^([A-E])\s+(\S.{2,})")
    while i < len(lines):
        first = start.match(lines[i])
        run, j = [first.group(2)] if first else [], i + 1
        while first and j < len(lines) and len(run) < 5:
            m = start.match(lines[j])
            if m and m.group(1) == first.group(1):
                run.append(m.group(2))
            elif m or len(lines[j].strip()) >= 12:
                break
            j += 1
        if len(run) >= 3:
            out += [f"{letter} {value}" for letter, value in zip(LETTERS, run, strict=False)]
            i = j
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def options_ascend(c: str | Column, within: int = 10) -> Column:
    """Whether the first ``within`` lines that begin with an option letter and a blank do so in rising order (two at least)."""
    lines = F.slice(F.split(F.coalesce(_col(c), F.lit("")), r"\n"), 1, within)
    letters = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*[A-E]\s+\S")), lambda x: F.left(F.ltrim(x), F.lit(1)))
    return (F.size(letters) >= 2) & (letters == F.array_sort(F.array_distinct(letters)))
