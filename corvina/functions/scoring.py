"""Scores, issues and grades of extracted records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.text import is_contaminated

# Placeholders of options that could not be extracted, and other marks the audit looks for.
PLACEHOLDER = r"(?iu)\[Alternative not found\]|\[Alternativa não encontrada\]"
CID_MARK = r"\(cid:\d+\)"
TYPESETTER_MARK = r"\.\.iinndd[db]"
MARKDOWN_MARK = r"#{1,3}\s*\*{1,2}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _opt(options: Column, i: int) -> Column:
    return F.coalesce(F.get(options, F.lit(i)), F.lit(""))


def option_quality(options: str | Column) -> Column:
    """Struct (score of at most 0.25, issue): placeholder, confirmed cascade, suspected cascade, short option, in this order."""
    o = F.coalesce(_col(options), F.array().cast("array<string>"))
    placeholder = F.exists(o, lambda x: x.rlike(PLACEHOLDER))
    confirmed = (F.size(o) >= 3) & F.contains(_opt(o, 0), _opt(o, 1)) & F.contains(_opt(o, 1), _opt(o, 2))
    suspected = (F.size(o) >= 5) & (F.length(_opt(o, 0)) > 3 * F.length(_opt(o, 4))) & (F.length(_opt(o, 4)) > 0)
    short = F.exists(o, lambda x: F.length(x) < 3)
    cases = [(F.size(o) == 0, 0.0, None), (placeholder, 0.0, "placeholder_detected"), (confirmed, 0.0, "cascade_confirmed"), (suspected, 0.05, "cascade_suspected"), (short, 0.10, "short_options")]
    score: Column = F.lit(0.25)
    issue: Column = F.lit(None).cast("string")
    for condition, points, name in reversed(cases):
        score = F.when(condition, points).otherwise(score)
        issue = F.when(condition, F.lit(name).cast("string")).otherwise(issue)
    return F.struct(score.alias("score"), issue.alias("issue"))


def confidence(text: str | Column, options: str | Column, number: str | Column, valid: Column | None = None) -> Column:
    """Struct (score rounded to 4, issues, routing) from six parts: 0.20 for five options, 0.15 for 50 characters of
    text, 0.25 for the options' quality, 0.10 for a number from 1 to 180, 0.20 for no contamination, 0.10 if valid.

    Routing looks at the sum before rounding: from 0.85 'accept', from 0.55 'fallback', else 'dead_letter'.
    """
    t = F.coalesce(_col(text), F.lit(""))
    o = F.coalesce(_col(options), F.array().cast("array<string>"))
    n = _col(number)
    five, long, placed = F.size(o) == 5, F.length(t) >= 50, F.coalesce(n.between(1, 180), F.lit(False))
    ok = valid if valid is not None else five & (F.length(t) > 0) & placed
    # The parts that cost most are worked out once, as an element that the rest refers to.
    costly = F.struct(
        option_quality(o).alias("quality"),
        is_contaminated(F.concat_ws(" ", t, F.array_join(o, " "))).alias("contaminated"),
        (F.regexp_count(t, F.lit(r"(?m)^[A-E]\s+\S.{2,}")) >= 3).alias("listed"),
    )
    points = lambda condition, p: F.when(condition, p).otherwise(0.0)

    def summed(x: Column) -> Column:
        clean = ~x["contaminated"] & ~x["listed"]
        return points(five, 0.20) + points(long, 0.15) + x["quality"]["score"] + points(placed, 0.10) + points(clean, 0.20) + points(ok, 0.10)

    def scored(x: Column) -> Column:
        issues = F.array_compact(
            F.array(
                F.when(~five, F.concat(F.lit("options="), F.size(o))),
                F.when(~long, F.concat(F.lit("text_length="), F.length(t))),
                x["quality"]["issue"],
                F.when(~placed, F.concat(F.lit("number="), F.coalesce(n.cast("string"), F.lit("null")))),
                F.when(x["contaminated"], "contaminated").when(x["listed"], "raw_options_in_text"),
                F.when(~ok, "invalid"),
            )
        )
        return F.struct(F.round(summed(x), 4).alias("score"), issues.alias("issues"), route(summed(x)).alias("routing"))

    return F.get(F.transform(F.array(costly), scored), F.lit(0))


def route(score: Column) -> Column:
    # Sums of decimal parts may end a hair below the bound they stand for.
    return F.when(score >= 0.85 - 1e-9, "accept").when(score >= 0.55 - 1e-9, "fallback").otherwise("dead_letter")


def audit_issues(text: str | Column, options: str | Column) -> Column:
    """Array of the eight kinds of issues that the quality audit counts."""
    t = F.coalesce(_col(text), F.lit(""))
    o = F.coalesce(_col(options), F.array().cast("array<string>"))
    whole = F.concat_ws(" ", t, F.array_join(o, " "))
    cascade = (
        (F.size(o) >= 5)
        & (F.length(_opt(o, 0)) > 3 * F.length(_opt(o, 4)))
        & (F.length(_opt(o, 4)) > 0)
        & F.contains(_opt(o, 0), _opt(o, 1))
        & F.contains(_opt(o, 1), _opt(o, 2))
    )
    return F.array_compact(
        F.array(
            F.when(F.exists(o, lambda x: x.rlike(PLACEHOLDER)), "placeholder"),
            F.when(is_contaminated(t), "header_pollution"),
            F.when(whole.rlike(CID_MARK), "cid_token"),
            F.when(whole.rlike(TYPESETTER_MARK), "typesetter_artefact"),
            F.when(whole.rlike(MARKDOWN_MARK), "markdown_artefact"),
            F.when(cascade, "cascade"),
            F.when(F.length(t) < 50, "short_text"),
            F.when(F.size(o) < 5, "missing_options"),
        )
    )


def repair_needs(text: str | Column, options: str | Column) -> Column:
    """Struct (problems, repair): too few or empty options, short text, broken signs, glyph codes, no sentence end.

    Repair is called for if options are missing, if there are two or more problems, or if the text is short.
    """
    t = F.coalesce(_col(text), F.lit(""))
    o = F.coalesce(_col(options), F.array().cast("array<string>"))
    missing = (F.size(o) < 5) | F.exists(o, lambda x: F.trim(x) == "")
    short = F.length(F.trim(t)) < 20
    problems = F.array_compact(
        F.array(
            F.when(missing, "missing_options"),
            F.when(short, "short_text"),
            F.when(t.rlike("�|\\?{2,}"), "broken_signs"),
            F.when(t.rlike(CID_MARK), "glyph_codes"),
            F.when(~F.rtrim(t).rlike(r"[.!?:…»”\")]$"), "no_sentence_end"),
        )
    )
    return F.struct(problems.alias("problems"), (missing | short | (F.size(problems) >= 2)).alias("repair"))


def layout_of(text: str | Column, keywords: dict[str, list[str]], bias: dict[str, float] | None = None, least: float = 0.3) -> Column:
    """Struct (layout, score): the layout with the largest share of its keywords in the text plus its bias; 'mixed', 0.5 below ``least``."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    scored = F.array(
        *[
            F.struct(
                (sum((F.contains(t, F.lit(w.lower())).cast("double") for w in words), F.lit(0.0)) / len(words) + F.lit((bias or {}).get(name, 0.0))).alias("score"),
                F.lit(name).alias("layout"),
            )
            for name, words in sorted(keywords.items())
        ]
    )
    best = F.array_max(scored)
    return F.when(best["score"] < least, F.struct(F.lit("mixed").alias("layout"), F.lit(0.5).alias("score"))).otherwise(
        F.struct(best["layout"].alias("layout"), best["score"].alias("score"))
    )


def text_features(text: str | Column, options: str | Column) -> Column:
    """Struct of numeric features of a text and its options for classifiers; each option is measured once, null ones only count."""
    o = F.coalesce(_col(options), F.array().cast("array<string>"))
    lengths = F.transform(F.filter(o, lambda x: x.isNotNull()), lambda x: F.length(x).cast("double"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("apart"))

    def step(a: Column, x: Column) -> Column:
        n, away = a["n"] + 1, x - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + away / n).alias("mean"), (a["apart"] + away * (away - away / n)).alias("apart"))

    moments = F.aggregate(lengths, start, step, lambda a: F.struct(a["mean"].alias("mean"), F.when(a["n"] > 0, F.sqrt(a["apart"] / a["n"])).alias("std")))
    return measured_features(text, F.size(o), moments["mean"], moments["std"])


def measured_features(text: str | Column, n_options: Column, mean_option: Column, std_option: Column) -> Column:
    """``text_features`` where the number of options and the mean and deviation of their lengths are known; null stands for 0."""
    t = F.coalesce(_col(text), F.lit(""))
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.struct(
        F.length(t).alias("n_chars"),
        F.size(words).alias("n_words"),
        F.regexp_count(t, F.lit(r"[.!?]+")).alias("n_sentences"),
        F.when(F.size(words) > 0, letters / F.size(words)).otherwise(0.0).alias("mean_word"),
        F.regexp_count(t, F.lit(r"\d")).alias("n_digits"),
        F.regexp_count(t, F.lit(",")).alias("n_commas"),
        F.regexp_count(t, F.lit(r"\?")).alias("n_questions"),
        F.coalesce(n_options, F.lit(0)).cast("int").alias("n_options"),
        F.coalesce(mean_option, F.lit(0.0)).alias("mean_option"),
        F.coalesce(std_option, F.lit(0.0)).alias("std_option"),
    )
