"""One surviving record for each group of duplicates, chosen field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm import encoding, scans
from corvina.operators.ranking import smallest_last
from corvina.operators.skew import meet
from corvina.session import cut

# Fixed value: texts that only say that there is none: one pair of brackets without others inside, of few words, and the like.
_PLACEHOLDER = r"(?isU)^\s*(?:\[[^\[\]]{0,60}\]|\([^()]{0,60}\)|<[^<>]{0,60}>|\{[^{}]{0,60}\}|n/?a|none|null|\W+|todo|tbd|lorem ipsum.*)?\s*$"
_CUT = r"(?:\[\s*(?:\.{3}|…)\s*\]|…)\s*$"


def survivors(df: DataFrame, key: str, id_column: str, fields: dict[str, Sequence[Column]]) -> DataFrame:
    """For each group of two or more ids the record from which each field is taken.

    Result: the key, ``{field}_from`` for each of ``fields``, n_rows. A field comes from the record whose list of
    priorities is greatest, compared in order, null being least; ties go to the smallest id.

    There is one aggregation for all fields: the maximum of a struct of the priorities. Tasks combine their rows
    first, so a group that holds a third of all rows sends one row per task. No text is in it.

    Edge cases: rows with a null key are in no group; rows delivered twice (same id) count once, so a group of one id
    has no result; a field that is null everywhere comes from the smallest id; extra columns are ignored.
    """

    def best(priorities: Sequence[Column]) -> Column:
        parts = [x.alias(f"p{i}") for i, x in enumerate(y for p in priorities for y in (p.isNotNull(), p))]
        top = F.max(F.struct(*parts, smallest_last(F.col(id_column)).alias("last")))
        return F.decode(F.unhex(F.translate(F.rtrim(top["last"], F.lit("~")), "0123456789ABCDEF", "FEDCBA9876543210")), "UTF-8")

    return (
        df.where(F.col(key).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(key)
        .agg(
            *[best(p).alias(f"{name}_from") for name, p in fields.items()],
            F.count(F.lit(1)).alias("n_rows"),
            (F.min(id_column) != F.max(id_column)).alias("_several"),
        )
        .where("_several")
        .drop("_several")
    )


def text_condition(
    df: DataFrame, codes: encoding.Model, words: DataFrame, facts: scans.Facts, text_column: str, keep: Sequence[str]
) -> DataFrame:
    """``keep``, undamaged (neither garbled, nor with scan noise, nor empty, cut off or a placeholder), full_length.

    Every distinct text is judged once: copies of a wording are reduced to a digest first, and the digests of bad texts meet
    the rows, a text that very many rows have in a broadcast. ``words`` is the ``encoding.vocabulary`` and ``facts`` are those
    of ``scans`` for all texts. ``full_length`` counts characters with white space squeezed, so of several undamaged wordings
    the longest is the full one.
    """
    t = F.col(text_column)
    squeezed = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    fine = F.coalesce(~t.rlike(_PLACEHOLDER) & ~t.rlike(_CUT), F.lit(False))
    rows = cut(df.select(*keep, fine.alias("_fine"), F.coalesce(F.length(squeezed), F.lit(0)).alias("full_length"), F.md5(t).alias("_h")))
    texts = df.where(fine).select(F.md5(t).alias("_h"), t.alias("_text")).dropDuplicates(["_h"])
    garbled = encoding.repair_encoding(texts, codes, "_h", "_text", words=words).select("id")
    scanned = scans.find_damage(texts, facts, "_h", "_text").select("id")
    bad = cut(garbled.unionByName(scanned).distinct().select(F.col("id").alias("_h"), F.lit(True).alias("_bad")))
    met = meet(rows, bad, "_h", "left")
    return met.select(*keep, (F.col("_fine") & F.col("_bad").isNull()).alias("undamaged"), "full_length")


def surviving_questions(questions: DataFrame, codes: encoding.Model, words: DataFrame, facts: scans.Facts) -> DataFrame:
    """content_hash, text_from, confidence_from, images_from, n_rows of each group of questions with equal content_hash.

    Text: undamaged, full, then highest parsing_confidence, latest updated_at. Confidence: highest, then latest.
    Images: known, then latest. Ties: smallest id.
    """
    keep = ["id", "content_hash", "parsing_confidence", "has_images", "updated_at"]
    judged = text_condition(questions.where(F.col("content_hash").isNotNull()), codes, words, facts, "question_text", keep)
    trust, late = F.col("parsing_confidence"), F.col("updated_at")
    return survivors(
        judged,
        "content_hash",
        "id",
        {
            "text": [F.col("undamaged"), F.when(F.col("undamaged"), F.col("full_length")), trust, late],
            "confidence": [trust, late],
            "images": [F.col("has_images").isNotNull(), late],
        },
    )


def surviving_records(questions: DataFrame, found: DataFrame) -> DataFrame:
    """The surviving record of each group with its values and where each came from."""
    one = questions.dropDuplicates(["id"])

    def value(column: str, source: str, name: str) -> DataFrame:
        return one.select(F.col("id").alias(source), F.col(column).alias(name))

    return (
        found.join(value("question_text", "text_from", "question_text"), "text_from")
        .join(value("parsing_confidence", "confidence_from", "parsing_confidence"), "confidence_from")
        .join(value("has_images", "images_from", "has_images"), "images_from")
    )
