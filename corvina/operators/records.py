"""Whole records put together: bundles with their children, chunks, and the phases of an extraction with model verdicts as input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.parsing import LETTERS
from corvina.functions.text import salvage_json


def child_rows(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """The rows of ``children`` whose ``key`` is a parent's.

    The distinct keys are compared first, so a key that very many rows share but no parent has is dropped before its rows move;
    a parent has few children.
    """
    known = children.select(key).distinct().join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")
    return children.join(known, key, "left_semi")


def bundles(questions: DataFrame, options: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per question: its columns, options (array of letter, text, is_correct in order), correct_answer, n_keys.

    ``options``: question_id, alternative_letter, alternative_text, alternative_order, id. ``keys``: exam_metadata_id, question_number,
    correct_answer; of several (languages) the smallest answer counts. Without a key no option is correct or wrong (null).
    Options and keys are aggregated before they are joined, so neither multiplies the other.
    """
    item = F.struct("alternative_order", "alternative_letter", "id", "alternative_text")
    listed = child_rows(options, "question_id", questions).groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("_o"))
    answers = keys.groupBy("exam_metadata_id", "question_number").agg(F.min("correct_answer").alias("correct_answer"), F.count(F.lit(1)).alias("n_keys"))
    both = questions.join(listed, "id", "left").join(answers, ["exam_metadata_id", "question_number"], "left")
    shown = F.transform(
        F.coalesce("_o", F.array().cast(listed.schema["_o"].dataType)),
        lambda x: F.struct(
            x["alternative_letter"].alias("letter"), x["alternative_text"].alias("text"), (x["alternative_letter"] == F.col("correct_answer")).alias("is_correct")
        ),
    )
    return both.withColumn("options", shown).withColumn("n_keys", F.coalesce("n_keys", F.lit(0))).drop("_o")


def option_lines(df: DataFrame, options: str) -> Column:
    """A column of options as lines 'A) text'. Strings that begin with a letter and a bracket stay as they are; others get the letter of
    their place (beyond E its number from 0). Structs (letter, text) use their own letter, in upper case, if they have one."""

    def fallback(i: Column) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(x) for x in LETTERS]), i), i.cast("string"))

    def plain(x: Column, i: Column) -> Column:
        return F.when(x.rlike(r"(?s)^[A-Ea-e]\).+"), x).otherwise(F.concat(fallback(i), F.lit(") "), F.coalesce(x, F.lit(""))))

    def named(x: Column, i: Column) -> Column:
        return F.concat(F.upper(F.coalesce(x["letter"], fallback(i))), F.lit(") "), F.coalesce(x["text"], F.lit("")))

    return F.transform(options, named if df.schema[options].dataType.simpleString().startswith("array<struct") else plain)


def build_chunks(df: DataFrame, id_column: str, text: str, options: str, context: str, shorten: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of each record: id, chunk_type, content, content_hash, token_count.

    'full' is the statement after '[ENUNCIADO] ' and a line for each option; 'context' is there if the context is not blank. The hash is
    that of the whole content; ``shorten`` (text to struct of content and token_count, like ``first_tokens``) is applied afterwards. Without
    it the content stays whole and token_count is null.
    """
    lines = F.coalesce(option_lines(df, options), F.array().cast("array<string>"))
    full = F.array_join(F.concat(F.array(F.concat(F.lit("[ENUNCIADO] "), F.coalesce(text, F.lit("")))), lines), "\n")
    piece = lambda kind, c: F.struct(F.lit(kind).alias("chunk_type"), c.alias("content"))
    both = F.array_compact(F.array(piece("full", full), F.when(F.col(context).rlike(r"\S"), piece("context", F.col(context)))))
    chunks = df.select(F.col(id_column).alias("id"), F.inline(both)).withColumn("content_hash", F.sha2("content", 256))
    if shorten is None:
        return chunks.withColumn("token_count", F.lit(None).cast("int"))
    return chunks.withColumn("_s", shorten(F.col("content"))).select("id", "chunk_type", F.col("_s.content").alias("content"), "content_hash", F.col("_s.token_count").alias("token_count"))


# ---------------------------------------------------------------- phases of an extraction


def chunks_to_search(chunks: DataFrame, hints: DataFrame, gaps: DataFrame) -> DataFrame:
    """Chunks in which missing questions may stand: those with a hinted number within a gap, or with options but no number.

    ``hints``: chunk_id, method, number, confidence; ``gaps``: gap_from, gap_to (at most some hundred). Result: the chunk's columns,
    n_hints, best_confidence.
    """
    numbers = gaps.select(F.explode(F.sequence(F.col("gap_from").cast("int"), F.col("gap_to").cast("int"))).alias("number")).distinct()  # at most the range of numbers
    named = hints.join(F.broadcast(numbers), "number").select("chunk_id", "confidence")
    loose = hints.where(F.col("number").isNull()).select("chunk_id", "confidence")
    found = named.unionByName(loose).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_hints"), F.max("confidence").alias("best_confidence"))
    return chunks.join(found, "chunk_id")


_CANDIDATES = "struct<missing_questions:array<struct<estimated_number:int,question_text:string,alternatives:array<string>,confidence:double,location_info:string,reconstruction_method:string>>>"


def parse_candidates(responses: DataFrame, response: str, location: str) -> DataFrame:
    """Questions that a model's JSON answers propose, those with exactly five options: number, question_text, options, confidence,
    location, method. Answers that are no JSON give none; text around the JSON does not matter."""
    parsed = F.from_json(salvage_json(response), _CANDIDATES)["missing_questions"]
    rows = responses.select(F.col(location).alias("_at"), F.explode(parsed).alias("q")).where(F.size("q.alternatives") == 5)
    return rows.select(
        F.col("q.estimated_number").alias("number"),
        F.coalesce("q.question_text", F.lit("")).alias("question_text"),
        F.col("q.alternatives").alias("options"),
        F.coalesce("q.confidence", F.lit(0.0)).alias("confidence"),
        F.concat_ws(" - ", "_at", F.coalesce("q.location_info", F.lit(""))).alias("location"),
        F.coalesce("q.reconstruction_method", F.lit("ai_detection")).alias("method"),
    )


def candidate_summary(candidates: DataFrame, sure: float = 0.7) -> DataFrame:
    """One row: candidates, those above ``sure``, mean confidence (0 without any)."""
    return candidates.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("confidence") > sure).alias("n_sure"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")
    )


def combine_phases(extracted: DataFrame, verdicts: DataFrame, repairs: DataFrame, detected: DataFrame, least: float = 0.4) -> DataFrame:
    """The result of an extraction in phases: number, text, phase, confidence, validation_error, repair_failed.

    ``extracted``: number, text. ``verdicts``: number, confidence, error (of a validation). ``repairs``: number, text (null: failed).
    ``detected``: number, text, confidence. A repaired question gains 0.3 of confidence, up to 0.9, and its text is the repaired one;
    detected questions count above ``least`` and where no extracted one has their number. Without a verdict the confidence is 0.5.
    """
    fixed = repairs.select("number", F.col("text").alias("_fixed"), F.lit(True).alias("_tried"))
    c = F.coalesce("confidence", F.lit(0.5))
    repaired = F.col("_fixed").isNotNull()
    first = (
        extracted.join(verdicts.select("number", "confidence", F.col("error").alias("_error")), "number", "left")
        .join(fixed, "number", "left")
        .select(
            "number",
            F.coalesce("_fixed", "text").alias("text"),
            F.when(repaired, "repaired").when(F.col("confidence").isNotNull(), "validated").otherwise("extracted").alias("phase"),
            F.when(repaired, F.greatest(c, F.least(F.lit(0.9), c + 0.3))).otherwise(c).alias("confidence"),
            F.col("_error").isNotNull().alias("validation_error"),
            (F.coalesce("_tried", F.lit(False)) & ~repaired).alias("repair_failed"),
        )
    )
    new = detected.where(F.col("confidence") > least).join(extracted.select("number"), "number", "left_anti")
    return first.unionByName(new.select("number", "text", F.lit("detected").alias("phase"), "confidence", F.lit(False).alias("validation_error"), F.lit(False).alias("repair_failed")))


def issue_lines(questions: DataFrame) -> DataFrame:
    """(number, issue) of each question of ``combine_phases``: validation error, failed repair, confidence below 0.5."""
    found = F.array_compact(
        F.array(F.when(F.col("validation_error"), "Validation error"), F.when(F.col("repair_failed"), "Repair failed"), F.when(F.col("confidence") < 0.5, "Low confidence score"))
    )
    return questions.select("number", F.explode(found).alias("issue"))


def confidence_map(questions: DataFrame, group: str) -> DataFrame:
    """(group, map of number to confidence) of the questions of each group, of which there are few (a booklet's)."""
    best = questions.groupBy(group, "number").agg(F.max("confidence").alias("c"))
    return best.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", "c")))).alias("confidences"))
