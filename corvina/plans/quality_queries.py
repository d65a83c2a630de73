"""Registered queries on references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.references import Reference, count_orphans, find_orphans
from corvina.sources.tables import read_table

EXAM = Reference("answer_keys.exam_metadata_id", ("exam_metadata_id",), ("id",), "exam_metadata")
NUMBER = Reference("answer_keys.question_number", ("exam_metadata_id", "question_number"), ("exam_metadata_id", "question_number"))
QUESTION = Reference("question_alternatives.question_id", ("question_id",), ("id",), "questions")


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the three references; numbers are judged only where the exam reference is no case."""
    keys, questions, gone = (read_table(spark, sf_dir, t) for t in ("answer_keys", "questions", "deletion_log"))
    exams = find_orphans(keys, read_table(spark, sf_dir, "exam_metadata"), EXAM, deletions=gone)
    judged = keys.join(exams.select(F.col("child_id").alias("id")), "id", "left_anti")
    numbers = find_orphans(judged, questions, NUMBER)
    options = find_orphans(read_table(spark, sf_dir, "question_alternatives"), questions, QUESTION, deletions=gone)
    return exams.unionByName(numbers).unionByName(options)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_orphans(spark, sf_dir).select("ref_field", "child_id", "status")


def p4_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_orphans(all_orphans(spark, sf_dir))


_CASES = r"""
WITH ek AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, min(created_at) AS born FROM exam_metadata WHERE id IS NOT NULL GROUP BY 1
), qk AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, min(created_at) AS born FROM questions WHERE id IS NOT NULL GROUP BY 1
), nk AS (
  SELECT lower(regexp_replace(exam_metadata_id, '^\s+|\s+$', '', 'g')) AS k, question_number AS num, min(created_at) AS born
  FROM questions WHERE exam_metadata_id IS NOT NULL AND question_number IS NOT NULL GROUP BY 1, 2
), gone AS (
  SELECT DISTINCT lower(trim(table_name)) AS tab, lower(regexp_replace(record_id, '^\s+|\s+$', '', 'g')) AS k FROM deletion_log
), exam_cases AS (
  SELECT DISTINCT 'answer_keys.exam_metadata_id' AS ref_field, c.id AS child_id,
         CASE WHEN ek.k IS NOT NULL THEN 'late' WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status, c.created_at
  FROM answer_keys c
  LEFT JOIN ek ON ek.k = lower(regexp_replace(c.exam_metadata_id, '^\s+|\s+$', '', 'g'))
  LEFT JOIN gone ON gone.tab = 'exam_metadata' AND gone.k = lower(regexp_replace(c.exam_metadata_id, '^\s+|\s+$', '', 'g'))
  WHERE c.exam_metadata_id IS NOT NULL AND (ek.k IS NULL OR ek.born > c.created_at)
), number_cases AS (
  SELECT DISTINCT 'answer_keys.question_number' AS ref_field, c.id AS child_id,
         CASE WHEN nk.k IS NOT NULL THEN 'late' ELSE 'missing' END AS status, c.created_at
  FROM answer_keys c
  LEFT JOIN nk ON nk.k = lower(regexp_replace(c.exam_metadata_id, '^\s+|\s+$', '', 'g')) AND nk.num = c.question_number
  WHERE c.exam_metadata_id IS NOT NULL AND c.question_number IS NOT NULL
    AND c.id NOT IN (SELECT child_id FROM exam_cases WHERE child_id IS NOT NULL)
    AND (nk.k IS NULL OR nk.born > c.created_at)
), option_cases AS (
  SELECT DISTINCT 'question_alternatives.question_id' AS ref_field, c.id AS child_id,
         CASE WHEN qk.k IS NOT NULL THEN 'late' WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status, c.created_at
  FROM question_alternatives c
  LEFT JOIN qk ON qk.k = lower(regexp_replace(c.question_id, '^\s+|\s+$', '', 'g'))
  LEFT JOIN gone ON gone.tab = 'questions' AND gone.k = lower(regexp_replace(c.question_id, '^\s+|\s+$', '', 'g'))
  WHERE c.question_id IS NOT NULL AND (qk.k IS NULL OR qk.born > c.created_at)
), cases AS (
  SELECT * FROM exam_cases UNION ALL SELECT * FROM number_cases UNION ALL SELECT * FROM option_cases
)
"""

QUERIES = {"p4_found": p4_found, "p4_orphans_by_month": p4_orphans_by_month}

ORACLE = {
    "p4_found": _CASES + "SELECT ref_field, child_id, status FROM cases",
    "p4_orphans_by_month": _CASES
    + "SELECT ref_field, strftime(created_at, '%Y-%m') AS month, status, count(*) AS n_rows FROM cases GROUP BY 1, 2, 3",
}
