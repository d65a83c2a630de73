"""Registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import encoding
from corvina.llm.languages import label_languages, mislabelled
from corvina.llm.levels import level_profile, reading_levels
from corvina.llm.mixing import Mix
from corvina.llm.neighbours import nearest_vectors, similar_pairs
from corvina.llm.packing import container_fill, pack_texts
from corvina.llm.scans import learn, repair_scans
from corvina.llm.splitting import split_oversized
from corvina.llm.survivors import surviving_questions, surviving_records
from corvina.sources.tables import read_table


#: Undamaged texts from which the classifier's table of byte bigrams is made, at most so many of each field; words are counted over all.
ENCODING_SAMPLE = 3000


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("questions", "question_text"), ("question_alternatives", "alternative_text"))
    tables = [read_table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("ref_field"), "id", F.col(c).alias("text")) for t, c in fields]
    sample = [text for t in tables for text in encoding.training_sample(t, "id", ["text"], ENCODING_SAMPLE)]
    texts = tables[0].unionByName(tables[1])
    words = encoding.vocabulary(texts.where(F.length("text") > 0).select("text"))
    return encoding.repair_encoding(texts, encoding.fit(sample), keep=("ref_field",), words=words)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("ref_field", F.col("id").alias("record_id")).distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest_vectors(read_table(spark, sf_dir, "question_chunks")))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("questions", "raw_text"), ("questions", "question_text"), ("dead_letter_questions", "raw_text"))
    tables = [read_table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("ref_field"), "id", F.col(c).alias("text")) for t, c in fields]
    return repair_scans(tables[0].unionByName(tables[1]).unionByName(tables[2]), keep=("ref_field",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("ref_field", F.col("id").alias("record_id"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)


def _surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = read_table(spark, sf_dir, "questions")
    codes = encoding.fit(encoding.training_sample(questions, "id", ["question_text"], ENCODING_SAMPLE))
    texts = questions.where(F.length("question_text") > 0).select(F.col("question_text").alias("text"))
    return surviving_questions(questions, codes, encoding.vocabulary(texts), learn(texts))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surviving(spark, sf_dir).select("content_hash", "text_from", "confidence_from", "images_from")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_records(read_table(spark, sf_dir, "questions"), _surviving(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_levels(read_table(spark, sf_dir, "questions"))
    return levels.where(F.col("level").isNotNull()).select(F.col("id").alias("question_id"), "level")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = read_table(spark, sf_dir, "questions")
    return level_profile(reading_levels(questions), questions)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(read_table(spark, sf_dir, "question_chunks"))
    return pieces.where(F.col("n_pieces") > 1).select(F.col("id").alias("chunk_id")).distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "question_chunks"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_texts(read_table(spark, sf_dir, "documents"))
    return packed.where(F.col("n_parts") > 1).select(F.col("id").alias("doc_id")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_fill(pack_texts(read_table(spark, sf_dir, "documents")))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).rows()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = mislabelled(label_languages(read_table(spark, sf_dir, "documents")))
    return cases.select(F.col("id").alias("doc_id"), "language").distinct()


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_found": p6_found,
    "p6_profile": p6_profile,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
}

#: The exact answer over all pairs, for small tables.
_NEAR = """WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM question_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  p AS (SELECT a.id AS me, b.id AS other, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id),
  t AS (SELECT me, other FROM p WHERE s >= 0.92 QUALIFY row_number() OVER (PARTITION BY me ORDER BY round(s, 12) DESC, other) <= 5)
  SELECT DISTINCT least(me, other) AS id_a, greatest(me, other) AS id_b FROM t"""

ORACLE: dict[str, str] = {"p2_found": _NEAR}
