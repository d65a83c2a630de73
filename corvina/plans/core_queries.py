"""Registered queries for relational, window, set and aggregate operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import mining, ranking
from corvina.operators.records import bundles, child_rows
from corvina.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Tables in which rows delivered twice, exactly alike, count as one record.
TWICE = ("exam_metadata", "questions", "question_alternatives", "answer_keys", "question_chunks", "dead_letter_questions")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register


def records(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with rows delivered twice taken once."""
    df = read_table(spark, sf_dir, table)
    return df.dropDuplicates(["id"]) if table in TWICE else df


# ---------------------------------------------------------------- counts and groups

_ALL = ["exam_metadata", "questions", "question_alternatives", "answer_keys", "question_chunks", "dead_letter_questions"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(DISTINCT id) AS n_records, count(*) AS n_rows FROM {t}" for t in _ALL))
def table_counts(spark, sf):
    parts = [
        read_table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count_distinct("id").alias("n_records"), F.count(F.lit(1)).alias("n_rows")) for t in _ALL
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM lineitem GROUP BY 1")
def share_of_total(spark, sf):
    return ranking.share_of_total(read_table(spark, sf, "lineitem"), "l_returnflag")


@query(
    "SELECT e.year, e.day, count(*) AS n_questions FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON q.exam_metadata_id = e.id GROUP BY 1, 2"
)
def questions_by_year_and_day(spark, sf):
    q, e = records(spark, sf, "questions"), records(spark, sf, "exam_metadata")
    exams = e.select(F.col("id").alias("exam_metadata_id"), "year", "day")
    # Counting by exam first leaves one row per exam for the join.
    counted = q.groupBy("exam_metadata_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(exams, "exam_metadata_id").groupBy("year", "day").agg(F.sum("n").alias("n_questions"))


@query(
    "SELECT e.id, e.pdf_filename, count(q.id) AS n_questions FROM (SELECT DISTINCT * FROM exam_metadata) e LEFT JOIN (SELECT DISTINCT * FROM questions) q ON q.exam_metadata_id = e.id GROUP BY 1, 2"
)
def exams_with_question_counts(spark, sf):
    counted = records(spark, sf, "questions").groupBy(F.col("exam_metadata_id").alias("id")).agg(F.count(F.lit(1)).alias("n_questions"))
    return records(spark, sf, "exam_metadata").select("id", "pdf_filename").join(counted, "id", "left").fillna(0, ["n_questions"])


@query(
    "SELECT exam_metadata_id, min(question_number) AS first_number, max(question_number) AS last_number, count(*) AS n_questions FROM (SELECT DISTINCT * FROM questions) GROUP BY 1"
)
def number_range_by_exam(spark, sf):
    return (
        records(spark, sf, "questions")
        .groupBy("exam_metadata_id")
        .agg(F.min("question_number").alias("first_number"), F.max("question_number").alias("last_number"), F.count(F.lit(1)).alias("n_questions"))
    )


@query(
    "SELECT q.id, coalesce(a.n, 0) AS n_options FROM (SELECT DISTINCT * FROM questions) q LEFT JOIN (SELECT question_id, count(*) AS n FROM (SELECT DISTINCT * FROM question_alternatives) GROUP BY 1) a ON a.question_id = q.id WHERE coalesce(a.n, 0) <> 5"
)
def wrong_option_count(spark, sf):
    counted = records(spark, sf, "question_alternatives").groupBy(F.col("question_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return records(spark, sf, "questions").select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_options")).where("n_options <> 5")


@query(
    """SELECT e.id, (SELECT count(DISTINCT q.id) FROM questions q WHERE q.exam_metadata_id = e.id) AS n_questions,
       (SELECT count(DISTINCT q.subject) FROM questions q WHERE q.exam_metadata_id = e.id) AS n_subjects,
       (SELECT count(DISTINCT k.id) FROM answer_keys k WHERE k.exam_metadata_id = e.id) AS n_keys FROM (SELECT DISTINCT * FROM exam_metadata) e"""
)
def exam_rollup(spark, sf):
    q = read_table(spark, sf, "questions").groupBy(F.col("exam_metadata_id").alias("id")).agg(
        F.count_distinct("id").alias("n_questions"), F.count_distinct("subject").alias("n_subjects")
    )
    k = read_table(spark, sf, "answer_keys").groupBy(F.col("exam_metadata_id").alias("id")).agg(F.count_distinct("id").alias("n_keys"))
    # Each child is counted by exam before it is joined, so counts are not multiplied by one another.
    return records(spark, sf, "exam_metadata").select("id").join(q, "id", "left").join(k, "id", "left").fillna(0, ["n_questions", "n_subjects", "n_keys"])


@query(
    """SELECT extraction_method, count(*) FILTER (WHERE parsing_confidence = 1) AS n_full, count(*) FILTER (WHERE parsing_confidence >= 0.85 AND parsing_confidence < 1) AS n_high,
       count(*) FILTER (WHERE parsing_confidence >= 0.55 AND parsing_confidence < 0.85) AS n_middle, count(*) FILTER (WHERE parsing_confidence < 0.55) AS n_low,
       count(*) FILTER (WHERE parsing_confidence IS NULL) AS n_unknown FROM (SELECT DISTINCT * FROM questions) GROUP BY 1"""
)
def score_bands(spark, sf):
    c = F.col("parsing_confidence")
    bands = {"n_full": c == 1, "n_high": (c >= 0.85) & (c < 1), "n_middle": (c >= 0.55) & (c < 0.85), "n_low": c < 0.55, "n_unknown": c.isNull()}
    return records(spark, sf, "questions").groupBy("extraction_method").agg(*[F.count_if(b).alias(n) for n, b in bands.items()])


@query(
    "SELECT extraction_method, round(avg(parsing_confidence::DOUBLE), 4) AS mean_confidence, count(parsing_confidence) AS n_scored FROM (SELECT DISTINCT * FROM questions) GROUP BY 1"
)
def mean_confidence(spark, sf):
    c = F.col("parsing_confidence").cast("double")
    return records(spark, sf, "questions").groupBy("extraction_method").agg(F.round(F.avg(c), 4).alias("mean_confidence"), F.count(c).alias("n_scored"))


_OWN_OPTIONS = "(SELECT DISTINCT * FROM question_alternatives WHERE question_id IN (SELECT id FROM questions))"


@query(
    f"SELECT question_id, string_agg(alternative_letter || ') ' || alternative_text, chr(10) ORDER BY alternative_order, alternative_letter, id) AS options FROM {_OWN_OPTIONS} GROUP BY 1"
)
def options_as_text(spark, sf):
    """Options of each question joined in order; those of dangling references, which may be many under one key, are left out by a semi-join."""
    line = F.concat("alternative_letter", F.lit(") "), "alternative_text")
    return (
        own_options(spark, sf)
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("alternative_order", "alternative_letter", "id", line.alias("line")))).alias("o"))
        .select("question_id", F.array_join(F.transform("o", lambda x: x["line"]), "\n").alias("options"))
    )


def own_options(spark, sf):
    return child_rows(records(spark, sf, "question_alternatives"), "question_id", read_table(spark, sf, "questions"))


@query(f"SELECT question_id, array_to_string(list(alternative_letter ORDER BY alternative_order, alternative_letter, id), '') AS letters, count(*) AS n FROM {_OWN_OPTIONS} GROUP BY 1")
def options_as_array(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("alternative_order", "alternative_letter", "id")))
    return own_options(spark, sf).groupBy("question_id").agg(
        F.array_join(F.transform(items, lambda x: x["alternative_letter"]), "").alias("letters"), F.count(F.lit(1)).alias("n")
    )


@query(
    "SELECT exam_type, array_to_string(list(DISTINCT year ORDER BY year), ',') AS years, count(DISTINCT year) AS n_years FROM exam_metadata WHERE exam_type IS NOT NULL GROUP BY 1"
)
def years_by_exam_type(spark, sf):
    years = F.array_sort(F.collect_set("year"))
    return read_table(spark, sf, "exam_metadata").where("exam_type IS NOT NULL").groupBy("exam_type").agg(F.array_join(years, ",").alias("years"), F.size(years).alias("n_years"))


@query(
    "SELECT application_type, sum(file_size)::BIGINT AS total_bytes, round(avg(file_size), 2) AS mean_bytes, count(*) AS n_files FROM (SELECT DISTINCT * FROM exam_metadata) GROUP BY 1"
)
def file_sizes(spark, sf):
    return records(spark, sf, "exam_metadata").groupBy("application_type").agg(
        F.sum("file_size").alias("total_bytes"), F.round(F.avg("file_size"), 2).alias("mean_bytes"), F.count(F.lit(1)).alias("n_files")
    )


@query(
    """SELECT (SELECT count(DISTINCT id) FROM exam_metadata) AS n_exams, (SELECT count(DISTINCT id) FROM questions) AS n_questions, (SELECT count(DISTINCT id) FROM question_alternatives) AS n_options,
       (SELECT count(DISTINCT id) FROM answer_keys) AS n_keys, (SELECT round(avg(parsing_confidence::DOUBLE), 2) FROM (SELECT DISTINCT * FROM questions)) AS mean_confidence,
       (SELECT min(year) FROM exam_metadata) AS first_year, (SELECT max(year) FROM exam_metadata) AS last_year"""
)
def parsing_stats(spark, sf):
    """One row of totals; every part is an aggregate of its own, put together as scalars."""
    one = {
        "n_exams": read_table(spark, sf, "exam_metadata").agg(F.count_distinct("id")),
        "n_questions": read_table(spark, sf, "questions").agg(F.count_distinct("id")),
        "n_options": read_table(spark, sf, "question_alternatives").agg(F.count_distinct("id")),
        "n_keys": read_table(spark, sf, "answer_keys").agg(F.count_distinct("id")),
        "mean_confidence": records(spark, sf, "questions").agg(F.round(F.avg(F.col("parsing_confidence").cast("double")), 2)),
        "first_year": read_table(spark, sf, "exam_metadata").agg(F.min("year")),
        "last_year": read_table(spark, sf, "exam_metadata").agg(F.max("year")),
    }
    return spark.range(1).select(*[x.scalar().alias(n) for n, x in one.items()])


@query(
    """WITH c AS (SELECT l_shipmode_flag AS value, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_flag FROM lineitem) GROUP BY 1)
       SELECT value, n, value = (SELECT min(value) FROM c WHERE n = (SELECT max(n) FROM c)) AS is_mode FROM c"""
)
def value_counts(spark, sf):
    return mining.value_counts(read_table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flags")), "flags")


@query(
    "SELECT source, count(length(text)) AS n_texts, round(avg(length(text)), 4) AS mean, median(length(text))::DOUBLE AS median, min(length(text)) AS least, max(length(text)) AS most, round(stddev_samp(length(text)), 4) AS deviation FROM documents GROUP BY 1"
)
def length_stats(spark, sf):
    stats = mining.length_stats(read_table(spark, sf, "documents"), "text", "source")
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


_PRIORITY = {"1-urgent": 1, "2-high": 2, "3-medium": 3, "4-not specified": 4, "5-low": 5}


@query(
    """SELECT year(o_orderdate) AS year, round(avg(CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 1 WHEN '2-high' THEN 2 WHEN '3-medium' THEN 3 WHEN '4-not specified' THEN 4 WHEN '5-low' THEN 5 END), 4) AS mean,
       count(CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 1 WHEN '2-high' THEN 2 WHEN '3-medium' THEN 3 WHEN '4-not specified' THEN 4 WHEN '5-low' THEN 5 END) AS n_mapped, count(*) AS n_rows FROM orders GROUP BY 1"""
)
def ordinal_mean_by_year(spark, sf):
    df = read_table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return mining.ordinal_mean(df, "o_orderpriority", _PRIORITY, "year").withColumn("mean", F.round("mean", 4))


@query(
    r"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 20"""
)
def term_top20(spark, sf):
    return mining.top_terms(read_table(spark, sf, "documents"), "text", 20)


@query("SELECT lower(left(text, 50)) AS prefix, count(*) AS n FROM documents WHERE length(text) > 50 GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def prefix_top10(spark, sf):
    return mining.top_prefixes(read_table(spark, sf, "documents"), "text", 50, 10)


@query(
    r"""SELECT source, term, n, place FROM (SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS place FROM
        (SELECT source, term, count(*) AS n FROM (SELECT lower(trim(source)) AS source, unnest(regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')) AS term FROM documents WHERE source IS NOT NULL) WHERE term <> '' GROUP BY 1, 2)) WHERE place <= 20"""
)
def source_keywords(spark, sf):
    df = read_table(spark, sf, "documents").where("source IS NOT NULL").withColumn("source", F.lower(F.trim("source")))
    return mining.top_terms_by(df, "text", "source", 20)


@query(
    f"""WITH c AS (SELECT question_id, count(*) AS n FROM {_OWN_OPTIONS} GROUP BY 1) SELECT round(avg(n), 4) AS mean_options,
        (SELECT n FROM (SELECT n, count(*) AS m FROM c GROUP BY 1 ORDER BY m DESC, n LIMIT 1)) AS mode_options FROM c"""
)
def option_count_mode(spark, sf):
    counted = own_options(spark, sf).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    return sizes.agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("m"), 4).alias("mean_options"), F.max_by("n", F.struct("m", -F.col("n"))).alias("mode_options"))


@query(
    """SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, grouping(user_id) AS g_user, grouping(event_type) AS g_type FROM events
       GROUP BY GROUPING SETS ((user_id), (event_type), ())"""
)
def multi_breakdown(spark, sf):
    df = read_table(spark, sf, "events").select("user_id", "event_type", "value")
    sets = [[F.col("user_id")], [F.col("event_type")], []]
    return df.groupingSets(sets, "user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("user_id").cast("long").alias("g_user"), F.grouping("event_type").cast("long").alias("g_type")
    )


@query(
    """SELECT name, value, target, CASE WHEN value >= target THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
         SELECT 'long_enough' AS name, round(avg(CASE WHEN length(question_text) >= 50 THEN 1.0 ELSE 0.0 END) * 100, 1)::DOUBLE AS value, 90.0::DOUBLE AS target FROM (SELECT DISTINCT * FROM questions)
         UNION ALL SELECT 'trusted', round(avg(CASE WHEN parsing_confidence >= 0.85 THEN 1.0 WHEN parsing_confidence < 0.85 THEN 0.0 END) * 100, 1)::DOUBLE, 80.0 FROM (SELECT DISTINCT * FROM questions)
         UNION ALL SELECT 'hashed', round(avg(CASE WHEN content_hash IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 1)::DOUBLE, 99.0 FROM (SELECT DISTINCT * FROM questions))"""
)
def audit_rates(spark, sf):
    rates = {
        "long_enough": (F.length("question_text") >= 50, 90.0),
        "trusted": (F.col("parsing_confidence") >= 0.85, 80.0),
        "hashed": (F.col("content_hash").isNotNull(), 99.0),
    }
    return mining.rate_checks(records(spark, sf, "questions"), rates)


@query(
    """SELECT q.subject, CASE WHEN question_number BETWEEN 46 AND 90 THEN 'ciencias_humanas' WHEN question_number BETWEEN 91 AND 135 THEN 'ciencias_natureza' WHEN question_number BETWEEN 136 AND 180 THEN 'matematica' ELSE 'linguagens' END AS area,
       count(*) AS n FROM (SELECT DISTINCT * FROM answer_keys) q GROUP BY 1, 2"""
)
def subject_against_number(spark, sf):
    from corvina.functions.parsing import area_of_number

    keys = records(spark, sf, "answer_keys").withColumn("area", area_of_number("question_number"))
    return mining.confusion(keys, "subject", "area").select(F.col("actual").alias("subject"), F.col("predicted").alias("area"), "n")


@query(
    """WITH m AS (SELECT extraction_method, avg(parsing_confidence::DOUBLE) AS mean FROM (SELECT DISTINCT * FROM questions) WHERE parsing_confidence IS NOT NULL GROUP BY 1)
       SELECT (SELECT min(extraction_method) FROM m WHERE mean = (SELECT max(mean) FROM m)) AS best, round((SELECT max(mean) FROM m), 4) AS best_mean,
              (SELECT min(extraction_method) FROM m WHERE mean = (SELECT min(mean) FROM m)) AS worst, round((SELECT min(mean) FROM m), 4) AS worst_mean"""
)
def best_extractor(spark, sf):
    m = (
        records(spark, sf, "questions").where("parsing_confidence IS NOT NULL").groupBy("extraction_method").agg(F.avg(F.col("parsing_confidence").cast("double")).alias("mean"))
    )
    return m.agg(
        F.max_by("extraction_method", "mean").alias("best"),
        F.round(F.max("mean"), 4).alias("best_mean"),
        F.min_by("extraction_method", "mean").alias("worst"),
        F.round(F.min("mean"), 4).alias("worst_mean"),
    )


@query(
    """SELECT e.year, count(*) FILTER (WHERE q.id IS NOT NULL) AS n_questions, round(100.0 * count(*) FILTER (WHERE q.parsing_confidence >= 0.85) / count(*), 2)::DOUBLE AS extraction_rate
       FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id GROUP BY 1"""
)
def extraction_rate_by_year(spark, sf):
    per_exam = records(spark, sf, "questions").groupBy(F.col("exam_metadata_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("parsing_confidence") >= 0.85).alias("good")
    )
    joined = per_exam.join(records(spark, sf, "exam_metadata").select("id", "year"), "id")
    return joined.groupBy("year").agg(F.sum("n").alias("n_questions"), F.round(F.lit(100.0) * F.sum("good") / F.sum("n"), 2).alias("extraction_rate"))


@query("SELECT chunk_type, sum(token_count)::BIGINT AS total_tokens, count(*) AS n_chunks, count(token_count) AS n_counted FROM (SELECT DISTINCT id, chunk_type, token_count FROM question_chunks) GROUP BY 1")
def chunk_tokens(spark, sf):
    return read_table(spark, sf, "question_chunks").select("id", "chunk_type", "token_count").dropDuplicates(["id"]).groupBy("chunk_type").agg(
        F.sum("token_count").alias("total_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.count("token_count").alias("n_counted")
    )


@query(
    """SELECT o_custkey, o_orderkey, round(spent, 2) AS spent FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM orders) WHERE spent <= 500000"""
)
def running_budget(spark, sf):
    out = ranking.running_budget(read_table(spark, sf, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 500_000.0, ["o_custkey"])
    return out.select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"))


@query("SELECT o_orderkey, round(spent, 2) AS spent FROM (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM orders) WHERE spent <= 50000000")
def running_budget_overall(spark, sf):
    """One budget for all rows; the running sum needs no single task."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ranking.running_budget(orders, [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 50_000_000.0).select("o_orderkey", F.round("spent", 2).alias("spent"))


_ASCII = "regexp_replace(coalesce(question_text, ''), '[^\\x00-\\x7f]', '?', 'g')"


@query(
    f"""WITH q AS (SELECT DISTINCT id, content_hash, question_number, lower(trim(subject)) AS subject, parsing_confidence, {_ASCII} AS t FROM questions WHERE content_hash IS NOT NULL),
        g AS (SELECT *, first_value(id) OVER (PARTITION BY content_hash ORDER BY parsing_confidence DESC NULLS LAST, id) AS best FROM q),
        m AS (SELECT g.subject, g.t AS got, b.t AS want, g.question_number IS NOT DISTINCT FROM b.question_number AS same, g.extraction_method_ok FROM (SELECT g.*, length(t) >= 20 AS extraction_method_ok FROM g) g JOIN q b ON b.id = g.best)
        SELECT subject, count(*) AS n_golden, count(*) FILTER (WHERE extraction_method_ok) AS n_found, round(avg(extraction_method_ok::INT), 6) AS completeness,
          round(avg(CASE WHEN extraction_method_ok THEN CASE WHEN length(want) = 0 THEN CASE WHEN got = '' THEN 0.0 ELSE 1.0 END ELSE least(1.0, levenshtein(got, want) / length(want)::DOUBLE) END END), 6) AS error_rate,
          round(avg(CASE WHEN extraction_method_ok THEN same::INT END), 6) AS question_number_accuracy FROM m GROUP BY 1"""
)
def golden_errors(spark, sf):
    """Every extracted wording (of 20 characters or more) against the most trusted one of its question: error rate, completeness, accuracy of numbers, by subject.

    Characters beyond ASCII count alike, so that engines which count bytes agree.
    """
    plain = F.regexp_replace(F.coalesce("question_text", F.lit("")), r"[^\x00-\x7f]", "?")
    q = records(spark, sf, "questions").where("content_hash IS NOT NULL").select("id", "content_hash", "question_number", F.lower(F.trim("subject")).alias("subject"), "parsing_confidence", plain.alias("t"))
    best = ranking.canonical_rows(q, "content_hash", "parsing_confidence", "id").select("id", "canonical_id")
    wanted = q.select(F.col("id").alias("canonical_id"), "t", "question_number")
    golden = best.join(q.select("id", "subject"), "id").join(wanted, "canonical_id")
    out = mining.golden_metrics(q.where(F.length("t") >= 20).select("id", "t", "question_number"), golden, ["id"], "t", "subject", "question_number")
    return out.withColumns({c: F.round(c, 6) for c in ("completeness", "error_rate", "question_number_accuracy")})


# ---------------------------------------------------------------- filters and pages


@query(
    """WITH f AS (SELECT q.id, q.question_number, e.year, e.day, e.caderno FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id WHERE e.day = 1 AND q.question_text ILIKE '%água%')
       SELECT id, question_number, year, day, caderno, (SELECT count(*) FROM f) AS total_rows, (SELECT ceil(count(*) / 20.0)::BIGINT FROM f) AS total_pages, (SELECT ceil(count(*) / 20.0) > 2 FROM f) AS has_next, true AS has_prev
       FROM f ORDER BY year DESC, day, caderno, question_number, id LIMIT 20 OFFSET 20"""
)
def filtered_page(spark, sf):
    exams = records(spark, sf, "exam_metadata").where("day = 1").select(F.col("id").alias("exam_metadata_id"), "year", "day", "caderno")
    rows = records(spark, sf, "questions").where(F.col("question_text").ilike("%água%")).select("id", "question_number", "exam_metadata_id").join(exams, "exam_metadata_id").drop("exam_metadata_id")
    return ranking.page(rows, [F.desc("year"), F.col("day"), F.col("caderno"), F.col("question_number"), F.col("id")], 2, 20)


@query("SELECT id FROM (SELECT DISTINCT * FROM questions) WHERE question_text ILIKE '%gráfico%' OR context_text ILIKE '%gráfico%'")
def any_text_like(spark, sf):
    return records(spark, sf, "questions").where(F.col("question_text").ilike("%gráfico%") | F.col("context_text").ilike("%gráfico%")).select("id")


@query(
    "SELECT count(*) FILTER (WHERE context_text IS NULL OR trim(context_text) = '') AS no_context, count(*) FILTER (WHERE raw_text IS NULL OR trim(raw_text) = '') AS no_raw_text, count(*) FILTER (WHERE has_images IS NULL) AS no_image_flag FROM (SELECT DISTINCT * FROM questions)"
)
def blank_fields(spark, sf):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return records(spark, sf, "questions").agg(
        F.count_if(blank("context_text")).alias("no_context"), F.count_if(blank("raw_text")).alias("no_raw_text"), F.count_if(F.col("has_images").isNull()).alias("no_image_flag")
    )


@query("SELECT id, subject FROM (SELECT DISTINCT * FROM questions) WHERE question_number IN (1, 46, 91, 136)")
def number_membership(spark, sf):
    return records(spark, sf, "questions").where(F.col("question_number").isin(1, 46, 91, 136)).select("id", "subject")


@query("SELECT id, CASE WHEN length(question_text) > 150 THEN left(question_text, 150) || '...' ELSE question_text END AS preview FROM (SELECT DISTINCT * FROM questions)")
def text_previews(spark, sf):
    t = F.col("question_text")
    return records(spark, sf, "questions").select("id", F.when(F.length(t) > 150, F.concat(F.substring(t, 1, 150), F.lit("..."))).otherwise(t).alias("preview"))


_SUBJECT_SQL = """CASE WHEN s LIKE '%linguagens%' THEN 'linguagens' WHEN s LIKE '%humanas%' THEN 'ciencias_humanas' WHEN s LIKE '%natureza%' THEN 'ciencias_natureza' WHEN s LIKE '%matem%' THEN 'matematica' ELSE coalesce(nullif(s, ''), 'geral') END"""


@query(f"SELECT {_SUBJECT_SQL} AS subject, count(*) AS n FROM (SELECT lower(trim(replace(subject, 'Subject.', ''))) AS s FROM (SELECT DISTINCT * FROM questions)) GROUP BY 1")
def canonical_subjects(spark, sf):
    s = F.lower(F.trim(F.replace(F.col("subject"), F.lit("Subject."), F.lit(""))))
    name = (
        F.when(s.like("%linguagens%"), "linguagens").when(s.like("%humanas%"), "ciencias_humanas").when(s.like("%natureza%"), "ciencias_natureza").when(s.like("%matem%"), "matematica")
    ).otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("geral")))
    return records(spark, sf, "questions").groupBy(name.alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM (SELECT DISTINCT * FROM questions) WHERE question_number BETWEEN 1 AND 180 AND length(question_text) >= 50 AND parsing_confidence >= 0.8 AND content_hash IS NOT NULL")
def structurally_valid(spark, sf):
    ok = F.col("question_number").between(1, 180) & (F.length("question_text") >= 50) & (F.col("parsing_confidence") >= 0.8) & F.col("content_hash").isNotNull()
    return records(spark, sf, "questions").where(ok).select("id")


@query("SELECT DISTINCT id, question_number, md5(id) AS h FROM questions ORDER BY h, id LIMIT 10")
def hash_sample(spark, sf):
    """Ten questions chosen by a hash of the id: a sample that is the same in every run."""
    return records(spark, sf, "questions").select("id", "question_number", F.md5("id").alias("h")).orderBy("h", "id").limit(10)


# ---------------------------------------------------------------- joins


@query("SELECT q.id, q.question_number, e.year, e.caderno FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id")
def questions_with_exams(spark, sf):
    exams = records(spark, sf, "exam_metadata").select(F.col("id").alias("exam_metadata_id"), "year", "caderno")
    return records(spark, sf, "questions").join(exams, "exam_metadata_id").select("id", "question_number", "year", "caderno")


@query(
    """SELECT q.id, q.question_number, coalesce(k.correct_answer, '-') AS correct_answer, coalesce(k.language_option, 'ingles') AS language_option FROM (SELECT DISTINCT * FROM questions) q
       LEFT JOIN (SELECT DISTINCT * FROM answer_keys) k ON k.exam_metadata_id = q.exam_metadata_id AND k.question_number = q.question_number"""
)
def questions_with_keys(spark, sf):
    keys = records(spark, sf, "answer_keys").select("exam_metadata_id", "question_number", "correct_answer", "language_option")
    joined = records(spark, sf, "questions").select("id", "exam_metadata_id", "question_number").join(keys, ["exam_metadata_id", "question_number"], "left")
    return joined.select("id", "question_number", F.coalesce("correct_answer", F.lit("-")).alias("correct_answer"), F.coalesce("language_option", F.lit("ingles")).alias("language_option"))


@query(
    """SELECT q.id, k.correct_answer FROM (SELECT DISTINCT id, exam_metadata_id, question_number, subject FROM questions) q
       LEFT JOIN (SELECT DISTINCT * FROM answer_keys) k ON k.exam_metadata_id = q.exam_metadata_id AND k.question_number = q.question_number AND lower(trim(k.subject)) = lower(trim(q.subject))"""
)
def questions_with_subject_keys(spark, sf):
    """Keys of the same exam, number and subject."""
    on = ["exam_metadata_id", "question_number", "s"]
    keys = records(spark, sf, "answer_keys").select("exam_metadata_id", "question_number", F.lower(F.trim("subject")).alias("s"), "correct_answer")
    q = records(spark, sf, "questions").select("id", "exam_metadata_id", "question_number", F.lower(F.trim("subject")).alias("s"))
    return q.join(keys, on, "left").select("id", "correct_answer")


@query(
    f"""SELECT q.id, q.question_number, e.year, k.correct_answer, coalesce(k.n, 0) AS n_keys, coalesce(a.t, '') AS options FROM (SELECT DISTINCT id, question_number, exam_metadata_id FROM questions) q
        LEFT JOIN (SELECT DISTINCT id, year FROM exam_metadata) e ON e.id = q.exam_metadata_id
        LEFT JOIN (SELECT exam_metadata_id, question_number, min(correct_answer) AS correct_answer, count(*) AS n FROM (SELECT DISTINCT * FROM answer_keys) GROUP BY 1, 2) k ON k.exam_metadata_id = q.exam_metadata_id AND k.question_number = q.question_number
        LEFT JOIN (SELECT o.question_id, string_agg(o.alternative_letter || ') ' || coalesce(o.alternative_text, '') || CASE WHEN o.alternative_letter = k.correct_answer THEN ' *' ELSE '' END, chr(10) ORDER BY o.alternative_order, o.alternative_letter, o.id) AS t
          FROM {_OWN_OPTIONS} o JOIN (SELECT DISTINCT id, question_number, exam_metadata_id FROM questions) q ON q.id = o.question_id
          LEFT JOIN (SELECT exam_metadata_id, question_number, min(correct_answer) AS correct_answer FROM answer_keys GROUP BY 1, 2) k ON k.exam_metadata_id = q.exam_metadata_id AND k.question_number = q.question_number GROUP BY 1) a ON a.question_id = q.id"""
)
def question_bundles(spark, sf):
    """Each question with its exam, its options in order, and which of them is correct, in one row."""
    q = records(spark, sf, "questions").select("id", "question_number", "exam_metadata_id")
    exams = records(spark, sf, "exam_metadata").select(F.col("id").alias("exam_metadata_id"), "year")
    full = bundles(q, records(spark, sf, "question_alternatives"), records(spark, sf, "answer_keys")).join(exams, "exam_metadata_id", "left")
    line = lambda o: F.concat(o["letter"], F.lit(") "), F.coalesce(o["text"], F.lit("")), F.when(o["is_correct"], " *").otherwise(""))
    return full.select("id", "question_number", "year", "correct_answer", "n_keys", F.array_join(F.transform("options", line), "\n").alias("options"))


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def orphan_parents(spark, sf):
    """Parents without children; an anti-join, as a left join with a null test keeps all children."""
    children = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read_table(spark, sf, "orders").select("o_orderkey").join(children, "o_orderkey", "left_anti")


@query("SELECT q.id FROM (SELECT DISTINCT * FROM questions) q WHERE q.id IN (SELECT question_id FROM question_chunks)")
def questions_with_chunks(spark, sf):
    return records(spark, sf, "questions").select("id").join(read_table(spark, sf, "question_chunks").select(F.col("question_id").alias("id")), "id", "left_semi")


@query(
    """SELECT n.n_name, r.r_name, count(DISTINCT o.o_orderkey) AS n_orders, count(DISTINCT c.c_custkey) AS n_customers FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
       JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2"""
)
def star_join(spark, sf):
    c, n, r, o = (read_table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    per_customer = o.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n"))
    joined = c.join(per_customer, c.c_custkey == per_customer.o_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))


@query(
    """SELECT q.id, (SELECT count(DISTINCT a.id) FROM question_alternatives a WHERE a.question_id = q.id) AS n_options,
       (SELECT min(k.correct_answer) FROM answer_keys k WHERE k.exam_metadata_id = q.exam_metadata_id AND k.question_number = q.question_number) AS first_key FROM (SELECT DISTINCT * FROM questions) q"""
)
def correlated_counts(spark, sf):
    options = read_table(spark, sf, "question_alternatives").groupBy(F.col("question_id").alias("id")).agg(F.count_distinct("id").alias("n_options"))
    keys = read_table(spark, sf, "answer_keys").groupBy("exam_metadata_id", "question_number").agg(F.min("correct_answer").alias("first_key"))
    q = records(spark, sf, "questions").select("id", "exam_metadata_id", "question_number")
    return q.join(options, "id", "left").join(keys, ["exam_metadata_id", "question_number"], "left").select("id", F.coalesce("n_options", F.lit(0)).alias("n_options"), "first_key")


@query(
    """SELECT DISTINCT a.id FROM question_alternatives a WHERE a.question_id IN (SELECT q.id FROM questions q WHERE q.question_number = 10 AND q.exam_metadata_id IN (SELECT e.id FROM exam_metadata e WHERE e.day = 1))"""
)
def nested_lookup(spark, sf):
    exams = read_table(spark, sf, "exam_metadata").where("day = 1").select(F.col("id").alias("exam_metadata_id"))
    q = read_table(spark, sf, "questions").where("question_number = 10").join(exams, "exam_metadata_id", "left_semi").select(F.col("id").alias("question_id"))
    return records(spark, sf, "question_alternatives").join(q, "question_id", "left_semi").select("id")


@query(
    """SELECT c.id, CASE WHEN v.vec_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT doc_id AS id FROM documents) c LEFT JOIN embeddings v ON v.vec_id = c.id"""
)
def vector_lookup(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("there"))
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(vectors, "id", "left").select("id", F.when(F.col("there"), "ok").otherwise("missing").alias("status"))


@query(
    """SELECT g.id AS key_file_id, min(c.id) AS booklet_id FROM (SELECT DISTINCT * FROM exam_metadata WHERE file_type = 'gabarito') g LEFT JOIN (SELECT DISTINCT * FROM exam_metadata WHERE file_type = 'caderno_questoes') c
       ON c.year = g.year AND c.day = g.day AND c.caderno = g.caderno AND c.application_type = g.application_type GROUP BY 1"""
)
def key_files_to_booklets(spark, sf):
    e = records(spark, sf, "exam_metadata")
    on = ["year", "day", "caderno", "application_type"]
    booklets = e.where("file_type = 'caderno_questoes'").groupBy(*on).agg(F.min("id").alias("booklet_id"))
    return e.where("file_type = 'gabarito'").select(F.col("id").alias("key_file_id"), *on).join(booklets, on, "left").select("key_file_id", "booklet_id")


@query(
    """WITH b AS (SELECT n_nationkey AS band, n_nationkey * 40.0 AS low, n_nationkey * 40.0 + 60.0 AS high FROM nation) SELECT e.event_id, b.band FROM events e JOIN b ON e.value BETWEEN b.low AND b.high"""
)
def range_join(spark, sf):
    bands = read_table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * F.lit(40.0)).alias("low"), (F.col("n_nationkey") * F.lit(40.0) + 60.0).alias("high")
    )
    return ranking.interval_join(read_table(spark, sf, "events").select("event_id", "value"), "value", bands, "low", "high", 50.0).select("event_id", "band")


_BOX = "SELECT p_brand AS page, p_partkey AS id, (p_partkey % 40)::DOUBLE AS x0, (p_partkey % 30)::DOUBLE AS y0, (p_partkey % 40 + p_size % 7 + 1)::DOUBLE AS x1, (p_partkey % 30 + p_size % 5 + 1)::DOUBLE AS y1 FROM part"


@query(
    f"WITH b AS ({_BOX}) SELECT l.page, l.id AS left_id, r.id AS right_id FROM b l JOIN b r ON l.page = r.page AND l.id < r.id AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1"
)
def overlapping_boxes(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    boxes = read_table(spark, sf, "part").select(
        F.col("p_brand").alias("page"), key.alias("id"), (key % 40).cast("double").alias("x0"), (key % 30).cast("double").alias("y0"),
        (key % 40 + size % 7 + 1).cast("double").alias("x1"), (key % 30 + size % 5 + 1).cast("double").alias("y1"),
    )
    return ranking.overlapping_boxes(boxes, boxes, "page", 8.0).where("left_id < right_id")


# ---------------------------------------------------------------- windows


@query(
    """SELECT id, question_number, (SELECT count(DISTINCT id) FROM dead_letter_questions) AS total_rows, (SELECT ceil(count(DISTINCT id) / 50.0)::BIGINT FROM dead_letter_questions) AS total_pages,
       (SELECT ceil(count(DISTINCT id) / 50.0) > 1 FROM dead_letter_questions) AS has_next, false AS has_prev FROM (SELECT DISTINCT id, question_number, created_at FROM dead_letter_questions) ORDER BY created_at DESC, id LIMIT 50"""
)
def page_with_total(spark, sf):
    rows = records(spark, sf, "dead_letter_questions").select("id", "question_number", "created_at")
    return ranking.page(rows, [F.desc("created_at"), F.col("id")], 1, 50).drop("created_at")


@query(
    """SELECT id, content_hash, first_value(id) OVER (PARTITION BY content_hash ORDER BY parsing_confidence DESC NULLS LAST, id) AS canonical_id, count(*) OVER (PARTITION BY content_hash) AS group_size
       FROM (SELECT DISTINCT * FROM questions) WHERE content_hash IS NOT NULL"""
)
def canonical_questions(spark, sf):
    return ranking.canonical_rows(records(spark, sf, "questions").where("content_hash IS NOT NULL"), "content_hash", "parsing_confidence", "id")


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"
)
def first_occurrences(spark, sf):
    return ranking.first_of(read_table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query(
    """SELECT o_orderkey, o_custkey, order_no, o_orderkey % 5 <> 0 AS answered FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS order_no FROM orders) WHERE order_no <= 45"""
)
def numbered_selection(spark, sf):
    from corvina.operators.search import pick_with_keys

    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    keys = orders.where("o_orderkey % 5 <> 0").select("o_orderkey")
    return pick_with_keys(orders, keys, ["o_orderkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 45).drop("o_totalprice")


@query(
    """SELECT count(*) AS n_selected, array_to_string(list(order_no ORDER BY order_no) FILTER (WHERE o_orderkey % 5 = 0), ',') AS missing_answers FROM (
         SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS order_no FROM orders) WHERE order_no <= 45"""
)
def missing_answers(spark, sf):
    """The order numbers of a selection that have no answer."""
    from corvina.operators.search import missing_numbers, pick_with_keys

    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    picked = pick_with_keys(orders, orders.where("o_orderkey % 5 <> 0").select("o_orderkey"), ["o_orderkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 45)
    return missing_numbers(picked).select("n_selected", F.array_join("missing_answers", ",").alias("missing_answers"))


@query(
    """WITH n AS (SELECT DISTINCT exam_metadata_id, question_number AS x FROM questions WHERE question_number BETWEEN 1 AND 180),
       b AS (SELECT * FROM n UNION SELECT DISTINCT exam_metadata_id, 0 FROM questions UNION SELECT DISTINCT exam_metadata_id, 181 FROM questions),
       l AS (SELECT exam_metadata_id, x, lead(x) OVER (PARTITION BY exam_metadata_id ORDER BY x) AS y FROM b)
       SELECT exam_metadata_id, x + 1 AS gap_from, y - 1 AS gap_to FROM l WHERE y - x > 1"""
)
def number_gaps(spark, sf):
    return ranking.gaps(read_table(spark, sf, "questions"), ["exam_metadata_id"], "question_number", 1, 180)


# ---------------------------------------------------------------- sets


@query("SELECT lower(trim(subject)) AS subject FROM questions WHERE subject IS NOT NULL UNION SELECT lower(trim(subject)) FROM answer_keys WHERE subject IS NOT NULL")
def subject_domain(spark, sf):
    one = lambda t: read_table(spark, sf, t).where("subject IS NOT NULL").select(F.lower(F.trim("subject")).alias("subject"))
    return one("questions").union(one("answer_keys")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_with_both(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def customers_without_open_orders(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey").subtract(read_table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT e.year, e.caderno FROM exam_metadata e GROUP BY 1, 2")
def distinct_booklets(spark, sf):
    return read_table(spark, sf, "exam_metadata").select("year", "caderno").distinct()


# ---------------------------------------------------------------- sinks as state transitions

_SPLIT = "SELECT user_id, event_id, event_type, value, ts FROM events WHERE event_id % 2 = {}"


@query(
    f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({_SPLIT.format(0)})) WHERE r = 1),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({_SPLIT.format(1)} AND user_id % 3 <> 0)) WHERE r = 1)
        SELECT user_id, event_id, value, user_id NOT IN (SELECT user_id FROM o) AS is_new FROM n UNION ALL SELECT user_id, event_id, value, false FROM o WHERE user_id NOT IN (SELECT user_id FROM n)"""
)
def upserted_state(spark, sf):
    events = read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    latest = [F.desc("ts"), F.desc("event_id")]
    old = ranking.first_of(events.where("event_id % 2 = 0"), ["user_id"], latest)
    return ranking.upsert(old, events.where("event_id % 2 = 1 AND user_id % 3 <> 0"), ["user_id"], latest).select("user_id", "event_id", "value", "is_new")


@query(
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id % 2, event_id) AS r FROM (
         SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY value DESC NULLS LAST, event_id) AS p FROM events) WHERE p = 1)) WHERE r = 1"""
)
def best_kept(spark, sf):
    events = read_table(spark, sf, "events").select("user_id", "event_id", "value")
    best = lambda half: ranking.first_of(events.where(f"event_id % 2 = {half}"), ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")])
    return ranking.keep_best(best(0), best(1), ["user_id"], "value")


@query(
    """SELECT content_hash, id FROM (SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS r FROM (SELECT DISTINCT id, content_hash, created_at, question_number FROM questions) WHERE question_number > 90 AND content_hash IS NOT NULL
       AND content_hash NOT IN (SELECT content_hash FROM questions WHERE question_number <= 90 AND content_hash IS NOT NULL)) WHERE r = 1"""
)
def appended_once(spark, sf):
    q = records(spark, sf, "questions").where("content_hash IS NOT NULL").select("content_hash", "id", "created_at", "question_number")
    new = ranking.append_once(q.where("question_number <= 90"), q.where("question_number > 90"), "content_hash", [F.col("created_at"), F.col("id")])
    return new.select("content_hash", "id")


_NULLED = "SELECT nullif(user_id % 7, 0) AS k, event_id, value FROM events WHERE event_id % 4 = {}"


@query(
    f"""WITH o AS (SELECT k, max(event_id) AS event_id FROM ({_NULLED.format(0)}) GROUP BY 1), n AS (SELECT k, max(event_id) AS event_id FROM ({_NULLED.format(1)} AND user_id % 7 < 4) GROUP BY 1)
        SELECT n.k, n.event_id, EXISTS (SELECT 1 FROM o WHERE o.k IS NOT DISTINCT FROM n.k) = false AS is_new FROM n
        UNION ALL SELECT o.k, o.event_id, false FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k IS NOT DISTINCT FROM o.k)"""
)
def upserted_with_null_keys(spark, sf):
    """An upsert in which null is a key like others."""
    events = read_table(spark, sf, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("k"), "event_id", "user_id")
    latest = [F.desc("event_id")]
    old = ranking.first_of(events.where("event_id % 4 = 0"), ["k"], latest)
    return ranking.upsert(old, events.where("event_id % 4 = 1 AND user_id % 7 < 4"), ["k"], latest).select("k", "event_id", "is_new")


@query(
    f"""WITH o AS (SELECT DISTINCT k FROM ({_NULLED.format(0)}) WHERE k IS NULL OR k < 3) SELECT k, min(event_id) AS event_id FROM ({_NULLED.format(1)}) n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k IS NOT DISTINCT FROM n.k) GROUP BY 1"""
)
def appended_with_null_keys(spark, sf):
    events = read_table(spark, sf, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("k"), "event_id")
    old = events.where("event_id % 4 = 0 AND (k IS NULL OR k < 3)")
    return ranking.append_once(old, events.where("event_id % 4 = 1"), "k", [F.col("event_id")]).select("k", "event_id")


@query(
    """WITH o AS (SELECT user_id, max(value) AS old_score FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, max(value) AS new_score FROM events WHERE event_id % 2 = 1 GROUP BY 1)
       SELECT user_id, round(old_score, 6) AS old_score, round(new_score, 6) AS new_score, CASE WHEN new_score > coalesce(old_score, 0) AND new_score >= 100 THEN 'persist' ELSE 'dead_letter' END AS decision FROM n LEFT JOIN o USING (user_id)"""
)
def second_attempts(spark, sf):
    """Second attempts that are better than the first and good enough are kept, others go to the dead letters."""
    events = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    out = ranking.accept_better(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "value", 100.0)
    return out.withColumns({c: F.round(c, 6) for c in ("old_score", "new_score")})


@query(
    f"""SELECT q.id, 'pending' AS status, concat_ws(chr(10), question_text, coalesce(o, '')) AS raw_text FROM (SELECT DISTINCT id, question_text, exam_metadata_id, question_number FROM questions WHERE parsing_confidence < 0.55) q
        LEFT JOIN (SELECT question_id, string_agg(alternative_text, chr(10) ORDER BY alternative_order, alternative_letter, id) AS o FROM {_OWN_OPTIONS} GROUP BY 1) a ON a.question_id = q.id
        WHERE q.id NOT IN (SELECT id FROM dead_letter_questions)"""
)
def dead_letters_enqueued(spark, sf):
    """Questions of low confidence as rows of the dead-letter queue."""
    item = F.struct("alternative_order", "alternative_letter", "id", "alternative_text")
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["alternative_text"])
    options = own_options(spark, sf).groupBy(F.col("question_id").alias("id")).agg(texts.alias("options"))
    failed = records(spark, sf, "questions").where("parsing_confidence < 0.55").select("id", "question_text").join(options, "id", "left")
    failed = failed.withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    return ranking.enqueue(failed, "question_text", "options", ["id"], read_table(spark, sf, "dead_letter_questions")).select("id", "status", "raw_text")


@query(
    """SELECT DISTINCT id, CASE WHEN question_number IS NOT NULL AND status = 'pending' THEN 'resolved' ELSE status END AS status FROM dead_letter_questions"""
)
def resolved_letters(spark, sf):
    letters = records(spark, sf, "dead_letter_questions").select("id", "status", "question_number")
    return ranking.mark_done(letters, letters.where("question_number IS NOT NULL"), "id", "status", "pending", "resolved").select("id", "status")
