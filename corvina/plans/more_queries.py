"""Registered queries for queues, backfills, batches, catalog, reports, candidates and hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions import cleaning, parsing
from corvina.functions import text as T
from corvina.operators import embedding, ranking
from corvina.operators import records as recs
from corvina.plans.core_queries import ORACLE, QUERIES, query, records
from corvina.plans.text_queries import _RAW, _nested, _raw_texts, _sql_artefacts, _sql_sanitised, _sql_strip
from corvina.sources import links, sinks
from corvina.sources.tables import read_table

__all__ = ["ORACLE", "QUERIES"]


@query(
    """SELECT q.id, e.year FROM (SELECT DISTINCT * FROM questions) q LEFT JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id
       WHERE q.embedding_status = 'pending' AND trim(q.question_text) <> '' ORDER BY q.id LIMIT 500"""
)
def pending_queue(spark, sf):
    """The next 500 questions of a queue."""
    exams = records(spark, sf, "exam_metadata").select(F.col("id").alias("exam_metadata_id"), "year")
    waiting = records(spark, sf, "questions").where("embedding_status = 'pending' AND trim(question_text) <> ''").select("id", "exam_metadata_id").orderBy("id").limit(500)
    return waiting.join(exams, "exam_metadata_id", "left").select("id", "year")


@query(
    r"""SELECT id, coalesce(content_hash, left(sha256(concat_ws(':', 'q', regexp_replace(regexp_replace(regexp_replace(lower(question_text), '^\s+|\s+$', '', 'g'), 'quest[ãa]o\s*\d+', '', 'g'), '\s+', ' ', 'g'))), 16)) AS content_hash,
        content_hash IS NULL AS filled FROM (SELECT DISTINCT id, question_text, content_hash FROM questions)"""
)
def hashes_backfilled(spark, sf):
    q = records(spark, sf, "questions")
    return q.select("id", F.coalesce("content_hash", T.content_hash("question_text", F.lit("q"))).alias("content_hash"), F.col("content_hash").isNull().alias("filled"))


@query(
    """SELECT o_custkey, batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_custkey, o_orderkey, ceil(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / 3.0)::BIGINT AS batch FROM orders) WHERE batch IN (1, 3) GROUP BY 1, 2"""
)
def selected_batches(spark, sf):
    """Rows of each customer in batches of three, of which the first and third are taken."""
    numbered = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ceil(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) / 3).cast("long").alias("batch"))
    return numbered.where(F.col("batch").isin(1, 3)).groupBy("o_custkey", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    """SELECT split_part(kind, ' ', 1) AS kind, count(*) AS n FROM (SELECT unnest(json_extract_string(extraction_errors, '$[*]')) AS kind FROM (SELECT DISTINCT id, extraction_errors FROM dead_letter_questions) WHERE extraction_errors IS NOT NULL) GROUP BY 1"""
)
def error_kinds(spark, sf):
    errors = F.explode(F.from_json("extraction_errors", "array<string>"))
    return records(spark, sf, "dead_letter_questions").select(errors.alias("e")).groupBy(F.substring_index("e", " ", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT e.year, e.day, count(*) FILTER (WHERE q.parsing_confidence >= 0.85) AS accepted, count(*) FILTER (WHERE q.parsing_confidence < 0.85) AS others, 0 AS dead FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id GROUP BY 1, 2
       UNION ALL SELECT e.year, e.day, 0, 0, count(*) FROM (SELECT DISTINCT id, pdf_filename FROM dead_letter_questions) d JOIN (SELECT DISTINCT * FROM exam_metadata) e USING (pdf_filename) GROUP BY 1, 2"""
)
def report_by_year_and_day(spark, sf):
    """Accepted and other questions, and dead letters, by year and day."""
    e = records(spark, sf, "exam_metadata")
    per_exam = records(spark, sf, "questions").groupBy(F.col("exam_metadata_id").alias("id")).agg(
        F.count_if(F.col("parsing_confidence") >= 0.85).alias("accepted"), F.count_if(F.col("parsing_confidence") < 0.85).alias("others")
    )
    live = per_exam.join(e.select("id", "year", "day"), "id").groupBy("year", "day").agg(F.sum("accepted").alias("accepted"), F.sum("others").alias("others")).withColumn("dead", F.lit(0).cast("long"))
    per_file = records(spark, sf, "dead_letter_questions").groupBy("pdf_filename").agg(F.count(F.lit(1)).alias("n"))
    dead = per_file.join(e.select("pdf_filename", "year", "day"), "pdf_filename").groupBy("year", "day").agg(F.sum("n").alias("dead"))
    zero = F.lit(0).cast("long")
    return live.unionByName(dead.select("year", "day", zero.alias("accepted"), zero.alias("others"), "dead"))


@query(
    """SELECT exam_metadata_id, question_number, id FROM (SELECT *, row_number() OVER (PARTITION BY exam_metadata_id, question_number ORDER BY parsing_confidence DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT * FROM questions)) WHERE r = 1"""
)
def best_candidates(spark, sf):
    """Of several candidates for a number of an exam the one with the highest confidence."""
    order = [F.col("parsing_confidence").desc_nulls_last(), F.col("id")]
    return ranking.first_of(records(spark, sf, "questions"), ["exam_metadata_id", "question_number"], order).select("exam_metadata_id", "question_number", "id")


@query(
    """SELECT c.id AS booklet_id, g.id AS key_file_id FROM (SELECT DISTINCT id, replace(pdf_filename, '_PV_', '_GB_') AS k FROM exam_metadata) c JOIN (SELECT DISTINCT id, pdf_filename FROM exam_metadata) g ON g.pdf_filename = c.k"""
)
def derived_key_join(spark, sf):
    """Files joined with those of the name derived from theirs."""
    e = records(spark, sf, "exam_metadata")
    left = e.select(F.col("id").alias("booklet_id"), F.replace("pdf_filename", F.lit("_PV_"), F.lit("_GB_")).alias("pdf_filename"))
    return left.join(e.select(F.col("id").alias("key_file_id"), "pdf_filename"), "pdf_filename").select("booklet_id", "key_file_id")


#: The tables of a data folder.
TABLES = (
    "exam_metadata", "questions", "question_alternatives", "answer_keys", "question_chunks", "dead_letter_questions", "deletion_log", "documents", "mix_targets",
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
)


@query(
    f"""SELECT table_name, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'VARCHAR[]' THEN 'array<string>'
        ELSE lower(data_type) END AS type FROM (SELECT table_name, column_name, data_type FROM information_schema.columns WHERE table_name IN {TABLES})"""
)
def catalog_columns(spark, sf):
    """Tables, columns and types as the sources have them."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in TABLES for f in read_table(spark, sf, t).schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


@query(
    """SELECT year, day, booklet, kind, year || '_' || kind || '_impresso_D' || day || '_CD' || booklet || '.pdf' AS file_name
       FROM (SELECT unnest([2020, 2021, 2022]) AS year), (SELECT unnest([1, 2]) AS day), (SELECT unnest([1, 2, 3, 4]) AS booklet), (SELECT unnest(['PV', 'GB']) AS kind)"""
)
def expected_files(spark, sf):
    return links.expected_files(spark, (2020, 2021, 2022))


@query("SELECT c_custkey, c_name, json_object('c_custkey', c_custkey, 'c_name', c_name)::VARCHAR AS row FROM customer")
def rows_as_json(spark, sf):
    return sinks.as_json(read_table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name")


@query(
    """SELECT id, i, (('0x' || left(md5(i || ':' || coalesce(question_text, '')), 8))::BIGINT % 2001) / 1000.0::DOUBLE - 1.0 AS x FROM (SELECT id, question_text, unnest(range(16)) AS i FROM (SELECT DISTINCT id, question_text FROM questions))"""
)
def hashed_vectors(spark, sf):
    return records(spark, sf, "questions").select("id", F.posexplode(embedding.hashed_vector("question_text", 16)).alias("i", "x"))


@query(
    """SELECT c.id, CASE WHEN v.content_hash IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT id, content_hash FROM question_chunks) c
       LEFT JOIN (SELECT DISTINCT content_hash FROM question_chunks WHERE chunk_type = 'full' AND len(embedding) = 64) v USING (content_hash)"""
)
def stored_vectors(spark, sf):
    """Chunks whose vector is among the stored ones, here the whole vectors of full chunks."""
    chunks = read_table(spark, sf, "question_chunks").select("id", "content_hash", "chunk_type", "embedding").dropDuplicates(["id"])
    return embedding.stored(chunks, chunks.where((F.col("chunk_type") == "full") & (F.size("embedding") == 64)))


@query(
    """SELECT chunk_type, id, tokens_used FROM (SELECT chunk_type, id, greatest(1, floor(token_count / count(*) OVER (PARTITION BY question_id)))::BIGINT AS tokens_used FROM (SELECT DISTINCT id, question_id, chunk_type, token_count FROM question_chunks) WHERE question_id IS NOT NULL AND token_count IS NOT NULL)"""
)
def shared_tokens(spark, sf):
    chunks = read_table(spark, sf, "question_chunks").select("id", "question_id", "chunk_type", "token_count").dropDuplicates(["id"])
    used = embedding.share_tokens(chunks.where("question_id IS NOT NULL AND token_count IS NOT NULL"), "token_count", "question_id")
    return used.select("chunk_type", "id", F.col("tokens_used").cast("long").alias("tokens_used"))


# ---------------------------------------------------------------- clean-up chains and estimates


def _sql_cut(x: str, steps: list[tuple[str, str]]) -> str:
    """``cleaning.cut`` in SQL; patterns with a reference back are spelt out for each character."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    repeated = lambda n: "(?:" + "|".join(f"{c}{{{n},}}" for c in signs) + ")$"
    spelt = [(repeated(6) if "{5,}$" in p and "\\1" in p else repeated(4) if "\\1" in p else p, new) for p, new in steps]
    return _sql_strip(_nested(x, spelt, False))


_CLEAN = _sql_cut(_sql_sanitised(_sql_artefacts(_nested("coalesce(raw_text, '')", T.GARBLED + T.SIGNS, True))), cleaning.QUESTION_CUTS)


@query(
    f"""SELECT table_name, id, {_CLEAN} AS text, coalesce(try_cast(nullif(regexp_extract(raw_text, '(?i)quest[ãa]o\\s*(\\d+)', 1), '') AS INT), CASE WHEN regexp_matches(lower(raw_text), '[∫√∑∞≤≥≠±]|função|equação') THEN 95
        WHEN regexp_matches(lower(raw_text), 'texto|literatura|poema|linguagem|autor') THEN 15 ELSE 50 END) AS number FROM ({_RAW})"""
)
def cleaned_questions(spark, sf):
    return _raw_texts(spark, sf).select("table_name", "id", cleaning.clean_question("raw_text").alias("text"), cleaning.estimated_number("raw_text").alias("number"))


@query(f"SELECT id, {_sql_cut('alternative_text', cleaning.OPTION_CUTS)} AS text FROM (SELECT DISTINCT id, alternative_text FROM question_alternatives)")
def cleaned_options(spark, sf):
    return records(spark, sf, "question_alternatives").select("id", cleaning.clean_option("alternative_text").alias("text"))


_SEPARATED = _sql_cut("coalesce(raw_text, '')", [*[(p, " ") for p in cleaning.SEPARATORS], (r"\s+", " ")])


@query(f"SELECT table_name, id, {_SEPARATED} AS text FROM ({_RAW})")
def without_separators(spark, sf):
    return _raw_texts(spark, sf).select("table_name", "id", cleaning.drop_separators(F.coalesce("raw_text", F.lit(""))).alias("text"))


# ---------------------------------------------------------------- files, pages, images


@query(
    """SELECT id, CASE WHEN contains(pdf_filename, '_GB_') THEN 'key' WHEN contains(pdf_filename, '_PV_') THEN 'booklet' END AS kind FROM (SELECT DISTINCT id, pdf_filename FROM exam_metadata)"""
)
def file_kinds(spark, sf):
    return records(spark, sf, "exam_metadata").select("id", parsing.file_kind("pdf_filename").alias("kind"))


@query("SELECT pdf_filename, count(*) AS n_pages, count(*) FILTER (WHERE length(coalesce(text, '')) < 50) > 0 AS scanned FROM documents WHERE pdf_filename IS NOT NULL GROUP BY 1")
def scanned_files(spark, sf):
    """Files of which a page has hardly any text. Pages are counted, not gathered, as one file may have very many."""
    return parsing.scanned_files(read_table(spark, sf, "documents").where("pdf_filename IS NOT NULL"), "pdf_filename", "text")


@query(
    """SELECT pdf_filename, id AS question_id, question_number FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY question_number, id) AS r FROM (SELECT DISTINCT q.id, q.question_number, e.pdf_filename FROM questions q JOIN exam_metadata e ON e.id = q.exam_metadata_id)) WHERE r = 1"""
)
def first_questions(spark, sf):
    """The question of a file that gets the file's images: its first one."""
    files = records(spark, sf, "exam_metadata").select(F.col("id").alias("exam_metadata_id"), "pdf_filename")
    q = records(spark, sf, "questions").select("id", "question_number", "exam_metadata_id").join(files, "exam_metadata_id")
    best = F.min_by(F.struct("id", "question_number"), F.struct(F.col("question_number").isNull(), "question_number", "id"))
    return q.groupBy("pdf_filename").agg(best.alias("x")).select("pdf_filename", F.col("x.id").alias("question_id"), "x.question_number")


@query("SELECT p_brand AS page, p_partkey AS image, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) NULLS LAST, p_partkey) AS sequence FROM part")
def image_order(spark, sf):
    """Images of each page from top to bottom, those without a place last, numbered from 1."""
    images = read_table(spark, sf, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("image"), F.nullif("p_size", F.lit(7)).alias("y"))
    return ranking.numbered(images, ["page"], [F.col("y").asc_nulls_last(), F.col("image")], "sequence").select("page", "image", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT pages, count(*) AS n, array_to_string(list(question_number ORDER BY question_number), ',') AS numbers FROM (SELECT DISTINCT question_number, CASE WHEN p > 0 THEN greatest(1, g - 1) || '-' || least(p, g + 1) ELSE '1-5' END AS pages FROM (SELECT question_number, 32 AS p, greatest(1, least(32, question_number // 2)) AS g FROM questions WHERE question_number IS NOT NULL)) GROUP BY 1")
def numbers_by_pages(spark, sf):
    """Question numbers that share an estimated range of pages of a booklet of 32 pages, so that each range is read once."""
    numbers = read_table(spark, sf, "questions").where("question_number IS NOT NULL").select("question_number").distinct()
    grouped = numbers.groupBy(cleaning.page_range("question_number", F.lit(32)).alias("pages")).agg(F.array_sort(F.collect_list("question_number")).alias("x"))
    return grouped.select("pages", F.size("x").cast("long").alias("n"), F.array_join("x", ",").alias("numbers"))


# ---------------------------------------------------------------- web pages (rows of our own, as no table holds any)

_PAGES = [
    ("https://a.org/exams/index.html", "<a href=\"2022_PV_prova_azul.pdf\">x</a><a class='k' href='/files/gabarito_2023.pdf'>y</a><a href='notes.txt'>n</a>"),
    ("https://b.org/p", "<a href='https://a.org/files/gabarito_2023.pdf'>z</a> <A HREF=\"//c.org/enem_2019_rosa.PDF\">w</A>"),
    ("https://c.org/empty", None),
]
_FOUND = {
    ("https://a.org/exams/2022_PV_prova_azul.pdf", 2022, "booklet", "azul"),
    ("https://a.org/files/gabarito_2023.pdf", 2023, "key", None),
    ("https://c.org/enem_2019_rosa.PDF", None, "booklet", "rosa"),
}


@query(
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in sorted(_FOUND, key=str))
    + ") t(link, year, kind, colour)"
)
def web_links(spark, sf):
    """The set of links that several pages name, with the category of each."""
    found = links.page_links(spark.createDataFrame(_PAGES, "url string, html string"), "url", "html").select("link").distinct()
    return found.select("link", F.inline(F.array(links.link_category("link"))))


# ---------------------------------------------------------------- phases of an extraction


@query(
    """WITH h AS (SELECT id AS chunk_id, unnest(regexp_extract_all(coalesce(raw_text, ''), '(?i)quest[ãa]o\\s*(\\d+)', 1))::INT AS number, 0.9::DOUBLE AS confidence FROM (SELECT DISTINCT id, raw_text FROM dead_letter_questions)
         UNION ALL SELECT id, unnest(regexp_extract_all(regexp_replace(coalesce(raw_text, ''), '[^\\pL\\pN_]', '  ', 'g'), '(?:^| )(\\d{1,3})(?: |$)', 1))::INT, 0.3 FROM (SELECT DISTINCT id, raw_text FROM dead_letter_questions)),
       o AS (SELECT DISTINCT id FROM dead_letter_questions WHERE len(regexp_extract_all(coalesce(raw_text, ''), '\\b[A-E]\\s*\\)')) >= 3),
       a AS (SELECT chunk_id, confidence FROM h WHERE number BETWEEN 10 AND 60 UNION ALL SELECT id, 0.6 FROM o)
       SELECT chunk_id AS id, count(*) AS n_hints, max(confidence) AS best_confidence FROM a GROUP BY 1"""
)
def searched_chunks(spark, sf):
    """Raw texts in which the questions 10 to 60 may stand, by the hints in them."""
    letters = records(spark, sf, "dead_letter_questions").select(F.col("id").alias("chunk_id"), "raw_text")
    hints = letters.select("chunk_id", F.inline(parsing.question_hints("raw_text")))
    gap = spark.createDataFrame([(10, 40), (30, 60)], "gap_from int, gap_to int")
    return recs.chunks_to_search(letters, hints, gap).select(F.col("chunk_id").alias("id"), "n_hints", "best_confidence")


@query(
    """SELECT count(*) AS n_candidates, count(*) FILTER (WHERE c > 0.7) AS n_sure, round(avg(c), 6) AS mean_confidence FROM (SELECT (event_id % 10) / 10.0::DOUBLE AS c, event_id % 3 + 4 AS n FROM events) WHERE n = 5"""
)
def parsed_candidates(spark, sf):
    """Answers of a model as JSON with text around it; only questions with exactly five options count."""
    n = (F.col("event_id") % 3 + 4).cast("int")
    options = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("o"), i.cast("string")))
    question = F.struct(F.col("event_id").cast("int").alias("estimated_number"), F.lit("q").alias("question_text"), options.alias("alternatives"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array(question).alias("missing_questions"))), F.lit(" as asked."))
    responses = read_table(spark, sf, "events").select(F.col("event_type").alias("at"), answer.alias("response"))
    return recs.candidate_summary(recs.parse_candidates(responses, "response", "at")).withColumn("mean_confidence", F.round("mean_confidence", 6))


_PHASES = """WITH e AS (SELECT o_orderkey AS number FROM orders WHERE o_orderkey % 3 <> 0),
  v AS (SELECT o_orderkey AS number, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, o_orderkey % 11 = 0 AS bad FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS number, o_orderkey % 4 = 0 AS ok FROM orders WHERE o_orderkey % 8 < 5),
  f AS (SELECT e.number, CASE WHEN r.ok THEN 'repaired' WHEN v.confidence IS NOT NULL THEN 'validated' ELSE 'extracted' END AS phase,
    CASE WHEN r.ok THEN greatest(coalesce(v.confidence, 0.5), least(0.9, coalesce(v.confidence, 0.5) + 0.3)) ELSE coalesce(v.confidence, 0.5) END AS confidence, coalesce(v.bad, false) AS validation_error, coalesce(NOT r.ok, false) AS repair_failed
    FROM e LEFT JOIN v USING (number) LEFT JOIN r USING (number)
    UNION ALL SELECT o_orderkey, 'detected', (o_orderkey % 10) / 10.0, false, false FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 10) / 10.0 > 0.4)"""


def _phases(spark, sf):
    n, text = F.col("o_orderkey"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    extracted = orders.where(n % 3 != 0).select(n.alias("number"), text.alias("text"))
    verdicts = orders.where(n % 2 == 0).select(n.alias("number"), ((n % 10) / 10.0).alias("confidence"), F.when(n % 11 == 0, "timeout").alias("error"))
    repairs = orders.where(n % 8 < 5).select(n.alias("number"), F.when(n % 4 == 0, text).alias("text"))
    detected = orders.select(n.alias("number"), text.alias("text"), ((n % 10) / 10.0).alias("confidence"))
    return recs.combine_phases(extracted, verdicts, repairs, detected)


@query(_PHASES + " SELECT number, phase, round(confidence, 6) AS confidence, validation_error, repair_failed FROM f")
def combined_phases(spark, sf):
    """Extracted, validated, repaired and newly detected questions put together; the verdicts of models are input."""
    return _phases(spark, sf).select("number", "phase", F.round("confidence", 6).alias("confidence"), "validation_error", "repair_failed")


@query(
    _PHASES + """ SELECT number, 'Validation error' AS issue FROM f WHERE validation_error UNION ALL SELECT number, 'Repair failed' FROM f WHERE repair_failed UNION ALL SELECT number, 'Low confidence score' FROM f WHERE confidence < 0.5"""
)
def phase_issues(spark, sf):
    return recs.issue_lines(_phases(spark, sf))


@query(
    """SELECT q.id, CASE WHEN e.day = 1 AND question_number BETWEEN 46 AND 90 THEN 'ciencias_humanas' WHEN e.day = 2 AND question_number BETWEEN 91 AND 135 THEN 'ciencias_natureza'
         WHEN e.day = 2 AND question_number BETWEEN 136 AND 180 THEN 'matematica' ELSE 'linguagens' END AS area,
       CASE WHEN e.pages_count > 0 THEN greatest(1, greatest(1, least(e.pages_count, question_number // 2)) - 1) || '-' || least(e.pages_count, greatest(1, least(e.pages_count, question_number // 2)) + 1) ELSE '1-5' END AS pages
       FROM (SELECT DISTINCT id, question_number, exam_metadata_id FROM questions) q JOIN (SELECT DISTINCT * FROM exam_metadata) e ON e.id = q.exam_metadata_id"""
)
def areas_and_pages(spark, sf):
    exams = records(spark, sf, "exam_metadata").select(F.col("id").alias("exam_metadata_id"), "day", "pages_count")
    q = records(spark, sf, "questions").select("id", "question_number", "exam_metadata_id").join(exams, "exam_metadata_id")
    return q.select("id", cleaning.area_of("question_number", "day").alias("area"), cleaning.page_range("question_number", "pages_count").alias("pages"))


@query("SELECT id, 'Questão ' || question_number || ' (' || coalesce(subject, '') || '): ' || question_text AS prompt FROM (SELECT DISTINCT id, question_number, subject, question_text FROM questions)")
def prompts(spark, sf):
    return records(spark, sf, "questions").select("id", cleaning.prompt("Questão %s (%s): %s", "question_number", "subject", "question_text").alias("prompt"))
