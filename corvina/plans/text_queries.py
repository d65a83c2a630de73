"""Registered queries for text, parsing, scoring, search, mining and stream operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import parsing, scoring
from corvina.functions import text as T
from corvina.functions.tokens import first_tokens
from corvina.operators import mining, search
from corvina.operators import records as recs
from corvina.plans.core_queries import _OWN_OPTIONS, ORACLE, QUERIES, own_options, query, records
from corvina.sources.tables import read_table
from corvina.streaming import ingest

__all__ = ["ORACLE", "QUERIES"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nested(column: str, steps: list[tuple[str, str]], plain: bool) -> str:
    for old, new in steps:
        column = f"replace({column}, {_q(old)}, {_q(new)})" if plain else f"regexp_replace({column}, {_q(_re2(old))}, {_q(new)}, {_q(_flags(old))})"
    return column


def _re2(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("(?isu)", "(?is)")


def _flags(pattern: str) -> str:
    return "g"


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(_re2(pattern))}))"


def _sql_sanitised(x: str) -> str:
    steps = [(T.CONTROL, ""), (T.REPLACEMENT, " "), *[(p, "") for p in T.TYPESETTER], (T.CID, " "), *[(p, "") for p in [*T.HEADERS, *T.AREAS, T.AREA_TAIL, *T.MARKDOWN]], (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]
    return _sql_strip(_nested(x, steps, False))


def _sql_garbled(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE ({_sql_count(x, T.REPLACEMENT)} + {_sql_count(x, T.CONTROL)}) / length({x})::DOUBLE END"


def _sql_contaminated(x: str) -> str:
    loose = "(?i)" + "|".join(f"(?:{p[5:]})" for p in T.HEADERS + T.AREAS if p.startswith("(?iu)"))
    exact = "|".join(f"(?:{p})" for p in [T.CID, *T.TYPESETTER, *(h for h in T.HEADERS if not h.startswith("(?iu)"))])
    return f"({_sql_garbled(x)} > 0.10 OR regexp_matches({x}, {_q(exact)}) OR regexp_matches({x}, {_q(loose)}))"


def _sql_artefacts(x: str) -> str:
    return _sql_strip(_nested(x, T.ARTEFACTS, False))


def _sql_issues(x: str) -> str:
    return f"(regexp_matches({x}, '\\?{{2,}}')::INT + contains({x}, 'Ã')::INT + contains({x}, 'â€')::INT + contains({x}, 'Â')::INT)"


# ---------------------------------------------------------------- text


@query(f"SELECT id, {_nested('question_text', T.GARBLED + T.SIGNS, True)} AS text FROM (SELECT DISTINCT id, question_text FROM questions)")
def encoding_normalised(spark, sf):
    return records(spark, sf, "questions").select("id", T.normalise_encoding("question_text").alias("text"))


@query(
    r"""SELECT id, CASE WHEN length(t) = 0 THEN 0.0 ELSE (len(regexp_extract_all(t, '�+')) + len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) + len(regexp_extract_all(t, '[\x{80}-\x{9f}]'))) / length(t)::DOUBLE END AS ratio
        FROM (SELECT DISTINCT id, coalesce(question_text, '') AS t FROM questions)"""
)
def garble_ratio(spark, sf):
    return records(spark, sf, "questions").select("id", T.garble_ratio("question_text").alias("ratio"))


_MARKS = {"question_marks": r"\?{2,}", "A_tilde": "Ã", "quotes": "â€", "A_circumflex": "Â"}


@query(
    "SELECT id, concat_ws(';', "
    + ", ".join(f"CASE WHEN {_sql_count('t', p)} > 0 THEN '{n}=' || {_sql_count('t', p)} END" for n, p in _MARKS.items())
    + ") AS issues FROM (SELECT DISTINCT id, coalesce(question_text, '') AS t FROM questions)"
)
def encoding_marks(spark, sf):
    return records(spark, sf, "questions").select("id", F.array_join(T.encoding_issues("question_text"), ";").alias("issues"))


_NORMAL = f"""SELECT id, raw, first, {_sql_artefacts('first')} AS second FROM (SELECT id, question_text AS raw, {_nested('question_text', T.GARBLED + T.SIGNS, True)} AS first FROM (SELECT DISTINCT id, question_text FROM questions))"""


@query(
    f"""SELECT id, second AS text, concat_ws(',', CASE WHEN first <> raw THEN 'encoding' END, CASE WHEN second <> first THEN 'artefacts' END) AS steps,
        {_sql_issues("coalesce(raw, '')")} AS issues_before, {_sql_issues("coalesce(second, '')")} AS issues_after,
        CASE WHEN {_sql_issues("coalesce(raw, '')")} = 0 THEN 1.0 ELSE greatest(0.0, ({_sql_issues("coalesce(raw, '')")} - {_sql_issues("coalesce(second, '')")}) / {_sql_issues("coalesce(raw, '')")}::DOUBLE) END AS improvement
        FROM ({_NORMAL})"""
)
def normalised_in_full(spark, sf):
    n = records(spark, sf, "questions").select("id", T.normalise_full("question_text").alias("n")).select("id", "n.*")
    return n.withColumn("steps", F.array_join("steps", ","))


_RAW = "SELECT DISTINCT 'questions' AS table_name, id, raw_text FROM questions UNION ALL SELECT DISTINCT 'dead_letter_questions', id, raw_text FROM dead_letter_questions"


def _raw_texts(spark, sf):
    """The raw texts of questions and dead letters."""
    one = lambda t: records(spark, sf, t).select(F.lit(t).alias("table_name"), "id", "raw_text")
    return one("questions").unionByName(one("dead_letter_questions"))


@query(f"SELECT table_name, id, {_sql_sanitised('nfc_normalize(raw_text)')} AS text, {_sql_contaminated('x')} AS contaminated FROM (SELECT *, coalesce(raw_text, '') AS x FROM ({_RAW}))")
def sanitised_texts(spark, sf):
    """Sanitised texts after canonical composition."""
    return _raw_texts(spark, sf).select("table_name", "id", T.sanitise(T.nfc("raw_text")).alias("text"), T.is_contaminated("raw_text").alias("contaminated"))


_OPTION_TAIL = [(r"\s+\d{1,3}\s*$", ""), (r"\s+-\s*$", "")]


@query(f"SELECT id, {_sql_strip(_nested(_sql_sanitised('alternative_text'), _OPTION_TAIL, False))} AS text FROM (SELECT DISTINCT id, alternative_text FROM question_alternatives)")
def sanitised_options(spark, sf):
    return records(spark, sf, "question_alternatives").select("id", T.sanitise_option("alternative_text").alias("text"))


@query(
    f"""SELECT extraction_method, grade, count(*) FILTER (WHERE c) AS n_contaminated, count(*) AS n FROM (
        SELECT extraction_method, {_sql_contaminated('t')} AS c, CASE WHEN m > 50 THEN 'poor' WHEN m > 10 THEN 'fair' ELSE 'good' END AS grade FROM (
        SELECT extraction_method, t, {" + ".join(_sql_count('t', p) for p in (T.REPLACEMENT, T.CID, "[|¦]{2,}", r"[\x{10000}-\x{10ffff}]"))} AS m
        FROM (SELECT DISTINCT id, extraction_method, coalesce(question_text, '') AS t FROM questions))) GROUP BY 1, 2"""
)
def contaminated_by_method(spark, sf):
    flags = records(spark, sf, "questions").select("extraction_method", T.is_contaminated("question_text").alias("c"), T.garble_grade("question_text").alias("grade"))
    return flags.groupBy("extraction_method", "grade").agg(F.count_if("c").alias("n_contaminated"), F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT id, count(*) AS n_words FROM (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(question_text), '[^\pL\pN\pM_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS w
        FROM (SELECT DISTINCT id, question_text FROM questions)) WHERE w <> '' GROUP BY 1"""
)
def plain_word_counts(spark, sf):
    words = records(spark, sf, "questions").select("id", F.explode(F.split(T.plain_words("question_text"), " ")).alias("w"))
    return words.where("w != ''").groupBy("id").agg(F.count(F.lit(1)).alias("n_words"))


@query(
    f"""SELECT doc_id, bad / greatest(1, length(t))::DOUBLE AS ratio, bad > 0.05 * length(t) AS garbled FROM (SELECT doc_id, t, length(t) - length(regexp_replace(t, {_q(T.BAD_CHARACTER)}, '', 'g')) AS bad
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
)
def garbled_documents(spark, sf):
    """Whole documents of which more than a twentieth of the characters is bad."""
    return read_table(spark, sf, "documents").select("doc_id", F.inline(F.array(T.garbled_whole("text"))))


@query(
    r"""SELECT id, length(t) < 100 OR len(w) < 10 OR len(list_distinct(w))::DOUBLE / len(w) < 0.3 AS repetitive FROM (
        SELECT id, t, regexp_split_to_array(lower(t), '\s+') AS w FROM (SELECT DISTINCT id, regexp_replace(coalesce(question_text, ''), '^\s+|\s+$', '', 'g') AS t FROM questions))"""
)
def repetitive_texts(spark, sf):
    return records(spark, sf, "questions").select("id", T.is_repetitive("question_text").alias("repetitive"))


@query(
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]+'), lambda x: x <> '')) AS n_tokens FROM documents"""
)
def token_counts(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"))


@query(
    r"""SELECT id, left(sha256(concat_ws(':', '2020', regexp_replace(regexp_replace(regexp_replace(lower(coalesce(question_text, '')), '^\s+|\s+$', '', 'g'), 'quest[ãa]o\s*\d+', '', 'g'), '\s+', ' ', 'g'))), 16) AS hash
        FROM (SELECT DISTINCT id, question_text FROM questions)"""
)
def content_hashes(spark, sf):
    return records(spark, sf, "questions").select("id", T.content_hash("question_text", F.lit(2020)).alias("hash"))


@query(
    "SELECT doc_id, start, substring(text, start + 1, 2000) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS start FROM documents)"
)
def text_windows(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.inline(T.text_windows("text", 2000)))


@query(
    """SELECT q.id, 'full' AS chunk_type, sha256('[ENUNCIADO] ' || q.question_text || coalesce(chr(10) || a.lines, '')) AS content_hash FROM (SELECT DISTINCT id, question_text FROM questions) q
       LEFT JOIN (SELECT question_id, string_agg(alternative_letter || ') ' || alternative_text, chr(10) ORDER BY alternative_order, alternative_letter, id) AS lines FROM (SELECT DISTINCT * FROM question_alternatives WHERE question_id IN (SELECT id FROM questions)) GROUP BY 1) a ON a.question_id = q.id
       UNION ALL SELECT id, 'context', sha256(context_text) FROM (SELECT DISTINCT id, context_text FROM questions) WHERE trim(context_text) <> ''"""
)
def built_chunks(spark, sf):
    """Chunks of statement and options, and of the context where there is one, with their hashes."""
    return recs.build_chunks(_chunk_parts(spark, sf), "id", "question_text", "options", "context_text").select("id", "chunk_type", "content_hash")


def _chunk_parts(spark, sf):
    options = _ordered_options(spark, sf, F.struct(F.col("alternative_letter").alias("letter"), F.col("alternative_text").alias("text")), "question_id")
    q = records(spark, sf, "questions").select("id", "question_text", "context_text")
    return q.join(options.withColumnRenamed("question_id", "id"), "id", "left")


@query()
def shortened_chunks(spark, sf):
    """Chunks cut after 8,000 tokens of a public tokenizer; the hash is that of the whole content."""
    return recs.build_chunks(_chunk_parts(spark, sf), "id", "question_text", "options", "context_text", lambda c: first_tokens(c, 8000)).drop("content")


def _ordered_options(spark, sf, value, key: str):
    """Options of each question in order, as an array of ``value``."""
    item = F.struct("alternative_order", "alternative_letter", "id", value.alias("_v"))
    return own_options(spark, sf).groupBy(F.col("question_id").alias(key)).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]).alias("options"))


@query(r"SELECT id, len(regexp_extract_all(coalesce(raw_text, ''), '(?i)quest[ãa]o\s*(\d+)')) AS n_headings FROM (SELECT DISTINCT id, raw_text FROM questions)")
def heading_counts(spark, sf):
    hints = parsing.question_hints("raw_text")
    return records(spark, sf, "questions").select("id", F.size(F.filter(hints, lambda h: h["method"] == "heading")).alias("n_headings"))


@query(
    rf"""SELECT table_name, id, 'heading' AS method, unnest(regexp_extract_all(x, '(?i)quest[ãa]o\s*(\d+)', 1))::INT AS number, 0.9::DOUBLE AS confidence FROM (SELECT *, coalesce(raw_text, '') AS x FROM ({_RAW}))
        UNION ALL SELECT table_name, id, 'options', NULL, 0.6 FROM ({_RAW}) WHERE len(regexp_extract_all(coalesce(raw_text, ''), '\b[A-E]\s*\)')) >= 3
        UNION ALL SELECT * FROM (SELECT table_name, id, 'number', unnest(regexp_extract_all(regexp_replace(coalesce(raw_text, ''), '[^\pL\pN_]', '  ', 'g'), '(?:^| )(\d{{1,3}})(?: |$)', 1))::INT AS number, 0.3 FROM ({_RAW})) WHERE number BETWEEN 1 AND 180"""
)
def question_hints(spark, sf):
    return _raw_texts(spark, sf).select("table_name", "id", F.inline(parsing.question_hints("raw_text")))


@query(r"SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_fields(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    """SELECT id, len(json_extract_string(extraction_errors, '$[*]')) AS n_errors FROM (SELECT DISTINCT id, extraction_errors FROM dead_letter_questions) WHERE extraction_errors IS NOT NULL"""
)
def error_lists(spark, sf):
    errors = F.from_json(T.salvage_json("extraction_errors"), "array<string>")
    return records(spark, sf, "dead_letter_questions").where("extraction_errors IS NOT NULL").select("id", F.size(errors).alias("n_errors"))


# ---------------------------------------------------------------- parsing


@query(
    r"""WITH s AS (SELECT id, regexp_replace(string_split(pdf_filename, '/')[-1], '\.[^.]*$', '') AS stem FROM (SELECT DISTINCT id, pdf_filename FROM exam_metadata)),
        p AS (SELECT *, string_split(stem, '_') AS p FROM s),
        d AS (SELECT *, len(p) >= 4 AND regexp_matches(p[1], '^\d+$') AS ok, list_filter(p, lambda x: regexp_matches(x, '^D\d$'))[-1] AS dd, list_filter(p, lambda x: regexp_matches(x, '^CD\d+$'))[-1] AS cd FROM p),
        n AS (SELECT *, coalesce(try_cast(substring(cd, 3, 9) AS INT), 1) AS num FROM d)
        SELECT id, CASE WHEN ok THEN p[1]::INT END AS year, CASE WHEN ok THEN p[2] END AS kind, CASE WHEN ok THEN coalesce(substring(dd, 2, 1)::INT, 1) END AS day, CASE WHEN ok THEN coalesce(cd, 'CD1') END AS booklet,
          CASE WHEN NOT ok THEN NULL WHEN list_contains(p, 'reaplicacao') THEN 'reaplicacao_PPL' ELSE 'regular' END AS application_type,
          CASE WHEN NOT ok THEN NULL WHEN contains(stem, 'braile_e_ledor') OR num IN (9, 11) THEN 'braille_ledor' WHEN num IN (10, 12) THEN 'libras' WHEN list_contains(p, 'PPL') AND NOT list_contains(p, 'reaplicacao') THEN 'PPL' END AS accessibility,
          CASE WHEN NOT ok THEN NULL WHEN contains(lower(stem), 'espanhol') THEN 'spanish' WHEN contains(lower(stem), 'ingles') THEN 'english' ELSE 'portuguese' END AS language,
          CASE WHEN NOT ok THEN NULL WHEN list_contains(p, 'PPL') THEN 'PPL' WHEN list_contains(p, 'digital') THEN 'ENEM_DIGITAL' ELSE 'ENEM' END AS exam_type FROM n"""
)
def file_metadata(spark, sf):
    return records(spark, sf, "exam_metadata").select("id", parsing.filename_metadata("pdf_filename").alias("m")).select("id", "m.*")


_BLOCKS = r"""SELECT DISTINCT 'questions' AS table_name, id AS key, raw_text AS text FROM questions UNION ALL SELECT 'documents', doc_id::VARCHAR, text FROM documents"""
_FIRST_OPTION = r"(?m)^\s*(?:\*{0,2}\(?[A-E]\)\*{0,2}\s|-\s+[A-E]\s)"
_CONTEXT = r"(?is)((?:TEXTO\s+[IVX]+|Texto\s+para\s+as?\s+quest|Leia\s+o\s+texto|Observe\s+a\s+figura|Analise\s+o\s+gráfico).*?)(?-i:\(?[A-E]\)\s)"


@query(
    rf"""WITH m AS (SELECT table_name, key, string_split(regexp_replace(coalesce(text, ''), '(?i)(?:\*\*)?quest[ãa]o\s*(\d+)(?:\*\*)?', chr(30) || '\1' || chr(31), 'g'), chr(30)) AS parts FROM ({_BLOCKS})),
        b AS (SELECT table_name, key, unnest(range(2, len(parts) + 1)) AS i, parts FROM m),
        c AS (SELECT table_name, key, i, string_split(parts[i], chr(31))[1]::INT AS number, {_sql_strip("substring(parts[i], instr(parts[i], chr(31)) + 1)")} AS block FROM b),
        l AS (SELECT * FROM c WHERE block <> '' QUALIFY row_number() OVER (PARTITION BY table_name, key, number ORDER BY i DESC) = 1),
        h AS (SELECT *, {_sql_strip(r"regexp_replace(regexp_split_to_array(block, " + _q(_FIRST_OPTION) + r")[1], '!\[[^\]]*\]\([^)]*\)', '', 'g')")} AS head FROM l),
        k AS (SELECT *, {_sql_strip(r"regexp_split_to_array(head, '\s-\s+[A-E]\s+\S')[1]")} AS st FROM h)
        SELECT table_name, key, number, CASE WHEN length(st) >= 10 THEN st ELSE substring(block, 1, 500) END AS statement, nullif({_sql_strip(f"regexp_extract(block, {_q(_CONTEXT)}, 1)")}, '') AS context FROM k"""
)
def question_blocks(spark, sf):
    """Question blocks of raw texts and of documents."""
    raw = records(spark, sf, "questions").select(F.lit("questions").alias("table_name"), F.col("id").alias("key"), F.col("raw_text").alias("text"))
    docs = read_table(spark, sf, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("key"), "text")
    both = raw.unionByName(docs).withColumn("_k", F.struct("table_name", "key"))
    blocks = parsing.question_blocks(both, "_k", "text")
    return blocks.select("_k.*", "number", parsing.statement("block").alias("statement"), parsing.context_block("block").alias("context"))


@query(
    """SELECT id, question_number, correct_answer, 'ingles' AS language_option FROM (SELECT DISTINCT id, question_number, correct_answer FROM answer_keys WHERE correct_answer IN ('A', 'B', 'C', 'D', 'E') AND question_number IS NOT NULL)
       UNION ALL SELECT id, question_number, translate(correct_answer, 'ABCDE', 'BCDEA'), 'espanhol' FROM (SELECT DISTINCT id, question_number, correct_answer FROM answer_keys WHERE correct_answer IN ('A', 'B', 'C', 'D', 'E') AND question_number <= 5)
       UNION ALL SELECT id, question_number + 45, correct_answer, NULL FROM (SELECT DISTINCT id, question_number, correct_answer FROM answer_keys WHERE correct_answer IN ('A', 'B', 'C', 'D', 'E') AND question_number IS NOT NULL)"""
)
def key_lines(spark, sf):
    """Answer keys printed as lines of a key sheet, two languages up to number 5 and a second column, and read back."""
    keys = records(spark, sf, "answer_keys").where("correct_answer RLIKE '^[A-E]$' AND question_number IS NOT NULL")
    second = F.when(F.col("question_number") <= 5, F.translate("correct_answer", "ABCDE", "BCDEA"))
    lines = keys.select("id", F.concat_ws(" ", F.col("question_number").cast("string"), "correct_answer", second, (F.col("question_number") + 45).cast("string"), "correct_answer").alias("line"))
    return parsing.answer_key_rows(lines, "line", "id").select("id", "question_number", "correct_answer", "language_option")


@query(
    r"""SELECT id, unnest(regexp_extract_all(t, '(\d+) [A-E]', 1))::INT AS number, unnest(regexp_extract_all(t, '\d+ ([A-E])', 1)) AS answer FROM (
        SELECT e AS id, string_agg(n || ' ' || a, ' ; ' ORDER BY n) AS t FROM (SELECT exam_metadata_id AS e, question_number AS n, min(correct_answer) AS a FROM answer_keys
        WHERE correct_answer IN ('A', 'B', 'C', 'D', 'E') AND question_number BETWEEN 1 AND 180 AND exam_metadata_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
)
def loose_answer_pairs(spark, sf):
    """Answers of each exam printed in one line of loose pairs, the first one wrong and repeated, and read back."""
    keys = records(spark, sf, "answer_keys").where("correct_answer RLIKE '^[A-E]$' AND question_number BETWEEN 1 AND 180 AND exam_metadata_id IS NOT NULL")
    one = keys.groupBy("exam_metadata_id", "question_number").agg(F.min("correct_answer").alias("a"))
    pair = F.transform(F.array_sort(F.collect_list(F.struct("question_number", "a"))), lambda x: F.concat_ws(" ", x["question_number"].cast("string"), x["a"]))
    lines = one.groupBy(F.col("exam_metadata_id").alias("id")).agg(F.array_join(pair, " ; ").alias("t"))
    wrong = F.translate(F.regexp_extract("t", r"^\d+ [A-E]", 0), "ABCDE", "BCDEA")
    return lines.select("id", F.explode(parsing.loose_answers(F.concat_ws(" ; ", wrong, "t"))).alias("number", "answer"))


@query()
def extracted_options(spark, sf):
    found = records(spark, sf, "questions").where("raw_text IS NOT NULL").select("id", parsing.extract_options("raw_text").alias("x"))
    return found.select("id", "x.confidence", "x.strategy", F.size("x.options").alias("n_options"))


@query()
def relabelled_options(spark, sf):
    t = parsing.relabel_options("raw_text")
    return _raw_texts(spark, sf).select("table_name", "id", t.alias("text"))


@query(
    rf"""SELECT table_name, id, len(l) >= 2 AND l = list_sort(list_distinct(l)) AS ascending FROM (SELECT table_name, id,
        list_transform(list_filter(string_split(coalesce(raw_text, ''), chr(10))[1:10], lambda x: regexp_matches(x, '^\s*[A-E]\s+\S')), lambda x: left(ltrim(x), 1)) AS l FROM ({_RAW}))"""
)
def ascending_options(spark, sf):
    return _raw_texts(spark, sf).select("table_name", "id", parsing.options_ascend("raw_text").alias("ascending"))


@query(
    rf"""SELECT id, letter, min_by(value, i) AS value FROM (SELECT id, i, left(line, 1) AS letter, {_sql_strip("regexp_replace(line, '^[A-E][)][*]{0,2}', '')")} AS value FROM (
        SELECT id, unnest(range(len(o))) AS i, unnest(o) AS line FROM (SELECT id, regexp_extract_all(raw_text, '(?m)^\s*(?:-\s+)?\*{{0,2}}\(?([A-E]\)[^\n]*)', 1) AS o FROM (SELECT DISTINCT id, raw_text FROM questions)))) WHERE value <> '' GROUP BY 1, 2"""
)
def simple_option_lines(spark, sf):
    return records(spark, sf, "questions").select("id", F.explode(parsing.simple_options("raw_text")).alias("letter", "value"))


_LISTED = f"SELECT question_id AS id, list(alternative_text ORDER BY alternative_order, alternative_letter, id) AS o FROM {_OWN_OPTIONS} GROUP BY 1"
_NEXT = "contains(o[i], o[i + 1]) AND o[i + 1] <> ''"
_HEAD = _sql_strip("substring(o[i], 1, instr(o[i], o[i + 1]) - 1)")


@query(
    f"""SELECT question_id, n >= 3 AND hits >= 2 AS cascade, options FROM (SELECT id AS question_id, len(o) AS n,
        len(list_filter(range(1, len(o)), lambda i: {_NEXT})) AS hits,
        array_to_string(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN i < len(o) AND {_NEXT} AND {_HEAD} <> '' THEN {_HEAD} ELSE {_sql_strip('o[i]')} END), '|') AS options FROM ({_LISTED}))"""
)
def cascades(spark, sf):
    options = _ordered_options(spark, sf, F.col("alternative_text"), "question_id")
    return options.select("question_id", parsing.is_cascade("options").alias("cascade"), F.array_join(parsing.undo_cascade("options"), "|").alias("options"))


# ---------------------------------------------------------------- scoring


def _with_options(spark, sf):
    options = _ordered_options(spark, sf, F.col("alternative_text"), "id")
    q = records(spark, sf, "questions").select("id", "question_text", "question_number", "subject", "extraction_method")
    return q.join(options, "id", "left")


_SCORED = f"""SELECT q.id, q.question_number, q.subject, q.extraction_method, coalesce(question_text, '') AS t, coalesce(o, []) AS o, coalesce(question_text, '') || ' ' || coalesce(array_to_string(o, ' '), '') AS whole
  FROM (SELECT DISTINCT id, question_text, question_number, subject, extraction_method FROM questions) q LEFT JOIN ({_LISTED}) a USING (id)"""
_PLACEHOLDERS = r"len(list_filter(o, lambda x: regexp_matches(x, '(?i)\[Alternative not found\]|\[Alternativa não encontrada\]'))) > 0"
_O = {i: f"coalesce(o[{i + 1}], '')" for i in (0, 1, 2, 4)}
_CONFIRMED = f"(contains({_O[0]}, {_O[1]}) AND contains({_O[1]}, {_O[2]}))"
_SUSPECTED = f"(len(o) >= 5 AND length({_O[0]}) > 3 * length({_O[4]}) AND length({_O[4]}) > 0)"
_QUALITY = f"""CASE WHEN len(o) = 0 THEN '' WHEN {_PLACEHOLDERS} THEN 'placeholder_detected' WHEN len(o) >= 3 AND {_CONFIRMED} THEN 'cascade_confirmed' WHEN {_SUSPECTED} THEN 'cascade_suspected'
  WHEN len(list_filter(o, lambda x: length(x) < 3)) > 0 THEN 'short_options' END"""


@query(
    f"""WITH a AS (SELECT *, {_QUALITY} AS issue, {_sql_contaminated('whole')} AS dirty, {_sql_count('t', r"(?m)^[A-E]\s+\S.{2,}")} >= 3 AS listed, len(o) = 5 AS five, coalesce(question_number BETWEEN 1 AND 180, false) AS placed FROM ({_SCORED})),
        b AS (SELECT *, CASE WHEN five THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN length(t) >= 50 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN issue IS NULL THEN 0.25 WHEN issue = 'cascade_suspected' THEN 0.05 WHEN issue = 'short_options' THEN 0.1 ELSE 0 END::DOUBLE
          + CASE WHEN placed THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN NOT dirty AND NOT listed THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN five AND length(t) > 0 AND placed THEN 0.1 ELSE 0 END::DOUBLE AS total FROM a)
        SELECT id, round(total, 4) AS score, concat_ws(';', CASE WHEN NOT five THEN 'options=' || len(o) END, CASE WHEN length(t) < 50 THEN 'text_length=' || length(t) END, nullif(issue, ''),
          CASE WHEN NOT placed THEN 'number=' || coalesce(question_number::VARCHAR, 'null') END, CASE WHEN dirty THEN 'contaminated' WHEN listed THEN 'raw_options_in_text' END,
          CASE WHEN NOT (five AND length(t) > 0 AND placed) THEN 'invalid' END) AS issues,
          CASE WHEN total >= 0.85 - 1e-9 THEN 'accept' WHEN total >= 0.55 - 1e-9 THEN 'fallback' ELSE 'dead_letter' END AS routing FROM b"""
)
def confidence_scores(spark, sf):
    scored = _with_options(spark, sf).select("id", scoring.confidence("question_text", "options", "question_number").alias("c"))
    return scored.select("id", "c.score", F.array_join("c.issues", ";").alias("issues"), "c.routing")


_AUDITED = f"""SELECT id, subject, extraction_method, list_filter([CASE WHEN {_PLACEHOLDERS} THEN 'placeholder' END, CASE WHEN {_sql_contaminated('t')} THEN 'header_pollution' END,
  CASE WHEN regexp_matches(whole, {_q(scoring.CID_MARK)}) THEN 'cid_token' END, CASE WHEN regexp_matches(whole, {_q(scoring.TYPESETTER_MARK)}) THEN 'typesetter_artefact' END,
  CASE WHEN regexp_matches(whole, {_q(scoring.MARKDOWN_MARK)}) THEN 'markdown_artefact' END, CASE WHEN {_SUSPECTED} AND {_CONFIRMED} THEN 'cascade' END,
  CASE WHEN length(t) < 50 THEN 'short_text' END, CASE WHEN len(o) < 5 THEN 'missing_options' END], lambda x: x IS NOT NULL) AS issues FROM ({_SCORED})"""


@query(
    f"""WITH f AS (SELECT unnest(issues) AS issue, extraction_method, subject FROM ({_AUDITED}))
        SELECT issue, 'all' AS dimension, NULL AS value, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT issue, 'extraction_method', extraction_method, count(*) FROM f GROUP BY 1, 3
        UNION ALL SELECT issue, 'subject', subject, count(*) FROM f GROUP BY 1, 3"""
)
def audit_breakdown(spark, sf):
    issues = _with_options(spark, sf).withColumn("issues", scoring.audit_issues("question_text", "options"))
    return mining.audit_counts(issues, "issues", "extraction_method", "subject")


@query(f"SELECT id, array_to_string(issues, ';') AS issues, len(issues) AS n FROM ({_AUDITED}) ORDER BY n DESC, id LIMIT 20")
def most_issues(spark, sf):
    issues = _with_options(spark, sf).select("id", scoring.audit_issues("question_text", "options").alias("issues"))
    return issues.select("id", F.array_join("issues", ";").alias("issues"), F.size("issues").alias("n")).orderBy(F.desc("n"), "id").limit(20)


@query(
    rf"""SELECT id, array_to_string(p, ';') AS problems, list_contains(p, 'missing_options') OR list_contains(p, 'short_text') OR len(p) >= 2 AS repair FROM (SELECT id, list_filter([
        CASE WHEN len(o) < 5 OR len(list_filter(o, lambda x: trim(x) = '')) > 0 THEN 'missing_options' END, CASE WHEN length(trim(t)) < 20 THEN 'short_text' END, CASE WHEN regexp_matches(t, '�|\?{{2,}}') THEN 'broken_signs' END,
        CASE WHEN regexp_matches(t, {_q(scoring.CID_MARK)}) THEN 'glyph_codes' END, CASE WHEN NOT regexp_matches(rtrim(t), '[.!?:…»”")]$') THEN 'no_sentence_end' END], lambda x: x IS NOT NULL) AS p FROM ({_SCORED}))"""
)
def repair_triage(spark, sf):
    needs = _with_options(spark, sf).select("id", scoring.repair_needs("question_text", "options").alias("r"))
    return needs.select("id", F.array_join("r.problems", ";").alias("problems"), "r.repair")


_LAYOUTS = {"science": ["energia", "temperatura", "solução", "gás"], "language": ["texto", "poema", "eu lírico", "leitura"], "mathematics": ["razão", "ângulo", "litros", "capacidade"]}


@query(
    "SELECT id, CASE WHEN s < 0.3 THEN 'mixed' ELSE l END AS layout, CASE WHEN s < 0.3 THEN 0.5 ELSE s END AS score FROM (SELECT id, greatest(science, language, mathematics) AS s, "
    "CASE WHEN science >= language AND science >= mathematics THEN 'science' WHEN mathematics >= language THEN 'mathematics' ELSE 'language' END AS l FROM (SELECT id, "
    + ", ".join("(" + " + ".join(f"contains(t, {_q(w)})::INT" for w in words) + f") / {len(words)}.0::DOUBLE AS {name}" for name, words in _LAYOUTS.items())
    + " FROM (SELECT DISTINCT id, lower(coalesce(question_text, '')) AS t FROM questions)))"
)
def layouts(spark, sf):
    return records(spark, sf, "questions").select("id", scoring.layout_of("question_text", _LAYOUTS).alias("x")).select("id", "x.*")


_COUNTED = {"n_sentences": r"[.!?]+", "n_digits": r"\d", "n_commas": ",", "n_questions": r"\?"}


@query(
    rf"""SELECT id, length(t) AS n_chars, len(w) AS n_words, {", ".join(f"{_sql_count('t', p)} AS {n}" for n, p in _COUNTED.items())},
        CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE, 6) ELSE 0.0 END AS mean_word, len(o) AS n_options,
        coalesce(round(list_avg(list_transform(o, lambda x: length(x)))::DOUBLE, 6), 0.0) AS mean_option, coalesce(round(list_stddev_pop(list_transform(o, lambda x: length(x)))::DOUBLE, 6), 0.0) AS std_option
        FROM (SELECT *, list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '') AS w FROM ({_SCORED}))"""
)
def difficulty_features(spark, sf):
    """Options are measured where they are read and summed up per question, so one to which very many hang is no long list."""
    options = read_table(spark, sf, "question_alternatives").select("id", "question_id", F.length("alternative_text").alias("_l")).dropDuplicates(["id"])
    sums = options.groupBy(F.col("question_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.avg("_l").alias("_mean"), F.stddev_pop("_l").alias("_std"))
    q = records(spark, sf, "questions").select("id", "question_text").join(sums, "id", "left")
    f = q.select("id", scoring.measured_features("question_text", F.col("_n"), F.col("_mean"), F.col("_std")).alias("f")).select("id", "f.*")
    return f.withColumns({c: F.round(c, 6) for c in ("mean_word", "mean_option", "std_option")})


@query(
    """SELECT doc_id, (CASE WHEN contains(lower(text), 'energia') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'solução') THEN 1 ELSE 0 END) AS science, (CASE WHEN contains(lower(text), 'poema') THEN 1 ELSE 0 END) AS language,
       contains(text, '%') AS has_percent FROM documents"""
)
def keyword_flags(spark, sf):
    flags = mining.keyword_flags("text", {"science": ["energia", "solução"], "language": ["poema"]})
    return read_table(spark, sf, "documents").select("doc_id", flags.alias("f")).select("doc_id", "f.science", "f.language", "f.has_percent")


# ---------------------------------------------------------------- search

#: The query vector: the components of a sine, so that no row need be read for it.
def _query_vector(n: int = 64) -> list[float]:
    import math

    return [round(math.sin(i + 1), 6) for i in range(n)]


_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in _query_vector()) + "]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_QV})"
TERMS = ("energia", "agua")


@query(f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_top20(spark, sf):
    top = search.vector_top_k(read_table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(), 20)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT label, vec_id, round(s, 6) AS similarity FROM (SELECT label, vec_id, {_COS} AS s, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings) WHERE r = 1 ORDER BY s DESC, vec_id LIMIT 5")
def vector_top_per_label(spark, sf):
    top = search.vector_top_k(read_table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(), 5, one_per="label")
    return top.select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings WHERE {_COS} >= 0.2")
def similarity_threshold(spark, sf):
    scored = search.vector_scores(read_table(spark, sf, "embeddings"), "embedding", _query_vector()).where("similarity >= 0.2")
    return scored.select("vec_id", F.round("similarity", 6).alias("similarity"))


_TOKENS = r"list_filter(regexp_split_to_array(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]+'), lambda x: x <> '')"
_MATCHES = f"""SELECT doc_id, least(1.0, (len(list_filter(w, lambda x: x = '{TERMS[0]}')) + len(list_filter(w, lambda x: x = '{TERMS[1]}'))) / (1 + ln(1.0 + len(w))) / 10.0) AS text_score
  FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE list_contains(w, '{TERMS[0]}') AND list_contains(w, '{TERMS[1]}')"""


@query(f"SELECT doc_id, round(text_score, 6) AS text_score FROM ({_MATCHES}) ORDER BY text_score DESC, doc_id LIMIT 20")
def text_top20(spark, sf):
    top = search.text_top_k(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", TERMS, 20)
    return top.select("doc_id", F.round("text_score", 6).alias("text_score"))


@query(
    f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT vec_id AS doc_id, {_COS} AS s FROM embeddings) QUALIFY r <= 30),
        b AS (SELECT doc_id, row_number() OVER (ORDER BY text_score DESC, doc_id) AS r FROM ({_MATCHES}) QUALIFY r <= 30)
        SELECT doc_id, a.r AS rank_a, b.r AS rank_b, round((1.0::DOUBLE / (60 + coalesce(a.r, 31)) + 1.0::DOUBLE / (60 + coalesce(b.r, 31))) / (2.0::DOUBLE / 61), 6) AS score
        FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""
)
def hybrid_rrf(spark, sf):
    """Hybrid search: vectors and words ranked apart and fused."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.hybrid_search(docs, "doc_id", "text", vectors, "embedding", _query_vector(), TERMS, 10)


_VECTORS = f"""SELECT id, question_id, chunk_type, lower(subject) AS subject, s FROM (SELECT id, question_id, chunk_type, list_cosine_similarity(embedding::DOUBLE[], {_QV}) AS s FROM (SELECT DISTINCT * FROM question_chunks)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) c LEFT JOIN (SELECT DISTINCT id AS question_id, subject FROM questions) q USING (question_id)"""


def _searched_chunks(spark, sf):
    """Chunks with usable vectors, and the subjects of their questions."""
    v = F.col("embedding")
    usable = (F.size(v) == 64) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    subjects = records(spark, sf, "questions").select(F.col("id").alias("question_id"), "subject")
    return records(spark, sf, "question_chunks").where(usable).select("id", "question_id", "chunk_type", "embedding").join(subjects, "question_id", "left")


@query(f"SELECT id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS r FROM ({_VECTORS}) WHERE chunk_type = 'context') WHERE r = 1 ORDER BY s DESC, id LIMIT 5")
def context_chunks(spark, sf):
    """The five best context chunks, one per question."""
    top = search.filtered_vectors(_searched_chunks(spark, sf), _query_vector(), 5, chunk_type="context")
    return top.select("id", F.round("similarity", 6).alias("similarity"))


@query(
    f"SELECT id, question_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS r FROM ({_VECTORS}) WHERE chunk_type = 'full' AND subject = 'matemática') WHERE r = 1 ORDER BY s DESC, id LIMIT 10"
)
def subject_chunks(spark, sf):
    """Search within one subject, whatever the case of its name; filters come before the top rows."""
    top = search.filtered_vectors(_searched_chunks(spark, sf), _query_vector(), 10, chunk_type="full", subject="MATEMÁTICA")
    return top.select("id", "question_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT doc_id, total_rows FROM (SELECT m.doc_id, text_score, exam_year, count(*) OVER () AS total_rows FROM ({_MATCHES}) m JOIN documents d ON d.doc_id = m.doc_id) ORDER BY text_score DESC, exam_year DESC NULLS LAST, doc_id LIMIT 10 OFFSET 10")
def text_search_page(spark, sf):
    """The second page of a word search with the number of all matches; ties go to the latest year."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "exam_year")
    return search.text_page(docs, "doc_id", "text", TERMS, "exam_year", 2, 10).select("doc_id", "total_rows")


@query(f"SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, {_COS} AS s FROM embeddings) QUALIFY rank <= 10")
def semantic_mode(spark, sf):
    """Hybrid search in its semantic mode, which reads no words."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.hybrid_search(docs, "doc_id", "text", vectors, "embedding", _query_vector(), TERMS, 10, "semantic").select("doc_id", F.col("rank").cast("long").alias("rank"))


_WORD_SETS = f"SELECT w, min(id) AS id FROM (SELECT id, list_sort(list_distinct({_TOKENS.replace('text', 'question_text')})) AS w FROM (SELECT DISTINCT id, question_text FROM questions)) WHERE len(w) > 0 GROUP BY 1"


@query(
    f"""WITH s AS ({_WORD_SETS}) SELECT id_a, id_b, n / (la + lb - n)::DOUBLE AS similarity FROM (SELECT a.id AS id_a, b.id AS id_b, len(a.w) AS la, len(b.w) AS lb, len(list_intersect(a.w, b.w)) AS n
        FROM s a JOIN s b ON a.id < b.id AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w)) WHERE n >= 0.8 * (la + lb - n)"""
)
def similar_word_sets(spark, sf):
    """Pairs of different word sets among questions that share at least 0.8 of their words; all of them, as the filters are exact."""
    return search.word_set_classes(records(spark, sf, "questions"), "id", "question_text", 0.8)


@query(f"WITH s AS ({_WORD_SETS}) SELECT q.id, s.id AS representative FROM (SELECT id, list_sort(list_distinct({_TOKENS.replace('text', 'question_text')})) AS w FROM (SELECT DISTINCT id, question_text FROM questions)) q JOIN s ON s.w = q.w")
def word_set_members(spark, sf):
    return search.word_set_members(records(spark, sf, "questions"), "id", "question_text")


# ---------------------------------------------------------------- models


@query()
def text_clusters(spark, sf):
    return mining.cluster_texts(read_table(spark, sf, "documents"), "doc_id", "text")[1]


@query()
def subject_predictions(spark, sf):
    q = records(spark, sf, "questions").withColumn("subject", F.lower(F.trim("subject")))
    return mining.predict_labels(q, mining.train_classifier(q, "subject", "question_text", "nb"), "id", "question_text").select("id", "predicted")


def _forest(spark, sf):
    q = records(spark, sf, "questions").withColumn("subject", F.lower(F.trim("subject"))).select("id", "subject", "question_text")
    training, test = mining.split_rows(q.where("subject IS NOT NULL"), "id")
    return mining.train_classifier(training, "subject", "question_text", "rf", vocabulary=500, pairs=True, balanced=True), test


@query()
def forest_confusion(spark, sf):
    """A forest on words and pairs of words with balanced labels, judged on the fifth of the rows that it has not seen."""
    model, test = _forest(spark, sf)
    judged = mining.predict_labels(test, model, "id", "question_text").join(test.select("id", "subject"), "id")
    return mining.confusion(judged, "subject", "predicted")


@query()
def forest_terms(spark, sf):
    return mining.term_importances(_forest(spark, sf)[0], spark)


# ---------------------------------------------------------------- streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf):
    return ingest.windowed_counts(spark, f"{sf}/events.parquet").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"""
)
def streamed_totals(spark, sf):
    """A stream of the events, aggregated as it arrives and read when it has ended."""
    return ingest.drained(ingest.type_totals(ingest.event_stream(spark, f"{sf}/events.parquet")), "complete").select("event_type", "n", F.round("total", 4).alias("total"))
