"""Text, parsing and scoring functions on literal rows."""

import hashlib
import statistics
import time

import pytest
from pyspark.sql import functions as F

from corvina.functions import cleaning, parsing, scoring
from corvina.functions import text as T


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("Dentre essas duas embalagens 2º DIA • CADERNO 8 • VERDE • MAT", "Dentre essas duas embalagens"),
        ("texto MENE 2024 final", "texto final"),
        ("resultado NEM2024 17", "resultado"),
        ("a (cid:42) b", "a b"),
        ("fim..iinnddb 16", "fim"),
        ("x\n\n\n\ny", "x\n\ny"),
        ("CIÊNCIAS HUMANAS E SUAS TECNOLOGIAS ok", "ok"),
        ("limpo", "limpo"),
        ("", ""),
        (None, None),
    ],
)
def test_sanitise(spark, dirty, clean):
    assert one(spark, dirty, T.sanitise) == clean
    assert one(spark, clean, T.sanitise) == clean  # a second time changes nothing


def test_options_lose_page_numbers(spark):
    assert one(spark, "texto da opção 25", T.sanitise_option) == "texto da opção"
    assert one(spark, "texto -", T.sanitise_option) == "texto"


def test_encoding_and_composition(spark):
    assert one(spark, "educaÃ§Ã£o “x” – …", T.normalise_encoding) == 'educação "x" - ...'
    assert one(spark, "ação", T.nfc) == "ação"
    assert one(spark, "a?? Ã©", T.encoding_issues) == ["question_marks=1", "A_tilde=1"]
    full = one(spark, "aÃ§Ã£o  x", T.normalise_full)
    assert (full.text, full.steps, full.improvement) == ("ação x", ["encoding", "artefacts"], 1.0)


def test_garble_ratio(spark):
    assert one(spark, "ab��cd\x01x", T.garble_ratio) == 2 / 8
    assert one(spark, "", T.garble_ratio) == 0.0
    assert one(spark, None, T.garble_ratio) == 0.0


def test_repetitive(spark):
    assert one(spark, "curto", T.is_repetitive) is True
    assert one(spark, "bla " * 60, T.is_repetitive) is True
    assert one(spark, " ".join(f"palavra{i}" for i in range(30)), T.is_repetitive) is False


def test_content_hash(spark):
    h = lambda text, year=2024: spark.createDataFrame([(text, year)], "t string, y int").select(T.content_hash("t", "y").alias("h")).first().h
    assert h("QUESTÃO 12  Qual  é?") == h("qual é?".replace("q", "questão 7 q", 1))
    assert h("a") != h("a", 2023)
    assert h(None) == h("") == hashlib.sha256(b"2024:").hexdigest()[:16]


def test_windows_images_json(spark):
    assert [tuple(x) for x in one(spark, "abcde", lambda c: T.text_windows(c, 2))] == [(0, "ab"), (2, "cd"), (4, "e")]
    assert one(spark, None, T.text_windows) == []
    assert one(spark, "x ![a](b.png) ![](c.png)", T.image_refs) == ["b.png", "c.png"]
    assert one(spark, 'so: {"a": {"b": 1}} ok', T.salvage_json) == '{"a": {"b": 1}}'
    assert one(spark, "[1, 2] x", T.salvage_json) == "[1, 2]"
    assert one(spark, "none", T.salvage_json) is None


def test_filename(spark):
    m = one(spark, "/a/2024_GB_reaplicacao_PPL_D2_CD10_ampliada.pdf", parsing.filename_metadata)
    assert (m.year, m.kind, m.day, m.booklet, m.application_type, m.accessibility, m.exam_type) == (2024, "GB", 2, "CD10", "reaplicacao_PPL", "libras", "PPL")
    assert one(spark, "2024_GB.pdf", parsing.filename_metadata) is None
    assert one(spark, "2021_PV_impresso_D1_CD9.pdf", parsing.filename_metadata).accessibility == "braille_ledor"


def test_answer_keys(spark):
    df = spark.createDataFrame([("x", "1 C D 46 B\n2 A\nnada\n91 E 92 A"), ("y", None)], "id string, t string")
    got = sorted((r.question_number, r.correct_answer, r.language_option) for r in parsing.answer_key_rows(df, "t", "id").collect())
    assert got == [(1, "C", "ingles"), (1, "D", "espanhol"), (2, "A", "ingles"), (46, "B", None), (91, "E", "ingles"), (92, "A", None)]
    assert one(spark, "1 C 2 A 1 D 500 B", parsing.loose_answers) == {1: "D", 2: "A"}


def test_blocks(spark):
    text = "capa QUESTÃO 1 primeiro texto longo\n**questão 2** segundo\nQuestão 1 outra vez"
    df = spark.createDataFrame([(1, text), (2, None)], "d int, t string")
    assert sorted((r.number, r.block) for r in parsing.question_blocks(df, "d", "t").collect()) == [(1, "outra vez"), (2, "segundo")]
    assert one(spark, "Leia com calma o trecho.\nA) um\nB) dois", parsing.statement) == "Leia com calma o trecho."
    assert one(spark, "x TEXTO I abc def (A) um", parsing.context_block) == "TEXTO I abc def"
    assert one(spark, "sem marca", parsing.context_block) is None


def test_hints(spark):
    hints = one(spark, "QUESTÃO 7 A) x B) y C) z 300", parsing.question_hints)
    assert [(h.method, h.number) for h in hints] == [("heading", 7), ("options", None), ("number", 7)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("texto\nA) um dois três\nB) quatro\nC) cinco\nD) seis\nE) sete", {"A": "um dois três", "B": "quatro", "C": "cinco", "D": "seis", "E": "sete"}),
        ("AA um\nBB dois\nCC três\nDD quatro\nEE cinco", {"A": "um", "B": "dois", "C": "três", "D": "quatro", "E": "cinco"}),
        ("- A um - B dois - C três - D quatro - E cinco", {"A": "um", "B": "dois", "C": "três", "D": "quatro", "E": "cinco"}),
        ("A) um\nB) dois\nC) três\nD) quatro E) cinco", {"A": "um", "B": "dois", "C": "três", "D": "quatro", "E": "cinco"}),
        ("nada", {}),
        (None, {}),
    ],
)
def test_options(spark, text, expected):
    assert one(spark, text, parsing.extract_options).options == expected


def test_simple_options(spark):
    assert one(spark, "x\nA) um\n- **B)** dois\n(C) três\nA) outra\nD)\n", parsing.simple_options) == {"A": "um", "B": "dois", "C": "três"}
    assert one(spark, None, parsing.simple_options) == {}


def test_cascade(spark):
    nested = ["opção A opção B opção C", "opção B opção C", "opção C"]
    assert one(spark, nested, parsing.is_cascade, "array<string>") is True
    assert one(spark, nested, parsing.undo_cascade, "array<string>") == ["opção A", "opção B", "opção C"]
    assert one(spark, ["a", "b", "c"], parsing.is_cascade, "array<string>") is False
    assert one(spark, [], parsing.is_cascade, "array<string>") is False


def test_relabel(spark):
    assert one(spark, "A um dois\nA três dois\n\nA quatro dois\nfim do texto aqui", parsing.relabel_options) == "A um dois\nB três dois\nC quatro dois\nfim do texto aqui"
    assert one(spark, "A um só\nfim", parsing.relabel_options) == "A um só\nfim"


OPTIONS = [f"Alt {x}: {'x' * 20}" for x in "ABCDE"]


@pytest.mark.parametrize(
    ("text", "options", "number", "score", "routing"),
    [
        ("A" * 100, OPTIONS, 10, 1.0, "accept"),
        ("A" * 10, OPTIONS, 10, 0.85, "accept"),
        ("A" * 100, OPTIONS[:4], 10, 0.7, "fallback"),
        ("A" * 100, ["[Alternative not found]", *OPTIONS[1:]], 10, 0.75, "fallback"),
        ("(cid:3)", [], None, 0.0, "dead_letter"),
        (None, None, None, 0.2, "dead_letter"),
    ],
)
def test_confidence(spark, text, options, number, score, routing):
    df = spark.createDataFrame([(text, options, number)], "t string, o array<string>, n int")
    got = df.select(scoring.confidence("t", "o", "n").alias("c")).first().c
    assert (got.score, got.routing) == (score, routing)


def test_audit(spark):
    issues = lambda t, o: spark.createDataFrame([(t, o)], "t string, o array<string>").select(scoring.audit_issues("t", "o").alias("i")).first().i
    assert issues("x" * 60, OPTIONS) == []
    assert issues("x" * 60, ["[alternativa não encontrada]", *OPTIONS[1:]]) == ["placeholder"]
    assert issues("(cid:42)" + "x" * 60, OPTIONS) == ["header_pollution", "cid_token"]
    assert issues(None, None) == ["short_text", "missing_options"]


def test_layout_and_features(spark):
    df = spark.createDataFrame([("Energia e gás.", ["a", "bcd"]), (None, None)], "t string, o array<string>")
    rows = df.select(scoring.layout_of("t", {"s": ["energia", "gás"], "l": ["poema"]}).alias("l"), scoring.text_features("t", "o").alias("f")).collect()
    assert (rows[0].l.layout, rows[0].l.score) == ("s", 1.0)
    assert (rows[0].f.n_words, rows[0].f.n_options, rows[0].f.mean_option, rows[0].f.std_option) == (3, 2, 2.0, 1.0)
    assert (rows[1].l.layout, rows[1].f.n_chars) == ("mixed", 0)


def test_features_of_many_options(spark):
    """The time grows with the number of options, not with its square; null options count, but have no length."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.repeat(F.lit("x"), (i % 7).cast("int"))).alias("o"))
    spark.range(1).select(scoring.text_features(F.lit("t"), F.array(F.lit("a"))).alias("f")).collect()
    began = time.monotonic()
    f = df.select(scoring.text_features(F.lit("t"), "o").alias("f")).first().f
    assert time.monotonic() - began < 10
    lengths = [i % 7 for i in range(1, 30_001)]
    assert (f.n_options, round(f.mean_option, 6), round(f.std_option, 6)) == (30_000, round(statistics.fmean(lengths), 6), round(statistics.pstdev(lengths), 6))
    f = spark.createDataFrame([(["a", None, "bcd"],)], "o array<string>").select(scoring.text_features(F.lit("t"), "o").alias("f")).first().f
    assert (f.n_options, f.mean_option, f.std_option) == (3, 2.0, 1.0)


def test_routing_bounds(spark):
    df = spark.createDataFrame([(0.85,), (0.8499,), (0.55,), (0.1,)], "s double")
    assert [r.r for r in df.select(scoring.route(F.col("s")).alias("r")).collect()] == ["accept", "fallback", "fallback", "dead_letter"]


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [("texto ENEM2024ENEM2024 fim", "texto fim"), ("texto 12", "texto"), ("texto AAAAAAAAA", "texto"), ("texto MATEMÁTICA e mais", "texto"), ("  a   b ", "a b"), (None, "")],
)
def test_clean_question(spark, dirty, clean):
    assert one(spark, dirty, cleaning.clean_question) == clean


def test_clean_option(spark):
    for dirty, clean in (("opção ENEM2024 x", "opção"), ("opção 25", "opção"), ("opção .", "opção."), ("uma opção AB", "uma opção"), ("CO2 AAAA", "CO2")):
        assert one(spark, dirty, cleaning.clean_option) == clean
    assert one(spark, "a 2202 MENE b enem 2023 c", cleaning.drop_separators) == "a b c"


def test_estimates(spark):
    assert [one(spark, t, cleaning.estimated_number) for t in ("QUESTÃO 7 x", "a √ b", "um poema", "nada", None)] == [7, 95, 15, 50, 50]
    df = spark.createDataFrame([(10, 32), (1, 32), (180, 32), (10, 0), (10, None)], "n int, p int")
    assert [r.x for r in df.select(cleaning.page_range("n", "p").alias("x")).collect()] == ["4-6", "1-2", "31-32", "1-5", "1-5"]
