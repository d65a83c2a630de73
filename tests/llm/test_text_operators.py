"""Encoding, scans, levels, languages and survivors on small texts."""

from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import encoding, languages, levels, scans, survivors

SENTENCES = [
    "A fórmula contém água, açúcar e ácido; não há exceção à regra.",
    "O avô não vê a irmã há três anos, mas está só e tranquilo.",
    "A produção de café aumentou após a última eleição, segundo o relatório.",
    "São Paulo é a maior cidade do país e também a mais populosa.",
    "O ângulo θ mede 45° e a razão é 3 × 2 ÷ 4 ≤ √2.",
    "— Você vem? — perguntou João. — Já vou!",
    "A situação das famílias é difícil; a opinião pública está dividida.",
    "«Às vezes», disse ela, “é melhor não saber”.",
]


@pytest.fixture(scope="module")
def codes():
    return encoding.fit(SENTENCES * 5)


# ---------------------------------------------------------------- encoding


@pytest.mark.parametrize("chain", ["utf8>cp1252", "utf8>latin1", "utf8>mac", "utf8>cp850", "cp1252>cp437", "cp1252>cp1251", "cp1252>cp1253", "utf8>cp1252>cp1252", "utf8>latin1>mac"])
def test_chains_invert(codes, chain):
    for text in SENTENCES[:4] + SENTENCES[6:7]:
        wrong = encoding.garble(text, chain)
        assert encoding.invert(wrong, chain) == text
        found = codes.repair(wrong)
        assert found is not None and found[3] == text, (chain, wrong, found)


def test_one_damaged_place(codes):
    text = SENTENCES[0] + " " + SENTENCES[2]
    wrong = text.replace("relatório", encoding.garble("relatório", "utf8>cp1252"))
    assert codes.repair(wrong)[1:] == (1, 0, text)


@pytest.mark.parametrize("text", [*SENTENCES, "", "NÃO É PERMITIDO", "ASCII only? Yes.", "um mundo n0vo", "o que é isso???", "½ × π", "niños, façade, naïve"])
def test_undamaged(codes, text):
    assert codes.repair(text) is None


def test_lost_letters(codes):
    assert codes.repair("A produ��o de caf� aumentou") == ("lost", 2, 2, "A produção de café aumentou")
    assert codes.repair("A produ??o de caf? aumentou")[0] == "lost"
    assert codes.repair("xyz�w") == ("lost", 1, 1, None)


def test_words_before_question_marks(codes):
    """A lost last letter is a case by the classifier's lead and a known word; an ordinary question is none."""
    assert codes.repair("O caf? aumentou e o café também") == ("lost", 1, 1, "O café aumentou e o café também")
    assert codes.repair("Quem é você? disse ela") is None and codes.repair("E a casa? perguntou") is None


def test_dropped_invisible_characters(codes):
    wrong = encoding.garble("famílias", "utf8>cp1252").replace("\xad", "")
    assert codes.repair(f"as {wrong} estÃ£o")[3] == "as famílias estão"
    bare = encoding.garble("Às vezes não há exceção à regra.", "utf8>latin1")
    assert codes.repair("".join(c for c in bare if not "\x80" <= c < "\xa0").replace("\xa0", " "))[3] == "Às vezes não há exceção à regra."


def test_encoding_frame(spark, codes):
    rows = [("a", encoding.garble(SENTENCES[0], "utf8>cp1252"), 1), ("b", SENTENCES[0], 2), ("c", None, 3), ("d", "", 4)]
    df = spark.createDataFrame(rows, "id string, text string, chain int")
    got = encoding.repair_encoding(df, codes).collect()
    assert [(r.id, r.chain, r.restored) for r in got] == [("a", "utf8>cp1252", SENTENCES[0])]
    assert encoding.repair_encoding(df.limit(0), codes).count() == 0
    assert encoding.repair_encoding(df.withColumn("k", F.lit("x")), codes, keep=("k",)).first().k == "x"


def test_many_dropped_characters_in_a_word():
    codes = encoding.fit([*SENTENCES * 5, "INFORMAÇÕES", "Leia as informações."])
    bare = "".join(c for c in encoding.garble("INFORMAÇÕES", "utf8>latin1>latin1") if not "\x80" <= c < "\xa0")
    assert bare == "INFORMAÃÂÃÂES"
    assert codes.repair(f"LEIA AS {bare} ABAIXO")[3] == "LEIA AS INFORMAÇÕES ABAIXO"


def test_words_outside_the_sample(spark):
    """Words are known from all texts, not from the sample that fits the table: one damaged word is found and restored."""
    codes = encoding.fit(SENTENCES * 5)
    rows = [(str(i), t) for i, t in enumerate(["O príncipe dança à noite, diz Zoé.", "Um príncipe é um príncipe."] * 3)]
    rows += [("one", "Era uma vez um " + encoding.garble("príncipe", "cp1252>cp850")), ("lost", "Era uma vez um pr�ncipe"), ("capital", "LÃ¡,"), ("other", "LÃ¡,")]
    rows += [(f"n{i}", "Lá, o avô não vê.") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    words = encoding.vocabulary(df.select("text"))
    got = {r.id: r.restored for r in encoding.repair_encoding(df, codes, words=words).collect()}
    assert got == {"one": "Era uma vez um príncipe", "lost": "Era uma vez um príncipe", "capital": "Lá,", "other": "Lá,"}
    assert encoding.repair_encoding(df.limit(0), codes, words=words).count() == 0


# ---------------------------------------------------------------- scans

PROSE = "O governo anunciou uma nova medida para o setor de energia elétrica. A população das cidades pequenas depende da chuva."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [x for i in range(60) for x in (PROSE, f"O governo anunciou uma nova\nCN - 1º dia | Caderno {i} - AZUL - Página {i}\nmedida para o setor.")]
    rows += ["O govern0 e a mcdida", "uma nova meclida para o setor", "uma nova mcdida."]
    return scans.learn(spark.createDataFrame([(t,) for t in rows], "text string"))


def repaired(spark, model, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = scans.repair_scans(df, model).collect()
    return (got[0].n_divided, got[0].n_misread, got[0].n_headers, got[0].repaired) if got else None


def test_skeletons(spark):
    for good, bad in (("forma", "forrna"), ("medida", "meclida"), ("setor", "sefor"), ("produção", "produça~o"), ("chuva", "cliuva"), ("casa", "c@5a"), ("pediu", "pediii")):
        assert scans.skeleton(good) == scans.skeleton(bad)
    words = ["c@5a", "forrna", "produça~o", "ﬁm", "abc123", "li", "ii$|9!"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", scans.skeleton_of(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: scans.skeleton(w) for w in words}


def test_repairs(spark, pages):
    assert repaired(spark, pages, PROSE) is None
    assert repaired(spark, pages, "") is None
    assert repaired(spark, pages, "O governo anun-\nciou uma nova medida.") == (1, 0, 0, "O governo anunciou uma nova medida.")
    assert repaired(spark, pages, "O governo anun¬ \r\nciou uma nova medida.")[3] == "O governo anunciou uma nova medida."
    assert repaired(spark, pages, "O govern0 anunciou uma nova mcdida.") == (0, 2, 0, "O governo anunciou uma nova medida.")
    text = "O governo anun-\n\nCN - 1º dia | Caderno 7 - AZUL - Página 9\n\nciou uma nova medida."
    assert repaired(spark, pages, text) == (1, 0, 1, "O governo anunciou uma nova medida.")


def test_no_damage(spark, pages):
    for text in ("QUESTÃO 12\nO governo\nA) uma\nB) nova", "— Você vem?\n— Já vou.", "H2O e B12 em 2020", "Meu rio\nde pedras\ncanta", "O governo anunciou [...]", "guarda-chuva e bem-te-vi"):
        assert repaired(spark, pages, text) is None


def test_scan_frame(spark):
    """The model comes from the frame; repeated rows give one row, nulls and empty frames none."""
    rows = [(i, PROSE) for i in range(80)] + [(900, PROSE.replace("medida", "medicla")), (900, PROSE.replace("medida", "medicla")), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("n_misread", F.lit("clash"))
    got = scans.repair_scans(df).collect()
    assert [(r.id, r.repaired) for r in got] == [(900, PROSE)]
    assert scans.repair_scans(df.limit(0)).count() == 0


# ---------------------------------------------------------------- levels

EASY = "o gato viu a bola e o cão foi para a casa do avô com a mãe e o pai "
PLAIN = "segundo a prefeitura muitas famílias mudaram a rotina por causa das chuvas na cidade nos últimos anos "
HARD = "a institucionalidade republicana problematiza epistemologicamente a intersubjetividade constitutiva das territorialidades contemporâneas "


def test_levels(spark):
    rows = [(f"{k}{i}", t * 6) for k, t in (("b", EASY), ("m", PLAIN), ("a", HARD)) for i in range(20)]
    rows += [("x", EASY * 3 + "fotossíntese rinocerontes"), ("s", "curto demais"), ("n", None), ("e", ""), ("u", "qwx " * 50), ("b0", EASY * 6)]
    got = {r.id: (r.level, r.n_words) for r in levels.reading_levels(spark.createDataFrame(rows, "id string, question_text string")).collect()}
    assert {got[f"b{i}"][0] for i in range(20)} == {"basico"}
    assert {got[f"m{i}"][0] for i in range(20)} == {"medio"}
    assert {got[f"a{i}"][0] for i in range(20)} == {"avancado"}
    assert got["x"][0] == "basico"
    assert got["s"] == (None, 2) and got["n"] == (None, 0) and got["e"] == (None, 0)
    assert len(got) == 65


def test_levels_empty(spark):
    assert levels.reading_levels(spark.createDataFrame([], "id string, question_text string")).count() == 0


def test_quantiles():
    rng = np.random.default_rng(1)
    grades = [rng.integers(0, 12, n).tolist() for n in (1, 2, 5, 80)]
    counts = np.array([np.bincount(g, minlength=12) for g in grades])
    assert np.allclose(levels.text_quantiles(counts), [np.quantile(g, levels.QUANTILES) for g in grades])


def test_first_grades():
    low, high = levels.SYLLABLE_BOUNDS
    assert levels.first_grade(np.array([0.5, low - 0.01, low, high - 0.01, high, 9.0])).tolist() == [0, 3, 4, 7, 8, 11]


# ---------------------------------------------------------------- languages

SAMPLES = {
    "pt": "A menina não quer sair de casa porque está chovendo muito. O irmão dela foi à padaria comprar pão e leite. As crianças brincam no quintal com os cães.",
    "es": "La niña no quiere salir de casa porque está lloviendo mucho. Su hermano fue a la panadería para comprar pan y leche. Los niños juegan en el patio con los perros.",
    "en": "The girl does not want to leave the house because it is raining. Her brother went to the bakery to buy bread and milk. The children play in the yard with the dogs.",
    "fr": "La fille ne veut pas sortir de la maison parce qu'il pleut beaucoup. Son frère est allé à la boulangerie pour acheter du pain. Les enfants jouent dans la cour avec les chiens.",
    "it": "La ragazza non vuole uscire di casa perché piove molto. Suo fratello è andato al forno per comprare il pane e il latte. I bambini giocano nel cortile con i cani.",
}


@pytest.fixture(scope="module")
def tongue():
    pairs = [(t, k) for k, t in SAMPLES.items()] * 3 + [(SAMPLES["es"], "pt"), (SAMPLES["en"], "it")]
    return languages.fit(pairs)


def test_codewords_are_apart():
    code = languages.codewords(5)
    assert code.shape == (5, 15)
    assert min((code[i] != code[j]).sum() for i in range(5) for j in range(i)) == 8


def test_held_out(tongue):
    for k, t in {"pt": "O leite das crianças está no quintal.", "es": "El pan está en el patio de la casa.", "en": "The milk is in the house.", "fr": "Le pain est dans la maison.", "it": "Il pane è nel cortile."}.items():
        assert languages.label_text(t, tongue)[0] == k


def test_passages(tongue):
    text = SAMPLES["pt"] + " “" + SAMPLES["en"] + "” " + SAMPLES["pt"]
    main, _, _, parts = languages.label_text(text, tongue)
    assert main == "pt" and [p["language"] for p in parts] == ["pt", "en", "pt"]
    assert parts[0]["start"] == 0 and parts[-1]["end"] == len(text) and all(a["end"] == b["start"] for a, b in zip(parts, parts[1:], strict=False))
    # A title is no passage.
    assert len(languages.label_text(SAMPLES["pt"] + " Ela leu «The Dogs and the Milk». " + SAMPLES["pt"], tongue)[3]) == 1


def test_language_frame(spark, tongue):
    rows = [(1, SAMPLES["pt"], "pt-BR"), (2, SAMPLES["pt"], "es"), (3, SAMPLES["es"], None), (4, None, "pt"), (5, "", "pt"), (6, "123", "??"), (7, SAMPLES["fr"], "FRA"), (8, SAMPLES["pt"] + " " + SAMPLES["pt"] + "\n" + SAMPLES["it"], "por")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("clash"))
    labelled = languages.label_languages(df, model=tongue)
    assert {r.id: r.language for r in labelled.collect()} == {1: "pt", 2: "pt", 3: "es", 4: None, 5: None, 6: None, 7: "fr", 8: "pt"}
    assert {(r.id, r.language) for r in languages.mislabelled(labelled).collect()} == {(2, "pt"), (3, "es"), (8, "pt"), (8, "it")}
    assert languages.label_languages(df.limit(0)).count() == 0


def test_label_spellings(spark):
    spelt = {"pt": "pt", "PT_br": "pt", " por": "pt", "Español": "es", "en-US": "en", "fra": "fr", "IT": "it", "gl": None, "??": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in spelt], "x string")
    assert {r.x: r.y for r in df.select("x", languages.label_language("x").alias("y")).collect()} == spelt


# ---------------------------------------------------------------- survivors


def test_survivors(spark, codes, pages):
    full, t = PROSE, [datetime(2020, 1, d) for d in range(1, 9)]
    rows = [
        ("a", "g", full[:60], Decimal("0.999"), True, t[0], 1),  # cut off
        ("b", "g", full.replace("população", "populaÃ§Ã£o"), Decimal("0.998"), None, t[7], 1),  # garbled
        ("c", "g", full.replace("medida", "meclida"), Decimal("0.997"), None, t[6], 1),  # misread
        ("d", "g", full, Decimal("0.500"), False, t[1], 1),
        ("e", "g", full.replace(" ", "\n", 1), Decimal("0.600"), None, t[2], 1),  # only wrapped
        ("f", "g", full, None, True, t[5], 1),
        ("h", "h", full, None, None, t[0], 1),
        ("i", "h", full, None, None, t[0], 1),
        ("j", "one", full, None, None, t[0], 1),
        ("j", "one", full, None, None, t[0], 1),  # delivered twice
        ("k", None, full, None, None, t[0], 1),
        ("l", "e", None, None, None, None, 1),
        ("m", "e", "[Enunciado não encontrado]", None, None, None, 1),
        ("n", "e", full, Decimal("0.1"), None, None, 1),
    ]
    schema = "id string, content_hash string, question_text string, parsing_confidence decimal(4,3), has_images boolean, updated_at timestamp_ntz, n_rows int"
    df = spark.createDataFrame(rows, schema)
    words = encoding.vocabulary(df.where("question_text <> ''").select(F.col("question_text").alias("text")))
    found = survivors.surviving_questions(df, codes, words, pages)
    got = {r.content_hash: (r.text_from, r.confidence_from, r.images_from) for r in found.collect()}
    assert got == {"g": ("e", "a", "f"), "h": ("h", "h", "h"), "e": ("n", "n", "l")}
    values = {r.content_hash: (r.parsing_confidence, r.has_images) for r in survivors.surviving_records(df, found).collect()}
    assert values["g"] == (Decimal("0.999"), True)
    assert survivors.surviving_questions(df.limit(0), codes, words, pages).count() == 0


def test_smallest_id_of_any_length(spark):
    df = spark.createDataFrame([("ab", "g"), ("a", "g"), ("b", "g"), ("ábc", "g")], "id string, k string")
    assert survivors.survivors(df, "k", "id", {"x": [F.lit(1)]}).first().x_from == "a"


RARE = ["o modernismo nasceu", "a coluna clara caiu"]
NOISY = [("m", "vimos que o modemismo nasceu tarde"), ("n", "vimos a coluna elara caiu tarde"), ("h", "um texto\nGRANDE PROVA FINAL 7\nde duas linhas"), ("g", "o nada")]


def test_full_filter(spark):
    """The filter only saves work: with one that lets everything pass the same damage is found."""
    rows = [(f"a{i}", f"{PROSE} {RARE[i % 2]} hoje.\nGRANDE PROVA FINAL 12\nfim do texto aqui") for i in range(40)]
    df = spark.createDataFrame([*rows, *NOISY], "id string, text string")
    read = lambda facts: {r.id: (r.n_divided, r.n_misread, r.n_headers, r.repaired) for r in scans.repair_scans(df, facts).collect()}
    whole = read(None)
    assert {"m", "n", "h"} <= set(whole) and whole["m"][3] == "vimos que o modernismo nasceu tarde"
    assert read(scans.learn(df.select("text"), 64)) == whole


def test_large_vocabulary(spark):
    """Among 300,000 other words, all used more often than it, a rare word stays, and a header of three uses is found."""
    some = ["".join("bcdfgjklmnprstvx"[(i >> 4 * k) & 15] + "aeiouaei"[(i >> k) & 7] for k in range(5)) for i in range(300_000)]
    rows = [(f"v{i}", " ".join(some[i : i + 300] * 2)) for i in range(0, len(some), 300)]
    rows += [(f"a{i}", f"{PROSE} {RARE[i % 2]} hoje.") for i in range(40)] + [(f"h{i}", f"texto {i}\nRARO CADERNO {i}\nde linhas") for i in range(3)]
    rows += [("ok", "vimos o modernista nascer"), *NOISY[:2]]
    got = {r.id: r.n_headers for r in scans.repair_scans(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"m": 0, "n": 0, "h0": 1, "h1": 1, "h2": 1}
