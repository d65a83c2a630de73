"""Ranking, search, mining and stream operators against brute force on small frames."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvina.functions.tokens import first_tokens
from corvina.operators import mining, ranking, search, skew
from corvina.operators import records as recs
from corvina.sources.tables import read_documents_dir
from corvina.streaming import ingest


def test_gaps(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("a", 7), ("b", 99), ("c", 1), ("c", 10), ("a", 2)], "g string, n int")
    got = sorted(tuple(r) for r in ranking.gaps(df, ["g"], "n", 1, 10).collect())
    assert got == [("a", 1, 1), ("a", 4, 6), ("a", 8, 10), ("b", 1, 10), ("c", 2, 9)]


def test_page_past_the_end_keeps_total(spark):
    df = spark.range(25)
    rows = ranking.page(df, [F.col("id")], 3, 10).collect()
    assert [r.id for r in rows] == [20, 21, 22, 23, 24] and rows[0].total_rows == 25 and rows[0].total_pages == 3 and not rows[0].has_next and rows[0].has_prev
    assert ranking.page(df, [F.col("id")], 9, 10).collect() == []


def test_interval_join_and_boxes(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 100)) for i in range(200)]
    ranges = [(i, a := rng.uniform(0, 90), a + rng.uniform(0, 30)) for i in range(40)]
    got = ranking.interval_join(spark.createDataFrame(points, "p int, v double"), "v", spark.createDataFrame(ranges, "r int, lo double, hi double"), "lo", "hi", 10.0)
    assert {(x.p, x.r) for x in got.collect()} == {(p, r) for p, v in points for r, a, b in ranges if a <= v <= b}
    boxes = [(rng.choice("xy"), i, a := rng.uniform(0, 50), b := rng.uniform(0, 50), a + rng.uniform(1, 20), b + rng.uniform(1, 20)) for i in range(60)]
    df = spark.createDataFrame(boxes, "page string, id int, x0 double, y0 double, x1 double, y1 double")
    pairs = [(r.left_id, r.right_id) for r in ranking.overlapping_boxes(df, df, "page", 7.0).collect()]
    want = [(p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]]
    assert sorted(pairs) == sorted(want)


def test_equal_boxes_are_compared_once(spark):
    boxes = [("x", i, float(i % 3 * 4), 0.0, float(i % 3 * 4 + 5), 9.0) for i in range(300)] + [("x", None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "page string, id int, x0 double, y0 double, x1 double, y1 double")
    pairs = ranking.overlapping_boxes(df, df, "page", 7.0)
    want = [(p[1], q[1]) for p in boxes for q in boxes if p[2] < q[4] and q[2] < p[4]]
    assert Counter((r.left_id, r.right_id) for r in pairs.collect()) == Counter(want)

    def joined(node) -> list[int]:
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
        return own + [n for x in below for n in joined(x)]

    assert joined(pairs._jdf.queryExecution().executedPlan()) == [10]  # four different boxes with themselves, and three neighbours both ways


def test_canonical_rows_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", "g", None), ("b", "g", 0.5), ("c", "g", 0.5), ("d", "h", None), ("e", "h", None)], "id string, g string, s double")
    got = {r.id: (r.canonical_id, r.group_size) for r in ranking.canonical_rows(df, "g", "s", "id").collect()}
    assert got == {"a": ("b", 3), "b": ("b", 3), "c": ("b", 3), "d": ("d", 2), "e": ("d", 2)}


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    state = {r.k: (r.v, r.is_new) for r in ranking.upsert(old, new, ["k"], [F.desc("t")]).collect()}
    assert state == {1: ("a", False), 2: ("d", False), 3: ("e", True)}
    assert {r.k: r.v for r in ranking.keep_best(old, new, ["k"], "t").collect()} == {1: "a", 2: "d", 3: "e"}
    assert [r.k for r in ranking.append_once(old, new, "k", [F.col("t")]).collect()] == [3]
    done = ranking.mark_done(old.withColumn("s", F.lit("pending")), new.select("k"), "k", "s", "pending", "resolved")
    assert {r.k: r.s for r in done.collect()} == {1: "pending", 2: "resolved"}


def test_null_keys(spark):
    """Null is a key like others: it is replaced, and appended once only."""
    schema = "k int, j string, t int"
    old = spark.createDataFrame([(None, "a", 1), (1, None, 1), (1, "b", 1)], schema)
    new = spark.createDataFrame([(None, "a", 2), (1, None, 2), (None, None, 2)], schema)
    state = {(r.k, r.j): (r.t, r.is_new) for r in ranking.upsert(old, new, ["k", "j"], [F.desc("t")]).collect()}
    assert state == {(None, "a"): (2, False), (1, None): (2, False), (1, "b"): (1, False), (None, None): (2, True)}
    assert ranking.append_once(old, new, "k", [F.col("t")]).count() == 0
    assert [(r.k, r.t) for r in ranking.append_once(old.where("k = 1"), new, "k", [F.col("t"), F.col("j")]).collect()] == [(None, 2)]
    assert ranking.upsert(old.limit(0), new.limit(0), ["k"], [F.desc("t")]).count() == 0


def test_second_attempts_and_queue(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, None)], "k int, s double")
    new = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.85), (4, 0.8), (5, None)], "k int, s double")
    got = {r.k: r.decision for r in ranking.accept_better(old, new, "k", "s").collect()}
    assert got == {1: "persist", 2: "dead_letter", 3: "persist", 4: "dead_letter", 5: "dead_letter"}
    failed = spark.createDataFrame([(1, "t", ["a", "b"]), (1, "t", ["a", "b"]), (2, "u", []), (3, None, ["c"]), (None, "n", None)], "k int, text string, options array<string>")
    queue = spark.createDataFrame([(2,)], "k int")
    rows = {r.k: (r.raw_text, r.status) for r in ranking.enqueue(failed, "text", "options", ["k"], queue).collect()}
    assert rows == {1: ("t\na\nb", "pending"), 3: ("c", "pending"), None: ("n", "pending")}


def test_hot_keys(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k")).withColumn("x", F.lit(1))
    table = rows.where("k <> 'k5'").groupBy("k").agg(F.max("id").alias("m"))
    assert [r.k for r in skew.hot_keys(rows, "k").collect()] == ["hot"]
    for how in ("inner", "left"):
        want = rows.join(table, "k", how)
        assert sorted(map(str, skew.meet(rows, table, "k", how).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert skew.meet(rows.limit(0), table, "k").count() == 0


def test_budget(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(5)], "i int, c double")
    assert [r.i for r in ranking.running_budget(df, [F.col("i")], "c", 9.0).collect()] == [0, 1, 2]
    many = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("c")).repartition(6)
    want, spent = [], 0.0
    for i in range(2000):
        spent += i % 7
        want += [(i, spent)] if spent <= 1000 else []
    assert sorted((r.id, r.spent) for r in ranking.running_budget(many, [F.col("id")], "c", 1000.0).collect()) == want
    assert ranking.running_budget(df.limit(0), [F.col("i")], "c", 9.0).count() == 0


def test_fusion_values(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "id int, rank int")
    got = {r.id: r.score for r in search.fuse(ranks([(1, 1), (2, 2)]), ranks([(2, 1), (1, 2)]), "id", 30, 10).collect()}
    expected = round((1 / 61 + 1 / 62) / (2 / 61), 6)
    assert got == {1: expected, 2: expected}
    assert search.fuse(ranks([(7, 1)]), ranks([(7, 1)]), "id", 30, 10).first().score == 1.0
    assert [r.id for r in search.fuse(ranks([(1, 1), (2, 2)]), ranks([]), "id", 30, 10).collect()] == [1, 2]
    assert search.fuse(ranks([(1, 1), (2, 2)]), ranks([(2, 1), (3, 2)]), "id", 30, 10).first().id == 2


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [1.0, 1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = [(r.id, round(r.similarity, 6)) for r in search.vector_top_k(df, "id", "v", [1.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (5, 1.0), (6, round(math.sqrt(0.5), 6))]
    per = search.vector_top_k(df.withColumn("g", F.col("id") % 2), "id", "v", [1.0, 0.0], 5, one_per="g").collect()
    assert [(r.g, r.id) for r in per] == [(1, 1), (0, 6)]


def test_text_search(spark):
    df = spark.createDataFrame([(1, "Água e energia"), (2, "agua"), (3, None), (4, "energia energia água")], "id int, t string")
    assert [r.id for r in search.text_top_k(df, "id", "t", ["agua", "energia"], 5).collect()] == [4, 1]


@pytest.mark.parametrize("paired", [400, 8, 1])
def test_word_sets(spark, monkeypatch, paired):
    monkeypatch.setattr(search, "PAIRED_WORDS", paired)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.sample(words, rng.randint(3, 12)))) for i in range(120)]
    texts += [(200 + i, t + (" w1" if i % 2 else "")) for i, t in texts[:60]]
    df = spark.createDataFrame([*texts, (999, None), (998, "")], "id int, t string")
    got = {(r.id_a, r.id_b) for r in search.word_set_classes(df, "id", "t", 0.8).collect()}
    first: dict = {}
    for i, t in sorted(texts):
        first.setdefault(frozenset(t.split()), i)
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.8}
    assert got == want
    members = {r.id: r.representative for r in search.word_set_members(df, "id", "t").collect()}
    assert members == {i: first[frozenset(t.split())] for i, t in texts}


def test_word_sets_of_few_words(spark):
    """At 0.5 sets that share one word only count, too."""
    rng = random.Random(9)
    texts = [(i, " ".join(rng.sample("abcdefgh", rng.randint(1, 4)))) for i in range(80)]
    df = spark.createDataFrame(texts, "id int, t string")
    first: dict = {}
    for i, t in texts:
        first.setdefault(frozenset(t.split()), i)
    got = {(r.id_a, r.id_b): r.similarity for r in search.word_set_classes(df, "id", "t", 0.5).collect()}
    assert got == {(i, j): len(a & b) / len(a | b) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.5}
    assert search.word_set_classes(df.limit(0), "id", "t", 0.5).count() == 0 and search.word_set_members(df.limit(0), "id", "t").count() == 0


def test_word_sets_of_like_phrases_write_little(spark):
    """Texts made of the same few phrases share rare words in millions of pairs, which are not to be written down."""
    rng = random.Random(11)
    phrases = [[f"p{i}w{j}" for j in range(6)] for i in range(60)]
    texts = [(i, " ".join(w for p in rng.sample(phrases, 10) for w in [*p, f"n{rng.randrange(300)}"])) for i in range(1500)]
    texts += [(2000 + i, t + " extra") for i, t in texts[:30]]
    store = spark.sparkContext._jsc.sc()

    def written() -> int:
        store.listenerBus().waitUntilEmpty()
        return store.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    got = {(r.id_a, r.id_b) for r in search.word_set_classes(spark.createDataFrame(texts, "id int, t string"), "id", "t", 0.8).collect()}
    sets = {i: set(t.split()) for i, t in texts}
    assert {(i, 2000 + i) for i in range(30)} <= got
    assert all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for i, j in got)
    assert written() - before < 10 * sum(len(t) for _, t in texts)


def test_filtered_search(spark):
    rows = [(1, "q1", "full", "Artes", 2020, [1.0, 0.0]), (2, "q1", "full", "artes", 2021, [1.0, 0.1]), (3, "q2", "context", "ARTES", 2021, [0.5, 0.5]), (4, "q3", "full", None, 2021, [0.9, 0.0]), (5, "q4", "full", "artes", 2021, None)]
    df = spark.createDataFrame(rows, "id int, question_id string, chunk_type string, subject string, year int, embedding array<double>")
    ids = lambda **f: [r.id for r in search.filtered_vectors(df, [1.0, 0.0], 9, **f).orderBy(F.desc("similarity"), "id").collect()]
    assert ids() == [1, 4, 3] and ids(subject="aRTES", chunk_type="full") == [1] and ids(year=2021, subject="artes") == [2, 3] and ids(chunk_type="none") == []


# ---------------------------------------------------------------- whole records


def test_option_lines_and_chunks(spark):
    rows = [(1, "Texto", ["A) um", "dois", None, "b)x", "e", "f"], "ctx"), (2, None, None, " \n"), (3, "", [], None)]
    df = spark.createDataFrame(rows, "id int, t string, o array<string>, c string")
    got = {(r.id, r.chunk_type): r for r in recs.build_chunks(df, "id", "t", "o", "c", lambda c: first_tokens(c, 4)).collect()}
    assert set(got) == {(1, "full"), (1, "context"), (2, "full"), (3, "full")}
    whole = "[ENUNCIADO] Texto\nA) um\nB) dois\nC) \nb)x\nE) e\n5) f"
    assert got[1, "full"].content_hash == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1, "full"].token_count == 4 and whole.startswith(got[1, "full"].content) and got[1, "context"].content == "ctx"
    assert {r.content for r in recs.build_chunks(df, "id", "t", "o", "c").where("id > 1").collect()} == {"[ENUNCIADO] "}
    named = spark.createDataFrame([(1, [("b", "x"), (None, "y")])], "id int, o array<struct<letter:string,text:string>>")
    assert named.select(recs.option_lines(named, "o").alias("x")).first().x == ["B) x", "B) y"]


def test_bundles(spark):
    q = spark.createDataFrame([("q1", "e", 1), ("q2", "e", 2), ("q3", None, None)], "id string, exam_metadata_id string, question_number int")
    o = spark.createDataFrame([("1", "q1", "B", "b", 2), ("2", "q1", "A", "a", 1), ("3", "none", "A", "a", 1)], "id string, question_id string, alternative_letter string, alternative_text string, alternative_order int")
    k = spark.createDataFrame([("e", 1, "B"), ("e", 1, "C"), ("x", 2, "A")], "exam_metadata_id string, question_number int, correct_answer string")
    got = {r.id: r for r in recs.bundles(q, o, k).collect()}
    assert [tuple(x) for x in got["q1"].options] == [("A", "a", False), ("B", "b", True)] and got["q1"].n_keys == 2
    assert got["q2"].options == [] and got["q2"].n_keys == 0 and got["q3"].correct_answer is None


def test_phases(spark):
    extracted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "number int, text string")
    verdicts = spark.createDataFrame([(1, 0.2, "slow"), (2, 0.8, None)], "number int, confidence double, error string")
    repairs = spark.createDataFrame([(2, "B"), (3, None)], "number int, text string")
    detected = spark.createDataFrame([(3, "x", 0.9), (4, "y", 0.41), (5, "z", 0.4)], "number int, text string, confidence double")
    out = recs.combine_phases(extracted, verdicts, repairs, detected)
    got = {r.number: (r.text, r.phase, round(r.confidence, 6), r.validation_error, r.repair_failed) for r in out.collect()}
    assert got == {1: ("a", "validated", 0.2, True, False), 2: ("B", "repaired", 0.9, False, False), 3: ("c", "extracted", 0.5, False, True), 4: ("y", "detected", 0.41, False, False)}
    assert {(r.number, r.issue) for r in recs.issue_lines(out).collect()} == {(1, "Validation error"), (1, "Low confidence score"), (3, "Repair failed"), (4, "Low confidence score")}
    assert recs.confidence_map(out.withColumn("g", F.lit("x")), "g").first().confidences[2] == pytest.approx(0.9)
    answers = [("p1", 'sure: {"missing_questions": [{"estimated_number": 9, "alternatives": ["a","b","c","d","e"], "confidence": 0.8}, {"alternatives": ["a"]}]} ok'), ("p2", "none"), ("p3", None), ("p4", "{broken")]
    found = recs.parse_candidates(spark.createDataFrame(answers, "at string, r string"), "r", "at").collect()
    assert [(r.number, r.confidence, r.location, r.method) for r in found] == [(9, 0.8, "p1 - ", "ai_detection")]


def test_golden_metrics(spark):
    golden = spark.createDataFrame([(1, "abcd", "m", 1), (2, "abcd", "m", 2), (3, "", "n", 3), (4, None, "n", 4)], "k int, t string, s string, n int")
    got = spark.createDataFrame([(1, "abcx", 1), (3, "zz", 9), (4, None, 4)], "k int, t string, n int")
    out = {r.s: r for r in mining.golden_metrics(got, golden, ["k"], "t", "s", "n").collect()}
    assert (out["m"].n_golden, out["m"].n_found, out["m"].completeness, out["m"].error_rate, out["m"].n_accuracy) == (2, 1, 0.5, 0.25, 1.0)
    assert (out["n"].error_rate, out["n"].n_accuracy) == (0.5, 0.5)


def test_forest(spark, tmp_path):
    df = spark.createDataFrame([(i, "gato preto dorme" if i % 4 else "sol forte brilha", "a" if i % 4 else "b") for i in range(60)], "id int, t string, y string")
    training, test = mining.split_rows(df, "id", 0.3)
    assert training.count() + test.count() == 60 and 5 < test.count() < 35
    model = mining.train_classifier(training, "y", "t", "rf", pairs=True, balanced=True)
    mining.save_model(model, str(tmp_path / "m"))
    rows = mining.predict_labels(df, mining.load_model(str(tmp_path / "m")), "id", "t").join(df, "id").collect()
    assert all(r.predicted == r.y and r.probabilities[r.y] > 0.5 and abs(sum(r.probabilities.values()) - 1) < 1e-6 for r in rows)
    terms = {r.term for r in mining.term_importances(model, spark).collect()}
    assert terms & {"gato preto", "preto dorme", "sol forte", "forte brilha"}
    assert mining.predict_labels(df, mining.train_classifier(df, "y", "t", "svm"), "id", "t").first().probabilities is None


def test_require_rows(spark):
    assert search.require_rows(spark.range(3), 3).count() == 3
    with pytest.raises(Exception, match="fewer than 4 rows"):
        search.require_rows(spark.range(3), 4).collect()


def test_mining(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", ["x"]), ("b", [])], "m string, issues array<string>")
    got = {(r.issue, r.dimension, r.value, r.n) for r in mining.audit_counts(df, "issues", "m").collect()}
    assert got == {("x", "all", None, 3), ("y", "all", None, 1), ("x", "m", "a", 2), ("x", "m", "b", 1), ("y", "m", "a", 1)}
    counted = {r.value: (r.n, r.is_mode) for r in mining.value_counts(df.select("m"), "m").collect()}
    assert counted == {"a": (2, True), "b": (2, False)}
    rates = {r.name: (r.value, r.verdict) for r in mining.rate_checks(df, {"a": (F.col("m") == "a", 40.0), "b": (F.col("m") == "z", 1.0)}).collect()}
    assert rates == {"a": (50.0, "PASS"), "b": (0.0, "FAIL")}


def test_classifier_and_clusters(spark):
    rows = [(i, ["gato cão vaca", "soma razão litros"][i % 2] + f" t{i % 5}", ["bichos", "contas"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, y string")
    model = mining.train_classifier(df, "y", "t", "nb")
    right = mining.predict_labels(df, model, "id", "t").join(df, "id").where("predicted = y").count()
    assert right == 60
    assigned, tops = mining.cluster_texts(df, "id", "t", k=2)
    assert assigned.count() == 60 and tops.agg(F.sum("size")).first()[0] == 60


def test_streams(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).selectExpr("id as event_id", "id % 10 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts", "'t' as event_type", "1.0 as value", "id % 3 as user_id")
    rows.repartition(4).write.parquet(src)
    total = ingest.drained(ingest.type_totals(ingest.event_stream(spark, src)), "complete").first()
    assert (total.n, total.total) == (40, 40.0)
    for run in range(2):  # a second run with a new checkpoint adds nothing
        ingest.append_new(ingest.event_stream(spark, src, 1), dst, "k", [F.col("event_id")], str(tmp_path / f"c{run}")).awaitTermination()
        assert sorted(r.k for r in spark.read.parquet(dst).collect()) == list(range(10))
    seen = ingest.drained(ingest.first_seen(ingest.event_stream(spark, src), ["k"], "ts", "2 hours"))
    assert seen.count() == 10
    assert ingest.drained(ingest.sessions(ingest.event_stream(spark, src)), "append") is not None


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {r.file_name: r.is_pdf for r in read_documents_dir(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}


def test_windows_over_several_batches(spark, tmp_path):
    """Each window has one row with all its events, also those that come batches later."""
    path = str(tmp_path / "events.parquet")
    for i in range(9):  # files in falling time, so most rows are late
        rows = [(f"2024-01-01 {9 - i:02d}:{m:02d}:00", "ab"[m % 2]) for m in (1, 20, 40)] + [("2024-01-01 12:30:00", "a")]
        spark.createDataFrame(rows, "ts string, event_type string").coalesce(1).write.mode("append").parquet(path)
    got = ingest.windowed_counts(spark, path)
    want = spark.read.parquet(path).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
