"""Sinks, links and cached vectors."""

import json

import pytest
from pyspark.sql import functions as F

from corvina.operators import embedding, ranking
from corvina.sources import links, sinks
from corvina.sources.tables import path_kind, read_exam_files


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(3, "b")], "v int, k string"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, t string")
    out = tmp_path / "r"
    assert sinks.write_report(df, str(out)) == 2 and json.loads(out.read_text()) == [{"i": 1, "t": "a|b"}, {"i": 2, "t": None}]
    sinks.write_report(df, str(out), "markdown", "T")
    assert out.read_text() == "# T\n\n| i | t |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |\n"
    sinks.write_report(df, str(out), "html", "<T>")
    assert "&lt;T&gt;" in out.read_text()
    with pytest.raises(ValueError, match="more than"):
        sinks.write_report(spark.range(sinks.MAX_REPORT_ROWS + 1), str(out))
    sinks.replace_table(df, str(tmp_path / "t"))
    sinks.replace_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.dump_tables({"x": df}, str(tmp_path / "d"), "json")
    assert spark.read.json(str(tmp_path / "d/x")).count() == 2


def test_links(spark):
    page = "<a href='/p/2020_PV_enem_azul.pdf'>x</a> <A class=c HREF=\"prova2.pdf\">y</a><a href='http://h/gabarito.pdf'>z</a><a href='x.html'>n</a><a href='outra.pdf'>n</a>"
    df = spark.createDataFrame([("https://s.org/d/i.html", page), ("https://s.org/e", None)], "url string, html string")
    got = {r.link for r in links.page_links(df, "url", "html").collect()}
    assert got == {"https://s.org/p/2020_PV_enem_azul.pdf", "https://s.org/d/prova2.pdf", "http://h/gabarito.pdf"}
    c = spark.createDataFrame([("x/2020_PV_Azul.pdf",), ("1999/gabarito.pdf",)], "u string").select(links.link_category("u").alias("c")).collect()
    assert [tuple(r.c) for r in c] == [(2020, "booklet", "azul"), (None, "key", None)]


def test_expected_files(spark):
    expected = links.expected_files(spark, (2020,))
    assert expected.count() == 16
    there = spark.createDataFrame([("2020_PV_impresso_D1_CD1.pdf", True), ("2020_GB_impresso_D1_CD1.pdf", False)], "file_name string, is_pdf boolean")
    assert tuple(links.file_status(expected, there).first()) == (2020, 16, 1, 1)


def test_cached_vectors(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("c", "bad")], "content_hash string, content string")
    cache = spark.createDataFrame([("a", [9.0])], "content_hash string, embedding array<float>")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    got = {r.content_hash: (r.embedding, r.from_cache) for r in embedding.embed_missing(chunks, cache, model, batch=1).collect()}
    assert got == {"a": ([9.0], True), "b": ([1.0], False), "c": (None, False)}


def test_hashed_vectors(spark):
    v = spark.createDataFrame([("x",), ("x",), (None,)], "t string").select(embedding.hashed_vector("t", 8).alias("v")).collect()
    assert v[0].v == v[1].v and len(v[2].v) == 8 and all(-1 <= x <= 1 for r in v for x in r.v)


def test_vector_cache(spark):
    """Old vectors count as not there, chunks that are too large are not sent, and a failing model says why."""
    chunks = spark.createDataFrame([("a", "x", 5), ("b", "y", 5), ("c", "z", 9000), ("d", "bad", 5)], "content_hash string, content string, n int")
    cache = spark.sql("SELECT 'a' AS content_hash, array(9.0f) AS embedding, current_timestamp() AS t UNION ALL SELECT 'b', array(8.0f), current_timestamp() - INTERVAL 30 DAYS")

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0] for _ in texts]

    got = {r.content_hash: (r.embedding, r.from_cache, r.error) for r in embedding.embed_missing(chunks, cache, model, batch=1, tokens="n", made_at="t").collect()}
    assert got == {"a": ([9.0], True, None), "b": ([1.0], False, None), "c": (None, False, "more than 8192 tokens"), "d": (None, False, "ValueError: no")}


def test_path_kind(spark, tmp_path):
    """What is at a path is asked of the path's own file system, so addresses with a scheme work, too."""
    (tmp_path / "f").write_text("x")
    assert [path_kind(spark, p) for p in (f"file://{tmp_path}", str(tmp_path / "f"), f"file://{tmp_path}/none")] == ["folder", "file", None]


def test_exam_files(spark, tmp_path):
    for name in ("2023/2023_PV_b.pdf", "2023/2023_GB_a.pdf", "2022/2022_PV_a.pdf", "2023/2023_PV_a.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    names = lambda *a: [r.file_name for r in read_exam_files(spark, str(tmp_path), *a).collect()]
    assert names("PV", 2023) == ["2023_PV_a.pdf", "2023_PV_b.pdf"] and names("GB") == ["2023_GB_a.pdf"]


def test_bounded_sample(spark):
    df = spark.range(5000).withColumn("t", F.lit("x"))
    got = ranking.bounded_sample(df, "id", 100).collect()
    assert len(got) == 100 and got == ranking.bounded_sample(df.repartition(7), "id", 100).collect()
    assert ranking.bounded_sample(df, "id", 9000).count() == 5000
    assert ranking.bounded_sample(df.limit(0), "id", 10).count() == 0
