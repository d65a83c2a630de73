"""Splitting, packing, mixing and neighbours: round trips, bounds and brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvina.llm import mixing, neighbours, packing, splitting
from corvina.functions.tokens import count, token_count

WORDS = "casa água coração número está bem-te-vi Rio 2020 fim.\n então, talvez; não\n\n".split(" ")


def long_text(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- tokens


def test_token_counts(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,), ("ação",)], "t string")
    assert [r.n for r in df.select(token_count("t").alias("n")).collect()] == [3, 0, None, count("ação")]


# ---------------------------------------------------------------- splitting


def pieces(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").withColumn("n_pieces", F.lit("clash"))
    out = {}
    for r in splitting.split_oversized(df, **kw).orderBy("id", "piece_no").collect():
        out.setdefault(r.id, []).append(r)
    return out


def check(text, rows, limit, overlap):
    assert "".join(r.piece[r.overlap_chars :] for r in rows) == text
    assert [r.piece_no for r in rows] == list(range(1, rows[0].n_pieces + 1))
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.piece.endswith(b.piece[: b.overlap_chars])
        if overlap:
            assert overlap // 2 <= count(b.piece[: b.overlap_chars]) <= overlap + 8
    assert all(count(r.piece) <= limit for r in rows)


def test_round_trip(spark):
    texts = [long_text(700), long_text(3000, 1), "x" * 5000, "çãé" * 2000, "日本語テキスト" * 600, " " * 9000 + "fim", "\n".join(["linha"] * 900), "😀" * 900]
    got = pieces(spark, texts, limit=200, overlap=20)
    for i, text in enumerate(texts):
        if count(text) > 200:
            check(text, got[i], 200, 0)
    check(texts[0], got[0], 200, 20)


def test_no_pieces(spark):
    assert pieces(spark, [None, "", "curto", "a " * 100], limit=200, overlap=20) == {}
    df = spark.createDataFrame([], "id int, content string")
    assert splitting.split_oversized(df).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_oversized(df, limit=100, overlap=95)


def test_repeated_rows_and_no_overlap(spark):
    text = long_text(800, 3)
    df = spark.createDataFrame([("k", text), ("k", text)], "id string, content string")
    rows = splitting.split_oversized(df, limit=300, overlap=0).orderBy("piece_no").collect()
    check(text, rows, 300, 0)
    assert all(r.overlap_chars == 0 for r in rows)


def test_cuts_at_paragraphs(spark):
    text = ("Uma frase curta aqui. " * 12 + "\n\n") * 10
    for r in pieces(spark, [text], limit=150, overlap=0)[0][:-1]:
        assert r.piece.endswith("\n\n")


@settings(max_examples=40, deadline=None)
@given(st.text(min_size=1, max_size=400))
def test_shapes_reach_the_end(text):
    from corvina.functions.tokens import DEFAULT_TOKENIZER, encoder

    tokens = np.array(encoder(DEFAULT_TOKENIZER).encode_ordinary(text))
    shape, ends = splitting.skeleton(text, tokens, DEFAULT_TOKENIZER)
    assert len(shape) == len(tokens) == len(ends) and ends[-1] == len(text) and shape[-1] != "z"


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_sum_of_squares_is_greedy(sizes):
    """Each item goes where the sum of squares over all levels grows least, as a search over all levels finds."""
    bins, level, held = packing.SumOfSquares(50), {}, {}
    for size in sizes:
        counts = np.bincount([v for v in level.values() if v < 50], minlength=51)

        def after(h, counts=counts, size=size):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 50:
                c[h + size] += 1
            return int((c[1:50] ** 2).sum())

        choices = [0, *[h for h in range(1, 51 - size) if counts[h]]]
        number = bins.place(size)
        assert after(level.get(number, 0)) == min(map(after, choices))
        level[number] = level.get(number, 0) + size
        held.setdefault(number, []).append(size)
    assert all(sum(v) <= 50 for v in held.values())


def test_packing(spark):
    rng = random.Random(1)
    texts = [long_text(rng.randint(1, 260), i) for i in range(300)] + ["", None, long_text(1500, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fill", F.lit("clash"))
    packed = packing.pack_texts(df.union(df.limit(5)), capacity=512, partitions=2)
    rows = packed.collect()
    assert {r.id for r in rows} == set(range(303)) and len({(r.id, r.part_no) for r in rows}) == len(rows)
    held: dict = {}
    for r in rows:
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
    assert max(held.values()) <= 512
    sizes = {i: count(t) or 0 for i, t in enumerate(texts)}
    assert all(sum(r.n_tokens for r in rows if r.id == i) == n for i, n in sizes.items())
    assert {r.id for r in rows if r.n_parts > 1} == {i for i, n in sizes.items() if n > 512}
    assert {r.id for r in rows if r.container_id is None} == {300, 301}
    # No packing needs fewer containers than the total or the items above half a container call for.
    least = max(-(-sum(held.values()) // 512), sum(r.n_tokens > 256 for r in rows))
    assert len(held) <= 1.1 * least + 2
    assert sorted(map(tuple, packing.pack_texts(df.union(df.limit(5)), capacity=512, partitions=2).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert packing.container_fill(packed, 512).agg(F.max("fill")).first()[0] <= 1
    assert packing.pack_texts(df.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7))
def test_pfair_deviation(shares):
    """At any slot each source has had its share of the slots to within less than one block, and its parts at the end of the period."""
    parts = {f"s{i}": x for i, x in enumerate(shares)}
    plan = mixing.pfair_period(parts)
    assert [slot for _, _, slot in plan] == list(range(sum(shares)))
    assert sorted((s, j) for s, j, _ in plan) == sorted((s, j) for s in parts for j in range(parts[s]))
    had = dict.fromkeys(parts, 0)
    for s, _, slot in plan:
        had[s] += 1
        assert all(abs(had[x] - Fraction(parts[x], sum(shares)) * (slot + 1)) < 1 for x in had)


def test_parts():
    assert mixing.parts_of({"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.0}) == {"a": 3, "b": 4, "c": 2}
    parts = mixing.parts_of({"a": 1 / 3, "b": 2 / 3 - 1e-9, "c": 1e-9})
    assert parts["c"] == 1 and abs(parts["a"] / sum(parts.values()) - 1 / 3) < 2e-5
    assert mixing.parts_of({}) == {} and mixing.parts_of({"a": 30.0, "b": 70.0}) == {"a": 3, "b": 7}
    assert sum(mixing.parts_of({"a": 33.33333, "b": 66.66661}).values()) <= mixing.PERIOD + 2


def mix_frames(spark):
    rng = random.Random(4)
    rows = [(i, long_text(rng.randint(20, 60), i), rng.choice(["a", " A ", "a", "a", "b", "c"])) for i in range(900)]
    rows += [(2000, "x", None), (2001, None, "a"), (2002, "", "a"), (2003, "y", "other"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("C", 0.2, 3), ("gone", 0.1, 9)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix(spark):
    docs, targets = mix_frames(spark)
    mix = mixing.Mix(docs, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["gone"].actual_share == 0 and shares["gone"].available_tokens == 0
    for s, w in (("a", 3 / 9), ("b", 4 / 9), ("c", 2 / 9)):
        assert abs(shares[s].aimed_share - w) < 1e-9 and abs(shares[s].actual_share - w) < 0.002
        assert shares[s].most_copies <= shares[s].max_repeats
    rows = mix.rows().orderBy("position", "id").collect()
    uses: dict = {}
    for r in rows:
        uses.setdefault((r.source, r.id), []).append(r.pass_no)
    assert all(v == sorted(set(v)) or sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    assert all(len(v) <= {"a": 1, "b": 2, "c": 3}[s] for (s, _), v in uses.items())
    assert sum(r.n_tokens for r in rows) == sum(x.mix_tokens for x in shares.values())
    assert len({r.position for r in rows}) == len(rows)
    # Any stretch of the mix has the shares: here the first half.
    half = rows[: len(rows) // 2]
    total = sum(r.n_tokens for r in half)
    for s, w in (("a", 3 / 9), ("b", 4 / 9), ("c", 2 / 9)):
        assert abs(sum(r.n_tokens for r in half if r.source == s) - w * total) < 2 * mixing.BLOCK


def test_mix_fills_up(spark):
    """A text too long for what a source still lacks is passed over for others that fit; a mix of many periods keeps the shares throughout."""
    rows = [(i, long_text(30, i), "a") for i in range(200)] + [(1000 + i, long_text(1500 if i % 10 == 0 else 30, i), "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 40), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    for total in (3000, 20_000, 60_000):
        mix = mixing.Mix(docs, targets, total_tokens=total)
        for r in mix.shares().collect():
            assert abs(r.mix_tokens - r.aimed_share * total) < 80, (total, r)
    rows = mix.rows().orderBy("position", "id").collect()
    assert len({r.position for r in rows}) == len(rows) and max(r.slot for r in rows) > 2 * 10
    had, at = {"a": 0, "b": 0}, 0
    for r in rows[: len(rows) * 9 // 10]:
        had[r.source] += r.n_tokens
        at += r.n_tokens
        assert abs(had["a"] - 0.7 * at) < 4 * mixing.BLOCK


def test_mix_edges(spark):
    docs, targets = mix_frames(spark)
    assert mixing.Mix(docs.limit(0), targets).rows().count() == 0
    assert {r.actual_share for r in mixing.Mix(docs.limit(0), targets).shares().collect()} == {0.0}
    small = mixing.Mix(docs, targets, total_tokens=5000)
    assert abs(small.rows().agg(F.sum("n_tokens")).first()[0] - 5000) < 400
    with pytest.raises(ValueError, match="once"):
        mixing.Mix(docs, targets.union(targets))


# ---------------------------------------------------------------- neighbours


def test_hilbert_curve_is_continuous():
    side = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = neighbours.hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    out = {}
    for i in range(len(ids)):
        order = sorted((-round(float(sims[i, j]), 9), ids[j]) for j in range(len(ids)) if j != i and sims[i, j] >= least)
        out[ids[i]] = [j for _, j in order[:k]]
    return out


def test_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 64))
    x = np.concatenate([centres[rng.integers(0, 150, 1200)] + 0.1 * rng.standard_normal((1200, 64)), rng.standard_normal((300, 64))]).astype(np.float32)
    x[:40] = x[0]  # many copies
    x[50] = x[51] * 3
    ids = [f"v{i:05d}" for i in range(len(x))]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [("z0", None), ("z1", []), ("z2", [0.0] * 64), ("z3", [float("nan")] * 64), ("z4", [1.0] * 63), ("z5", [float("inf")] + [1.0] * 63), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("vec", F.lit("clash"))
    got: dict = {}
    for r in neighbours.nearest_vectors(df, window=200).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(ids, x.astype(np.float64), 5, 0.92)
    found = sum(len(set(v) & set(got.get(k, []))) for k, v in want.items())
    assert found / sum(map(len, want.values())) >= 0.95
    assert set(got) <= set(ids) and all(len(v) == len(set(v)) <= 5 and k not in v for k, v in got.items())
    assert got["v00020"] == ids[:5] and got["v00000"] == ids[1:6]
    pairs = neighbours.similar_pairs(neighbours.nearest_vectors(df, window=200))
    assert pairs.where("id_a >= id_b").count() == 0
    assert neighbours.nearest_vectors(df.limit(0)).count() == 0


def test_partitions_and_hot_copies(spark, monkeypatch):
    """The result does not hang on the number of partitions; copies are the same whether met in a broadcast or not."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((100, 64))
    x = (centres[rng.integers(0, 100, 900)] + 0.1 * rng.standard_normal((900, 64))).astype(np.float32)
    x[:300] = x[0]
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, embedding array<float>")
    rows = lambda: sorted((r.id, r.place, r.neighbour) for r in neighbours.nearest_vectors(df).collect())
    first = rows()
    want = brute(ids, x.astype(np.float64), 5, 0.92)
    assert {k: v for k, v in want.items() if v} == {k: [n for i, _, n in first if i == k] for k in {i for i, _, _ in first}}
    monkeypatch.setattr(neighbours, "MAX_BROADCAST", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_crowd_beyond_every_window(spark):
    """A third of the rows is one topic, far larger than a window: all of it is compared, and what is beside it."""
    rng = np.random.default_rng(5)
    noise = lambda n, size: size / 8 * rng.standard_normal((n, 64))
    centre = rng.standard_normal(64) / 8
    x = np.concatenate([centre + noise(3000, 0.2), centre + noise(1000, 0.45), rng.standard_normal((5000, 64))]).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, embedding array<float>")
    got: dict = {}
    for r in neighbours.nearest_vectors(df, window=64).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(ids, x.astype(np.float64), 5, 0.92)
    for part in (ids[:3000], ids):
        found = sum(len(set(want[i]) & got.get(i, set())) for i in part)
        assert found >= 0.99 * sum(len(want[i]) for i in part)
