"""The most similar vectors of every vector, found along several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.operators.ranking import bounded_sample
from corvina.operators.skew import meet
from corvina.session import cut

#: Coordinates of a curve and bits per coordinate; together they fit in a long.
COORDINATES, BITS = 8, 7
#: Rows compared at once; vectors kept in memory at once by a task.
BLOCK, CHUNK = 512, 32_768
#: A vector with similar ones in a window's width through this stands in a crowd, which windows do not see whole.
CROWD_SHARE = 8
#: Each vector of a crowd is at least so similar to a centre; vectors that the driver takes at once to choose centres.
COVER, COVER_SAMPLE = 0.8, 4096
#: Vectors of a crowd (and as many others) that a task compares at once.
CROWD_BLOCK = 8192
#: Vectors with several copies that are broadcast at most, each with its smallest ids.
MAX_BROADCAST = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of non-negative integer cells.

    By the transposition of Gray codes published by J. Skilling, "Programming the Hilbert curve", 2004.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work of the rotated, reflected sub-cubes
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: a random projection and a random shift fixed by the curve's number."""
    rng = np.random.default_rng(7919 * (curve + 1))
    dims = unit.shape[1]
    m = min(COORDINATES, dims)
    axes = np.linalg.qr(rng.standard_normal((dims, m)))[0].astype(np.float32)
    spread = 4.0 / np.sqrt(dims)  # coordinates of a unit vector mostly lie within this distance of 0
    shifted = (unit @ axes) / (2 * spread) + 0.5 + rng.uniform(-0.1, 0.1, m).astype(np.float32)
    side = 1 << BITS
    return hilbert_keys(np.clip((shifted * side).astype(np.int64), 0, side - 1), BITS)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims)


def _unit(raw: np.ndarray, dtype: type = np.float64) -> np.ndarray:
    wide = raw.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(dtype)


def _best(near: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the rough similarities that may be among the ``k`` best of their row, and how many each row has."""
    counts = (near >= least - 1e-5).sum(axis=1)
    floor = np.full(len(near), least, np.float32)
    full = np.flatnonzero(counts > k)
    if len(full):
        floor[full] = np.maximum(least, np.partition(near[full], -k, axis=1)[:, -k])
    rows, cols = np.nonzero(near >= floor[:, None] - np.float32(1e-5))
    return rows, cols, counts


def _ranked(rows: np.ndarray, cols: np.ndarray, exact: np.ndarray, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, similar rows and similarities by exact similarity; up to ``k``, and those as similar as the k-th one."""
    good = exact >= least
    rows, cols, exact = rows[good], cols[good], np.minimum(exact[good], 1.0)
    order = np.lexsort((-exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
    for a, b in zip(starts, np.r_[starts[1:], len(rows)] if len(rows) else [], strict=True):
        # Rows as similar as the k-th one stay, as the smaller id is to win.
        b = a + int(np.searchsorted(-exact[a:b], -exact[min(a + k, b) - 1], side="right"))
        yield int(rows[a]), cols[a:b], exact[a:b]


def _best_in_window(unit: np.ndarray, window: int, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each row with a similar one at most ``window`` rows away: row, similar rows, similarities (``k``, best first), how many there are."""
    rough = unit.astype(np.float32)
    for begin in range(0, len(unit), BLOCK):
        end = min(begin + BLOCK, len(unit))
        low, high = max(0, begin - window), min(len(unit), end + window)
        near = rough[begin:end] @ rough[low:high].T
        near[np.arange(end - begin), np.arange(begin - low, end - low)] = -2
        rows, cols, counts = _best(near, k, least)
        exact = np.einsum("ij,ij->i", unit[begin + rows], unit[low + cols])
        for row, others, similar in _ranked(rows, cols, exact, k, least):
            yield begin + row, low + others, similar, int(counts[row])


def _merged(ids: list[list], others: np.ndarray, similar: np.ndarray, k: int) -> tuple[list, list]:
    """The ids of similar vectors, each with its copies, and the similarities: ``k``, ties to the smaller id."""
    them = sorted((-s, i) for o, s in zip(others, similar, strict=True) for i in ids[o])[:k]
    return [i for _, i in them], [-s for s, _ in them]


def _cover(unit: np.ndarray) -> np.ndarray:
    """Centres so that each of the unit vectors is at least ``COVER`` similar to one."""
    centres, left = [], unit
    while len(left):
        centre = left[left @ left[0] >= COVER].sum(axis=0)
        centre /= np.linalg.norm(centre)
        if centre @ left[0] < COVER:
            centre = left[0]
        centres.append(centre)
        away = left @ centre < COVER
        away[0] = False
        left = left[away]
    return np.array(centres, np.float32)


def _rows_at_once(unit: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Similarities to all centres, for so many rows at once as memory allows: first row, matrix."""
    step = max(1, 4_000_000 // len(centres))
    for i in range(0, len(unit), step):
        yield i, unit[i : i + step] @ centres.T


def _among_crowds(crowd: DataFrame, unique: DataFrame, k: int, least: float, dims: int, key_type: str) -> DataFrame:
    """The most similar of all ``unique`` vectors (vec, ids) for those of the ``crowd`` (id, vec, ids), exactly: id, to, sims.

    Centres cover the crowd. A vector as similar as ``least`` to one whose angle to its centre is r is at most r and the
    angle of ``least`` away from that centre (triangle inequality), so no other vectors are compared with those of the centre.
    Vectors outside the crowd get what is similar to them in it, which is all they lack.
    Both sides are cut into blocks of bounded size by a hash and every pair of blocks is a group of its own, so a dense topic
    is spread over tasks. The work is the square of a topic's size, and nothing between topics that are apart.
    """
    spark = crowd.sparkSession
    sc = spark.sparkContext
    centres = np.empty((0, dims), np.float32)
    while True:
        shared = sc.broadcast(centres)

        def uncovered(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(shared.value):
                    unit = _unit(_matrix(batch.column(1), dims), np.float32)
                    top = np.concatenate([near.max(axis=1) for _, near in _rows_at_once(unit, shared.value)])
                    batch = batch.take(pa.array(np.flatnonzero(top < COVER)))
                yield batch

        left = crowd.select("id", "vec").mapInArrow(uncovered, f"id {key_type}, vec binary")
        some = [r.vec for r in bounded_sample(left, "id", COVER_SAMPLE).collect()]
        if not some:
            break
        centres = np.concatenate([centres, _cover(_unit(np.frombuffer(b"".join(some), np.float32).reshape(-1, dims), np.float32))])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(0), dims), np.float32)
                parts = [(near.argmax(axis=1), near.max(axis=1)) for _, near in _rows_at_once(unit, shared.value)]
                home, top = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(top.astype(np.float64))], ["vec", "ids", "p", "c"])

    housed = cut(crowd.select("vec", "ids").mapInArrow(homes, f"vec binary, ids array<{key_type}>, p int, c double"))
    reach = np.full(len(centres), 2.0)  # the similarity to a centre from which vectors are compared
    blocks = np.ones((2, len(centres)), np.int64)
    for p, n, c in housed.groupBy("p").agg(F.count(F.lit(1)), F.min("c")).collect():  # a row for each centre
        reach[p] = np.cos(min(np.pi, np.arccos(np.clip(c, -1, 1)) + np.arccos(least))) - 1e-3
        blocks[0, p] = -(-n // CROWD_BLOCK)

    def meets(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, near in _rows_at_once(unit, shared.value):
            rows, cols = np.nonzero(near >= bounds.value[0])
            yield i + rows, cols

    bounds = sc.broadcast((reach, blocks))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, cols in meets(_unit(_matrix(batch.column(0), dims), np.float32)):
                    n += np.bincount(cols, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["p", "n"])

    tagged = unique.join(crowd.select("vec", F.lit(True).alias("inside")), "vec", "left")
    for p, n in unique.select("vec").mapInArrow(counted, "p int, n long").groupBy("p").agg(F.sum("n")).collect():
        blocks[1, p] = -(-n // CROWD_BLOCK)
    sides = sc.broadcast((reach, blocks))

    def sent(side: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, theirs = sides.value[1][side], sides.value[1][1 - side]
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = batch.column(0).to_pylist()
                pairs = [(np.arange(len(vec)), batch.column(2).to_numpy())] if side == 0 else meets(_unit(_matrix(batch.column(0), dims), np.float32))
                for at, p in pairs:
                    own = np.array([crc32(vec[i]) for i in at], np.int64) % mine[p]
                    row = np.repeat(np.arange(len(at)), theirs[p])
                    other = np.concatenate([np.arange(theirs[x]) for x in p]) if len(p) else np.empty(0, np.int64)
                    for i in range(0, len(row), 20_000):
                        r, o = row[i : i + 20_000], other[i : i + 20_000]
                        ab = (own[r], o) if side == 0 else (o, own[r])
                        take = pa.array(at[r])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(p[r].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in ab), *(c.take(take) for c in batch.columns[:2]), batch.column(batch.num_columns - 1).take(take)],
                            ["p", "a", "b", "vec", "ids", "inside"],
                        )

        return rows

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        me, to, sims = [], [], []
        id_arrow = left.schema.field("ids").type.value_type
        if left.num_rows and right.num_rows:
            mine, theirs = (_unit(_matrix(t.column("vec"), dims)) for t in (left, right))
            rough, names, ids = theirs.astype(np.float32), left.column("ids").to_pylist(), right.column("ids").to_pylist()
            at = {x[0]: i for i, x in enumerate(ids)}

            def add(unit: np.ndarray, own: list[list], against: np.ndarray, rough: np.ndarray, ids: list[list], at: dict) -> None:
                for begin in range(0, len(unit), BLOCK):
                    part = unit[begin : begin + BLOCK]
                    near = part.astype(np.float32) @ rough.T
                    for i in range(len(part)):
                        if (same := at.get(own[begin + i][0])) is not None:
                            near[i, same] = -2
                    rows, cols, _ = _best(near, k, least)
                    exact = np.einsum("ij,ij->i", part[rows], against[cols])
                    for row, others, similar in _ranked(rows, cols, exact, k, least):
                        ordered = _merged(ids, others, similar, k)
                        me.append(own[begin + row][0])
                        to.append(ordered[0])
                        sims.append(ordered[1])

            add(mine, names, theirs, rough, ids, at)
            outside = np.flatnonzero([x is None for x in right.column("inside").to_pylist()])
            if len(outside):
                add(theirs[outside], [ids[i] for i in outside], mine, mine.astype(np.float32), names, {})
        return pa.table([pa.array(me, id_arrow), pa.array(to, pa.list_(id_arrow)), pa.array(sims, pa.list_(pa.float64()))], ["id", "to", "sims"])

    shape = f"p int, a int, b int, vec binary, ids array<{key_type}>, inside boolean"
    both = housed.select("vec", "ids", "p", F.lit(True).alias("inside")), tagged.select("vec", "ids", "inside")
    groups = [df.mapInArrow(sent(side), shape).groupBy("p", "a", "b") for side, df in enumerate(both)]
    return groups[0].cogroup(groups[1]).applyInArrow(compared, f"id {key_type}, to array<{key_type}>, sims array<double>")


def nearest_vectors(
    df: DataFrame,
    id_column: str = "id",
    vector_column: str = "embedding",
    k: int = 5,
    min_similarity: float = 0.92,
    dims: int = 64,
    curves: int = 4,
    window: int = 1024,
    partitions: int | None = None,
) -> DataFrame:
    """Up to ``k`` other usable vectors of highest cosine similarity, at least ``min_similarity``, for each usable one.

    Result: id, neighbour, similarity, place (1 is the most similar; ties: smaller id). Usable are vectors of
    ``dims`` finite numbers that are not all zero.

    Equal vectors are first reduced to one representative with its ``k + 1`` smallest ids, so a vector that a third of
    the rows share costs one place on a curve. The representatives are sorted along ``curves`` Hilbert curves of
    different random projections and shifts, range-partitioned by curve and key; each is compared with the ``window``
    keys before and after it in blocks. The curves' results are merged and ranked by the exact similarity.
    A vector that has an eighth of ``window`` similar ones on any curve stands in a crowd and is compared with all
    vectors that can be similar to it instead (see ``_among_crowds``), so the work follows the density.
    Outside crowds the search is approximate: neighbours that are never within the window on any curve are missed (the tests
    hold the recall against brute force). Windows end at the edges of a task's range, which differ from curve to curve. Copies are exact: a copy beyond the first ``k + 1`` takes the ``k`` smallest ids.

    Edge cases: null, short, zero and non-finite vectors are left out; rows delivered twice (same id and vector) count
    once; empty input gives no rows; extra columns are ignored.
    """
    key_type = df.schema[id_column].dataType.simpleString()

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.where(vectors.is_valid(), np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1), -1)
            right = np.flatnonzero(lengths == dims)
            if not len(right):
                continue
            flat = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                fine = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            flat = flat[fine] + np.float32(0)  # -0 becomes 0, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(right[fine])), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "vec"]
            )

    vectors = (
        df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .mapInArrow(usable, f"id {key_type}, vec binary")
    )
    ranked = vectors.withColumn("_r", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k + 1)
    unique = ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))

    def along_curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(0), dims), np.float32)
            for curve in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(unit), curve, np.int32)),
                        pa.array(curve_keys(unit, curve)),
                        batch.column(0),
                        batch.column(1),
                    ],
                    ["curve", "key", "vec", "ids"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(curve: np.ndarray, unit: np.ndarray, ids: list[list], digests: list[str | None], fresh: int) -> Iterator[pa.RecordBatch]:
            me, to, sims, crowded, copies, digest = [], [], [], [], [], []
            for c in np.unique(curve):
                at = np.flatnonzero(curve == c)
                alone = {int(i) for i in at if c == 0 and i >= len(ids) - fresh and len(ids[i]) > 1}
                for row, others, similar, n in _best_in_window(unit[at], window, k, min_similarity):
                    ordered = _merged(ids, at[others], similar, k)
                    me.append(ids[at[row]][0])
                    to.append(ordered[0])
                    sims.append(ordered[1])
                    crowded.append(n >= least_crowd)
                    copies.append(None)
                    digest.append(None)
                for i in alone:  # copies, once for each vector
                    me.append(ids[i][0])
                    to.append([])
                    sims.append([])
                    crowded.append(False)
                    copies.append(ids[i])
                    digest.append(digests[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(me, id_arrow), pa.array(to, pa.list_(id_arrow)), pa.array(sims, pa.list_(pa.float64())), pa.array(crowded, pa.bool_()), pa.array(copies, pa.list_(id_arrow)), pa.array(digest, pa.string())],
                ["id", "to", "sims", "crowded", "ids", "d"],
            )

        curve, unit, ids, digests, id_arrow, fresh = np.empty(0, np.int32), np.empty((0, dims)), [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            id_arrow = batch.column(3).type.value_type
            curve = np.concatenate([curve, batch.column(0).to_numpy()])
            unit = np.concatenate([unit, _unit(_matrix(batch.column(2), dims))])
            new = batch.column(3).to_pylist()
            ids += new
            digests += [md5(v.as_py()).hexdigest() if len(i) > k else None for v, i in zip(batch.column(2), new, strict=True)]
            fresh += batch.num_rows
            if len(ids) >= CHUNK:
                yield from found(curve, unit, ids, digests, fresh)
                # The last rows meet the next ones; what they have found so far is merged with that later.
                curve, unit, ids, digests, fresh = curve[-window:], unit[-window:], ids[-window:], digests[-window:], 0
        if fresh:
            yield from found(curve, unit, ids, digests, fresh)

    least_crowd = max(k + 1, window // CROWD_SHARE)
    placed = unique.mapInArrow(along_curves, f"curve int, key long, vec binary, ids array<{key_type}>")
    # Without a number the ranges are joined where they are small, so a task has many windows even with very many partitions.
    ranged = placed.repartitionByRange(partitions, "curve", "key") if partitions else placed.repartitionByRange("curve", "key")
    lists = (
        ranged.sortWithinPartitions("curve", "key")
        .mapInArrow(compared, f"id {key_type}, to array<{key_type}>, sims array<double>, crowded boolean, ids array<{key_type}>, d string")
    )

    def listed_once(lists: DataFrame, *more) -> DataFrame:
        pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("to", "sims"))))
        ordered = F.transform(pairs, lambda x: F.struct((-x["sims"]).alias("s"), x["to"].alias("i")))
        return lists.groupBy("id").agg(F.slice(F.array_sort(ordered), 1, k).alias("near"), *more)

    # Written once, as whether there are crowds decides what else is to be done.
    heads = cut(listed_once(lists, F.max("crowded").alias("crowded"), F.max("ids").alias("ids"), F.max("d").alias("d")))
    crowd = heads.where("crowded").select("id")
    if not crowd.isEmpty():
        own_vectors = unique.withColumn("id", F.element_at("ids", 1)).join(crowd, "id").select("id", "vec", "ids")
        whole = listed_once(_among_crowds(cut(own_vectors), unique, k, min_similarity, dims, key_type)).withColumnRenamed("near", "whole")
        more = F.filter("near", lambda x: ~F.exists("whole", lambda w: w["i"] == x["i"]))
        merged = F.when(F.col("whole").isNull(), F.col("near")).when(F.col("crowded"), F.col("whole")).otherwise(F.concat("whole", more))
        # Outside vectors that no window found may be new here.
        heads = heads.join(whole, "id", "full").withColumn("near", F.coalesce(merged, "whole"))
    heads = heads.withColumn("ids", F.coalesce("ids", F.array("id"))).drop("id")
    copies = heads.select(F.explode("ids").alias("id"), "ids", "near")
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("i")))
    best = F.slice(F.array_sort(F.concat(own, "near")), 1, k)
    listed = copies.select("id", F.posexplode(best).alias("p", "x")).select(
        "id", F.col("x.i").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).alias("place")
    )
    # Copies beyond the smallest k + 1 ids: digests stand for the vectors, so what is shuffled is narrow.
    many = heads.where(F.col("d").isNotNull()).select("d", "ids")
    rows = vectors.select("id", F.md5("vec").alias("d"))
    if many.count() <= MAX_BROADCAST:
        met = rows.join(F.broadcast(many), "d")
    else:  # a vector that very many rows share still meets them in a broadcast
        met = meet(cut(rows), many, "d")
    late = met.where(~F.array_contains("ids", F.col("id")))
    rest = late.select("id", F.posexplode(F.slice("ids", 1, k)).alias("p", "neighbour")).select(
        "id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("p") + 1).alias("place")
    )
    return listed.unionByName(rest.distinct())


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) in which at least one took the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
