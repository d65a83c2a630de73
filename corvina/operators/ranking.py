"""Order-dependent operators: shares, pages, canonical rows, gaps, intervals, upserts as state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.session import cut


def share_of_total(df: DataFrame, *keys: str, digits: int = 2) -> DataFrame:
    """Rows per group and their share of all rows in percent."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n")).scalar()  # a scalar, so no window over one partition
    return counted.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / whole, digits))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the total, the number of pages, and whether there is a next or previous one.

    The total comes from all rows, so it is right for a page past the end too (which has no rows).
    """
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total_rows") / size)
    return rows.withColumn("total_rows", total.scalar()).select(
        "*", pages.cast("long").alias("total_pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_prev")
    )


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Rows of each group numbered from 1 in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def falling(df: DataFrame, column: str) -> Column:
    """An expression that is larger for smaller values of an integer or string column, for use inside a maximum."""
    c = F.col(column)
    if df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return -c
    return smallest_last(c)


def smallest_last(c: Column) -> Column:
    """A string that is the larger the smaller the (string) value is, for use inside a maximum: its hex digits mapped to their
    complements, ended by a sign above all of them."""
    return F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def canonical_rows(df: DataFrame, group: str, score: str, id_column: str) -> DataFrame:
    """Each row with the id of its group's canonical row: highest score (null last), then smallest id.

    The canonical row is a maximum, so tasks combine their rows first and no window gathers a large group.
    """
    order = F.struct(F.col(score).isNotNull().alias("known"), F.col(score).alias("score"), falling(df, id_column).alias("last"))
    best = df.groupBy(group).agg(F.max_by(id_column, order).alias("canonical_id"), F.count(F.lit(1)).alias("group_size"))
    return df.join(best, group).select(id_column, group, "canonical_id", "group_size")


def gaps(numbers: DataFrame, keys: Sequence[str], number: str, low: int, high: int) -> DataFrame:
    """Runs of missing numbers of each group within [low, high]: keys, gap_from, gap_to.

    A group that is there without any number in range has one gap, the whole range.
    """
    given = numbers.select(*keys, F.col(number).cast("long").alias("_n"))
    inside = given.where(F.col("_n").between(low, high))
    edges = given.select(*keys).distinct()
    bounds = edges.withColumn("_n", F.lit(low - 1)).unionByName(edges.withColumn("_n", F.lit(high + 1)))
    points = inside.unionByName(bounds).distinct()
    following = F.lead("_n").over(Window.partitionBy(*keys).orderBy("_n"))
    return points.withColumn("_next", following).where("_next - _n > 1").select(*keys, (F.col("_n") + 1).alias("gap_from"), (F.col("_next") - 1).alias("gap_to"))


def interval_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points within closed ranges, by an equi-join on buckets of ``width``; a range is repeated for each bucket it touches."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where(F.col(point).between(F.col(low), F.col(high))).drop("_b")


def overlapping_boxes(left: DataFrame, right: DataFrame, page_column: str, cell: float) -> DataFrame:
    """Pairs of boxes on one page that overlap. Both sides: page, id, x0, y0, x1, y1; result: page, left_id, right_id.

    Equal boxes of a page are compared as one and their ids paired afterwards, so the comparisons do not grow with copies, only the
    result does. Boxes are put on a grid of ``cell``; a pair meets in the cells they share and counts in the first of them only.
    """
    corners = ("x0", "y0", "x1", "y1")
    # A fixed number of parts, as few boxes may make very many pairs and would else be put together in fewer tasks than there are cores.
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * spark.sparkContext.defaultParallelism)

    def cells(df: DataFrame, side: str) -> DataFrame:
        alike = df.groupBy(F.col(page_column).alias("page"), *corners).agg(F.collect_list(F.struct("id")).alias("ids"))  # in structs, as null ids would be left out
        named = alike.select("page", *[F.col(c).alias(f"{side}_{c}") for c in ("ids", *corners)])
        span = lambda a, b: F.sequence(F.floor(F.col(f"{side}_{a}") / cell), F.floor(F.col(f"{side}_{b}") / cell))
        return named.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1"))).repartition(parts, "page", "_cx", "_cy")

    both = cells(left, "l").join(cells(right, "r"), ["page", "_cx", "_cy"])
    meet = (F.col("l_x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("l_x1")) & (F.col("l_y0") < F.col("r_y1")) & (F.col("r_y0") < F.col("l_y1"))
    first = (F.col("_cx") == F.floor(F.greatest("l_x0", "r_x0") / cell)) & (F.col("_cy") == F.floor(F.greatest("l_y0", "r_y0") / cell))
    met = both.where(meet & first).select("page", "l_ids", "r_ids")
    return met.select("page", F.inline("l_ids").alias("left_id"), "r_ids").select("page", "left_id", F.inline("r_ids").alias("right_id"))


def running_budget(df: DataFrame, order: Sequence[Column], cost: str, budget: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows in order within each group as long as the running cost stays within the budget.

    Without keys the rows are sorted into ranges, written once, and summed within each range; the sums of the ranges before
    it are added, so no task gets the whole table.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.sum(cost).alias("_t")).select("_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))  # a row per range
    summed = ranged.withColumn("spent", F.sum(cost).over(upto)).join(F.broadcast(before), "_range")
    return summed.withColumn("spent", F.col("spent") + F.col("_before")).where(F.col("spent") <= budget).drop("_range", "_before")


# ---------------------------------------------------------------- bounded parts of unbounded tables


def bounded_sample(df: DataFrame, id_column: str, bound: int, total: int | None = None) -> DataFrame:
    """Up to ``bound`` rows by a hash of the id, the same whatever the partitions.

    Tasks first keep the share of hashes that gives half as many rows again as the bound, so a large table sends no
    more than a small one. ``total`` is the number of rows if it is known.
    """
    rows = df.count() if total is None else total
    span = 1 << 40
    u = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(span))
    share = min(1.0, 1.5 * (bound + 20) / max(1, rows))
    kept = df.withColumn("_u", u).where(F.col("_u") < int(share * span)) if share < 1 else df.withColumn("_u", u)
    return kept.orderBy("_u", id_column).limit(bound).drop("_u")


# ---------------------------------------------------------------- sinks as state transitions


def known_by(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined with the distinct keys of ``others``, null being equal to null: 'left_anti', 'left_semi', or 'left' with the
    column ``_known`` (true or null)."""
    theirs = others.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_known", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(theirs, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The state after ``new`` rows replaced ``old`` ones of the same keys; of several new rows the first by ``version`` counts.

    ``is_new`` tells whether the key was not there before. A null key is a key like others, equal to itself.
    """
    fresh = first_of(new, keys, version)
    kept = known_by(old, fresh, keys, "left_anti").withColumn("is_new", F.lit(False))
    added = known_by(fresh, old, keys, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    return kept.unionByName(added)


def keep_best(old: DataFrame, new: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Of old and new rows of a key the one with the higher score; on a tie the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_of(both, keys, [F.col(score).desc_nulls_last(), F.col("_new")]).drop("_new")


def append_once(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """New rows whose key is not there yet, one per key (null is a key, too): what an idempotent append writes."""
    return first_of(known_by(new, old, [key], "left_anti"), [key], order)


def accept_better(old: DataFrame, new: DataFrame, key: str, score: str, least: float = 0.85) -> DataFrame:
    """For each row of ``new`` what becomes of a second attempt: ``persist`` if its score is above the old one and at least
    ``least``, else ``dead_letter``. Result: key, old_score, new_score, decision. Nothing known before counts as 0."""
    before = old.groupBy(key).agg(F.max(score).alias("old_score"))
    after = new.groupBy(key).agg(F.max(score).alias("new_score"))
    better = (F.col("new_score") > F.coalesce("old_score", F.lit(0.0))) & (F.col("new_score") >= least)
    return after.join(before, key, "left").select(key, "old_score", "new_score", F.when(better, "persist").otherwise("dead_letter").alias("decision"))


def enqueue(failed: DataFrame, text: str, options: str, key: Sequence[str], queue: DataFrame | None = None) -> DataFrame:
    """Rows for a queue of dead letters: the columns of ``failed`` but text and options, raw_text (the text and each option on a line
    of its own; null parts are left out), status 'pending'. Rows whose ``key`` is in ``queue`` already are left out; repeated keys give one row."""
    raw = F.concat_ws("\n", F.col(text), F.array_join(options, "\n"))
    rows = failed.withColumn("raw_text", raw).withColumn("status", F.lit("pending")).drop(*({text, options} - {"raw_text"}))
    rows = first_of(rows, key, [F.col("raw_text")])
    return known_by(rows, queue, key, "left_anti") if queue is not None else rows


def mark_done(df: DataFrame, done: DataFrame, key: str, status: str, before: str, after: str) -> DataFrame:
    """``status`` becomes ``after`` for the listed keys, but only where it is ``before``."""
    listed = done.select(key).distinct().withColumn("_done", F.lit(True))
    changed = F.when(F.col("_done") & (F.col(status) == before), after).otherwise(F.col(status))
    return df.join(listed, key, "left").withColumn(status, changed).drop("_done")
