"""Mixes sources to target shares of all tokens and interleaves them by Pfair scheduling."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.tokens import DEFAULT_TOKENIZER, token_count
from corvina.session import cut

#: Positions within a source are summed in so many hash ranges.
RANGES = 1024
#: More listed sources than this are refused, so that what is broadcast has a bound (sources times ``RANGES``).
MAX_SOURCES = 500
#: Tokens of a block, whatever the size of the mix.
BLOCK = 2048
#: Weights are multiples of one part in so many, so the schedule repeats after so many slots (or fewer) and is made for one period.
PERIOD = 100_000
#: A source's last pass is filled up from so many further texts at most.
FILLERS = 1000


def clean_source(column: str | Column) -> Column:
    """Sources compare without regard to case and blanks."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(c), r"[\s ]+", "")


def parts_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole parts for each positive weight, at least one each: exact for shares of up to 1 in all that are
    decimals which ``period`` can express, else to about one part in ``period``. There are about ``period`` parts at most."""
    w = {s: x for s, x in weights.items() if x > 0}
    if sum(w.values()) > 1 + 1e-9 or any(abs(x * period - round(x * period)) > 1e-6 for x in w.values()):
        whole = sum(w.values())
        w = {s: x / whole for s, x in w.items()}
    parts = {s: max(1, round(x * period)) for s, x in w.items()}
    common = math.gcd(*parts.values()) if parts else 1
    return {s: n // common for s, n in parts.items()}


def pfair_period(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block from 0, slot from 0) of one period, as many slots as there are parts, in slot order.

    A source of n parts of L has the weight w = n / L. Its block j may not start before slot floor(j / w) and must end by slot
    ceil((j + 1) / w). Of the released blocks the one with the earliest deadline comes next. What a source has had then differs
    from its weight times the slots by less than one block at any slot. At the end of the period every source has had
    its parts exactly, so the same schedule follows again: block k * n + j has the slot k * L + slot of j.
    """
    whole = sum(parts.values())
    waiting = [(0, -(-whole // n), s, 0) for s, n in parts.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int, int]] = []
    for slot in range(whole):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * whole // parts[s], -(-(j + 2) * whole // parts[s]), s, j + 1))
    return out


class Mix:
    """A planned mix: ``rows()`` is the mix in order, ``shares()`` the report per source."""

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        total_tokens: int | None = None,
        tokenizer: str = DEFAULT_TOKENIZER,
    ) -> None:
        """Counts tokens per source and fixes the size of the mix.

        ``targets``: source, target_share, max_repeats. The mix is as large as the scarcest source allows when its
        texts are used ``max_repeats`` times, or ``total_tokens`` if that is less. Listed sources without any
        token cannot take part; the others keep their proportions, as multiples of one part in ``PERIOD``.

        Edge cases: texts of unlisted or null sources are left out; null and empty texts count no tokens and are
        left out; rows delivered twice (same id) count once; a listing with repeated sources, negative shares or
        more than ``MAX_SOURCES`` sources is refused; empty tables give an empty mix.
        """
        rows = targets.select(clean_source("source").alias("s"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES or len({r[0] for r in rows}) != len(rows) or any((r[1] or 0) < 0 for r in rows):
            raise ValueError("targets must name each source once, with shares of at least 0")
        self.targets = {r[0]: (r[1] or 0.0, max(0, r[2] or 0)) for r in rows if r[0] is not None}
        self.spark = docs.sparkSession
        key = F.col(id_column).alias("id")
        listed = docs.select(key, clean_source(docs["source"]).alias("source"), F.col(text_column).alias("_text")).where(
            F.col("source").isin(sorted(self.targets)) & (F.octet_length("_text") > 0)
        )
        counted = listed.select("id", "source", token_count("_text", tokenizer).alias("n_tokens"))
        spread = F.xxhash64(F.col("id").cast("string"))
        # The text stays behind here: what is kept is a narrow row per document.
        self.docs = cut(
            counted.dropDuplicates(["id"]).withColumn("_h", spread).withColumn("_range", F.shiftrightunsigned("_h", 54).cast("int"))
        )
        self.ranges = self.docs.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_t"))
        have = {r[0]: int(r[1]) for r in self.ranges.groupBy("source").agg(F.sum("_t")).collect()}
        self.have = {s: have.get(s, 0) for s in self.targets}
        usable = {s: w for s, (w, repeats) in self.targets.items() if w > 0 and repeats > 0 and self.have[s] > 0}
        self.parts = parts_of(usable)
        whole = sum(self.parts.values())
        self.weights = {s: n / whole for s, n in self.parts.items()}
        most = min((self.targets[s][1] * self.have[s] / w for s, w in self.weights.items()), default=0.0)
        self.total = min(most, total_tokens) if total_tokens is not None else most
        self.goal = {s: min(round(w * self.total), self.targets[s][1] * self.have[s]) for s, w in self.weights.items()}

    def _plan(self) -> DataFrame:
        schema = "source string, _goal long, _size long, _parts long"
        return self.spark.createDataFrame([(s, self.goal[s], self.have[s], self.parts[s]) for s in self.weights], schema)

    def _placed(self) -> DataFrame:
        """Each document with the tokens of its source before it."""
        before = F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = self.ranges.withColumn("_before", before).drop("_t")  # at most sources * RANGES rows
        within = Window.partitionBy("source", "_range").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, -1)
        placed = (
            self.docs.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(F.broadcast(offsets), ["source", "_range"])
            .join(F.broadcast(self._plan()), "source")
            .withColumn("_at", F.col("_before") + F.col("_in"))
        )
        return placed.withColumn("_rest", F.col("_goal") % F.col("_size"))

    def _fillers(self, placed: DataFrame) -> DataFrame:
        """Texts that fill what the last pass of their source leaves: id, source, _fill (their place in the last pass)."""
        fits = F.col("_at") + F.col("n_tokens") <= F.col("_rest")
        had = {r[0]: int(r[1]) for r in placed.where(fits).groupBy("source").agg(F.sum("n_tokens")).collect()}
        left = {s: self.goal[s] % self.have[s] - had.get(s, 0) for s in self.weights}
        room = F.coalesce(F.create_map(*[F.lit(x) for s, n in left.items() for x in (s, n)])[F.col("source")], F.lit(0)) if left else F.lit(0)
        order = F.row_number().over(Window.partitionBy("source").orderBy("_h", "id"))
        rows = placed.where(~fits & (F.col("n_tokens") <= room)).select("id", "source", "n_tokens", "_h").withColumn("_r", order).where(F.col("_r") <= FILLERS).collect()
        chosen = []
        for r in sorted(rows, key=lambda r: (r.source, r._r)):
            if r.n_tokens <= left[r.source]:
                chosen.append((r.id, r.source, self.goal[r.source] % self.have[r.source] - left[r.source]))
                left[r.source] -= r.n_tokens
        key_type = self.docs.schema["id"].dataType.simpleString()
        return self.spark.createDataFrame(chosen, f"id {key_type}, source string, _fill long")

    def chosen(self) -> DataFrame:
        """Each document with its place in its source and how often it is used: in full passes, and once more if it lies within the
        part of the last pass that is still wanted, or, as a place ``_fill`` there tells, fits into what is left of it."""
        placed = cut(self._placed())
        full = F.floor(F.col("_goal") / F.col("_size")).cast("int")
        extra = ((F.col("_at") + F.col("n_tokens") <= F.col("_rest")) | F.col("_fill").isNotNull()).cast("int")
        filled = placed.join(F.broadcast(self._fillers(placed)), ["id", "source"], "left")  # at most sources * FILLERS rows
        return filled.withColumn("_full", full).withColumn("copies", full + extra).where("copies > 0")

    def rows(self) -> DataFrame:
        """The mix: position (sortable; not dense), id, source, pass_no (from 1), n_tokens, slot.

        A text's place in the stream of its source gives its block; the block's slot comes from the schedule of one period,
        which is all that is broadcast, by arithmetic.
        """
        whole = sum(self.parts.values())
        slots = self.spark.createDataFrame(pfair_period(self.parts), "source string, _j int, _slot int")
        used = self.chosen().select("id", "source", "n_tokens", "_at", "_fill", "_full", "_size", "_parts", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass_no"))
        at = F.when(F.col("pass_no") > F.col("_full"), F.coalesce("_fill", "_at")).otherwise(F.col("_at"))
        block = F.floor(F.col("_stream") / BLOCK)
        return (
            used.withColumn("_stream", at + (F.col("pass_no") - 1) * F.col("_size"))
            .withColumn("_j", (block % F.col("_parts")).cast("int"))
            .withColumn("_k", F.floor(block / F.col("_parts")))
            .join(F.broadcast(slots), ["source", "_j"])
            .withColumn("slot", F.col("_k") * whole + F.col("_slot"))
            .select((F.col("slot") * BLOCK + F.col("_stream") % BLOCK).alias("position"), "id", "source", "pass_no", "n_tokens", "slot")
        )

    def shares(self) -> DataFrame:
        """Per listed source: target_share, aimed_share (after leaving out sources without texts), available_tokens,
        mix_tokens, actual_share, n_texts, most_copies."""
        listed = self.spark.createDataFrame(
            [(s, w, self.weights.get(s, 0.0), repeats, self.have[s]) for s, (w, repeats) in self.targets.items()],
            "source string, target_share double, aimed_share double, max_repeats int, available_tokens long",
        )
        used = self.chosen().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies")
        )
        whole = used.agg(F.sum("mix_tokens")).scalar()
        filled = listed.join(used, "source", "left").fillna(0, ["mix_tokens", "n_texts", "most_copies"])
        return filled.withColumn("actual_share", F.coalesce(F.col("mix_tokens") / whole, F.lit(0.0)))
