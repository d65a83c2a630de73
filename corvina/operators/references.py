"""References to records that do not exist: orphan and early references, listed and counted by period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.skew import MAX_HOT_KEYS
from corvina.session import cut


def clean_key(column: str | Column) -> Column:
    """Keys compare without regard to case and outer white space."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c.cast("string"), r"^[\s ]+|[\s ]+$", ""))


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``name`` labels it; the columns pair up with the parent's columns."""

    name: str
    child_columns: tuple[str, ...]
    parent_columns: tuple[str, ...]
    parent_table: str | None = None  # name used in the deletion log; None: deletions are not told apart


def _keyed(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The clean key as one string; null if any part is null. Parts are joined by a separator that no trimmed id holds."""
    parts = [clean_key(df[c]) for c in columns]
    key = parts[0]
    for part in parts[1:]:
        key = F.concat(key, F.lit("\x1f"), part)  # concat gives null for a null part
    return key


def find_orphans(
    child: DataFrame,
    parent: DataFrame,
    ref: Reference,
    child_id: str = "id",
    created_at: str = "created_at",
    deletions: DataFrame | None = None,
) -> DataFrame:
    """Child rows whose reference names no parent, or one that came only after the child.

    Result: ref_field, child_id, status ('late', 'deleted', 'missing'), child_created_at; one row per child id.

    The distinct non-null keys of the child are anti-joined with the parent's keys; only that status table goes
    back to the child's rows. A key that holds a large share of the rows (there can be at most ``MAX_HOT_KEYS``)
    meets its rows in a broadcast join, so no task gets the whole group; all others meet in a shuffle.

    Edge cases: null references are no case; a blank key is an ordinary key; a null time of child or parent is
    never 'late'; rows delivered twice give one row; empty inputs give an empty result; other columns of either
    input, also of the same name, do not matter.
    """
    c = child.select(
        F.col(child_id).cast("string").alias("child_id"),
        _keyed(child, ref.child_columns).alias("_k"),
        F.col(created_at).alias("child_created_at"),
    ).where(F.col("_k").isNotNull())
    p = (
        parent.select(_keyed(parent, ref.parent_columns).alias("_k"), F.col(created_at).alias("_born"))
        .where(F.col("_k").isNotNull())
        .groupBy("_k")
        .agg(F.min("_born").alias("_born"))
    )
    # Written once, as the keys that are absent, those that are early and the total all start from it.
    keys = cut(c.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("child_created_at").alias("_first")))
    absent = keys.join(p, "_k", "left_anti")
    if ref.parent_table is not None and deletions is not None:
        gone = (
            deletions.where(clean_key("table_name") == ref.parent_table)
            .select(clean_key("record_id").alias("_k"))
            .where(F.col("_k").isNotNull())
            .distinct()
            .withColumn("_gone", F.lit(True))
        )
        absent = absent.join(gone, "_k", "left")
        state = F.when(F.col("_gone"), "deleted").otherwise("missing")
    else:
        state = F.lit("missing")
    absent = absent.select("_k", "_n", state.alias("_state"), F.lit(None).cast(c.schema["child_created_at"].dataType).alias("_born"))
    early = keys.join(p, "_k").where(F.col("_first") < F.col("_born")).select("_k", "_n", F.lit("late").alias("_state"), "_born")
    least = F.greatest(F.lit(1), F.floor(keys.agg(F.sum("_n")).scalar() / MAX_HOT_KEYS))
    # Written once, as both joins below and, for a compound key, those of the next reference start from it.
    status = cut(absent.unionByName(early).select("_k", "_state", "_born", (F.col("_n") > least).alias("_hot")))
    hot, cold = status.where("_hot"), status.where("NOT _hot")
    found = c.join(F.broadcast(hot), "_k").unionByName(c.join(cold, "_k"))
    return (
        found.where((F.col("_state") != "late") | (F.col("_born") > F.col("child_created_at")))
        .select(F.lit(ref.name).alias("ref_field"), "child_id", F.col("_state").alias("status"), "child_created_at")
        .distinct()
    )


def count_orphans(found: DataFrame) -> DataFrame:
    """Orphans per reference, month of the child's creation (yyyy-MM, null if unknown) and status."""
    return found.groupBy("ref_field", F.date_format("child_created_at", "yyyy-MM").alias("month"), "status").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
