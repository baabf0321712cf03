"""References to records that do not exist, are deleted, or appear later than the reference.

Parent keys are compressed into runs of consecutive integers. A reference is
matched *as of* the nearest run start at or below it; it leads nowhere if no run
starts there or if the key lies beyond that run's end. Only distinct keys take part in
the match, so a parent that holds a third of all references costs one row.

Defined results
---------------
* A null reference is no reference. A null or absent ``created_at`` is never late,
  and its period is ``unknown``.
* A parent present several times counts as created at its earliest time.
* Repeated deletion entries count once; an entry for a key that exists is a restored
  record and reports nothing.
* Empty tables give no rows (or, for an empty parent, every reference). Further
  columns of the inputs, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a key block as a power of two. Keys of one block meet in one window
#: partition, so its size has this bound (distinct references plus run starts).
BLOCK_BITS = 16


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows of ``child`` refer by ``column`` to ``parent`` (key ``parent_key``)."""

    table_name: str
    child: DataFrame
    row_id: str
    column: str
    parent_name: str
    parent: DataFrame
    parent_key: str
    created_at: str = "created_at"
    parent_created_at: str = "created_at"


def key_runs(keys: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Runs of consecutive integers in ``key``: ``by..., block, run_start, run_end``.

    Runs end at block borders, which keeps every window partition bounded.
    Repeated and null keys are ignored.
    """
    by = by or []
    distinct = keys.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("long").alias("_k")).distinct()
    block = F.shiftright(F.col("_k"), BLOCK_BITS)
    numbered = distinct.withColumn("block", block).withColumn(
        "_island", F.col("_k") - F.row_number().over(Window.partitionBy(*by, "block").orderBy("_k"))
    )
    return numbered.groupBy(*by, "block", "_island").agg(F.min("_k").alias("run_start"), F.max("_k").alias("run_end")).drop("_island")


def match_runs(keys: DataFrame, runs: DataFrame, by: list[str], key: str = "ref_key") -> DataFrame:
    """``keys`` with ``is_present``: an as-of match of each key to the preceding run start."""
    block = F.shiftright(F.col(key), BLOCK_BITS)
    probes = keys.withColumns({"block": block, "_at": F.col(key), "_end": F.lit(None).cast("long"), "_probe": F.lit(1)})
    starts = runs.select(*by, "block", F.col("run_start").alias("_at"), F.col("run_end").alias("_end"), F.lit(0).alias("_probe"))
    order = Window.partitionBy(*by, "block").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    joined = probes.unionByName(starts, allowMissingColumns=True).withColumn("_run_end", F.last("_end", ignorenulls=True).over(order))
    return (
        joined.where("_probe = 1")
        .withColumn("is_present", F.coalesce(F.col(key) <= F.col("_run_end"), F.lit(False)))
        .drop("block", "_at", "_end", "_probe", "_run_end")
    )


def find_orphans(references: list[Reference], deletions: DataFrame) -> DataFrame:
    """All dangling references: ``table_name, column_name, row_id, period, reason``.

    ``deletions`` has ``table_name`` and ``record_id``. ``reason`` is ``missing``,
    ``deleted`` or ``late``.
    """
    refs = reduce(
        DataFrame.unionByName,
        [
            r.child.where(F.col(r.column).isNotNull()).select(
                F.lit(r.table_name).alias("table_name"),
                F.lit(r.column).alias("column_name"),
                F.lit(r.parent_name).alias("parent"),
                F.col(r.row_id).cast("long").alias("row_id"),
                F.col(r.column).cast("long").alias("ref_key"),
                F.col(r.created_at).alias("ref_at"),
            )
            for r in references
        ],
    )
    seen: dict[str, Reference] = {}
    for r in references:
        seen.setdefault(r.parent_name, r)
    parents = reduce(
        DataFrame.unionByName,
        [
            r.parent.where(F.col(r.parent_key).isNotNull()).select(
                F.lit(name).alias("parent"), F.col(r.parent_key).cast("long").alias("ref_key"), F.col(r.parent_created_at).alias("parent_at")
            )
            for name, r in seen.items()
        ],
    )
    by_key = refs.groupBy("parent", "ref_key").agg(F.min("ref_at").alias("first_ref_at"))
    matched = match_runs(by_key, key_runs(parents, "ref_key", ["parent"]), ["parent"])

    deleted = (
        deletions.where(F.col("record_id").isNotNull())
        .select(F.col("table_name").alias("parent"), F.col("record_id").cast("long").alias("ref_key"))
        .distinct()
        .withColumn("was_deleted", F.lit(True))
    )
    gone = (
        matched.where(~F.col("is_present"))
        .join(deleted, ["parent", "ref_key"], "left")
        .select("parent", "ref_key", F.when(F.col("was_deleted"), "deleted").otherwise("missing").alias("reason"), F.lit(None).cast("timestamp").alias("parent_at"))
    )
    created = parents.groupBy("parent", "ref_key").agg(F.min("parent_at").alias("parent_at"))
    young = (
        matched.where("is_present AND first_ref_at IS NOT NULL")
        .join(created, ["parent", "ref_key"])
        .where("parent_at > first_ref_at")
        .select("parent", "ref_key", F.lit("late").alias("reason"), "parent_at")
    )
    # Keys without a defect have left by now; what returns to the rows is small, one row per key.
    return (
        refs.join(gone.unionByName(young), ["parent", "ref_key"])
        .where("reason <> 'late' OR parent_at > ref_at")
        .select(
            "table_name",
            "column_name",
            "row_id",
            F.coalesce(F.date_format(F.to_utc_timestamp("ref_at", F.current_timezone()), "yyyy-MM"), F.lit("unknown")).alias("period"),
            "reason",
        )
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, column, period and reason, for the report by table and month."""
    return orphans.groupBy("table_name", "column_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_references"))
