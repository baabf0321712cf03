"""Inserts, upserts and deletes as the next version of a table.

Parquet has no update in place; every function returns the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyori.operators.sizing import broadcast_if_small
from fumiyori.session import cut_lineage

#: Rows that one task numbers; ids come from counts per range, so no single task sees all rows.
ID_ROWS = 1_000_000


def assign_ids(new: DataFrame, existing: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """``new`` with ids after the highest existing one, in a fixed order, without one task over all rows.

    Rows are split by ranges of the order columns, about one per :data:`ID_ROWS` rows; a range's
    ids start after the rows of the ranges before it (one count per range). The ranges are
    written before they are counted, so both readings see the same.
    """
    start = existing.agg(F.max(id_col)).first()[0] or 0  # one number
    fresh = new.drop(id_col)
    ranges = max(1, -(-fresh.count() // ID_ROWS))
    placed = cut_lineage(fresh.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()))
    numbered = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = numbered.groupBy("_p").agg(F.max("_n").alias("_size"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    # One row a range of a million rows.
    return numbered.join(broadcast_if_small(offsets), "_p").withColumn(id_col, F.lit(int(start)) + F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def get_or_create(existing: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """``existing`` with the incoming rows whose key is new, one row a key, with fresh ids."""
    fresh = incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing, key, "left_anti")
    return existing.unionByName(assign_ids(fresh, existing, id_col, [key]), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, overwrite_nulls: bool = False) -> DataFrame:
    """Full outer merge on ``key``: incoming values win; null ones only if asked."""
    new = incoming.select(*(F.col(c).alias(f"_{c}") for c in incoming.columns), F.lit(True).alias("_is_new"))
    merged = existing.withColumn("_is_old", F.lit(True)).join(new, F.col(key) == F.col(f"_{key}"), "full_outer")

    def value(c: str):
        if c not in incoming.columns:
            return F.col(c)
        kept = F.when(F.col("_is_new"), F.col(f"_{c}")).otherwise(F.col(c)) if overwrite_nulls else F.coalesce(F.col(f"_{c}"), F.col(c))
        return kept.alias(c)

    return merged.select(*(value(c) for c in existing.columns))


def classify_sync(existing: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``key, change``: new, updated or same for every incoming row."""
    old = existing.select(key, *(F.col(c).alias(f"_{c}") for c in compared), F.lit(True).alias("_old"))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return incoming.join(old, key, "left").select(key, F.when(F.col("_old").isNull(), "new").when(differs, "updated").otherwise("same").alias("change"))


def insert_or_replace(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last row by ``sequence`` of every key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.col(sequence)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in columns)).select(*rows.columns)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-null values of ``changes`` by key."""
    columns = [c for c in changes.columns if c != key]
    other = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(other, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def delete_matching(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``base`` without the rows whose key is in ``gone``."""
    return base.join(gone.select(key).distinct(), key, "left_anti")


def reject_places(masters: DataFrame, mentions: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masters with rejected states, mentions left, report name/n_relations/found) of a logical deletion by name."""
    listed = names.select(F.col("name").alias("display_name")).distinct()
    ids = masters.join(listed, "display_name", "left_semi").select("master_id", "display_name")
    marked = masters.join(ids.select("master_id", F.lit("rejected").alias("_s")), "master_id", "left").withColumn("validation_status", F.coalesce("_s", "validation_status")).drop("_s")
    counts = mentions.join(ids, "master_id").groupBy("display_name").agg(F.count(F.lit(1)).alias("n_relations"))
    report = listed.join(ids.select("display_name").distinct().withColumn("found", F.lit(True)), "display_name", "left").join(counts, "display_name", "left").select(F.col("display_name").alias("name"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"), F.coalesce("found", F.lit(False)).alias("found"))
    return marked, delete_matching(mentions, ids, "master_id"), report


def touch(before: DataFrame, after: DataFrame, key: str, now: Column, column: str = "updated_at") -> DataFrame:
    """``after`` with ``column`` set to ``now`` in rows that differ from the row of the same key in ``before``."""
    compared = [c for c in after.columns if c != column and c in before.columns and c != key]
    old = before.select(key, F.struct(*(F.col(c) for c in compared)).alias("_old"))
    changed = ~F.col("_old").eqNullSafe(F.struct(*(F.col(c) for c in compared)))
    return after.join(old, key, "left").withColumn(column, F.when(changed, now).otherwise(F.col(column))).drop("_old").select(*after.columns)


def consolidation(old: DataFrame, new: DataFrame) -> str:
    """What to do with two tables of the same kind: ``nothing``, ``keep new``, ``take over`` or ``refuse`` (both hold rows)."""
    has_old, has_new = (not df.limit(1).isEmpty() for df in (old, new))
    return {(False, False): "nothing", (False, True): "keep new", (True, False): "take over", (True, True): "refuse"}[has_old, has_new]


def usage_statistics(masters: DataFrame, mentions: DataFrame) -> DataFrame:
    """Masters with ``usage_count, first_used_at, last_used_at`` recomputed from the mentions."""
    used = mentions.where("master_id IS NOT NULL").groupBy("master_id").agg(F.count(F.lit(1)).alias("usage_count"), F.min("created_at").alias("first_used_at"), F.max("created_at").alias("last_used_at"))
    return masters.select("master_id").join(used, "master_id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
