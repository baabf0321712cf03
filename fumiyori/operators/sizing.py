"""Broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast here (of a few dozen bytes each: some tens of MB at most).
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if counting shows at most ``max_rows`` rows.

    Otherwise ``df`` unchanged: the join is then a shuffle join that AQE splits where
    a key is hot. The count stops at ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than the cluster has cores.

    For steps that cost much CPU a row. A large table has partitions enough and is left as it
    is, so only small ones are ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
