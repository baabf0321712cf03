"""Reads and writes of single records and statistics, as functions that return frames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyori.operators import merging, statistics
from fumiyori.session import read_table


class EngineError(Exception):
    """Base of this package's errors, with a code."""

    code = "engine_error"


class NotFound(EngineError):
    code = "not_found"


class InvalidConfig(EngineError):
    code = "invalid_config"


@dataclass
class Config:
    """Settings; later sources win: defaults, environment, a mapping."""

    folder: str = "."
    min_confidence: float = 0.7
    sentence_min: int = 3
    sentence_max: int = 500
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, environment: dict[str, str] | None = None, mapping: dict | None = None) -> Config:
        config = cls()
        for source in ({k.removeprefix("FUMIYORI_").lower(): v for k, v in (environment or {}).items() if k.startswith("FUMIYORI_")}, mapping or {}):
            for key, value in source.items():
                if hasattr(config, key) and key != "extra":
                    setattr(config, key, type(getattr(config, key))(value))
                else:
                    config.extra[key] = value
        return config

    def validate(self) -> list[str]:
        """What is wrong with the settings; empty if nothing."""
        problems = []
        if not 0 <= self.min_confidence <= 1:
            problems.append("min_confidence must lie between 0 and 1")
        if self.sentence_min > self.sentence_max:
            problems.append("sentence_min must not exceed sentence_max")
        return problems


KEYS = {"authors": "author_id", "works": "work_id", "sentences": "sentence_id", "place_masters": "master_id", "place_aliases": "alias_id", "sentence_places": "relation_id"}


class Store:
    """The tables of a folder. Writes return the next version of a table; nothing is changed in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        if name not in KEYS:
            raise NotFound(name)
        return read_table(self.spark, self.folder, name)

    def get(self, name: str, key: int) -> DataFrame:
        return self.table(name).where(F.col(KEYS[name]) == key)

    def find(self, name: str, **values) -> DataFrame:
        found = self.table(name)
        for column, value in values.items():
            found = found.where(F.col(column).eqNullSafe(F.lit(value)))
        return found

    def create(self, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """The table with further rows and fresh ids."""
        existing = self.table(name)
        return existing.unionByName(merging.assign_ids(rows, existing, KEYS[name], order), allowMissingColumns=True)

    def update(self, name: str, changes: DataFrame) -> DataFrame:
        return merging.patch(self.table(name), changes, KEYS[name])

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        return merging.delete_matching(self.table(name), keys, KEYS[name])

    def author_stats(self, author_id: int) -> DataFrame:
        """Works, sentences, mentions and distinct places of an author."""
        works = self.table("works").where(F.col("author_id") == author_id).select("work_id", "sentence_count")
        sentences = self.table("sentences").join(works.select("work_id"), "work_id").select("sentence_id")
        places = self.table("sentence_places").join(sentences, "sentence_id").agg(F.count(F.lit(1)).alias("total_places"), F.countDistinct("master_id").alias("unique_places"))
        totals = works.agg(F.count(F.lit(1)).alias("works_count"), F.coalesce(F.sum("sentence_count"), F.lit(0)).alias("total_sentences"))
        return totals.withColumn("k", F.lit(1)).join(places.withColumn("k", F.lit(1)), "k").drop("k")

    def work_stats(self, work_id: int) -> DataFrame:
        return statistics.work_rollup(self.get("works", work_id), self.table("sentences").where(F.col("work_id") == work_id), self.table("sentence_places"))

    def reset(self, *names: str) -> dict[str, DataFrame]:
        """Empty tables of the same columns, to be written over the ones that start anew."""
        return {name: self.table(name).where("false") for name in names}

    def snapshot(self, name: str, to: str) -> None:
        """A backup of a table in another folder."""
        self.table(name).write.mode("overwrite").parquet(f"{to}/{name}.parquet")


class Cache:
    """Frames kept for repeated reads, by key, for a number of seconds; writes invalidate keys by prefix."""

    def __init__(self, seconds: float = 3600, now: Callable[[], float] = time.monotonic):
        self.seconds, self.now = seconds, now
        self._kept: dict[str, tuple[float, DataFrame]] = {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame kept under ``key``, made anew if there is none or it is too old."""
        made, df = self._kept.get(key, (0.0, None))
        if df is None or self.now() - made >= self.seconds:
            self.invalidate(key)
            df = make().persist()
            self._kept[key] = self.now(), df
        return df

    def invalidate(self, prefix: str = "") -> int:
        """Drops the frames whose key begins so; how many there were."""
        gone = [key for key in self._kept if key.startswith(prefix)]
        for key in gone:
            self._kept.pop(key)[1].unpersist()
        return len(gone)


def answered(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a stored reply, requests still to be asked) by md5 of kind and text."""
    from fumiyori.functions.text import cache_key

    keyed = requests.withColumn("key", cache_key(F.col("api"), F.col("text")))
    return keyed.join(replies, "key"), keyed.join(replies.select("key"), "key", "left_anti")
