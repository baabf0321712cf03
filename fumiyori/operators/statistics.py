"""Aggregations over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyori.functions.scoring import coordinate, verdict


#: Ids of sentences whose uses meet in one window partition.
CONTEXT_BLOCK = 65_536


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def place_statistics(masters: DataFrame, mentions: DataFrame, sentences: DataFrame, works: DataFrame) -> DataFrame:
    """Mentions, sentences, works and authors of every master, unmentioned ones with zeros.

    Mentions are counted per (master, work) first, so a master with a third of the mentions
    reaches the last step as one row a work.
    """
    used = mentions.where("master_id IS NOT NULL").select("relation_id", "sentence_id", "master_id")
    # A sentence belongs to one work, so sentences may be counted within works and added up.
    placed = used.join(sentences.select(F.col("sentence_id"), "work_id"), "sentence_id", "left")
    per_sentence = placed.groupBy("master_id", "work_id", "sentence_id").agg(F.count("relation_id").alias("n"))
    per_work = per_sentence.groupBy("master_id", "work_id").agg(F.sum("n").alias("n"), F.count("sentence_id").alias("s"))
    authored = per_work.join(works.select("work_id", "author_id"), "work_id", "left")
    totals = authored.groupBy("master_id").agg(F.sum("n").alias("mention_count"), F.sum("s").alias("sentence_count"), F.count(F.when(F.col("author_id").isNotNull() | F.col("work_id").isNotNull(), F.col("work_id"))).alias("work_count"), F.countDistinct("author_id").alias("author_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return masters.select("master_id", "display_name", "place_type").join(totals, "master_id", "left").select("master_id", "display_name", "place_type", *map(zero, ("mention_count", "sentence_count", "work_count", "author_count")))


def master_summary(masters: DataFrame) -> DataFrame:
    n, geo = F.count(F.lit(1)), F.count(coordinate("latitude"))
    return masters.agg(n.alias("total_masters"), geo.alias("geocoded"), F.count_if(F.col("validation_status") == "validated").alias("validated"), F.coalesce(F.sum("usage_count"), F.lit(0)).alias("total_usage"), rate(geo, n).alias("geocoding_rate"))


def distribution(df: DataFrame, column: str, null_as: str | None = None) -> DataFrame:
    """Counts by value; nulls left out or under a name."""
    value = F.col(column) if null_as is None else F.coalesce(column, F.lit(null_as))
    return df.where(value.isNotNull()).groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def geocoding_statistics(masters: DataFrame) -> DataFrame:
    both = coordinate("latitude").isNotNull() & coordinate("longitude").isNotNull()
    c = F.col("geocoding_confidence")
    return masters.agg(F.count(F.lit(1)).alias("total"), F.count_if(both).alias("geocoded"), F.count_if(both & (c >= 0.9)).alias("high"), F.count_if(both & (c >= 0.7) & (c < 0.9)).alias("medium"), rate(F.count_if(both), F.count(F.lit(1))).alias("success_rate"))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, null_count, completion_rate`` of columns, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns)))
    return one.select("_n", cells.alias("c")).select("c.column_name", "c.null_count", rate(F.col("_n") - F.col("c.null_count"), F.col("_n")).alias("completion_rate"))


def punctuation_audit(sentences: DataFrame, text: str = "sentence_text") -> DataFrame:
    c, n = F.col(text), F.count(F.lit(1))
    ends = lambda m: F.count_if(c.endswith(m))
    marked = ends("。") + ends("！") + ends("？")
    share = rate(marked, n)
    return sentences.agg(n.alias("total"), ends("。").alias("full_stops"), ends("！").alias("exclamations"), ends("？").alias("questions"), F.round(F.avg(F.length(c)), 4).alias("avg_length"), share.alias("punctuation_rate"), F.when(share >= 95, "good").when(share >= 80, "fair").otherwise("poor").alias("grade"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of tables, one row each."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))


def author_rollup(authors: DataFrame, works: DataFrame) -> DataFrame:
    per = works.groupBy("author_id").agg(F.count(F.lit(1)).alias("works_count"), F.sum("sentence_count").alias("total_sentences"))
    return authors.select("author_id", "author_name").join(per, "author_id", "left").select("author_id", "author_name", F.coalesce("works_count", F.lit(0)).alias("works_count"), F.coalesce("total_sentences", F.lit(0)).alias("total_sentences"))


def work_rollup(works: DataFrame, sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Sentences, mentions, distinct places and mean confidence of every work."""
    s = sentences.groupBy("work_id").agg(F.count(F.lit(1)).alias("sentence_count"), F.coalesce(F.sum(F.length("sentence_text")), F.lit(0)).alias("content_length"))
    by_master = mentions.join(sentences.select("sentence_id", "work_id"), "sentence_id").groupBy("work_id", "master_id").agg(F.count(F.lit(1)).alias("n"), F.sum("extraction_confidence").alias("c"), F.count("extraction_confidence").alias("k"))
    m = by_master.groupBy("work_id").agg(F.sum("n").alias("place_count"), F.count("master_id").alias("unique_places"), F.round(F.sum("c") / F.nullif(F.sum("k"), F.lit(0)), 9).alias("average_confidence"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return works.select("work_id").join(s, "work_id", "left").join(m, "work_id", "left").select("work_id", zero("sentence_count"), zero("content_length"), zero("place_count"), zero("unique_places"), "average_confidence")


def ungeocoded_usage(masters: DataFrame, mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Places without coordinates: how often they are used, and one sample sentence (the least text)."""
    missing = masters.where(coordinate("latitude").isNull() | coordinate("longitude").isNull()).select("master_id", "display_name")
    texts = mentions.select("master_id", "sentence_id").join(missing.select("master_id"), "master_id", "left_semi").join(sentences.select("sentence_id", "sentence_text"), "sentence_id")
    used = texts.groupBy("master_id").agg(F.count(F.lit(1)).alias("usage_count"), F.min("sentence_text").alias("sample_text"))
    return missing.join(used, "master_id", "left").select("master_id", "display_name", F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "sample_text")


def verification_worklist(masters: DataFrame, mentions: DataFrame, sentences: DataFrame, limit: int = 20, contexts: int = 5) -> DataFrame:
    """The least used unverified places with up to ``contexts`` first sentences (a top-k report).

    Only the smallest ids of every block of ids are kept, so a popular place never gathers all its texts.
    """
    open_ = masters.where("validation_status IS NULL OR validation_status <> 'validated'").select("master_id", "display_name", "geocoding_confidence")
    counts = mentions.groupBy("master_id").agg(F.count(F.lit(1)).alias("usage_count"))
    top = open_.join(counts, "master_id").orderBy(F.col("usage_count").asc(), F.col("geocoding_confidence").asc_nulls_first(), "master_id").limit(limit)
    # The first sentences of every block of ids, then of those the first: what is gathered is a few rows a block.
    used = mentions.join(F.broadcast(top.select("master_id")), "master_id").select("master_id", "sentence_id").join(sentences.select("sentence_id"), "sentence_id", "left_semi").distinct()
    first = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("sentence_id"))).where(F.col("_r") <= contexts).drop("_r")
    kept = first(first(used.withColumn("_block", F.floor(F.col("sentence_id") / CONTEXT_BLOCK)), "master_id", "_block"), "master_id").select("master_id", "sentence_id")
    lines = kept.join(sentences.select("sentence_id", "sentence_text"), "sentence_id")
    texts = lines.groupBy("master_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("sentence_id", "sentence_text"))), 1, contexts).alias("c"))
    return top.join(texts, "master_id", "left").select("master_id", "display_name", "usage_count", F.size("c").alias("n_contexts"), F.concat_ws("|||", F.transform("c", lambda s: s.sentence_text)).alias("contexts"))


def alias_text(masters: DataFrame, aliases: DataFrame) -> DataFrame:
    """``master_id, aliases``: alias names in order, joined by blanks."""
    names = aliases.where("master_id IS NOT NULL").groupBy("master_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("alias_name"))).alias("aliases"))
    return masters.select("master_id").join(names, "master_id", "left").select("master_id", F.coalesce("aliases", F.lit("")).alias("aliases"))


def metrics_in_range(events: DataFrame, start: str, end: str) -> DataFrame:
    """Count and mean value by kind of event between two times, ends included."""
    return events.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("value"), 6), F.lit(0.0)).alias("avg_value"))


def alerts(events: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """Latest value of every kind that breaks its threshold (``<`` or ``>``)."""
    last = events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    rules = events.sparkSession.createDataFrame([(k, op, float(t)) for k, (op, t) in thresholds.items()], "event_type string, op string, threshold double")
    return last.join(F.broadcast(rules), "event_type").where("(op = '<' AND value < threshold) OR (op = '>' AND value > threshold)").select("event_type", "value", "threshold")


def recorders(events: DataFrame, kind: str, value: str, order: list[str], bounds: list[float]) -> DataFrame:
    """Counter, gauge and histogram of every kind: ``kind, total, last_value, sum_value, le_...`` (cumulative counts up to each bound)."""
    v = F.col(value)
    buckets = [F.count_if(v <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.max_by(value, F.struct(*order)).alias("last_value"), F.round(F.sum(v), 6).alias("sum_value"), *buckets)


def author_details(authors: DataFrame, works: DataFrame, sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """``author_id, works_count, total_sentences, total_places, unique_places`` of every author."""
    placed = mentions.select("sentence_id", "master_id").join(sentences.select("sentence_id", "work_id"), "sentence_id").groupBy("work_id", "master_id").agg(F.count(F.lit(1)).alias("n"))
    s = sentences.groupBy("work_id").agg(F.count(F.lit(1)).alias("s"))
    by_work = works.where("author_id IS NOT NULL").select("author_id", "work_id").join(s, "work_id", "left").groupBy("author_id").agg(F.count(F.lit(1)).alias("works_count"), F.sum("s").alias("total_sentences"))
    by_place = works.select("author_id", "work_id").join(placed, "work_id").groupBy("author_id", "master_id").agg(F.sum("n").alias("n")).groupBy("author_id").agg(F.sum("n").alias("total_places"), F.count("master_id").alias("unique_places"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return authors.select("author_id").join(by_work, "author_id", "left").join(by_place, "author_id", "left").select("author_id", *map(zero, ("works_count", "total_sentences", "total_places", "unique_places")))


def export_statistics(authors: DataFrame) -> DataFrame:
    """``entry, value, n``: authors, works, and authors by copyright state and section, as an export's metadata lists them (no works without their column)."""
    one = lambda entry, n: authors.agg(n.alias("n")).select(F.lit(entry).alias("entry"), F.lit(None).cast("string").alias("value"), "n")
    by = lambda entry, column: authors.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(entry).alias("entry"), "value", "n")
    return reduce(DataFrame.unionByName, (one("total_authors", F.count(F.lit(1))), one("total_works", F.coalesce(F.sum("aozora_works_count"), F.lit(0)) if "aozora_works_count" in authors.columns else F.lit(0).cast("long")), by("copyright_status", "copyright_status"), by("section", "section")))


def usage_actions(judged: DataFrame, key: str) -> DataFrame:
    """``key, n_uses, n_place, action`` of per-sentence verdicts (``is_place``)."""
    n, k = F.count(F.lit(1)), F.count_if("is_place")
    return judged.groupBy(key).agg(n.alias("n_uses"), k.alias("n_place")).withColumn("action", F.when(F.col("n_uses") == 0, "削除推奨: 使用例なし").when(F.col("n_place") == 0, "削除推奨").when(F.col("n_place") / F.col("n_uses") < 0.5, "削除検討").otherwise("保持推奨"))


def place_verdicts(judged: DataFrame, key: str) -> DataFrame:
    """``key, n, is_valid, confidence, action, place_type`` of per-context analyses ``is_place, confidence, place_type``.

    ``place_type`` is the one most analyses give, of equally frequent ones the last in the order of code points.
    """
    per_type = judged.groupBy(key, "place_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_place").alias("k"), F.sum("confidence").alias("c"))
    votes = per_type.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("c").alias("c"), F.max_by("place_type", F.struct("n", "place_type")).alias("place_type"))
    return votes.select(key, "n", verdict(F.col("n"), F.col("k"), F.col("c") / F.col("n")).alias("v"), "place_type").select(key, "n", "v.is_valid", "v.confidence", "v.action", "place_type")


def import_report(changes: DataFrame) -> DataFrame:
    """``processed, new, updated, same, success_rate`` of classified rows (``change``)."""
    n, of = F.count(F.lit(1)), lambda kind: F.count_if(F.col("change") == kind)
    return changes.agg(n.alias("processed"), *(of(kind).alias(kind) for kind in ("new", "updated", "same")), F.round((of("new") + of("updated")) * 100.0 / F.greatest(F.lit(1), n), 2).alias("success_rate"))


def run_report(steps: DataFrame) -> DataFrame:
    """Steps (``ok`` boolean, ``n_new``, ``n_sentences``, ``seconds``) as one row of totals and rates."""
    n, good = F.count(F.lit(1)), F.count_if("ok")
    return steps.agg(
        n.alias("processed"), good.alias("succeeded"), (n - good).alias("failed"), F.coalesce(F.sum("n_new"), F.lit(0)).alias("new_works"), F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("sentences"),
        rate(good, n).alias("success_rate"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.greatest(F.lit(1), F.sum("n_sentences")), 6).alias("seconds_per_sentence"),
    )
