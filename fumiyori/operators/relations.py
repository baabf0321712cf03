"""Joins and windows over the star of authors, works, sentences, masters and mentions.

Counts per key are aggregated and joined back, not windowed, because a window cannot split a
key that holds a third of the rows while a join can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Order values that one window partition holds; a long work is cut into such blocks, so no task sees all of it.
BLOCK = 4096


def context_windows(sentences: DataFrame, reach: int = 2) -> DataFrame:
    """``sentence_id, context_before, context_after``: texts of the neighbours by order value, null if none.

    A work is cut into blocks of order values; rows near a border are also given to the block
    beyond it as neighbours. A sentence without an order has no neighbours. Texts at one place
    are joined in the order of their ids.
    """
    place = F.col("sentence_order").cast("long")
    at = lambda o: F.floor(o / BLOCK)
    blocks = F.when(place.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(at(place), at(place - reach), at(place + reach))))
    rows = sentences.select("sentence_id", "work_id", "sentence_text", place.alias("_o"), F.explode(blocks).alias("_block"))
    order = Window.partitionBy("work_id", "_block").orderBy("_o")
    joined = lambda a, b: F.when(F.col("_o").isNotNull(), F.nullif(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_o", "sentence_id", "sentence_text")).over(order.rangeBetween(a, b))), lambda x: x["sentence_text"])), F.lit("")))
    found = rows.select("sentence_id", "_o", "_block", joined(-reach, -1).alias("context_before"), joined(1, reach).alias("context_after"))
    return found.where(F.col("_o").isNull() | (F.col("_block") == at(F.col("_o")))).drop("_o", "_block")


def block_ranks(rows: DataFrame, group: str, block: list[Column], order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank within ``group``: the rank within a block, plus the rows of the blocks before it.

    ``block`` are expressions that rise with ``order``; only one row a block meets in the window over a whole group.
    """
    keys = [f"_b{i}" for i in range(len(block))]
    placed = rows.withColumns(dict(zip(keys, block, strict=True)))
    sizes = placed.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    other = before.select(F.col(group).alias("_g"), *(F.col(k).alias(f"{k}_") for k in keys), "_before")
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy(group, *keys).orderBy(*order)))
    same = F.col(group).eqNullSafe(F.col("_g"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return ranked.join(other, same).withColumn(name, (F.col("_r") + F.col("_before")).cast("int")).select(*rows.columns, name)


def sentence_positions(sentences: DataFrame) -> DataFrame:
    """``sentence_id, sentence_position``: the rank of the id within its work."""
    rows = sentences.select("sentence_id", "work_id")
    return block_ranks(rows, "work_id", [F.floor(F.col("sentence_id") / BLOCK)], ["sentence_id"], "sentence_position").select("sentence_id", "sentence_position")


def star(mentions: DataFrame, sentences: DataFrame, works: DataFrame, authors: DataFrame, how: str = "inner") -> DataFrame:
    """Mentions with their sentence, work and author."""
    return (
        mentions.join(sentences.select("sentence_id", "work_id", "sentence_order", "sentence_text"), "sentence_id", how)
        .join(works.select("work_id", F.col("title").alias("work_title"), "author_id", F.col("publication_year").alias("work_publication_year")), "work_id", how)
        .join(authors.select("author_id", "author_name", F.col("birth_year").alias("author_birth_year"), F.col("death_year").alias("author_death_year")), "author_id", how)
    )


def place_frequencies(mentions: DataFrame, sentences: DataFrame, works: DataFrame) -> DataFrame:
    """``relation_id`` with the numbers of mentions of the same master in the same work and by the same author."""
    placed = mentions.where("master_id IS NOT NULL").select("relation_id", "sentence_id", "master_id").join(sentences.select("sentence_id", "work_id"), "sentence_id").join(works.select("work_id", "author_id"), "work_id")
    in_work = placed.groupBy("work_id", "author_id", "master_id").agg(F.count(F.lit(1)).alias("place_frequency_in_work"))
    # The author's count adds up the works' counts: no second pass over the mentions.
    by_author = in_work.groupBy("author_id", "master_id").agg(F.sum("place_frequency_in_work").alias("place_frequency_by_author"))
    counts = in_work.join(by_author, ["author_id", "master_id"])
    return placed.join(counts.drop("author_id"), ["work_id", "master_id"]).select("relation_id", "place_frequency_in_work", "place_frequency_by_author")


def enrich_mentions(mentions: DataFrame, sentences: DataFrame, works: DataFrame, authors: DataFrame, masters: DataFrame) -> DataFrame:
    """The denormalised mention: context, attributes, positions and frequencies."""
    return (
        star(mentions.select("relation_id", "sentence_id", "master_id", "matched_text"), sentences, works, authors)
        .join(context_windows(sentences), "sentence_id", "left")
        .join(sentence_positions(sentences), "sentence_id", "left")
        .join(place_frequencies(mentions, sentences, works), "relation_id", "left")
        .join(masters.select("master_id", F.col("display_name").alias("place_name")), "master_id", "left")
        .withColumn("position_in_sentence", F.instr("sentence_text", F.col("matched_text")) - 1)
    )


def refill(base: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the nulls of some columns filled from ``source``; filled values stay."""
    other = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(other, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in base.columns))


def name_key(c: Column) -> Column:
    """A name without blanks."""
    return F.translate(c, " 　", "")


def match_names(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """The best partner of every left row: the same name, else the same without blanks; the lowest id of equals."""
    a = left.select(F.col(left_id).alias("_l"), F.col(left_name).alias("_ln")).withColumn("_k", name_key(F.col("_ln")))
    b = right.select(F.col(right_id).alias("_r"), F.col(right_name).alias("_rn")).withColumn("_k", name_key(F.col("_rn")))
    met = a.join(b, "_k").withColumn("match", F.when(F.col("_ln") == F.col("_rn"), "exact").otherwise("fuzzy"))
    best = met.groupBy("_l").agg(F.min(F.struct("match", F.col("_r").alias("partner"))).alias("m"))
    return best.select(F.col("_l").alias(left_id), F.col("m.partner").alias("partner_id"), F.col("m.match").alias("match"))


def author_patterns(c: Column) -> Column:
    """Spellings to look an author up by, in order: as is, cut after two, cut after one."""
    n = F.length(c)
    cut = lambda k: F.concat(F.substring(c, 1, k), F.lit(" "), F.substring(c, F.lit(k + 1), n))
    return F.array_compact(F.array(c, F.when(n >= 4, cut(2)), F.when(n >= 3, cut(1))))


def match_authors(names: DataFrame, authors: DataFrame, name: str = "name") -> DataFrame:
    """``name, author_id``: the first pattern that is an author, else the first author whose name has the surname; empty names find nobody."""
    wanted = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    tried = wanted.select("name", F.posexplode(author_patterns(F.col("name"))).alias("rank", "author_name"))
    found = tried.join(authors.select("author_name", "author_id"), "author_name").groupBy("name").agg(F.min_by("author_id", F.struct("rank", "author_id")).alias("author_id"))
    rest = wanted.join(found, "name", "left_anti").withColumn("surname", F.when(F.col("name").rlike("[ 　]"), F.regexp_extract("name", "^[^ 　]+", 0)).otherwise(F.substring("name", 1, 2)))
    # A surname meets the names that have its rarest pair of characters (or its only character), so no loop over all names is needed.
    spelled = authors.where("author_name <> ''").groupBy("author_name").agg(F.min("author_id").alias("author_id"))
    first = containing(rest.select("surname"), "surname", spelled, "author_name").groupBy("surname").agg(F.min("author_id").alias("author_id"))
    return found.unionByName(rest.join(first, "surname").select("name", "author_id"))


def containing(probes: DataFrame, part: str, rows: DataFrame, whole: str) -> DataFrame:
    """The distinct strings ``part`` of ``probes`` with all ``rows`` whose ``whole`` they lie within.

    Strings meet by equality on one pair of characters of ``part``, the one that the fewest
    wholes have; parts of one character meet on that character. Empty parts meet nothing.
    """
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    grams = lambda c: F.array_distinct(F.when(F.length(c) >= 2, pairs(c)).otherwise(F.array()))
    letters = F.array_distinct(F.split(F.col(whole), ""))
    parts = probes.where(F.length(part) > 0).select(part).distinct()
    # Single characters are indexed only if some part is one.
    singles = rows.select(F.explode(letters).alias("_gram"), *rows.columns).join(parts.where(F.length(part) == 1).select(F.col(part).alias("_gram")), "_gram", "left_semi")
    index = rows.select(F.explode(grams(F.col(whole))).alias("_gram"), *rows.columns).unionByName(singles)
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keyed = parts.select(part, F.explode(F.when(F.length(part) >= 2, grams(F.col(part))).otherwise(F.array(F.col(part)))).alias("_gram"))
    # A gram that no whole has rules its part out.
    rarest = keyed.join(counts, "_gram", "left").groupBy(part).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("g")).where("g.n > 0").select(part, F.col("g.gram").alias("_gram"))
    return rarest.join(index, "_gram").where(F.col(whole).contains(F.col(part))).select(part, *rows.columns)
