"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fumiyori.llm.bpe import encode_corpus
from fumiyori.llm.canonical import match_places
from fumiyori.llm.leakage import leaked_passages, merge_spans
from fumiyori.llm.lookalike import same_look
from fumiyori.llm.mojibake import damaged_rows
from fumiyori.llm.names import name_groups, same_names
from fumiyori.llm.residue import residue_windows
from fumiyori.llm.sentences import reordered, split_sentences
from fumiyori.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every row that holds at least two."""
    units = split_sentences(read_table(spark, sf_dir, "sentences").where("sentence_id IS NOT NULL"), ["sentence_id"], "sentence_text")
    return units.where("n_parts >= 2").select("sentence_id", "char_start", "char_end")


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentence units with their new order within the work."""
    return reordered(read_table(spark, sf_dir, "sentences"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical place of every mention and alias without a master, -1 for none."""
    return match_places(*(read_table(spark, sf_dir, t) for t in ("sentence_places", "place_aliases", "place_masters")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that look the same and differ in characters."""
    return same_look(read_table(spark, sf_dir, "place_masters"), read_table(spark, sf_dir, "sentence_places"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and titles with text from a wrong encoding."""
    return p4_restored(spark, sf_dir).select("source_table", "source_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the restored text, null where it cannot be restored."""
    return damaged_rows(read_table(spark, sf_dir, "sentences"), read_table(spark, sf_dir, "works"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author rows that mean the same person or organisation."""
    return same_names(read_table(spark, sf_dir, "authors"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author row that shares a name with another, and its group's first row."""
    return name_groups(read_table(spark, sf_dir, "authors")).selectExpr("id AS author_id", "`group` AS group_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they contain at least half of."""
    return p9_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages themselves, in positions of the bare text."""
    return leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches to remove from each document."""
    return merge_spans(p9_passages(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, error pages or notices."""
    return p10_windows(spark, sf_dir).select("doc_id").distinct()


def p10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residue itself with the label of the exemplar."""
    return residue_windows(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_sentences, p2_found, p3_found, p4_found, p4_restored, p5_found, p5_members, p8_ids, p9_found, p9_passages, p9_spans, p10_found, p10_windows)
}
#: None of these is expressed in SQL: tests compare them with brute force, round trips and a public encoder.
ORACLES: dict[str, str] = {}
