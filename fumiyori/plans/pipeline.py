"""The whole way from pages to an enriched mention table, as one plan, and its command line.

Every step is a function from frames to frames; there is no loop over authors, works or
sentences, and the only driver boundary is the final write.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyori.functions import text as X
from fumiyori.functions.scoring import mention_quality, overall_quality, place_quality, sentence_quality
from fumiyori.operators import merging, relations, resolving, statistics
from fumiyori.session import build_session, cut_lineage, read_table
from fumiyori.sources import pages as P


def texts_of_pages(pages: DataFrame) -> DataFrame:
    """``work_id, text`` of pages (``work_id``, ``html``); pages without text are left out."""
    return pages.select("work_id", P.page_text(F.col("html")).alias("text")).where("text IS NOT NULL")


def known_works(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Works not yet in the table, by author and title: what a failed run still has to do."""
    return fetched.join(known.select("author_id", "title").distinct(), ["author_id", "title"], "left_anti")


def sentences_of_texts(texts: DataFrame, terminators: str = "。．！？", min_len: int = 3) -> DataFrame:
    """``work_id, sentence_order, sentence_text, char_count``."""
    cut = texts.select("work_id", F.posexplode(X.split_sentences(F.col("text"), terminators, min_len, None)))
    return cut.select("work_id", (F.col("pos") + 1).alias("sentence_order"), F.col("col").alias("sentence_text"), F.length("col").alias("char_count"))


def mentions_of_sentences(sentences: DataFrame, masters: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions by the dictionary tagger, resolved to masters: one row per sentence, master and text."""
    found = resolving.dictionary_candidates(sentences, masters.where("validation_status IS NULL OR validation_status <> 'rejected'"))
    # Names are resolved once each and joined back, so the candidates are read twice: they are written in between.
    best = cut_lineage(resolving.best_candidates(found.withColumn("ordinal", F.col("start")), ["sentence_id"]))
    resolved = resolving.resolve_masters(best.select(F.col("text").alias("name")), masters, aliases)
    return best.join(resolved.select(F.col("name").alias("text"), "master_id"), "text").where("master_id IS NOT NULL").select("sentence_id", "master_id", F.col("text").alias("matched_text"), F.col("start").alias("start_position"), F.col("end").alias("end_position"), F.col("confidence").alias("extraction_confidence"))


def quality_of_mentions(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """``relation_id, quality_score`` of mentions."""
    m = mentions.join(sentences.select("sentence_id", "sentence_text"), "sentence_id")
    name = F.col("matched_text")
    return m.select("relation_id", overall_quality(sentence_quality(F.col("sentence_text")), place_quality(name, F.col("extraction_confidence")), mention_quality(name, F.col("sentence_text"))).alias("quality_score"))


def run(spark: SparkSession, sf_dir: str, out: str) -> dict[str, str]:
    """Enriches the mentions of a data folder and writes them with the statistics; returns the paths."""
    t = lambda name: read_table(spark, sf_dir, name)
    enriched = relations.enrich_mentions(t("sentence_places"), t("sentences"), t("works"), t("authors"), t("place_masters"))
    quality = quality_of_mentions(t("sentence_places"), t("sentences"))
    results = {
        "mentions": enriched.join(quality, "relation_id", "left"),
        "usage": merging.usage_statistics(t("place_masters"), t("sentence_places")),
        "place_statistics": statistics.place_statistics(t("place_masters"), t("sentence_places"), t("sentences"), t("works")),
    }
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: f"{out}/{name}" for name in results}


def maintain(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """The maintenance steps in their order, each written under ``out``; ``step, state, n_rows, message`` of all of them.

    A step that fails is reported and does not keep the next from running.
    """
    t = lambda name: read_table(spark, sf_dir, name)
    works = lambda: t("works").select("work_id", "title", "author_id", F.nullif("publication_year", F.lit(0)).alias("publication_year"))
    steps = {
        "enrich_mentions": lambda: relations.enrich_mentions(t("sentence_places"), t("sentences"), t("works"), t("authors"), t("place_masters")),
        "works_metadata": lambda: statistics.work_rollup(t("works"), t("sentences"), t("sentence_places")),
        "publication_years": lambda: relations.refill(works(), works().groupBy("author_id").agg(F.max("publication_year").alias("publication_year")), "author_id", ["publication_year"]),
        "whole_sentences": lambda: t("sentence_places").drop("matched_text").join(t("sentences").select("sentence_id", F.col("sentence_text").alias("matched_text")), "sentence_id"),
        "usage": lambda: merging.usage_statistics(t("place_masters"), t("sentence_places")),
    }
    report = []
    for name, step in steps.items():
        try:
            step().write.mode("overwrite").parquet(f"{out}/{name}")
            report.append((name, "completed", spark.read.parquet(f"{out}/{name}").count(), None))
        except Exception as error:  # one step's failure is the report's matter
            report.append((name, "failed", None, str(error).split("\n", 1)[0]))
    return spark.createDataFrame(report, "step string, state string, n_rows long, message string")


def improvement(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, rate_before, rate_after`` of how completely columns are filled in two versions of a table."""
    rates = lambda df, name: statistics.null_audit(df, columns).select("column_name", F.col("completion_rate").alias(name))
    return rates(before, "rate_before").join(rates(after, "rate_after"), "column_name")


def delete_places(spark: SparkSession, sf_dir: str, out: str, names: list[str]) -> DataFrame:
    """Rejects places by name and writes masters and mentions as they are afterwards; a report by name."""
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    masters, mentions, report = merging.reject_places(read_table(spark, sf_dir, "place_masters"), read_table(spark, sf_dir, "sentence_places"), listed)
    masters.write.mode("overwrite").parquet(f"{out}/place_masters.parquet")
    mentions.write.mode("overwrite").parquet(f"{out}/sentence_places.parquet")
    return report


#: Verbs that show queries, and their queries.
REPORTS = {
    "status": ["author_progress"], "stats": ["master_summary", "geocoding_statistics", "author_statistics", "table_counts"], "sections": ["section_statistics"], "author-stats": ["author_details"],
    "cleanup": ["cleanup_candidates"], "verify": ["verification_split", "verification_worklist"], "usage": ["usage_actions"], "missing": ["missing_info", "completion_rates"],
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """``run DIR OUT``, ``maintain DIR OUT``, ``delete DIR OUT NAME...``, ``search-authors DIR NAME``, ``query NAME DIR``, or a verb of :data:`REPORTS` with ``DIR``."""
    from fumiyori.plans import catalogue

    parser = argparse.ArgumentParser(prog="fumiyori")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, arguments in (("run", ["folder", "out"]), ("maintain", ["folder", "out"]), ("delete", ["folder", "out"]), ("search-authors", ["folder", "name"]), ("query", ["name", "folder"]), *((verb, ["folder"]) for verb in REPORTS)):
        command = sub.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
        if name == "delete":
            command.add_argument("names", nargs="+")
    options = parser.parse_args(argv)
    spark = spark or build_session()
    if options.command == "run":
        print(run(spark, options.folder, options.out))
    elif options.command == "maintain":
        maintain(spark, options.folder, options.out).show(20, False)
    elif options.command == "delete":
        delete_places(spark, options.folder, options.out, options.names).show(50, False)
    elif options.command == "search-authors":
        authors = read_table(spark, options.folder, "authors")
        relations.match_authors(spark.createDataFrame([(options.name,)], "name string"), authors).join(authors, "author_id").show(50, False)
    elif options.command == "query":
        catalogue.QUERIES[options.name](spark, options.folder).show(50, False)
    else:
        for name in REPORTS[options.command]:
            catalogue.QUERIES[name](spark, options.folder).show(20, False)


if __name__ == "__main__":
    main()
