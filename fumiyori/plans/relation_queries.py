"""Queries of joins, windows, statistics, filters and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyori.functions.scoring import coordinate
from fumiyori.operators import merging as M
from fumiyori.operators import relations as R
from fumiyori.operators import statistics as S
from fumiyori.session import read_table

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark tables -> DataFrame) under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: read_table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        Q[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


# --- joins and windows ---------------------------------------------------------------

_BEFORE_AFTER = "string_agg(sentence_text, '' ORDER BY sentence_order, sentence_id) OVER (PARTITION BY work_id ORDER BY sentence_order RANGE BETWEEN {} AND {})"
_CONTEXTS = f"SELECT sentence_id, {_BEFORE_AFTER.format('2 PRECEDING', '1 PRECEDING')} AS context_before, {_BEFORE_AFTER.format('1 FOLLOWING', '2 FOLLOWING')} AS context_after FROM sentences"
#: A coordinate in SQL: NaN stands for none.
_LAT, _LON = ("CASE WHEN NOT isnan({0}) THEN {0} END".format(c) for c in ("latitude", "longitude"))


@query(_CONTEXTS)
def context_window(t):
    """Neighbouring texts of all sentences; texts at one place in the order of their ids."""
    return R.context_windows(t("sentences"))


@query("SELECT sentence_id, row_number() OVER (PARTITION BY work_id ORDER BY sentence_id)::INT AS sentence_position FROM sentences")
def sentence_position(t):
    return R.sentence_positions(t("sentences"))


_FREQUENCIES = """
    SELECT relation_id, count(*) OVER (PARTITION BY work_id, master_id) AS place_frequency_in_work, count(*) OVER (PARTITION BY author_id, master_id) AS place_frequency_by_author
    FROM sentence_places JOIN (SELECT sentence_id, work_id FROM sentences) USING (sentence_id) JOIN (SELECT work_id, author_id FROM works) USING (work_id) WHERE master_id IS NOT NULL"""


@query(_FREQUENCIES)
def place_frequency(t):
    return R.place_frequencies(t("sentence_places"), t("sentences"), t("works"))


@query("""
    SELECT relation_id, sentence_id, work_id, title AS work_title, author_id, author_name, publication_year AS work_publication_year, birth_year AS author_birth_year, death_year AS author_death_year
    FROM sentence_places JOIN (SELECT sentence_id, work_id FROM sentences) USING (sentence_id) JOIN (SELECT work_id, title, author_id, publication_year FROM works) USING (work_id) JOIN (SELECT author_id, author_name, birth_year, death_year FROM authors) USING (author_id)""")
def mention_star(t):
    star = R.star(t("sentence_places").select("relation_id", "sentence_id"), t("sentences"), t("works"), t("authors"))
    return star.select("relation_id", "sentence_id", "work_id", "work_title", "author_id", "author_name", "work_publication_year", "author_birth_year", "author_death_year")


@query(f"""
    SELECT relation_id, sentence_id, m.master_id, matched_text, s.work_id, sentence_order, s.sentence_text, title AS work_title, author_id, w.publication_year AS work_publication_year, author_name, birth_year AS author_birth_year, death_year AS author_death_year,
           context_before, context_after, sentence_position, place_frequency_in_work, place_frequency_by_author, p.display_name AS place_name, (instr(s.sentence_text, matched_text) - 1)::INT AS position_in_sentence
    FROM sentence_places m JOIN sentences s USING (sentence_id) JOIN works w ON s.work_id = w.work_id JOIN authors a USING (author_id) JOIN ({_CONTEXTS}) USING (sentence_id)
    JOIN (SELECT sentence_id, row_number() OVER (PARTITION BY work_id ORDER BY sentence_id)::INT AS sentence_position FROM sentences) USING (sentence_id)
    LEFT JOIN ({_FREQUENCIES}) USING (relation_id) LEFT JOIN place_masters p ON m.master_id = p.master_id""")
def enriched_mentions(t):
    """All derived columns of a mention together."""
    return R.enrich_mentions(t("sentence_places"), t("sentences"), t("works"), t("authors"), t("place_masters"))


@query("""
    SELECT p.master_id, p.display_name, p.place_type, count(m.relation_id) AS mention_count, count(DISTINCT m.sentence_id) AS sentence_count, count(DISTINCT s.work_id) AS work_count, count(DISTINCT w.author_id) AS author_count
    FROM place_masters p LEFT JOIN sentence_places m USING (master_id) LEFT JOIN sentences s ON m.sentence_id = s.sentence_id LEFT JOIN works w ON s.work_id = w.work_id GROUP BY ALL""")
def place_statistics(t):
    return S.place_statistics(t("place_masters"), t("sentence_places"), t("sentences"), t("works"))


@query("SELECT w.work_id, title, author_name FROM works w JOIN authors a USING (author_id) WHERE contains(author_name, 'Augusta') ORDER BY work_id")
def works_of_author(t):
    return t("works").join(t("authors").where(F.col("author_name").contains("Augusta")).select("author_id", "author_name"), "author_id").select("work_id", "title", "author_name").orderBy("work_id")


@query("SELECT DISTINCT author_id, author_name FROM authors a WHERE EXISTS (SELECT 1 FROM works w WHERE w.author_id = a.author_id)")
def authors_with_works(t):
    return t("authors").join(t("works").select("author_id"), "author_id", "left_semi").select("author_id", "author_name")


@query("SELECT author_id, author_name FROM authors a WHERE NOT EXISTS (SELECT 1 FROM works w WHERE w.author_id = a.author_id)")
def authors_without_works(t):
    return t("authors").join(t("works").select("author_id"), "author_id", "left_anti").select("author_id", "author_name")


@query("SELECT count(*) AS mentions, count(s.sentence_id) AS linked FROM sentence_places m LEFT JOIN (SELECT DISTINCT sentence_id FROM sentences) s USING (sentence_id)")
def link_integrity(t):
    s = t("sentences").select("sentence_id").distinct().withColumn("linked", F.lit(1))
    return t("sentence_places").join(s, "sentence_id", "left").agg(F.count(F.lit(1)).alias("mentions"), F.count("linked").alias("linked"))


@query("""
    SELECT a.author_id, min({'m': CASE WHEN a.listed = b.author_name THEN 'exact' ELSE 'fuzzy' END, 'p': b.author_id}).p AS partner_id, min({'m': CASE WHEN a.listed = b.author_name THEN 'exact' ELSE 'fuzzy' END, 'p': b.author_id}).m AS match
    FROM (SELECT author_id, CASE WHEN section = 'ア' THEN author_name WHEN section = 'カ' THEN replace(author_name, ' ', '　') ELSE substring(author_name, 1, 1) || ' ' || substring(author_name, 2) END AS listed FROM authors) a
    JOIN authors b ON replace(replace(a.listed, ' ', ''), '　', '') = replace(replace(b.author_name, ' ', ''), '　', '') GROUP BY a.author_id""")
def name_match(t):
    """Names of a list, blanks typed otherwise in most sections, against the authors."""
    a = t("authors")
    n = F.col("author_name")
    listed = F.when(F.col("section") == "ア", n).when(F.col("section") == "カ", F.replace(n, F.lit(" "), F.lit("　"))).otherwise(F.concat(F.substring(n, 1, 1), F.lit(" "), F.substring(n, 2, 1 << 30)))
    return R.match_names(a.select("author_id", listed.alias("listed")), a, "author_id", "listed", "author_id", "author_name")


@query("""
    WITH w AS (SELECT DISTINCT replace(replace(author_name, ' ', ''), '　', '') AS name FROM authors WHERE replace(replace(author_name, ' ', ''), '　', '') <> ''),
    tried AS (SELECT name, 0 AS rank, name AS author_name FROM w UNION ALL SELECT name, 1, substring(name, 1, 2) || ' ' || substring(name, 3) FROM w WHERE length(name) >= 4 UNION ALL SELECT name, 2, substring(name, 1, 1) || ' ' || substring(name, 2) FROM w WHERE length(name) >= 3),
    found AS (SELECT name, arg_min(author_id, {'r': rank, 'a': author_id}) AS author_id FROM tried JOIN authors USING (author_name) GROUP BY name)
    SELECT * FROM found UNION ALL
    SELECT name, min(author_id) FROM w JOIN authors ON contains(author_name, substring(name, 1, 2)) WHERE name <> '' AND name NOT IN (SELECT name FROM found) GROUP BY name""")
def author_lookup(t):
    """Authors by flexible spellings of their names without blanks."""
    names = t("authors").select(R.name_key(F.col("author_name")).alias("name"))
    return R.match_authors(names, t("authors"))


@query("SELECT m.relation_id, min(s.sentence_id) AS sentence_id FROM (SELECT relation_id, sentence_text AS matched_text FROM sentence_places JOIN sentences USING (sentence_id)) m JOIN sentences s ON m.matched_text = s.sentence_text GROUP BY m.relation_id")
def text_relink(t):
    """Mentions that hold a whole sentence as their text find the first sentence of that text."""
    s = t("sentences").groupBy("sentence_text").agg(F.min("sentence_id").alias("sentence_id"))
    whole = t("sentence_places").select("relation_id", "sentence_id").join(t("sentences").select("sentence_id", F.col("sentence_text").alias("matched_text")), "sentence_id").drop("sentence_id")
    return whole.join(s, F.col("matched_text") == F.col("sentence_text")).select("relation_id", "sentence_id")


@query("""
    SELECT relation_id, coalesce(m.sentence_id, 0) AS sentence_id, coalesce(m.extraction_confidence, 0.5) AS extraction_confidence, coalesce(m.ai_confidence, p.geocoding_confidence) AS ai_confidence
    FROM sentence_places m LEFT JOIN place_masters p USING (master_id)""")
def relation_refill(t):
    p = t("place_masters").select("master_id", F.col("geocoding_confidence").alias("ai_confidence"))
    m = t("sentence_places").select("relation_id", "sentence_id", "master_id", F.coalesce("extraction_confidence", F.lit(0.5)).alias("extraction_confidence"), "ai_confidence")
    return R.refill(m, p, "master_id", ["ai_confidence"]).select("relation_id", F.coalesce("sentence_id", F.lit(0)).alias("sentence_id"), "extraction_confidence", "ai_confidence")


# --- statistics ------------------------------------------------------------------------


@query(f"SELECT count(*) AS total_masters, count({_LAT}) AS geocoded, count_if(validation_status = 'validated') AS validated, coalesce(sum(usage_count), 0)::BIGINT AS total_usage, round(count({_LAT}) * 100.0::DOUBLE / count(*), 2) AS geocoding_rate FROM place_masters")
def master_summary(t):
    return S.master_summary(t("place_masters"))


@query("SELECT place_type, count(*) AS n FROM place_masters WHERE place_type IS NOT NULL GROUP BY 1")
def type_distribution(t):
    return S.distribution(t("place_masters"), "place_type")


@query("SELECT coalesce(copyright_status, 'unknown') AS copyright_status, count(*) AS n FROM authors GROUP BY 1")
def copyright_statistics(t):
    return S.distribution(t("authors"), "copyright_status", "unknown")


@query("SELECT coalesce(section, 'その他') AS section, count(*) AS n FROM authors GROUP BY 1")
def section_statistics(t):
    return S.distribution(t("authors"), "section", "その他")


@query(f"""
    SELECT count(*) AS total, count_if(b) AS geocoded, count_if(b AND c >= 0.9) AS high, count_if(b AND c >= 0.7 AND c < 0.9) AS medium, round(count_if(b) * 100.0::DOUBLE / count(*), 2) AS success_rate
    FROM (SELECT ({_LAT}) IS NOT NULL AND ({_LON}) IS NOT NULL AS b, geocoding_confidence AS c FROM place_masters)""")
def geocoding_statistics(t):
    return S.geocoding_statistics(t("place_masters"))


@query("SELECT geocoding_source, count(*) AS n FROM place_masters WHERE geocoding_source IS NOT NULL GROUP BY 1")
def geocoding_sources(t):
    return S.distribution(t("place_masters"), "geocoding_source")


@query("SELECT count(*) AS total_authors, coalesce(sum(aozora_works_count), 0)::BIGINT AS total_works, round(avg(aozora_works_count), 2) AS average_works FROM authors")
def author_statistics(t):
    return t("authors").agg(F.count(F.lit(1)).alias("total_authors"), F.coalesce(F.sum("aozora_works_count"), F.lit(0)).alias("total_works"), F.round(F.avg("aozora_works_count"), 2).alias("average_works"))


@query("SELECT author_id, author_name, aozora_works_count FROM authors WHERE aozora_works_count > 0 ORDER BY aozora_works_count DESC, author_name, author_id LIMIT 10")
def top_authors(t):
    return t("authors").where("aozora_works_count > 0").orderBy(F.col("aozora_works_count").desc(), "author_name", "author_id").select("author_id", "author_name", "aozora_works_count").limit(10)


@query("SELECT a.author_id, a.author_name, count(w.work_id) AS works_count, coalesce(sum(w.sentence_count), 0)::BIGINT AS total_sentences FROM authors a LEFT JOIN works w USING (author_id) GROUP BY ALL")
def author_rollup(t):
    return S.author_rollup(t("authors"), t("works"))


@query("""
    WITH s AS (SELECT work_id, count(*) AS n, sum(length(sentence_text))::BIGINT AS l FROM sentences GROUP BY 1),
    m AS (SELECT work_id, count(*) AS n, count(DISTINCT master_id) AS u, round(avg(extraction_confidence), 9) AS c FROM sentence_places JOIN sentences USING (sentence_id) GROUP BY 1)
    SELECT w.work_id, coalesce(s.n, 0) AS sentence_count, coalesce(l, 0) AS content_length, coalesce(m.n, 0) AS place_count, coalesce(u, 0) AS unique_places, c AS average_confidence FROM works w LEFT JOIN s USING (work_id) LEFT JOIN m USING (work_id)""")
def work_rollup(t):
    return S.work_rollup(t("works"), t("sentences"), t("sentence_places"))


_UNGEOCODED = f"""
    SELECT p.master_id, p.display_name, count(s.sentence_id) AS usage_count, min(s.sentence_text) AS sample_text FROM place_masters p LEFT JOIN sentence_places m USING (master_id) LEFT JOIN sentences s ON m.sentence_id = s.sentence_id
    WHERE ({_LAT}) IS NULL OR ({_LON}) IS NULL GROUP BY ALL"""


@query(_UNGEOCODED)
def ungeocoded_usage(t):
    return S.ungeocoded_usage(t("place_masters"), t("sentence_places"), t("sentences"))


@query("""
    WITH top AS (SELECT p.master_id, any_value(display_name) AS display_name, count(*) AS usage_count FROM place_masters p JOIN sentence_places m USING (master_id) WHERE validation_status IS NULL OR validation_status <> 'validated' GROUP BY p.master_id, geocoding_confidence ORDER BY usage_count, geocoding_confidence NULLS FIRST, p.master_id LIMIT 20),
    lines AS (SELECT DISTINCT master_id, sentence_id, sentence_text FROM sentence_places JOIN sentences USING (sentence_id)),
    five AS (SELECT master_id, list(sentence_text ORDER BY sentence_id) AS c FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY sentence_id) <= 5) GROUP BY 1)
    SELECT top.*, coalesce(len(c), -1)::INT AS n_contexts, coalesce(array_to_string(c, '|||'), '') AS contexts FROM top LEFT JOIN five USING (master_id)""")
def verification_worklist(t):
    w = S.verification_worklist(t("place_masters"), t("sentence_places"), t("sentences"))
    return w.withColumn("n_contexts", F.coalesce("n_contexts", F.lit(-1)))


@query("SELECT m.master_id, coalesce(string_agg(alias_name, ' ' ORDER BY alias_name), '') AS aliases FROM place_masters m LEFT JOIN place_aliases a USING (master_id) GROUP BY 1")
def alias_concat(t):
    return S.alias_text(t("place_masters"), t("place_aliases"))


_AUDITED = ["author_name_kana", "aozora_author_url", "birth_year", "death_year", "alias_info"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count, round(count({c}) * 100.0::DOUBLE / count(*), 2) AS completion_rate FROM authors" for c in _AUDITED))
def completion_rates(t):
    return S.null_audit(t("authors"), _AUDITED)


@query("""
    SELECT total, a AS full_stops, b AS exclamations, c AS questions, l AS avg_length, r AS punctuation_rate, CASE WHEN r >= 95 THEN 'good' WHEN r >= 80 THEN 'fair' ELSE 'poor' END AS grade
    FROM (SELECT *, round((a + b + c) * 100.0::DOUBLE / total, 2) AS r FROM (SELECT count(*) AS total, count_if(ends_with(sentence_text, '。')) AS a, count_if(ends_with(sentence_text, '！')) AS b, count_if(ends_with(sentence_text, '？')) AS c, round(avg(length(sentence_text)), 4) AS l FROM sentences))""")
def punctuation_audit(t):
    return S.punctuation_audit(t("sentences"))


_TABLES = ["authors", "works", "sentences", "place_masters", "place_aliases", "sentence_places"]


@query(" UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS n FROM {x}" for x in _TABLES))
def table_counts(t):
    return S.table_counts({x: t(x) for x in _TABLES})


@query("SELECT author_id, count(*) AS total_works, count(processed_at) AS completed, count(*) - count(processed_at) AS pending, coalesce(sum(CASE WHEN processed_at IS NOT NULL THEN sentence_count END), 0)::BIGINT AS sentences, round(count(processed_at) * 100.0::DOUBLE / count(*), 2) AS completion_rate FROM works GROUP BY 1")
def author_progress(t):
    done = F.count("processed_at")
    n = F.count(F.lit(1))
    return t("works").groupBy("author_id").agg(n.alias("total_works"), done.alias("completed"), (n - done).alias("pending"), F.coalesce(F.sum(F.when(F.col("processed_at").isNotNull(), F.col("sentence_count"))), F.lit(0)).alias("sentences"), S.rate(done, n).alias("completion_rate"))


@query("SELECT event_type, count(*) AS n, coalesce(round(avg(value), 6), 0) AS avg_value FROM events WHERE ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-12 00:00:00' GROUP BY 1")
def metrics_range(t):
    return S.metrics_in_range(t("events"), "2024-01-05 00:00:00", "2024-01-12 00:00:00")


_RULES = {"click": ("<", 60.0), "view": (">", 5.0), "purchase": (">", 3.0), "error": ("<", 0.7), "signup": (">", 30.0)}


@query("SELECT event_type, value, threshold FROM (SELECT event_type, arg_max(value, {'ts': ts, 'id': event_id}) AS value FROM events GROUP BY 1) JOIN (VALUES " + ", ".join(f"('{k}', '{o}', {v}::DOUBLE)" for k, (o, v) in _RULES.items()) + ") r(event_type, op, threshold) USING (event_type) WHERE (op = '<' AND value < threshold) OR (op = '>' AND value > threshold)")
def alert_rows(t):
    return S.alerts(t("events"), _RULES)


# --- filters, sorts, sets --------------------------------------------------------------


@query(f"SELECT 'pm_' || master_id AS place_id, display_name, {_LAT} AS latitude, {_LON} AS longitude FROM place_masters WHERE validation_status <> 'rejected'")
def places_view(t):
    """Places that are not rejected; a coordinate that is no number is none."""
    return t("place_masters").where("validation_status <> 'rejected'").select(F.concat(F.lit("pm_"), F.col("master_id")).alias("place_id"), "display_name", coordinate("latitude").alias("latitude"), coordinate("longitude").alias("longitude"))


@query("SELECT author_id, author_name FROM authors WHERE aozora_author_url IS NOT NULL AND aozora_author_url <> '' ORDER BY author_name, author_id")
def authors_with_url(t):
    return t("authors").where("aozora_author_url IS NOT NULL AND aozora_author_url <> ''").select("author_id", "author_name").orderBy("author_name", "author_id")


@query("SELECT author_id, author_name, aozora_works_count FROM authors WHERE author_name_kana IS NULL OR birth_year IS NULL OR death_year IS NULL")
def missing_info(t):
    return t("authors").where("author_name_kana IS NULL OR birth_year IS NULL OR death_year IS NULL").select("author_id", "author_name", "aozora_works_count")


@query("SELECT author_id, author_name FROM authors WHERE section = 'サ' AND contains(author_name, 'a')")
def name_search(t):
    return t("authors").where((F.col("section") == "サ") & F.col("author_name").contains("a")).select("author_id", "author_name")


@query(f"SELECT relation_id, m.master_id FROM sentence_places m JOIN place_masters p USING (master_id) WHERE ({_LAT}) IS NULL OR ({_LON}) IS NULL")
def ungeocoded_mentions(t):
    missing = t("place_masters").where(coordinate("latitude").isNull() | coordinate("longitude").isNull())
    return t("sentence_places").join(missing.select("master_id"), "master_id").select("relation_id", "master_id")


@query("SELECT DISTINCT extraction_method FROM sentence_places")
def distinct_methods(t):
    return t("sentence_places").select("extraction_method").distinct()


@query("SELECT title, author_id FROM works WHERE author_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_titles(t):
    return t("works").where("author_id IS NOT NULL").groupBy("title", "author_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title", "author_id")


# --- merges ------------------------------------------------------------------------------


def _changes(authors: DataFrame) -> DataFrame:
    """Incoming rows: every author with a year or a status changed, and as many new names."""
    return authors.select("author_name", F.when(F.col("birth_year") > 1900, F.col("birth_year") + 1).alias("birth_year"), F.lit("expired").alias("copyright_status")).unionByName(
        authors.select(F.concat(F.lit("新"), F.col("author_name")).alias("author_name"), "birth_year", F.lit("active").alias("copyright_status"))
    )


_INCOMING = "(SELECT author_name, CASE WHEN birth_year > 1900 THEN birth_year + 1 END AS birth_year, 'expired' AS copyright_status FROM authors UNION ALL SELECT '新' || author_name, birth_year, 'active' FROM authors)"


@query(f"SELECT coalesce(a.author_name, i.author_name) AS author_name, coalesce(i.birth_year, a.birth_year) AS birth_year, coalesce(i.copyright_status, a.copyright_status) AS copyright_status FROM authors a FULL JOIN {_INCOMING} i ON a.author_name = i.author_name")
def upsert_merge(t):
    a = t("authors").select("author_name", "birth_year", "copyright_status")
    return M.upsert(a, _changes(a), "author_name")


@query(f"SELECT i.author_name, CASE WHEN a.author_name IS NULL THEN 'new' WHEN a.birth_year IS DISTINCT FROM i.birth_year OR a.copyright_status IS DISTINCT FROM i.copyright_status THEN 'updated' ELSE 'same' END AS change FROM {_INCOMING} i LEFT JOIN authors a ON a.author_name = i.author_name")
def sync_classify(t):
    a = t("authors").select("author_name", "birth_year", "copyright_status")
    return M.classify_sync(a, _changes(a), "author_name", ["birth_year", "copyright_status"])


@query("SELECT max(author_id) + row_number() OVER (ORDER BY name) AS author_id, name AS author_name FROM (SELECT (SELECT max(author_id) FROM authors) AS author_id, '新' || author_name AS name FROM authors) GROUP BY name UNION ALL SELECT author_id, author_name FROM authors")
def get_or_create(t):
    a = t("authors").select("author_id", "author_name")
    return M.get_or_create(a, a.select(F.concat(F.lit("新"), F.col("author_name")).alias("author_name")).unionByName(a.select("author_name")), "author_name", "author_id")


@query("SELECT sentence_id, master_id, matched_text, max(relation_id) AS relation_id FROM sentence_places GROUP BY 1, 2, 3")
def insert_or_replace(t):
    rows = t("sentence_places").select("sentence_id", "master_id", "matched_text", "relation_id")
    return M.insert_or_replace(rows, ["sentence_id", "master_id", "matched_text"], "relation_id")


@query("SELECT relation_id FROM sentence_places WHERE coalesce(sentence_id NOT IN (SELECT s.sentence_id FROM sentences s JOIN works w USING (work_id) JOIN authors a USING (author_id) WHERE a.section = 'サ'), true)")
def semi_delete(t):
    gone = t("sentences").join(t("works").select("work_id", "author_id"), "work_id").join(t("authors").where("section = 'サ'").select("author_id"), "author_id").select("sentence_id")
    return M.delete_matching(t("sentence_places"), gone, "sentence_id").select("relation_id")


@query("""
    WITH n AS (SELECT DISTINCT display_name AS name FROM place_masters WHERE place_type = '山' UNION SELECT 'no such place')
    SELECT name, count(m.relation_id) AS n_relations, bool_or(p.master_id IS NOT NULL) AS found FROM n LEFT JOIN place_masters p ON p.display_name = name LEFT JOIN sentence_places m USING (master_id) GROUP BY 1""")
def logical_delete(t):
    p = t("place_masters")
    names = p.where("place_type = '山'").select(F.col("display_name").alias("name")).unionByName(p.sparkSession.createDataFrame([("no such place",)], "name string"))
    return M.reject_places(p, t("sentence_places"), names)[2]


@query("SELECT p.master_id, count(m.relation_id) AS usage_count, min(m.created_at) AS first_used_at, max(m.created_at) AS last_used_at FROM place_masters p LEFT JOIN sentence_places m USING (master_id) GROUP BY 1")
def usage_statistics(t):
    return M.usage_statistics(t("place_masters"), t("sentence_places"))


@query("SELECT work_id, title, coalesce(nullif(w.publication_year, 0), y.y) AS publication_year FROM works w LEFT JOIN (SELECT author_id, max(publication_year) AS y FROM works GROUP BY 1) y USING (author_id)")
def fill_publication_year(t):
    w = t("works").select("work_id", "title", "author_id", F.nullif("publication_year", F.lit(0)).alias("publication_year"))
    y = t("works").groupBy("author_id").agg(F.max("publication_year").alias("publication_year"))
    return R.refill(w, y, "author_id", ["publication_year"]).select("work_id", "title", "publication_year")


QUERIES = Q
