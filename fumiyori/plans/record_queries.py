"""Queries of geocoding in context, tagging, enrichment, exports and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumiyori.functions import scoring as C
from fumiyori.functions import text as X
from fumiyori.functions import vocabulary as V
from fumiyori.operators import merging as M
from fumiyori.operators import relations as R
from fumiyori.operators import resolving as G
from fumiyori.operators import statistics as S
from fumiyori.plans import relation_queries
from fumiyori.plans.entity_queries import _KEY, _PAIRS, _context_b_sql, _index_pages, _texts, _values
from fumiyori.plans.relation_queries import _LAT, _LON, query
from fumiyori.plans.text_queries import _USUAL
from fumiyori.sources import pages as P

_BEFORE = set(relation_queries.Q)

# --- coordinates ------------------------------------------------------------------------

_PREFIX = "CASE WHEN contains(location, '都') THEN split_part(location, '都', 1) || '都' WHEN contains(location, '府') THEN split_part(location, '府', 1) || '府' WHEN contains(location, '県') THEN split_part(location, '県', 1) || '県' END"
_SIMPLE = "(SELECT *, translate(entry, '都府県', '') AS base FROM (VALUES " + ", ".join(_values(i, x) for i, x in enumerate((V.SIMPLE_PLACES, V.PREFECTURES), 1)) + ") g(tier, ordinal, entry, lat, lon, location, confidence))"


@query(f"""
    WITH w AS (SELECT DISTINCT display_name AS name FROM place_masters WHERE display_name <> ''),
    g AS (SELECT w.name, ordinal, lat, lon, location, confidence,
                 CASE WHEN tier = 1 AND entry = name THEN 1 WHEN tier = 2 AND (contains(entry, name) OR base = name) THEN 2 WHEN tier = 2 AND (contains(name, base) OR contains(base, name)) THEN 3 END AS rank
          FROM w JOIN {_SIMPLE} ON true QUALIFY rank IS NOT NULL AND row_number() OVER (PARTITION BY w.name ORDER BY rank NULLS LAST, ordinal) = 1)
    SELECT w.name, rank AS tier, lat, lon, location, {_PREFIX} AS prefecture, round(CASE rank WHEN 3 THEN greatest(0.3, confidence - 0.3) ELSE confidence END, 4) AS confidence FROM w LEFT JOIN g USING (name)""")
def geocode_simple(t):
    """Coordinates of all distinct place names by the simple geocoder."""
    return G.geocode_simple(t("place_masters").select(F.col("display_name").alias("name")))


_GATED = relation_queries.ORACLES["geocode_tiers"].replace("SELECT DISTINCT display_name AS name FROM place_masters WHERE display_name <> ''", f"SELECT DISTINCT name FROM ({_context_b_sql(_PAIRS)}) WHERE is_place AND name <> ''")


@query(_GATED)
def geocode_in_context(t):
    """Coordinates of the mention texts that some sentence takes for a place."""
    none = F.lit(None).cast("string")
    return G.geocode_in_context(_texts(t).select("name", C.context_b(F.col("name"), F.col("sentence_text"), none, none).is_place.alias("is_place")))


@query("SELECT master_id, latitude, longitude, CASE WHEN geocoding_confidence > 0.8 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM place_masters WHERE latitude BETWEEN 24 AND 45.5 AND longitude BETWEEN 122 AND 146")
def api_geocoding(t):
    """Answers of a map service (the masters' coordinates stand for them) within the bounds, with their confidence."""
    answers = t("place_masters").where(C.in_japan(F.col("latitude"), F.col("longitude"), "B"))
    return answers.select("master_id", "latitude", "longitude", C.api_confidence(F.col("geocoding_confidence")).alias("confidence"))


@query(f"SELECT relation_id, {_LAT} AS latitude, {_LON} AS longitude, geocoding_source, geocoding_confidence FROM sentence_places JOIN place_masters USING (master_id) WHERE ({_LAT}) IS NOT NULL AND ({_LON}) IS NOT NULL")
def propagated_coordinates(t):
    """Coordinates of the masters handed on to their mentions."""
    return G.propagated_coordinates(t("sentence_places"), t("place_masters"))


# --- tagging, verification, creation -----------------------------------------------------


@query("""
    SELECT sentence_id, n_tokens, n_entities, round(CASE WHEN n_tokens > 0 AND m IS NOT NULL THEN 0.3 * least(n_tokens / 100, 1.0) + 0.7 * m ELSE 0.0 END, 9) AS confidence FROM (
        SELECT sentence_id, len(list_filter(regexp_extract_all(trim(regexp_replace(sentence_text, '[\\s　\\x{00a0}]+', ' ', 'g'), ' '), '[一-鿿々]+|[ぁ-ゟ]+|[゠-ヿ]+|\\p{L}+|\\p{Nd}+|[^\\s\\p{L}\\p{Nd}]'), lambda x: x <> ''))::INT AS n_tokens FROM sentences)
    LEFT JOIN (SELECT sentence_id, count(*) AS n, avg(least(1.0, 0.7 + CASE WHEN length(matched_text) >= 4 THEN 0.1 ELSE 0.0 END + CASE WHEN master_id IS NOT NULL THEN 0.1 ELSE 0.0 END)::DOUBLE) AS m FROM sentence_places WHERE matched_text IS NOT NULL GROUP BY 1) USING (sentence_id), LATERAL (SELECT coalesce(n, 0) AS n_entities)""")
def analyzed_texts(t):
    """Tokens and entities of every sentence, with the confidence of the analysis (mentions stand for a tagger's entities)."""
    entities = t("sentence_places").where("matched_text IS NOT NULL").groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"), F.avg(C.entity_confidence(F.col("matched_text"), F.col("master_id").isNotNull())).alias("m"))
    n = F.size(X.tokens(F.col("sentence_text")))
    counted = t("sentences").select("sentence_id", F.when(F.col("sentence_text").isNotNull(), n).alias("n_tokens")).join(entities, "sentence_id", "left")
    return counted.select("sentence_id", "n_tokens", F.coalesce("n", F.lit(0)).alias("n_entities"), F.round(C.nlp_confidence(F.col("n_tokens"), F.col("m")), 9).alias("confidence"))


@query("SELECT sentence_id, round(0.7 * avg(extraction_confidence) + 0.3 * coalesce(avg(ai_confidence), 0), 9) AS confidence FROM sentence_places GROUP BY 1 HAVING avg(extraction_confidence) IS NOT NULL")
def blended_confidences(t):
    """Extraction and context confidence of a sentence's mentions in one."""
    m = t("sentence_places").groupBy("sentence_id").agg(F.avg("extraction_confidence").alias("e"), F.avg("ai_confidence").alias("c"))
    return m.where("e IS NOT NULL").select("sentence_id", F.round(C.blended_confidence(F.col("e"), F.col("c")), 9).alias("confidence"))


@query("""
    SELECT name FROM (SELECT DISTINCT matched_text AS name FROM sentence_places WHERE matched_text IS NOT NULL)
    LEFT JOIN (SELECT matched_text AS name, count_if(ai_verified) * 2 >= count(*) AS ok, avg(ai_confidence) AS c FROM sentence_places WHERE ai_confidence IS NOT NULL AND matched_text IS NOT NULL GROUP BY 1) USING (name) WHERE coalesce(ok AND c >= 0.7, true)""")
def accepted_candidates(t):
    """Mention texts that the stored verdicts accept, or that have none."""
    m = t("sentence_places").where("matched_text IS NOT NULL")
    verdicts = m.where("ai_confidence IS NOT NULL").groupBy(F.col("matched_text").alias("name")).agg((F.count_if("ai_verified") * 2 >= F.count(F.lit(1))).alias("is_place_name"), F.avg("ai_confidence").alias("confidence"))
    return G.accepted(m.select(F.col("matched_text").alias("name")).distinct(), verdicts)


@query(f"""
    WITH fresh AS (SELECT key AS normalized_name, min(name) AS display_name FROM (SELECT matched_text AS name, {_KEY.format('matched_text')} AS key FROM sentence_places WHERE master_id IS NULL) WHERE key <> '' AND key NOT IN (SELECT normalized_name FROM place_masters WHERE normalized_name IS NOT NULL) GROUP BY 1)
    SELECT (SELECT max(master_id) FROM place_masters) + row_number() OVER (ORDER BY normalized_name) AS master_id, normalized_name, display_name, 'pending' AS validation_status FROM fresh""")
def created_masters(t):
    """Masters made for mention texts without one, an id each in the order of their keys."""
    masters = t("place_masters").select("master_id", "normalized_name", "display_name", "validation_status", "usage_count")
    top = masters.agg(F.max("master_id").alias("top"))
    made = G.create_masters(t("sentence_places").where("master_id IS NULL").select(F.col("matched_text").alias("name")), masters)
    return made.join(F.broadcast(top), F.col("master_id") > F.col("top")).select("master_id", "normalized_name", "display_name", "validation_status")


@query("SELECT relation_id, ai_verified AS is_place_name, ai_confidence AS confidence FROM sentence_places WHERE ai_verified IS NOT NULL")
def parsed_replies(t):
    """Stored replies of a model, fenced JSON, parsed."""
    m = t("sentence_places").select("relation_id", F.to_json(F.struct(F.col("ai_verified").alias("is_place_name"), F.col("ai_confidence").alias("confidence"))).alias("j"))
    parsed = m.select("relation_id", X.parse_reply(F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).alias("r"))
    return parsed.where("r IS NOT NULL").select("relation_id", "r.is_place_name", "r.confidence")


# --- authors and works --------------------------------------------------------------------


def _encyclopedia(t):
    """Pages made of the authors: one for each name and word, telling of a writer."""
    a = t("authors").where("birth_year IS NOT NULL AND death_year IS NOT NULL").select("author_name", "birth_year", "death_year")
    life = F.concat(F.lit("日本の小説家（"), F.col("birth_year"), F.lit("年4月1日 - "), F.col("death_year"), F.lit("年5月2日）。"))
    return a.select(F.concat("author_name", F.lit(" 詩人")).alias("keyword"), F.concat("author_name", F.lit("の項")).alias("title"), F.lit("https://pages.example/").alias("url"), life.alias("summary"), F.lit("").alias("content"), F.lit(None).cast("array<string>").alias("options")).unionByName(
        a.select(F.col("author_name").alias("keyword"), F.lit("一覧").alias("title"), F.lit("https://pages.example/list").alias("url"), F.lit("").alias("summary"), F.lit("").alias("content"), F.array(F.lit("別人 (政治家)"), F.lit("別人 (画家)")).alias("options"))
    )


@query("SELECT author_id, author_name || 'の項' AS title, birth_year, death_year, author_name || ' 詩人' AS keyword FROM authors WHERE birth_year BETWEEN 1850 AND 1920 AND death_year BETWEEN 1850 AND 2000 AND birth_year < death_year")
def author_pages(t):
    """The page that describes each author, by keywords in order of preference."""
    found = P.lookup_pages(t("authors"), _encyclopedia(t))
    return found.where("death_year BETWEEN 1850 AND 2000 AND birth_year < death_year").select("author_id", "title", "birth_year", "death_year", "keyword")


@query("SELECT author_id, birth_year, death_year FROM authors WHERE birth_year BETWEEN 1800 AND 1950 AND death_year BETWEEN 1850 AND 2000 AND birth_year < death_year")
def life_spans(t):
    """Life years read from a summary that states them."""
    a = t("authors").where("birth_year BETWEEN 1800 AND 1950 AND death_year BETWEEN 1850 AND 2000 AND birth_year < death_year")
    told = F.concat(F.lit("小説家（"), F.col("birth_year"), F.lit("年4月1日 - "), F.col("death_year"), F.lit("年5月2日）。"))
    return a.select("author_id", X.life_years(told, F.lit("")).alias("l")).select("author_id", "l.birth_year", "l.death_year")


@query("""
    WITH s AS (SELECT author_id, count(DISTINCT work_id) AS works_count, count(sentence_id) AS total_sentences FROM works LEFT JOIN sentences USING (work_id) WHERE author_id IS NOT NULL GROUP BY 1),
    p AS (SELECT author_id, count(*) AS total_places, count(DISTINCT master_id) AS unique_places FROM works JOIN sentences USING (work_id) JOIN sentence_places USING (sentence_id) WHERE author_id IS NOT NULL GROUP BY 1)
    SELECT author_id, coalesce(works_count, 0) AS works_count, coalesce(total_sentences, 0) AS total_sentences, coalesce(total_places, 0) AS total_places, coalesce(unique_places, 0) AS unique_places FROM authors LEFT JOIN s USING (author_id) LEFT JOIN p USING (author_id)""")
def author_details(t):
    """Works, sentences, mentions and places of every author."""
    return S.author_details(t("authors"), t("works"), t("sentences"), t("sentence_places"))


@query("""
    SELECT 'total_authors' AS entry, NULL::VARCHAR AS value, count(*) AS n FROM authors UNION ALL SELECT 'total_works', NULL, coalesce(sum(aozora_works_count), 0)::BIGINT FROM authors
    UNION ALL SELECT 'copyright_status', copyright_status, count(*) FROM authors GROUP BY copyright_status UNION ALL SELECT 'section', section, count(*) FROM authors GROUP BY section""")
def export_metadata(t):
    """What an export of the authors says of itself."""
    return S.export_statistics(t("authors"))


@query("SELECT 'https://bunko.example/cards/1/card' || work_id || '.html' AS url, 'https://bunko.example/cards/1/files/' || work_id || '_2.html' AS file_url FROM works")
def text_file_links(t):
    """The first link to a text file of cards that have several links."""
    link = lambda n: F.concat(F.lit('<a href="./files/'), F.col("work_id"), F.lit(f'_{n}.html">XHTML{n}</a>'))
    cards = t("works").select(F.concat(F.lit("https://bunko.example/cards/1/card"), F.col("work_id"), F.lit(".html")).alias("url"), F.concat(F.lit('<p><a href="../index.html">top</a>'), link(2), link(1), F.lit("</p>")).alias("html"))
    return P.text_files(cards).select("url", F.replace("file_url", F.lit("/./"), F.lit("/")).alias("file_url"))


@query("""
    SELECT relation_id, p.display_name, s.sentence_id, s.sentence_text, title, author_name FROM sentence_places m JOIN sentences s USING (sentence_id) JOIN place_masters p USING (master_id) LEFT JOIN works w ON s.work_id = w.work_id LEFT JOIN authors a ON w.author_id = a.author_id ORDER BY p.display_name, s.sentence_id, relation_id""")
def place_usages(t):
    """All uses of the places with sentence, work and author, in order."""
    m = t("sentence_places").select("relation_id", "sentence_id", "master_id").join(t("sentences").select("sentence_id", "sentence_text", "work_id"), "sentence_id").join(t("place_masters").select("master_id", "display_name"), "master_id")
    whole = m.join(t("works").select("work_id", "title", "author_id"), "work_id", "left").join(t("authors").select("author_id", "author_name"), "author_id", "left")
    return whole.select("relation_id", "display_name", "sentence_id", "sentence_text", "title", "author_name").orderBy("display_name", "sentence_id", "relation_id")


@query("SELECT event_type, count(*) AS total, arg_max(value, {'t': ts, 'i': event_id}) AS last_value, round(sum(value), 6) AS sum_value, count_if(value <= 1) AS le_1, count_if(value <= 10) AS le_10, count_if(value <= 100) AS le_100 FROM events GROUP BY 1")
def metric_recorders(t):
    """Counter, gauge and histogram of every kind of event."""
    return S.recorders(t("events"), "event_type", "value", ["ts", "event_id"], [1, 10, 100])


@query("SELECT author_id, author_name, copyright_status FROM authors WHERE copyright_status = 'active'")
def record_find(t):
    """Records by the value of a column, as the record store finds them."""
    return t("authors").where(F.col("copyright_status").eqNullSafe(F.lit("active"))).select("author_id", "author_name", "copyright_status")


# --- verdicts, reports, old names ------------------------------------------------------------


@query(f"""
    WITH c AS (SELECT name, place_type, count(*) AS n, count_if(is_place) AS k, sum(confidence) AS s FROM ({_context_b_sql(_PAIRS)}) GROUP BY 1, 2),
    v AS (SELECT name, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, sum(s) AS s, arg_max(place_type, {{'n': n, 't': place_type}}) AS place_type FROM c GROUP BY 1)
    SELECT name, n, k / n >= 0.5 AS is_valid, round(s / n * CASE WHEN k = 0 THEN 1.0 WHEN k / n < 0.3 THEN 0.8 WHEN k / n < 0.7 THEN 0.9 ELSE 1.0 END, 9) AS confidence,
           CASE WHEN k = 0 THEN '削除推奨' WHEN k / n < 0.3 THEN '削除検討' WHEN k / n < 0.7 THEN '要再検討' ELSE '保持推奨' END AS action, place_type FROM v""")
def context_verdicts(t):
    """The verdict on every mention text over all its contexts, with the kind of place most of them give."""
    none = F.lit(None).cast("string")
    judged = _texts(t).select("name", C.context_b(F.col("name"), F.col("sentence_text"), none, none).alias("c")).select("name", "c.is_place", "c.confidence", "c.place_type")
    return S.place_verdicts(judged, "name")


@query(f"SELECT count(*) AS processed, count_if(change = 'new') AS new, count_if(change = 'updated') AS updated, count_if(change = 'same') AS same, round((count_if(change = 'new') + count_if(change = 'updated')) * 100.0::DOUBLE / greatest(1, count(*)), 2) AS success_rate FROM ({relation_queries.ORACLES['sync_classify']})")
def import_report(t):
    """Counts and success of an import of authors."""
    a = t("authors").select("author_name", "birth_year", "copyright_status")
    return S.import_report(M.classify_sync(a, relation_queries._changes(a), "author_name", ["birth_year", "copyright_status"]))


@query("SELECT author_id, coalesce(CASE WHEN birth_year > 1900 THEN birth_year + 1 END, birth_year) AS birth_year, death_year FROM authors")
def patched_authors(t):
    """Authors with some years corrected by id."""
    a = t("authors").select("author_id", "birth_year", "death_year")
    return M.patch(a, a.select("author_id", F.when(F.col("birth_year") > 1900, F.col("birth_year") + 1).alias("birth_year")), "author_id")


@query("SELECT author_id, author_name, aozora_works_count FROM authors WHERE author_name_kana IS NULL OR birth_year IS NULL OR death_year IS NULL ORDER BY aozora_works_count DESC NULLS LAST, author_name, author_id LIMIT 50")
def missing_info_worklist(t):
    """The authors with most works among those that lack a reading or a year (a top-k report)."""
    missing = t("authors").where("author_name_kana IS NULL OR birth_year IS NULL OR death_year IS NULL")
    return missing.orderBy(F.col("aozora_works_count").desc_nulls_last(), "author_name", "author_id").select("author_id", "author_name", "aozora_works_count").limit(50)


@query("SELECT 'https://bunko.example/index/' || section || '.html' AS url, regexp_replace(translate(author_name, '<>&()', ''), '^[\\s　\\x{00a0}]+|[\\s　\\x{00a0}]+$', '', 'g') AS text, 'https://bunko.example/index/person' || author_id || '.html' AS person_url FROM authors WHERE section IS NOT NULL")
def person_links(t):
    """Links to the pages of persons on the index pages."""
    return P.person_links(_index_pages(t))


@query(f"SELECT sentence_id, array_to_string(list_filter([CASE WHEN length(x) < 10 THEN 'too_short' END, CASE WHEN length(x) > 1000 THEN 'too_long' END, CASE WHEN regexp_matches(x, '[^{_USUAL}]') THEN 'unusual_characters' END], lambda i: i IS NOT NULL), ',') AS issues FROM (SELECT sentence_id, sentence_text AS x FROM sentences)")
def sentence_issues(t):
    """What keeps each sentence from the full score."""
    return t("sentences").select("sentence_id", F.concat_ws(",", C.sentence_issues(F.col("sentence_text"))).alias("issues"))


@query("SELECT title, author_id, aozora_work_url FROM works")
def work_rows(t):
    """Works from rows with old names."""
    return P.work_rows(t("works").select(F.col("title").alias("work_title"), "author_id", F.lit(None).cast("string").alias("aozora_url"), F.col("aozora_work_url").alias("work_url")))


@query("SELECT sentence_id, master_id, matched_text, coalesce(start_position, -1) AS start_position FROM sentence_places")
def mention_rows(t):
    """Mentions from rows with old names."""
    return P.mention_rows(t("sentence_places").select("sentence_id", F.col("master_id").alias("place_id"), "matched_text", "start_position", F.lit(-1).alias("position_in_sentence")))


@query("SELECT relation_id, work_id, author_id FROM sentence_places LEFT JOIN (SELECT sentence_id, work_id FROM sentences) USING (sentence_id) LEFT JOIN (SELECT work_id, author_id FROM works) USING (work_id)")
def relation_keys(t):
    """Mentions whose work and author were known for the verified ones only, the others filled in."""
    keys = t("sentence_places").select("relation_id", "sentence_id", "ai_verified").join(t("sentences").select("sentence_id", "work_id"), "sentence_id", "left").join(t("works").select("work_id", "author_id"), "work_id", "left")
    base = keys.select("relation_id", *(F.when(F.col("ai_verified"), F.col(c)).alias(c) for c in ("work_id", "author_id")))
    return R.refill(base, keys.select("relation_id", "work_id", "author_id"), "relation_id", ["work_id", "author_id"])


QUERIES = {k: v for k, v in relation_queries.Q.items() if k not in _BEFORE}
ORACLES = {k: v for k, v in relation_queries.ORACLES.items() if k in QUERIES}

