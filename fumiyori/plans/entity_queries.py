"""Queries of candidates, resolution, contexts, coordinates, quality, pages and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumiyori.functions import scoring as C
from fumiyori.functions import vocabulary as V
from fumiyori.operators import resolving as G
from fumiyori.operators import statistics as S
from fumiyori.operators.sizing import spread
from fumiyori.operators.relations import name_key
from fumiyori.sources import pages as P
from fumiyori.plans.relation_queries import query as _register
from fumiyori.plans import relation_queries
from fumiyori.plans.text_queries import sentence_score_sql

_BEFORE = set(relation_queries.Q)
query = _register
_LAT = relation_queries._LAT


def _texts(t):
    """Distinct (name, sentence) pairs of mentions, which the scores are computed on."""
    return t("sentence_places").select("sentence_id", F.col("matched_text").alias("name")).join(t("sentences").select("sentence_id", "sentence_text"), "sentence_id").where("name IS NOT NULL").select("name", "sentence_text").distinct()


def _hits(text: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '{p}')::INT" for p in patterns) + ")"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PAIRS = "(SELECT DISTINCT matched_text AS name, sentence_text FROM sentence_places JOIN sentences USING (sentence_id) WHERE matched_text IS NOT NULL)"
_SURE = _list(k for k, v in V.AMBIGUOUS_PERSON.items() if v > 0.5)


@query(f"""
    SELECT name, sentence_text,
           CASE WHEN name = '' OR bad OR known THEN false ELSE p > q END AS is_place,
           CASE WHEN name = '' THEN 0.0 WHEN bad THEN 0.9 WHEN known THEN 0.85 ELSE round(greatest(p, q) * CASE WHEN name IN ({_SURE}) THEN 0.7 ELSE 1.0 END::DOUBLE, 4) END AS confidence,
           CASE WHEN name = '' THEN '不明' WHEN bad THEN '無効' WHEN known THEN '人名・学術用語' WHEN regexp_matches(name, '[都道府県市区町村]') THEN '都市' WHEN regexp_matches(name, '寺|神社|城|駅|橋') THEN '建物' WHEN regexp_matches(name, '[山川海湖島]') THEN '自然' WHEN regexp_matches(name, '国|藩') THEN '歴史' ELSE '一般' END AS place_type
    FROM (SELECT *, regexp_matches(name, '{'|'.join(V.INVALID_NAMES)}') AS bad, name IN ({_list(V.PERSON_NAMES + V.ACADEMIC_A)}) AS known,
                 least(1.0::DOUBLE, {_hits('x', V.PLACE_CONTEXT)} * 0.1::DOUBLE) AS p, least(1.0::DOUBLE, {_hits('x', V.PERSON_CONTEXT)} * 0.15::DOUBLE) AS q
          FROM (SELECT *, ' ' || sentence_text || ' ' AS x FROM {_PAIRS}))""")
def context_scores_a(t):
    """Context analysis A on every distinct pair of a name and its sentence."""
    none = F.lit(None).cast("string")
    return _texts(t).select("name", "sentence_text", C.context_a(F.col("name"), F.col("sentence_text"), none, none).alias("c")).select("name", "sentence_text", "c.is_place", "c.confidence", "c.place_type")


def _context_b_sql(pairs: str) -> str:
    """Context analysis B of (name, sentence_text) rows."""
    return f"""
    SELECT *,
           CASE WHEN person OR learned OR common OR doubtful THEN false ELSE a + h > b END AS is_place,
           CASE WHEN person THEN 0.95 WHEN learned THEN 0.90 WHEN common THEN 0.85 WHEN doubtful THEN 0.8 WHEN a + h > 0 THEN round(least(0.95::DOUBLE, 0.5 + (a + h) * 0.15::DOUBLE), 4) ELSE 0.5 END AS confidence,
           CASE WHEN person THEN '人名' WHEN learned THEN '学術用語' WHEN common THEN '一般名詞' WHEN doubtful THEN '人名' WHEN h > 0 THEN '歴史地名' WHEN name IN ({_list(r[0] for r in V.rows(V.CITIES))}) THEN '都市部' WHEN regexp_matches(name, '[都府県]$') THEN '都道府県' ELSE '一般地名' END AS place_type,
           CASE WHEN person THEN '人名: ' || name WHEN learned THEN '学術用語: ' || name WHEN common THEN '一般名詞: ' || name WHEN doubtful THEN '人名指標: ' || name ELSE '地名指標' || (a + h) || '件 vs 人名指標' || b || '件' END AS reasoning
    FROM (SELECT *, name IN ({_list(V.PERSON_NAMES)}) AS person, name IN ({_list(V.ACADEMIC_B)}) AS learned, name IN ({_list(V.COMMON_NOUNS)}) AS common, name IN ({_SURE}) AND b > a AS doubtful
          FROM (SELECT *, {_hits('x', V.PLACE_CONTEXT)} AS a, {_hits('x', V.PERSON_CONTEXT)} AS b, {_hits('x', V.HISTORY_CONTEXT)} AS h FROM (SELECT *, ' ' || coalesce(sentence_text, '') || ' ' AS x FROM {pairs})))"""


@query(f"SELECT name, sentence_text, is_place, confidence, place_type, reasoning FROM ({_context_b_sql(_PAIRS)})")
def context_scores_b(t):
    """Context analysis B on the same pairs."""
    none = F.lit(None).cast("string")
    return _texts(t).select("name", "sentence_text", C.context_b(F.col("name"), F.col("sentence_text"), none, none).alias("c")).select("name", "sentence_text", "c.is_place", "c.confidence", "c.place_type", "c.reasoning")


_VOTES = "(SELECT master_id, count(*) AS n, count_if(ai_verified) AS k, avg(ai_confidence) AS m FROM sentence_places WHERE master_id IS NOT NULL AND ai_confidence IS NOT NULL GROUP BY 1)"


@query(f"""
    SELECT master_id, k / n >= 0.5 AS is_valid, round(m * CASE WHEN k = 0 THEN 1.0 WHEN k / n < 0.3 THEN 0.8 WHEN k / n < 0.7 THEN 0.9 ELSE 1.0 END, 9) AS confidence,
           CASE WHEN k = 0 THEN '削除推奨' WHEN k / n < 0.3 THEN '削除検討' WHEN k / n < 0.7 THEN '要再検討' ELSE '保持推奨' END AS action FROM {_VOTES}""")
def vote_verdicts(t):
    """Votes of the mentions over their master."""
    votes = t("sentence_places").where("master_id IS NOT NULL AND ai_confidence IS NOT NULL").groupBy("master_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ai_verified").alias("k"), F.avg("ai_confidence").alias("m"))
    return votes.select("master_id", C.verdict(F.col("n"), F.col("k"), F.col("m")).alias("v")).select("master_id", "v.is_valid", "v.confidence", "v.action")


@query(f"""
    SELECT p.master_id, CASE WHEN v.n IS NULL THEN 'error' WHEN k / n < 0.5 AND round(m * CASE WHEN k = 0 THEN 1.0 WHEN k / n < 0.3 THEN 0.8 ELSE 0.9 END, 9) >= 0.7 THEN 'delete' ELSE 'verified' END AS outcome FROM place_masters p LEFT JOIN {_VOTES} v USING (master_id)""")
def verification_split(t):
    """Masters to delete, verified, or without an analysis."""
    votes = t("sentence_places").where("master_id IS NOT NULL AND ai_confidence IS NOT NULL").groupBy("master_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ai_verified").alias("k"), F.avg("ai_confidence").alias("m"))
    judged = t("place_masters").select("master_id").join(votes, "master_id", "left").select("master_id", "n", C.verdict(F.col("n"), F.col("k"), F.col("m")).alias("v"))
    return judged.select("master_id", F.when(F.col("n").isNull(), "error").when(~F.col("v.is_valid") & (F.col("v.confidence") >= 0.7), "delete").otherwise("verified").alias("outcome"))


@query(f"""
    SELECT * FROM (SELECT master_id, name AS display_name, usage_count, CASE WHEN NOT is_place AND contains(reasoning, '人名') THEN '人名として判定' WHEN regexp_matches(name, '毎日|自然') THEN '架空地名または抽象表現' END AS reason
    FROM ({_context_b_sql(f"(SELECT master_id, display_name AS name, usage_count, sample_text AS sentence_text FROM ({relation_queries._UNGEOCODED}))")})) WHERE reason IS NOT NULL""")
def cleanup_candidates(t):
    """Places without coordinates whose sample speaks for a person."""
    used = S.ungeocoded_usage(t("place_masters"), t("sentence_places"), t("sentences"))
    none = F.lit(None).cast("string")
    judged = used.select("master_id", "display_name", "usage_count", C.context_b(F.col("display_name"), F.col("sample_text"), none, none).alias("c"))
    why = F.when(~F.col("c.is_place") & F.col("c.reasoning").contains("人名"), "人名として判定").when(F.col("display_name").rlike("毎日|自然"), "架空地名または抽象表現")
    return judged.select("master_id", "display_name", "usage_count", why.alias("reason")).where("reason IS NOT NULL")


@query("""
    SELECT m.sentence_id, m.name, arg_min(method, {'c': -conf, 'o': relation_id}) AS extraction_method, max(conf) AS confidence FROM (
        SELECT sentence_id, relation_id, extraction_method AS method, coalesce(extraction_confidence, 0) AS conf, regexp_replace(matched_text, '^[\\s　\\x{00a0}]+|[\\s　\\x{00a0}]+$', '', 'g') AS name FROM sentence_places) m
    WHERE length(name) > 1 AND NOT regexp_matches(name, '%s') AND name NOT IN (%s) GROUP BY 1, 2""" % ("|".join(V.INVALID_CANDIDATES), _list(V.CANDIDATE_STOP_WORDS)))
def dedup_candidates(t):
    """The best candidate per sentence and text."""
    c = t("sentence_places").select("sentence_id", F.col("matched_text").alias("text"), F.coalesce("extraction_confidence", F.lit(0.0)).alias("confidence"), F.col("relation_id").alias("ordinal"), "extraction_method")
    return G.best_candidates(c, ["sentence_id"]).select("sentence_id", F.col("text").alias("name"), "extraction_method", "confidence")


@query("""
    SELECT sentence_id, display_name AS name, i - 1 AS start_position FROM (SELECT DISTINCT display_name FROM place_masters WHERE validation_status IS NULL OR validation_status <> 'rejected'), (SELECT sentence_id, sentence_text, unnest(range(1, length(sentence_text) + 1)) AS i FROM sentences)
    WHERE substring(sentence_text, i, length(display_name)) = display_name AND length(display_name) >= 2""")
def dictionary_candidates(t):
    """Names of all places that are not rejected, found in sentences by the default tagger."""
    names = t("place_masters").where("validation_status IS NULL OR validation_status <> 'rejected'")
    return G.dictionary_candidates(t("sentences"), names).select("sentence_id", F.col("text").alias("name"), F.col("start").cast("long").alias("start_position"))


@query("SELECT DISTINCT matched_text AS token, 0.6 AS confidence FROM sentence_places WHERE regexp_matches(matched_text, '%s')" % "|".join(f"^(?:{p})" for p in V.CANDIDATE_PATTERNS))
def pattern_candidates(t):
    tokens = t("sentence_places").select(F.col("matched_text").alias("token")).distinct()
    return G.pattern_candidates(tokens)


_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(translate(regexp_replace({0}, '^[\\s　\\x{{00a0}}]+|[\\s　\\x{{00a0}}]+$', '', 'g'), '１２３４５６７８９０', '1234567890'), '東亰', '東京'), '大坂', '大阪'), '横濱', '横浜'), '県府市区町村', ''), '[のにへでを]$', ''), '山山+', '山', 'g'), '川川+', '川', 'g'), '島島+', '島', 'g')"


@query(f"""
    WITH w AS (SELECT DISTINCT matched_text AS name, {_KEY.format('matched_text')} AS key FROM sentence_places WHERE matched_text <> ''),
    live AS (SELECT * FROM place_masters WHERE validation_status IS NULL OR validation_status <> 'rejected'),
    hits AS (
        SELECT name, 1 AS tier, master_id FROM w JOIN live ON key = normalized_name UNION ALL SELECT name, 2, master_id FROM w JOIN live ON name = display_name
        UNION ALL SELECT name, 3, a.master_id FROM w JOIN place_aliases a ON name = alias_name JOIN live USING (master_id)),
    exact AS (SELECT name, min(tier) AS tier, arg_min(master_id, tier::BIGINT * 1000000000 + master_id) AS master_id FROM hits GROUP BY 1),
    part AS (SELECT name, arg_min(master_id, length(normalized_name)::BIGINT * 1000000000 + master_id) AS master_id FROM w JOIN live ON contains(normalized_name, key) OR contains(display_name, name)
             WHERE name NOT IN (SELECT name FROM exact) AND key <> '' GROUP BY 1)
    SELECT w.name, coalesce(e.master_id, p.master_id) AS master_id, CASE WHEN e.name IS NOT NULL THEN e.tier WHEN p.name IS NOT NULL THEN 4 END AS tier FROM w LEFT JOIN exact e USING (name) LEFT JOIN part p ON p.name = w.name""")
def resolve_tiers(t):
    """Masters of all distinct mention texts by four tiers."""
    return G.resolve_masters(t("sentence_places").select(F.col("matched_text").alias("name")), t("place_masters"), t("place_aliases"))


def _values(tier: int, table: str) -> str:
    return ", ".join(f"({tier}, {i}, '{n}', {a}::DOUBLE, {o}::DOUBLE, '{loc}', {c}::DOUBLE)" for i, (n, a, o, loc, c) in enumerate(V.rows(table)))


_GAZ = "(SELECT *, translate(entry, '都府県', '') AS base FROM (VALUES " + ", ".join(_values(i, x) for i, x in enumerate((V.CITIES, V.HISTORICAL, V.PREFECTURES, V.FOREIGN), 1)) + ") g(tier, ordinal, entry, lat, lon, location, confidence))"


@query(f"""
    WITH w AS (SELECT DISTINCT display_name AS name FROM place_masters WHERE display_name <> ''),
    g AS (SELECT w.name, tier, ordinal, lat, lon, location, confidence,
                 CASE WHEN (tier IN (1, 2, 4) AND entry = name) OR (tier = 3 AND (contains(entry, name) OR base = name)) THEN tier WHEN tier = 3 AND (contains(name, base) OR contains(base, name)) THEN 5 WHEN tier = 1 AND (contains(name, entry) OR contains(entry, name)) THEN 6 END AS rank
          FROM w JOIN {_GAZ} ON true QUALIFY rank IS NOT NULL AND row_number() OVER (PARTITION BY w.name ORDER BY rank NULLS LAST, ordinal) = 1)
    SELECT w.name, rank AS tier, lat, lon, location, CASE WHEN contains(location, '都') THEN split_part(location, '都', 1) || '都' WHEN contains(location, '府') THEN split_part(location, '府', 1) || '府' WHEN contains(location, '県') THEN split_part(location, '県', 1) || '県' END AS prefecture,
           round(CASE rank WHEN 5 THEN greatest(0.3, confidence - 0.3) WHEN 6 THEN greatest(0.4, confidence - 0.2) ELSE confidence END, 4) AS confidence FROM w LEFT JOIN g USING (name)""")
def geocode_tiers(t):
    """Coordinates of all distinct place names by the gazetteer tiers."""
    return G.geocode(t("place_masters").select(F.col("display_name").alias("name")))


@query("SELECT master_id, coalesce(latitude BETWEEN 24 AND 46 AND longitude BETWEEN 123 AND 146, false) AS in_a, coalesce(latitude BETWEEN 24 AND 45.5 AND longitude BETWEEN 122 AND 146, false) AS in_b FROM place_masters")
def bounding_boxes(t):
    return t("place_masters").select("master_id", C.in_japan(F.col("latitude"), F.col("longitude"), "A").alias("in_a"), C.in_japan(F.col("latitude"), F.col("longitude"), "B").alias("in_b"))


_SHAPE = "|".join(p for _, p in V.PLACE_SHAPES)


@query(f"""
    SELECT relation_id, round(CASE WHEN length(name) < 2 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN length(name) > 50 THEN 0.9 ELSE 1.0 END * CASE WHEN c < 0.6 THEN 0.7 ELSE 1.0 END * CASE WHEN regexp_matches(name, '{_SHAPE}') THEN 1.0 ELSE 0.6 END, 4) AS place_score,
           round(CASE WHEN x = '' THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN contains(x, name) THEN 1.0 ELSE 0.5 END * CASE WHEN length(x) < 10 THEN 0.9 ELSE 1.0 END, 4) AS mention_score
    FROM (SELECT relation_id, matched_text AS name, extraction_confidence AS c, coalesce(sentence_text, '') AS x FROM sentence_places LEFT JOIN sentences USING (sentence_id))""")
def quality_scores(t):
    m = t("sentence_places").select("relation_id", "sentence_id", F.col("matched_text").alias("name"), F.col("extraction_confidence").alias("c")).join(t("sentences").select("sentence_id", "sentence_text"), "sentence_id", "left")
    return m.select("relation_id", C.place_quality(F.col("name"), F.col("c")).alias("place_score"), C.mention_quality(F.col("name"), F.col("sentence_text")).alias("mention_score"))


@query(f"""
    SELECT *, round(0.3 * sentence_score + 0.4 * place_score + 0.3 * mention_score, 2) AS overall FROM (
        SELECT relation_id, {sentence_score_sql('sentence_text')} AS sentence_score,
               round(CASE WHEN length(name) < 2 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN length(name) > 50 THEN 0.9 ELSE 1.0 END * CASE WHEN c < 0.6 THEN 0.7 ELSE 1.0 END * CASE WHEN regexp_matches(name, '{_SHAPE}') THEN 1.0 ELSE 0.6 END, 4) AS place_score,
               round(CASE WHEN x = '' THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN contains(x, name) THEN 1.0 ELSE 0.5 END * CASE WHEN length(x) < 10 THEN 0.9 ELSE 1.0 END, 4) AS mention_score,
               list_filter([{', '.join(f"CASE WHEN regexp_matches(name, '{p}') THEN '{n}' END" for n, p in V.PLACE_SHAPES)}], lambda s: s IS NOT NULL) AS shapes
        FROM (SELECT relation_id, matched_text AS name, extraction_confidence AS c, sentence_text, coalesce(sentence_text, '') AS x FROM sentence_places JOIN sentences USING (sentence_id)))""")
def overall_scores(t):
    """The three scores of a mention combined."""
    m = t("sentence_places").select("relation_id", "sentence_id", F.col("matched_text").alias("name"), F.col("extraction_confidence").alias("c")).join(t("sentences").select("sentence_id", "sentence_text"), "sentence_id")
    s, p, q = C.sentence_quality(F.col("sentence_text")), C.place_quality(F.col("name"), F.col("c")), C.mention_quality(F.col("name"), F.col("sentence_text"))
    return m.select("relation_id", s.alias("sentence_score"), p.alias("place_score"), q.alias("mention_score"), C.overall_quality(s, p, q).alias("overall"), C.place_shapes(F.col("name")).alias("shapes"))


@query("""
    SELECT DISTINCT master_id FROM (
        SELECT master_id, concat_ws(' ', normalized_name, display_name, canonical_name) AS x FROM place_masters UNION ALL SELECT master_id, alias_name FROM place_aliases WHERE master_id IS NOT NULL)
    WHERE list_contains(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+'), 'port')""")
def place_search(t):
    """Places with a word in any of their names."""
    return G.search_places(G.search_index(t("place_masters"), t("place_aliases")), "port")


@query("SELECT 'extra' AS side, column_name FROM (SELECT column_name FROM (DESCRIBE authors) WHERE column_name NOT IN ('author_id', 'author_name', 'aozora_author_url', 'birth_year', 'death_year', 'wikipedia_url', 'created_at', 'updated_at')) UNION ALL SELECT 'missing', 'wikipedia_url'")
def schema_difference(t):
    """Columns of the table against the expected ones."""
    from fumiyori.schema import AUTHORS_CORE, schema_diff

    return schema_diff(t("authors"), AUTHORS_CORE)


@query("SELECT sentence_id, prefecture || display_name AS text, 0 AS start_position, 0.9 AS confidence FROM (SELECT master_id AS sentence_id, prefecture, display_name FROM place_masters) WHERE regexp_matches(prefecture, '[都道府県]$') AND regexp_matches(display_name, '[市区町村]')")
def compound_candidates(t):
    """Prefecture and city tokens that follow each other (tokens made of the masters' names)."""
    p = t("place_masters").select(F.col("master_id").alias("sentence_id"), F.posexplode(F.array("prefecture", "display_name")).alias("pos", "token"))
    return G.compound_candidates(p.withColumn("start", F.lit(0))).select("sentence_id", "text", F.col("start").alias("start_position"), "confidence")


@query(f"""
    SELECT name, n_uses, n_place, CASE WHEN n_place = 0 THEN '削除推奨' WHEN n_place / n_uses < 0.5 THEN '削除検討' ELSE '保持推奨' END AS action
    FROM (SELECT name, count(*) AS n_uses, count_if(is_place) AS n_place FROM ({_context_b_sql(_PAIRS)}) GROUP BY name)""")
def usage_actions(t):
    """Recommended action per mention text, from engine B on its sentences."""
    none = F.lit(None).cast("string")
    judged = _texts(t).select("name", C.context_b(F.col("name"), F.col("sentence_text"), none, none).is_place.alias("is_place"))
    return S.usage_actions(judged, "name")


@query(f"""
    SELECT author_id, count(DISTINCT s.sentence_id) AS processed, count(m.relation_id) AS extracted, count({_LAT}) AS geocoded, round(count({_LAT}) * 100.0::DOUBLE / greatest(1, count(m.relation_id)), 2) AS success_rate
    FROM works w JOIN sentences s USING (work_id) LEFT JOIN sentence_places m USING (sentence_id) LEFT JOIN place_masters p USING (master_id) WHERE author_id IS NOT NULL GROUP BY 1""")
def author_geocoding(t):
    """Sentences, mentions and located mentions of every author."""
    s = t("works").where("author_id IS NOT NULL").select("work_id", "author_id").join(t("sentences").select("sentence_id", "work_id"), "work_id")
    m = t("sentence_places").select("relation_id", "sentence_id", "master_id").join(t("place_masters").select("master_id", C.coordinate("latitude").alias("latitude")), "master_id", "left").groupBy("sentence_id").agg(F.count("relation_id").alias("e"), F.count("latitude").alias("g"))
    per = s.join(m, "sentence_id", "left").groupBy("author_id", "sentence_id").agg(F.max("e").alias("e"), F.max("g").alias("g")).groupBy("author_id")
    e, g = F.coalesce(F.sum("e"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))
    return per.agg(F.count(F.lit(1)).alias("processed"), e.alias("extracted"), g.alias("geocoded"), F.round(g * 100.0 / F.greatest(F.lit(1), e), 2).alias("success_rate"))


@query("SELECT count(*) AS processed, count(processed_at) AS succeeded, count(*) - count(processed_at) AS failed, count(*)::BIGINT AS new_works, coalesce(sum(sentence_count), 0)::BIGINT AS sentences, round(count(processed_at) * 100.0::DOUBLE / count(*), 2) AS success_rate, round(sum(content_length * 0.001::DOUBLE) / greatest(1, sum(sentence_count)), 6) AS seconds_per_sentence FROM works")
def run_reports(t):
    """A report over works as steps of a run."""
    w = t("works").select(F.col("processed_at").isNotNull().alias("ok"), F.lit(1).alias("n_new"), F.col("sentence_count").alias("n_sentences"), (F.col("content_length") * 0.001).alias("seconds"))
    return S.run_report(w)


@query("SELECT master_id FROM place_masters WHERE contains(concat_ws(' ', normalized_name, display_name, canonical_name), '橋')")
def place_substring_search(t):
    return t("place_masters").where(F.concat_ws(" ", "normalized_name", "display_name", "canonical_name").contains("橋")).select("master_id")


# --- pages: index and card pages are written from the tables and read back --------------------


def _index_pages(t):
    """One index page a section, as HTML (a section's list is one page, as the site has it)."""
    a = t("authors").where("section IS NOT NULL").select("section", "author_id", "author_name", F.coalesce("aozora_works_count", F.lit(0)).alias("n"), F.coalesce("copyright_status", F.lit("expired")).alias("c"))
    li = F.concat(F.lit('<li><a href="person'), F.col("author_id"), F.lit('.html#sakuhin">'), F.translate("author_name", "<>&()", ""), F.lit("</a> (公開中："), F.col("n"), F.lit(")"), F.when(F.col("c") == "active", " ＊著作権存続＊").otherwise(""), F.lit("</li>"))
    return a.select("section", li.alias("li")).groupBy("section").agg(F.concat_ws("\n", F.collect_list("li")).alias("items")).select(F.concat(F.lit("https://bunko.example/index/"), F.col("section"), F.lit(".html")).alias("url"), F.concat(F.lit("<html><h1>索引</h1><ol>"), F.col("items"), F.lit("</ol></html>")).alias("html"))


@query("SELECT regexp_replace(translate(author_name, '<>&()', ''), '^[\\s　\\x{00a0}]+|[\\s　\\x{00a0}]+$', '', 'g') AS name, coalesce(aozora_works_count, 0)::INT AS works_count, CASE WHEN copyright_status = 'active' THEN 'active' ELSE 'expired' END AS copyright_status, 'https://bunko.example/index_pages/person' || author_id || '.html' AS author_url FROM authors WHERE section IS NOT NULL")
def author_index_pages(t):
    return P.author_index(_index_pages(t)).select("name", "works_count", "copyright_status", "author_url")


def _cards(t):
    """One card page a work; an id below 0 has no address, as addresses hold digits only."""
    w = t("works").where("author_id >= 0")
    title = F.translate("title", "<>&", "")
    return w.select(
        F.concat(F.lit("https://bunko.example/cards/"), F.lpad(F.col("author_id").cast("string"), 6, "0"), F.lit("/card"), F.col("work_id"), F.lit(".html")).alias("url"),
        F.concat(
            F.lit("<html><head><title>x</title></head><body><h1>"), title, F.lit('</h1><h2>公開中の作品</h2><ol><li><a href="/cards/'), F.col("work_id"), F.lit('/card.html">'), title, F.lit('</a></li></ol><table summary="作品データ"><tr><th>初出：</th><td>'),
            F.coalesce(F.nullif("publication_year", F.lit(0)).cast("string"), F.lit("")), F.lit('年</td></tr></table><table summary="工作員データ"><tr><td>入力：</td><td>係'), F.col("work_id"), F.lit('</td></tr><tr><td>校正：</td><td>校'), F.col("work_id"), F.lit("</td></tr></table></body></html>"),
        ).alias("html"),
    ).where("url IS NOT NULL AND html IS NOT NULL")


@query("SELECT lpad(author_id::VARCHAR, 6, '0') AS source_work_id, work_id::VARCHAR AS card_id, CASE WHEN publication_year BETWEEN 1800 AND 2100 THEN publication_year END AS publication_year, '係' || work_id AS input_person, '校' || work_id AS proof_person FROM works WHERE author_id >= 0 AND title IS NOT NULL")
def card_metadata(t):
    return P.card_metadata(_cards(t)).select("source_work_id", "card_id", "publication_year", "input_person", "proof_person")


@query("SELECT '/cards/' || work_id || '/card.html' AS href FROM works WHERE author_id >= 0 AND title IS NOT NULL")
def work_links(t):
    return P.works_under_heading(_cards(t)).select("href")


@query("SELECT '/cards/' || work_id || '/card.html' AS href FROM works WHERE author_id >= 0 AND title IS NOT NULL")
def card_links(t):
    return P.links(_cards(t), "cards").select("href")


@query("SELECT work_id::VARCHAR AS card_id, 1 AS n_h1, 1 AS n_h2, 0 AS n_h3, 1 AS n_ol, 1 AS n_li, 0 AS n_author_items FROM works WHERE author_id >= 0 AND title IS NOT NULL")
def page_structure(t):
    return P.structure_profile(_cards(t)).select(F.regexp_extract("url", r"card(\d+)\.html", 1).alias("card_id"), "n_h1", "n_h2", "n_h3", "n_ol", "n_li", "n_author_items")


@query(r"""
    SELECT 'https://bunko.example/cards/' || lpad(author_id::VARCHAR, 6, '0') || '/card' || work_id || '.html' AS url,
           regexp_replace(x || '公開中の作品' || x || '初出：' || coalesce(nullif(publication_year, 0)::VARCHAR, '') || '年入力：係' || work_id || '校正：校' || work_id, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}　]+', '') AS text
    FROM (SELECT *, translate(title, '<>&', '') AS x FROM works) WHERE author_id >= 0 AND title IS NOT NULL""".replace("\\\\", "\\"))
def main_texts(t):
    """Main text of pages by the parser, furniture left out."""
    return _cards(t).select("url", P.main_text(F.col("html")).alias("text"))


@query("SELECT author_name, coalesce(author_name_kana, '') AS kana, coalesce(copyright_status, 'expired') AS copyright_status, coalesce(section, 'その他') AS section, 'v4.0' AS source_system FROM authors")
def author_projection(t):
    """Export columns under their table names with defaults."""
    a = t("authors").select(F.col("author_name").alias("name"), F.col("author_name_kana").alias("name_reading"), F.col("aozora_works_count").alias("works_count"), "copyright_status", F.col("aozora_author_url").alias("author_url"), "alias_info", "section")
    return P.author_rows(a).select("author_name", F.coalesce("author_name_kana", F.lit("")).alias("kana"), "copyright_status", "section", "source_system")


@query("SELECT author_id, replace(replace(author_name, ' ', ''), '　', '') AS name_key FROM authors ORDER BY author_name, author_id")
def author_scan(t):
    return t("authors").orderBy("author_name", "author_id").select("author_id", name_key(F.col("author_name")).alias("name_key"))


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, coalesce(round(avg(value), 6), 0) AS avg_value FROM events GROUP BY ALL""")
def hourly_metrics(t):
    """The streaming metrics on the events as a batch."""
    from fumiyori.streaming.metrics import hourly_metrics as metrics

    return metrics(t("events"))


@query()
def pipeline_mentions(t):
    """Documents cut into sentences, tagged and resolved in one plan."""
    from fumiyori.functions.text import clean_markup
    from fumiyori.plans import pipeline

    texts = spread(t("documents").select("doc_id", "text")).select("doc_id", clean_markup(F.col("text")).alias("text")).where("text <> ''")
    cut = pipeline.sentences_of_texts(texts.select(F.col("doc_id").alias("work_id"), "text"))
    sentences = cut.withColumn("sentence_id", F.xxhash64("work_id", "sentence_order"))
    return pipeline.mentions_of_sentences(sentences, t("place_masters"), t("place_aliases"))


QUERIES = {k: v for k, v in relation_queries.Q.items() if k not in _BEFORE}
ORACLES = {k: v for k, v in relation_queries.ORACLES.items() if k in QUERIES}
