"""From mention candidates to masters, and from masters to coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyori.functions import vocabulary as V
from fumiyori.functions.scoring import coordinate, is_invalid_candidate
from fumiyori.functions.text import normalize_place_name, prefecture_of, strip
from fumiyori.operators.relations import containing
from fumiyori.operators.sizing import broadcast_if_small
from fumiyori.session import cut_lineage

#: Characters of the shortest name that is looked up in sentences.
GRAM = 2
#: Numbers of first characters by which names are looked up in sentences.
WIDTHS = (GRAM, 4, 8)


def dictionary_candidates(sentences: DataFrame, names: DataFrame, name: str = "display_name", confidence: float = 0.8) -> DataFrame:
    """Occurrences of known names in sentences: ``sentence_id, text, start, end, confidence``.

    Names meet sentences by equality on as many of their first characters as a width of
    ``WIDTHS`` allows, so no pair of a sentence and a name that it cannot hold is looked at. As
    long as the names are few enough they are broadcast, because every position looks for them.
    """
    width = F.greatest(*(F.when(F.length(name) >= w, w) for w in WIDTHS))
    keyed = names.where(F.length(name) >= GRAM).select(F.col(name).alias("text"), F.substring(F.col(name), F.lit(1), width).alias("gram")).distinct()
    # A position carries as many characters as the longest name has, never its whole sentence.
    longest = keyed.agg(F.max(F.length("text"))).first()[0] or GRAM
    text = F.col("sentence_text")
    slices = F.transform(F.sequence(F.lit(0), F.length(text) - GRAM), lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(longest)).alias("slice")))
    places = sentences.where(F.length(text) >= GRAM).select("sentence_id", F.explode(slices).alias("p")).select("sentence_id", "p.start", "p.slice")
    widths = places.select("*", F.explode(F.array(*map(F.lit, WIDTHS))).alias("w")).where(F.length("slice") >= F.col("w"))
    grams = widths.select("sentence_id", "slice", "start", F.substring(F.col("slice"), F.lit(1), F.col("w")).alias("gram"))
    met = grams.join(broadcast_if_small(keyed), "gram").where(F.col("slice").startswith(F.col("text")))
    return met.select("sentence_id", "text", "start", (F.col("start") + F.length("text")).alias("end"), F.lit(confidence).alias("confidence"))


def pattern_candidates(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Tokens shaped like places, confidence 0.6."""
    return tokens.where(reduce(lambda a, b: a | b, (F.col(token).rlike(f"^(?:{p})") for p in V.CANDIDATE_PATTERNS))).withColumn("confidence", F.lit(0.6))


def compound_candidates(tokens: DataFrame) -> DataFrame:
    """A prefecture token directly followed by one with a city sign, joined: ``sentence_id, text, start, end, confidence``.

    ``tokens`` has ``sentence_id, pos, token, start``.
    """
    follow = Window.partitionBy("sentence_id").orderBy("pos")
    pairs = tokens.withColumn("after", F.lead("token").over(follow)).where(F.col("token").rlike(r"[都道府県]\z") & F.col("after").rlike("[市区町村]"))
    text = F.concat("token", "after")
    return pairs.select("sentence_id", text.alias("text"), "start", (F.col("start") + F.length(text)).alias("end"), F.lit(0.9).alias("confidence"))


def accepted(candidates: DataFrame, verdicts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Candidates (``name``) that a stored verdict accepts; without a verdict a name is accepted."""
    judged = verdicts.select("name", "is_place_name", "confidence")
    ok = F.coalesce(F.col("is_place_name") & (F.col("confidence") >= threshold), F.lit(True))
    return candidates.join(judged, "name", "left").where(ok).drop("is_place_name", "confidence")


def create_masters(names: DataFrame, masters: DataFrame) -> DataFrame:
    """``masters`` with one row for every new normalized name; rejected names stay blocked."""
    from fumiyori.operators.merging import get_or_create

    fresh = names.select(normalize_place_name(F.col("name")).alias("normalized_name"), "name").where("normalized_name <> ''").groupBy("normalized_name").agg(F.min("name").alias("display_name"))
    new = fresh.select("normalized_name", "display_name", F.lit("pending").alias("validation_status"), F.lit(0).cast("long").alias("usage_count"))
    return get_or_create(masters, new, "normalized_name", "master_id")


def locate_masters(masters: DataFrame, located: DataFrame) -> DataFrame:
    """Masters with coordinates filled where both are known and neither is 0; ``located`` has ``name, lat, lon, confidence``."""
    known = located.where("lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0").select(F.col("name").alias("display_name"), "lat", "lon", F.col("confidence").alias("_c"))
    merged = masters.join(known, "display_name", "left")
    return merged.withColumns({"latitude": F.coalesce("latitude", "lat"), "longitude": F.coalesce("longitude", "lon"), "geocoding_confidence": F.coalesce("geocoding_confidence", "_c")}).select(*masters.columns)


def best_candidates(candidates: DataFrame, by: list[str], text: str = "text", order: str = "ordinal") -> DataFrame:
    """One candidate per text: highest confidence, then lowest ordinal; short and invalid ones left out."""
    clean = candidates.withColumn(text, strip(F.col(text))).where((F.length(text) > 1) & ~is_invalid_candidate(F.col(text)))
    rest = [c for c in clean.columns if c not in (*by, text)]
    return clean.groupBy(*by, text).agg(F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), F.col(order))).alias("_r")).select(*by, text, *(F.col(f"_r.{c}").alias(c) for c in rest))


def resolve_masters(names: DataFrame, masters: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``name, master_id, tier`` of every distinct name: normalized, display, alias, then substring.

    Rejected masters are never found. The substring tier looks for the key in normalized names
    and for the name in display names, and takes the shortest normalized name, then the lowest
    id; an empty key is in none.
    """
    # Every tier reads the distinct names: they are written once.
    wanted = cut_lineage(names.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct().withColumn("key", normalize_place_name(F.col("name"))))
    live = masters.where("validation_status IS NULL OR validation_status <> 'rejected'").select("master_id", "normalized_name", "display_name")
    tier = lambda df, n: df.select("name", "master_id", F.lit(n).alias("tier"))
    hits = tier(wanted.join(live, wanted.key == live.normalized_name), 1).unionByName(tier(wanted.join(live, wanted.name == live.display_name), 2)).unionByName(
        tier(wanted.join(aliases.where("master_id IS NOT NULL").select("master_id", "alias_name").join(live.select("master_id"), "master_id"), F.col("name") == F.col("alias_name")), 3)
    )
    exact = hits.groupBy("name").agg(F.min(F.struct("tier", "master_id")).alias("m")).select("name", "m.master_id", "m.tier")
    open_ = cut_lineage(wanted.join(exact, "name", "left_anti").where("key <> ''"))
    # Per spelling the first master in the order of the tier: nothing else of a repeated spelling can win.
    first = lambda c: live.where(F.col(c) != "").groupBy(c).agg(F.min(F.struct(F.length("normalized_name").alias("n"), "master_id", "normalized_name")).alias("m")).select(F.col(c).alias("spelling"), "m.master_id", "m.normalized_name")
    rank = F.min(F.struct(F.length("normalized_name").alias("n"), "master_id")).alias("m")
    by_key = containing(open_, "key", first("normalized_name"), "spelling").groupBy("key").agg(rank)
    by_name = containing(open_, "name", first("display_name"), "spelling").groupBy("name").agg(rank)
    both = open_.join(by_key, "key").select("name", "m").unionByName(by_name.select("name", "m"))
    best = both.groupBy("name").agg(F.min("m").alias("m")).select("name", "m.master_id", F.lit(4).alias("tier"))
    return wanted.select("name").join(exact.unionByName(best), "name", "left")


def gazetteer(spark) -> DataFrame:
    """All tiers as rows ``tier, ordinal, name, lat, lon, location, confidence`` (a fixed table of under 100 rows)."""
    data = []
    for tier, table in enumerate((V.CITIES, V.HISTORICAL, V.PREFECTURES, V.FOREIGN), 1):
        data += [(tier, i, *row) for i, row in enumerate(V.rows(table))]
    return spark.createDataFrame(data, "tier int, ordinal int, name string, lat double, lon double, location string, confidence double")


def geocode(names: DataFrame, name: str = "name", compat: bool = True) -> DataFrame:
    """``name, tier, lat, lon, location, prefecture, confidence`` of distinct names by tiers.

    City, historical and foreign names match exactly; prefectures match by substring in list
    order (``compat``) or by their base name; what is left falls back to a containing or
    contained prefecture base (confidence less 0.3, at least 0.3) and city (less 0.2, at
    least 0.4).
    """
    spark = names.sparkSession
    wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    rows = F.broadcast(gazetteer(spark).withColumnRenamed("name", "entry").withColumn("base", F.translate("entry", "都府県", "")))
    contains = F.col("entry").contains(F.col("name")) if compat else F.col("base") == F.col("name")
    exact = F.col("tier").isin(1, 2, 4) & (F.col("entry") == F.col("name"))
    prefecture = (F.col("tier") == 3) & (contains | (F.col("base") == F.col("name")))
    near = lambda c: F.col("name").contains(c) | c.contains(F.col("name"))
    loose_prefecture = (F.col("tier") == 3) & near(F.col("base"))
    loose_city = (F.col("tier") == 1) & near(F.col("entry"))
    # The gazetteer is a fixed list of under 100 rows, so the substring join is a scan of that list per name.
    met = wanted.join(rows, exact | prefecture | loose_prefecture | loose_city, "left")
    rank = F.when(exact | prefecture, F.col("tier")).when(loose_prefecture, 5).otherwise(6)
    best = met.groupBy("name").agg(F.min(F.struct(rank.alias("rank"), "ordinal", "lat", "lon", "location", "confidence")).alias("g"))
    confidence = F.when(F.col("g.rank") == 5, F.greatest(F.lit(0.3), F.col("g.confidence") - 0.3)).when(F.col("g.rank") == 6, F.greatest(F.lit(0.4), F.col("g.confidence") - 0.2)).otherwise(F.col("g.confidence"))
    found = F.col("g.lat").isNotNull()
    return best.select("name", F.when(found, F.col("g.rank")).alias("tier"), F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"), F.col("g.location").alias("location"), prefecture_of(F.col("g.location")).alias("prefecture"), F.when(found, F.round(confidence, 4)).alias("confidence"))


def geocode_simple(names: DataFrame, name: str = "name") -> DataFrame:
    """``name, tier, lat, lon, location, prefecture, confidence`` of distinct names by the simple geocoder.

    Its places match exactly; then prefectures in list order that contain the name or equal it
    without 都府県; then prefectures whose base contains it or lies in it (confidence less 0.3).
    """
    entries = [(1, i, *row) for i, row in enumerate(V.rows(V.SIMPLE_PLACES))] + [(2, i, *row) for i, row in enumerate(V.rows(V.PREFECTURES))]
    rows = names.sparkSession.createDataFrame(entries, "tier int, ordinal int, entry string, lat double, lon double, location string, confidence double").withColumn("base", F.translate("entry", "都府県", ""))
    wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    n, prefecture = F.col("name"), F.col("tier") == 2
    rank = F.when(~prefecture, F.when(F.col("entry") == n, 1)).when(F.col("entry").contains(n) | (F.col("base") == n), 2).when(n.contains(F.col("base")) | F.col("base").contains(n), 3)
    # A fixed list of under 100 rows: the substring join is a scan of that list per name.
    met = wanted.join(F.broadcast(rows), rank.isNotNull(), "left")
    best = met.groupBy("name").agg(F.min(F.struct(rank.alias("tier"), "ordinal", "lat", "lon", "location", "confidence")).alias("g"))
    found = F.col("g.lat").isNotNull()
    return best.select("name", F.when(found, F.col("g.tier")).alias("tier"), F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"), F.col("g.location").alias("location"), prefecture_of(F.col("g.location")).alias("prefecture"), F.when(found, F.round(F.when(F.col("g.tier") == 3, F.greatest(F.lit(0.3), F.col("g.confidence") - 0.3)).otherwise(F.col("g.confidence")), 4)).alias("confidence"))


def geocode_in_context(judged: DataFrame) -> DataFrame:
    """The tiers of :func:`geocode` for the names that some context takes for a place; ``judged`` has ``name, is_place``."""
    return geocode(judged.where("is_place").select("name"))


def propagated_coordinates(mentions: DataFrame, masters: DataFrame) -> DataFrame:
    """``relation_id, latitude, longitude, geocoding_source, geocoding_confidence`` of mentions whose master is located."""
    located = masters.select("master_id", coordinate("latitude").alias("latitude"), coordinate("longitude").alias("longitude"), "geocoding_source", "geocoding_confidence").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return mentions.select("relation_id", "master_id").join(located, "master_id").drop("master_id")


def best_address(results: DataFrame, name: str = "name", address: str = "address", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per name the result whose address has the name, else the first inside Japan, else the first."""
    inside = F.coalesce(F.col(lat).between(24, 46) & F.col(lon).between(123, 146), F.lit(False))
    rank = F.when(F.col(address).contains(F.col(name)), 0).when(inside, 1).otherwise(2)
    columns = [c for c in results.columns if c != name]
    return results.groupBy(name).agg(F.min_by(F.struct(*columns), F.struct(rank, F.col("ordinal"))).alias("_r")).select(name, *(F.col(f"_r.{c}").alias(c) for c in columns))


def address_confidence(in_address: Column, is_place: Column, context: Column, location_type: Column) -> Column:
    grade = F.when(location_type == "ROOFTOP", 0.1).when(location_type == "RANGE_INTERPOLATED", 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.7 + F.when(in_address, 0.2).otherwise(0.0) + F.when(is_place, 0.1).otherwise(0.0) + 0.1 * context + grade)


def search_index(masters: DataFrame, aliases: DataFrame) -> DataFrame:
    """``master_id, tokens`` over all names of a place, split at what is no letter or digit, case-folded."""
    names = masters.select("master_id", F.concat_ws(" ", "normalized_name", "display_name", "canonical_name").alias("t")).unionByName(aliases.where("master_id IS NOT NULL").select("master_id", F.col("alias_name").alias("t")))
    words = names.select("master_id", F.explode(F.split(F.lower("t"), r"(?U)[^\p{L}\p{N}]+")).alias("token")).where("token <> ''").distinct()
    return words.groupBy("master_id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def updated_index(index: DataFrame, changed: DataFrame, masters: DataFrame, aliases: DataFrame) -> DataFrame:
    """``index`` with the entries of the ``changed`` masters (``master_id``) made anew; those of masters that are gone leave."""
    ids = changed.select("master_id").distinct()
    fresh = search_index(masters.join(ids, "master_id", "left_semi"), aliases.join(ids, "master_id", "left_semi"))
    return index.join(ids, "master_id", "left_anti").unionByName(fresh)


def search_places(index: DataFrame, term: str) -> DataFrame:
    return index.where(F.array_contains("tokens", term.lower())).select("master_id")
