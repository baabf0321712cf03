"""Scores of contexts, candidates, texts and mentions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fumiyori.functions import vocabulary as V


def _occurs(c: Column, pattern: str) -> Column:
    """``rlike``; a literal, or one after a few characters to choose from, is found by plain searches that cost less."""
    choice = re.fullmatch(r"(?:\[([^\]\\^-]+)\])?([^\[\]\\.*+?{}()|^$]+)", pattern)
    if not choice:
        return c.rlike(pattern)
    return reduce(lambda a, b: a | b, (c.contains(first + choice.group(2)) for first in choice.group(1) or [""]))


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in a text (each counts once)."""
    return F.size(F.filter(F.array(*(_occurs(c, p) for p in patterns)), lambda hit: hit))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def is_invalid_name(c: Column) -> Column:
    return c.rlike("|".join(V.INVALID_NAMES))


def is_invalid_candidate(c: Column) -> Column:
    return c.rlike("|".join(V.INVALID_CANDIDATES)) | c.isin(V.CANDIDATE_STOP_WORDS)


def context_a(place: Column, sentence: Column, before: Column, after: Column) -> Column:
    """Struct is_place, confidence, place_type, reason of engine A."""
    text = F.concat(F.coalesce(before, F.lit("")), F.lit(" "), F.coalesce(sentence, F.lit("")), F.lit(" "), F.coalesce(after, F.lit("")))
    found = F.struct(F.least(F.lit(1.0), hits(text, V.PLACE_CONTEXT) * 0.1).alias("p"), F.least(F.lit(1.0), hits(text, V.PERSON_CONTEXT) * 0.15).alias("q"))
    ambiguous = place.isin([k for k, v in V.AMBIGUOUS_PERSON.items() if v > 0.5])
    kind = F.when(place.rlike("[都道府県市区町村]"), "都市").when(place.rlike("寺|神社|城|駅|橋"), "建物").when(place.rlike("[山川海湖島]"), "自然").when(place.rlike("国|藩"), "歴史").otherwise("一般")
    fixed = lambda confidence, label: F.struct(F.lit(False).alias("is_place"), F.lit(confidence).alias("confidence"), F.lit(label).alias("place_type"))
    scored = _let(found, lambda h: F.struct((h.p > h.q).alias("is_place"), F.round(F.greatest(h.p, h.q) * F.when(ambiguous, 0.7).otherwise(1.0), 4).alias("confidence"), kind.alias("place_type")))
    return (
        F.when(F.coalesce(F.length(place), F.lit(0)) == 0, fixed(0.0, "不明"))
        .when(is_invalid_name(place), fixed(0.9, "無効"))
        .when(place.isin(V.PERSON_NAMES + V.ACADEMIC_A), fixed(0.85, "人名・学術用語"))
        .otherwise(scored)
    )


def context_b(place: Column, sentence: Column, before: Column, after: Column) -> Column:
    """Struct is_place, confidence, place_type, reasoning of engine B."""
    text = F.concat(F.coalesce(before, F.lit("")), F.lit(" "), F.coalesce(sentence, F.lit("")), F.lit(" "), F.coalesce(after, F.lit("")))
    found = F.struct(hits(text, V.PLACE_CONTEXT).alias("place"), hits(text, V.PERSON_CONTEXT).alias("person"), hits(text, V.HISTORY_CONTEXT).alias("past"))
    sure = place.isin([k for k, v in V.AMBIGUOUS_PERSON.items() if v > 0.5])
    cities = [r[0] for r in V.rows(V.CITIES)]
    fixed = lambda confidence, label, text: F.struct(F.lit(False).alias("is_place"), F.lit(confidence).alias("confidence"), F.lit(label).alias("place_type"), F.concat(F.lit(text), place).alias("reasoning"))

    def judge(h: Column) -> Column:
        total = h.place + h.past
        kind = F.when(h.past > 0, "歴史地名").when(place.isin(cities), "都市部").when(place.rlike("[都府県]$"), "都道府県").otherwise("一般地名")
        scored = F.struct(
            (total > h.person).alias("is_place"),
            F.when(total > 0, F.round(F.least(F.lit(0.95), 0.5 + total * 0.15), 4)).otherwise(0.5).alias("confidence"),
            kind.alias("place_type"),
            F.format_string("地名指標%d件 vs 人名指標%d件", total, h.person).alias("reasoning"),
        )
        return F.when(sure & (h.person > h.place), fixed(0.8, "人名", "人名指標: ")).otherwise(scored)

    return (
        F.when(place.isin(V.PERSON_NAMES), fixed(0.95, "人名", "人名: "))
        .when(place.isin(V.ACADEMIC_B), fixed(0.90, "学術用語", "学術用語: "))
        .when(place.isin(V.COMMON_NOUNS), fixed(0.85, "一般名詞", "一般名詞: "))
        .otherwise(_let(found, judge))
    )


def verdict(n: Column, n_place: Column, mean_confidence: Column) -> Column:
    """Struct is_valid, confidence, action of votes over one place."""
    ratio = n_place / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.struct(F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence"), F.lit("不明").alias("action"))).otherwise(
        F.struct(
            (ratio >= 0.5).alias("is_valid"),
            F.round(mean_confidence * F.when(ratio == 0, 1.0).when(ratio < 0.3, 0.8).when(ratio < 0.7, 0.9).otherwise(1.0), 9).alias("confidence"),
            F.when(ratio == 0, "削除推奨").when(ratio < 0.3, "削除検討").when(ratio < 0.7, "要再検討").otherwise("保持推奨").alias("action"),
        )
    )


def nlp_confidence(n_tokens: Column, mean_entity: Column) -> Column:
    """0.3 for up to 100 tokens, 0.7 for the entities; 0 if either is missing."""
    return F.when((n_tokens > 0) & mean_entity.isNotNull(), 0.3 * F.least(n_tokens / 100, F.lit(1.0)) + 0.7 * mean_entity).otherwise(0.0)


def blended_confidence(mean_extraction: Column, context: Column) -> Column:
    return F.when(mean_extraction.isNotNull(), 0.7 * mean_extraction + 0.3 * F.coalesce(context, F.lit(0.0))).otherwise(0.0)


_UNUSUAL = r"[^\w\s぀-ヿ　-鿿。、！？「」『』（）]"


def sentence_quality(c: Column) -> Column:
    """Score of a sentence: length and unusual characters."""
    return F.round(F.when(F.length(c) < 10, 0.8).otherwise(1.0) * F.when(F.length(c) > 1000, 0.9).otherwise(1.0) * F.when(c.rlike("(?U)" + _UNUSUAL), 0.7).otherwise(1.0), 4)


def sentence_issues(c: Column) -> Column:
    """What keeps a sentence from the full score; none for a valid one."""
    return F.array_compact(F.array(F.when(F.length(c) < 10, "too_short"), F.when(F.length(c) > 1000, "too_long"), F.when(c.rlike("(?U)" + _UNUSUAL), "unusual_characters")))


def place_quality(name: Column, confidence: Column) -> Column:
    shape = reduce(lambda a, b: a | b, (name.rlike(p) for _, p in V.PLACE_SHAPES))
    return F.round(F.when(F.length(name) < 2, 0.8).otherwise(1.0) * F.when(F.length(name) > 50, 0.9).otherwise(1.0) * F.when(confidence < 0.6, 0.7).otherwise(1.0) * F.when(shape, 1.0).otherwise(0.6), 4)


def place_shapes(name: Column) -> Column:
    """The shapes a name has."""
    return F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(n)) for n, p in V.PLACE_SHAPES)))


def mention_quality(name: Column, context: Column) -> Column:
    context = F.coalesce(context, F.lit(""))
    return F.round(F.when(F.length(context) == 0, 0.8).otherwise(1.0) * F.when(context.contains(name), 1.0).otherwise(0.5) * F.when(F.length(context) < 10, 0.9).otherwise(1.0), 4)


def overall_quality(sentence: Column, place: Column, mention: Column) -> Column:
    return F.round(0.3 * sentence + 0.4 * place + 0.3 * mention, 2)


def coordinate(c: Column | str) -> Column:
    """A latitude or longitude; NaN stands for none, as null does."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def api_confidence(context: Column) -> Column:
    """Confidence of a map service's answer: 0.8, and 0.1 more (at most 0.9) where the context is sure."""
    return F.when(context > 0.8, F.least(F.lit(0.9), F.lit(0.8) + 0.1)).otherwise(0.8)


def entity_confidence(name: Column, is_location: Column) -> Column:
    """Confidence of a tagged entity by its length and label."""
    return F.least(F.lit(1.0), 0.7 + F.when(F.length(name) >= 4, 0.1).otherwise(0.0) + F.when(is_location, 0.1).otherwise(0.0))


def in_japan(lat: Column, lon: Column, engine: str = "A") -> Column:
    top, left = (46.0, 123.0) if engine == "A" else (45.5, 122.0)
    return F.coalesce(lat.between(24.0, top) & lon.between(left, 146.0), F.lit(False))
