"""One consistent form for text that looks the same (problem 3).

Every token's *resolved script set* is the intersection, over its letters, of the scripts
that have a letter of that look. A token with an empty set mixes scripts beyond repair by
any single one and takes the script that spells most of it; a token whose set has several
members is a whole-script confusable and takes the first of :data:`PREFERENCE`. The token
is then spelled in that script. Letters of the Japanese mixture (kanji, kana) resolve by
their unambiguous neighbours instead, because these scripts mix within words. What remains
(width, composition, invisible characters, blanks) is normalised.

Defined results: null stays null; empty or blank text becomes empty; case, accents, old
character forms and inner blanks are kept, since they are visible. Results are idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that print like a Latin letter.
CYRILLIC = dict(zip("АВЕКМНОРСТХЅІЈУЗаеорсхуѕіјһԁԛԝӏѵ", "ABEKMHOPCTXSIJY3aeopcxysijhdqwlv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυϲϳ", "ABEZHIKMNOPTYXoavipucj", strict=True))
ARMENIAN = dict(zip("ՕՍոօսհզց", "OUnouhqg", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
COPTIC = dict(zip("ⲞⲢⲤⲎⲔⲘⲚⲦⲬⲨⲟⲣⲥ", "OPCHKMNTXYopc", strict=True))
# Katakana that print like a kanji.
KANA_KANJI = dict(zip("ロニハカタトエー", "口二八力夕卜工一", strict=True))
HYPHENS = dict.fromkeys(map(ord, "‐‑‒–−﹣－"), "-")
PREFERENCE = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic")

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")

_TO_LATIN = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC}
_FROM_LATIN = {script: {latin: own for own, latin in table.items()} for script, table in _TO_LATIN.items()}
_KANJI_KANA = {kanji: kana for kana, kanji in KANA_KANJI.items()}


@lru_cache(maxsize=4096)
def script_of(char: str) -> str:
    """The script of a letter, or "" for what all scripts share."""
    if not char.isalpha() and char != "ー":
        return ""
    name = unicodedata.name(char, "")
    for prefix, script in (("LATIN", "Latin"), ("CYRILLIC", "Cyrillic"), ("GREEK", "Greek"), ("CJK", "Han"), ("KATAKANA", "Katakana"), ("HIRAGANA", "Hiragana"), ("HANGUL", "Hangul")):
        if name.startswith(prefix):
            return script
    return name.split(" ")[0].title()


@lru_cache(maxsize=4096)
def scripts_of(char: str) -> frozenset[str]:
    """Scripts that have a letter printed like ``char``, its own included; accents do not matter."""
    own = script_of(char)
    if not own:
        return frozenset()
    base = unicodedata.normalize("NFD", char)[0]
    latin = base if own == "Latin" else _TO_LATIN.get(own, {}).get(base)
    found = {own}
    if latin is not None:
        found.add("Latin")
        found.update(script for script, table in _FROM_LATIN.items() if latin in table)
    return frozenset(found)


def _spell(token: str, script: str) -> str:
    """``token`` with every letter that has a twin in ``script`` written in it."""
    out = []
    for char in unicodedata.normalize("NFD", token):
        own = script_of(char)
        if own and own != script and own in ("Latin", *_TO_LATIN):
            latin = char if own == "Latin" else _TO_LATIN[own].get(char)
            if latin is not None:
                char = latin if script == "Latin" else _FROM_LATIN.get(script, {}).get(latin, char)
        out.append(char)
    return unicodedata.normalize("NFC", "".join(out))


def resolve_alphabets(token: str) -> str:
    """The consistent spelling of a token of alphabetic letters."""
    sets = [s for s in map(scripts_of, token) if s]
    if not sets:
        return token
    common = frozenset.intersection(*sets)
    if common:
        script = next((p for p in PREFERENCE if p in common), min(common))
    else:
        script = max(PREFERENCE, key=lambda p: (sum(p in s for s in sets), -PREFERENCE.index(p)))
    return _spell(token, script)


def resolve_japanese(token: str) -> str:
    """Katakana and kanji of one look, decided by the nearest letters that have no twin."""
    chars = list(token)
    twin = [c in KANA_KANJI or c in _KANJI_KANA for c in chars]
    for i, c in enumerate(chars):
        if twin[i]:
            sides = (next((chars[j] for j in order if not twin[j]), "") for order in (range(i - 1, -1, -1), range(i + 1, len(chars))))
            kana = any(script_of(s) == "Katakana" and s not in "ノヶケ" for s in sides if s)
            chars[i] = (c if c in KANA_KANJI else _KANJI_KANA[c]) if kana else KANA_KANJI.get(c, c)
    return "".join(chars)


def _token_form(match: re.Match) -> str:
    token = match.group()
    if token.isascii():
        return token
    scripts = {script_of(c) for c in token}
    if scripts & {"Han", "Katakana", "Hiragana"}:
        return resolve_japanese(token) if scripts <= {"Han", "Katakana", "Hiragana", ""} else "".join(
            resolve_japanese(p) if script_of(p[0]) in ("Han", "Katakana", "Hiragana") else resolve_alphabets(p) for p in re.findall(r"[々-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+|[^々-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+", token)
        )
    return resolve_alphabets(token)


def consistent(text: str | None) -> str | None:
    """The one form under which texts of the same look are equal."""
    if text is None:
        return None
    if text.isascii():
        return text.strip()
    x = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).translate(HYPHENS)
    x = unicodedata.normalize("NFC", INVISIBLE.sub("", x))
    return _TOKEN.sub(_token_form, x).strip()


@F.pandas_udf(T.StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return texts.map(lambda t: t if t is None else known[t] if t in known else known.setdefault(t, consistent(t)))


def consistent_form(column: Column | str) -> Column:
    """Column of consistent forms (Arrow batches)."""
    return _consistent_udf(F.col(column) if isinstance(column, str) else column)


def same_look_masters(masters: DataFrame) -> DataFrame:
    """Pairs ``left_id < right_id`` whose display or normalized names look the same and differ in characters."""
    names = masters.where(F.col("master_id").isNotNull()).select(
        "master_id", F.explode(F.array(F.struct(F.lit("d").alias("field"), F.col("display_name").alias("name")), F.struct(F.lit("n").alias("field"), F.col("normalized_name").alias("name")))).alias("f")
    ).select("master_id", "f.field", "f.name").where("name IS NOT NULL")
    forms = names.select("name").distinct().withColumn("form", consistent_form("name")).where("form <> ''")
    # Only looks with several spellings go on; a spelling shared by many rows stays one row until here.
    shared = forms.withColumn("spellings", F.count(F.lit(1)).over(Window.partitionBy("form"))).where("spellings > 1").drop("spellings")
    rows = names.join(shared, "name").distinct()
    a = rows.select("field", "form", F.col("name").alias("name_a"), F.col("master_id").alias("left_id"))
    b = rows.select("field", "form", F.col("name").alias("name_b"), F.col("master_id").alias("right_id"))
    return a.join(b, ["field", "form"]).where("left_id < right_id AND name_a <> name_b").select("left_id", "right_id").distinct()


def same_look_mentions(mentions: DataFrame, masters: DataFrame) -> DataFrame:
    """``relation_id, master_id`` of mentions that look like their master's display name and differ in characters."""
    named = mentions.where("relation_id IS NOT NULL AND master_id IS NOT NULL AND matched_text IS NOT NULL")
    # One row per (master, text): a master with a third of all mentions shrinks to its spellings.
    texts = named.select("master_id", "matched_text").distinct()
    displays = masters.where("display_name IS NOT NULL").select("master_id", "display_name").distinct()
    differ = texts.join(displays, "master_id").where("matched_text <> display_name")
    alike = differ.where(consistent_form("matched_text") == consistent_form("display_name")).select("master_id", "matched_text").distinct()
    return named.join(alike, ["master_id", "matched_text"]).select("relation_id", "master_id").distinct()


def same_look(masters: DataFrame, mentions: DataFrame) -> DataFrame:
    """``source_table, left_id, right_id`` of both kinds of look-alikes."""
    return (
        same_look_masters(masters)
        .select(F.lit("place_masters").alias("source_table"), "left_id", "right_id")
        .unionByName(same_look_mentions(mentions, masters).select(F.lit("sentence_places").alias("source_table"), F.col("relation_id").alias("left_id"), F.col("master_id").alias("right_id")))
    )
