"""Text rules as column expressions. Null in, null out; nothing here leaves the JVM but NFKC."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumiyori.functions import vocabulary as V

#: White space of any script, as a regular expression class.
WS = r"[\s　\x{00a0}]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC normalisation, which has no built-in function (Arrow batches)."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def any_of(words: list[str]) -> str:
    return "|".join(words)


def strip(c: Column) -> Column:
    """Without outer white space of any script (``trim`` keeps the wide blank)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


# Markup: the patterns in their order, with what they become and how they are counted.
MARKUP_STEPS: list[tuple[str, str, str]] = [
    (r"<ruby><rb>([^<]+)</rb><rp>[（(]</rp><rt>([^<]*)</rt><rp>[）)]</rp></ruby>", "$1（$2）", "ruby"),
    (r"<ruby>([^<]+)<rt>([^<]*)</rt></ruby>", "$1（$2）", "ruby"),
    (r"<br\s*/?\s*>", "", "tag"),
    (r"<[^>]+>", "", "tag"),
    (r"《[^》]*》", "", "annotation"),
    (r"［[^］]*］", "", "annotation"),
    (r"〔[^〕]*〕", "", "annotation"),
    (r"底本：[^\n]*\n?", "", "other"),
    (r"入力：[^\n]*\n?", "", "other"),
    (r"校正：[^\n]*\n?", "", "other"),
    (r"※[^\n]*\n?", "", "other"),
    (r"初出：[^\n]*\n?", "", "other"),
    (r"\n\s*\n\s*\n+", "\n\n", "other"),
    (r"[ \t]+", " ", "other"),
    (r"　+", "　", "other"),
]


def clean_markup(c: Column) -> Column:
    """Text without readings, tags, annotations, colophon lines and surplus blanks."""
    for pattern, to, _ in MARKUP_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return final_normalization(c)


def final_normalization(c: Column) -> Column:
    """Blanks and line breaks collapsed, every line and the text stripped."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"(?md)^[ \t　]+|[ \t　]+$", ""))


def markup_counts(c: Column) -> Column:
    """Struct of removed pieces by class, each counted before its replacement."""
    counts: dict[str, Column] = {}
    for pattern, to, kind in MARKUP_STEPS:
        if kind != "other":
            n = F.regexp_count(c, F.lit(pattern))
            counts[kind] = counts[kind] + n if kind in counts else n
        c = F.regexp_replace(c, pattern, to)
    return F.struct(*(n.alias(f"{kind}_count") for kind, n in counts.items()))


def split_sentences(c: Column, terminators: str = "。．！？!?", min_len: int = 6, max_len: int | None = 500, keep: bool = True) -> Column:
    """Array of sentences cut after (or at) each terminator, stripped, within the lengths (``max_len`` None: of any length)."""
    flat = F.regexp_replace(c, r"\n", " ")
    parts = F.split(flat, f"(?<=[{terminators}])" if keep else f"[{terminators}]")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= min_len if max_len is None else F.length(s).between(min_len, max_len))


def clean_text(c: Column, compat: bool = False) -> Column:
    """NFKC text without annotations and tags. ``compat`` normalises first and drops line breaks, as the old order did."""
    def marks(x: Column) -> Column:
        for pattern in (r"《[^》]*》", r"［[^］]*］", r"〔[^〕]*〕", r"※[^※]*※", r"<[^>]+>"):
            x = F.regexp_replace(x, pattern, "")
        return x

    def lines(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t　]+", " "), r"\n\s*\n", "\n")

    if compat:
        return strip(F.regexp_replace(lines(marks(nfkc(c))), r"[\x00-\x1f\x7f-\x9f]", ""))
    return strip(F.regexp_replace(lines(nfkc(marks(c))), r"[\x00-\x09\x0b-\x1f\x7f-\x9f]", ""))


def normalize_title(c: Column) -> Column:
    """NFKC title of letters, digits, kana, kanji and Japanese marks, blanks collapsed."""
    x = F.regexp_replace(nfkc(c), r"[\x00-\x1f\x7f-\x9f]", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s぀-ゟ゠-ヿ一-龯々〆〤、。・！？「」『』（）【】〔〕《》]", "")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_author_name(c: Column) -> Column:
    return strip(F.translate(nfkc(c), "　", " "))


def is_person_page(href: Column) -> Column:
    """Whether an address is the page of a person, whatever place in the page it names."""
    return F.substring_index(href, "#", 1).rlike(r"^person\d+\.html\z")


def preprocess(c: Column) -> Column:
    """Runs of white space as one blank, stripped."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


#: Runs of one script: what a tagger without a dictionary takes for words.
WORD_RUNS = r"[一-鿿々]+|[ぁ-ゟ]+|[゠-ヿ]+|\p{L}+|\p{Nd}+|[^\s\p{L}\p{Nd}]"


def tokens(c: Column, separated: bool = False) -> Column:
    """Words of a text: its parts between blanks if it is ``separated`` already, else runs of one script."""
    clean = preprocess(c)
    found = F.split(clean, " ") if separated else F.regexp_extract_all(clean, F.lit(WORD_RUNS), 0)
    return F.filter(found, lambda t: F.length(t) > 0)


def extract_metadata(c: Column) -> Column:
    """Struct of title, author and colophon entries; null where absent."""
    def first(*patterns: str) -> Column:
        return F.coalesce(*(F.nullif(strip(F.regexp_extract(c, p + r"[ \t　]*([^\n]*)", 1)), F.lit("")) for p in patterns))

    return F.struct(
        first("【タイトル】", "作品名：", "題名：").alias("title"), first("【作者】", "著者：", "作者：").alias("author"), first("底本：").alias("source"),
        first("入力：").alias("input"), first("校正：").alias("proof"), first("初出：").alias("debut"),
    )


def text_quality(c: Column) -> Column:
    """Struct score, is_valid, issues of a text."""
    n = F.length(c)
    empty = c.isNull() | (n == 0)
    checks = [
        (n < 100, 0.3, "too_short", True), ((n >= 100) & (n < 500), 0.1, "short", False), (c.rlike("<[^>]+>"), 0.1, "tags", False),
        (c.rlike("[《》［］〔〕]"), 0.1, "annotations", False), (c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]"), 0.5, "damaged", True), (c.rlike(r"\n{5,}"), 0.05, "blank_lines", False),
    ]
    score = F.lit(1.0)
    for hit, cost, _, _ in checks:
        score = score - F.when(hit, cost).otherwise(0.0)
    errors = F.lit(False)
    for hit, _, _, is_error in checks:
        if is_error:
            errors = errors | hit
    return F.struct(
        F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)).alias("score"),
        F.when(empty, False).otherwise(~errors).alias("is_valid"),
        F.array_compact(F.array(*(F.when(hit, F.lit(name)) for hit, _, name, _ in checks))).alias("issues"),
    )


def normalize_place_name(c: Column) -> Column:
    """Key of a place name: digits narrow, old spellings, without 県府市区町村, final particle and doubled 山川島."""
    x = F.translate(strip(c), "１２３４５６７８９０", "1234567890")
    for old, new in (("東亰", "東京"), ("大坂", "大阪"), ("横濱", "横浜")):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.translate(x, "県府市区町村", "")
    return F.regexp_replace(F.regexp_replace(x, "[のにへでを]$", ""), r"([山川島])\1+", "$1")


def add_punctuation(c: Column) -> Column:
    """A final mark where none stands; questions and exclamations by their words anywhere."""
    return (
        F.when((F.length(c) == 0) | c.rlike(r"[。！？」』〉》]\z"), c)
        .when(c.rlike("[？か]"), F.concat(c, F.lit("？")))
        .when(c.rlike("[！よ]|だ！|である！"), F.concat(c, F.lit("！")))
        .otherwise(F.concat(c, F.lit("。")))
    )


def restore_punctuation(c: Column) -> Column:
    """A final mark by the ending of the sentence (variant of regeneration)."""
    return (
        F.when((F.length(c) == 0) | c.rlike(r"[。！？」』]\z"), c)
        .when(c.rlike(r"？|か\z"), F.concat(c, F.lit("？")))
        .when(c.rlike(r"！|(だ|である|た|ない)\z"), F.concat(c, F.lit("！")))
        .otherwise(F.concat(c, F.lit("。")))
    )


def detect_genre(c: Column, ladder: list[tuple[str, str]] = V.GENRES_B) -> Column:
    """The first genre of the ladder with a keyword in the title, else 小説."""
    found = F.lit(None).cast("string")
    for genre, words in reversed(ladder):
        found = F.when(c.rlike(any_of(words.split())), genre).otherwise(found)
    return F.when(c.isNotNull(), F.coalesce(found, F.lit("小説")))


def _first_year(c: Column, pattern: str, base: int = 0) -> Column:
    years = F.transform(F.regexp_extract_all(c, F.lit("(?U)" + pattern), 1), lambda y: y.try_cast("int"))
    kept = F.filter(years, lambda y: (y + base).between(1800, 2100) & (y > 0))
    return F.when(_may_match(c, pattern), F.get(kept, 0) + base)


def _may_match(c: Column, pattern: str) -> Column:
    """Whether a text has the characters without which a pattern cannot match, by plain searches that cost little."""
    literals = re.sub(r"\[[^\]]*\]|\\.|\([^()]*\)|\.\*\?|[+*?{}^$|.\d]", "\0", pattern)
    return reduce(lambda a, b: a & b, (c.contains(word) for word in dict.fromkeys(filter(None, literals.split("\0")))), F.lit(True))


def extract_year(c: Column) -> Column:
    """Year of publication: western patterns, eras, contexts; the first match in this order. Wide digits count."""
    c = F.translate(c, "０１２３４５６７８９", "0123456789")
    # A year needs four digits, or digits after the name of an era.
    c = F.when(c.rlike(r"(?U)\d{4}|(?:明治|大正|昭和)\d"), c)
    return F.coalesce(*(_first_year(c, p) for p in V.YEAR_PATTERNS), *(_first_year(c, p, b) for p, b in V.ERA_PATTERNS), *(_first_year(c, p) for p in V.YEAR_CONTEXTS))


def life_years(summary: Column, content: Column) -> Column:
    """Struct birth_year, death_year from the first 1000 characters of each text."""
    text = F.concat(F.substring(F.coalesce(summary, F.lit("")), 1, 1000), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 1000))
    at = lambda p, g: F.regexp_extract(text, "(?U)" + p, g).try_cast("int")
    spans = [F.struct(at(p, 1).alias("birth_year"), at(p, 2).alias("death_year")) for p in V.LIFE_SPANS]
    valid = lambda s: s.birth_year.between(1800, 1950) & s.death_year.between(1850, 2000) & (s.birth_year < s.death_year)
    one = lambda patterns: F.coalesce(*(F.when(at(p, 1).between(1800, 2100), at(p, 1)) for p in patterns))
    return F.coalesce(*(F.when(valid(s), s) for s in spans), F.struct(one(V.BIRTHS).alias("birth_year"), one(V.DEATHS).alias("death_year")))


def is_literary(c: Column) -> Column:
    return F.coalesce(c.rlike(any_of(V.LITERARY)), F.lit(False))


def best_literary_option(options: Column) -> Column:
    """The option without an avoided word that has the earliest preferred word, else the first such option."""
    kept = F.filter(options, lambda o: ~o.rlike(any_of(V.AVOIDED)))
    ranked = F.transform(kept, lambda o, i: F.struct(F.coalesce(*(F.when(o.contains(w), F.lit(n)) for n, w in enumerate(V.PREFERRED)), F.lit(len(V.PREFERRED))).alias("rank"), i.alias("at"), o.alias("option")))
    return F.array_min(ranked).option


def offset_of(text: Column, name: Column) -> Column:
    """0-based place of a name in a text, -1 if absent."""
    return F.instr(text, name) - 1


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed table."""
    mapped = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]
    return mapped if default is None else F.coalesce(mapped, F.lit(default))


def prefecture_of(location: Column) -> Column:
    """The prefix through the first 都, else 府, else 県."""
    found = F.lit(None).cast("string")
    for sign in "県府都":
        found = F.when(location.contains(sign), F.concat(F.substring_index(location, sign, 1), F.lit(sign))).otherwise(found)
    return found


def cache_key(api: Column, text: Column) -> Column:
    return F.md5(F.concat(api, F.lit(":"), text))


def parse_reply(c: Column) -> Column:
    """A model's JSON reply without fences; null unless it has ``is_place_name``."""
    body = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    reply = F.from_json(body, "is_place_name boolean, confidence double, place_type string, reasoning string")
    return F.when(F.get_json_object(body, "$.is_place_name").isNotNull(), reply)


def sample(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def text_statistics(c: Column) -> Column:
    """Struct of character, sentence and paragraph counts and sentence lengths; null for empty text."""
    sentences = F.filter(F.transform(F.split(F.regexp_replace(c, r"\n", " "), "(?<=[。．！？!?])"), strip), lambda s: F.length(s) > 0)
    lengths = F.transform(sentences, F.length)
    paragraphs = F.filter(F.split(c, r"\n\n"), lambda p: F.length(strip(p)) > 0)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    n = F.size(sentences)
    return F.when(
        F.length(c) > 0,
        F.struct(
            F.length(c).alias("n_chars"), F.length(F.regexp_replace(c, rf"{WS}+", "")).alias("n_visible"), n.alias("n_sentences"), F.size(paragraphs).alias("n_paragraphs"),
            F.when(n > 0, F.round(total / n, 2)).otherwise(0.0).alias("avg_length"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("max_length"), F.coalesce(F.array_min(lengths), F.lit(0)).alias("min_length"),
        ),
    )
