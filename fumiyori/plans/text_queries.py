"""Queries of the text rules over sentences, titles and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyori.functions import text as X
from fumiyori.functions import vocabulary as V
from fumiyori.functions.scoring import sentence_quality
from fumiyori.operators.sizing import spread
from fumiyori.session import read_table

_WS = r"[\s　\x{00a0}]"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_split(text: str, terminators: str, low: int, high: int | None, keep: bool = True) -> str:
    flat = f"replace({text}, chr(10), ' ')"
    parts = f"regexp_extract_all({flat}, '[^{terminators}]*[{terminators}]|[^{terminators}]+$')" if keep else f"regexp_split_to_array({flat}, '[{terminators}]')"
    return f"list_filter(list_transform({parts}, lambda x: {_strip('x')}), lambda x: length(x) >= {low}{'' if high is None else f' AND length(x) <= {high}'})"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "sentences").select("sentence_id", F.col("sentence_text").alias("t"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")))


def sentence_split(spark, sf_dir):
    """Documents cut into sentences of 6 to 500 characters, marks kept."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(X.split_sentences(F.col("t")))).select("doc_id", (F.col("pos") + 1).alias("sentence_order"), F.col("col").alias("sentence_text"), F.length("col").alias("char_count"))


def sentence_split_short(spark, sf_dir):
    """The same with the marks 。．！？ and pieces from 3 characters."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(X.split_sentences(F.col("t"), "。．！？", 3, None))).select("doc_id", (F.col("pos") + 1).alias("sentence_order"), F.col("col").alias("sentence_text"))


def sentence_split_drop(spark, sf_dir):
    """Sentences without their marks."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(X.split_sentences(F.col("t"), "。．！？", 1, None, False))).select("doc_id", (F.col("pos") + 1).alias("sentence_order"), F.col("col").alias("sentence_text"))


def text_statistics(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.text_statistics(F.col("t")).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")


def clean_markup(spark, sf_dir):
    return _documents(spark, sf_dir).where("t IS NOT NULL").select("doc_id", X.clean_markup(F.col("t")).alias("clean"))


def markup_counts(spark, sf_dir):
    return _documents(spark, sf_dir).where("t IS NOT NULL").select("doc_id", X.markup_counts(F.col("t")).alias("c")).select("doc_id", "c.*")


def clean_text_nfkc(spark, sf_dir):
    """NFKC text without annotations (no SQL: DuckDB has no NFKC with these orders)."""
    return _documents(spark, sf_dir).where("t IS NOT NULL").select("doc_id", X.clean_text(F.col("t")).alias("clean"), X.clean_text(F.col("t"), compat=True).alias("clean_compat"))


def text_quality(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.text_quality(F.col("t")).alias("q")).select("doc_id", "q.score", "q.is_valid", F.concat_ws(",", "q.issues").alias("issues"))


def document_metadata(spark, sf_dir):
    return _documents(spark, sf_dir).where("t IS NOT NULL").select("doc_id", X.extract_metadata(F.col("t")).alias("m")).select("doc_id", "m.*")


def add_punctuation(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sentence_id", X.add_punctuation(F.col("t")).alias("by_words"), X.restore_punctuation(F.col("t")).alias("by_ending"))


def detect_genre(spark, sf_dir):
    return read_table(spark, sf_dir, "works").select("work_id", X.detect_genre(F.col("title"), V.GENRES_A).alias("genre_a"), X.detect_genre(F.col("title"), V.GENRES_B).alias("genre_b"))


def extract_year(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.extract_year(F.col("t")).alias("year")).where("year IS NOT NULL")


def normalize_place_names(spark, sf_dir):
    return read_table(spark, sf_dir, "place_masters").select("master_id", X.normalize_place_name(F.col("display_name")).alias("place_key"))


def normalized_titles(spark, sf_dir):
    return read_table(spark, sf_dir, "works").select("work_id", X.normalize_title(F.col("title")).alias("title_key"), X.normalize_author_name(F.col("title")).alias("name_key"))


def preprocess_text(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sentence_id", X.preprocess(F.col("t")).alias("clean"))


def literary_filter(spark, sf_dir):
    return _documents(spark, sf_dir).where(X.is_literary(F.col("t"))).select("doc_id")


def mention_offset(spark, sf_dir):
    m = read_table(spark, sf_dir, "sentence_places").select("relation_id", "sentence_id", "matched_text")
    return m.join(_sentences(spark, sf_dir), "sentence_id").select("relation_id", X.offset_of(F.col("t"), F.col("matched_text")).alias("start_found"))


def prefecture_prefix(spark, sf_dir):
    return read_table(spark, sf_dir, "place_masters").select("master_id", X.prefecture_of(F.col("prefecture")).alias("area"))


def cache_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "place_masters").select("master_id", X.cache_key(F.lit("maps"), F.col("display_name")).alias("cache_key"))


def text_samples(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sentence_id", X.sample(F.col("t")).alias("sample"))


def sentence_scores(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sentence_id", sentence_quality(F.col("t")).alias("score"))


def author_readings(spark, sf_dir):
    return read_table(spark, sf_dir, "authors").select("author_id", F.coalesce("author_name_kana", X.lookup(F.col("author_name"), V.READINGS)).alias("reading"))


def category_map(spark, sf_dir):
    return read_table(spark, sf_dir, "place_masters").select("master_id", X.lookup(F.col("place_type"), V.CATEGORIES, "有名地名").alias("category"))


def prompts(spark, sf_dir):
    m = read_table(spark, sf_dir, "place_masters")
    return m.select("master_id", X.prompt("地名「%s」を地図で探す（%s）", F.col("display_name"), F.coalesce("prefecture", F.lit("不明"))).alias("prompt"))


QUERIES = {f.__name__: f for f in (
    sentence_split, sentence_split_short, sentence_split_drop, text_statistics, clean_markup, markup_counts, clean_text_nfkc, text_quality, document_metadata, add_punctuation, detect_genre, extract_year,
    normalize_place_names, normalized_titles, preprocess_text, literary_filter, mention_offset, prefecture_prefix, cache_keys, text_samples, sentence_scores, author_readings, category_map, prompts,
)}


def _sql_markup(text: str) -> str:
    for pattern, to, _ in X.MARKUP_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    x = f"regexp_replace(regexp_replace({text}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(f"regexp_replace({x}, '(?m)^[ \\t　]+|[ \\t　]+$', '', 'g')")


def _sql_counts() -> str:
    text, terms = "text", {}
    for pattern, to, kind in X.MARKUP_STEPS:
        if kind != "other":
            terms.setdefault(kind, []).append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return ", ".join(f"({' + '.join(t)})::INT AS {k}_count" for k, t in terms.items())


def _sql_genre(ladder) -> str:
    return "CASE WHEN title IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(title, '{'|'.join(words.split())}') THEN '{genre}'" for genre, words in ladder) + " ELSE '小説' END"


def _sql_year() -> str:
    def one(pattern: str, base: int = 0) -> str:
        return f"list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda y: TRY_CAST(y AS INT)), lambda y: y + {base} BETWEEN 1800 AND 2100 AND y > 0)[1] + {base}"

    return "coalesce(" + ", ".join([*(one(p) for p in V.YEAR_PATTERNS), *(one(p, b) for p, b in V.ERA_PATTERNS), *(one(p) for p in V.YEAR_CONTEXTS)]) + ")"


def _sql_first(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_strip(f'''regexp_extract(text, '{p}[ \\t　]*([^\\n]*)', 1)''')}, '')" for p in patterns) + ")"


# Letters, marks, digits, connectors, blanks and the ranges of the rule, spelled out for an engine without Unicode words.
_USUAL = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}぀-ヿ　-鿿。、！？「」『』（）"


def sentence_score_sql(text: str) -> str:
    """The score of a sentence in SQL."""
    return f"round(CASE WHEN length({text}) < 10 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN length({text}) > 1000 THEN 0.9 ELSE 1.0 END * CASE WHEN regexp_matches({text}, '[^{_USUAL}]') THEN 0.7 ELSE 1.0 END, 4)"


_SENT = "CASE WHEN text IS NULL OR text = '' THEN NULL ELSE list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '), '[^。．！？!?]*[。．！？!?]|[^。．！？!?]+$'), lambda x: " + _strip("x") + "), lambda x: length(x) > 0) END"


def _exploded(list_sql: str) -> str:
    return f"SELECT doc_id, generate_subscripts(s, 1)::INT AS sentence_order, unnest(s) AS sentence_text FROM (SELECT doc_id, {list_sql} AS s FROM documents WHERE text IS NOT NULL)"


ORACLES = {
    "sentence_split": f"SELECT *, length(sentence_text)::INT AS char_count FROM ({_exploded(_sql_split('text', '。．！？!?', 6, 500))})",
    "sentence_split_short": _exploded(_sql_split("text", "。．！？", 3, None)),
    "sentence_split_drop": _exploded(_sql_split("text", "。．！？", 1, None, False)),
    "text_statistics": f"""
        SELECT doc_id, length(text)::INT AS n_chars, length(regexp_replace(text, '{_WS}+', '', 'g'))::INT AS n_visible, len(s)::INT AS n_sentences,
               len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {_strip('p')} <> ''))::INT AS n_paragraphs,
               CASE WHEN len(s) > 0 THEN round(list_sum(list_transform(s, lambda x: length(x)))::DOUBLE / len(s), 2) ELSE 0.0 END AS avg_length,
               coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS max_length, coalesce(list_min(list_transform(s, lambda x: length(x))), 0)::INT AS min_length
        FROM (SELECT doc_id, text, {_SENT} AS s FROM documents WHERE text <> '')""",
    "clean_markup": f"SELECT doc_id, {_sql_markup('text')} AS clean FROM documents WHERE text IS NOT NULL",
    "markup_counts": f"SELECT doc_id, {_sql_counts()} FROM documents WHERE text IS NOT NULL",
    "text_quality": r"""
        SELECT doc_id, CASE WHEN e THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0::DOUBLE - 0.3 * a - 0.1 * b - 0.1 * c - 0.1 * d - 0.5 * f - 0.05 * g)), 2) END AS score,
               NOT e AND a = 0 AND f = 0 AS is_valid,
               coalesce(array_to_string(list_filter([CASE WHEN a = 1 THEN 'too_short' END, CASE WHEN b = 1 THEN 'short' END, CASE WHEN c = 1 THEN 'tags' END, CASE WHEN d = 1 THEN 'annotations' END, CASE WHEN f = 1 THEN 'damaged' END, CASE WHEN g = 1 THEN 'blank_lines' END], lambda x: x IS NOT NULL), ','), '') AS issues
        FROM (SELECT doc_id, text IS NULL OR text = '' AS e, coalesce(length(text) < 100, false)::INT AS a, coalesce(length(text) BETWEEN 100 AND 499, false)::INT AS b,
                     coalesce(regexp_matches(text, '<[^>]+>'), false)::INT AS c, coalesce(regexp_matches(text, '[《》［］〔〕]'), false)::INT AS d,
                     coalesce(regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]'), false)::INT AS f, coalesce(regexp_matches(text, '\n{5,}'), false)::INT AS g FROM documents)""",
    "document_metadata": f"SELECT doc_id, {_sql_first('【タイトル】', '作品名：', '題名：')} AS title, {_sql_first('【作者】', '著者：', '作者：')} AS author, {_sql_first('底本：')} AS source, {_sql_first('入力：')} AS input, {_sql_first('校正：')} AS proof, {_sql_first('初出：')} AS debut FROM documents WHERE text IS NOT NULL",
    "add_punctuation": """
        SELECT sentence_id,
               CASE WHEN t = '' OR regexp_matches(t, '[。！？」』〉》]$') THEN t WHEN regexp_matches(t, '[？か]') THEN t || '？' WHEN regexp_matches(t, '[！よ]|だ！|である！') THEN t || '！' ELSE t || '。' END AS by_words,
               CASE WHEN t = '' OR regexp_matches(t, '[。！？」』]$') THEN t WHEN regexp_matches(t, '？|か$') THEN t || '？' WHEN regexp_matches(t, '！|(だ|である|た|ない)$') THEN t || '！' ELSE t || '。' END AS by_ending
        FROM (SELECT sentence_id, sentence_text AS t FROM sentences)""",
    "detect_genre": f"SELECT work_id, {_sql_genre(V.GENRES_A)} AS genre_a, {_sql_genre(V.GENRES_B)} AS genre_b FROM works",
    "extract_year": f"SELECT * FROM (SELECT doc_id, {_sql_year()} AS year FROM (SELECT doc_id, translate(text, '０１２３４５６７８９', '0123456789') AS text FROM documents)) WHERE year IS NOT NULL",
    "normalize_place_names": f"""
        SELECT master_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(translate({_strip('display_name')}, '１２３４５６７８９０', '1234567890'), '東亰', '東京'), '大坂', '大阪'), '横濱', '横浜'), '県府市区町村', ''), '[のにへでを]$', ''), '山山+', '山', 'g'), '川川+', '川', 'g'), '島島+', '島', 'g'), '^$', '') AS place_key FROM place_masters""",
    "preprocess_text": f"SELECT sentence_id, trim(regexp_replace(sentence_text, '{_WS}+', ' ', 'g'), ' ') AS clean FROM sentences",
    "literary_filter": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{'|'.join(V.LITERARY)}')",
    "mention_offset": "SELECT relation_id, (instr(sentence_text, matched_text) - 1)::INT AS start_found FROM sentence_places JOIN sentences USING (sentence_id)",
    "prefecture_prefix": "SELECT master_id, CASE WHEN contains(prefecture, '都') THEN split_part(prefecture, '都', 1) || '都' WHEN contains(prefecture, '府') THEN split_part(prefecture, '府', 1) || '府' WHEN contains(prefecture, '県') THEN split_part(prefecture, '県', 1) || '県' END AS area FROM place_masters",
    "cache_keys": "SELECT master_id, md5('maps:' || display_name) AS cache_key FROM place_masters",
    "text_samples": "SELECT sentence_id, CASE WHEN length(sentence_text) > 50 THEN substring(sentence_text, 1, 50) || '...' ELSE sentence_text END AS sample FROM sentences",
    "sentence_scores": f"SELECT sentence_id, {sentence_score_sql('sentence_text')} AS score FROM sentences",
    "author_readings": "SELECT author_id, coalesce(author_name_kana, CASE author_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.READINGS.items()) + " END) AS reading FROM authors",
    "category_map": "SELECT master_id, coalesce(CASE place_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CATEGORIES.items()) + " END, '有名地名') AS category FROM place_masters",
    "prompts": "SELECT master_id, '地名「' || display_name || '」を地図で探す（' || coalesce(prefecture, '不明') || '）' AS prompt FROM place_masters",
}
