"""HTML pages and JSON exports as tables. Pages come in as rows (url, html); nothing is fetched here."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumiyori.functions import vocabulary as V
from fumiyori.functions.text import best_literary_option, clean_text, extract_year, is_literary, is_person_page, life_years, normalize_title, strip

_TAG = r"<[^>]+>"


def text_of(c: Column) -> Column:
    """Text of a piece of HTML."""
    return strip(F.regexp_replace(c, _TAG, ""))


def links(pages: DataFrame, contains: str, html: str = "html", url: str = "url") -> DataFrame:
    """``url, text, href`` of every link whose address contains a word."""
    return _placed_links(pages, html, url).where(F.col("href").contains(contains)).drop("pos")


def _placed_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``url, pos, text, href`` of every link in the order of the page."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\b[^>]*>.*?</a>)'), 1)).alias("pos", "a"))
    return found.select("url", "pos", text_of(F.col("a")).alias("text"), F.regexp_extract("a", r'(?i)href\s*=\s*["\']([^"\']+)["\']', 1).alias("href"))


def absolute(href: Column, base: Column) -> Column:
    """An address against the address of its page."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def author_index(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Authors of an index page: ``section, name, works_count, copyright_status, alias, author_url``."""
    lists = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<ol\b[^>]*>(.*?)</ol>"), 1)).alias("i", "ol"))
    names = F.array(*(F.lit(s) for s in V.INDEX_SECTIONS))
    items = lists.select("url", F.coalesce(F.get(names, F.col("i")), F.concat(F.lit("section_"), (F.col("i") + 1).cast("string"))).alias("section"), F.explode(F.regexp_extract_all("ol", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)).alias("li"))
    parsed = items.withColumn("text", text_of(F.col("li")))
    return parse_author_items(parsed).select("section", "name", "works_count", "copyright_status", "alias", "author_url")


def parse_author_items(items: DataFrame) -> DataFrame:
    """Items (``text``, and ``li``, ``url`` for links) that give a name and its number of works; others are dropped."""
    person = F.regexp_extract("li", r"person(\d+)\.html", 1) if "li" in items.columns else F.lit("")
    href = F.regexp_extract("li", r'(?i)href\s*=\s*["\']([^"\']+)["\']', 1) if "li" in items.columns else F.lit("")
    base = F.col("url") if "url" in items.columns else F.lit("")
    return items.where(F.col("text").rlike(r"^.+?\s*\(公開中：\d+\)")).select(
        *items.columns,
        strip(F.regexp_extract("text", r"^(.+?)\s*\(公開中：(\d+)\)", 1)).alias("name"),
        F.regexp_extract("text", r"^(.+?)\s*\(公開中：(\d+)\)", 2).cast("int").alias("works_count"),
        F.when(F.col("text").contains("＊著作権存続＊"), "active").otherwise("expired").alias("copyright_status"),
        F.nullif(F.regexp_extract("text", r"\(→(.+?)\)", 1), F.lit("")).alias("alias"),
        F.when(person != "", F.concat(F.regexp_extract(base, r"^(https?://[^/]+)", 1), F.lit("/index_pages/person"), person, F.lit(".html"))).when(href != "", absolute(href, base)).alias("author_url"),
    )


def works_under_heading(pages: DataFrame, heading: str = "公開中の作品", html: str = "html", url: str = "url") -> DataFrame:
    """``url, title, href`` of the links to cards in the list after a heading."""
    part = F.regexp_extract(F.col(html), rf"(?is)<h2[^>]*>\s*{heading}\s*</h2>.*?<ol\b[^>]*>(.*?)</ol>", 1)
    found = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(part, F.lit(r'(?is)(<a\b[^>]*>.*?</a>)'), 1)).alias("a"))
    return found.select("url", text_of(F.col("a")).alias("title"), F.regexp_extract("a", r'(?i)href\s*=\s*["\']([^"\']+)["\']', 1).alias("href")).where("href LIKE '/cards/%'")


def text_files(pages: DataFrame) -> DataFrame:
    """The first link to a text file of every page."""
    found = _placed_links(pages).where(F.col("href").rlike(r"\d+_\d+\.html$"))
    return found.groupBy("url").agg(F.min(F.struct("pos", "text", "href")).alias("l")).select("url", "l.text", absolute(F.col("l.href"), F.col("url")).alias("file_url"))


class _Main(HTMLParser):
    """Text of the first ``div.main_text``, of the body without page furniture, and of everything."""

    FURNITURE = frozenset({"script", "style", "header", "footer", "nav"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.main: list[str] | None = None
        self.body: list[str] = []
        self.all: list[str] = []
        self.depth = self.skipped = 0
        self.in_body = self.closed = False

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif self.main is None and "main_text" in (dict(attrs).get("class") or "").split():
                self.main, self.depth = [], 1
        elif tag == "body":
            self.in_body = True
        if tag in self.FURNITURE:
            self.skipped += 1

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "body":
            self.in_body = False
        if tag in self.FURNITURE and self.skipped:
            self.skipped -= 1

    def handle_data(self, data):
        self.all.append(data)
        if self.depth and self.main is not None:
            self.main.append(data)
        if self.in_body and not self.skipped:
            self.body.append(data)


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """Main text of pages; nested tags need a parser (Arrow batches)."""

    def one(page):
        if page is None:
            return None
        parser = _Main()
        parser.feed(page)
        return "".join(parser.main if parser.main is not None else parser.body if parser.body else parser.all).strip()

    return pages.map(one)


@F.pandas_udf(T.StringType())
def decode_legacy(raw: pd.Series) -> pd.Series:
    """Bytes of pages without a usable charset: Shift_JIS, else EUC-JP, else UTF-8 without what is broken."""

    def one(data):
        if data is None:
            return None
        for codec in ("shift_jis", "euc_jp"):
            try:
                return bytes(data).decode(codec)
            except UnicodeDecodeError:
                continue
        return bytes(data).decode("utf_8", "ignore")

    return raw.map(one)


def page_text(html: Column) -> Column:
    """Clean main text, null if empty."""
    return F.nullif(clean_text(main_text(html)), F.lit(""))


def table_cell(html: Column, summary: str, header: str) -> Column:
    """The first data cell of a table (by summary) whose header has one of the words."""
    table = F.regexp_extract(html, rf'(?is)<table[^>]*summary\s*=\s*["\']{summary}["\'][^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)(<tr\b.*?</tr>)"), 1)
    kept = F.filter(rows, lambda r: F.regexp_extract(r, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", 1).rlike(header))
    return F.nullif(text_of(F.regexp_extract(F.get(kept, 0), r"(?is)<t[hd]\b.*?</t[hd]>\s*<td\b[^>]*>(.*?)</td>", 1)), F.lit(""))


def card_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Ids from the address, year and persons from the tables of a work's card."""
    h = F.col(html)
    year_cell = table_cell(h, "作品データ", "初出|発表|発行|出版")
    return pages.select(
        F.col(url).alias("url"),
        F.nullif(F.regexp_extract(url, r"/cards/(\d+)/card(\d+)\.html", 1), F.lit("")).alias("source_work_id"),
        F.nullif(F.regexp_extract(url, r"/cards/(\d+)/card(\d+)\.html", 2), F.lit("")).alias("card_id"),
        F.coalesce(extract_year(year_cell), extract_year(F.substring(text_of(h), 1, 1000))).alias("publication_year"),
        table_cell(h, "工作員データ", "入力").alias("input_person"), table_cell(h, "工作員データ", "校正").alias("proof_person"),
    )


def structure_profile(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Counts of headings and lists, heading texts, author items of every page."""
    h = F.col(html)
    count = lambda t: F.regexp_count(h, F.lit(rf"(?i)<{t}\b")).alias(f"n_{t}")
    return pages.select(F.col(url).alias("url"), *map(count, ("h1", "h2", "h3", "ol", "li")), F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]>"), 1), text_of).alias("headings"), F.regexp_count(h, F.lit(r"\(公開中：\d+\)")).alias("n_author_items"))


AUTHOR_JSON = "authors array<struct<name:string,name_reading:string,works_count:int,copyright_status:string,author_url:string,alias_info:string,section:string,scraped_at:string>>, total_count int, scraped_at string"


def read_author_json(spark: SparkSession, path: str) -> DataFrame:
    """Authors of an export as table rows, with the defaults of the table."""
    rows = spark.read.schema(AUTHOR_JSON).json(path, multiLine=True).select(F.explode("authors").alias("a"))
    return author_rows(rows.select("a.*"))


def author_rows(rows: DataFrame) -> DataFrame:
    """Export columns under their table names, defaults filled in."""
    return rows.select(
        F.col("name").alias("author_name"), F.col("name_reading").alias("author_name_kana"), F.col("author_url").alias("aozora_author_url"),
        F.coalesce("copyright_status", F.lit("expired")).alias("copyright_status"), F.coalesce("works_count", F.lit(0)).alias("aozora_works_count"),
        "alias_info", F.coalesce("section", F.lit("その他")).alias("section"), F.lit("v4.0").alias("source_system"), F.lit("pending").alias("verification_status"),
    )


def preview_author_json(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first rows of an export beside its metadata."""
    return spark.read.schema(AUTHOR_JSON).json(path, multiLine=True).select("total_count", "scraped_at", F.explode(F.slice("authors", 1, n)).alias("a")).select("total_count", "scraped_at", "a.*")


def lookup_pages(authors: DataFrame, pages: DataFrame, name: str = "author_name") -> DataFrame:
    """``author_id, title, url, extract, birth_year, death_year, keyword`` of the page that describes each author.

    ``pages`` has ``keyword, title, url, summary, content, options`` (``options``: what a page that
    only lists others offers). Keywords are tried in the order of their words; the first page counts
    that tells of a writer born from 1850 to 1920, directly or through the best of its options.
    """
    words = F.array(*(F.lit(w) for w in V.LOOKUP_WORDS))
    tried = authors.select("author_id", F.col(name).alias("_n"), F.posexplode(words).alias("rank", "word")).select("author_id", "rank", F.concat("_n", "word").alias("keyword"))
    found = tried.join(pages, "keyword").withColumn("option", best_literary_option(F.col("options")))
    own = pages.where("options IS NULL").groupBy("title").agg(F.min(F.struct("url", "summary", "content")).alias("p"))
    direct = found.where("options IS NULL").select("author_id", "rank", "keyword", "title", "url", "summary", "content")
    chosen = found.where("option IS NOT NULL").select("author_id", "rank", "keyword", F.col("option").alias("title")).join(own, "title").select("author_id", "rank", "keyword", "title", "p.url", "p.summary", "p.content")
    told = direct.unionByName(chosen).withColumn("life", life_years(F.col("summary"), F.col("content")))
    fit = told.where(F.col("life.birth_year").between(1850, 1920) & is_literary(F.col("summary")))
    best = fit.groupBy("author_id").agg(F.min(F.struct("rank", "title", "url", "summary", "life", "keyword")).alias("b"))
    return best.select("author_id", "b.title", "b.url", F.substring("b.summary", 1, 500).alias("extract"), "b.life.birth_year", "b.life.death_year", "b.keyword")


def new_works(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed works (``author_id, title, url``) whose normalized title the author does not have yet; titles or addresses that are empty are left out."""
    titled = listed.where("trim(title) <> '' AND url <> ''").withColumn("title", normalize_title(strip(F.col("title"))))
    return titled.join(known.select("author_id", "title").distinct(), ["author_id", "title"], "left_anti")


def first_of(df: DataFrame, *names: str) -> Column:
    """The first value that is not null of the columns that ``df`` has among ``names``; null if it has none."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def work_rows(rows: DataFrame) -> DataFrame:
    """Works under their table names, from whichever of the old names the rows have."""
    return rows.select(first_of(rows, "work_title", "title").cast("string").alias("title"), first_of(rows, "author_id").cast("long").alias("author_id"), first_of(rows, "aozora_url", "aozora_work_url", "work_url").cast("string").alias("aozora_work_url"))


def mention_rows(rows: DataFrame) -> DataFrame:
    """Mentions under their table names, from whichever of the old names the rows have."""
    return rows.select(
        first_of(rows, "sentence_id").cast("long").alias("sentence_id"), first_of(rows, "master_id", "place_id").cast("long").alias("master_id"), first_of(rows, "matched_text").cast("string").alias("matched_text"), first_of(rows, "start_position", "position_in_sentence").cast("int").alias("start_position")
    )


def person_links(pages: DataFrame) -> DataFrame:
    """``url, text, person_url`` of the links to pages of persons, absolute and without a place in the page."""
    found = links(pages, "person").where(is_person_page(F.col("href")))
    return found.select("url", "text", absolute(F.substring_index("href", "#", 1), F.col("url")).alias("person_url"))


def ingested(fetched: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works with a text that are not known yet, works to be tried again) of fetched pages ``author, title, text``."""
    fresh = fetched.join(known.select("author", "title").distinct(), ["author", "title"], "left_anti")
    lacks = F.coalesce(F.length("text") == 0, F.lit(True))
    return fresh.where(~lacks), fresh.where(lacks).select("author", "title")


def write_author_json(authors: DataFrame, path: str) -> None:
    """Authors as JSON lines under ``authors``, and the export's time and statistics under ``metadata``."""
    from fumiyori.operators.statistics import export_statistics

    authors.write.mode("overwrite").json(f"{path}/authors")
    export_statistics(authors).withColumn("export_date", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
