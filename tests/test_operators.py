"""Bounds, ties and missing values of the core operators, on literal rows."""

import pytest
from pyspark.sql import functions as F

from fumiyori.functions import scoring as C
from fumiyori.functions import text as X
from fumiyori.functions import vocabulary as V
from fumiyori.operators import merging, proximity, relations, resolving, statistics
from fumiyori.plans import pipeline
from fumiyori.sources import pages as P


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sentences_of_any_length_are_kept(spark):
    long = "あ" * 1_000_001 + "。"
    df = spark.createDataFrame([("短い文です。" + long,)], "t string")
    got = df.select(X.split_sentences(F.col("t"), "。．！？", 3, None).alias("s")).first().s
    assert got == ["短い文です。", long]
    cut = pipeline.sentences_of_texts(df.select(F.lit(1).alias("work_id"), F.col("t").alias("text")))
    assert [r.char_count for r in cut.collect()] == [6, 1_000_002]


def test_surnames_of_any_length_find_their_author(spark):
    authors = spark.createDataFrame([(1, "Mary Wollstonecraft"), (2, "丘 のぼる"), (3, "夏目 漱石"), (4, None), (5, "")], "author_id long, author_name string")
    names = spark.createDataFrame([("Wollstonecraft M.",), ("丘 登",), ("夏目漱石",), ("無",), ("",), (None,)], "name string")
    assert rows(relations.match_authors(names, authors)) == [("Wollstonecraft M.", 1), ("丘 登", 2), ("夏目漱石", 3)]


def test_containing_equals_brute_force(spark):
    parts, wholes = ["", "a", "ab", "ba", "abc", "xyz", "bb", "aab"], ["", "a", "abba", "aabb", "cab", "bcabc", "zzxyzz", None]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(parts)], "i int, part string")
    w = spark.createDataFrame([(i, x) for i, x in enumerate(wholes)], "j int, whole string")
    got = sorted((r.part, r.j) for r in relations.containing(p.unionByName(p), "part", w, "whole").collect())
    assert got == sorted((x, j) for x in parts for j, y in enumerate(wholes) if x and y and x in y)


def test_substring_tier_looks_for_key_and_name_in_their_own_columns(spark):
    masters = spark.createDataFrame([(1, "町田駅前", "町田駅前", None), (2, "青山墓地", "青山墓地", "rejected"), (3, "新青山台", "新青山台町", "pending"), (4, "長い青山通", "青山通", "pending"), (5, "北田", "北田町", None)], "master_id long, normalized_name string, display_name string, validation_status string")
    aliases = spark.createDataFrame([], "alias_id long, master_id long, alias_name string")
    # 町田 has the key 田: one character, found in the shortest normalized name with it.
    names = spark.createDataFrame([("町田",), ("青山",), ("無人島",), ("県",), ("",), (None,)], "name string")
    assert rows(resolving.resolve_masters(names, masters, aliases)) == [("無人島", None, None), ("町田", 5, 4), ("県", None, None), ("青山", 3, 4)]


def test_contexts_order_equal_places_by_id(spark):
    df = spark.createDataFrame([(2, 1, 1, "b"), (1, 1, 1, "a"), (3, 1, 2, "c"), (4, 1, None, "x"), (5, None, 1, "y")], "sentence_id long, work_id long, sentence_order int, sentence_text string")
    assert rows(relations.context_windows(df)) == [(1, None, "c"), (2, None, "c"), (3, "ab", None), (4, None, None), (5, None, None)]


def test_nan_is_no_coordinate(spark):
    nan = float("nan")
    masters = spark.createDataFrame([(1, "a", nan, nan, 0.95, "validated", 2), (2, "b", 35.0, 139.0, 0.95, None, 1), (3, "c", None, 1.0, 0.8, None, None), (4, "d", 1.0, nan, 0.8, None, None)], "master_id long, display_name string, latitude double, longitude double, geocoding_confidence double, validation_status string, usage_count long")
    assert rows(statistics.master_summary(masters)) == [(4, 2, 1, 3, 50.0)]
    assert rows(statistics.geocoding_statistics(masters)) == [(4, 1, 1, 0, 25.0)]
    empty = spark.createDataFrame([], "relation_id long, sentence_id long, master_id long, sentence_text string")
    assert [r[0] for r in rows(statistics.ungeocoded_usage(masters, empty, empty))] == [1, 3, 4]


def test_literal_rules_of_years_and_hits(spark):
    texts = {"1930（昭和5）年": 1930, "明治43年": 1910, "大正1年": 1912, "昭和5": 1930, "１９３０年": 1930, "年のない文": None, "人口は1200人": None, "戦前の記録、およそ1935": 1935, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.y for r in df.select("t", X.extract_year(F.col("t")).alias("y")).collect()} == texts
    patterns = ["[へに]行", "町", "は.*言った", "藩$", "a.c"]
    lines = {"京へ行く": 1, "町に行った": 2, "彼は強く言った": 1, "水戸藩": 1, "水戸藩の町": 1, "abc": 1, "へ 行": 0}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r.t: r.n for r in df.select("t", C.hits(F.col("t"), patterns).alias("n")).collect()} == lines


def test_hits_equal_plain_patterns(spark):
    df = spark.createDataFrame([("京へ行き、町を通って寺に着いた。さん",), ("彼は笑った",), (" 昔の藩 ",), ("",)], "t string")
    for patterns in (V.PLACE_CONTEXT, V.PERSON_CONTEXT, V.HISTORY_CONTEXT):
        plain = F.size(F.filter(F.array(*(F.col("t").rlike(p) for p in patterns)), lambda h: h))
        assert all(r.a == r.b for r in df.select(C.hits(F.col("t"), patterns).alias("a"), plain.alias("b")).collect())


def test_worklist_keeps_first_sentences(spark):
    masters = spark.createDataFrame([(1, "a", 0.5, None), (2, "b", None, None), (3, "c", 0.1, "validated")], "master_id long, display_name string, geocoding_confidence double, validation_status string")
    mentions = spark.createDataFrame([(1, s) for s in (*range(1, 9), 70_000, 1)] + [(2, 5), (2, 999)], "master_id long, sentence_id long")
    sentences = spark.createDataFrame([(s, f"s{s}") for s in (*range(1, 9), 70_000)], "sentence_id long, sentence_text string")
    assert rows(statistics.verification_worklist(masters, mentions, sentences)) == [(1, "a", 10, 5, "s1|||s2|||s3|||s4|||s5"), (2, "b", 2, 1, "s5")]


def test_ids_follow_the_order_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merging, "ID_ROWS", 7)
    old = spark.createDataFrame([(41, "z")], "id long, name string")
    new = spark.createDataFrame([(f"n{i:03}",) for i in range(100)] + [("n005",), ("z",), (None,)], "name string")
    got = {r.name: r.id for r in merging.get_or_create(old, new, "name", "id").collect()}
    assert got == {"z": 41} | {f"n{i:03}": 42 + i for i in range(100)}


def test_areas_over_many_bins(spark):
    square = "POLYGON((100 10, 140 10, 140 50, 100 50, 100 10), (110 20, 120 20, 120 30, 110 30, 110 20))"
    two = "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"
    areas = spark.createDataFrame([(1, square), (2, two), (3, None), (4, "POINT(1 1)")], "area_id int, boundary_wkt string")
    places = {1: (30.0, 130.0), 2: (25.0, 115.0), 3: (25.0, 105.0), 4: (30.0, 141.0), 5: (30.0, 99.0), 6: (10.0, 120.0), 7: (50.0, 140.0), 8: (1.0, 1.0), 9: (5.5, 5.5), 10: (3.0, 3.0), 11: (20.0, 115.0)}
    points = spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, lat double, lon double")
    want = {(1, 1), (3, 1), (6, 1), (7, 1), (8, 2), (9, 2), (11, 1)}
    for width in (0.5, 1.0, 360.0):
        assert {(r.id, r.area_id) for r in proximity.inside_areas(points, areas, bin_deg=width).collect()} == want


def test_simple_geocoder_and_context(spark):
    names = spark.createDataFrame([("銀座",), ("東京",), ("青森",), ("長野県松本",), ("どこか",), ("",)], "name string")
    got = {r.name: (r.tier, r.location, r.confidence) for r in resolving.geocode_simple(names).collect()}
    assert got == {"銀座": (1, "東京都中央区", 0.95), "東京": (2, "東京都", 0.95), "青森": (2, "青森県", 0.95), "長野県松本": (3, "長野県", 0.65), "どこか": (None, None, None)}
    judged = spark.createDataFrame([("銀座", False), ("銀座", True), ("江戸", False)], "name string, is_place boolean")
    assert [r.name for r in resolving.geocode_in_context(judged).collect()] == ["銀座"]


def test_touch_and_consolidation(spark):
    before = spark.createDataFrame([(1, "a", "t0"), (2, None, "t0"), (3, "c", "t0")], "k long, v string, updated_at string")
    after = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0"), (3, "d", "t0"), (4, "e", None)], "k long, v string, updated_at string")
    assert rows(merging.touch(before, after, "k", F.lit("t1"))) == [(1, "a", "t0"), (2, "b", "t1"), (3, "d", "t1"), (4, "e", "t1")]
    none = before.where("false")
    assert [merging.consolidation(*x) for x in ((none, none), (none, after), (before, none), (before, after))] == ["nothing", "keep new", "take over", "refuse"]


def test_pages_of_authors(spark):
    authors = spark.createDataFrame([(1, "夏目 漱石"), (2, "某 氏"), (3, "同 名")], "author_id long, author_name string")
    life = "小説家（1867年2月9日 - 1916年12月9日）。"
    pages = [("夏目 漱石 作家", "夏目漱石", "u1", life, "", None), ("夏目 漱石 明治", "他", "u0", life, "", None), ("某 氏", "某", "u2", "政治家（1867年2月9日 - 1916年12月9日）。", "", None), ("同 名", "曖昧", "u3", "", "", ["同名 (医師)", "同名 (詩人)"]), ("x", "同名 (詩人)", "u4", life, "", None)]
    df = spark.createDataFrame(pages, "keyword string, title string, url string, summary string, content string, options array<string>")
    assert rows(P.lookup_pages(authors, df).select("author_id", "title", "birth_year", "death_year", "keyword")) == [(1, "夏目漱石", 1867, 1916, "夏目 漱石 作家"), (3, "同名 (詩人)", 1867, 1916, "同 名")]


def test_new_and_ingested_works(spark):
    known = spark.createDataFrame([(1, "こころ")], "author_id long, title string")
    listed = spark.createDataFrame([(1, "こころ", "u"), (1, " こころ　", "u"), (1, "ＡＢＣ", "u"), (2, "こころ", "u"), (1, "", "u"), (1, "門", ""), (1, None, "u")], "author_id long, title string, url string")
    assert rows(P.new_works(listed, known).select("author_id", "title")) == [(1, "ABC"), (2, "こころ")]
    fetched = spark.createDataFrame([("a", "x", "text"), ("a", "y", ""), ("a", "z", None), ("b", "k", "text")], "author string, title string, text string")
    done, again = P.ingested(fetched, spark.createDataFrame([("b", "k")], "author string, title string"))
    assert rows(done.select("title")) == [("x",)] and rows(again) == [("a", "y"), ("a", "z")]


def test_tokens(spark):
    df = spark.createDataFrame([("彼は東京タワーへ2度 行ったNo.7",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.tokens(F.col("t"))).collect()] == [["彼", "は", "東京", "タワー", "へ", "2", "度", "行", "った", "No", ".", "7"], [], None]
    assert df.select(X.tokens(F.lit(" 吾輩 は　猫 "), separated=True)).first()[0] == ["吾輩", "は", "猫"]


def test_verdicts_take_the_kind_most_contexts_give(spark):
    df = spark.createDataFrame([("a", True, 0.8, "x"), ("a", True, 0.6, "x"), ("a", False, 0.4, "y"), ("b", False, 0.9, "y"), ("b", False, 0.7, "x"), ("c", True, 1.0, None)], "name string, is_place boolean, confidence double, place_type string")
    assert rows(statistics.place_verdicts(df, "name")) == [("a", 3, True, 0.54, "要再検討", "x"), ("b", 2, False, 0.8, "削除推奨", "y"), ("c", 1, True, 1.0, "保持推奨", None)]


def test_index_is_kept_up(spark):
    masters = spark.createDataFrame([(1, "a b", "A", None), (2, "c", "C", None), (3, "d", "D", None)], "master_id long, normalized_name string, display_name string, canonical_name string")
    aliases = spark.createDataFrame([(1, "old"), (2, "see"), (None, "x")], "master_id long, alias_name string")
    index = resolving.search_index(masters, aliases)
    now = masters.where("master_id <> 3").withColumn("display_name", F.when(F.col("master_id") == 1, "Z").otherwise(F.col("display_name")))
    changed = spark.createDataFrame([(1,), (3,)], "master_id long")
    assert rows(resolving.updated_index(index, changed, now, aliases)) == rows(resolving.search_index(now, aliases))


def test_cache_expires_and_is_invalidated(spark):
    from fumiyori.api import Cache

    clock, made = [0.0], []
    cache = Cache(10, lambda: clock[0])
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("authors:1", make).count() == 3 and cache.get("authors:1", make).count() == 3 and len(made) == 1
    clock[0] = 10.0
    assert cache.get("authors:1", make).count() == 3 and len(made) == 2
    cache.get("works:1", make)
    assert cache.invalidate("authors:") == 1 and cache.invalidate() == 1 and cache.invalidate() == 0


def test_old_names_and_person_pages(spark):
    one = spark.createDataFrame([("t", 1, None, "u")], "work_title string, author_id long, aozora_url string, work_url string")
    assert rows(P.work_rows(one)) == [("t", 1, "u")] and rows(P.work_rows(one.select("author_id"))) == [(None, 1, None)]
    hrefs = {"person12.html#a": True, "person12.html": True, "person.html": False, "x/person12.html": False, "person12.html\n": False}
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    assert {r.h: r.p for r in df.select("h", X.is_person_page(F.col("h")).alias("p")).collect()} == hrefs


def test_preview_of_an_export(spark, tmp_path):
    import json

    path = tmp_path / "a.json"
    path.write_text(json.dumps({"authors": [{"name": "某", "works_count": 3}, {"name": "誰"}], "total_count": 2, "scraped_at": "x"}))
    assert [(r.total_count, r.scraped_at, r.name, r.works_count) for r in P.preview_author_json(spark, str(path), 1).collect()] == [(2, "x", "某", 3)]


def test_maintenance_reports_steps(spark, tmp_path):
    for name, schema in (("works", "work_id long, title string, author_id long, publication_year int"), ("sentences", "sentence_id long, work_id long, sentence_order int, sentence_text string"), ("authors", "author_id long, author_name string, birth_year int, death_year int"), ("place_masters", "master_id long, display_name string, validation_status string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], "relation_id long, sentence_id long, master_id long, matched_text string").write.parquet(str(tmp_path / "sentence_places.parquet"))
    report = {r.step: r.state for r in pipeline.maintain(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    # The mentions here lack the columns of two steps.
    assert report == {"enrich_mentions": "completed", "works_metadata": "failed", "publication_years": "completed", "whole_sentences": "completed", "usage": "failed"}
    pipeline.main(["delete", str(tmp_path), str(tmp_path / "out"), "東京"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "place_masters.parquet")).count() == 0


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from fumiyori import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        session.cut_lineage(type("D", (), {"sparkSession": Session()})())
