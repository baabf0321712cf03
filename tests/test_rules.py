"""Japanese text rules, pages, merges and metrics on small literal inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from fumiyori.functions import scoring as C
from fumiyori.functions import text as X
from fumiyori.functions import vocabulary as V
from fumiyori.operators import merging as M
from fumiyori.operators import relations as R
from fumiyori.operators import resolving as G
from fumiyori.sources import pages as P


def one(spark, expression, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(expression(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("text, expected", [("大坂", "大阪"), ("１２３", "123"), ("京都府", "京都"), ("市川", "川"), ("山山", "山"), ("東京の", "東京"), ("", ""), ("　東亰　", "東京")])
def test_place_key(spark, text, expected):
    assert one(spark, X.normalize_place_name, text) == expected


@pytest.mark.parametrize("text, year", [("1930（昭和5）年", 1930), ("明治43年", 1910), ("大正1年", 1912), ("昭和5", 1930), ("１９３０年", 1930), ("0123年、明治0年", None), ("", None), ("戦前の1935", 1935)])
def test_year(spark, text, year):
    assert one(spark, X.extract_year, text) == year


@pytest.mark.parametrize("text, parts", [("鎌倉である。私は書生であった。", ["鎌倉である。", "私は書生であった。"]), ("", []), ("短い。", [])])
def test_split(spark, text, parts):
    assert one(spark, lambda c: X.split_sentences(c), text) == [p for p in parts if len(p) >= 6]


def test_split_keeps_all_characters(spark):
    text = "一つ目の文である。二つ目！三つ目？ 四つ目"
    pieces = one(spark, lambda c: X.split_sentences(c, "。！？", 1, 10_000), text)
    assert "".join(pieces) == text.replace(" ", "")


@pytest.mark.parametrize("text, by_words, by_ending", [("来るか", "来るか？", "来るか？"), ("行くよ", "行くよ！", "行くよ。"), ("雨だ", "雨だ。", "雨だ！"), ("済。", "済。", "済。"), ("", "", "")])
def test_punctuation(spark, text, by_words, by_ending):
    assert (one(spark, X.add_punctuation, text), one(spark, X.restore_punctuation, text)) == (by_words, by_ending)


def test_markup(spark):
    text = "<ruby>漱石<rt>そうせき</rt></ruby>は｜東京《とうきょう》［＃「東京」に傍点］に。\n底本：全集\n入力：誰か\n"
    assert one(spark, X.clean_markup, text) == "漱石（そうせき）は｜東京に。"
    assert tuple(one(spark, X.markup_counts, text)) == (1, 0, 2)


def test_null_text_stays_null(spark):
    for rule in (X.clean_markup, X.normalize_place_name, X.add_punctuation, X.detect_genre, X.extract_year, X.clean_text):
        assert one(spark, rule, None) is None


@pytest.mark.parametrize("compat, expected", [(False, "a東京に\nb"), (True, "a東京[注]にb")])
def test_clean_text_orders(spark, compat, expected):
    assert one(spark, lambda c: X.clean_text(c, compat), "ａ東京《とう》［注］に\n\nｂ") == expected


def test_life_years_and_options(spark):
    assert tuple(one(spark, lambda c: X.life_years(c, F.lit("")), "某（1867年2月9日 - 1916年12月9日）は作家")) == (1867, 1916)
    options = F.array(F.lit("某 (植物学者)"), F.lit("某 (詩人)"), F.lit("某 (小説家)"))
    assert one(spark, lambda c: X.best_literary_option(options), "x") == "某 (小説家)"
    assert one(spark, lambda c: X.is_literary(c), "明治の詩人") is True


def test_replies(spark):
    reply = one(spark, X.parse_reply, '```json\n{"is_place_name": true, "confidence": 0.9}\n```')
    assert (reply.is_place_name, reply.confidence) == (True, 0.9)
    assert one(spark, X.parse_reply, '{"confidence": 1}') is None and one(spark, X.parse_reply, "no json") is None


@pytest.mark.parametrize("n, k, action, confidence, valid", [(5, 0, "削除推奨", 0.5, False), (5, 1, "削除検討", 0.4, False), (5, 3, "要再検討", 0.45, True), (5, 4, "保持推奨", 0.5, True), (0, 0, "不明", 0.0, False)])
def test_verdicts(spark, n, k, action, confidence, valid):
    v = spark.range(1).select(C.verdict(F.lit(n), F.lit(k), F.lit(0.5)).alias("v")).first().v
    assert (v.action, v.is_valid) == (action, valid) and v.confidence == pytest.approx(confidence)


def test_contexts(spark):
    a = one(spark, lambda p, s: C.context_a(p, s, F.lit(None), F.lit(None)), "江戸", "江戸の町に行った。")
    assert a.is_place and a.confidence == pytest.approx(0.2)
    b = one(spark, lambda p, s: C.context_b(p, s, F.lit(None), F.lit(None)), "柏", "柏さんは怒って笑った。")
    assert not b.is_place and b.confidence == 0.8
    assert one(spark, lambda p, s: C.context_b(p, s, F.lit(None), F.lit(None)), "夏目", "x").confidence == 0.95


def test_geocoding_tiers(spark):
    names = spark.createDataFrame([("本郷",), ("江戸",), ("京都",), ("パリ",), ("新横浜駅",), ("無い所",), (None,), ("",)], "name string")
    got = {r.name: (r.tier, r.location) for r in G.geocode(names).collect()}
    assert got["本郷"] == (1, "東京都文京区") and got["江戸"][0] == 2 and got["パリ"][0] == 4 and got["無い所"] == (None, None)
    assert got["京都"] == (3, "東京都") and got["新横浜駅"][0] == 6 and len(got) == 6
    assert {r.name: r.location for r in G.geocode(names, compat=False).collect()}["京都"] == "京都府"


def test_author_index(spark):
    html = '<ol><li><a href="person74.html#x">梶井 基次郎</a> (公開中：54) ＊著作権存続＊</li><li>芥川 紗織 (公開中：5) (→間所 紗織)</li><li>なし</li></ol><ol></ol>'
    rows = [tuple(r) for r in P.author_index(spark.createDataFrame([("https://site.example/index/a.html", html)], "url string, html string")).collect()]
    assert rows == [("ア", "梶井 基次郎", 54, "active", None, "https://site.example/index_pages/person74.html"), ("ア", "芥川 紗織", 5, "expired", "間所 紗織", None)]


def test_main_text_precedence(spark):
    pages = ['<body><nav>n</nav><div class="main_text">本<div>文</div></div>後</body>', "<body><script>s</script>体</body>", "<p>全部</p>", None, ""]
    got = [r.x for r in spark.createDataFrame([(p,) for p in pages], "h string").select(P.main_text(F.col("h")).alias("x")).collect()]
    assert got == ["本文", "体", "全部", None, ""]


def test_decoding(spark):
    data = [("東京".encode("shift_jis"),), ("東京".encode("euc_jp"),), ("東京".encode() + b"\xff",), (None,)]
    got = [r.x for r in spark.createDataFrame([(bytearray(d[0]) if d[0] else None,) for d in data], "b binary").select(P.decode_legacy(F.col("b")).alias("x")).collect()]
    assert got[0] == "東京" and got[3] is None and len(got) == 4


def test_get_or_create_is_idempotent(spark):
    base = spark.createDataFrame([(1, "東京")], "id long, name string")
    new = spark.createDataFrame([(None, "東京"), (None, "京都"), (None, "京都"), (None, None)], "id long, name string")
    once = M.get_or_create(base, new, "name", "id")
    twice = M.get_or_create(once, new, "name", "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "東京"), (2, "京都")]


def test_merge_modes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", None), ("c", 3)], "k string, v int")
    assert sorted(map(str, map(tuple, M.upsert(old, new, "k").collect()))) == ["('a', 1, 'x')", "('b', 2, 'y')", "('c', 3, None)"]
    assert sorted(map(str, map(tuple, M.upsert(old, new, "k", True).collect())))[0] == "('a', None, 'x')"
    assert M.upsert(old.where("false"), new.where("false"), "k").count() == 0


def test_name_patterns(spark):
    assert one(spark, R.author_patterns, "夏目漱石") == ["夏目漱石", "夏目 漱石", "夏 目漱石"]
    assert one(spark, R.author_patterns, "太宰") == ["太宰"]


def test_windows_equal_self_joins(spark):
    rows = [(i, w, o, f"t{i}") for i, (w, o) in enumerate([(1, 1), (1, 2), (1, 4), (1, 5), (1, 9), (2, 1), (2, 3)])]
    s = spark.createDataFrame(rows, "sentence_id long, work_id long, sentence_order int, sentence_text string")
    got = {r.sentence_id: (r.context_before, r.context_after) for r in R.context_windows(s).collect()}
    for i, w, o, _ in rows:
        before = "".join(t for _, w2, o2, t in sorted(rows, key=lambda r: r[2]) if w2 == w and o - 2 <= o2 <= o - 1) or None
        after = "".join(t for _, w2, o2, t in sorted(rows, key=lambda r: r[2]) if w2 == w and o + 1 <= o2 <= o + 2) or None
        assert got[i] == (before, after)


def test_streaming_metrics_equal_batch(spark, tmp_path):
    from fumiyori.streaming.metrics import hourly_metrics, run_to_folder

    at = lambda h: datetime.datetime(2024, 1, 1, h, 30)
    events = spark.createDataFrame([(at(1), "a", 1.0), (at(1), "a", 3.0), (at(2), "b", None), (at(9), "a", 2.0)], "ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = run_to_folder(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    done = {tuple(r) for r in spark.read.schema(hourly_metrics(events).schema).parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in hourly_metrics(events).collect()}
    assert done <= batch and {r[2] for r in done} == {"a", "b"}


def test_config_and_store(spark, tmp_path):
    from fumiyori.api import Config, NotFound, Store

    assert Config.load({"FUMIYORI_MIN_CONFIDENCE": "0.5"}, {"min_confidence": 2.0}).validate() == ["min_confidence must lie between 0 and 1"]
    spark.createDataFrame([(1, "a")], "author_id long, author_name string").write.parquet(str(tmp_path / "authors.parquet"))
    store = Store(spark, str(tmp_path))
    assert store.get("authors", 1).count() == 1 and store.find("authors", author_name="b").count() == 0
    assert sorted(r.author_id for r in store.create("authors", spark.createDataFrame([("z",)], "author_name string"), ["author_name"]).collect()) == [1, 2]
    with pytest.raises(NotFound):
        store.table("nothing")


def test_gazetteer_is_small(spark):
    assert G.gazetteer(spark).count() == len(V.rows(V.CITIES)) + len(V.rows(V.HISTORICAL)) + 47 + 10


def test_resolution_tiers_and_rejected(spark):
    masters = spark.createDataFrame([(1, "東京", "東京都", None), (2, "京", "京", None), (3, "新橋", "新橋駅", "rejected"), (4, "日本橋", "日本橋", "pending"), (5, "日本橋北", "日本橋北詰", None)], "master_id long, normalized_name string, display_name string, validation_status string")
    aliases = spark.createDataFrame([(1, "江戸"), (3, "芝口"), (None, "空")], "master_id long, alias_name string")
    names = spark.createDataFrame([("東京府",), ("東京都",), ("江戸",), ("日本",), ("新橋駅",), ("芝口",), ("無",), ("",), (None,), ("日本橋北詰の",)], "name string")
    got = {r.name: (r.master_id, r.tier) for r in G.resolve_masters(names, masters, aliases).collect()}
    assert got == {"東京府": (1, 1), "東京都": (1, 2), "江戸": (1, 3), "日本": (4, 4), "新橋駅": (None, None), "芝口": (None, None), "無": (None, None), "日本橋北詰の": (None, None)}


def test_created_and_located_masters(spark):
    masters = spark.createDataFrame([(7, "東京", "東京都", "rejected", 3, None, None, None)], "master_id long, normalized_name string, display_name string, validation_status string, usage_count long, latitude double, longitude double, geocoding_confidence double")
    names = spark.createDataFrame([("東京府",), ("京都府",), ("京都",), ("",), (None,)], "name string")
    made = G.create_masters(names, masters)
    assert sorted((r.master_id, r.normalized_name, r.display_name) for r in made.collect()) == [(7, "東京", "東京都"), (8, "京都", "京都")]
    located = spark.createDataFrame([("京都", 35.0, 135.7, 0.9), ("東京都", 0.0, 139.0, 0.9)], "name string, lat double, lon double, confidence double")
    assert {r.master_id: r.latitude for r in G.locate_masters(made, located).collect()} == {7: None, 8: 35.0}


def test_verdict_gate_and_addresses(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    verdicts = spark.createDataFrame([("a", True, 0.9), ("b", True, 0.5)], "name string, is_place_name boolean, confidence double")
    assert sorted(r.name for r in G.accepted(names, verdicts).collect()) == ["a", "c"]
    results = spark.createDataFrame([("x", 1, "パリ", 48.0, 2.0), ("x", 2, "日本", 35.0, 139.0), ("y", 1, "どこか", 1.0, 1.0), ("y", 2, "東京y町", 35.0, 139.0)], "name string, ordinal int, address string, lat double, lon double")
    assert {r.name: r.address for r in G.best_address(results).collect()} == {"x": "日本", "y": "東京y町"}


def test_json_sources_round_trip(spark, tmp_path):
    import json

    path = tmp_path / "authors.json"
    path.write_text(json.dumps({"authors": [{"name": "某", "works_count": 3}, {"name": "誰", "section": "ア"}], "total_count": 2, "scraped_at": "x"}))
    rows = {r.author_name: (r.aozora_works_count, r.copyright_status, r.section) for r in P.read_author_json(spark, str(path)).collect()}
    assert rows == {"某": (3, "expired", "その他"), "誰": (0, "expired", "ア")}
    assert P.preview_author_json(spark, str(path), 1).count() == 1
    authors = spark.createDataFrame([(1, "ア", "expired")], "author_id long, section string, copyright_status string")
    P.write_author_json(authors, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "authors")).count() == 1


def test_schema_evolution(spark):
    from fumiyori.schema import AUTHORS_CORE, evolve, schema_diff

    old = spark.createDataFrame([(1, "a", None)], "author_id long, author_name string, section string")
    new = evolve(old)
    assert new.first().copyright_status == "expired" and new.first().section is None
    assert {("missing", "birth_year"), ("extra", "section")} <= {tuple(r) for r in schema_diff(old, AUTHORS_CORE).collect()}


def test_pipeline_writes_and_reads(spark, tmp_path):
    import os

    from fumiyori.plans import pipeline

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    paths = pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert {name: spark.read.parquet(path).count() > 0 for name, path in paths.items()} == dict.fromkeys(paths, True)


def test_logical_deletion(spark):
    masters = spark.createDataFrame([(1, "a", None), (2, "b", "pending")], "master_id long, display_name string, validation_status string")
    mentions = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "relation_id long, master_id long")
    marked, left, report = M.reject_places(masters, mentions, spark.createDataFrame([("a",), ("z",), ("a",)], "name string"))
    assert {r.master_id: r.validation_status for r in marked.collect()} == {1: "rejected", 2: "pending"}
    assert [r.relation_id for r in left.collect()] == [3]
    assert {tuple(r) for r in report.collect()} == {("a", 2, True), ("z", 0, False)}


def test_blocks_do_not_change_windows(spark, monkeypatch):
    rows = [(i, w, o, f"t{i}") for i, (w, o) in enumerate([(1, 1), (1, 2), (1, 4), (1, 5), (1, 9), (2, 1), (2, 3), (2, None), (3, -1), (3, 0), (3, 1)])]
    s = spark.createDataFrame(rows, "sentence_id long, work_id long, sentence_order int, sentence_text string")
    whole = sorted(map(str, R.context_windows(s).collect())), sorted(map(tuple, R.sentence_positions(s).collect()))
    monkeypatch.setattr(R, "BLOCK", 2)
    assert (sorted(map(str, R.context_windows(s).collect())), sorted(map(tuple, R.sentence_positions(s).collect()))) == whole
    assert R.context_windows(s.where("false")).count() == R.sentence_positions(s.where("false")).count() == 0


def test_contexts_of_equal_places_follow_the_ids(spark):
    from fumiyori.operators.relations import context_windows

    rows = [(9, 1, 1, "a"), (2, 1, 1, "b"), (5, 1, 2, "c"), (7, 1, 3, "e"), (3, 1, 3, "d"), (4, 1, None, "x")]
    got = {r.sentence_id: (r.context_before, r.context_after) for r in context_windows(spark.createDataFrame(rows, "sentence_id long, work_id long, sentence_order int, sentence_text string")).collect()}
    assert got == {9: (None, "cde"), 2: (None, "cde"), 5: ("ba", "de"), 7: ("bac", None), 3: ("bac", None), 4: (None, None)}
