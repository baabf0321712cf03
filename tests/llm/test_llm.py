"""Operators of training texts: brute force, round trips, a public encoder, and edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fumiyori.llm import bpe, canonical, leakage, lookalike, mojibake, names, queries, residue, sentences

VOCABULARY = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# --- 1 ------------------------------------------------------------------------------


def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize("parts, glue", [
    (["「ここでいい。」", "医者は言った。"], ""),
    (["「待ってくれ！」と医者は橋の上で言った。", "雪が舞いはじめた。"], ""),
    (["（雨だ！　早く入れ！）", "私は帰った。"], ""),
    (["待て！　と叫ぶ声が響いた。", "え？　と妹が聞き返した。"], ""),
    (["医者はDr. と呼ばれていた。", "第1.2版のNo.7は売り切れた。"], ""),
    (["ああ……春よ、と彼は呟いた。", "もう遅い。"], "　"),
    (["花は散り人は去り", "母の写真を抱きて眠る夜", "ふるさとは遠く雲の空"], "\n"),
    (["“真的吗？”医生在那里说道。", "你去过北京吗？", "他把信寄到了上海……", "夜真安静啊！"], ""),
    (['"늦었다. 집에 가자." 하고 의사는 말했다.', "밤은 참 조용했다!"], " "),
    (["डॉ. वेलकर वहाँ रहते थे।", "क्या वह कभी लौटेगा?", '"रुको! कहाँ जाते हो?" नाविक ने कहा।'], " "),
    (["ไม่มีใครรู้จักSaint Kilda", "คุณหมออยู่ที่นั่นมา 3 ปีแล้ว", "ฝนตกหนักตลอดทั้งคืน"], " "),
    (["Dr. Vessel read vol. ii, e.g. p. 12.", "“Stop!” said Mr. J. T. Quill.", "It rose by 0.5 per cent. in May.", "They left at 9 a.m.", "How quiet it was!"], " "),
    (["Am 3. Mai ging er, z. B. um ca. 4.500 Leute zu sehen.", "„Halt! Wer da?“, sagte Frau Östling.", "Wie schön!"], " "),
    (["L’auberge Holà ! de Caen resta ouverte.", "« Déjà ? » demanda M. Cordelier.", "Quelle soirée !"], "  "),
])
def test_sentences_of_languages(parts, glue):
    assert cut(glue.join(parts)) == parts
    assert cut("  " + glue.join(parts) + "\n") == parts


@pytest.mark.parametrize("opening", "もちろん もっと しかも やっと とつぜん はるか ほどなく にわとり もみじ へちま のうぜん でんでん虫 からくり からす とりわけ".split())
def test_words_that_begin_like_particles_open_sentences(opening):
    assert cut(f"雪が舞いはじめた。{opening}、橋の上に見えた。") == ["雪が舞いはじめた。", f"{opening}、橋の上に見えた。"]


@pytest.mark.parametrize("opening", "もちろん もっと しかも やっと とつぜん はるか ほどなく にわとり からす".split())
def test_words_that_begin_like_particles_open_after_other_marks(opening):
    assert cut(f"なんと静かな夜だろう！{opening}、橋は見えた。") == ["なんと静かな夜だろう！", f"{opening}、橋は見えた。"]
    assert cut("もう遅い。と彼は言った。") == ["もう遅い。と彼は言った。"] and cut("もう遅い。って彼は言った。") == ["もう遅い。って彼は言った。"]


def test_looks_are_as_far_as_words_and_texts_are():
    long = "雪の降る" * 40
    assert cut(f"“真的吗？”他在桥上{'慢慢地' * 40}说，然后{'又看了看' * 40}走了。雨停了。") == [f"“真的吗？”他在桥上{'慢慢地' * 40}说，然后{'又看了看' * 40}走了。", "雨停了。"]
    assert cut(f"「{long}。（{long}『{long}“{long}《{long}。》{long}。”{long}。』{long}）」と言った。終わり。")[1:] == ["終わり。"]
    assert cut("It was long" * 9 + ".St. Anne. The end.") == ["It was long" * 9 + ".St. Anne.", "The end."]
    assert len(cut("「" * 20_000 + "雨。" + "」" * 20_000)) == 1


def test_terminator_lattice_gives_no_sentence_without_a_word():
    assert cut("How quiet it was! ... They left.") == ["How quiet it was! ...", "They left."]
    assert cut("Stop! ! Go on.") == ["Stop! !", "Go on."] and cut("... !") == ["... !"]


def test_openers_are_learned_from_the_corpus(spark):
    rows = [(i, f"ものぐさ{c}は来た。") for i, c in enumerate("太次三四五六")] + [(10 + i, f"船{c}は来た。") for i, c in enumerate("太次")]
    learned = sentences.learn_openers(spark.createDataFrame(rows, "i long, t string"), "t")
    assert "ものぐさ" in learned and not any(w.startswith("船") for w in learned)
    text = "静かだろう！ものぐさ男は来た。"
    assert [text[a:b] for a, b in sentences.sentence_spans(text, sentences.Lexicon(learned))] == ["静かだろう！", "ものぐさ男は来た。"]
    assert sentences.learn_openers(spark.createDataFrame([], "t string"), "t") == []


def test_sentence_edge_cases():
    assert cut(None) == cut("") == cut(" \n　") == []
    assert cut("終わりの印がない") == ["終わりの印がない"]
    assert cut("The line\nruns on. Next one") == ["The line\nruns on.", "Next one"]
    assert cut("Ã¤rger. Ã¼ber Ã¶l. GrÃ¶ÃŸe. Die Stra") and len(cut("あ「い。う。")) >= 1
    assert cut("「" * 5000) and len(cut("これは文である。" * 3000)) == 3000


def test_sentences_lose_nothing():
    random.seed(3)
    pieces = ["「待て！」", "と言った。", "医者は", "P. Thrane went. ", "ไม่มีใคร ", "“Stop!” ", "\n", "……", "（雨だ。）", "3.5 ", "か？", "M. Daubrel "]
    for _ in range(400):
        text = "".join(random.choices(pieces, k=random.randint(1, 12)))
        assert "".join(cut(text)).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_new_order(spark):
    rows = [(1, 7, 1, "一つ。二つ。"), (2, 7, 2, "三つ。"), (3, 8, None, "四つ。"), (4, None, 1, None)]
    got = sentences.reordered(spark.createDataFrame(rows, "sentence_id long, work_id long, sentence_order int, sentence_text string")).collect()
    assert sorted((r.work_id, r.sentence_order, r.sentence_text) for r in got) == [(7, 1, "一つ。"), (7, 2, "二つ。"), (7, 3, "三つ。"), (8, 1, "四つ。")]


# --- 2 ------------------------------------------------------------------------------


def places(spark, mentions, aliases=(), masters=()):
    m = spark.createDataFrame(list(mentions), "relation_id long, master_id long, matched_text string, name string")
    a = spark.createDataFrame(list(aliases), "alias_id long, master_id long, alias_name string, alias_type string")
    p = spark.createDataFrame(list(masters), "master_id long, normalized_name string, display_name string, canonical_name string")
    return {(r.source_table, r.source_id): r.master_id for r in canonical.match_places(m, a, p).collect()}


MASTERS = [(1, "楢淵洞", "楢淵洞駅", "楢淵洞駅"), (2, "votatemick", "Saint Votatemick Harbour", "Saint Votatemick Harbour"), (3, "柏瀧洞", "柏瀧洞", "柏瀧洞"), (4, "新貝町", "新貝町", None)]


def test_canonical_places(spark):
    texts = {1: ("楢淵洞駅", 1), 2: ("【楢淵洞】付近", 1), 3: ("楢淵淵洞駅", 1), 4: ("楢洞淵", 1), 5: ("桂雲県 楢淵洞駅", 1), 6: ("St. Votatemick Hbr.", 2), 7: ("Votatmick Harbour, Saint", 2), 8: ("ＳＡＩＮＴ_VOTATEMICK HARBOUR", 2), 9: ("新貝町", -1), 10: ("海辺", -1), 11: ("", -1), 12: (None, -1), 13: ("−", -1), 14: ("x" * 5000, -1), 15: ("冴郷荘", 3), 16: ("旧柏滝洞", 3)}
    got = places(spark, [(i, None, t, "n") for i, (t, _) in texts.items()] + [(99, 1, "楢淵洞駅", "n")], [(1, 3, "冴郷荘", "historical"), (2, None, "柏瀧洞方面", "variation")], MASTERS)
    assert got == {("sentence_places", i): m for i, (_, m) in texts.items()} | {("place_aliases", 2): 3}


def test_canonical_places_of_long_texts(spark):
    name = "ab cd " * 40 + "ef"
    texts = {1: ("楢淵洞駅" + "\u200b" * 200, 1), 2: (name, 9), 3: (name.replace("ef", "eg"), 9), 4: ("【" * 200 + "楢淵洞" + "】" * 200, 1), 5: ("yz" * 300, -1)}
    got = places(spark, [(i, None, t, "n") for i, (t, _) in texts.items()], [], [*MASTERS, (9, name, name, name)])
    assert got == {("sentence_places", i): m for i, (_, m) in texts.items()}


def test_canonical_places_empty(spark):
    assert places(spark, []) == {} and places(spark, [(1, None, "楢淵洞", "n")]) == {("sentence_places", 1): -1}


def test_pigeonhole_equals_brute_force(spark):
    """Every text within the allowed slips of a name is found, as a full comparison finds it."""
    random.seed(5)
    base = [(i, "".join(random.choices("abcdefgh", k=9)) + "ia") for i in range(40)]
    masters = [(i, b, b, b) for i, b in base]
    texts = []
    for i, b in random.choices(base, k=60):
        x = list(b)
        for _ in range(random.randint(0, 2)):
            x[random.randrange(len(x))] = random.choice("abcdefghz")
        texts.append("".join(x))
    got = places(spark, [(k, None, t, "") for k, t in enumerate(texts)], [], masters)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            row, last = [row[0] + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    for k, t in enumerate(texts):
        best = min(edits(t, b) for _, b in base)
        assert best <= 2 and edits(t, dict(base)[got["sentence_places", k]]) == best


@pytest.mark.parametrize("n, slips", [(3, 1), (4, 2), (5, 2)])
def test_short_names_meet_by_two_segments_as_a_full_comparison_finds_them(spark, n, slips):
    random.seed(n)
    base = sorted({"".join(random.sample("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未", k=n)) for _ in range(60)})
    masters = [(i, b, b, b) for i, b in enumerate(base)]
    texts = []
    for b in random.choices(base, k=150):
        x = list(b)
        for new in random.sample("申酉戌亥", random.randint(0, slips)):
            how, at = random.randrange(4), random.randrange(len(x))
            if how == 0:
                x[at] = new
            elif how == 1:
                x.insert(at, new)
            elif how == 2 and len(x) > 1:
                del x[at]
            else:
                x[at : at + 2] = x[at : at + 2][::-1]
        texts.append("".join(x))
    got = places(spark, [(k, None, t, "") for k, t in enumerate(texts)], [], masters)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            row, last = [row[0] + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return 1 if row[-1] == 2 and sorted(a) == sorted(b) else row[-1]

    for k, t in enumerate(texts):
        best = min(edits(t, b) for b in base)
        found = got["sentence_places", k]
        assert (found == -1) if best > slips else found >= 0 and edits(t, base[found]) == best, (t, found, best)


# --- 3 ------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b, same", [
    ("Ｐｏｒｔ　Mîra", "Port Mîra", True), ("Рort", "Port", True), ("ＴОМ", "TOM", True), ("Mîra", "Mîra", True), ("楢​淵洞　", "楢淵洞", True), ("⽊村", "木村", True), ("上鮎ロ炭坑", "上鮎口炭坑", True), ("ダ口ッサ", "ダロッサ", True), ("ｶﾞｰﾃﾞﾝ", "ガーデン", True), ("渚\U000e0101町", "渚町", True), ("Pօrt", "Port", True), ("ᎪᏴ", "AB", True), ("ⲟⲣ", "op", True), ("Սոսե", "Սոսե", True), ("a‐b", "a-b", True),
    ("PORT", "Port", False), ("Mira", "Mîra", False), ("竜", "龍", False), ("Post", "Port", False), ("a  b", "a b", False),
])
def test_looks(a, b, same):
    assert (lookalike.consistent(a) == lookalike.consistent(b)) is same
    assert lookalike.consistent(lookalike.consistent(a)) == lookalike.consistent(a)


def test_looks_of_tables(spark):
    masters = spark.createDataFrame([(1, "port", "Port"), (2, "рort", "Port"), (3, "x", "Рort"), (4, None, None), (5, "y", "Port"), (6, "", " ")], "master_id long, normalized_name string, display_name string")
    mentions = spark.createDataFrame([(1, 1, "Рort", 0), (2, 1, "Port", 0), (3, 9, "Рort", 0), (4, None, "Рort", 0), (5, 1, None, 0), (1, 1, "Рort", 0), (6, 1, "PORT", 0)], "relation_id long, master_id long, matched_text string, display_name int")
    got = {tuple(r) for r in lookalike.same_look(masters, mentions).collect()}
    assert got == {("place_masters", 1, 2), ("place_masters", 1, 3), ("place_masters", 2, 3), ("place_masters", 3, 5), ("sentence_places", 1, 1)}
    assert lookalike.same_look(masters.where("false"), mentions.where("false")).count() == 0


# --- 4 ------------------------------------------------------------------------------

SOUND = ["Die Größe der Stille überraschte Frau Östling.", "Où donc était passé le bâtiment ?", "第1.2版の楢淵洞案内は彼女が編んだ。", "気温は12.5度、雪が舞いはじめた。", "老画家说：“太晚了。回家吧。”然后离开了村子。", "คุณหมออยู่ที่นั่นมา 3 ปีแล้ว"]
DECOYS = [*SOUND, "A placa dizia NÃO ENTRE, perto de Caen.", "Вывеска в Caen гласила: «Закрыто».", "Η πινακίδα έγραφε «Κλειστό».", "式は x² ± 3½ ≒ ½、黒板に残っていた。", "駅の札には「ﾏｯﾁ ﾄ ﾀﾊﾞｺ」と半角で刷られた。", "繧繝縁の畳をCapeで見た。", "縺れた糸を解きながら話を聞いた。", "医者は橋で弟を𠮟った。", "Das Schild „Äpfel – 3 € das Pfund“ hing dort.", "Ångström säljer båtar.", "ああ……春よ、と彼は呟いた。", "", "   "]
WRONG = [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("cp932", "latin_1"), ("cp932", "cp1251"), ("euc_jp", "latin_1"), ("gb18030", "latin_1"), ("utf_8", "gb18030"), ("cp874", "latin_1")]


@pytest.mark.parametrize("text", DECOYS)
def test_sound_text_is_left_alone(text):
    assert mojibake.examine(text) == (False, None)


@pytest.mark.parametrize("right, wrong", WRONG)
def test_round_trip_of_wrong_encodings(right, wrong):
    damaged = restored = 0
    for text in SOUND:
        try:
            bad = text.encode(right).decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if bad != text:
            damaged += 1
            found, back = mojibake.examine(bad)
            assert found, bad
            restored += back == text
    assert damaged and restored >= 0.6 * damaged


def test_difference_equals_costs():
    random.seed(8)
    letters = "aB é”ｶﾞｰ漢かア\u0e33\u0e01Θ§ "
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(1, 25)))
        a = random.randint(0, len(text))
        b = random.randint(a, len(text))
        part = "".join(random.choices(letters, k=random.randint(0, 8)))
        low, high = mojibake._surroundings(text, a, b)
        apart = mojibake.cost(text[low:a] + part + text[b:high]) - mojibake.cost(text[low:high])
        assert abs(apart - (mojibake.cost(text[:a] + part + text[b:]) - mojibake.cost(text))) < 1e-6
        assert sum(map(mojibake._bits.__getitem__, text)) <= mojibake.cost(text)


def test_many_damaged_stretches_are_all_restored():
    words = "Größe für überall Äußerung möglich schön Brücke Köln Müller Straße können früher Mädchen Vögel Tür".split()
    for n in (5, 16, 40, 120):
        sound = " 橋の上で ".join(words[i % len(words)] for i in range(n))
        bad = " 橋の上で ".join(words[i % len(words)].encode().decode("cp1252", "replace") for i in range(n))
        if "\ufffd" not in bad:
            assert mojibake.examine(bad) == (True, sound)


def test_damage_after_many_accented_words_is_found():
    sound = "Où était-il passé, élève à l’été, déjà là, prêt à fêter Noël, même âgé, très gêné, côté forêt, près du château, frère aîné, où l’âme rêvait. " * 3
    found, back = mojibake.examine(sound + "楢淵洞案内は彼女が編んだ。".encode("cp932").decode("cp1251", "replace"))
    assert found and mojibake.examine(sound) == (False, None)


def test_damage_that_stays():
    assert mojibake.examine("大ノ亀漕��の坂") == (True, None)
    assert mojibake.examine("$B8EK\\20$N<g?M$O?(B")[0] and mojibake.examine("GrÃƒÂ¶Ãƒe im Tal")[0]


def test_damage_in_tables(spark):
    rows = spark.createDataFrame([(1, "GrÃ¶ÃŸe im Tal", 0), (1, "GrÃ¶ÃŸe im Tal", 0), (2, None, 0), (3, "", 0), (None, "Ã¶Ã¤Ã¼", 0)], "sentence_id long, sentence_text string, source_id int")
    got = mojibake.find_damaged(rows, "sentences", "sentence_id", "sentence_text").collect()
    assert [(r.source_id, r.restored) for r in got] == [(1, "Größe im Tal")] * 2
    assert mojibake.find_damaged(rows.where("false"), "s", "sentence_id", "sentence_text").count() == 0


# --- 5 ------------------------------------------------------------------------------


def same(spark, rows):
    data = [(i, n, k, b, d, a) for i, (n, k, b, d, a) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "author_id long, author_name string, author_name_kana string, birth_year int, death_year int, alias_info string").withColumn("id", F.lit(0)).withColumn("kind", F.lit("x"))
    return {tuple(r) for r in names.same_names(df).collect()}


def test_names(spark):
    got = same(spark, [
        ("Edward Petreguck", None, 1899, 1932, None), ("Edward “Ned” Petreguck", None, None, None, None), ("PETREGUCK, Edward", None, 1899, None, None), ("E. Petreguck", None, None, None, None), ("Edwrad Petreguck", None, None, 1932, None),
        ("Augusta Petreguck", None, 1901, 1970, None), ("Edward Petregick-Brown", None, 1950, None, None),
        ("緑琴 梅露", "みどりこと うめつゆ", 1895, 1920, None), ("梅露　緑琴", None, None, None, None), ("Midorikoto Umetsuyu", None, None, 1920, None), ("梅露緑山人", None, None, None, "緑琴 梅露"), ("みどりこと うめつゆ", None, None, None, None),
        ("緑琴 梅霧", "みどりこと うめきり", 1930, 1999, None),
        ("Bonidill Literary Society", None, None, None, None), ("The Bonidill Lit. Soc.", None, None, None, None), ("Bonidull Literary Club", None, None, None, None),
        ("渚松梅国文学研究所", None, None, None, None), ("渚松梅國文研", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None), ("  ", None, None, None, None),
    ])
    person, poet = {1, 2, 3, 4, 5}, {8, 9, 10, 11, 12}
    pairs = lambda s: {(a, b) for a in s for b in s if a < b}
    assert pairs(person - {4}) <= got and pairs(poet) <= got and {(14, 15), (17, 18)} <= got
    assert not {p for p in got if (p[0] in person) != (p[1] in person) or 6 in p or 13 in p or 16 in p or p[1] > 18 or p == (1, 7)}


@pytest.mark.parametrize("key", ["johannes", "edward", "abc", "山川田中", "abcdefghi"])
def test_exchange_at_every_position_is_a_candidate(spark, key):
    swapped = {key[:i] + key[i + 1] + key[i] + key[i + 2 :] for i in range(len(key) - 1)} - {key}
    keyed = spark.createDataFrame([("K", x, x) for x in sorted(swapped | {key})], "kind string, key string, whole string")
    got = {(r.key_a, r.key_b) for r in names.candidate_pairs(keyed).collect()}
    assert {(min(key, x), max(key, x)) for x in swapped} <= got


def test_exchange_across_the_border_links_names(spark):
    got = same(spark, [("Benedikt Petreguck", None, 1899, None, None), ("Bendeikt Petreguck", None, 1899, None, None), ("梅川 緑琴", None, 1890, None, None), ("梅緑 川琴", None, 1890, None, None)])
    assert got == {(1, 2), (3, 4)}


def test_long_chains_are_one_group(spark):
    random.seed(4)
    ids = random.sample(range(1000), 60)
    chain = [*zip(ids, ids[1:]), (2001, 2000), (3000, 3001), (3001, 3002)]
    got = {r.id: r.group for r in names._components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | dict.fromkeys((2000, 2001), 2000) | dict.fromkeys((3000, 3001, 3002), 3000)


@pytest.mark.parametrize("share", [1, 7, 1_000_000])
def test_groups_are_the_same_however_many_links_a_task_takes(spark, monkeypatch, share):
    monkeypatch.setattr(names, "LINKS_A_TASK", share)
    random.seed(5)
    ids = random.sample(range(1000), 40)
    links = [*zip(ids, ids[1:]), *((random.randrange(2000, 2020), random.randrange(2000, 2020)) for _ in range(12)), (5, 5)]
    group = {i: i for link in links for i in link}
    while (lower := {i: min([g, *(group[b] for a, b in links if a == i), *(group[a] for a, b in links if b == i)]) for i, g in group.items()}) != group:
        group = lower
    found = [tuple(r) for r in names._components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == sorted(group.items())
    assert names._components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_plans_of_names_stay_small(spark, monkeypatch):
    joins = []
    cut = names.cut_lineage

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(names, "cut_lineage", counted)
    got = same(spark, [("Edward Petreguck", None, 1899, None, None), ("Edwrad Petreguck", None, 1899, None, None), ("E. Petreguck", None, None, None, None), ("緑琴 梅露", None, 1895, 1920, None), ("梅露　緑琴", None, None, None, None)])
    assert got == {(1, 2), (1, 3), (2, 3), (4, 5)}
    # The driver plans and keeps every join, on however few rows: a doubled plan shows here, not in the result.
    assert max(joins) <= 2 and sum(joins) <= 6


@pytest.mark.parametrize("name, core", [("渚松国文学究所", "渚松"), ("渚松梅川国文学研究処", "渚松梅川"), ("浜文芸協会", "浜"), ("渚松梅国文学研究所", "渚松梅")])
def test_organisations_of_any_length(name, core):
    found = names.parse(name, "", "")
    assert (found["kind"], found["core"]) == ("org", core)


def test_names_empty(spark):
    assert same(spark, []) == set()


def test_banded_distance():
    assert [names.edits_at_most(a, b, 1) for a, b in (("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("", "a"), ("", ""))] == [1, 1, 2, 1, 0]


# --- 8 ------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_tokens_equal_public_encoder(spark):
    import tiktoken

    ranks = bpe.load_ranks(VOCABULARY)
    public = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    bits = ["a", "the ", "  ", "\n", "ー", "日本", "é", "🗾", "1", "12345", "'s", "'ll", "ing", "　", "ñ", "x" * 40, "<|endoftext|>", "กา", "한국", "\x00"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


# --- 9 ------------------------------------------------------------------------------


def brute(docs, items):
    found = set()
    for d, text in docs:
        for i, item in items:
            x, y = leakage.bare(text), leakage.bare(item)
            need = (len(y) + 1) // 2
            if y and any(y[a : a + need] in x for a in range(len(y) - need + 1)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("shard", [40, 200, 1_000_000])
def test_leaks_equal_brute_force(spark, shard):
    random.seed(shard)
    word = lambda n: "".join(random.choices("abあい", k=n))
    items = [(i, word(random.randint(1, 30))) for i in range(12)] + [(50, ""), (51, None), (52, "!!")]
    docs = [(0, None), (1, ""), (2, "。。")]
    for d in range(3, 60):
        text = word(random.randint(0, 80))
        if random.random() < 0.6:
            item = random.choice(items[:12])[1]
            a = random.randint(0, len(item) // 2)
            text = text[:10] + item[a : a + random.randint(1, len(item))].upper() + text[10:]
        docs.append((d, "、".join(text) if d % 3 else text.replace("あ", "あ《よみ》")))
    docs += [(100, docs[-1][1]), (101, docs[-1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    found = leakage.leaked_passages(frame, spark.createDataFrame(items, "item_id long, item_text string"), shard)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)


def test_readings_tags_and_comments_of_any_length_are_bridged(spark):
    item = "船は楢淵洞を出て新貝浦へ向かった"
    between = ["《" + "よ" * 61 + "》", "<span title='" + "x" * 500 + "'>", "<!-- a\nb -- c\n -->", "［＃" + "注" * 300 + "］"]
    docs = spark.createDataFrame([(i, "前" + item[:6] + b + item[6:11] + "後") for i, b in enumerate(between)], "doc_id long, text string")
    assert {r.doc_id for r in leakage.leaked_passages(docs, spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()} == set(range(len(between)))
    assert leakage.bare("<!-- open only") == "openonly"


def test_items_in_several_groups_and_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 3)
    monkeypatch.setattr(leakage, "CHARS_PER_PASS", 40)
    monkeypatch.setattr(leakage, "CELLS", 7)
    test_leaks_equal_brute_force(spark, 200)


def test_leaks_empty_and_merged(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert leakage.leaked_passages(docs, items).count() == 0
    spans = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 3, 9), (1, 3, 9, 10), (1, 4, 20, 25), (2, 1, 1, 2), (2, 1, 1, 2)], "doc_id long, item_id long, bare_start long, bare_end long")
    assert sorted(map(tuple, leakage.merge_spans(spans).collect())) == [(1, 0, 10), (1, 20, 25), (2, 1, 2)]


def test_fm_index_counts_and_locates():
    import numpy as np

    random.seed(9)
    text = [random.randint(1, 5) for _ in range(3000)]
    index = leakage.FMIndex(np.array([*text, 0]))
    for phrase in ([1], [2, 3], [5, 5, 5], text[100:112], text[-3:], [1, 2, 3, 4, 5, 1, 2]):
        low, high = index.search([np.array(phrase)])
        places_ = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
        assert places_ == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


# --- 10 -----------------------------------------------------------------------------

CASES = ["{{title}} by {{author}} was first printed in {{year}}.", "本当の文。\n作品名：${work_title}\n", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "雪が舞いはじめた。\n404 Not Found\nThe requested URL /cards/7/ was not found on this server.", "準備中です。後日公開予定です。", "You need to enable JavaScript to run this app.", "本文が入ります本文が入ります本文が入ります", "Loading...\n자바스크립트를 활성화해 주세요.", "Text to follow. Text to follow."]
NO_CASES = ["Her essay asks why printers in Caen set lorem ipsum and not a poem.", "活字の{{と}}は印刷所では中括弧と呼ばれた。", "Room 404 of the hotel had no number on its door.", "伏字は多く、××の夜に○○へ行つた、とだけ読める。", "彼の随筆には、JavaScriptを使わずに地図を描いた苦労話がある。", "劇場は準備中の札を下げたままだった。", "The guide explains that a letter began with {{name}} and ended with a seal.", "船頭は弟を※［＃二の字点、1-2-22］叱った。", "", None, " \n"]


def test_residue(spark):
    texts = [*CASES, *NO_CASES]
    filler = [f"彼女は橋の上で{i}冊の詩集を拾い上げた。" for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *filler])], "doc_id long, text string, label string")
    assert {r.doc_id for r in residue.residue_windows(df).select("doc_id").distinct().collect()} == set(range(len(CASES)))
    assert residue.residue_windows(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, "彼女は来た。" * 20_000 + "\nComing soon. Coming soon.")], "doc_id long, text string")
    assert residue.residue_windows(long).select("doc_id").distinct().count() == 1


INSIDE = ["彼は{{name}}と言った。", "In {{year}} she moved to Kyoto.", "The ferry to [PLACE_NAME] left at noon.", "彼女は橋の上でお探しのページは移動または削除された可能性があります", "船は沖へこのページを表示するにはJavaScriptを有効にしてください。", "Then she opened the 404 Not Found", "The lamp went out and Please turn on JavaScript in your browser and reload the page."]
NOT_INSIDE = ["A letter template has {{name}} where the name belongs.", "雛形では${title}の所に題が入る。", "He wrote [SIC] after the word, and <BR> too.", "The page said “404 Not Found” in red.", "画面には「お探しのページは移動または削除された可能性があります」と表示された。"]


def test_residue_inside_other_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*INSIDE, *NOT_INSIDE])], "doc_id long, text string")
    assert {r.doc_id for r in residue.residue_windows(df).select("doc_id").distinct().collect()} == set(range(len(INSIDE)))


# Wordings of residue (19 of the 52 are exemplars as they stand), and ordinary sentences with the same words.
OTHER_WORDING = """
Page not found
Enable JavaScript to continue.
This site requires JavaScript
401 Unauthorized
ただいまメンテナンス中です。
Quisque sit amet velit vel nisi.
[Your Name Here]
${user.first name}
Seite nicht gefunden
Page introuvable
页面未找到
Sorry, the page you are looking for could not be found.
Oops! Something went wrong.
This website is temporarily down for scheduled maintenance.
Please sign in to view this page.
JavaScript must be enabled to view this site.
You do not have permission to access this page.
Error establishing a database connection
Your session has expired. Please log in again.
Insert your text here
Dear [First Name],
Hello <CUSTOMER_NAME>!
ご指定のページは存在しません。
サーバーエラーが発生しました。時間をおいて再度アクセスしてください。
この記事を閲覧するには会員登録が必要です。
JavaScriptが無効になっています。
工事中です。しばらくお待ちください。
ここに見出しを入力してください。
Diese Seite befindet sich im Aufbau.
Bitte melden Sie sich an, um fortzufahren.
Cette page est en construction.
Veuillez vous connecter pour continuer.
Une erreur est survenue. Veuillez réessayer plus tard.
网站正在建设中
请先登录后再查看。
服务器内部错误
요청하신 페이지가 존재하지 않습니다.
서버 점검 중입니다.
자바스크립트를 사용하도록 설정해 주세요.
여기에 제목을 입력하세요
Mauris vitae ultricies leo integer malesuada nunc.
Uncaught TypeError: Cannot read properties of undefined
Access to this resource is forbidden.
Please verify you are human
Content to be added later.
This section is currently being written.
Fehler 500: Interner Serverfehler
{{ customer.name }} 様
%FIRST_NAME%, welcome back!
Subscribe to continue reading.
HTTP Error 503. The service is unavailable.
本文はただいま作成中です。
""".strip().splitlines()
ORDINARY = """
The page was torn and could not be read.
She asked him to sign in the book and continue.
The bridge is under construction, he wrote.
He did not find the page in the manuscript.
An internal error of judgement, said Mrs. Oakmere, cost Port Feskutrel its library.
The site of the museum needs JavaScript for its map, but the poem below does not.
The server brought the soup and was soon gone.
Access to the harbour was denied to strangers.
劇場は準備中の札を下げたままだった。
彼は手紙を書くのに失敗しました。
会員の登録が必要だと老人は思った。
ページをめくる音がした。
Le service était indisponible ce jour-là et le facteur rentra.
Die Seite war zerrissen und nicht mehr zu lesen.
他在页面上写了一个字。
그는 문을 찾을 수 없었다.
[sic] he wrote. See note [3] and [Fig. 2].
x < y and y > z, {a, b}
In 404 the town was not found on any map.
The year 500 saw an error in the calendar.
Try again later, he said, and closed the door.
They met again later in the maintenance yard of the railway.
""".strip().splitlines()


def test_residue_in_other_wording():
    index = residue.ResidueIndex()
    found = lambda text: any(index.match(p, q) for p, q in residue.passages(text))
    assert [t for t in OTHER_WORDING if not found(t)] == [] and [t for t in ORDINARY if found(t)] == []
    assert [t for t in OTHER_WORDING if not found("彼女は橋の上にいた。\n" + t + "\nIt rained.")] == []


def test_posted_terms_miss_no_exemplar():
    """Retrieval by the rarer terms equals comparison with every exemplar."""
    index = residue.ResidueIndex()
    for text in [*OTHER_WORDING, *ORDINARY, *CASES, *INSIDE]:
        for passage, _ in residue.passages(text):
            held = residue.term_set(passage)
            assert held == set(residue.terms(passage))
            assert sorted(index.retrieve(held)) == [k for k, e in enumerate(index.exemplars) if len(held & set(e)) >= index.most(e)]


# --- queries ------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")
@pytest.mark.parametrize("name, columns", [
    ("p1_found", ["sentence_id", "char_start", "char_end"]), ("p2_found", ["source_table", "source_id", "master_id"]), ("p3_found", ["source_table", "left_id", "right_id"]), ("p4_found", ["source_table", "source_id"]),
    ("p5_found", ["author_id_a", "author_id_b"]), ("p8_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id"]),
])
def test_query_columns_and_distinct_rows(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    rows = [str(r) for r in df.collect()]
    assert df.columns == columns and len(rows) == len(set(rows))
