"""Fixed values of the rules: word lists, patterns, gazetteers. Data only."""

from __future__ import annotations

# Sections of the author index, by the position of their list.
INDEX_SECTIONS = "ア カ サ タ ナ ハ マ ヤ ラ ワ その他".split()

# Patterns whose hits in a context speak for a place.
PLACE_CONTEXT = "[へに]行 [をに]出 [に]住 [を]通 [から]来 [に]着 [を]訪 [に]向 [で]生 [を]発 街 町 村 里 国 県 市 区 滞在 旅行 参拝 見物 観光 散歩 出身 在住 移住 引越 帰郷 故郷 景色 風景 名所 遺跡 寺 神社 駅 港 橋 川 山 海 湖 から.*まで を経由 経由して 通過 立ち寄".split()
# Patterns whose hits speak for a person.
PERSON_CONTEXT = "さん$ 君$ 氏$ 先生$ 様$ 殿$ は話 が言 と会 に聞 と話 を呼 の顔 の性格 の家族 の人 という人 名前 名前は という名 呼ばれ 呼んで 機嫌 怒 笑 泣 悲し 喜 憤 は.*打つ は.*叩 は.*殴 は.*怒鳴 は.*言った は.*思った は.*感じた".split()
# Patterns whose hits speak for the past.
HISTORY_CONTEXT = "国$ 藩$ 城$ 宿場 街道 古く 昔 江戸時代 平安 鎌倉 時代 当時 昔の 古い 歴史".split()

# Places that are also names, with the likelihood of a person where known.
AMBIGUOUS_PERSON = {"柏": 0.8, "清水": 0.7, "青山": 0.6}
# Persons.
PERSON_NAMES = (
    "松村 松村任三 牧野 牧野富太郎 湯川 湯川秀樹 朝比奈 朝比奈泰彦 木村 木村陽二郎 原 原寛 服部 服部広太郎 中井 中井猛之進 小泉 小泉源一 "
    "夏目 夏目漱石 芥川 芥川龍之介 太宰 太宰治 川端 川端康成 三島 三島由紀夫 谷崎 谷崎潤一郎 "
    "田中 佐藤 鈴木 高橋 渡辺 伊藤 山田 中村 小林 加藤 吉田 山本 佐々木 山口 松本 井上 林 清水 山崎 池田"
).split()
# Learned and technical words (engine A).
ACADEMIC_A = (
    "語原 語源 学名 分類 標本 観察 記録 図鑑 植物 花 葉 茎 根 種子 果実 樹木 草本 苔類 菌類 藻類 細胞 組織 "
    "研究 論文 学会 発表 実験 調査 分析 結果 考察 結論 仮説 理論 法則 原理 "
    "沢山 大分 随分 大抵 大概 大体 最早 漸く 愈々 段々 次第 次第に 遂に 到頭 矢張 矢張り 如何 如何にも 何故 何処"
).split()
# Learned and technical words (engine B).
ACADEMIC_B = (
    "語原 語源 学名 分類 標本 観察 記録 図鑑 植物 花 葉 茎 根 種子 果実 開花 結実 発芽 生育 分布 生息 自生 "
    "研究 調査 実験 観測 分析 考察 論文 報告 発表 講演 会議 学会 協会 団体 病原 症状 治療 診断 医学 薬学 牧羊神 多分神 "
    "理論 概念 思想 哲学 主義 方法 技術 進退維谷 最上"
).split()
# Common nouns (engine B).
COMMON_NOUNS = (
    "今日 昨日 明日 今朝 夕方 深夜 早朝 沢山 大勢 少数 多数 全部 一部 半分 時間 時期 期間 瞬間 永久 一時 移動 到着 出発 帰宅 外出 散歩 旅行 行動 動作 作業 活動 運動 労働 "
    "美容院 理髪店 病院 学校 図書館 郵便局 銀行 会社 工場 店舗 商店 市場 山野 田野 野原 草原 荒野 平野 水辺 川辺 海辺 岸辺 湖畔 池畔 森林 竹林 松林 雑木林 "
    "問題 課題 困難 障害 原因 結果 影響 目的 手段 方法 方式 方向 状況 状態 性質 特徴 性格 個性 人格 品格 気持 感情 心情 気分 心境 感覚 印象 感想 意見 考え 思考 判断 "
    "程度 具合 調子 様子 様相 模様 最上 最高 最低 最大 最小 最多"
).split()
# Texts that are no place names.
INVALID_NAMES = [r"^[あ-ん]{1,2}$", r"^[ア-ン]{1,2}$", r"^[0-9]+$", r"^[ぁ-ん]*$", r"^(今日|昨日|明日|一昨日|明後日)$", r"^(朝|昼|夕方|夜|深夜|早朝)$", r"^(春|夏|秋|冬|正月|盆)$", r"^(こちら|そちら|あちら|どちら)$", r"^(ここ|そこ|あそこ|どこ)$"]
# Texts that are no candidates, and stop words among candidates.
INVALID_CANDIDATES = [r"^[0-9]+$", r"^[ぁ-ん]+$", r"^[一二三四五六七八九十]+$", r"^[、。！？]+$"]
CANDIDATE_STOP_WORDS = "こと もの とき ところ あの その この 私 僕 君 彼 彼女 先生 様 さん 今日 明日 昨日 今 後 前 時".split()
# Shapes of place candidates.
CANDIDATE_PATTERNS = [r"[東西南北]?[都道府県市区町村郡]", r".*[山川島湖港駅]$", r".*[神社寺院]$", r".*[大学高校]$", r"[0-9]*[丁目番地号]"]

# Gazetteer rows "name lat lon location confidence", in order.
CITIES = """
本郷 35.7081 139.7619 東京都文京区 0.95
神田 35.6918 139.7648 東京都千代田区 0.95
青山 35.6736 139.7263 東京都港区 0.95
麻布 35.6581 139.7414 東京都港区 0.95
両国 35.6967 139.7933 東京都墨田区 0.95
赤坂 35.6745 139.7378 東京都港区 0.95
日本橋 35.6813 139.7744 東京都中央区 0.95
築地 35.6654 139.7707 東京都中央区 0.95
新橋 35.6665 139.7580 東京都港区 0.95
上野 35.7136 139.7772 東京都台東区 0.95
伏見 34.9393 135.7578 京都府京都市伏見区 0.98
嵐山 35.0088 135.6761 京都府京都市右京区 0.98
清水 34.9948 135.7849 京都府京都市東山区 0.92
祇園 35.0037 135.7744 京都府京都市東山区 0.98
宇治 34.8842 135.7991 京都府宇治市 0.95
難波 34.6659 135.5020 大阪府大阪市浪速区 0.92
梅田 34.7010 135.4962 大阪府大阪市北区 0.92
心斎橋 34.6723 135.5002 大阪府大阪市中央区 0.92
横浜 35.4478 139.6425 神奈川県横浜市 0.95
鎌倉 35.3197 139.5468 神奈川県鎌倉市 0.95
箱根 35.2322 139.1069 神奈川県足柄下郡箱根町 0.95
鹿児島 31.5966 130.5571 鹿児島県鹿児島市 0.95
日光 36.7581 139.6014 栃木県日光市 0.93
小樽 43.1907 140.9947 北海道小樽市 0.95
函館 41.7687 140.7291 北海道函館市 0.95
札幌 43.0642 141.3469 北海道札幌市 0.95
"""
HISTORICAL = """
江戸 35.6762 139.6503 東京都 0.85
平安京 35.0116 135.7681 京都府 0.85
伊勢 34.4900 136.7056 三重県伊勢市 0.85
大和 34.6851 135.8325 奈良県 0.85
美濃 35.3912 136.7223 岐阜県 0.85
尾張 35.1802 136.9066 愛知県西部 0.85
薩摩 31.5966 130.5571 鹿児島県 0.85
伊豆 34.9756 138.9462 静岡県伊豆半島 0.85
甲斐 35.6635 138.5681 山梨県 0.85
信濃 36.2048 137.9677 長野県 0.85
越後 37.9026 139.0235 新潟県 0.85
近江 35.0045 135.8686 滋賀県 0.85
"""
PREFECTURES = """
北海道 43.0642 141.3469
青森県 40.8244 140.7400
岩手県 39.7036 141.1527
宮城県 38.2682 140.8721
秋田県 39.7186 140.1024
山形県 38.2404 140.3633
福島県 37.7503 140.4677
茨城県 36.3417 140.4468
栃木県 36.5657 139.8836
群馬県 36.3911 139.0608
埼玉県 35.8572 139.6489
千葉県 35.6047 140.1233
東京都 35.6762 139.6503
神奈川県 35.4478 139.6425
新潟県 37.9026 139.0235
富山県 36.6953 137.2113
石川県 36.5945 136.6256
福井県 36.0652 136.2216
山梨県 35.6635 138.5681
長野県 36.2048 137.9677
岐阜県 35.3912 136.7223
静岡県 34.9766 138.3831
愛知県 35.1802 136.9066
三重県 34.7303 136.5086
滋賀県 35.0045 135.8686
京都府 35.0116 135.7681
大阪府 34.6937 135.5023
兵庫県 34.6913 135.1830
奈良県 34.6851 135.8325
和歌山県 34.2261 135.1675
鳥取県 35.5038 134.2381
島根県 35.4722 133.0505
岡山県 34.6617 133.9345
広島県 34.3966 132.4596
山口県 34.1861 131.4706
徳島県 34.0658 134.5590
香川県 34.3401 134.0434
愛媛県 33.8416 132.7658
高知県 33.5597 133.5311
福岡県 33.6064 130.4181
佐賀県 33.2494 130.2989
長崎県 32.7448 129.8737
熊本県 32.7898 130.7417
大分県 33.2382 131.6126
宮崎県 31.9111 131.4239
鹿児島県 31.5966 130.5571
沖縄県 26.2124 127.6792
"""
PREFECTURE_CONFIDENCE = 0.95
FOREIGN = """
ローマ 41.9028 12.4964 イタリア 0.90
パリ 48.8566 2.3522 フランス 0.90
ロンドン 51.5074 -0.1278 イギリス 0.90
ベルリン 52.5200 13.4050 ドイツ 0.90
ニューヨーク 40.7128 -74.0060 アメリカ 0.90
上海 31.2304 121.4737 中国 0.90
ペキン 39.9042 116.4074 中国 0.90
北京 39.9042 116.4074 中国 0.90
モスクワ 55.7558 37.6176 ロシア 0.90
ウィーン 48.2082 16.3738 オーストリア 0.90
"""

# Genre keywords, in the order of the two ladders (default 小説).
GENRES_A = [("詩", "詩 歌 俳句 短歌 うた"), ("戯曲", "戯曲 脚本 劇 一幕"), ("評論", "論 評 批評 研究 考察 序文 解説"), ("随筆", "随筆 日記 記 雑記 感想 印象")]
GENRES_B = [("小説", "物語 記 日記 記録"), ("随筆", "随筆 雑感 感想 思い出"), ("詩", "詩 詩集 歌"), ("戯曲", "戯曲 劇 台本"), ("評論", "評論 論 批評 解説")]
# Western years, then eras with the year before their first, then contexts; in order.
YEAR_PATTERNS = [r"(\d{4})年", r"(\d{4})（.*?）年", r"「.*?」(\d{4})年", r"『.*?』(\d{4})年", r"(\d{4})・\d+・\d+", r"(\d{4})/\d+/\d+", r"(\d{4})-\d+-\d+", r"(\d{4})年\d+月", r"(\d{4})．\d+．\d+", r"明治(\d+)・大正・昭和", r"(\d{4})ころ", r"(\d{4})頃", r"(\d{4})前後"]
ERA_PATTERNS = [(r"明治(\d+)年", 1867), (r"大正(\d+)年", 1911), (r"昭和(\d+)年", 1925), (r"明治(\d+)", 1867), (r"大正(\d+)", 1911), (r"昭和(\d+)", 1925)]
YEAR_CONTEXTS = [r"戦前.*?(\d{4})", r"戦後.*?(\d{4})", r"明治時代.*?(\d{4})", r"大正時代.*?(\d{4})", r"昭和時代.*?(\d{4})"]
# Spans of life, then single births and deaths; in order.
LIFE_SPANS = [r"(\d{4})年.*?〈.*?〉.*?-\s*(\d{4})年", r"(\d{4})年.*?月.*?日.*?-\s*(\d{4})年.*?月.*?日", r"（(\d{4})年.*?-.*?(\d{4})年.*?）", r"、(\d{4})年.*?-.*?(\d{4})年", r"(\d{4})年.*?-.*?(\d{4})年"]
BIRTHS = [r"(\d{4})年\d+月\d+日〈", r"（(\d{4})年.*?月.*?日.*?-", r"、(\d{4})年.*?月.*?日"]
DEATHS = [r"-\s*(\d{4})年〈.*?〉.*?月.*?日", r"-.*?(\d{4})年.*?月.*?日"]
# Words of writers, words that prefer and that rule out an option.
LITERARY = "作家 小説家 詩人 文学者 歌人 俳人 小説 詩 文学 作品 著作 執筆 明治文学 大正文学 昭和文学 近代文学 青空文庫 プロレタリア文学 自然主義".split()
PREFERRED = "作家 小説家 詩人 文学者 歌人 俳人 明治 大正 昭和 文学 小説 詩".split()
AVOIDED = "植物学者 博士 学者 研究者 教授 医師 政治家 実業家 軍人 官僚 現代 平成".split()
# Readings and categories.
READINGS = {"夏目 漱石": "なつめ そうせき", "芥川 竜之介": "あくたがわ りゅうのすけ", "太宰 治": "だざい おさむ", "川端 康成": "かわばた やすなり", "三島 由紀夫": "みしま ゆきお", "森 鴎外": "もり おうがい", "樋口 一葉": "ひぐち いちよう", "宮沢 賢治": "みやざわ けんじ", "谷崎 潤一郎": "たにざき じゅんいちろう", "志賀 直哉": "しが なおや"}
CATEGORIES = {"完全地名": "市区町村", "都道府県": "都道府県", "市区町村": "市区町村", "有名地名": "有名地名", "自然地名": "有名地名", "歴史地名": "歴史地名", "nlp_entity": "有名地名"}
# Shapes that a valid place name begins with.
PLACE_SHAPES = [("prefecture", r"^.+?[都道府県]"), ("city", r"^.+?[市区町村]"), ("district", r"^.+?郡"), ("station", r"^.+?駅"), ("landmark", r"^.+?[山|川|湖|海|公園|寺|神社]")]


# Places of the simple geocoder.
SIMPLE_PLACES = """
本郷 35.7081 139.7619 東京都文京区 0.95
神田 35.6918 139.7648 東京都千代田区 0.95
青山 35.6736 139.7263 東京都港区 0.95
麻布 35.6581 139.7414 東京都港区 0.95
両国 35.6967 139.7933 東京都墨田区 0.95
赤坂 35.6745 139.7378 東京都港区 0.95
日本橋 35.6813 139.7744 東京都中央区 0.95
築地 35.6654 139.7707 東京都中央区 0.95
新橋 35.6665 139.7580 東京都港区 0.95
上野 35.7136 139.7772 東京都台東区 0.95
銀座 35.6762 139.7649 東京都中央区 0.95
新宿 35.6896 139.7006 東京都新宿区 0.95
渋谷 35.6598 139.7006 東京都渋谷区 0.95
浅草 35.7148 139.7967 東京都台東区 0.95
品川 35.6284 139.7387 東京都港区 0.95
池袋 35.7298 139.7101 東京都豊島区 0.95
伏見 34.9393 135.7578 京都府京都市伏見区 0.98
嵐山 35.0088 135.6761 京都府京都市右京区 0.98
清水 34.9948 135.7849 京都府京都市東山区 0.92
祇園 35.0037 135.7744 京都府京都市東山区 0.98
宇治 34.8842 135.7991 京都府宇治市 0.95
京都 35.0116 135.7681 京都府京都市 0.95
難波 34.6659 135.5020 大阪府大阪市浪速区 0.92
梅田 34.7010 135.4962 大阪府大阪市北区 0.92
心斎橋 34.6723 135.5002 大阪府大阪市中央区 0.92
大阪 34.6937 135.5023 大阪府大阪市 0.95
横浜 35.4478 139.6425 神奈川県横浜市 0.95
鎌倉 35.3197 139.5468 神奈川県鎌倉市 0.95
箱根 35.2322 139.1069 神奈川県足柄下郡箱根町 0.95
川崎 35.5309 139.7029 神奈川県川崎市 0.95
千葉 35.6074 140.1065 千葉県千葉市 0.95
埼玉 35.8617 139.6455 埼玉県さいたま市 0.95
名古屋 35.1815 136.9066 愛知県名古屋市 0.95
金沢 36.5945 136.6256 石川県金沢市 0.95
富山 36.6953 137.2113 富山県富山市 0.95
新潟 37.9026 139.0235 新潟県新潟市 0.95
長野 36.6485 138.1950 長野県長野市 0.95
小樽 43.1907 140.9947 北海道小樽市 0.95
函館 41.7687 140.7291 北海道函館市 0.95
札幌 43.0642 141.3469 北海道札幌市 0.95
最上 38.7583 140.1761 山形県最上郡 0.90
福岡 33.5904 130.4017 福岡県福岡市 0.95
鹿児島 31.5966 130.5571 鹿児島県鹿児島市 0.95
長崎 32.7448 129.8737 長崎県長崎市 0.95
江戸 35.6762 139.6503 東京都 0.85
平安京 35.0116 135.7681 京都府 0.85
大和 34.6851 135.8325 奈良県 0.85
伊勢 34.4900 136.7056 三重県伊勢市 0.85
甲斐 35.6635 138.5681 山梨県 0.85
信濃 36.2048 137.9677 長野県 0.85
"""
# What is added to an author's name to look a page up, in order of preference.
LOOKUP_WORDS = ["", " 作家", " 小説家", " 文学者", " 詩人", " 明治", " 大正", " 昭和"]


def rows(table: str) -> list[tuple[str, float, float, str, float]]:
    """Rows (name, lat, lon, location, confidence) of a gazetteer text."""
    out = []
    for line in filter(None, map(str.strip, table.splitlines())):
        name, lat, lon, *rest = line.split()
        location, confidence = rest if rest else (name, PREFECTURE_CONFIDENCE)
        out.append((name, float(lat), float(lon), location, float(confidence)))
    return out
