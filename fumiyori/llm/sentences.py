"""Sentence boundaries across languages and scripts (problem 1).

Spaceless scripts (Japanese, Chinese, Thai): a lattice of dictionary words is laid over the
text around every gap and its cheapest path read; the gap is classified by the word that
ends before it (final particles and forms) and the word that opens after it. A Japanese full
stop outside marks ends its sentence unless a particle of quotation follows. Spaced scripts:
a lattice of terminators; every end mark, with the closing marks after it, is one node that
is judged by its word (abbreviation, ordinal, initial, ellipsis) and by what follows.

Text within a pair of quotation marks or brackets is never divided. A quotation that its
sentence runs on from belongs to it; one that stands alone is a sentence.

Defined results: null, empty and blank texts have no sentences; a text with a wrong encoding
is one sentence; an unpaired mark pairs with nothing; offsets count code points and exclude
outer white space; concatenated sentences differ from the text by white space only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyori.llm.frames import frame
from fumiyori.llm.mojibake import examine
from fumiyori.operators.relations import BLOCK, block_ranks
from fumiyori.operators.sizing import spread

PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "［": "］", "[": "]", "〔": "〕", "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’"}
QUOTES = "「『“„«\"‹"
CLOSERS = set("」』）)》〉】］]〕”“»›\"’")
END_MARKS = set("。．！？!?.…‥।॥؟۔。｡")
BLANK = set(" \t\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
BREAKS = set("\n\r\v\f\u0085\u2028\u2029")

# Words of the lattices, by class. "j" particles that lead a sentence on, "o" words that open
# a sentence, "f" forms that end one, "c" words that continue one.
WORDS = {
    "ja": {
        "j": "と って とは とも など という といふ なんて と言 と云 と叫 と聞 と思 が を に の は も で へ や から まで より ので のに けれど ながら さえ ばかり だけ しか ほど くらい では には へと での との として にて とて なら 、 ， ・ ― — ：",
        "o": "ところが ところで とても とにかく とうとう ともかく ともあれ とある となり とき ときに とたん どこ どう どんな だが だから でも では、 しかし そして それ その そこ これ この ここ あの ああ あれ あなた なんと なぜ なお もう もし やがて やはり はい はじめ のち また まだ まあ にわかに がらん えっ え？ おや さて すると ついに つまり さらに ただ たとえば 私 彼 彼女 第 "
        # Words that begin like a particle.
        "がっかり がっくり がやがや がらがら がらり がちゃん がんばれ にわとり にわか にぎやか におい にがい にこにこ にっこり にもかかわらず にやり のんびり のどか のろのろ のっそり のびのび はるか はじめて はたして はっきり はっと はやく はやい はなし はげしい はてな はたけ はあ ははあ "
        "もちろん もっと もっとも もしも もしかすると もしかして もしや もとより もはや もともと もろとも ものすごい もうすぐ もみじ もたもた ですから ですが でしたら でんわ でこぼこ へえ やっと やっぱり やさしい やまびこ やむなく やや やれやれ やあ からす からだ からっぽ よりによって しかも しかるに しかたなく "
        "ほどなく ほどよい ならば ならんで だけど だけれど けれども けれど、 くらやみ さえずり ながらく とつぜん とりわけ とびら となりの とおく とっさ ともだち とびきり とどのつまり とき、 とはいえ とすると とすれば となると",
        "f": "た だ る い う よ ね か な ぞ わ さ ぬ なり けり です ます でした ました だろう でしょう ない たい くれ なさい せよ ろう",
        "c": "ああ おお いや ええ まあ",
    },
    "zh": {
        "j": "， 、 ： ； — 的",
        "o": "我 你 他 她 它 我们 他们 这 那 从 在 但 可是 然后 后来 的确 的士 地图 地方 地上 得知 得到",
        "f": "了 吗 呢 吧 啊 的 呀",
        "c": "说 说道 道 问 喊 喊道 答 答道 回答 叫 叫道 想 写道",
    },
    "th": {
        "j": "ที่ ใน ถึง จาก และ หรือ กับ ของ ให้ ว่า ซึ่ง อยู่ มา ไป แล้ว ปี ปีแล้ว วัน เดือน ตลอด ตลอดทั้งคืน ในตอนเช้า ครั้ง เมตร กิโลเมตร บาท น. พ.ศ. ค.ศ. ๆ",
        "o": "ไม่มีใคร ไม่มี ไม่ คุณ น้อง พี่ ฝน เขา เธอ ฉัน ผม เรา มัน พวก แต่ แล้ว วันนี้ เมื่อ ถ้า นี่ นั่น ที่นี่ ทุก คืน เช้า บ้าน ครู นัก ชาย หญิง เด็ก แม่ พ่อ",
        "f": "รู้จัก ครับ ค่ะ คะ นะ แล้ว เช้า คืน จดหมาย",
        "c": "",
    },
}


class Lexicon:
    """Words by language and class; ``learned`` openers (words that sentences of the corpus begin with) join the listed ones."""

    def __init__(self, learned: Iterable[str] = ()):
        self.words = {lang: {w: c for c in ("f", "c", "o", "j") for w in groups[c].split()} for lang, groups in WORDS.items()}
        self.openers = {lang: set(groups["o"].split()) for lang, groups in WORDS.items()}
        for word in learned:
            for lang in ["th"] if "฀" <= word[0] <= "๿" else ["ja", "zh"]:
                if self.words[lang].get(word) != "j":
                    self.openers[lang].add(word)
                    self.words[lang].setdefault(word, "o")
        #: Characters of the longest word: how far a gap is looked at on each side.
        self.reach = {lang: max(map(len, words)) for lang, words in self.words.items()}
        self._known: dict[tuple[str, str], tuple[tuple[str, str], ...]] = {}

    def lattice(self, text: str, lang: str) -> tuple[tuple[str, str], ...]:
        """Words and classes on the cheapest path; a known word costs little, an unknown character much."""
        if (found := self._known.get((text, lang))) is not None:
            return found
        words, longest = self.words[lang], self.reach[lang]
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(1e9, 0, "")] * len(text)
        for i in range(len(text)):
            cost = best[i][0]
            if cost + 3.0 < best[i + 1][0]:
                best[i + 1] = (cost + 3.0, i, "?")
            for j in range(i + 1, min(len(text), i + longest) + 1):
                kind = words.get(text[i:j])
                if kind and cost + 2.5 - 0.4 * (j - i) < best[j][0]:
                    best[j] = (cost + 2.5 - 0.4 * (j - i), i, kind)
        path, j = [], len(text)
        while j > 0:
            _, i, kind = best[j]
            path.append((text[i:j], kind))
            j = i
        if len(self._known) >= LATTICES:
            self._known.clear()
        return self._known.setdefault((text, lang), tuple(reversed(path)))

    def opens(self, text: str, at: int, lang: str) -> str:
        """The class of the word that begins at ``at``: "j" goes on, "o" opens, "" is the end."""
        rest = text[at : at + self.reach[lang]]
        if not rest:
            return ""
        word, kind = self.lattice(rest, lang)[0]
        openers = self.openers[lang]
        if any(rest[:n] in openers for n in range(len(rest), len(word) if kind == "j" else len(word) - 1, -1)):
            return "o"
        return "j" if kind == "j" else "o"

    def closes(self, text: str, at: int, lang: str) -> str:
        """The word before ``at`` and its class."""
        path = self.lattice(text[max(0, at - self.reach[lang]) : at], lang)
        return path[-1] if path else ("", "")


# Words whose full stop does not end a sentence, whatever follows.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof capt col gen lt sgt rev hon messrs st ste mt pt n s w nth nr no nos vol vols ch chs p pp fig figs cf ed eds vs viz approx c ca ab al cent "
    "jr sr m mm mme mlle mgr me p.ex ex env av apr art z b bzw u d h ü i a str abb bd hr fr hrn frl ing dipl usw geb gest evtl ggf inkl exkl tel "
    "str sta stn hbr cstl hrbr harb ave rd blvd okt nov dez jan feb mär apr jun jul aug sept sep oct dec mon tue wed thu fri sat sun mo di mi do sa so डॉ सं श्री पं "
    "esq co inc ltd corp sq г ул им стр рис т.е".split()
)
#: Abbreviations that may also end a sentence: they do before a capital letter or mark that opens one.
ENDING = frozenset("a.m p.m etc usw b.c a.d u.s u.k".split())
MONTHS = re.compile(r"(?i)(januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jan\b|feb\b|mär\b|apr\b|jun\b|jul\b|aug\b|sept?\b|okt\b|nov\b|dez\b|jahrhundert|jh\b|kapitel|klasse|stock)")
#: What leads a Japanese sentence on after a full stop: a particle of quotation, or a mark that opens nothing.
_QUOTING = re.compile("と|って|、|，|,|・|―|—|：|など")
#: Marks that bound a word.
_EDGES = frozenset("「」『』（）()[]“”„«»\"—–")
#: What a sentence without a word costs; paths of lattices that a worker remembers (speed only).
WORDLESS, LATTICES = 6.0, 100_000
#: A learned opener begins so many rows at least, goes on in so many ways, and is so long; and how many are kept, the most frequent first.
OPENER_ROWS, OPENER_WAYS, OPENER_LENGTHS, OPENERS = 5, 2, (2, 8), 20_000


def _pairs(text: str) -> list[int]:
    """For every position, the position of the mark that closes a pair opened there, or -1."""
    partner = [-1] * len(text)
    stack: list[tuple[str, int]] = []
    # How many open marks each mark would close: what closes none is not sought in the stack.
    awaited: Counter[str] = Counter()
    for i, char in enumerate(text):
        if awaited[char]:
            while True:
                mark, at = stack.pop()
                closers = PAIRS.get(mark) or mark
                awaited.subtract(closers)
                if char in closers:
                    partner[at] = i
                    break
        elif char == '"' or char in PAIRS and char != "‘":
            stack.append((char, i))
            awaited.update(PAIRS.get(char) or char)
    return partner


def _tops(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost pairs, ends exclusive."""
    partner, i, found = _pairs(text), 0, []
    while i < len(text):
        if partner[i] >= 0:
            found.append((i, partner[i] + 1))
            i = partner[i]
        i += 1
    return found


def _language(text: str) -> str:
    if re.search("[가-힣]", text):
        return "ko"
    if re.search("[ऀ-ॿ]", text):
        return "hi"
    if re.search("[฀-๿]", text):
        return "th"
    hiragana = len(re.findall("[ぁ-ん]", text))
    if hiragana and not (hiragana <= 0.2 * len(text) and re.search("[吗说这们从离时约间写记啊]|的|[一-鿿]了", text) and not re.search("(?:した|して|いる|から|です|ます|だ)[。、]", text)):
        return "ja"
    if re.search("[一-鿿ァ-ヶ]", text):
        # A few kanji or kana inside a text of letters are names.
        east, letters = len(re.findall("[一-鿿ァ-ヶー]", text)), len(re.findall(r"[^\W\d_一-鿿ァ-ヶー]", text))
        if east >= letters or re.search("[。！？，]", text):
            return "zh" if not re.search("[ァ-ヶ一-鿿]{2}(?:県|町|駅)?$", text) or re.search("[的了吗呢吧说这们个从]|“", text) else "ja"
    return "xx"


def _skip(text: str, at: int, what: set[str]) -> int:
    while at < len(text) and text[at] in what:
        at += 1
    return at


def _spaceless(text: str, lang: str, lexicon: Lexicon) -> list[int]:
    """Ends of sentences in Japanese or Chinese."""
    tops = _tops(text)
    inside, i, ends, begin = dict(tops), 0, [], True
    prose = any(c in "。！？!?" for c in _outside(text, tops))
    while i < len(text):
        char = text[i]
        if i in inside:
            end = inside[i]
            closed = text[i:end]
            after = _skip(text, end, BLANK)
            ended = closed.rstrip("".join(CLOSERS))[-1:] in END_MARKS
            if begin and after < len(text) and text[after] not in BREAKS and text[after] not in END_MARKS:
                alone = text[after] in PAIRS and (closed[0] in QUOTES or closed[0] in "（(") and ended
                if not alone and ended:
                    alone = lexicon.opens(text, after, lang) == "o" if lang == "ja" else closed[0] not in "《〈" and not _goes_on(text, after, lexicon)
                if alone:
                    ends.append(end)
                    i = after
                    continue
            begin, i = False, end
            continue
        if char in BREAKS:
            if not prose or ends and not text[ends[-1] : i].strip() or _line_ends(text, i, lang, lexicon):
                ends.append(i)
                begin = True
            i += 1
            continue
        if char in "。！？!?｡．…‥" or char == "." and lang == "zh" and _skip(text, i + 1, BLANK) > i + 1:
            end = i + 1
            while end < len(text) and (text[end] in END_MARKS and text[end] != "." or text[end] in "」』）”》】" and end not in inside):
                end += 1
            run = text[i:end]
            if char == "．" and i and text[i - 1].isdigit() and text[end : end + 1].isdigit():
                i = end
                continue
            after = _skip(text, end, BLANK)
            if after >= len(text) or text[after] in BREAKS:
                done = True
            elif set(run) <= set("…‥"):
                done = lang == "zh" or lexicon.closes(text, i, lang)[1] == "f"
                done = done and lexicon.opens(text, after, lang) == "o"
            else:
                plain = lang == "ja" and set(run) <= set("。｡")
                done = plain and not _QUOTING.match(text, after) or lexicon.opens(text, after, lang) == "o"
            if done:
                ends.append(end)
                begin, i = True, after
                continue
            begin, i = False, end
            continue
        if char not in BLANK:
            begin = False
        i += 1
    return ends


def _outside(text: str, tops: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in tops:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _goes_on(text: str, at: int, lexicon: Lexicon) -> bool:
    """Whether a Chinese sentence runs on from a quotation: a word of saying before its end."""
    end = re.compile("[。！？!?\n]|$").search(text, at).start()
    return lexicon.opens(text, at, "zh") == "j" or any(kind == "c" for _, kind in lexicon.lattice(text[at:end], "zh"))


def _line_ends(text: str, at: int, lang: str, lexicon: Lexicon) -> bool:
    """Whether a line of prose ends its sentence at a line break."""
    last = at
    while last > 0 and text[last - 1].isspace():
        last -= 1
    if not last or text[last - 1] in END_MARKS or text[last - 1] in CLOSERS:
        return True
    if text[at + 1 : at + 2] in BREAKS:
        return True
    if text[last - 1] in "、，：；・":
        return False
    return lexicon.closes(text, last, lang)[1] == "f" and lexicon.opens(text, _skip(text, at, BREAKS | BLANK), lang) == "o"


def _thai(text: str, lexicon: Lexicon) -> list[int]:
    """Ends of Thai sentences: blanks and breaks whose next word opens one."""
    ends, inside = [], _tops(text)
    for m in re.finditer(r"\s+", text):
        a, b = m.span()
        if a == 0 or b == len(text) or any(s < a < e for s, e in inside):
            continue
        nxt = text[b]
        if BREAKS & set(m.group()):
            if not ("฀" <= nxt <= "๿" and lexicon.opens(text, b, "th") == "j") or BREAKS & set(text[a : a + 1]) and text[a + 1 : a + 2] in BREAKS:
                ends.append(a)
            continue
        if not "฀" <= nxt <= "๿" or text[a - 1].isdigit():
            continue
        word, kind = lexicon.closes(text, a, "th") if "฀" <= text[a - 1] <= "๿" else ("", "")
        if kind == "j" and word in ("ที่", "ใน", "ถึง", "จาก", "กับ", "ของ", "และ"):
            continue
        if lexicon.opens(text, b, "th") == "o":
            ends.append(a)
    return ends


def _terminators(text: str, lang: str) -> list[tuple[int, int, float]]:
    """(end, where the next sentence would begin, weight) of every place where a sentence of a spaced script may end."""
    tops, nodes, i, opening = dict(_tops(text)), [], 0, True
    cased = lang == "xx"
    while i < len(text):
        char = text[i]
        if i in tops:
            end = tops[i]
            after = _skip(text, end, BLANK | BREAKS)
            inner = text[i + 1 : end - 1].rstrip()
            if after > end and after < len(text) and inner[-1:] in END_MARKS and (char in QUOTES or opening):
                broken = bool(BREAKS & set(text[end:after]))
                if (cased and _capital(text, after)) or (not cased and broken and opening):
                    nodes.append((end, after, 3.0))
                    i, opening = after, True
                    continue
            i, opening = end, False
        elif char in BREAKS:
            after = _skip(text, i, BLANK | BREAKS)
            if sum(c in "\n\u2028\u2029" for c in text[i:after]) >= 2:
                nodes.append((i, after, 4.0))
                opening = True
            i = after
        elif char in END_MARKS:
            end = i
            while end < len(text) and (text[end] in END_MARKS or text[end] in "»”" and end not in tops):
                end += 1
            run = text[i:end]
            after = _skip(text, end, BLANK | BREAKS)
            if after >= len(text):
                break
            weight = _weight(text, i, run, after, lang) if after > end else 3.0 if run[-1] in "।॥。！？" else -4.0
            nodes.append((end, after, weight))
            i, opening = (after, True) if weight > 0 else (end, False)
        else:
            opening = opening and char.isspace()
            i += 1
    return nodes


def _spaced(text: str, lang: str) -> list[int]:
    """Ends of sentences of scripts with blanks: the best path through the lattice of terminators.

    A path takes the weight of every terminator it ends a sentence at, and loses
    :data:`WORDLESS` for a sentence without a word.
    """
    nodes = [(0, 0, 0.0), *_terminators(text, lang), (len(text), len(text), 0.0)]
    words = [0, *accumulate(map(str.isalnum, text))]
    best, back, leader, ready = [0.0], [0], -1, 0
    for j in range(1, len(nodes)):
        end, _, weight = nodes[j]
        # Nodes with a word between them and this one; of these the best so far leads.
        while ready < j and words[nodes[ready][1]] < words[end]:
            leader = ready if leader < 0 or best[ready] >= best[leader] else leader
            ready += 1
        options = [(best[i] - WORDLESS, i) for i in range(ready, j)] + ([(best[leader], leader)] if leader >= 0 else [])
        gain, i = max(options)
        best.append(gain + weight)
        back.append(i)
    ends, j = [], back[-1]
    while j > 0:
        ends.append(nodes[j][0])
        j = back[j]
    return ends[::-1]


def _capital(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can open a sentence of a cased script."""
    while at < len(text) and (text[at] in PAIRS or text[at] in "\"'’¿¡*" or text[at] in BLANK):
        at += 1
    if at >= len(text) or text[at] in "—–-,;:":
        return False
    return text[at].isupper() or text[at].isdigit() or not text[at].islower() and text[at].isalpha()


def _weight(text: str, at: int, run: str, after: int, lang: str) -> float:
    """How much an end mark followed by a blank speaks for the end of its sentence, below 0 against it."""
    capital = _capital(text, after)
    goes_on = text[after] in ",;:—–-"
    if any(c in "!?！？।॥؟" for c in run):
        return 3.0 if (capital if lang == "xx" else not goes_on) else -3.0
    start = at
    while start > 0 and not text[start - 1].isspace() and text[start - 1] not in _EDGES:
        start -= 1
    key = text[start:at].strip("'’*").casefold()
    if "…" in run or len(run) >= 3:
        return 1.0 if capital else -2.0
    if len(run) == 2:
        return 2.0 if capital or lang != "xx" else -2.0
    if key.isdigit() or re.fullmatch(r"\d+[.,]\d+", key):
        return 2.0 if capital and not MONTHS.match(text, after) else -2.0
    if key in ENDING:
        return 1.0 if capital and not text[after].isdigit() else -2.0
    last = key.rsplit(".", 1)[-1].rsplit("’", 1)[-1].rsplit("-", 1)[-1]
    if key in ABBREVIATIONS or last in ABBREVIATIONS and ("." in key or "-" not in key):
        return -4.0
    if len(last) == 1 and last.isalpha() and last.isascii():
        return -4.0
    if lang != "xx":
        return -3.0 if goes_on else 3.0
    if capital:
        return 3.0
    return 1.0 if len(key) >= 5 and not key[0].isdigit() and not goes_on else -2.0


BASE = Lexicon()


def sentence_spans(text: str | None, lexicon: Lexicon = BASE) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text."""
    if not text or not text.strip():
        return []
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    body = text[first:last]
    lang = _language(body)
    ends = _spaceless(body, lang, lexicon) if lang in ("ja", "zh") else _thai(body, lexicon) if lang == "th" else _spaced(body, lang)
    spans, start = [], 0
    for end in [*ends, len(body)]:
        a, b = start, end
        while a < b and body[a].isspace():
            a += 1
        while b > a and body[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((first + a, first + b))
        start = max(start, end)
    if len(spans) > 1 and examine(text)[0]:
        return [(first, last)]
    return spans


def learn_openers(rows: DataFrame, text: str) -> list[str]:
    """Words that the rows of a corpus begin with, in scripts without blanks.

    A beginning is taken for a word if it is frequent and what follows it varies. All rows are
    counted; the result is bounded by :data:`OPENERS`, so it can go to every task.
    """
    low, high = OPENER_LENGTHS
    begun = rows.select(F.regexp_replace(F.col(text), r"^[\s　]+", "").alias("t")).where(F.col("t").rlike("^[ぁ-ヿ一-鿿฀-๿]"))
    cut = begun.select("t", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).where(F.length("t") > F.col("n"))
    counted = cut.groupBy(F.expr("substring(t, 1, n)").alias("word"), F.expr("substring(t, n + 1, 1)").alias("next")).agg(F.count(F.lit(1)).alias("rows"))
    words = counted.groupBy("word").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ways")).where((F.col("rows") >= OPENER_ROWS) & (F.col("ways") >= OPENER_WAYS) & F.col("word").rlike("^[ぁ-ヿ一-鿿฀-๿]+$"))
    return [r.word for r in words.orderBy(F.col("rows").desc(), "word").limit(OPENERS).collect()]


def split_sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every sentence as a row: the keys, ``part`` (from 1), ``char_start``, ``char_end``, ``sentence_text``, ``n_parts``.

    Openers are learned from the beginnings of all rows first.
    """
    learned = learn_openers(df, text)
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(learned)
        for batch in batches:
            # Nullable integers arrive as floats: whole numbers are what they were.
            values = [[None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in batch[k].tolist()] for k in keys]
            rows = []
            for i, t in enumerate(batch[text]):
                spans = sentence_spans(t, lexicon)
                rows += [(*(v[i] for v in values), k, a, b, t[a:b], len(spans)) for k, (a, b) in enumerate(spans, 1)]
            if rows:
                yield frame([*keys, "part", "char_start", "char_end", "sentence_text", "n_parts"], rows)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "part int", "char_start int", "char_end int", "sentence_text string", "n_parts int"])
    return spread(df.select(*dict.fromkeys([*keys, text]))).mapInPandas(run, schema)


def reordered(sentences: DataFrame) -> DataFrame:
    """Every sentence unit with its new ``sentence_order`` within the work: the old order, then the place in the row.

    Rows without an order come first. Works are ranked by blocks, so a long one is not one task.
    """
    rows = sentences.where(F.col("sentence_id").isNotNull()).select("sentence_id", "work_id", F.col("sentence_order").alias("row_order"), F.col("sentence_text").alias("row_text"))
    units = split_sentences(rows, ["sentence_id", "work_id", "row_order"], "row_text")
    known = F.col("row_order").isNotNull()
    blocks = [F.when(known, F.floor(F.col("row_order") / BLOCK)).otherwise(F.lit(-(1 << 40))), F.when(known, F.lit(0).cast("long")).otherwise(F.floor(F.col("sentence_id") / BLOCK))]
    ranked = block_ranks(units, "work_id", blocks, ["row_order", "sentence_id", "part"], "sentence_order")
    return ranked.select("sentence_id", "work_id", "sentence_order", "sentence_text", "char_start", "char_end")
