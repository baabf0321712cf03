"""Text that was decoded with the wrong character encoding (problem 4).

A best-first search over *encode, decode and unescape* steps. A state is a text; a step
takes the whole text, or one damaged stretch of it, back to the bytes of an encoding it may
have been read in and decodes them by another. States are visited once (by hash), the
cheapest first; the cost is the implausibility of the characters. The cheapest reachable
text is the restored one if it is clearly cheaper than what stands there.

A record is *affected* if a restoration exists or if it carries what only damage leaves:
replacement characters, C1 controls or private-use characters.

Defined results: null, empty and blank texts are unaffected. What cannot be restored is
affected with a null restoration; partial restorations are given if they are clearly
cheaper. Long texts are searched by damaged regions, so their cost grows linearly.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyori.llm.frames import frame
from fumiyori.operators.sizing import spread

#: Encodings a text may have been read in by mistake, and those its bytes may really have.
EIGHT_BIT = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp874", "iso8859_2", "iso8859_15")
DOUBLE_BYTE = ("gb18030", "cp932", "euc_jp", "cp949", "big5")
REALLY = ("utf_8", "cp932", "euc_jp", "gb18030", "cp949", "cp874", "cp1252")
#: Bits above the cheapest text reached so far from which on a search goes no further.
SLACK = 40.0
#: Sound characters between two regions that are searched apart; a region of more stretches is cut again at half as many.
GAP, CROWDED = 12, 30
#: A restoration counts if the changed part loses this share of its cost and this many bits.
SHARE, BITS = 0.78, 8.0
#: Bits per character up to which a text counts as sound, which ends a search.
SOUND = 8.0

_GONE = re.compile("[�\x80-\x9f-\U000f0000-\U0010ffff]")
_JIS = re.compile(r"\x1b?\$[@B]((?:[!-~]{2})+?)\x1b?\([BJ]")
_JIS_ODD = re.compile(r"\x1b?\$[@B]([!-~]+?)\x1b?\(?[BJ]?\)?(?=\)|$|[^!-~])")
_ESCAPE = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[a-zA-Z]{2,8});|(?:%[0-9A-Fa-f]{2}){2,}|(?:\\u[0-9a-fA-F]{4})+|(?:\\x[0-9a-fA-F]{2})+|(?:=[0-9A-F]{2}){2,}")
_NARROW = re.compile("[!-~]{0,16}")
_HALF_KANA = re.compile("[ｦ-ﾟ]+")
_HALF_WELL = re.compile("(?:[ｳｶ-ﾄﾊ-ﾎ]ﾞ|[ﾊ-ﾎ]ﾟ|[ｱ-ﾜｦﾝ]ｰ*(?:(?<=[ｷｼﾁﾆﾋﾐﾘﾞﾟ])[ｬｭｮ]|(?<=[ｼﾁﾌｳﾃﾂﾞ])[ｧｨｩｪｫ])?|ｯ(?=[ｶ-ﾄﾊ-ﾎﾗ-ﾜ])|ｰ)+$")


@lru_cache(maxsize=1 << 17)
def char_bits(char: str) -> tuple[float, str]:
    """(bits, script family): how unlikely a character is in sound text of the corpus's languages."""
    code = ord(char)
    if code < 0x80:
        if char.islower():
            return 4.3, "a"
        if char.isupper():
            return 6.0, "a"
        return (2.5 if char in " \n\r\t" else 6.0, "") if code >= 0x20 and code != 0x7F or char in "\n\r\t" else (25.0, "")
    if code < 0xA0 or code == 0xFFFD or 0xE000 <= code <= 0xF8FF or code >= 0xF0000:
        return 25.0, "s"
    if code < 0x100:
        if char.isalpha() and char not in "ªºµÐÞþðýÿÝ":
            return (8.0 if char.islower() else 10.0), "x"
        return (6.0, "") if code == 0xA0 else (8.0, "s") if code == 0xAD else (9.0, "s") if char in "«»°§·" else (13.0, "s")
    if code < 0x250:
        return (10.0 if char in "œŒ" else 13.0), "x"
    if 0x3041 <= code <= 0x3096:
        return 5.0, "j"
    if 0x30A0 <= code <= 0x30FF or 0x3099 <= code <= 0x309E:
        return 6.5, "j"
    if 0x3000 <= code <= 0x3020:
        return 6.0, ""
    if 0x4E00 <= code <= 0x9FFF:
        for codec, first, last in (("shift_jis", 0x88, 0x97), ("gb2312", 0xB0, 0xD7)):
            try:
                if first <= char.encode(codec)[0] <= last:
                    return 9.5, "j"
            except UnicodeEncodeError:
                pass
        return 16.0, "j"
    if 0xAC00 <= code <= 0xD7A3:
        return (9.0 if len(char.encode("euc_kr")) == 2 else 18.0), "k"
    if 0x0E00 <= code <= 0x0E7F:
        return (13.0 if code >= 0x0E4F else 9.0 if code in (0x0E03, 0x0E05, 0x0E11, 0x0E12) else 9.0 if char in "ฆฌญฎฏฐฒฬฤ" else 5.0), "t"
    if 0x0900 <= code <= 0x097F:
        return 5.0, "d"
    if 0x0370 <= code <= 0x03FF:
        return (6.5 if char.islower() else 9.0), "c"
    if 0x0400 <= code <= 0x052F:
        return (6.5 if char.islower() else 9.0) if 0x410 <= code <= 0x44F or char in "аеорсхуѕіјѕЅ" else 13.0, "c"
    if char in "“”‘’–—―…„":
        return 7.0, ""
    if 0xFF01 <= code <= 0xFF5E:
        return 9.0 if char not in "！？（），：；～" else 6.0, ""
    if 0xFF61 <= code <= 0xFF65:
        return 13.0, "h"
    if 0xFF66 <= code <= 0xFF9F:
        return 8.0, "h"
    if 0xF900 <= code <= 0xFAFF or 0x2E80 <= code <= 0x2FDF or 0x20000 <= code <= 0x3FFFF:
        return 12.0, "j"
    if 0x2500 <= code <= 0x259F:
        return 16.0, "s"
    if unicodedata.category(char) in ("Cf", "Mn", "Zs"):
        return 8.0, ""
    return (10.0, "") if code > 0xFFFF else (12.0, "") if char in "±×÷≒≠□■○●◎◇◆△▲▽▼☆★※→←↑↓〒♪" else (15.0, "s")


# Bits of a change of script inside a word.
_CLASH = {frozenset(pair): bits for pair, bits in (("ac", 2), ("ja", 3), ("xc", 3), ("xj", 7), ("sj", 7), ("ss", 2), ("sx", 4), ("sa", 3), ("sc", 6), ("sh", 7), ("hj", 5), ("ha", 5), ("hx", 7), ("kj", 2.5), ("kx", 7), ("tx", 4), ("tj", 7), ("dj", 7), ("td", 7), ("kt", 7), ("kd", 7), ("cj", 7), ("ck", 7), ("ct", 7), ("st", 7), ("sk", 7))}


_NEVER_INSIDE = frozenset("“”„‚‡†•‰‹›«»")


def cost(text: str) -> float:
    """Bits of a text: its characters, changes of script inside words, malformed half-width kana."""
    total, before, last, half, mark = 0.0, "", "", False, False
    for char in text:
        bits, family = char_bits(char)
        total += bits
        # A quotation mark between letters.
        if mark and family in ("a", "x", "c"):
            total += 8.0
        mark = char in _NEVER_INSIDE and before in ("a", "x", "c")
        if family:
            if before:
                if before != family:
                    total += _CLASH.get(frozenset((before, family)), 0.0)
                elif family == "x" and (char.isupper() or last.isupper()):
                    total += 3.0
            if family == "h":
                half = True
            elif (family == "a" or family == "x") and char.isupper() and last.islower() and before in ("a", "x"):
                total += 3.0
            if family == "c" and char in "ΘΓπΣσΦΩδφ" and before in ("a", "x"):
                total += 8.0
            if family == "t" and char in "ัิีึืฺุู็่้๊๋์ํ๎" and before != "t":
                total += 12.0
        before, last = family, char
    if half:
        for found in _HALF_KANA.findall(text):
            if not _HALF_WELL.match(found):
                total += 5.0 * len(found)
    return total


class _Bits(dict):
    """Bits by character, filled as characters come up."""

    def __missing__(self, char: str) -> float:
        self[char] = bits = char_bits(char)[0]
        return bits


_bits = _Bits()


def _surroundings(text: str, a: int, b: int) -> tuple[int, int]:
    """The part of a text whose cost may change with ``text[a:b]``: the characters next to it, and half-width kana that run up to it."""
    low, high = max(0, a - 3), min(len(text), b + 3)
    while low > 0 and "ｦ" <= text[low - 1] <= "ﾟ":
        low -= 1
    while high < len(text) and "ｦ" <= text[high] <= "ﾟ":
        high += 1
    return low, high


READ_AS = {"any": EIGHT_BIT + DOUBLE_BYTE, "8": EIGHT_BIT, "16": DOUBLE_BYTE}


def _bytes_of(text: str, codec: str) -> bytes | None:
    """The bytes that read as ``text`` under a codec; undefined bytes may have passed as C1 controls."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if not codec.startswith(("cp125", "cp874")):
            return None
    out = bytearray()
    for char in text:
        try:
            out += char.encode(codec)
        except UnicodeEncodeError:
            if 0x80 <= ord(char) < 0xA0:
                out.append(ord(char))
            else:
                return None
    return bytes(out)


def _steps(text: str, kind: str = "any"):
    """(text, encoding) one step away from a stretch."""
    unescaped = _JIS.sub(lambda m: ("\x1b$B" + m.group(1) + "\x1b(B").encode("ascii").decode("iso2022_jp", "replace"), text)
    if unescaped == text and "$B" in text:
        unescaped = _JIS_ODD.sub(lambda m: ("\x1b$B" + m.group(1)[: len(m.group(1)) // 2 * 2] + "\x1b(B").encode("ascii").decode("iso2022_jp", "replace"), text)
    if unescaped != text:
        yield unescaped, "utf_8"
    if _ESCAPE.search(text):
        yield _ESCAPE.sub(_unescape, text), "utf_8"
    if text.isascii():
        return
    for wrong in READ_AS[kind]:
        raw = _bytes_of(text, wrong)
        if raw is None or raw.isascii():
            continue
        for right in REALLY:
            if right != wrong:
                try:
                    yield raw.decode(right), "16" if wrong in DOUBLE_BYTE and right != "utf_8" else right
                except (UnicodeDecodeError, ValueError):
                    continue


def _unescape(match: re.Match) -> str:
    token = match.group()
    if token[0] == "&":
        return html.unescape(token)
    if token[0] == "\\":
        return token.encode("ascii").decode("unicode_escape")
    return bytes.fromhex(token.replace(token[0], "")).decode("latin_1")


# A stretch that an eight-bit reading leaves: its characters, with and without what stands between them.
_HIGH = "\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™Ѐ-ґ─-▟Α-ωϖⁿ√≈≡≤≥⌠⌡∙ﬁﬂ∂∑∏π∫Ω≠∞◊ıˇ˘˙˚˝˛₧⌐"
_HIGH_SET = frozenset(re.findall(f"[{_HIGH}]", "".join(map(chr, range(0x80, 0x10000)))))
_EIGHT = (re.compile(f"[{_HIGH}][{_HIGH} -~]*[{_HIGH}]"), re.compile(f"[{_HIGH}]{{2,}}"), re.compile(f"[{_HIGH}][{_HIGH}!-~]*"))


def _stretches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the parts of a text that may be damaged while the rest is sound."""
    spans = [(*m.span(), "8") for pattern in _EIGHT for m in pattern.finditer(text)]
    odd = [i for i, c in enumerate(text) if char_bits(c)[0] >= 12.0 or 0xFF61 <= ord(c) <= 0xFF9F]
    if odd:
        first, last = odd[0], odd[-1] + 1
        spans += [(max(0, first - a), min(len(text), last + b), "16") for a in (0, 1, 2) for b in (0, 1, 2)]
    return [s for s in dict.fromkeys(spans) if s[1] - s[0] >= 2 and (s[2] == "16" or (s[0], s[1]) != (0, len(text)))]


def _regions(text: str, gap: int = GAP) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that may be damaged, as many as have ``gap`` sound characters between them."""
    found: list[list[int]] = []
    for i, c in enumerate(text):
        if c in _HIGH_SET or char_bits(c)[0] >= 12.0 or 0xFF61 <= ord(c) <= 0xFF9F:
            if found and i - found[-1][1] <= gap:
                found[-1][1] = i + 1
            else:
                found.append([i, i + 1])
    parts = [(a, b) for a, b in found if b - a >= 2]
    if gap:
        parts = [(a + x, a + y) for a, b in parts for x, y in (_regions(text[a:b], gap // 2) if len(_stretches(text[a:b])) > CROWDED else [(0, b - a)])]
    return parts


def _changed(before: str, after: str) -> tuple[str, str]:
    """The parts of two texts between their common head and tail."""
    head = 0
    while head < min(len(before), len(after)) and before[head] == after[head]:
        head += 1
    tail = 0
    while tail < min(len(before), len(after)) - head and before[-1 - tail] == after[-1 - tail]:
        tail += 1
    return before[head : len(before) - tail], after[head : len(after) - tail]


def is_better(before: str, after: str) -> bool:
    """Whether ``after`` is clearly more plausible than ``before``, judged on what changed."""
    if before == after:
        return False
    old, new = _changed(before, after)
    a, b = cost(old), cost(new)
    return cost(before) - cost(after) >= BITS and (b <= SHARE * a or b - 5.0 * len(new) <= 0.5 * (a - 5.0 * len(old)))


@lru_cache(maxsize=1 << 16)
def _only_chinese(char: str) -> bool:
    """Whether a kanji is common in simplified Chinese but not in Japanese."""
    try:
        return "一" <= char <= "鿿" and not 0x88 <= char.encode("shift_jis")[0] <= 0x97
    except UnicodeEncodeError:
        return True


def _is_believable(old: str, new: str, right: str, whole: str) -> bool:
    """Whether a decoding that succeeds for nearly any bytes (unlike UTF-8) can be meant.

    What stood there must itself be odd, and what comes must be sound: without rare
    characters, in one script that fits the rest of the text, and not too short to tell.
    """
    if len(old) < 2:
        return False
    odd = sum(char_bits(c)[0] >= 12.0 or char_bits(c)[1] == "h" for c in old)
    if right == "cp1252":
        return cost(new) < cost(old) and not any(char_bits(c)[0] >= 12.0 for c in new)
    if sum(char_bits(c)[0] >= 12.0 for c in new) > 0.1 * len(new) or cost(old) < 8.0 * len(old):
        return False
    if right == "16" and odd < 0.35 * len(old):
        return False
    families = {f for _, f in map(char_bits, new) if f and f != "a"}
    if len(families) > 1 or "h" in families:
        return False
    if families == {"t"} and not re.search("[\u0e00-\u0e7f]{4}", new):
        return False
    if re.search("[ぁ-んァ-ヶ]", whole) and any(map(_only_chinese, new)):
        return False
    if len(new) < 4:
        return cost(new) <= (0.45 if right == "16" else 0.58) * cost(old)
    return True


def _is_sound(text: str, bits: float) -> bool:
    return bits <= SOUND * len(text) and not any(char_bits(c)[0] >= 12.0 for c in text)


def restore(text: str) -> str:
    """The cheapest text that the search reaches.

    The whole text is read again, and every damaged region with sound text around it is searched
    on its own, again and again as long as that makes the text cheaper; so neither the length of
    a text nor the number of its regions bounds the search.
    """
    whole = _search(text, with_stretches=False)
    starts = [text] if whole == text or _is_sound(whole, cost(whole)) else [text, whole]
    return min([whole, *map(_by_regions, starts)], key=cost)


def _by_regions(text: str) -> str:
    """``text`` with its damaged regions restored one by one, until nothing gets cheaper."""
    best, price = text, cost(text)
    while True:
        out, at, regions = [], 0, _regions(best)
        if len(regions) <= 1:
            joined = _search(best)
        else:
            for (a, b), (following, _) in zip(regions, [*regions[1:], (len(best), 0)], strict=True):
                # The last byte of a character may read as a narrow sign.
                b = min(following, _NARROW.match(best, b).end())
                part = _search(best[a:b])
                out += [best[at:a], part if is_better(best[a:b], part) else best[a:b]]
                at = b
            joined = "".join([*out, best[at:]])
        if (now := cost(joined)) >= price:
            return best
        best, price = joined, now
        if _is_sound(best, price):
            return best


def _search(text: str, with_stretches: bool = True) -> str:
    """The cheapest text reached; ends at a sound one, or where all others left cost too much more than the best."""
    start = cost(text)
    best, best_cost = text, start
    queue, seen, order = [(start, 0, text)], {hash(text)}, 0
    while queue:
        here, _, state = heapq.heappop(queue)
        if here > best_cost + SLACK:
            break
        reached = ((0, len(state), part, right) for part, right in _steps(state))
        if with_stretches:
            reached = chain(reached, ((a, b, part, right) for a, b, kind in _stretches(state) for part, right in _steps(state[a:b], kind)))
        near: dict[tuple[int, int], tuple[int, int, float]] = {}
        for a, b, part, right in reached:
            if (a, b) not in near:
                low, high = _surroundings(state, a, b)
                near[a, b] = low, high, cost(state[low:high])
            low, high, was = near[a, b]
            new = state[low:a] + part + state[b:high]
            # Changes of script only add to the bits of the characters.
            if sum(map(_bits.__getitem__, new)) >= was:
                continue
            found = state[:low] + new + state[high:]
            if (key := hash(found)) in seen:
                continue
            seen.add(key)
            price = here + cost(new) - was
            if price < here and (right == "utf_8" or _is_believable(*_changed(state, found), right, found)):
                order += 1
                heapq.heappush(queue, (price, order, found))
                if price < best_cost:
                    best, best_cost = found, price
        if best is not text and _is_sound(best, best_cost):
            break
    return best


def _common_kanji() -> str:
    return "".join(chr(c) for c in range(0x4E00, 0xA000) if char_bits(chr(c))[0] < 12)


_SUSPECT = re.compile(
    "[^ -~\t\r\n　-〠ぁ-ゟァ-ヿ！-｠가-힣ऀ-ॿ฀-๿“”‘’–—―…«»„À-ÖØ-öø-üﾞﾟ ­̀-ͯ -‏ ⁠﻿︀-️⺀-⿟豈-﫿\U0001f000-\U000e01ef\U00020000-\U0003ffff" + _common_kanji() + "]"
    "|[À-ÿ]{3}|[ÃÂ][ -ÿ]|[À-ÿ][¡-¿]|\\$B|&[#a-zA-Z0-9]{2,8};|%[0-9A-Fa-f]{2}%|\\\\[ux][0-9a-fA-F]{2}|=[0-9A-F]{2}="
    "|[a-zA-Z'’ ][一-鿿]{1,2}[a-z]|[À-ÿ][぀-ヿ一-鿿]|[぀-ヿ一-鿿][À-ÿ]|[฀-๿][À-ÿ]|[–—‘’“”…][À-ÿA-Z][–—‘’“”…]"
)


@lru_cache(maxsize=20_000)
def examine(text: str) -> tuple[bool, str | None]:
    """(affected, restored text or None)."""
    if not _SUSPECT.search(text):
        return False, None
    gone = bool(_GONE.search(text))
    best = restore(text)
    if is_better(text, best):
        return True, None if _GONE.search(best) and gone and len(_GONE.findall(best)) >= len(_GONE.findall(text)) else best
    return gone, None


def find_damaged(texts: DataFrame, source: str, id_col: str, text_col: str) -> DataFrame:
    """``source_table, source_id, text, restored`` of the affected rows of a table."""

    def run(batches):
        for batch in batches:
            kept = [(source, i, t, found[1]) for i, t in zip(batch["i"].tolist(), batch["t"], strict=True) if (found := examine(t))[0]]
            if kept:
                yield frame(["source_table", "source_id", "text", "restored"], kept)

    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"[^\x20-\x7e]|\$B|[&%=\\]")).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return spread(rows).mapInPandas(run, "source_table string, source_id long, text string, restored string")


def damaged_rows(sentences: DataFrame, works: DataFrame) -> DataFrame:
    """Affected sentences and titles with what could be restored."""
    return find_damaged(sentences, "sentences", "sentence_id", "sentence_text").unionByName(find_damaged(works, "works", "work_id", "title"))

