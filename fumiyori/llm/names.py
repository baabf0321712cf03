"""Variant spellings of the names of persons and organisations (problem 5).

A pigeonhole segment join: every name yields a few forms (as written, in Latin letters by its
reading, with an initial, as a pen name, as an organisation). A form's key is cut into
``k + 1`` segments; an inverted index holds them by key length and number; position-shifted
substrings of the other keys are looked up in it, and banded edit distance verifies the
names. Life years and readings then decide between the same person and a relative.

Strong links (equal or nearly equal full names) form groups. A weak link (an initial, a
reading that several persons share) counts only if it leads to one group.

Kanji readings are learned from the corpus's own pairs of names and readings.

Defined results: rows with null or empty names mean nobody and pair with none; rows with
the same name are one person unless their years differ; further columns are not read. A
pair whose birth or death years differ is never the same person.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyori.llm.frames import frame
from fumiyori.llm.lookalike import consistent
from fumiyori.session import cut_lineage

#: Edits that the key of a form may differ by.
EDITS = 1
#: Kanji rarer in names than this share of the average kanji are taken for typing slips.
SLIP_SHARE = 0.2
#: Links that one task joins to groups by itself (two longs each: some 100 MB while it does); of more links, each task takes a share.
LINKS_A_TASK = 1_000_000

#: What a pair is judged by, beside its forms.
FACTS = ("latin", "in_kana", "kana", "birth", "death")

# Old and new character forms, titles, short forms, nicknames.
OLD_FORMS = str.maketrans("龍瀧邊邉國櫻澤濱嶋峯藏廣壽鐵靜惠眞圓實齋齊德榮會學藝輯傳團雜單繪詩條萬與", "竜滝辺辺国桜沢浜島峰蔵広寿鉄静恵真円実斎斉徳栄会学芸集伝団雑単絵詩条万与")
TITLES = frozenset("dr prof sir frau herr fräulein mr mrs ms miss m mme mlle mgr lady lord rev the".split())
JA_TAIL = re.compile(r"(?:[・/／ ]?(?:氏|女史|先生|著|訳|作|編|画|様|殿|さん))$|[（(](?:作家|詩人|著|訳|画家|歌人|俳人)[）)]$")
PEN_TAIL = re.compile(r"(?:楼主人|山人|主人|庵|軒|亭|斎|居士|散人|生)$")
JA_ORG = {"詩人会": "詩人会", "詩会": "詩人会", "出版社編集部": "編集部", "編集部": "編集部", "文芸協会": "文協", "文協": "文協", "国文学研究所": "国文研", "国文研": "国文研", "歌誌同人": "同人", "同人": "同人"}
JA_ORG_HEAD = re.compile(r"^(?:財団法人|社団法人|株式会社|一般社団法人|公益財団法人|[（(][社財株][）)])|(?:株式会社)$")
ORG_WORDS = {"institute": "inst", "inst": "inst", "letters": "lett", "lett": "lett", "literary": "lit", "lit": "lit", "society": "soc", "soc": "soc", "university": "univ", "univ": "univ", "press": "press", "pr": "press", "publishing": "publ", "publ": "publ", "company": "co", "co": "co", "travel": "trav", "trav": "trav", "writers": "writ", "writ": "writ", "association": "assoc", "assoc": "assoc", "twa": "twa"}
ORG_NOISE = frozenset("of the ltd inc e.v ev gmbh llc limited".split())
NICKNAMES = {
    "bob": "robert", "rob": "robert", "dora": "dorothea", "thea": "dorothea", "ori": "oriane", "yvi": "yvette", "zach": "zacharias", "zack": "zacharias", "jette": "henriette", "bella": "isabella", "josie": "josephine", "fifi": "josephine", "vicky": "victoria",
    "dick": "richard", "rick": "richard", "leo": "leopold", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "pip": "philippa", "hans": "johannes", "jan": "johannes", "gussie": "augusta", "gusta": "augusta", "theo": "theodor", "ned": "edward", "ted": "edward", "ben": "benedikt",
    "bill": "william", "will": "william", "peggy": "margaret", "maggie": "margaret", "greta": "margaret", "ulla": "ursula", "uschi": "ursula", "bastian": "sebastian", "lottie": "charlotte", "alex": "alexander", "klaus": "nikolaus", "niko": "nikolaus", "kate": "katherine", "kitty": "katherine", "wally": "walter", "fritz": "friedrich", "pippa": "philippa", "sascha": "alexander",
}
_KANA = dict(zip("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんがぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽ", "a i u e o ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho ma mi mu me mo ya yu yo ra ri ru re ro wa o n ga gi gu ge go za ji zu ze zo da ji zu de do ba bi bu be bo pa pi pu pe po".split(), strict=True))
_SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
_KANJI = re.compile("[㐀-鿿]")


def romaji(kana: str) -> str:
    """A reading in Latin letters; long vowels are written short."""
    out = ""
    for char in kana:
        if char in _SMALL and out.endswith("i"):
            out = out[:-1] + (_SMALL[char][1:] if out[-3:-1] in ("sh", "ch") or out[-2:-1] == "j" else _SMALL[char])
        elif char in _KANA:
            out += _KANA[char]
        elif char == "っ":
            out += "t"
        elif char != "ー":
            out += char
    return _short(out)


def _short(letters: str) -> str:
    return re.sub(r"ou|oo|oh(?![aeiou])", "o", re.sub(r"uu", "u", letters.translate(str.maketrans("āīūēōâîûêô", "aiueoaiueo"))))


def _hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def edits_at_most(a: str, b: str, limit: int) -> int:
    """Banded edit distance with exchanges of neighbours; ``limit + 1`` if beyond the limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [limit + 1] * len(b)
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def _org_word(token: str) -> str | None:
    if token in ORG_WORDS:
        return ORG_WORDS[token]
    if len(token) >= 5:
        return next((code for word, code in ORG_WORDS.items() if len(word) >= 5 and edits_at_most(token, word, 1) <= 1), None)
    return None


@lru_cache(maxsize=50_000)
def parse(name: str, kana: str, alias: str) -> dict:
    """What a name says: its kind and the parts that are compared."""
    x = (consistent(name) or "").translate(OLD_FORMS).replace("_", " ").strip()
    # Neighbouring scripts mix in names: kanji, kana or Latin letters.
    if _KANJI.search(x) or re.search("[ぁ-ゖァ-ヶ]", x):
        x = re.sub("^(?:故|文豪)", "", x)
        bare = JA_ORG_HEAD.sub("", x)
        bare = re.sub(r"[（(][^（）()]*[）)]$", "", bare) if any(bare.rstrip("）)").endswith(t) for t in JA_ORG) else bare
        bare = bare.replace(" ", "").replace("・", "")
        for tail, code in sorted(JA_ORG.items(), key=lambda t: -len(t[0])):
            if bare.endswith(tail) and len(bare) > len(tail):
                return {"kind": "org", "core": bare[: -len(tail)], "type": code}
            if bare.startswith(tail) and len(bare) > len(tail) and len(tail) > 2:
                return {"kind": "org", "core": bare[len(tail) :], "type": code}
            # One slip within the type.
            if len(tail) >= 4:
                for n in (len(tail), len(tail) - 1, len(tail) + 1):
                    if len(bare) > n and edits_at_most(bare[-n:], tail, 1) <= 1:
                        return {"kind": "org", "core": bare[:-n], "type": code}
        while (cut := JA_TAIL.sub("", x).strip()) != x and cut:
            x = cut
        parts = [p for p in re.split(r"[ ・,，、=＝]+", x) if p]
        if len(parts) == 1 and (m := re.fullmatch("([ぁ-ゖ]{2,})([㐀-鿿]+)|([㐀-鿿]+)([ぁ-ゖ]{2,})", x)):
            parts = [g for g in m.groups() if g]
        pen = ""
        if len(parts) == 1 and PEN_TAIL.search(x) and len(PEN_TAIL.sub("", x)) >= 2:
            pen = PEN_TAIL.sub("", x)
        other = [p for p in re.split(r"[ ・,、]+", (consistent(alias) or "").translate(OLD_FORMS)) if p] if alias else []
        return {"kind": "ja", "parts": parts, "pen": pen, "alias": other, "kana": _hiragana(consistent(kana) or "") if kana else ""}
    nick = re.findall(r"[“\"(]([A-Za-zÀ-ÿ]+)[”\")]", x)
    x = re.sub(r"[“\"(][^”\")]*[”\")]", " ", x)
    tokens = [t.strip(".'’-").casefold() for t in re.split(r"[\s,]+", x) if t.strip(".'’-,")]
    codes = [c for t in tokens if (c := _org_word(t))]
    if len(codes) >= 2 or "twa" in codes:
        core = [t for t in tokens if not _org_word(t) and t not in ORG_NOISE]
        kind = "+".join(sorted(set(codes)))
        return {"kind": "org", "core": " ".join(core), "type": "assoc+trav+writ" if kind == "twa" else kind}
    full = [t for t in tokens if len(t) > 1 and t not in TITLES]
    initials = [t for t in tokens if len(t) == 1]
    return {"kind": "xx", "full": [_short(NICKNAMES.get(t, t)) if len(full) > 1 else t for t in full], "initials": initials, "nick": [n.casefold() for n in nick], "kana": _hiragana(kana) if kana else ""}


def readings(part: str, learned: dict[str, str]) -> str | None:
    """The reading of a name part in kana, by learned readings of its kanji."""
    out = ""
    for char in part:
        if _KANJI.match(char):
            if char not in learned:
                return None
            out += learned[char]
        else:
            out += char
    return _hiragana(out)


def forms(name: str, kana: str, alias: str, learned: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(kind, key, whole) of every form; keys are joined within an edit, wholes verify."""
    p = parse(name, kana, alias)
    if p["kind"] == "org":
        if p["core"]:
            yield "O" + p["type"], p["core"], p["core"]
        return
    if p["kind"] == "ja":
        parts = p["parts"]
        if p["pen"]:
            # Given name and the first character of the family name.
            yield "P", p["pen"], p["pen"]
            if len(p["alias"]) == 2:
                yield "K", "".join(p["alias"]), "".join(p["alias"])
        else:
            yield "K", "".join(parts), "".join(parts)
            if len(parts) == 2:
                yield "K", parts[1] + parts[0], parts[1] + parts[0]
                yield "P", parts[1] + parts[0][:1], parts[1] + parts[0][:1]
        read = p["kana"].split() if p["kana"] else []
        if len(read) != 2 and len(parts) == 2 and not p["pen"]:
            read = [r for part in parts if (r := readings(part, learned))]
        if len(read) == 2 and "．" not in name:
            yield from _latin_forms([romaji(r) for r in read], [])
        return
    yield from _latin_forms(p["full"], p["initials"])
    if p["kana"] and len(p["kana"].split()) == 2:
        yield from _latin_forms([romaji(r) for r in p["kana"].split()], [])


def _latin_forms(full: list[str], initials: list[str]) -> Iterator[tuple[str, str, str]]:
    if len(full) >= 2:
        whole = " ".join(sorted(full))
        for token in full:
            rest = sorted(full)
            rest.remove(token)
            # Either part may be the one with the slip; the other narrows the search.
            yield "L" + rest[0], token, whole
            yield "I" + rest[0][0], token, token
    elif len(full) == 1 and initials:
        for initial in initials:
            yield "i" + initial, full[0], full[0]


def learn_readings(authors: DataFrame) -> dict[str, str]:
    """The usual reading of every kanji, from names of two parts with readings of two parts.

    Every cut of a reading votes for its halves; a kanji's reading is the one that most
    different partners agree on. The result has at most one entry a kanji.
    """

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, kana in zip(batch["author_name"], batch["author_name_kana"], strict=True):
                p = parse(name, kana, "")
                read = p.get("kana", "").split()
                if p["kind"] == "ja" and len(p["parts"]) == 2 == len(read):
                    for part, sound in zip(p["parts"], read, strict=True):
                        if len(part) == 2 and all(map(_KANJI.match, part)):
                            for cut in range(1, len(sound)):
                                rows += [(part[0], sound[:cut], part[1]), (part[1], sound[cut:], part[0])]
            if rows:
                yield frame(["kanji", "sound", "partner"], rows)

    cast = authors.where("author_name IS NOT NULL AND author_name_kana IS NOT NULL").select("author_name", "author_name_kana").mapInPandas(votes, "kanji string, sound string, partner string")
    counted = cast.groupBy("kanji", "sound").agg(F.countDistinct("partner").alias("n"))
    best = counted.groupBy("kanji").agg(F.max_by("sound", F.struct(F.col("n"), -F.length("sound"), F.col("sound"))).alias("sound"))
    return {r.kanji: r.sound for r in best.collect()}


def _kanji_counts(authors: DataFrame) -> DataFrame:
    letters = F.explode(F.split(F.regexp_replace("author_name", "[^㐀-鿿]", ""), ""))
    return authors.select(letters.alias("kanji")).where("kanji <> ''").groupBy("kanji").agg(F.count(F.lit(1)).alias("n"))


def candidate_pairs(keyed: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs of distinct forms ``(kind, whole_a, whole_b, key_a, key_b)`` whose keys share a shifted segment.

    ``keyed`` has ``kind, key, whole``. Equal forms need no search and are not paired here. An exchange
    of neighbours that lies across a border of segments changes both; for it each border gives one more
    piece, the whole key with the two characters at the border in order of their code points. Those pieces
    have numbers below 0 and go through the same join.
    """
    k = edits
    size = lambda n, s: F.floor((s + 1) * n / (k + 1)) - F.floor(s * n / (k + 1))
    at = lambda n, s: F.floor(s * n / (k + 1))
    distinct = keyed.select("kind", "key", "whole").distinct().withColumn("n", F.length("key"))
    index = distinct.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(k)))).select(
        "kind", F.col("n").alias("m"), "s", F.substring("key", (at(F.col("n"), F.col("s")) + 1).cast("int"), size(F.col("n"), F.col("s")).cast("int")).alias("piece"), F.col("key").alias("key_b"), F.col("whole").alias("whole_b")
    )
    probes = (
        distinct.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - k), F.col("n") + k)))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(k))))
        .withColumn("d", F.explode(F.sequence(F.lit(-k), F.lit(k))))
        .withColumn("from", (at(F.col("m"), F.col("s")) + F.col("d")).cast("int"))
        .where(F.col("from") >= 0)
        .select("kind", "m", "s", F.substring("key", F.col("from") + 1, size(F.col("m"), F.col("s")).cast("int")).alias("piece"), F.col("key").alias("key_a"), F.col("whole").alias("whole_a"))
        .where("piece <> ''")
    )
    bordered = distinct.where(F.col("n") >= 2).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("b", at(F.col("n"), F.col("s")).cast("int")).where("b >= 1")
    two = [F.substring("key", F.col("b") + i, F.lit(1)) for i in (0, 1)]
    level = F.concat(F.expr("substring(key, 1, b - 1)"), F.least(*two), F.greatest(*two), F.expr("substring(key, b + 2)"))
    crossed = lambda x: bordered.select("kind", F.col("n").alias("m"), (-F.col("s")).alias("s"), level.alias("piece"), F.col("key").alias(f"key_{x}"), F.col("whole").alias(f"whole_{x}"))
    # Sizes are estimated from the file of authors, before names become many pieces, and would let the driver broadcast them.
    met = probes.unionByName(crossed("a")).hint("merge").join(index.unionByName(crossed("b")), ["kind", "m", "s", "piece"]).where("key_a < key_b").select("kind", "key_a", "whole_a", "key_b", "whole_b")
    # The built-in distance is banded by its threshold; an exchange of neighbours counts two there.
    # It comes before the duplicates are removed, so only near pairs are shuffled again.
    apart = F.levenshtein("key_a", "key_b", k + 1)
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    return met.where(apart.between(0, k) | ((apart == k + 1) & (letters("key_a") == letters("key_b")))).distinct()


def _year(value: float | None) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def _years_agree(a: tuple, b: tuple) -> bool | None:
    """False if life years differ, True if one is equal, None if nothing can be compared."""
    seen = None
    for x, y in zip(a, b, strict=True):
        if x is not None and y is not None:
            if x != y:
                return False
            seen = True
    return seen


def _judge(kind: str, a: str, b: str, years: bool | None, kana_a: str, kana_b: str, slips: frozenset[str], mixed: bool) -> str | None:
    """"strong", "weak" or None for two rows that share a form of this kind (``a``, ``b`` its wholes)."""
    if years is False:
        return None
    same = a == b
    if kind[0] == "O":
        if same:
            return "strong"
        return "strong" if len(a) >= 3 and edits_at_most(a, b, 1) <= 1 and (a.isascii() or any(c in slips for c in set(a) ^ set(b)) or sorted(a) == sorted(b)) else None
    if kind == "K":
        if same:
            return "strong"
        if edits_at_most(a, b, 1) > 1:
            return None
        if sorted(a) == sorted(b) or any(c in slips for c in set(a) ^ set(b)):
            return "strong"
        if kana_a and kana_b:
            return "strong" if kana_a == kana_b and years else None
        return "weak" if years and abs(len(a) - len(b)) == 1 else None
    if kind == "P":
        return "weak" if same else None
    if kind[0] == "L":
        if mixed:
            near = edits_at_most(a, b, 1)
            return "weak" if near <= 1 else None
        if same:
            return "strong"
        return "strong" if len(a) >= 9 and edits_at_most(a, b, 1) <= 1 else None
    return "weak" if same else None


def _is_latin(name: str) -> bool:
    return not re.search("[぀-ヿ㐀-鿿]", name)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every id of a task's links ``a, b`` with the smallest id that these links lead it to."""
    parts = [batch[["a", "b"]].to_numpy(dtype="int64") for batch in batches]
    if not parts:
        return
    links = np.concatenate(parts)
    ids, ends = np.unique(links, return_inverse=True)
    x, y = ends.reshape(links.shape).T
    root = np.arange(len(ids))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((up := root[root]) != root).any():
            root = up
    yield pd.DataFrame({"id": ids, "group": ids[root]})


def _components(links: DataFrame) -> DataFrame:
    """``id, group`` of links ``a, b``, which are counted first: a group has its smallest id.

    Each task joins its share of the links. If there are several shares, the smallest ids are spread over
    what the tasks found until nothing changes. What a row hears goes to its group's row too, and every row
    then takes its group's group, so the rounds grow with the logarithm of a chain's length.
    """
    tasks = ceil(links.count() / LINKS_A_TASK)
    dealt = links.select("a", "b").repartition(tasks) if tasks > 1 else links.select("a", "b").coalesce(1)
    found = cut_lineage(dealt.mapInPandas(_forest, "id long, group long"))
    if tasks <= 1:
        return found
    both = cut_lineage(found.select("id", F.col("group").alias("other")).unionByName(found.select(F.col("group").alias("id"), F.col("id").alias("other"))).distinct())
    labels = cut_lineage(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("group")))
    while True:
        heard = cut_lineage(labels.join(both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("group").alias("heard")), "id"))
        offers = heard.select("id", F.least("group", "heard").alias("group")).unionByName(heard.select(F.col("group").alias("id"), F.least("group", "heard").alias("group")))
        told = cut_lineage(offers.groupBy("id").agg(F.min("group").alias("told")))
        jumped = told.join(told.select(F.col("id").alias("told"), F.col("told").alias("next")), "told").select("id", F.least("told", "next").alias("now"))
        after = cut_lineage(labels.join(jumped, "id").select("id", F.col("now").alias("group"), (F.col("now") < F.col("group")).alias("moved")))
        labels = after.select("id", "group")
        if not after.where("moved").limit(1).count():
            return labels


def name_groups(authors: DataFrame) -> DataFrame:
    """``id, group, birth, death`` of the rows that share a name with another; a group has the id of its first row."""
    learned = learn_readings(authors)
    rows = authors.where("author_id IS NOT NULL AND author_name IS NOT NULL AND trim(author_name) <> ''").select(
        F.col("author_id").cast("long").alias("id"), F.col("author_name").alias("name"), F.coalesce("author_name_kana", F.lit("")).alias("kana"), F.coalesce("alias_info", F.lit("")).alias("alias"), F.col("birth_year").alias("birth"), F.col("death_year").alias("death")
    )

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, n, k, a, born, died in zip(*(batch[c].tolist() for c in ("id", "name", "kana", "alias", "birth", "death")), strict=True):
                facts = (_is_latin(n), bool(re.search("[ぁ-ゖァ-ヶ]", n)), k, _year(born), _year(died))
                out += [(i, *f, *facts) for f in dict.fromkeys(forms(n, k, a, learned))]
            if out:
                yield frame(["id", "kind", "key", "whole", *FACTS], out)

    # What is judged goes with the forms, so that pairs need not look their rows up again.
    spelled = cut_lineage(rows.mapInPandas(spell, "id long, kind string, key string, whole string, latin boolean, in_kana boolean, kana string, birth long, death long"))
    # A row that has an initial only looks for rows whose full name has it ("i" finds "I").
    probing = spelled.withColumn("weak_side", F.col("kind").startswith("i")).withColumn("kind", F.when(F.col("kind").startswith("i"), F.concat(F.lit("I"), F.substring("kind", 2, 1))).otherwise(F.col("kind")))
    searched = probing.where(~F.col("kind").startswith("P"))
    # Read twice below, and its plan would double with every use.
    near = cut_lineage(candidate_pairs(searched).unionByName(probing.select("kind", F.col("key").alias("key_a"), F.col("whole").alias("whole_a"), F.col("key").alias("key_b"), F.col("whole").alias("whole_b")).distinct()))

    side = lambda s, rows: rows.select("kind", F.col("key").alias(f"key_{s}"), F.col("whole").alias(f"whole_{s}"), F.struct("id", *FACTS, "whole").alias(s))
    # An initial is shared by a great many full names: only rows that have no more than it look for them.
    initial = F.col("kind").startswith("I")
    swapped = near.where(initial & (F.col("key_a") < F.col("key_b"))).select("kind", F.col("key_b").alias("key_a"), F.col("whole_b").alias("whole_a"), F.col("key_a").alias("key_b"), F.col("whole_a").alias("whole_b"))
    looking = side("a", probing.where(~initial | F.col("weak_side")))
    met = near.unionByName(swapped).join(looking.hint("merge"), ["kind", "key_a", "whole_a"]).join(side("b", probing).hint("merge"), ["kind", "key_b", "whole_b"]).where("a.id <> b.id")
    lower = F.col("a.id") < F.col("b.id")
    ordered = met.select("kind", F.when(lower, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("y"))
    pairs = ordered.select("kind", *(F.col(f"{side}.{c}").alias(f"{c}_{s}") for side, s in (("x", "a"), ("y", "b")) for c in ("id", "whole", *FACTS))).distinct()
    # One row a kanji, however many names there are.
    counts = {r.kanji: r.n for r in _kanji_counts(authors).collect()}
    average = sum(counts.values()) / max(1, len(counts))
    slips = frozenset(c for c, n in counts.items() if n < SLIP_SHARE * average)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                years = _years_agree((_year(r.birth_a), _year(r.death_a)), (_year(r.birth_b), _year(r.death_b)))
                mixed = r.latin_a != r.latin_b
                if r.kind[0] in "LI" and not r.latin_a and not r.latin_b:
                    # Two Japanese names of one reading: only if one is written in kana, at least in part.
                    if not r.in_kana_a and not r.in_kana_b:
                        continue
                    mixed = True
                verdict = _judge(r.kind, r.whole_a, r.whole_b, years, r.kana_a, r.kana_b, slips, mixed)
                if verdict == "weak" and years and (r.kind[0] in "LP" or r.kana_a and r.kana_a == r.kana_b):
                    verdict = "strong"
                if verdict:
                    out.append((r.id_a, r.id_b, verdict))
            if out:
                yield frame(["a", "b", "verdict"], out)

    links = cut_lineage(pairs.mapInPandas(judge, "a long, b long, verdict string").groupBy("a", "b").agg(F.min("verdict").alias("verdict")))
    strong = links.where("verdict = 'strong'").select("a", "b")
    groups = _components(strong)
    # A weak link counts if it leads its poorer row to one group only.
    weak = links.where("verdict = 'weak'").select("a", "b")
    of = lambda s: groups.select(F.col("id").alias(s), F.col("group").alias(f"g{s}"))
    ends = weak.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb")
    facing = ends.select(F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("gb").alias("h")), F.struct(F.col("gb").alias("g"), F.col("ga").alias("h")))).alias("x")).select("x.g", "x.h")
    single = cut_lineage(facing.groupBy("g").agg(F.min("h").alias("h"), F.max("h").alias("last")).where("h = last").select(F.col("g").alias("a"), F.col("h").alias("b")))
    final = _components(strong.unionByName(single))
    return final.join(rows.select("id", "birth", "death"), "id")


def same_names(authors: DataFrame) -> DataFrame:
    """All pairs ``author_id_a < author_id_b`` of rows that mean the same person or organisation."""
    member = name_groups(authors)
    x, y = (member.select("group", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "birth", "death"))) for s in "xy")
    return (
        x.join(y, "group")
        .where("id_x < id_y AND NOT coalesce(birth_x <> birth_y, false) AND NOT coalesce(death_x <> death_y, false)")
        .select(F.col("id_x").alias("author_id_a"), F.col("id_y").alias("author_id_b"))
    )
