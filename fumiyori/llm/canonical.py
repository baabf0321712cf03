"""Mapping free-entered place texts to the canonical list (problem 2), in SQL only.

A partition-based pigeonhole join. A reference string within ``k`` edits of a text
keeps at least one of its ``k + 1`` segments unchanged, shifted by at most ``k``
positions. The segments of the references are joined by equality with the substrings
of the texts at those positions; built-in ``levenshtein`` verifies the candidates.
What no reference accepts is reported through an anti-join.

Distinct texts are matched, not rows: a text that a third of all rows hold costs as
much as a rare one.

Defined results
---------------
* Texts that are null, empty or nothing but marks mean no canonical place (-1).
* A text that equals (in its consistent form) a canonical name, its base or an alias
  assigned to a canonical place means that place; one that equals another place means
  none; all others go to the closest reference within ``k`` edits, where ``k`` grows with
  the length of the reference. Of equally close places the one with the lowest
  ``master_id`` is taken.
* Repeated rows each get their own result row; empty tables give no rows; further
  columns are not read. Equality holds for texts of every length; what is left is compared
  only if its core is at most ``k`` characters longer than a name.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame

from fumiyori.session import cut_lineage

# Spellings that people use for the same thing.
OLD_FORMS = "龍竜 瀧滝 邊辺 邉辺 國国 櫻桜 澤沢 濱浜 嶋島 嶌島 峯峰 藏蔵 廣広 壽寿 驛駅 溫温 縣県 臺台 鄕郷 莊荘 關関 鐵鉄 舊旧 鹽塩 橫横 眞真 靜静 惠恵 戶戸 區区 圓円 淵渕 碕崎 﨑崎 嶺嶺 樓楼 學学 會会 神神 社社"
LATIN_LOOKALIKES = "аa еe оo рp сc хx уy іi ѕs јj һh кk тt мm вb нh ԁd ԛq ԝw αa εe οo ρp νv ιi κk τt υu χx ζz ηn βb μm"
INVISIBLE = "­͏​‌‍‎‏⁠﻿︎︀󠄀󠄁"
MARKS = "「」『』【】〔〕《》〈〉（）()[]“”„\"‘’*＊♪!！?？…"
REGION_PREFIX = r"^[^ ]{2,4}?(県|府|景勝区) *(?=.{2})"
LEAD_WORDS = r"^(旧|元|the |near |nr\.* ?|old |former |at |ex-)(?=.{2})"
NOTES = r"[（(][^（()）]*(現.?在.?地|near)[^（()）]*[）)]"
DOUBLED = r"([^ -~])\1+"
TAIL_WORDS = r"(市|付近|あたり|辺り|周辺|界隈|方面|地方|行き|駅前| region| area| district|,? *county)$"
ABBREVIATIONS = [
    (r"\bmt\b", "mount"), (r"\bmnt\b", "mount"), (r"^n\b", "north"), (r"^st\b(?= )", "saint"), (r"^s\b(?= )", "saint"), (r"^(north|port|mount) st\b(?= )", "$1 saint"),
    (r"\b(st|str)$", "street"), (r"\bpt\b", "port"), (r"\bp\b(?= )", "port"), (r"\b(sta|stn)$", "station"), (r"\b(hbr|harb|hrbr|harbor|harbr)$", "harbour"), (r"\b(cstl|cast|ctl)$", "castle"),
]

#: Edits by the length of the reference; an exchange of letters counts as one slip, though as two edits.
EDITS = "CASE WHEN {n} <= 3 THEN 1 WHEN {n} <= 11 THEN 2 ELSE 3 END"
#: Segments that must meet at once: in short references one segment is a character or two, which too many share.
AT_ONCE = "CASE WHEN {n} BETWEEN 3 AND 5 THEN 2 ELSE 1 END"


def _folding() -> tuple[str, str]:
    """Character map of the comparison form: pairs (from, to), then what is deleted."""
    pairs: dict[str, str] = {}
    for block in (range(0xFF01, 0xFF5F), range(0x2F00, 0x2FD6), range(0xF900, 0xFB00), range(0x2E80, 0x2EF4)):
        for code in block:
            folded = unicodedata.normalize("NFKC", chr(code)).lower()
            if len(folded) == 1 and folded != chr(code):
                pairs[chr(code)] = folded
    for code in range(0xC0, 0x250):
        folded = unicodedata.normalize("NFD", chr(code)).lower()
        if folded[0] != chr(code) and folded[0].isascii():
            pairs[chr(code)] = folded[0]
    for pair in OLD_FORMS.split() + LATIN_LOOKALIKES.split():
        if pair[0] != pair[1]:
            pairs[pair[0]] = pair[1]
    pairs |= {chr(c): " " for c in (0xA0, 0x3000, 0x202F, 0x205F, *range(0x2000, 0x200B))}
    pairs |= dict.fromkeys("‐‑‒–—−_.·", " ") | {"-": " "}
    deleted = INVISIBLE + "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + deleted, "".join(pairs.values())


def _quoted(text: str) -> str:
    """A SQL string; braces are doubled for the formatter of ``spark.sql``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def consistent_sql(column: str) -> str:
    """SQL expression: lower case, narrow, without accents and invisible characters; dots, bars and hyphens as blanks."""
    source, target = _folding()
    return f"trim(regexp_replace(translate(lower({column}), {_quoted(source)}, {_quoted(target)}), ' +', ' '))"


def core_sql(column: str) -> str:
    """SQL expression: what names the place in a consistent text, blanks between its words kept.

    Doubled characters of spaceless scripts, marks, notes in brackets, regions before and
    vague words around the name are taken away; short forms of words are written out.
    """

    def cut(x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)})"

    x = cut(cut(column, NOTES), DOUBLED, "$1")
    x = f"trim(translate({x}, {_quoted(MARKS)}, ''))"
    for _ in range(2):
        x = f"trim({cut(cut(x, LEAD_WORDS), TAIL_WORDS)})"
        x = f"trim({cut(x, REGION_PREFIX)})"
    x = cut(x, "[,・'ノのヶケ]", "")
    for short, long in ABBREVIATIONS:
        x = cut(x, short, long)
    return x


def shapes_sql(core: str) -> str:
    """SQL expression: the spellings of a core under which it is compared.

    Without blanks; with its words in alphabetical order; and its last word alone, where a
    spaceless script has a blank after something that is no known region.
    """
    return (
        f"array_distinct(array(replace({core}, ' ', ''), array_join(array_sort(split({core}, ' ')), ''), "
        f"CASE WHEN {core} RLIKE '[^ -~] [^ -~]+$' AND length(substring_index({core}, ' ', -1)) > 2 THEN substring_index({core}, ' ', -1) ELSE replace({core}, ' ', '') END))"
    )


def match_places(mentions: DataFrame, aliases: DataFrame, masters: DataFrame) -> DataFrame:
    """``source_table, source_id, master_id`` of every mention and alias without a master.

    ``master_id`` is the canonical place meant, or -1.
    """
    spark = mentions.sparkSession
    sql = lambda text, **frames: spark.sql(text, **frames)
    wanted = sql(
        """
        SELECT 'sentence_places' AS source_table, relation_id AS source_id, matched_text AS text FROM {m} WHERE master_id IS NULL
        UNION ALL
        SELECT 'place_aliases', alias_id, alias_name FROM {a} WHERE master_id IS NULL
        """,
        m=mentions,
        a=aliases,
    )
    # Every later step reads the forms; writing them once keeps the plans small and survives lost executors.
    texts = cut_lineage(sql(
        f"""
        SELECT text, form, explode({shapes_sql('c')}) AS core
        FROM (SELECT *, {core_sql('form')} AS c FROM (SELECT text, {consistent_sql('text')} AS form FROM (SELECT DISTINCT text FROM {{w}} WHERE text IS NOT NULL)))
        """,
        w=wanted,
    ))
    names = cut_lineage(sql(
        f"""
        SELECT *, {core_sql('form')} AS core, replace({core_sql('base')}, ' ', '') AS short
        FROM (SELECT master_id, {consistent_sql('canonical_name')} AS form, {consistent_sql('normalized_name')} AS base FROM {{p}} WHERE canonical_name IS NOT NULL)
        """,
        p=masters,
    ))
    assigned = sql(
        f"SELECT {consistent_sql('a.alias_name')} AS form, a.alias_type, a.master_id FROM {{a}} a JOIN {{n}} n ON a.master_id = n.master_id",
        a=aliases,
        n=names,
    )
    # Names as written, then bases, then assigned aliases: all mean the place when equal.
    equal = sql(
        f"""
        SELECT name, min_by(master_id, struct(rank, master_id)) AS master_id FROM (
            SELECT form AS name, 0 AS rank, master_id FROM {{n}}
            UNION ALL SELECT explode({shapes_sql('core')}), 1, master_id FROM {{n}}
            UNION ALL SELECT form, 2, master_id FROM {{a}}
            UNION ALL SELECT replace({core_sql('form')}, ' ', ''), 3, master_id FROM {{a}} WHERE alias_type = 'historical'
            UNION ALL SELECT short, 4, master_id FROM {{n}}
        ) WHERE name <> '' GROUP BY name
        """,
        n=names,
        a=assigned,
    )
    same = cut_lineage(sql(
        """
        SELECT text, min_by(master_id, struct(rank, master_id)) AS master_id FROM (
            SELECT t.text, e.master_id, 0 AS rank FROM {t} t JOIN {e} e ON t.form = e.name
            UNION ALL SELECT t.text, e.master_id, 1 FROM {t} t JOIN {e} e ON t.core = e.name
        ) GROUP BY text
        """,
        t=texts,
        e=equal,
    ))
    others = sql(
        f"""
        SELECT DISTINCT name FROM (
            SELECT explode(array(form, replace({core_sql('form')}, ' ', ''))) AS name FROM (SELECT {consistent_sql('display_name')} AS form FROM {{p}} WHERE canonical_name IS NULL)
        ) WHERE name <> ''
        """,
        p=masters,
    )
    elsewhere = sql("SELECT DISTINCT t.text FROM {t} t JOIN {o} o ON o.name = t.core UNION SELECT t.text FROM {t} t JOIN {o} o ON o.name = t.form", t=texts, o=others)
    left = sql(
        """
        SELECT text, core, length(core) AS n FROM {t} t
        WHERE core <> '' AND NOT EXISTS (SELECT 1 FROM {s} s WHERE s.text = t.text)
          AND NOT EXISTS (SELECT 1 FROM {o} o WHERE o.text = t.text)
        """,
        t=texts,
        s=same,
        o=elsewhere,
    )
    references = cut_lineage(sql(
        f"""
        SELECT ref, n, {EDITS.format(n='n')} AS k, {AT_ONCE.format(n='n')} AS m, min(master_id) AS master_id FROM (
            SELECT ref, length(ref) AS n, master_id FROM (
                SELECT explode({shapes_sql('core')}) AS ref, master_id FROM {{n}} UNION SELECT short, master_id FROM {{n}}
            ) WHERE ref <> ''
        ) GROUP BY ref, n
        """,
        n=names,
    ))
    # Of k + m segments, k edits leave m unchanged.
    single = sql(
        """
        SELECT ref, n, k, m, master_id, s, at, substring(ref, CAST(at AS INT) + 1, CAST(div((s + 1) * n, k + m) - at AS INT)) AS piece
        FROM (SELECT *, div(s * n, k + m) AS at FROM {r} LATERAL VIEW explode(sequence(0, k + m - 1)) AS s)
        """,
        r=references,
    )
    segments = sql(
        """
        SELECT ref, n, k, master_id, s, -1 AS s2, piece FROM {g} WHERE m = 1
        UNION ALL
        SELECT a.ref, a.n, a.k, a.master_id, a.s, b.s, a.piece || '/' || b.piece FROM {g} a JOIN {g} b ON a.ref = b.ref AND a.n = b.n AND a.s < b.s WHERE a.m = 2
        """,
        g=single,
    )
    shapes = sql("SELECT DISTINCT n, k, m, s, at, length(piece) AS w, reach FROM {g} LATERAL VIEW explode(sequence(n - k, n + k)) AS reach WHERE piece <> ''", g=single)
    shifted = sql(
        """
        SELECT text, core, h.n AS ref_n, h.k, h.m, h.s, d, substring(core, CAST(at + d AS INT) + 1, w) AS piece
        FROM {l} l JOIN {h} h ON l.n = h.reach
        LATERAL VIEW explode(sequence(-k, k)) AS d
        WHERE at + d >= 0 AND at + d + w <= l.n
        """,
        l=left,
        h=shapes,
    )
    # The pieces of a text that short references may meet are gathered in one row, so pairs of them need no join.
    windows = sql(
        """
        SELECT text, core, ref_n, s, -1 AS s2, piece FROM {w} WHERE m = 1
        UNION ALL
        SELECT text, core, ref_n, x.s, y.s, x.piece || '/' || y.piece
        FROM (SELECT text, core, ref_n, any_value(k) AS k, collect_set(struct(s, d, piece)) AS p FROM {w} WHERE m = 2 GROUP BY text, core, ref_n)
        LATERAL VIEW explode(p) AS x LATERAL VIEW explode(p) AS y
        WHERE x.s < y.s AND abs(x.d - y.d) <= k
        """,
        w=shifted,
    )
    candidates = sql(
        """
        SELECT w.text, w.core, g.ref, g.n, g.k, g.master_id
        FROM {w} w JOIN {g} g ON w.ref_n = g.n AND w.s = g.s AND w.s2 = g.s2 AND w.piece = g.piece
        UNION
        SELECT l.text, l.core, r.ref, r.n, r.k, r.master_id
        FROM {l} l JOIN {r} r ON l.n = r.n AND r.n <= 3 AND array_sort(split(l.core, '')) = array_sort(split(r.ref, ''))
        """,
        w=windows,
        g=segments,
        l=left,
        r=references,
    )
    # Two exchanged letters are one slip, though two edits; the shortest names bear one slip only.
    close = sql(
        """
        SELECT text, min_by(master_id, struct(slips, edits, abs(length(core) - n), master_id)) AS master_id FROM (
            SELECT *, CASE WHEN edits = 2 AND length(core) = n AND array_sort(split(core, '')) = array_sort(split(ref, '')) THEN 1 ELSE edits END AS slips
            FROM (SELECT *, levenshtein(core, ref, 3) AS edits FROM {c})
            WHERE edits BETWEEN 0 AND greatest(k, 2)
        ) WHERE slips <= k
        GROUP BY text
        """,
        c=candidates,
    )
    found = cut_lineage(sql("SELECT text, master_id FROM {s} UNION ALL SELECT text, master_id FROM {c}", s=same, c=close))
    return sql(
        """
        SELECT w.source_table, w.source_id, f.master_id FROM {w} w JOIN {f} f ON w.text = f.text
        UNION ALL
        SELECT w.source_table, w.source_id, -1L FROM {w} w WHERE NOT EXISTS (SELECT 1 FROM {f} f WHERE f.text = w.text)
        """,
        w=wanted,
        f=found,
    )
