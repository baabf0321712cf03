"""Template residue and error-page text (problem 10).

Labelled exemplars of residue, phrases of a few terms (:mod:`fumiyori.llm.exemplars`), are kept
in an inverted index. Terms are words of spaced scripts, character pairs of spaceless ones,
status codes, and one sign for every placeholder. Passages are the sentences of a document's
lines. Only an exemplar's rarer terms are posted: as a passage must hold most of the
exemplar's terms, it must hold one of these, so nothing is missed by posting no others.

A retrieved exemplar *matches* where a window of the passage, hardly wider than the exemplar,
contains :data:`EXEMPLAR_SHARE` of its TF-IDF mass. The passage is residue

* if terms of that label, or of what goes with notices, make up :data:`WINDOW_SHARE` of it; or
* if the exemplar is nothing that ordinary text says, it stands at an end of the passage or is
  long, and nothing around it speaks of it as a notice (exemplars of such speech are indexed too).

A placeholder counts unless the words around it speak of placeholders; a run of words of blind
text counts anywhere. Document frequencies are counted over all passages of all documents, in
the same pass that retrieves the candidates.

Defined results: null, empty and blank texts have no passage and are no cases; repeated
documents each come out; texts of any length are covered passage by passage. ``window`` is the
passage in the form it is compared in (narrow, lower case, placeholders as one sign).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyori.llm import exemplars as E
from fumiyori.llm.frames import frame
from fumiyori.operators.sizing import spread
from fumiyori.session import cut_lineage

#: Share of a passage's mass that the label's terms must hold, and of an exemplar's mass that a window must.
WINDOW_SHARE, EXEMPLAR_SHARE = 0.8, 0.85
#: Terms of the shortest exemplar that counts beside other text, and of one that counts amid it.
EDGE_TERMS, AMID_TERMS = 3, 7
#: Terms of the passage window that is held against a vocabulary of blind text.
BLIND_TERMS = 4

_SLOT = re.compile(r"\{\{[^{}\n]+\}\}|[$#]\{[^{}\n]+\}|%%\s*[\w.]+\s*%%|@@\s*[\w.]+\s*@@|<%[^%<>\n]+%>|\{%[^%{}\n]+%\}")
_WEAK_SLOT = re.compile(r"\[\[([^\[\]\n]+)\]\]|<<([^<>\n]+)>>|__([A-Za-z][A-Za-z0-9_.]*?)__|\[(?![＃#])([^\[\]\n]+)\]|<([A-Z]{2,}(?:_[A-Z]+)*|[a-z]+[_ ][a-z_ ]+)>|%([A-Z]{2,}(?:_[A-Z]+)*)%|｛([^｛｝\n]+)｝|\{([A-Za-z_][\w. ]*)\}")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ASKING = re.compile(r"【([^【】\n]*)】")
_BREAK = re.compile(r"[\r\n\u0085  \x0b\x0c]+")
_END = re.compile(r"(?<=[。!?])|(?<=[.])(?=\s)")
_TERM = re.compile(r"[^\W\d_぀-ヿ㐀-鿿豈-﫿]+|\d+|[぀-ヿ㐀-鿿豈-﫿]+|[§¤¢]|#\d{3}(?!\d)")
_HIDDEN = re.compile("[­͏​-‏⁠﻿︀-️]")
_STATUS = frozenset("400 401 403 404 405 408 410 429 500 501 502 503 504".split())
_OPEN, _CLOSE = "「『“„«‹", "」』”»›"


def folded(text: str) -> str:
    """The form in which texts are compared; placeholders become one sign, doubtful brackets another before their words."""
    text = text.replace("§", " ").replace("¤", " ").replace("¢", " ")
    if "{" in text or "%" in text or "@@" in text or "<" in text or "[" in text or "__" in text or "｛" in text or "【" in text:
        text = _SLOT.sub(" § ", text)
        text = _WEAK_SLOT.sub(lambda m: " ¤ " + _HUMP.sub(" ", m.group(m.lastindex).replace("_", " ")) + " ", text)
        text = _ASKING.sub(r" ¢ \1 ", text)
    return unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold()


def placed_terms(passage: str) -> Iterator[tuple[str, int, int]]:
    """The terms of a folded passage in order, with their places."""
    for m in _TERM.finditer(passage):
        token, at = m.group(), m.start()
        if token[0].isdigit():
            yield ("#" + token if token in _STATUS else "0"), at, m.end()
        elif len(token) == 1 or token[0] == "#" or not ("぀" <= token[0] <= "鿿" or "豈" <= token[0] <= "﫿"):
            yield token, at, m.end()
        else:
            for i in range(len(token) - 1):
                yield token[i : i + 2], at + i, at + i + 2


def terms(passage: str) -> Counter[str]:
    """Term frequencies of a folded passage."""
    return Counter(t for t, _, _ in placed_terms(passage))


def term_set(passage: str) -> set[str]:
    """The distinct terms of a folded passage."""
    held: set[str] = set()
    for token in _TERM.findall(passage):
        if token[0].isdigit():
            held.add("#" + token if token in _STATUS else "0")
        elif len(token) == 1 or token[0] == "#" or not ("぀" <= token[0] <= "鿿" or "豈" <= token[0] <= "﫿"):
            held.add(token)
        else:
            held.update(map(add, token, token[1:]))
    return held


def passages(text: str | None) -> Iterator[tuple[str, bool]]:
    """The sentences of a text's lines in the form compared, and whether they begin within a quotation."""
    if not text:
        return
    for line in _BREAK.split(folded(text)):
        depth = 0
        for part in _END.split(line):
            if bare := part.strip():
                yield bare, depth > 0
            depth = max(0, depth + sum(part.count(c) for c in _OPEN) - sum(part.count(c) for c in _CLOSE))


def _within_quotation(passage: str, start: int, end: int) -> bool:
    """Whether a quotation of the passage, with words outside it, holds what lies between two places."""
    before, after = passage[:start], passage[end:]
    opened = max(map(before.rfind, _OPEN))
    if opened > max(map(before.rfind, _CLOSE)):
        closed = min((i for i in map(after.find, _CLOSE) if i >= 0), default=-1)
    else:
        opened, closed = (before.rfind('"'), after.find('"')) if before.count('"') % 2 else (-1, -1)
    return opened >= 0 and closed >= 0 and bool(_TERM.search(before[:opened]) or _TERM.search(after[closed:]))


class ResidueIndex:
    """The inverted index of exemplars: of residue, and of speech about it."""

    def __init__(self, patterns: dict[str, str] | None = None):
        self.labels: list[str] = []
        self.sure: list[bool] = []
        self.exemplars: list[Counter[str]] = []
        self.vocabulary: dict[str, set[str]] = {}
        around = set(terms(" \n".join(E.FURNITURE.split())))
        seen = set()
        for label, block in (patterns or E.PATTERNS).items():
            known = self.vocabulary.setdefault(label, set(around))
            phrases = [p for line in filter(None, map(str.strip, block.splitlines())) for p in E.expanded(line)]
            if label == "placeholder":
                phrases += [f"¤ {field}" for field in E.FIELDS] + [f"¢ {word}" for word in ("入力", "入れて", "未設定", "挿入", "記入", "未定")]
            for phrase in phrases:
                held = terms(phrase.lstrip("~").casefold())
                key = (label, phrase[0] != "~", frozenset(held.items()))
                if held and key not in seen:
                    seen.add(key)
                    self.labels.append(label)
                    self.sure.append(phrase[0] != "~")
                    self.exemplars.append(held)
                    known.update(held)
        shared = Counter(t for e in self.exemplars for t in e)
        common = around - {"javascript"}
        self.postings: dict[str, list[int]] = {}
        for k, exemplar in enumerate(self.exemplars):
            rare_first = sorted(exemplar, key=lambda t: (t in common, shared[t], t))
            for term in rare_first[: len(exemplar) - self.most(exemplar) + 1]:
                self.postings.setdefault(term, []).append(k)
        self.posted, self.least = frozenset(self.postings), list(map(self.most, self.exemplars))
        self.blind = {label: frozenset(w.casefold() for w in words) for label, words in E.VOCABULARIES.items()}
        self.spoken = {kind: [frozenset(terms(p)) for line in filter(None, map(str.strip, block.splitlines())) for p in E.expanded(line)] for kind, block in E.MENTIONS.items()}
        self.terms = frozenset(shared) | around
        self.weigh({}, 0)

    @staticmethod
    def most(exemplar: Counter[str]) -> int:
        """Distinct terms that are more than half of an exemplar's."""
        return len(exemplar) // 2 + 1

    def weigh(self, frequencies: dict[str, int], n_passages: int) -> None:
        """Sets the terms' weights from the numbers of passages that hold them; an unknown term weighs as much as the average."""
        self.weight = {t: max(0.1, math.log((n_passages + 2) / (frequencies.get(t, 0) + 1))) if n_passages else 1.0 for t in self.terms}
        self.other = sum(self.weight.values()) / max(1, len(self.weight))
        self.mass = [sum(n * self.weight[t] for t, n in e.items()) for e in self.exemplars]

    def retrieve(self, held: set[str]) -> list[int]:
        """Exemplars most of whose terms a passage holds."""
        near: set[int] = set()
        for t in held & self.posted:
            near.update(self.postings[t])
        return [k for k in near if len(held & self.exemplars[k].keys()) >= self.least[k]]

    def is_candidate(self, held: set[str]) -> bool:
        return any(len(held & words) >= BLIND_TERMS for words in self.blind.values()) or bool(self.retrieve(held))

    def match(self, passage: str, quoted: bool = False) -> str | None:
        """The label of the residue in a folded passage, if any."""
        row = list(placed_terms(passage))
        held = Counter(t for t, _, _ in row)
        for label, words in self.blind.items():
            if any(all(t in words for t, _, _ in row[i : i + BLIND_TERMS]) for i in range(len(row) - BLIND_TERMS + 1)):
                return label
        near = sorted(self.retrieve(set(held)), key=lambda k: -self.mass[k])
        total = sum(n * self.weight.get(t, self.other) for t, n in held.items())
        covered: dict[str, bool] = {}
        for k in near:
            label, exemplar = self.labels[k], self.exemplars[k]
            if label not in covered:
                covered[label] = sum(n * self.weight.get(t, self.other) for t, n in held.items() if t in self.vocabulary[label]) >= WINDOW_SHARE * total
            if not (covered[label] and not quoted or self.sure[k]):
                continue
            if sum(min(n, held[t]) * self.weight[t] for t, n in exemplar.items()) < EXEMPLAR_SHARE * self.mass[k]:
                continue
            for first, last in self._runs(row, k):
                if label == "placeholder":
                    if not self._spoken_of(row, first, last, ("placeholder",)):
                        return label
                elif not quoted and not _within_quotation(passage, row[first][1], row[last][2]) and (covered[label] or self._stands_out(row, k, first, last)):
                    return label
        return None

    def _runs(self, row: list[tuple[str, int, int]], k: int) -> Iterator[tuple[int, int]]:
        """(first, last term) of the windows that contain an exemplar."""
        exemplar = self.exemplars[k]
        n = sum(exemplar.values())
        width, past = n + max(1, n // 4), 0
        for at, (term, _, _) in enumerate(row):
            if at >= past and term in exemplar:
                left, mass = dict(exemplar), 0.0
                for last in range(at, min(len(row), at + width)):
                    if left.get(row[last][0], 0) > 0:
                        left[row[last][0]] -= 1
                        mass += self.weight[row[last][0]]
                        if mass >= EXEMPLAR_SHARE * self.mass[k]:
                            while last + 1 < len(row) and left.get(row[last + 1][0], 0) > 0:
                                last += 1
                                left[row[last][0]] -= 1
                            yield at, last
                            past = last + 1
                            break

    def _stands_out(self, row: list[tuple[str, int, int]], k: int, first: int, last: int) -> bool:
        """Whether a run is a notice beside other text: long or at an end, and not spoken of."""
        n = sum(self.exemplars[k].values())
        if not self.sure[k] or n < EDGE_TERMS:
            return False
        known, a, b = self.vocabulary[self.labels[k]], first, last
        while a > 0 and row[a - 1][0] in known:
            a -= 1
        while b + 1 < len(row) and row[b + 1][0] in known:
            b += 1
        if n < AMID_TERMS and a > 0 and b + 1 < len(row):
            return False
        return not self._spoken_of(row, first, last, ("placeholder", "notice"))

    def _spoken_of(self, row: list[tuple[str, int, int]], first: int, last: int, kinds: tuple[str, ...]) -> bool:
        rest = {t for t, _, _ in row[:first]} | {t for t, _, _ in row[last + 1 :]}
        return any(mention <= rest for kind in kinds for mention in self.spoken[kind])


def _candidates(index: ResidueIndex, documents: DataFrame) -> DataFrame:
    """``doc_id, passage, quoted`` of the retrieved passages, and rows ``term, n`` of passage counts, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                for passage, quoted in passages(text):
                    held = term_set(passage)
                    counts[""] += 1
                    counts.update(held & index.terms)
                    if index.is_candidate(held):
                        rows.append((doc, passage, quoted, None, None))
            if rows:
                yield frame(["doc_id", "passage", "quoted", "term", "n"], rows)
        if counts:
            yield frame(["doc_id", "passage", "quoted", "term", "n"], [(None, None, None, t, n) for t, n in counts.items()])

    rows = documents.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(spread(rows).mapInPandas(run, "doc_id long, passage string, quoted boolean, term string, n long"))


def residue_windows(documents: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, label, window`` of every passage of residue."""
    index = ResidueIndex(patterns)
    found = _candidates(index, documents)
    # One row a term of the exemplars.
    counts = {r.term: r.n for r in found.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    index.weigh(counts, counts.pop("", 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label_of = lru_cache(maxsize=50_000)(index.match)
        for batch in batches:
            rows = [(doc, label, p) for doc, p, q in zip(batch["doc_id"].tolist(), batch["passage"], batch["quoted"].tolist(), strict=True) if (label := label_of(p, q))]
            if rows:
                yield frame(["doc_id", "label", "window"], rows)

    return spread(found.where("doc_id IS NOT NULL").select("doc_id", "passage", "quoted")).mapInPandas(run, "doc_id long, label string, window string")
