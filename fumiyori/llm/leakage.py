"""Evaluation texts inside training texts (problem 9), by an FM-index per shard.

Texts are compared in a bare form: no markup, readings, case, width, blanks, punctuation
or invisible characters. Every shard of the corpus gets an FM-index (suffix array, Burrows-
Wheeler transform, wavelet matrix for ranks, sampled suffix positions). A passage of ``w``
characters of an item holds at least one of the item's aligned blocks of ``(w + 1) // 2``
characters, so these blocks are the phrases: backward search finds them, sampled positions
locate them, and each occurrence is extended to the longest passage around it.

Defined results: null, empty and bare-empty texts contain nothing; an item whose bare form
is empty is in no document; repeated documents are each reported; a passage counts from
half of the item's bare length (rounded up). Texts longer than a shard are indexed in
overlapping pieces, so nothing is cut off.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyori.llm.frames import frame
from fumiyori.operators.sizing import spread

#: Characters of one FM-index; a parameter of memory (some 60 bytes a character while it is built).
SHARD_CHARS = 1_000_000
#: Every how many text positions a suffix position is kept.
SAMPLE = 16
#: Items that step backwards side by side; characters of items that one pass over the corpus, and so one broadcast, looks for (a larger set takes several passes).
ITEMS_AT_ONCE, CHARS_PER_PASS = 5_000, 20_000_000
#: Cells of an item and its alignments that are compared at once.
CELLS = 4_000_000

_MARKUP = re.compile(r"《[^《》\n]*》|［＃[^［］]*］|\[#[^\[\]]*\]|<rt>[^<]*</rt>|<rp>[^<]*</rp>|</?[a-zA-Z][^<>]*>|&(?:nbsp|shy|zwnj|zwj|ensp|emsp);|\x1b\[[0-9;]*m")
_BARE = re.compile(r"[\W_]+")


def _without_comments(text: str) -> str:
    """``text`` without what stands between comment marks, over lines too."""
    kept, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        kept.append(text[at:start])
        at = end + 3
    return "".join([*kept, text[at:]])


def bare(text: str | None) -> str:
    """What is compared of a text."""
    if not text:
        return ""
    x = _MARKUP.sub("", _without_comments(text))
    return _BARE.sub("", unicodedata.normalize("NFKC", x).casefold())


def _suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; ``codes`` ends with a unique smallest symbol."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    span = max(1, 60 // bits)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(span, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(span):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        if span < n:
            ahead[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + ahead
        span *= 2


class _Bits:
    """A bit vector with constant-time ranks: 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Backward search and locate over an integer text; all queries are vectorised."""

    def __init__(self, codes: np.ndarray, sample: int = SAMPLE):
        suffixes = _suffix_array(codes)
        n = len(codes)
        transform = codes[suffixes - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes))]).astype(np.int64)
        self.height = max(1, int(codes.max()).bit_length())
        self.levels: list[tuple[_Bits, int]] = []
        row = transform
        for level in range(self.height - 1, -1, -1):
            ones = ((row >> level) & 1).astype(bool)
            self.levels.append((_Bits(ones), int(n - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
        kept = suffixes % sample == 0
        self.kept, self.positions, self.n = _Bits(kept), suffixes[kept], n

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before ``at``."""
        low, high = np.zeros_like(at), at
        for depth, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.height - 1 - depth)) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases; the phrases step backwards side by side."""
        size = np.array([len(p) for p in phrases], np.int64)
        table = np.zeros((len(phrases), int(size.max(initial=0))), np.int64)
        for i, phrase in enumerate(phrases):
            table[i, : len(phrase)] = phrase[::-1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(table.shape[1]):
            live = np.flatnonzero((step < size) & (low < high))
            if not len(live):
                break
            symbol = table[live, step]
            low[live] = self.starts[symbol] + self.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to a sampled one."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            hit = self.kept.get(here)
            found[open_[hit]] = self.positions[self.kept.rank(here[hit])] + steps[open_[hit]]
            open_ = open_[~hit]
            if len(open_):
                at = rows[open_]
                symbol, where = np.zeros_like(at), at
                for bits, zeros in self.levels:
                    one = bits.get(where)
                    ahead = bits.rank(where)
                    symbol = (symbol << 1) | one
                    where = np.where(one, zeros + ahead, where - ahead)
                rows[open_] = self.starts[symbol] + self.rank(symbol, at)
                steps[open_] += 1
        return found


class Phrases:
    """The bare items and the blocks that stand for their passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, text) for i, text in items if text]
        self.need = [(len(text) + 1) // 2 for _, text in self.items]
        self.blocks = [(k, at) for k, (_, text) in enumerate(self.items) for at in range(0, len(text) - self.size(k) + 1, self.size(k))]
        self.longest = max((len(text) for _, text in self.items), default=0)

    def size(self, k: int) -> int:
        return max(1, (self.need[k] + 1) // 2)

    def find(self, shard: "Shard") -> Iterator[tuple[int, int, int, int]]:
        """(text number, item id, start, end) of the longest passage for each place an item occurs."""
        coded = [shard.code(text) for _, text in self.items]
        usable = [(k, at) for k, at in self.blocks if (coded[k][at : at + self.size(k)] > 0).all()]
        if not usable:
            return
        low, high = shard.index.search([coded[k][at : at + self.size(k)] for k, at in usable])
        counts = np.maximum(0, high - low)
        which = np.repeat(np.arange(len(usable)), counts)
        rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = shard.index.locate(rows)
        block_item, block_at = np.array([k for k, _ in usable]), np.array([a for _, a in usable])
        alignments = np.unique(np.stack([block_item[which], places - block_at[which]]), axis=1)
        borders = np.flatnonzero(np.diff(alignments[0], prepend=-1, append=-1))
        for first, last in zip(borders[:-1], borders[1:], strict=True):
            k = int(alignments[0, first])
            yield from self._extend(shard, k, coded[k], alignments[1, first:last])

    def _extend(self, shard: "Shard", k: int, item: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Passages of an item at its alignments with the text."""
        some, n, codes, ends = max(1, CELLS // len(item)), len(shard.codes), shard.codes, shard.ends
        for begin in range(0, len(shifts), some):
            part = shifts[begin : begin + some]
            at = part[:, None] + np.arange(len(item))
            inside = (at >= 0) & (at < n)
            same = np.zeros((len(part), len(item) + 2), np.int8)
            same[:, 1:-1] = (codes[np.where(inside, at, 0)] == item) & inside
            edge = np.diff(same, axis=1)
            (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            long = b - a >= self.need[k]
            start, size = part[row[long]] + a[long], (b - a)[long]
            text = np.searchsorted(ends, start, side="right")
            start = start - np.where(text > 0, ends[text - 1], 0)
            for t, x, y in zip(text.tolist(), start.tolist(), (start + size).tolist(), strict=True):
                yield t, self.items[k][0], x, y


class Shard:
    """The FM-index of some bare texts."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer(("\x01".join(texts) + "\x01").encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(raw, return_inverse=True)
        self.codes = np.append(codes.astype(np.int64) + 1, 0)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.index = FMIndex(self.codes)

    def code(self, text: str) -> np.ndarray:
        """The symbols of a text, -1 where the shard has none."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at + 1, -1)


def _pieces(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, with an overlap that no passage exceeds."""
    if len(text) <= size:
        yield 0, text
        return
    for start in range(0, max(1, len(text) - overlap), size - overlap):
        yield start, text[start : start + size]


def _search(documents: DataFrame, items: list[tuple[int, str]], shard_chars: int) -> DataFrame:
    groups = [Phrases(items[i : i + ITEMS_AT_ONCE]) for i in range(0, len(items), ITEMS_AT_ONCE)]
    longest = max((g.longest for g in groups), default=0)
    size = max(shard_chars, 4 * longest + 4)
    sent = documents.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: dict[str, list[tuple[int, int]]] = {}
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            # The index is built once; all groups of items pass it.
            texts = list(shard)
            index = Shard(texts)
            for phrases in sent.value:
                hits = {(doc, item, offset + a, offset + b) for t, item, a, b in phrases.find(index) for doc, offset in shard[texts[t]]}
                if hits:
                    yield frame(["doc_id", "item_id", "bare_start", "bare_end"], sorted(hits))

        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                for offset, piece in _pieces(bare(text), size, longest):
                    if piece not in shard:
                        if held and held + len(piece) > size:
                            yield from flush()
                            shard.clear()
                            held = 0
                        shard[piece] = []
                        held += len(piece) + 1
                    shard[piece].append((doc, offset))
        if shard:
            yield from flush()

    return spread(documents.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(run, "doc_id long, item_id long, bare_start long, bare_end long")


def leaked_passages(documents: DataFrame, items: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``doc_id, item_id, bare_start, bare_end`` of every passage of at least half an item.

    Items are read in slices of :data:`CHARS_PER_PASS` characters, so neither the driver nor a broadcast holds more.
    """
    rows = items.where("item_id IS NOT NULL AND item_text <> ''").select(F.col("item_id").cast("long"), "item_text").distinct()
    passes: list[DataFrame] = []
    part, held = [], 0
    for row in rows.toLocalIterator():
        part.append((row[0], bare(row[1])))
        held += len(part[-1][1])
        if held >= CHARS_PER_PASS:
            passes.append(_search(documents, part, shard_chars))
            part, held = [], 0
    if part or not passes:
        passes.append(_search(documents, part, shard_chars))
    return reduce(DataFrame.unionByName, passes)


def merge_spans(passages: DataFrame) -> DataFrame:
    """``doc_id, bare_start, bare_end`` of the stretches to remove: overlapping passages joined."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("bare_start", "bare_end")
    reach = F.max("bare_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = passages.select("doc_id", "bare_start", "bare_end").distinct().withColumn("fresh", F.when(reach >= F.col("bare_start"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("doc_id", "island").agg(F.min("bare_start").alias("bare_start"), F.max("bare_end").alias("bare_end")).drop("island")
