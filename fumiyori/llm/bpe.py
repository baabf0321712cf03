"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Exact merges in linear time: the bytes of a piece, mapped to Latin-1 characters, are
searched with an Aho-Corasick automaton of the whole vocabulary. From left to right the
longest token that fits is taken; two neighbours *fit* if their joint bytes encode to just
these two tokens, which is remembered per pair. Where nothing fits, the last token gives
way to its next shorter prefix; a position proved dead is never entered again. A row of
pairwise fitting tokens is what the merges yield.

Defined results: empty and null texts give an empty list; lone surrogates cannot occur in
Parquet strings; special-token strings inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import os

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumiyori.operators.sizing import spread

#: Folder of the vocabulary files; a parameter, never part of the repository.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pieces whose ids, and pairs whose fit, one worker remembers; at the bound the memory starts anew (speed only).
PIECE_MEMORY, PAIR_MEMORY = 200_000, 1_000_000
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes texts by longest matches and remembered compatibility of neighbours."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {rank: raw for raw, rank in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for raw, rank in ranks.items():
            self.automaton.add_word(raw.decode("latin_1"), (rank, len(raw)))
            for cut in range(len(raw) - 1, 0, -1):
                if raw[:cut] in ranks:
                    self.shorter[rank] = ranks[raw[:cut]]
                    break
        self.automaton.make_automaton()
        self.length = {rank: len(raw) for raw, rank in ranks.items()}
        self.fit: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids by merging the pair of lowest rank again and again (for short strings)."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side in an encoding."""
        pair = (left, right)
        found = self.fit.get(pair)
        if found is None:
            if len(self.fit) >= PAIR_MEMORY:
                self.fit.clear()
            found = self.fit[pair] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return found

    def encode_bytes(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None and len(raw) <= 2:
            return [whole]
        longest: list[int] = [-1] * len(raw)
        reach = [0] * len(raw)
        for end, (rank, size) in self.automaton.iter(raw.decode("latin_1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, rank
        ids: list[int] = []
        dead = bytearray(len(raw) + 1)
        at, candidate, fit = 0, longest[0], self.fits
        while True:
            while candidate >= 0:
                after = at + self.length[candidate]
                if not dead[after] and (not ids or fit(ids[-1], candidate)):
                    break
                candidate = self.shorter.get(candidate, -1)
            if candidate >= 0:
                ids.append(candidate)
                at = after
                if at == len(raw):
                    return ids
                candidate = longest[at]
            else:
                # No token leads on from here: the one before must be shorter.
                dead[at] = 1
                last = ids.pop()
                at -= self.length[last]
                candidate = self.shorter.get(last, -1)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= PIECE_MEMORY:
                    known.clear()
                ids = self.encode_bytes(piece.encode("utf_8"))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def token_ids(column: Column, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Column of id lists (Arrow batches)."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(encoder(path).encode)

    return encode(column)


def encode_corpus(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), folder=folder).alias("ids"))
