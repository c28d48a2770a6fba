"""Encoding with a public byte-pair vocabulary: exact merges in linear time by backtracking over longest matches.

A vocabulary of ranks defines one encoding of each piece of text: the one that repeated merging of the lowest-ranked
pair gives. Instead of merging, an Aho-Corasick automaton gives the longest token at a position and shorter ones by a
prefix table; a token may follow another only if the two are compatible, that is if merging their joined bytes gives
back just these two. A wrong turn is undone step by step, and positions that proved dead are never entered again, so the
work is linear in the piece. Decoding copies slices of one byte table found by offsets.

Defined ids: null and empty texts have no ids (an empty list). Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every entry point.
TOKENIZER_FOLDER = os.environ.get("RAMAGEM_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k"
# Fixed value: the published pattern that splits text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces a worker remembers; a bound on memory, without effect on results.
REMEMBERED_PIECES = 200_000
#: Longer pieces are not remembered.
LONG_PIECE = 64


class Vocabulary:
    """Tokens by rank, the automaton over them, and the tables for prefixes and pair compatibility."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.trie = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.trie.add_word(t.decode("latin-1"), i)
        self.trie.make_automaton()
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = b"".join(tokens)
        self._split_tokens()
        self._shorter_tokens()
        self.known: dict[str, tuple[int, ...]] = {}

    def _shorter_tokens(self) -> None:
        """The longest token that is a proper prefix of each token, or -1."""
        self.shorter = [-1] * len(self.tokens)
        for i, t in enumerate(self.tokens):
            for n in range(len(t) - 1, 0, -1):
                j = self.rank.get(t[:n])
                if j is not None:
                    self.shorter[i] = j
                    break

    def _split_tokens(self) -> None:
        """The two tokens whose merge gives each token: merges of lower rank leave exactly two parts."""
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.parts.append((i, i))
                continue
            pieces = self._merge_below(t, i)
            if len(pieces) != 2:
                self.parts.append((i, i))  # never made by merges; only matched as whole
                continue
            pair = (self.rank[pieces[0]], self.rank[pieces[1]])
            self.parts.append(pair)
            self.merged[pair] = i

    def _merge_below(self, token: bytes, limit: int) -> list[bytes]:
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            ranked = [(self.rank.get(a + b, limit), n) for n, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            best, n = min(ranked)
            if best >= limit:
                break
            pieces[n : n + 2] = [pieces[n] + pieces[n + 1]]
        return pieces

    @lru_cache(maxsize=1 << 20)  # noqa: B019
    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        Unmake the younger of the two facing tokens again and again: a merge across the border that is older than what
        it would have had to wait for proves them incompatible.
        """
        merged, parts = self.merged, self.parts
        bound = len(parts)
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                bound = left
                inner = parts[left][1]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1
                inner = parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound = right + 1
                inner = parts[right][0]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = parts[left][1]
                if inner == left:
                    return True
                left = inner

    def _longest(self, text: str, size: int) -> list[int]:
        """The longest token that begins at each position (bytes as Latin-1 text)."""
        best = [-1] * size
        lengths = self.lengths
        for end, token in self.trie.iter(text):
            # matches come by their end, longest first or not: keep the longest for the start
            start = end - lengths[token] + 1
            now = best[start]
            if now < 0 or lengths[now] < lengths[token]:
                best[start] = token
        return best

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(raw)
        if whole is not None and (len(raw) == 1 or self.parts[whole][0] != whole):
            return [whole]
        size = len(raw)
        text = raw.decode("latin-1")
        longest, lengths, shorter, compatible = self._longest(text, size), self.lengths, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_at[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == size:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this position is dead, shorten the token before
                open_at[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in _splitter().findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= LONG_PIECE:
                    if len(known) >= REMEMBERED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        offsets, table = self.offsets, self.bytes
        return b"".join(table[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _splitter():
    return regex.compile(PATTERN)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 as is, all others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def load_vocabulary(name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_FOLDER) -> Vocabulary:
    """A byte-level vocabulary from its rank file, else from its JSON file."""
    ranks = os.path.join(folder, f"{name}.tiktoken")
    if os.path.exists(ranks):
        with open(ranks, "rb") as lines:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
        return Vocabulary([token for _, token in pairs])
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as source:
        held = json.load(source)
    special = {t["content"] for t in held.get("added_tokens", ())}
    alphabet = _byte_alphabet()
    words = sorted((i, t) for t, i in held["model"]["vocab"].items() if t not in special)
    return Vocabulary([bytes(alphabet[c] for c in t) for _, t in words])


def encoded(documents: DataFrame, name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_FOLDER, key: str = "doc_id") -> DataFrame:
    """(key, ids) for documents (key, text); one row for each row, repeated keys too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(name, folder)
        for batch in batches:
            ids = pa.array([vocabulary.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=[key, "ids"])

    return documents.select(key, "text").mapInArrow(run, f"{key} bigint, ids array<int>")


def token_counts(documents: DataFrame, name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_FOLDER, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens) for documents (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(name, folder)
        for batch in batches:
            counts = pa.array([len(vocabulary.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), counts], names=[key, "n_tokens"])

    return documents.select(key, "text").mapInArrow(run, f"{key} bigint, n_tokens bigint")


def decoded(ids: DataFrame, name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_FOLDER, key: str = "doc_id") -> DataFrame:
    """(key, text) for rows (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(name, folder)
        for batch in batches:
            texts = pa.array([vocabulary.decode(x) if x is not None else None for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), texts], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} bigint, text string")
