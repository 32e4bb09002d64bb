"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

A word's symbols form a doubly linked list, its adjacent pairs that have a merge rank lie in a heap. The pair of lowest rank (the
leftmost of equals) is popped and merged until none is left; the word has as many tokens as it had symbols, less the merges. The
library of the vocabulary file normalises and splits new words; each distinct word between white space is merged once while it stays
in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, worker_cache

#: Unicode White_Space, which is what the normaliser's \\s means; it becomes one space and tokens never cross it.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Words of printable ASCII and Latin-1 letters need no library: composed already, and their lower case is one character for one.
_LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_LATIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # the library pattern that _PIECES stands for


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable, else the next free character from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when all ranked pairs are merged, lowest rank first."""
    n = len(symbols)
    if n < 2:
        return n
    text, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(text, text[1:])) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if text[i] is None or j < 0 or (text[i], text[j]) != pair:
            continue  # one side was merged meanwhile
        text[i], text[j] = pair[0] + pair[1], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        merges += 1
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0:
                new = (text[left], text[after[left]])
                if new in ranks:
                    heapq.heappush(heap, (ranks[new], left, new))
    return n - merges


class PairCounter:
    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a byte-pair vocabulary of the kind this counter knows")
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in reversed(list(enumerate(model["merges"])))}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.latin = any(p.get("pattern", {}).get("Regex") == _LATIN_SPLIT for p in spec["pre_tokenizer"].get("pretokenizers", []))
        self.symbols = byte_symbols()
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.limit = limit

    def _piece(self, symbols: str) -> int:
        n = self.pieces.get(symbols)
        if n is None:
            if len(self.pieces) > self.limit:
                self.pieces = dict(islice(self.pieces.items(), self.limit // 2))
            n = self.pieces[symbols] = merged_count([*symbols[:-1], symbols[-1] + self.suffix], self.ranks)
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.latin and _LATIN.fullmatch(text):
            pieces = _PIECES.findall(text.lower())
            if not text.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.symbols) for p in pieces]
        else:
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return sum(map(self._piece, pieces))

    def _word(self, word: str) -> int:
        """Tokens of a run without white space; a special string in it is one token."""
        if self.special is None or not self.special.search(word):
            return self._plain(word)
        return sum(self._plain(x) for x in self.special.split(word) if x) + len(self.special.findall(word))

    def count(self, text: str) -> int:
        words, known = SPACE.split(text), self.words
        for w in set(words).difference(known):
            known[w] = self._word(w) if w else 0
        total = sum(map(known.__getitem__, words))
        if len(known) > self.limit:  # the oldest entries are mostly the frequent ones
            self.words = dict(islice(known.items(), self.limit // 2))
        return total


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text): whole texts, null is empty, repeated rows stay apart.

    A null id stays null; other columns are ignored, whatever their names; an empty table gives an empty result."""

    def count(it):
        counter = worker_cache("pair counts", tokenizer_path, lambda: PairCounter(tokenizer_path))
        for rows in batches(it, ["doc_id", "text"]):
            n = [counter.count(t or "") for _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len((r[1] or "").encode("utf-8", "replace")) for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
