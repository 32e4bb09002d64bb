"""Token ids of whole texts by the tokenizers library, with a bounded cache over space-separated chunks.

A byte-level BPE splits a text by a fixed pattern before it merges, and no match of that pattern reaches from one
chunk "<space><non-space...>" into the next. So a text's ids are the joined ids of its chunks, and each distinct
chunk needs the library once while it stays in the cache. Texts where a cut isn't clean (a space inside a longer run of
white space) or that hold a special token's string go to the library whole. New chunks go to the library many at
a time, joined to short texts; each chunk holds one space, its first character, so it starts at the tokens that begin with a space.
"""

from __future__ import annotations

import gc
import re
from itertools import islice

import numpy as np

from .common import worker_cache

#: Marks at a chunk's end are a match of their own behind a letter or digit, so word and marks have their own ids.
_MARKS = ".,!?;:*&%$#|"
#: A space that has white space before it and white space or the end behind it.
_UNCLEAN = re.compile(r"\s (?:\s|\Z)")


CACHED = 850_000  # chunks that a worker keeps, some 160 MB


class ChunkEncoder:
    def __init__(self, path: str, dtype: str = "<u4", limit: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = dtype
        starts = [i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]  # how a byte-level vocabulary writes a space
        self.starts = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.starts[starts] = True
        if len(self.starts) - 1 > np.iinfo(dtype).max:
            raise ValueError(f"ids of {path} don't fit into {dtype}")
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # of chunks that start a text, without a space

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], joined: int = 50) -> None:
        """Put the ids of " " + chunk into the cache."""
        if len(self.cache) > self.limit:  # the oldest entries are mostly the frequent ones
            self.cache = dict(islice(self.cache.items(), self.limit // 2))
        plain, single, made = [], [], []
        for c in chunks:
            core = c.rstrip(_MARKS)
            if core is not c and core and core[-1].isalnum() and not core[0].isspace():
                made.append((c, core, c[len(core) :]))
            elif c and c.strip() == c:
                plain.append(c)
            else:
                single.append(c)
        known = self.cache
        plain = list(dict.fromkeys(plain + [core for _, core, _ in made if core not in known]))
        groups = [plain[i : i + joined] for i in range(0, len(plain), joined)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.starts[ids]) * ids.itemsize
            if len(at) != len(group):
                single += group
                continue
            data, at = ids.tobytes(), at.tolist()
            self.cache.update((c, data[x:y]) for c, x, y in zip(group, at, [*at[1:], len(data)]))
        self.cache.update(zip(single, self._library([" " + c for c in single])))
        tails = list({t for _, _, t in made}.difference(self.heads))
        self.heads.update(zip(tails, self._library(tails)))
        self.cache.update([(c, self.cache[core] + self.heads[t]) for c, core, t in made])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text. No cycles arise here, so the collector needn't walk the many lists meanwhile."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole, split, new, known = [], [], set(), self.cache.get
        for i, text in enumerate(texts):
            if _UNCLEAN.search(text) or any(s in text for s in self.specials):
                whole.append(i)
                continue
            rest = text.split(" ")
            head = rest.pop(0)
            ids = list(map(known, rest))  # one look-up for each chunk; the gaps are filled below
            gaps = [k for k, v in enumerate(ids) if v is None]
            lost = [rest[k] for k in gaps]
            new.update(lost)
            split.append((i, head, ids, gaps, lost))
        if new:
            self._learn(list(new))
        if len(self.heads) > self.limit // 4:
            self.heads.clear()
        first = list({s[1] for s in split}.difference(self.heads))
        self.heads.update(zip(first, self._library(first)))
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        for i, head, ids, gaps, lost in split:
            for k, c in zip(gaps, lost):
                ids[k] = self.cache[c]
            out[i] = self.heads[head] + b"".join(ids)
        return out


def id_type(path: str, *more: int) -> str:
    """The narrowest little-endian unsigned type for all ids of a tokenizer file, and for more ids."""
    import json

    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    vocab = about["model"]["vocab"]
    top = max([*(vocab.values() if isinstance(vocab, dict) else [len(vocab)]), *(t["id"] for t in about.get("added_tokens") or []), *more])
    return "<u2" if top < 1 << 16 else "<u4"


def encoder(path: str, dtype: str = "<u4", limit: int = CACHED) -> ChunkEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return worker_cache("encoder", (path, dtype, limit), lambda: ChunkEncoder(path, dtype, limit))
