"""Removal of repeated passages by recompression.

Words get names, and rounds of recompression replace maximal runs of one name, then pairs of neighbouring names, by new ones. A pair is replaced where a hash of its left name says 0 and one of
its right name says 1, so no two pairs overlap and equal substrings are cut alike but for their ends. A new name is a digest of what it stands for: all tasks name alike, without
an exchange. Each symbol knows the range of words that settles it: any occurrence of these words holds the same symbol at the same place.

1. Documents are packed into chunks of about CHUNK bytes (or one document), written bucketed by chunk, so that later joins move only small answers, not texts.
2. First Spark round: each chunk's distinct high-level names go to buckets by name, which answer which ones occur more than once in the table.
3. A window of words that holds a symbol of a single occurrence occurs once. All others (few but the repeated ones) are verified by a 128-bit digest of their words: each chunk sends
   the first occurrence of each to buckets by digest, which answer which ones start earlier elsewhere. Later occurrences in a chunk are known there already, so a passage that fills the table is sent once
   a chunk at most.
4. Words under a window that starts earlier elsewhere go.

Buckets hold names or windows of about BUCKET bytes of text, whatever the input's size.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_path, stored

CHUNK, BUCKET = 2_000_000, 16_000_000  # bytes of text
ROUNDS = "rpppp"  # r: runs, p: pairs
_FAR = 1 << 30
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit lanes of a digest for each word of all texts on end, and how many words each text has."""
    import xxhash

    index, parts, sizes = _Index(), [], []
    for t in texts:
        w = t.split()  # at bytes 0x20 and 0x09-0x0D
        sizes.append(len(w))
        parts.append(np.fromiter(map(index.__getitem__, w), np.int64, len(w)))
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, index)), np.uint64).reshape(-1, 2)
    at = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return lanes[at, 0], lanes[at, 1], np.array(sizes, np.int64)


def symbols(words: np.ndarray, sizes: np.ndarray, rounds: str = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after some rounds, and the ranges [low, high) of words that settle each; symbols that need a text's end aren't settled by
    words alone and have ranges beyond it."""
    first = np.cumsum(sizes) - sizes
    name = np.insert(words, first, 0)  # a stop before each text never merges
    low = np.insert(np.arange(len(words), dtype=np.int64), first, -_FAR)
    stop = low < 0
    high = np.where(stop, len(words) + _FAR, low + 1)
    with np.errstate(over="ignore"):
        for k, kind in enumerate(rounds):
            if kind == "r":
                head = np.ones(len(name), bool)
                head[1:] = (name[1:] != name[:-1]) | stop[1:] | stop[:-1]
                at = np.flatnonzero(head)
                last = np.append(at[1:], len(name)) - 1
                n = last - at + 1
                # A run ends where another name begins, so its neighbours settle it too.
                new_low, new_high = np.minimum(low[at], low[np.maximum(at - 1, 0)]), np.maximum(high[last], high[np.minimum(last + 1, len(name) - 1)])
                new_high[last == len(name) - 1] = len(words) + _FAR
                name = np.where(n > 1, mixed(name[at] * _M1 + n.astype(np.uint64) * _M2 + np.uint64(k)), name[at])
                low, high, stop = new_low, new_high, stop[at]
                continue
            right = (mixed(name + np.uint64(k * 7919 + 1)) >> np.uint64(63)).astype(bool) & ~stop
            left = ~right & ~stop
            pair = np.zeros(len(name), bool)
            pair[:-1] = left[:-1] & right[1:]
            gone = np.zeros(len(name), bool)
            gone[1:] = pair[:-1]
            i = np.flatnonzero(pair)
            alone_left, alone_right = np.flatnonzero(left & ~pair), np.flatnonzero(right & ~gone)
            new_name, new_low, new_high = name.copy(), low.copy(), high.copy()
            new_name[i] = mixed(name[i] * _M2 + name[i + 1] + np.uint64(k))
            new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
            # What stays alone does so because of the neighbour that it could have merged with.
            beyond = np.append(high[1:], len(words) + _FAR)
            new_high[alone_left] = np.maximum(high[alone_left], beyond[alone_left])
            new_low[alone_right] = np.minimum(low[alone_right], low[alone_right - 1])
            name, low, high, stop = new_name[~gone], new_low[~gone], new_high[~gone], stop[~gone]
    return name[~stop], low[~stop], high[~stop]


def _settled(lane: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that some window of words settles."""
    name, low, high = symbols(lane, sizes)
    fits = (low >= 0) & (high - low <= window)
    return name[fits], low[fits], high[fits]


def _pack(texts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _texts(body: bytes, sizes: list[int]) -> list[bytes]:
    import zstandard

    whole, ends = zstandard.ZstdDecompressor().decompress(body, max_output_size=sum(sizes)) if sum(sizes) else b"", np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


_CHUNKS = "chunk long, ids array<long>, sizes array<int>, body binary"


def _chunks(it, most: int):
    from pyspark import TaskContext

    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int32())), pa.array([_pack(texts)], pa.binary())], ["chunk", "ids", "sizes", "body"])

    for batch in it:
        for i, t in zip(batch.column(0), batch.column(1)):
            text = (t.as_py() or "").encode("utf-8", "replace")
            if ids and held + len(text) > most:
                yield chunk()
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(i.as_py())
            texts.append(text)
            held += len(text) + 16
    if ids:
        yield chunk()


def _rows(it):
    for batch in it:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _by_bucket(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts values of a bucket together, and where each of the n buckets starts and ends in it."""
    bucket = (values % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _names(it, window: int, n: int):
    """A chunk's distinct names for each bucket, ascending."""
    for row in _rows(it):
        lane, _, sizes = words_of(_texts(row["body"], row["sizes"]))
        name = np.unique(_settled(lane, sizes, window)[0])
        order, ends = _by_bucket(name, n)
        at = np.flatnonzero(np.diff(ends)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([row["chunk"]] * len(at), pa.int64()), pa.array([name[order[ends[b] : ends[b + 1]]].tobytes() for b in at], pa.binary())], ["bucket", "chunk", "names"])


def _repeated(group):
    """For each chunk a bit for each of its names: whether another chunk has it too."""
    import pandas as pd

    lists = [np.frombuffer(x, np.uint64) for x in group["names"]]
    _, where, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    bits = np.split(count[where] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "bits": [np.packbits(b).tobytes() for b in bits]})


def _candidates(lane: np.ndarray, sizes: np.ndarray, window: int, flags, n: int) -> np.ndarray:
    """Starts of the windows all of whose symbols occur more than once in the table."""
    name, low, high = _settled(lane, sizes, window)
    distinct, where, count = np.unique(name, return_inverse=True, return_counts=True)
    again = count > 1
    order, ends = _by_bucket(distinct, n)
    for f in flags or []:
        a, b = ends[f["bucket"]], ends[f["bucket"] + 1]
        again[order[a:b]] |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=b - a).astype(bool)
    single = ~again[where]
    cover = np.zeros(len(lane) + 1, np.int32)
    np.add.at(cover, np.maximum(high[single] - window, 0), 1)
    np.add.at(cover, low[single] + 1, -1)
    rest = np.cumsum(cover[:-1]) == 0
    first = np.cumsum(sizes) - sizes
    for a, s in zip(first.tolist(), sizes.tolist()):  # windows lie inside a text
        rest[max(a, a + s - window + 1) : a + s] = False
    return np.flatnonzero(rest)


_ENTRIES = "bucket int, chunk long, keys binary, at binary, docs binary, known boolean"
_DOC = np.dtype([("id", "<u8"), ("tie", "<u8"), ("first", "<u4"), ("n", "<u4")])


def _digests(lanes: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> np.ndarray:
    out = np.empty((len(at), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, lane in enumerate(lanes):
            x = np.zeros(len(at), np.uint64)
            for i in range(window):
                x = (x ^ (x >> np.uint64(31))) * _M1 + lane[at + i]
            out[:, k] = mixed(x)
    return out


def _later(keys: np.ndarray, ident: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries aren't the first of their key (equal places of equal rows are one), and an order by key, then place."""
    order = np.lexsort((start, tie, ident, keys[:, 1], keys[:, 0]))
    k, place = keys[order], (ident[order], tie[order], start[order])
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]).any(1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = np.logical_or.reduce([p != p[head] for p in place])
    return later, order


def _windows(it, window: int, n: int):
    """For each bucket a chunk's first occurrences of candidate windows; and once, known: the chunk's later ones."""
    import xxhash

    for row in _rows(it):
        texts = _texts(row["body"], row["sizes"])
        a, b, sizes = words_of(texts)
        at = _candidates(a, sizes, window, row["flags"], n)
        keys = _digests((a, b), at, window)
        first = np.cumsum(sizes) - sizes
        doc = np.searchsorted(first + sizes, at, side="right")
        # Ids in ascending order as unsigned numbers, null last.
        ids = np.array([(1 << 64) - 1 if i is None else i + (1 << 63) for i in row["ids"]], np.uint64)
        ties = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
        later, _ = _later(keys, ids[doc], ties[doc], at - first[doc])
        out = [(row["chunk"] % n, row["chunk"], b"", at[later].astype("<u4").tobytes(), b"", True)] if later.any() else []
        at, keys, doc = at[~later], keys[~later], doc[~later]
        order, ends = _by_bucket(keys[:, 0], n)
        for bucket in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[bucket] : ends[bucket + 1]]  # ascending places
            each, count = np.unique(doc[mine], return_counts=True)
            docs = np.empty(len(each), _DOC)
            docs["id"], docs["tie"], docs["first"], docs["n"] = ids[each], ties[each], first[each], count
            out.append((bucket, row["chunk"], keys[mine].tobytes(), at[mine].astype("<u4").tobytes(), docs.tobytes(), False))
        if out:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _ENTRIES.split(", ")])


def _earlier_elsewhere(group):
    """chunk, at: the places of a chunk's windows that start earlier elsewhere."""
    import pandas as pd

    known = group[group["known"]][["chunk", "at"]]
    rows = group[~group["known"]]
    if not len(rows):
        return known
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64).reshape(-1, 2)
    at = np.frombuffer(b"".join(rows["at"]), "<u4")
    docs = np.frombuffer(b"".join(rows["docs"]), _DOC)
    docs = np.repeat(docs, docs["n"])
    later, _ = _later(keys, docs["id"], docs["tie"], at - docs["first"])
    ends = np.cumsum([0, *(len(x) // 4 for x in rows["at"])]).tolist()
    found = [(c, at[a:b][later[a:b]].tobytes()) for c, a, b in zip(rows["chunk"], ends, ends[1:]) if later[a:b].any()]
    return pd.concat([known, pd.DataFrame(found, columns=["chunk", "at"])])


def _cut(it, window: int):
    """doc_id, n_words, n_removed, kept for each document of a chunk."""
    for row in _rows(it):
        words = [t.split() for t in _texts(row["body"], row["sizes"])]
        ends = np.cumsum([0, *map(len, words)])
        cover = np.zeros(ends[-1] + 1, np.int32)
        for found in row["found"] or []:
            at = np.frombuffer(found, "<u4").astype(np.int64)  # each place once
            cover[at] += 1
            cover[at + window] -= 1
        stay = (np.cumsum(cover[:-1]) == 0).tolist()
        kept = [[w for w, s in zip(x, stay[a : a + len(x)]) if s] for x, a in zip(words, ends.tolist())] if row["found"] else words
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array([len(x) for x in words], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(words, kept)], pa.int64()), pa.array([b" ".join(y).decode("utf-8", "replace") for y in kept], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets of key: a join with something small that is shuffled by key leaves it in place."""
    spark, name = df.sparkSession, f"chunks_{uuid.uuid4().hex}"
    path = session_path(spark, name)
    df.repartition(n, key).write.option("path", path).option("compression", "uncompressed").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, window: int = 20, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of docs (doc_id, text).

    A word goes if it lies in `window` consecutive words of its document that also start earlier: in a document with a smaller doc_id, or before in the same. Null texts have no words; a text of fewer words than a window
    stays whole. Null doc_ids come after all others, rows that share a doc_id follow each other by a digest of their texts, and rows equal in both are one document, whose result each of them gets. Other
    columns are ignored; an empty table gives an empty result. Repeated windows inside a document count too, overlapping ones as well.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = _bucketed(own.mapInArrow(partial(_chunks, most=chunk), _CHUNKS), "chunk", parts)
    total = chunks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // bucket))
    names = chunks.mapInArrow(partial(_names, window=window, n=n), "bucket int, chunk long, names binary")
    answers = names.groupBy("bucket").applyInPandas(_repeated, "chunk long, bucket int, bits binary")
    flags = stored(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags")), "repeated")  # a row a chunk, a bit a name
    asked = chunks.join(flags.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "sizes", "body", "flags")
    entries = asked.mapInArrow(partial(_windows, window=window, n=n), _ENTRIES)
    places = entries.groupBy("bucket").applyInPandas(_earlier_elsewhere, "chunk long, at binary")
    found = stored(places.groupBy("chunk").agg(F.collect_list("at").alias("found")), "repeats")
    told = chunks.join(found.hint("shuffle_hash"), "chunk", "left").select("ids", "sizes", "body", "found")
    return told.mapInArrow(partial(_cut, window=window), "doc_id long, n_words long, n_removed long, kept string")
