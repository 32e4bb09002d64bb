"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normalised: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters. Patterns are windows of ten words (a shorter item is one
window). The automaton's symbols are numbers of words, so matches start and end at word borders and a window costs ten nodes at most; words that no
benchmark item has are one symbol that no pattern has. A text is read once; word numbers found lead back to character spans of the original. A benchmark too large for one automaton is cut into parts, whose automata a task
builds one after another for a buffer of texts at a time: texts are neither written nor shuffled in between, and no part passes through the driver.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_path, worker_cache

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
PART_BYTES = 2 << 20  # of benchmark texts in one automaton, which takes some 80 bytes for each of them
BUFFER = 64 << 20  # of texts that a task scans for one part of a large benchmark before it builds the automaton of the next
_RANGES = "array<struct<start:int,end:int>>"
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, spans {_RANGES}"


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_SPACED).split()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (start, end) in ascending order; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Automaton:
    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.names = sorted({name for name, _ in items})
        self.numbers: dict[bytes, int] = {}
        place = {name: k for k, name in enumerate(self.names)}
        found: dict[tuple, set[int]] = {}
        for name, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised(text)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(place[name])
        for window, names in found.items():
            self.machine.add_word(window, (len(window), tuple(names)))
        self.empty = not found
        if found:
            self.machine.make_automaton()
        #: Runs of known words that are as long as the shortest pattern; no match reaches over an unknown word.
        self.runs = re.compile(b"\x01{%d,}" % min(map(len, found), default=1))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged ranges of the words hit, sorted item ids."""
        words = normalised(text)
        if self.empty or not words:
            return len(words), [], []
        known = self.numbers.get
        symbols = [known(w, 0) for w in words]
        hits, names = [], set()
        for run in self.runs.finditer(bytes(map(bool, symbols))):
            first = run.start()
            for end, (n, ids) in self.machine.iter(tuple(symbols[first : run.end()])):
                hits.append((first + end + 1 - n, first + end + 1))
                names.update(ids)
        return len(words), merged(hits), sorted(self.names[k] for k in names)


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters of the original text from the first to the last word of each range."""
    places = [m.span() for m in WORDS.finditer(text)] if ranges else []
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


@dataclass
class Machines:
    """The automata of a benchmark, for tasks. One of up to part_bytes is a broadcast; more are built one after another from files in the shared folder, for each
    buffer of texts, so a task holds one at a time and every text is read once."""

    size: int
    key: str
    one: Broadcast | None  # its items
    uris: list[str]  # folders of the parts, if there are several

    @property
    def buffer(self) -> int:
        """Bytes of texts that are scanned for one automaton before the next is built."""
        return 2_000_000 if self.one is not None else BUFFER

    def passes(self, back: bool):
        """Each automaton; back: the last one first, which a worker still has from the buffer before."""
        if self.one is not None:
            yield worker_cache("automaton", self.key, lambda: Automaton(self.one.value, self.size))
            return
        for k, uri in sorted(enumerate(self.uris), reverse=back):
            yield worker_cache("automaton", (self.key, k), lambda uri=uri: Automaton(_items_at(uri), self.size))


def _items_at(uri: str) -> list[tuple[str, str]]:
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(uri)
    files = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [r for f in sorted(files) for r in parquet.ParquetFile(system.open_input_file(f)).read(["item_id", "text"]).to_pylist()]
    return sorted((r["item_id"], r["text"]) for r in rows)


def machines(benchmark: DataFrame, size: int, part_bytes: int) -> Machines:
    """Null texts are no items; the items of a part have about part_bytes (or are one item), which is all that a broadcast, a task or an automaton holds at a time."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-held // part_bytes))
    if n == 1:
        mine = sorted(tuple(r) for r in items.collect())
        return Machines(size, hashlib.sha256(repr((size, mine)).encode()).hexdigest(), spark.sparkContext.broadcast(mine), [])
    path = session_path(spark, "benchmark")
    items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("part").write.partitionBy("part").parquet(path)
    return Machines(size, path, None, [f"{path}/part={k}" for k in range(n)])


def _buffered(it, most: int):
    """Lists of Arrow batches whose texts (the column text) have about `most` bytes together."""
    held, size = [], 0
    for batch in it:
        at = batch.schema.get_field_index("text")
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            held.append(part)
            size += part.column(at).nbytes
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.as_py() or "" for t in batch.column(batch.schema.get_field_index("text"))]


def _ranges(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each row of docs (doc_id, text) with n_words, n_hit, items and spans.

    Null and empty texts have no words; null items are ignored, an item with a null id counts under the id "", repeated items count once. Repeated rows
    and rows with a null doc_id each get their own row; extra columns are not kept, whatever their names. The texts are read once, however large the benchmark is.
    """
    parts = machines(benchmark, size, part_bytes)

    def scan(it):
        back = False
        for held in _buffered(it, parts.buffer):
            texts = [_texts(b) for b in held]
            found: list[list] = [[(0, [], [])] * len(t) for t in texts]
            for automaton in parts.passes(back):
                for mine, own in zip(texts, found):
                    for k, t in enumerate(mine):
                        n, ranges, names = automaton.scan(t)
                        own[k] = (n, merged([*own[k][1], *ranges]) if own[k][1] else ranges, sorted({*own[k][2], *names}) if own[k][2] else names)
            back = not back
            for batch, mine, own in zip(held, texts, found):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), "n_words": pa.array([f[0] for f in own], pa.int64()), "n_hit": pa.array([sum(b - a for a, b in f[1]) for f in own], pa.int64()),
                    "items": pa.array([f[2] for f in own], pa.list_(pa.string())), "spans": _ranges([spans(t, f[1]) for t, f in zip(mine, own)]),
                })

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns and all other rows stay as they are. Null and empty texts stay, repeated rows stay or go alike; null and
    repeated items as in contaminated(); an empty benchmark removes nothing, an empty table gives an empty one."""
    parts = machines(benchmark, size, part_bytes)

    def clean(it):
        back = False
        for held in _buffered(it, parts.buffer):
            texts = [_texts(b) for b in held]
            stay = [[True] * len(t) for t in texts]
            for automaton in parts.passes(back):
                for mine, own in zip(texts, stay):
                    for k, t in enumerate(mine):
                        own[k] = own[k] and not automaton.scan(t)[1]
            back = not back
            for batch, own in zip(held, stay):
                yield batch.filter(pa.array(own, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
