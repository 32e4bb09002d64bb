"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

A round serves every queue its share of one window; what a share has beyond whole tokens stays with the queue as its
deficit and counts in the next round. Serving round after round would be one long loop, so the state after any round is computed
instead: with queue totals T_1..T_m (sum T) and S_j = T_1 + ... + T_j, the queues up to j have been served
floor(t * S_j / T) tokens after t tokens of output. The difference between neighbours is what one queue got; it stays within one token
of its exact share t * T_j / T, which is its deficit, and that holds across windows, partitions and executors. The place of
each token follows from its offset in its queue alone, so every document is cut and placed by itself.

Targets are the queues' shares of all tokens unless given. With other targets the queue that runs dry first ends a phase, and
the queues left share the next phase by their targets; within a phase the same formula holds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_tokens import CACHED, encoder, id_type
from .common import batches, stored, worker_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


@dataclass(frozen=True)
class Phase:
    """Output tokens [start, start + size), and how many each queue gives in it (parallel to queues)."""

    start: int
    size: int
    gives: tuple[int, ...]
    before: tuple[int, ...]  # what each queue gave in earlier phases


def phases(totals: dict[str, int], targets: dict[str, float] | None) -> tuple[list[str], list[Phase]]:
    """Queues in a fixed order, and the phases until all are empty. Queues without a positive target come in the last phase."""
    queues = sorted(totals)
    left = [totals[q] for q in queues]
    aim = [Fraction(str(targets.get(q, 0))) for q in queues] if targets else [Fraction(n) for n in left]
    out, at, before = [], 0, [0] * len(queues)
    while any(left):
        live = [j for j, n in enumerate(left) if n and aim[j] > 0]
        if live:
            rounds = min(Fraction(left[j]) / aim[j] for j in live)
            gives = [min(left[j], int(rounds * aim[j])) if j in live else 0 for j in range(len(queues))]
            for j in live:
                if Fraction(left[j]) / aim[j] == rounds:
                    gives[j] = left[j]
        else:
            gives = list(left)
        out.append(Phase(at, sum(gives), tuple(gives), tuple(before)))
        at += sum(gives)
        before = [a + b for a, b in zip(before, gives)]
        left = [a - b for a, b in zip(left, gives)]
    return queues, out


class Placement:
    """Where the tokens of a queue lie in the output. queues and plan are those with a target, rest is start and size of the last phase,
    in which all others are served."""

    def __init__(self, queues: list[str], plan: list[Phase], rest: tuple[int, int], sequence: int, window: int):
        self.rest = rest
        self.index = {q: j for j, q in enumerate(queues)}
        self.plan, self.sequence, self.window = plan, sequence, window
        self.sums = [np.concatenate(([0], np.cumsum(p.gives, dtype=object))).tolist() if queues else [0] for p in plan]

    def parts(self, queue: str, lo: int | None, hi: int | None):
        """Start, size, tokens of the queue, of the queue before, of the queues up to it without and with it; of each phase."""
        j = self.index.get(queue)
        if j is None:
            return [(*self.rest, hi - lo, 0, lo, hi)]
        return [(p.start, p.size, p.gives[j], p.before[j], sums[j], sums[j + 1]) for p, sums in zip(self.plan, self.sums)]

    def pieces(self, queue: str, a: int, n: int, lo: int | None = None, hi: int | None = None):
        """(start in the document, length, output position) of tokens [a, a + n) of a queue, in order. lo, hi: the tokens of the queues up to
        this one, without and with it, if it has no target."""
        done = 0
        for start, size, mine, before, lo, hi in self.parts(queue, lo, hi):
            x = a + done - before
            if x >= mine or not mine:
                continue
            served = lambda w: min(w * self.window, size) * hi // size - min(w * self.window, size) * lo // size
            w = x * size // (mine * self.window)
            while served(w) > x:
                w -= 1
            while served(w + 1) <= x:
                w += 1
            while done < n and x < mine:
                t0, t1 = min(w * self.window, size), min((w + 1) * self.window, size)
                first, last = served(w), served(w + 1)
                ahead = t1 * lo // size - t0 * lo // size  # what the queues before this one give in the window
                at = start + t0 + ahead + x - first
                room = min(last - x, n - done)
                while room:
                    cut = min(room, self.sequence - at % self.sequence)
                    yield done, cut, at
                    done, x, at, room = done + cut, x + cut, at + cut, room - cut
                w += 1
            if done == n:
                return


TOKENS = "part int, queue string, local long, doc_id long, n_tokens long, ids binary"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, cached: int = CACHED) -> DataFrame:
    """Ids of each document, with its offset among those of its queue in its partition; written to the shared folder."""

    kind = id_type(tokenizer_path, end_id)
    width = np.dtype(kind).itemsize

    def encode(it):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer_path, kind, cached), np.array([end_id], kind).tobytes()
        part, served = TaskContext.get().partitionId(), {}
        for rows in batches(it, ["queue", "doc_id", "text"]):
            local, counts, data = [], [], []
            for (queue, _, _), ids in zip(rows, enc.encode([r[2] for r in rows])):
                local.append(served.get(queue, 0))
                counts.append(len(ids) // width + 1)
                data.append(ids + end)
                served[queue] = local[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array(local, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], ["part", "queue", "local", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.coalesce("source", F.lit("")).alias("queue"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(encode, TOKENS), "pack-tokens", compression="zstd")


def _ends(totals: DataFrame, block: int) -> tuple[DataFrame, int]:
    """queue, lo, hi: the tokens of the queues up to each one, without and with it, in their order; and the sum. In two phases: within sorted
    blocks of about `block` queues, and over the blocks."""

    def add(it):
        from pyspark import TaskContext

        part, sum_ = TaskContext.get().partitionId(), 0
        for batch in it:
            n = np.array(batch.column(1).to_pylist(), np.int64)
            upto = sum_ + np.cumsum(n)
            sum_ = int(upto[-1]) if len(n) else sum_
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(upto - n), pa.array(upto)], ["block", "queue", "lo", "hi"])

    blocks = -(-totals.count() // block) or 1
    inside = stored(totals.select("queue", "n").repartitionByRange(blocks, "queue").sortWithinPartitions("queue").mapInArrow(add, "block int, queue string, lo long, hi long"), "pack-queues")
    starts, at = [], 0
    for r in inside.groupBy("block").agg(F.max("hi").alias("n")).orderBy("block").toLocalIterator():
        starts.append((r.block, at))
        at += r.n
    start = totals.sparkSession.createDataFrame(starts, "block int, ahead long")
    return inside.join(F.broadcast(start), "block").select("queue", (F.col("lo") + F.col("ahead")).alias("lo"), (F.col("hi") + F.col("ahead")).alias("hi")), at


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = 2048, window_sequences: int = 16, targets: dict[str, float] | None = None, queues: int = 4096, cached: int = CACHED, release: bool = False) -> DataFrame:
    """Pack docs (doc_id, text, source) into sequences of `sequence` tokens; returns a row per piece (PIECES).

    All sequences are full but the last, which a reader pads. A window of window_sequences sequences holds the queues in
    target proportion, each queue's documents in one run. Null text is empty (its end id is still packed), null source is the
    queue "", a null doc_id stays null, repeated rows are packed one by one. Each source is a queue of its own, however many there are: the
    plan of those with a target goes to the tasks, the others' places are a table that is joined to the tokens; `queues` of them are added up in
    a task. cached bounds each worker's cache of token ids: fewer save memory and cost time. release: workers drop
    the encoder before the pieces are cut, which saves memory where no more texts are encoded. An empty table gives no pieces.
    """
    tokens = tokenized(docs, tokenizer_path, end_id, cached)
    shares = tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(shares.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-bases")
    totals = stored(bases.groupBy("queue").agg(F.sum("n").alias("n")), "pack-totals")
    aims = {q: v for q, v in (targets or {}).items() if v > 0}
    aimed = F.col("queue").isin(list(aims))
    named, plan = phases({r.queue: r.n for r in totals.where(aimed).collect()}, aims)
    ends, rest = _ends(totals.where(~aimed), queues)
    placement = Placement(named, plan, (sum(p.size for p in plan), rest), sequence, sequence * window_sequences)

    kind = id_type(tokenizer_path, end_id)

    def cut(it):
        if release:
            worker_cache("packing", "", object)
        for rows in batches(it, ["queue", "local", "base", "lo", "hi", "doc_id", "ids"]):
            out = [[] for _ in range(8)]
            for queue, local, base, lo, hi, doc_id, ids in rows:
                wide = np.frombuffer(ids, kind).astype("<u4")
                for start, length, at in placement.pieces(queue, base + local, len(wide), lo, hi):
                    for column, v in zip(out, (doc_id, start, length, zlib.crc32(wide[start : start + length]), len(wide), at // sequence, at % sequence, queue)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(out[7], pa.string())], [c.split()[0] for c in PIECES.split(", ")])

    # The stored sizes decide: a small table of bases is broadcast, a large one is joined by shuffle.
    places = stored(bases.select("part", "queue", "base").join(ends, "queue", "left"), "pack-places")
    return tokens.join(places, ["part", "queue"]).select("queue", "local", "base", "lo", "hi", "doc_id", "ids").mapInArrow(cut, PIECES)
