"""MinHash near-deduplication with an LSH forest.

1. Every document becomes its set of hashed word shingles; equal sets are one class from here on, so copies cost one row each.
2. A class's signature is read in TREES rotated orders. Each order is range-partitioned and sorted, so classes with a long common prefix
   stand side by side, and one hot prefix may span many partitions.
3. A region is a run of rows that agree in the first DEPTH values, at least. Regions of up to SMALL rows give all their pairs. Larger
   ones are cut where neighbours agree least (so dense regions are compared at a greater depth) into regions of up to BLOCK rows, neighbours across a
   cut stay candidates.
4. Members of large regions get a long signature. A large region first gives a spanning forest of its pairs of highest estimated similarity,
   whose links join most of its members. A second pass gives every pair between members that are still apart and whose estimate
   is at most 3.5 standard deviations below the threshold.
5. Rows of one prefix that lie in several regions or partitions are a cut run. Cut runs that share documents are one cluster; in the second pass each
   of its documents outside the cluster's largest component is also compared with all others that are still apart, in blocks of both sides. A cut then
   loses a pair only by its estimate (the same 3.5 deviations); the cost is the number of documents outside times the cluster's size.
6. Candidates are confirmed on full sets. Components over the confirmed links come from alternating stars.

A link of similarity s is missed with a chance of about (1 - s**DEPTH) ** TREES: 8e-7 at 0.85, 7e-5 at 0.8, less above.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, counted, stored, worker_cache
from .components import components

TREES, DEPTH, REST = 24, 5, 6
HASHES = TREES * DEPTH
LONG = 1024  # values of the long signatures, of which the low 8 bits are kept
SMALL, BLOCK = 8, 384
SIDE = 2048  # rows of a block's side where cut runs are compared
FILTER_BITS = 1 << 25  # 4 MiB on the driver and in each task, whatever the input
_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_LONG_A = _RNG.integers(1, 2**63, LONG, dtype=np.uint64) | np.uint64(1)
_LONG_B = _RNG.integers(0, 2**63, LONG, dtype=np.uint64)
_P = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; a shorter text is one shingle, one without words has none.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased.
    """
    split = (text or "").encode("utf-8", "replace").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("word hashes", "", _WordHashes).__getitem__, split), np.uint64, len(split))
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        x = h[: len(h) - k + 1] * _P[0]
        for i in range(1, k):
            x = (x ^ (x >> np.uint64(31))) * _P[i % 63] + h[i : len(h) - k + 1 + i]
        x += _P[63] * np.uint64(k)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(x: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """A 32-bit minimum for each of the hash functions."""
    out = np.full(len(a), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            out = np.minimum(out, ((x[i : i + 512, None] * a + b) >> np.uint64(32)).min(0))
    return out.astype("<u4")


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """A row for each row of docs: doc_id, n (set size), set_id (digest of the set; null if empty), sig."""

    def sign(it):
        import xxhash

        for rows in batches(it, ["doc_id", "text"]):
            sets = [shingle_set(t, words) for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n", "set_id", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n int, set_id binary, sig binary")


def _orders(it):
    """Each signature in all rotated orders: tree, prefix (a hash of the first DEPTH values), rest (the next REST values), node, n."""
    for batch in it:
        sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, HASHES)
        if not len(sigs):
            continue
        ids, sizes = batch.column(0), batch.column(1)
        double = np.concatenate([sigs, sigs], 1)
        for t in range(TREES):
            at = t * DEPTH
            prefix = np.zeros(len(sigs), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(DEPTH):
                    prefix = (prefix ^ (prefix >> np.uint64(29))) * _P[k] + double[:, at + k].astype(np.uint64)
            rest = np.ascontiguousarray(double[:, at + DEPTH : at + DEPTH + REST].astype(">u4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sigs), t, np.int32)), pa.array(prefix.view(np.int64)), pa.array([r.tobytes() for r in rest], pa.binary()), ids, sizes], ["tree", "prefix", "rest", "node", "n"])


_FOUND = "kind int, tree int, prefix long, region string, a long, na int, b long, nb int"


def _agree(x: bytes, y: bytes) -> int:
    return next((k for k in range(0, len(x), 4) if x[k : k + 4] != y[k : k + 4]), len(x)) // 4


def _regions(ratio: float):
    """Walk a sorted partition. kind 0: candidate pair a, b; 1: a is in the large region; 2: a stands at a partition's edge; 3: a is in a small
    region that was cut off a large one."""

    def walk(it):
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []

        def flush(tree, prefix, rows, edge, was_cut):
            if len(rows) > SMALL or was_cut:
                name = uuid.uuid5(uuid.NAMESPACE_OID, f"{part} {tree} {prefix} {rows[0][1]} {len(rows)}").hex
            if len(rows) > SMALL:
                out.extend((1, tree, prefix, name, a, na, None, None) for _, a, na in rows)
            else:
                for i, (_, a, na) in enumerate(rows):
                    out.extend((0, None, None, None, a, na, b, nb) for _, b, nb in rows[:i] if a != b and min(na, nb) >= ratio * max(na, nb))
                if was_cut:
                    out.extend((3, tree, prefix, name, a, na, None, None) for _, a, na in rows)
            if edge:
                out.extend((2, tree, prefix, str(part), a, na, None, None) for _, a, na in (rows if len(rows) <= SMALL else [rows[0], rows[-1]]))

        key, rows, first, was_cut = None, [], True, False
        for batch in it:
            for tree, prefix, rest, node, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if key != (tree, prefix):
                    if rows and (len(rows) > 1 or first or was_cut):
                        flush(*key, rows, first, was_cut)
                    first = first and key is None
                    key, rows, was_cut = (tree, prefix), [], False
                elif len(rows) >= BLOCK:
                    depth = [_agree(rows[k - 1][0], rows[k][0]) for k in range(BLOCK // 2, len(rows))]
                    cut = BLOCK // 2 + depth.index(min(depth))
                    x, y = rows[cut - 1], rows[cut]
                    out.append((0, None, None, None, x[1], x[2], y[1], y[2]))
                    flush(*key, rows[:cut], first, True)
                    rows, was_cut = rows[cut:], True
                rows.append((rest, node, n))
            if len(out) > 20_000:
                yield _batch(out)
                out.clear()
        if rows:
            flush(*key, rows, True, was_cut)
        if out:
            yield _batch(out)

    return walk


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _FOUND.split(", ")])


def _pairs(rows: DataFrame) -> DataFrame:
    """Candidates a < b, each once."""
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _estimates(block, ratio: float, least: float):
    """Agreement of all signatures in a region as a matrix; 0 below `least`, outside the size ratio and beyond the first common region."""
    sig = np.ascontiguousarray(np.frombuffer(b"".join(block["sig"]), np.uint8).reshape(-1, LONG).T)
    n = block["n"].to_numpy()
    same = np.zeros((len(n), len(n)), np.int16)
    for values in sig:
        same += values[:, None] == values[None, :]
    est = (same / LONG - 1 / 256) / (1 - 1 / 256)  # low bits agree by chance once in 256
    est[np.minimum(n[:, None], n[None, :]) < ratio * np.maximum(n[:, None], n[None, :])] = 0
    est[est < least] = 0
    np.fill_diagonal(est, 0)
    return est


def _forest(block, ratio: float, least: float):
    """Spanning forest of highest estimates (Prim's rule)."""
    import pandas as pd

    est, ids, out = _estimates(block, ratio, least), block["node"].to_numpy(), []
    left = np.ones(len(ids), bool)
    while left.any():
        start = int(np.flatnonzero(left)[0])
        left[start] = False
        best, by = np.where(left, est[start], 0), np.full(len(ids), start)
        while best.max(initial=0) > 0:
            k = int(best.argmax())
            out.append((ids[k], ids[by[k]]))
            left[k] = False
            better = left & (est[k] > best)
            best, by = np.where(better, est[k], best), np.where(better, k, by)
            best[~left] = 0
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _apart(block, ratio: float, least: float):
    """All pairs of different components, each only in the first region that both are in."""
    import pandas as pd

    comp = block["component"].to_numpy()
    if (comp == comp[0]).all():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    est = _estimates(block, ratio, least)
    est[comp[:, None] == comp[None, :]] = 0
    names = [set(r) for r in block["regions"]]
    mine, ids = block["region"].iloc[0], block["node"].to_numpy()
    i, j = np.nonzero(np.triu(est))
    own = [min(names[x] & names[y]) == mine for x, y in zip(i.tolist(), j.tolist())]
    return pd.DataFrame({"a": ids[i[own]], "b": ids[j[own]]}, dtype="int64")


def _cut_runs(found: DataFrame) -> DataFrame:
    """node, head (smallest node of the run) for all rows of runs that lie in several regions, or beyond the two partitions whose edges are joined."""
    rows = found.where("kind > 0").select("tree", "prefix", "kind", "region", F.col("a").alias("node"))
    region, part = F.when(F.col("kind") != 2, F.col("region")), F.when(F.col("kind") == 2, F.col("region").cast("int"))
    runs = rows.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.min(region).alias("r"), F.max(region).alias("r2"), F.min(part).alias("p"), F.max(part).alias("p2"))
    cut = runs.where("r < r2 or (r is not null and p < p2) or p2 - p > 1").select("tree", "prefix", "head")
    return rows.join(cut, ["tree", "prefix"]).select("node", "head").distinct()


def _blocks(wide: DataFrame) -> DataFrame:
    """wide (cluster, node, n, sig, component) dealt to blocks (cluster, i, j): rows outside the cluster's largest component ask, all rows answer."""
    sizes = wide.groupBy("cluster", "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy("cluster").agg(F.sum("c").alias("all"), F.max("c").alias("c"), F.max_by("component", F.struct("c", "component")).alias("largest"))
    parts = stored(most.where("c < all").select("cluster", "largest", F.ceil((F.col("all") - F.col("c")) / SIDE).cast("int").alias("asking"), F.ceil(F.col("all") / SIDE).cast("int").alias("answering")), "clusters")
    at = wide.join(parts, "cluster").withColumn("h", F.xxhash64("node"))
    deal = lambda own, other: (F.pmod("h", own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    (i, to_j), (j, to_i) = deal("asking", "answering"), deal("answering", "asking")
    shape = ["cluster", "i", "j", "asks", "node", "n", "component", "sig"]
    asks = at.where("component <> largest").withColumn("i", i).withColumn("j", to_j).withColumn("asks", F.lit(True)).select(shape)
    return asks.union(at.withColumn("j", j).withColumn("i", to_i).withColumn("asks", F.lit(False)).select(shape))


def _long(text: str, words: int) -> tuple[bytes, bytes]:
    """The low 8 bits of each value of a long signature, and a sketch: the low two bits, as two planes of bits."""
    values = signature(shingle_set(text, words), _LONG_A, _LONG_B).astype(np.uint8)
    return values.tobytes(), np.packbits([values & 1, values >> 1 & 1]).tobytes()


def _across(block, ratio: float):
    """All pairs of a row that asks and one that answers in different components, by their sketches, up to 3.5 standard deviations below."""
    import pandas as pd

    chance = 1 - (1 - ratio) * 0.75  # low two bits agree by chance once in four
    most = LONG * ((1 - chance) + 3.5 * math.sqrt(chance * (1 - chance) / LONG))
    (x, low_x), (y, low_y) = ((b, np.frombuffer(b"".join(b["sig"]), np.uint64).reshape(len(b), 2, LONG // 64)) for b in (block[block["asks"]], block[~block["asks"]]))
    n, component, ids, out = y["n"].to_numpy(), y["component"].to_numpy(), y["node"].to_numpy(), []
    planes = [np.ascontiguousarray(low_y[:, k]) for k in (0, 1)]
    for node, size, own, sig in zip(x["node"].tolist(), x["n"].tolist(), x["component"].tolist(), low_x):
        at = np.flatnonzero((component != own) & (np.minimum(n, size) >= ratio * np.maximum(n, size)))
        differ = np.bitwise_count((planes[0][at] ^ sig[0]) | (planes[1][at] ^ sig[1])).sum(1, dtype=np.int32)
        near = ids[at[differ <= most]]
        out.append(pd.DataFrame({"a": np.full(len(near), node), "b": near}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _of_texts(nodes: DataFrame, docs: DataFrame, made, shape: str) -> DataFrame:
    """node and made(text) for the documents whose ids are in nodes (node), and few others. Only their texts are worked on.

    The ids go to the tasks as a filter of FILTER_BITS bits, whatever their number; a document that falls on a set bit by chance only costs time.
    """
    width = 32_768
    at = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in at.groupBy((F.col("bit") / width).cast("int").alias("k")).agg(F.expr(f"bitmap_construct_agg(bit % {width})").alias("bits")).toLocalIterator():
        bits[r.k * width // 8 : (r.k + 1) * width // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def make(it):
        held = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            on = (held[at >> 3] >> (at & 7)) & 1
            for rows in batches([batch.filter(pa.array(on.astype(bool)))], ["doc_id", "text"]):
                made_rows = [made(r[1]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c) for c in zip(*made_rows))], ["node", *(c.split()[0] for c in shape.split(", "))])

    return docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")).mapInArrow(make, f"node long, {shape}")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets have intersection * share[1] >= union * share[0]."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    full = _of_texts(nodes, docs, lambda text: (shingle_set(text, words).view(np.int64),), "set array<long>")
    with_a = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(full.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common).where(F.col("common") * share[1] >= (F.size("sa") + F.size("sb") - F.col("common")) * share[0]).select("a", "b")


def near_groups(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where intersection / union of their shingle sets is share[0] / share[1] or more; component_id is the smallest doc_id
    reachable. Null texts and texts without words have no shingles and no links. Rows that share a doc_id are one document and always in
    one component (each row keeps its own n_shingles). A null doc_id takes no part in links: component_id null, kept. An empty table gives an empty result.
    """
    ratio = share[0] / share[1]
    least = ratio - 3.5 * math.sqrt(ratio * (1 - ratio) / LONG)
    signed = stored(_signed(docs, words), "signed")
    rows = signed.select("doc_id", "n", "set_id")
    classes = stored(rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes, [signed.set_id == classes.set_id, signed.doc_id == classes.rep]).select(F.col("rep").alias("node"), "n", "sig")
    reps = stored(reps, "reps")
    order = reps.mapInArrow(_orders, "tree int, prefix long, rest binary, node long, n int")
    keys = ["tree", "prefix", "rest", "node"]
    found, size = counted(order.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_regions(ratio), _FOUND), "regions", crowded=F.count(F.when(F.col("kind") == 1, 1)))
    edge = found.where("kind = 2").select("tree", "prefix", "region", "a")
    first = edge.groupBy("tree", "prefix").agg(F.min(F.col("region").cast("int")).alias("p"), F.max(F.col("region").cast("int")).alias("q")).where("p < q").select("tree", "prefix", "p")
    early = edge.join(first, ["tree", "prefix"]).where("cast(region as int) = p").select("tree", "prefix", F.col("a").alias("b"))
    crossing = edge.join(early, ["tree", "prefix"]).select("a", "b")
    inside = found.where("kind = 1").select("region", F.col("a").alias("node"), F.col("na").alias("n"))
    candidates, shape, crowded = found.where("kind = 0").select("a", "b").union(crossing), "a long, b long", size["crowded"] > 0
    runs, size = counted(_cut_runs(found), "runs", n=F.count("*"))
    cut = size["n"] > 0
    if crowded or cut:
        dense = stored(_of_texts(inside.select("node").union(runs.select("node")), docs, lambda text: _long(text, words), "sig binary, sketch binary").dropDuplicates(["node"]), "dense")
    if crowded:
        members = stored(inside.join(dense.select("node", "sig"), "node"), "members", compression="zstd")
        candidates = candidates.union(members.groupBy("region").applyInPandas(lambda block: _forest(block, ratio, least), shape))
    pairs = stored(_pairs(candidates), "pairs")
    # Rows of one document may have different sets: their classes belong together.
    owners = rows.where("doc_id is not null").join(classes, "set_id", "left").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("high"))
    owners = stored(owners, "owners")
    several = owners.where("rep < high").select("doc_id", F.col("rep").alias("a"))
    same = rows.join(several, "doc_id").join(classes, "set_id").where("a < rep").select("a", F.col("rep").alias("b"))
    links = stored(_confirmed(pairs, docs, words, share).union(same).hint("rebalance"), "links")
    group = stored(components(links.toDF("src", "dst")), "groups")
    more = []
    if crowded:
        regions = members.groupBy("node").agg(F.collect_set("region").alias("regions"))  # at most one for each tree
        again = members.join(regions, "node").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        more.append(again.groupBy("region").applyInPandas(lambda block: _apart(block, ratio, least), shape))
    if cut:
        cluster = stored(components(runs.toDF("src", "dst")).toDF("node", "cluster"), "cut")
        wide = cluster.join(dense.select("node", F.col("sketch").alias("sig")), "node").join(reps.select("node", "n"), "node").join(group, "node", "left")
        wide = stored(wide.withColumn("component", F.coalesce("component", "node")), "wide")
        more.append(_blocks(wide).groupBy("cluster", "i", "j").applyInPandas(lambda block: _across(block, ratio), shape))
    if more:
        rest, size = counted(_pairs(more[0].union(more[1]) if len(more) > 1 else more[0]).join(pairs, ["a", "b"], "left_anti"), "apart", n=F.count("*"))
        if size["n"]:
            links = links.union(_confirmed(rest, docs, words, share))
            group = stored(components(links.toDF("src", "dst")), "groups")
    named = rows.join(owners.select("doc_id", "rep"), "doc_id", "left").join(group.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay, whatever their names.

    Rows without words, or with a null doc_id, stay; rows that share a doc_id stay or go together; an empty table gives an empty one. See near_groups()."""
    gone = stored(near_groups(docs, words, share).where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
