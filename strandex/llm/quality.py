"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The trees are grown on a bounded sample of labelled rows; scoring walks all trees for a whole batch of documents at once with numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, smallest_hashes, worker_cache

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?'\"-()"
MARKS = b"#$%&*@^~_+=<>/\\{}[]"
HIGH = bytes(range(128, 256))
FEATURES = 24
BLOCK = 50


def statistics(text: str) -> list[float]:
    """FEATURES numbers of one text; shares are of bytes, words or lines, so length alone moves few of them."""
    raw = text.encode("utf-8", "replace")
    n, words, lines = max(1, len(raw)), text.split(), [x for x in text.split("\n") if x]
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    m = max(1, len(words))
    counts = Counter(words)
    twins = list(map(eq, words, words[1:]))
    most = max(counts.values(), default=0)
    long = max(map(len, words), default=0)
    # Junk may be a passage of a longer text: the worst block of words counts beside the whole.
    blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
    full = [b for b in blocks if len(b) >= BLOCK // 2] or blocks
    worst = max((sum(map(eq, b, b[1:])) / len(b) for b in full), default=0)
    few = min((len(set(b)) / len(b) for b in full), default=1)
    shouted = max((sum(map(str.isupper, b)) / len(b) for b in full), default=0)
    odd = [(len(j) - len(j.translate(None, MARKS + b"|!"))) / max(1, len(j)) for j in (" ".join(b).encode("utf-8", "replace") for b in full)]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, long / 100, share(UPPER), share(LOWER), share(DIGITS), share(STOPS), share(MARKS), share(b"!"), share(b"|"), share(HIGH),
        share(b" \t\n\r"), share(b"\n"), len(counts) / m, most / m, sum(twins) / m, len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(lines)) / 1000, worst, few, shouted, max(odd, default=0), share(b"."),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a node's children lie at left and left + 1, a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x: one step down all trees for all rows at a time."""
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = self.left[node]
            node = np.where(left < 0, node, left + (x[rows, self.feature[node]] > self.limit[node]))
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 2.0) -> Trees:
    """Grow trees by gain over gradient histograms (logistic loss)."""
    if not len(y):
        return Trees(0.0, np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.full(1, -1), np.zeros(1), 0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    feature, limit, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        feature.append(0), limit.append(0.0), left.append(-1), value.append(0.0)
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, at in level:
                gs, hs = g[at].sum(), h[at].sum()
                value[node] = rate * gs / (hs + smooth)
                best = (1e-6, 0, 0)
                for f in range(x.shape[1]) if d < depth and hs > 2 * least else ():
                    size = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(binned[at, f], g[at], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, f], h[at], size))[:-1]
                    gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[0] > 1e-6:
                    _, f, b = best
                    feature[node], limit[node], left[node] = f, edges[f][b], len(feature)
                    for _ in range(2):
                        feature.append(0), limit.append(0.0), left.append(-1), value.append(0.0)
                    over = binned[at, f] > b
                    below += [(left[node], at[~over]), (left[node] + 1, at[over])]
                else:
                    margin[at] += value[node]
            level = below
    return Trees(base, np.array(roots), np.array(feature), np.array(limit), np.array(left), np.array(value), depth)


def _measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    def measure(it):
        for rows in batches(it, ["text", *extra]):
            x = [statistics(r[0] or "") for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *(pa.array([r[1 + i] for r in rows], pa.int64()) for i in range(len(extra)))], ["x", *extra])

    return docs.select("text", *(F.col(c).cast("long") for c in extra)).mapInArrow(measure, "x array<double>, " + ", ".join(f"{c} long" for c in extra))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, max_rows: int = 20_000) -> Trees:
    """Trees from labelled documents whose crc32(doc_id as text) mod folds isn't held_out.

    max_rows bounds the sample: of more labelled rows, those with the smallest hashes of their ids are taken, a few less than
    max_rows; rows of docs that repeat an id share the bound. Of several labels of an id the largest counts. Rows with a null label or id teach nothing;
    without any labelled row every score is 0.5.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").where(crc_mod(F.col("doc_id"), folds) != held_out).select("doc_id", F.col(label).cast("long").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, 0.97 * max_rows / max(1, n))
    picked = smallest_hashes(known, share).limit(max_rows)
    rows = _measured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["label"]).limit(max_rows).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), FEATURES)
    return boosted(x, np.array([r.label for r in rows], float))


def scored(docs: DataFrame, trees: Trees, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text). Null text is empty text, which has a score too; a null id counts as fold 0.
    Repeated rows are scored one by one, equal texts alike; other columns are ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(it):
        for rows in batches(it, ["doc_id", "text", "held_out"]):
            s = shared.value.score(np.array([statistics(r[1] or "") for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns; null ids, repeated rows and columns of any names pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def keep(it):
        worker_cache("quality", "", object)  # the classifier needs no cache; other operators' go
        for batch in it:
            texts = [t.as_py() or "" for t in batch.column(batch.schema.get_field_index("text"))]
            s = shared.value.score(np.array([statistics(t) for t in texts]).reshape(len(texts), FEATURES))
            yield batch.filter(pa.array(s >= threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
