"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystrom landmarks.

Kernel. k(u, v) sums, over all three-character subsequences that u and v share within a span of SPAN characters, the
product of their weights DECAY ** span, divided by sqrt(k(u, u) k(v, v)); a character inserted into a word (idiiot, idxiot) costs
some decay and not the match. The words of labelled sentences are the instances. With landmarks z and K = k(z, z) an
instance has Nystrom features k(u, z) K^(-1/2), and a linear SVM is trained on these.

Scoring. The decision is sum_j b_j k(u, z_j) with b = K^(-1/2) w. All k(u, .) are inner products of one sparse map of u, so the
sum over landmarks is taken once, into a table with a weight for each subsequence, and a word costs a few table look-ups instead of
a dynamic programme for each landmark. A document's score is a calibrated function of its highest word decisions.

Instances are labelled by their documents (multiple-instance learning): a word counts as toxic if it stands in several
different contexts of toxic documents and in (nearly) none of clean ones; contexts, not documents, are counted, so that copies
of one document don't teach each of its words as an insult.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, smallest_hashes, stored, worker_cache

SPAN = 5
DECAY = 0.6
LENGTH = 32  # longer words count in overlapping pieces of this length
SYMBOLS = 64
TOP = 4
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]

#: Characters read as a letter when they stand in a word.
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_DROP = str.maketrans("", "", "".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def folded(token: str) -> str:
    """Lower case, look-alikes as letters, no ASCII marks, compatible characters as one: i.d-1ot -> idiot."""
    word = token.lower()
    if not word.isalpha():
        word = word.translate(_LOOKS).translate(_DROP)
    return word if word.isascii() else unicodedata.normalize("NFKC", word)


def spelled(tokens: list[str]) -> list[str]:
    """tokens, with each run of three or more single characters also as one word (i d i o t)."""
    if not any(len(t) == 1 for t in tokens):
        return tokens
    out, run = list(tokens), []
    for t in [*tokens, "  "]:
        if len(t) == 1:
            run.append(t)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def codes(words: list[str]) -> np.ndarray:
    """Symbols of the words in a matrix; 0 is padding. Letters have their own symbol, others share some."""
    width = max(3, max(map(len, words), default=3))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "replace"), "<u4").reshape(len(words), width)
    return np.where(flat == 0, 0, np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % (SYMBOLS - 27))).astype(np.int32)


def mapped(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors of the words: row, subsequence and weight of each entry, sorted by row and subsequence."""
    c = codes(words)
    n, width = c.shape
    keys, weights = [], []
    for i, j in _OFFSETS:
        if width > j:
            a, b, d = c[:, : width - j], c[:, i : i + width - j], c[:, j:]
            keys.append(np.where(d > 0, (a * SYMBOLS + b) * SYMBOLS + d, -1))
            weights.append(np.full(width - j, DECAY ** (j + 1)))
    keys = np.concatenate(keys, 1)
    weight = np.broadcast_to(np.concatenate(weights), keys.shape)
    ids = (np.arange(n, dtype=np.int64)[:, None] << 20 | keys)[keys >= 0]
    values = weight[keys >= 0]
    if not len(ids):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    order = np.argsort(ids)
    ids, values = ids[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    sums = np.add.reduceat(values, first)
    rows, subs = ids[first] >> 20, ids[first] & ((1 << 20) - 1)
    norms = np.sqrt(np.bincount(rows, sums**2, n))
    return rows, subs, sums / norms[rows]


def dense_kernel(a: list[str], b: list[str]) -> np.ndarray:
    """k(u, v) for all u in a, v in b; for words against landmarks, whose subsequences make up one small table."""
    rows, subs, w = mapped(b)
    seen, at = np.unique(subs, return_inverse=True)
    table = np.zeros((len(seen) + 1, len(b)), np.float32)
    table[at, rows] = w
    index = np.full(SYMBOLS**3, len(seen), np.int32)
    index[seen] = np.arange(len(seen))
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(a), 512):
        r, s, v = mapped(a[lo : lo + 512])
        if len(r):
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            out[lo + r[first]] = np.add.reduceat(v[:, None].astype(np.float32) * table[index[s]], first)
    return out


def pieces_of(word: str) -> list[str]:
    """The word, or overlapping pieces of LENGTH characters that cover a longer one."""
    return [word[at : at + LENGTH] for at in range(0, max(1, len(word) - LENGTH // 2), LENGTH // 2)]


@dataclass
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float
    calibration: np.ndarray  # weights of the TOP highest decisions, then a constant
    landmarks: list[str]

    def decisions(self, words: list[str]) -> np.ndarray:
        """The SVM's decision for each word; the worst piece counts for long ones."""
        pieces, owner = [], []
        for k, w in enumerate(words):
            for piece in pieces_of(w):
                pieces.append(piece)
                owner.append(k)
        out = np.full(len(words), -np.inf)
        order = np.argsort([len(p) for p in pieces], kind="stable")  # words of one length share a matrix without padding
        owner = np.array(owner, int)
        for lo in range(0, len(pieces), 4_000):
            at = order[lo : lo + 4_000]
            r, s, v = mapped([pieces[k] for k in at])
            np.maximum.at(out, owner[at], np.bincount(r, v * self.table[s], len(at)) + self.bias)
        return out

    def score(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(tops @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


class WordCache:
    """Decisions of words, bounded; one for each Python worker and model."""

    def __init__(self, model: Model, limit: int = 600_000):
        self.model, self.limit, self.known = model, limit, {}

    def tops(self, texts: list[str]) -> np.ndarray:
        """The TOP highest decisions among the distinct words of each text, descending; filled with the bias."""
        split = [set(spelled(t.split())) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        forms = list({folded(w) for w in new})
        values = dict(zip(forms, self.model.decisions(forms).tolist()))
        known.update((w, values[folded(w)]) for w in new)
        out = np.full((len(texts), TOP), self.model.bias)
        for i, words in enumerate(split):
            least = sorted(map(known.__getitem__, words))[-3 * TOP :][:1]
            best = {folded(w): known[w] for w in words if known[w] >= least[0]}  # Idiot! and idiot are one word
            got = sorted(best.values(), reverse=True)[:TOP]
            out[i, : len(got)] = got
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the constant. y in {-1, 1}."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        slack = 1 - y * (x @ w[:-1].astype(x.dtype) + w[-1])  # x stays as it is, not widened as a whole
        on = np.flatnonzero(slack > 0)
        gradient, curve = ridge @ w, ridge.copy()
        for lo in range(0, len(on), 8_192):
            k = on[lo : lo + 8_192]
            a = np.concatenate([x[k], np.ones((len(k), 1))], 1)
            gradient -= 2 * c * a.T @ (weight[k] * y[k] * slack[k])
            curve += 2 * c * (a * weight[k][:, None]).T @ a
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def inserted(word: str) -> list[str]:
    """The word with one letter put in, at each inner place: instances that teach the tolerance for insertions."""
    return [word[:k] + "xqzaeo"[k % 6] + word[k:] for k in range(1, len(word))]


def train_words(toxic: list[str], clean: list[str], landmarks: int) -> Model:
    """SVM over the words; up to half of the landmarks are toxic words."""
    if not toxic or not clean:
        return Model(np.zeros(SYMBOLS**3, np.float32), -1.0, np.array([0.0] * TOP + [-3.0 if clean else 0.0]), [])
    marks = toxic[: landmarks // 2]
    near = np.concatenate([dense_kernel(clean[lo : lo + 16_384], marks).max(1) for lo in range(0, len(clean), 16_384)])
    hard = np.argsort(-near, kind="stable")  # the clean words most like an insult, and the most frequent ones
    marks = list(dict.fromkeys([*marks, *(clean[k] for k in hard[: (landmarks - len(marks)) // 2]), *clean[:landmarks]]))[:landmarks]
    k = dense_kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    varied = [v for w in toxic if len(w) >= 5 for v in inserted(w)]
    words = toxic + varied + clean
    y = np.array([1.0] * (len(toxic) + len(varied)) + [-1.0] * len(clean))
    weight = np.concatenate([np.full(len(x), share / max(1, len(x))) for x, share in ((toxic, 0.4), (varied, 0.1), (clean, 0.5))]) * len(toxic)
    x = np.empty((len(words), root.shape[1]), np.float32)
    for lo in range(0, len(words), 16_384):
        x[lo : lo + 16_384] = dense_kernel(words[lo : lo + 16_384], marks) @ root
    w = svm(x, y, weight)
    b = root @ w[:-1]
    table = np.zeros(SYMBOLS**3, np.float32)
    r, s, v = mapped(marks)
    np.add.at(table, s, v * b[r])
    return Model(table, float(w[-1]), np.zeros(TOP + 1), marks)


def calibrated(tops: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, none negative but the constant, for the highest decisions."""
    x = np.concatenate([tops, np.ones((len(tops), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.03 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.03 * w)
        w[:] = w + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, landmarks: int = 256, max_rows: int = 20_000, max_words: int = 150_000) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) mod folds isn't held_out.

    max_rows bounds the sample: of more labelled rows those with the smallest hashes of their ids are taken, a few less
    than max_rows. Of several labels of an id the largest counts, of several texts the last in order. Null labels, ids and texts teach
    nothing; without labelled texts of both kinds every score is the same. Of the words of the sample that pass the tests below, max_words of each kind train the SVM, those with the most
    contexts, which bounds the driver whatever the texts' lengths.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").where(crc_mod(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max(F.col(label).cast("long")).alias("label"))
    share = min(1.0, 0.97 * max_rows / max(1, known.count()))
    picked = smallest_hashes(known, share).limit(max_rows)
    rows = stored(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("text", "label"), "toxic-sample")

    def contexts(it):
        import xxhash

        for batch in batches(it, ["text", "label"]):
            seen = {}
            for text, y in batch:
                words = [w for w in map(folded, spelled(text.split())) if w]
                for before, w in zip(["", *words], words):
                    if len(w) >= 3:
                        context = xxhash.xxh64_intdigest(before) >> 1
                        seen.update(((piece, context, y), None) for piece in pieces_of(w) if len(piece) >= 3)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.int32())], ["word", "before", "label"])

    pairs = rows.mapInArrow(contexts, "word string, before long, label int").distinct()
    counts = stored(pairs.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")), "toxic-words")
    n = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("*").alias("words")).first()
    prior = max(1, n.bad) / max(1, n.bad + n.good)
    # Log-likelihood ratio of a word's contexts against the prior; its bound grows with the number of words looked at.
    c = F.col("bad") + F.col("good")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (c * p))).otherwise(0.0)
    strength = term(F.col("bad"), prior) + term(F.col("good"), 1 - prior)
    often = F.col("bad") / c
    toxic = [r.word for r in counts.where((often > 0.9) & (strength > math.log(max(1, n.words)) + 1)).orderBy(F.desc("bad"), "word").limit(max_words).collect()]
    clean = [r.word for r in counts.where((F.col("good") >= 2) & (often < 2 * prior)).orderBy(F.desc("good"), "word").limit(max_words).collect()]
    model = train_words(toxic, clean, landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(it):
        cache = WordCache(shared.value)
        for batch in batches(it, ["text", "label"]):
            yield pa.RecordBatch.from_arrays([pa.array(cache.tops([t or "" for t, _ in batch]).tolist(), pa.list_(pa.float64())), pa.array([y for _, y in batch], pa.int64())], ["tops", "label"])

    sample = rows.mapInArrow(measure, "tops array<double>, label long").collect()
    if toxic and clean and sample:
        model.calibration = calibrated(np.array([r.tops for r in sample]), np.array([r.label for r in sample], float))
    return model


def scored(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text). Null text is empty, which has a score too; a null id counts as fold 0, so
    it is held out where that is. Repeated rows are scored one by one, equal texts alike; other columns are ignored; an empty table gives an empty result."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(it):
        cache = worker_cache("toxic words", key, lambda: WordCache(shared.value))
        for rows in batches(it, ["doc_id", "text", "held_out"]):
            s = cache.model.score(cache.tops([r[1] or "" for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
