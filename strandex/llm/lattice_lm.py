"""Language-model scores by a subword lattice: the marginal probability of a text over all its segmentations.

The vocabulary is an existing one. Its unigram scores come from how often its pieces occur in the training words, with a prior that falls with
the rank the vocabulary itself gives a piece. A word, with the mark that starts it, is a lattice with an arc for every piece
that fits (single bytes always do); a forward recursion in log space sums all paths. Pieces are counted once for each distinct word, as the
lattice is for words that training has not seen. A word that it has seen is one arc more, with its count less an absolute discount; the
discounts are the lattice's weight. Words and the end of a text are independent given the text's class: a class is one of the
most frequent languages of the training rows, with counts of its own above the common ones, and the classes are summed out, so a
score is the probability of the text alone.

Each distinct word of the corpus is scored once. Words that make up at least 1 / HEAVY of all tokens (so at most HEAVY of them, whatever
the corpus) go to the tasks as a broadcast table; the other words of a text are joined by shuffle, where none can be hot.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, stored, worker_cache

HEAVY = 300_000
MARK = "▁"


def tokens(text: str | None) -> list[bytes]:
    """Runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def lexicon(docs: DataFrame, classes: int) -> DataFrame:
    """word, t (times in all rows), c0, c1, ... (times in training rows of a class); docs has text and class (-1: not in training)."""
    names = ["t", *(f"c{k}" for k in range(classes))]

    def count(it):
        held = [Counter() for _ in range(classes + 1)]  # the last: not in training

        def flush():
            words = list(set().union(*held))
            counts = [[h[w] for w in words] for h in held]
            total = np.sum(counts, axis=0, dtype=np.int64) if words else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(total), *(pa.array(c, pa.int64()) for c in counts[:-1])], ["word", *names])
            for h in held:
                h.clear()

        for rows in batches(it, ["text", "class"]):
            for text, k in rows:
                held[k].update(tokens(text))
            if sum(map(len, held)) > 250_000:
                yield from flush()
        yield from flush()

    shape = "word string, " + ", ".join(f"{c} long" for c in names)
    return docs.select("text", "class").mapInArrow(count, shape).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


class Lattice:
    """Natural-log scores of the pieces; first: those that start a word (without the mark), inner: the others, as bytes."""

    def __init__(self, first: dict[bytes, float], inner: dict[bytes, float]):
        self.first, self.inner = first, inner
        self.longest = max(map(len, [*first, *inner]), default=1)

    def word(self, w: bytes) -> float:
        """log of the summed probability of all segmentations."""
        n, longest, first, inner = len(w), self.longest, self.first, self.inner
        into: list[list[float]] = [[] for _ in range(n + 1)]
        for k in range(min(n, longest) + 1):
            s = first.get(w[:k])
            if s is not None:
                into[k].append(s)
        at = -math.inf
        for i in range(n + 1):
            terms = into[i]
            if not terms:
                continue
            if len(terms) == 1:
                at = terms[0]
            else:
                top = max(terms)
                at = top + math.log(sum([math.exp(x - top) for x in terms]))
            if i == n:
                return at
            for k in range(i + 1, min(n, i + longest) + 1):
                s = inner.get(w[i:k])
                if s is not None:
                    into[k].append(at + s)
        return -math.inf


def trained(words: DataFrame, model_path: str) -> Lattice:
    """Scores from the distinct words in training (a column word)."""
    import sentencepiece

    def pieces(it):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        total = np.zeros(sp.get_piece_size())
        for rows in batches(it, ["word"], 500_000):
            total += np.bincount([i for s in sp.encode([r[0] for r in rows], num_threads=1) for i in s], minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], ["piece", "n"])

    counted = words.select("word").mapInArrow(pieces, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = sp.get_piece_size()  # the driver gets one row per piece at most
    n = np.zeros(size)
    for r in counted.collect():
        n[r.piece] = r.n
    use = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)])
    rank = np.array([-sp.get_score(i) if not sp.is_byte(i) else size for i in range(size)])
    prior = np.where(use, 1 / (10 + np.maximum(rank, 0)), 0)
    weight = np.where(use, n, 0) + 0.01 * size * prior / prior.sum()
    total = weight.sum()
    first, inner = {}, {}
    for i in np.flatnonzero(use).tolist():
        score = math.log(weight[i] / total)
        if sp.is_byte(i):
            inner[bytes([int(sp.id_to_piece(i)[1:-1], 16)])] = score
    for i in np.flatnonzero(use).tolist():
        text, score = sp.id_to_piece(i), math.log(weight[i] / total)
        if sp.is_byte(i):
            continue
        if text.startswith(MARK) and MARK not in text[1:]:
            first[text[1:].encode()] = score
        elif MARK not in text:
            key = text.encode()
            inner[key] = float(np.logaddexp(score, inner[key])) if key in inner else score
    return Lattice(first, inner)


class _Heavy(dict):
    def __missing__(self, _):
        return -1


class Counts:
    """What training has counted: n tokens, v distinct ones, and the discount of absolute discounting, for one class or for all."""

    def __init__(self, n: int, v: int, once: int, twice: int):
        self.n, self.v = n, v
        self.discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    def share(self, c: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities from counts c, with the discounts spread by the probabilities below."""
        if not self.n:
            return below
        return np.maximum(c - self.discount, 0) / self.n + self.discount * self.v / self.n * below


def scored(docs: DataFrame, model_path: str, folds: int = 10, held_out: int = 0, alpha: float = 0.1, heavy: int = HEAVY, classes: int = 6) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    Rows whose crc32(doc_id as text) mod folds is held_out are not learned from; a null doc_id counts as 0. A text's tokens are its words
    and one end, so null and empty texts have one token. base_score is the log10 probability under counts smoothed by alpha,
    score under the whole model, lattice_score under the lattice without the arcs of seen words and without classes; lang only sorts training rows into classes (the most frequent languages, one class for the rest and nulls).
    Repeated rows are scored (and, in training, counted) one by one; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    fold = crc_mod(F.col("doc_id"), folds)
    lang = F.coalesce("lang", F.lit(""))
    common = [r.lang for r in docs.where(fold != held_out).groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(classes - 1).collect()]
    place = F.lit(len(common))
    for k, name in enumerate(common):
        place = F.when(lang == name, k).otherwise(place)
    size = len(common) + 1
    rows = docs.select("doc_id", "text", (fold == held_out).alias("held_out"), F.when(fold != held_out, place).otherwise(-1).alias("class"))
    columns = [f"c{k}" for k in range(size)]
    words = stored(lexicon(rows, size).withColumn("c", sum(F.col(c) for c in columns)), "lexicon")
    of = lambda c: [F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}"), *(F.count(F.when(x, 1)).alias(f"{k}_{c}") for k, x in (("v", F.col(c) > 0), ("once", F.col(c) == 1), ("twice", F.col(c) == 2)))]
    sums = words.agg(*(x for c in ["c", *columns] for x in of(c)), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    held = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    ends = np.array([held.get(k, 0) for k in range(size)], float)
    end = int(ends.sum())
    n, v = sums.n_c + end, sums.v_c + (end > 0)
    everything = Counts(n, v, sums.once_c, sums.twice_c)
    each = [Counts(sums[f"n_{c}"] + int(e), sums[f"v_{c}"] + int(e > 0), sums[f"once_{c}"], sums[f"twice_{c}"]) for c, e in zip(columns, ends)]
    lattice = spark.sparkContext.broadcast(trained(words.where("c > 0"), model_path))
    stop = (end + 1) / (n + 2)  # the lattice alone has no word counts: a text goes on or ends after each word
    go_on = math.log10(1 - stop)
    log_base = lambda c: np.log10((np.asarray(c, float) + alpha) / (n + alpha * (v + 1)))

    def mixed(total, by_class, logs):
        """log10 of a token's probability in each class. Below 1e-250 the lattice's is scaled back after the sums, which are linear in it then."""
        logs = np.asarray(logs, float)
        low = np.minimum(logs + 575, 0)
        back = everything.share(np.asarray(total, float), np.exp(logs - low))
        deep = np.where(np.asarray(total) > 0, 0, low) / math.log(10)
        return [np.log10(m.share(np.asarray(c, float), back)) + deep for m, c in zip(each, by_class)]

    def score_words(it):
        for part in batches(it, ["word", "t", "c", *columns], 500_000):
            counts = np.array([r[2:] for r in part], np.int64).T
            alone = np.array([lattice.value.word(r[0].encode()) for r in part])
            lm = [*mixed(counts[0], counts[1:], alone), alone / math.log(10) + go_on]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array(counts[0]), pa.array(log_base(counts[0])), *map(pa.array, lm)], ["word", "t", "c", "base", *logs_of])

    logs_of = [f"lm{k}" for k in range(size + 1)]  # by class, and under the lattice alone
    doubles = "".join(f", {c} double" for c in logs_of)
    table = stored(words.mapInArrow(score_words, f"word string, t long, c long, base double{doubles}"), "word-scores")
    least = (sums.t + heavy) // heavy  # at most `heavy` words can have that many of sums.t tokens
    top = table.where(F.col("t") >= least).toArrow()
    end_base, end_lm = float(log_base([end])[0]), np.array([float(x[0]) for x in mixed([end], ends[:, None], [-700.0])] + [math.log10(stop)])
    shared = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy() > 0, top["base"].to_numpy(), np.stack([top[c].to_numpy() for c in logs_of], 1)))
    key = words.stored_path

    def score_docs(it):
        from pyspark import TaskContext

        def unpacked():
            names, known, base, lm = shared.value
            return _Heavy((w.encode(), i) for i, w in enumerate(names)), np.append(known, False), np.append(base, 0.0), np.append(lm, np.zeros((1, size + 1)), 0)

        index, known, base, lm = worker_cache("heavy words", key, unpacked)
        uid = TaskContext.get().partitionId() << 36
        for part in batches(it, ["doc_id", "text", "held_out"]):
            out = [[] for _ in range(9)]
            for doc_id, text, held_row in part:
                split = tokens(text)
                at = np.fromiter(map(index.__getitem__, split), np.int64, len(split))
                rare = Counter([split[i] for i in np.flatnonzero(at < 0).tolist()])
                for column, value in zip(out, (uid, doc_id, held_row, len(split) + 1, int(known[at].sum()) + (end > 0), float(base[at].sum()) + end_base, lm[at].sum(0) + end_lm, [w.decode() for w in rare], list(rare.values()))):
                    column.append(value)
                uid += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "words", "times"])

    shape = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm array<double>, words array<string>, times array<long>"
    scores = stored(rows.select("doc_id", "text", "held_out").mapInArrow(score_docs, shape), "doc-scores", compression="zstd")
    tail = scores.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    rare = table.where(F.col("t") < least).select("word", "c", F.col("base").alias("wb"), *logs_of)
    extra = tail.join(rare, "word").groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("xk"), F.sum(F.col("k") * F.col("wb")).alias("xb"), *(F.sum(F.col("k") * F.col(c)).alias(c) for c in logs_of))
    out = scores.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm").join(extra, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    weights = np.log10((ends + 1) / (ends.sum() + size))
    by_class = [F.col("lm")[k] + zero(c) + float(weights[k]) for k, c in enumerate(logs_of[:-1])]
    best = F.greatest(*by_class, by_class[0])
    score = best + F.log10(sum(F.pow(F.lit(10.0), x - best) for x in by_class))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("xk", F.lit(0))).alias("n_known"), F.lit(int(n)).alias("train_tokens"), (F.col("base") + zero("xb")).alias("base_score"), score.alias("score"), (F.col("lm")[size] + zero(logs_of[-1])).alias("lattice_score"))
