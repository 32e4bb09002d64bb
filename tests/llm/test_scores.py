import math
import zlib
from collections import Counter

import public_tokenizers
import pytest

from strandex.llm import lattice_lm

from .helpers import docs, small

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_recursion_sums_all_segmentations():
    first = {b"": -2.0, b"a": -1.0, b"ab": -1.5}
    inner = {b"a": -2.0, b"b": -1.2, b"ab": -0.7, b"c": -3.0}

    def brute(w, table):
        if not w:
            return 1.0 if table is inner else math.exp(first[b""])
        total = sum(math.exp(table[w[:k]]) * brute(w[k:], inner) for k in range(1, len(w) + 1) if w[:k] in table)
        return total + (math.exp(first[b""]) * brute(w, inner) if table is first else 0)

    lattice = lattice_lm.Lattice(first, inner)
    for w in (b"a", b"ab", b"abc", b"abab"):
        assert math.isclose(math.exp(lattice.word(w)), brute(w, first))
    assert lattice.word(b"z") == -math.inf


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_base_scores(spark, heavy):
    rows = {r.doc_id: r for r in lattice_lm.scored(small(spark), MODEL, heavy=heavy).collect()}
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r, w = rows[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert -1e9 < r.score < 0


def test_heavy_words_change_nothing(spark):
    a = {r.doc_id: r.score for r in lattice_lm.scored(small(spark), MODEL, heavy=3).collect()}
    b = {r.doc_id: r.score for r in lattice_lm.scored(small(spark), MODEL, heavy=10**6).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_odd_rows(spark):
    table = docs(spark, ids=[0, 1, 1, None, 4, 5, 6, 7, 8])
    rows = lattice_lm.scored(table, MODEL).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1] and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert lattice_lm.scored(docs(spark, []), MODEL).count() == 0


def summed(w, lattice):
    """Probability of a word over all its segmentations, one by one."""
    def rest(x):
        return 1.0 if not x else sum(math.exp(lattice.inner[x[:k]]) * rest(x[k:]) for k in range(1, len(x) + 1) if x[:k] in lattice.inner)

    return sum(math.exp(lattice.first[w[:k]]) * rest(w[k:]) for k in range(len(w) + 1) if w[:k] in lattice.first)


def test_scores_of_small_texts_by_brute_force(spark):
    texts = [("en", "the cat saw the dog"), ("en", "The dog and the cat"), ("fr", "le chat et le chien"), (None, "xy zq"), ("en", ""), ("fr", None), ("en", "a cat a zebra")]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10][: len(texts) - 1] + [i for i in range(200) if not zlib.crc32(str(i).encode()) % 10][:1]
    table = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in zip(ids, texts)], "doc_id long, text string, lang string, c0 int")
    words = lambda t: (t or "").encode().lower().split()
    train, common = texts[:-1], ["en", "fr", ""]
    count = {lang: Counter(w for x, t in train if (x or "") == lang for w in words(t)) for lang in common}
    total = sum(count.values(), Counter())
    lattice = lattice_lm.trained(spark.createDataFrame([(w.decode(),) for w in total], "word string"), MODEL)

    def share(counts, ends, c, below):
        n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
        once, twice = (sum(x == k for x in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        return max(c - d, 0) / n + d * v / n * below

    ends = {lang: sum((x or "") == lang for x, _ in train) for lang in common}
    n = sum(total.values()) + len(train)
    stop = (len(train) + 1) / (n + 2)
    got = {r.doc_id: r for r in lattice_lm.scored(table, MODEL, classes=4).collect()}
    for i, (_, t) in zip(ids, texts):
        each = []
        # The fourth class stays empty: its counts are the common ones.
        for lang in [*common, "none"]:
            own, e = count.get(lang, Counter()), ends.get(lang, 0)
            p = (ends.get(lang, 0) + 1) / (len(train) + 4)
            for w in words(t):
                below = share(total, len(train), total[w], summed(w, lattice))
                p *= share(own, e, own[w], below) if sum(own.values()) + e else below
            below = share(total, len(train), len(train), math.exp(-700))
            p *= share(own, e, e, below) if sum(own.values()) + e else below
            each.append(p)
        assert math.isclose(got[i].score, math.log10(sum(each)), rel_tol=1e-6)
        assert math.isclose(got[i].lattice_score, sum(math.log10(summed(w, lattice) * (1 - stop)) for w in words(t)) + math.log10(stop), rel_tol=1e-6)
