import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import centroids


def brute(rows, k, rounds, d=64):
    """rows (vec_id, components): cluster, distance, inertia of the cluster and of all, digest, as multiset rows."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    means = [v for _, _, v in named[:k]]
    if not means:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        means = [[sum(v[j] for (_, v), o in zip(kept, own) if o == c) // own.count(c) for j in range(d)] if c in own else means[c] for c in range(len(means))]
    last = [near(v) for _, v in kept]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, s, sum(x for x, y in last if y == c), sum(x for x, _ in last), name[c]) for (i, _), (s, c) in zip(kept, last)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "cluster": F.lit(None), "distance": F.lit(1)})


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 64)).astype("float32").tolist() + rng.integers(-2, 3, (40, 64)).astype(float).tolist()
    rows = list(enumerate(x))
    rows += [(5, x[5]), (5, x[6]), (None, x[7]), (200, x[8]), (201, None), (202, []), (203, x[0][:63]), (204, [*x[0], 0.0]), (205, [math.nan, *x[0][1:]]), (206, [None, *x[0][1:]]), (207, [math.inf, *x[0][1:]]), (208, [0.0] * 64), (209, [0.0] * 64)]
    got = sorted(map(tuple, centroids.clusters(vectors(spark, rows), k=12, rounds=3).collect()), key=str)
    assert got == brute(rows, 12, 3)
    few = rows[:5]
    assert sorted(map(tuple, centroids.clusters(vectors(spark, few), k=40, rounds=2).collect()), key=str) == brute(few, 40, 2)
    for none in (rows[:0], [(None, x[0])], [(1, None)]):
        assert centroids.clusters(vectors(spark, none)).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 4000])
def test_walk_finds_the_nearest_and_stops_early(spread):
    rng = np.random.default_rng(spread)
    means = rng.integers(-spread, spread + 1, (300, 3))
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, 3)), means[:50]])
    who, best, computed = centroids.Lists(means).nearest(x)
    every = ((x[:, None] - means[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (best == every.min(1)).all()  # argmin takes the first of equals
    assert spread < 4000 or computed < every.size / 4


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(vectors(spark, [(1, [1e30] * 64)])).collect()
