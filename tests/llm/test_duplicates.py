import random

from pyspark.sql import functions as F

from strandex.llm import components, exact_dedup, near_dedup

from .helpers import docs, small


def test_components(spark):
    n = 200
    rng = random.Random(1)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(170)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_steps_of_small_graphs_write_few_files(spark, monkeypatch):
    """Also where Spark doesn't join small partitions; with few rows a task the result is the same."""
    from pathlib import Path

    from strandex.operators import components as stars

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(60)], "src long, dst long")
    files, settings = [], {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def seen(made):
        def make(df, name, **more):
            out = made(df, name, **more)
            table = out[0] if isinstance(out, tuple) else out
            files.append((name, len(list(Path(table.stored_path.removeprefix("file:")).glob("part-*.parquet")))))
            return out

        return make

    monkeypatch.setattr(stars, "stored", seen(stars.stored))
    monkeypatch.setattr(stars, "counted", seen(stars.counted))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for task_rows, most in ((100_000, 1), (50, 5)):
            monkeypatch.setattr(stars, "TASK_ROWS", task_rows)
            files.clear()
            got = {r.node: r.component for r in stars.components(edges).collect()}
            assert got == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 260)]}
            assert len(files) > 4 and all(0 < n <= most for _, n in files[1:]), files
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_passing_state_has_no_checksum_files(spark, tmp_path, monkeypatch):
    """A state folder that is kept has them."""
    monkeypatch.setattr(exact_dedup, "shared_path", lambda spark, name: f"file://{tmp_path}/passing")
    rows = [exact_dedup.exact_groups(docs(spark), **more).collect() for more in ({}, {"state_dir": f"file://{tmp_path}/kept"})]
    assert groups(rows[0]) == groups(rows[1])
    changes, sums = ({d: list((tmp_path / d / "checkpoint/state").rglob(p)) for d in ("passing", "kept")} for p in ("[0-9]*.changelog", "[0-9]*.changelog.crc"))
    assert changes["passing"] and changes["kept"] and not sums["passing"] and sums["kept"]


def groups(rows):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)


def test_exact_groups(spark):
    rows = exact_dedup.exact_groups(docs(spark)).collect()
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert by[0] == by[0] and by[0] == (1, 2, False) and by[1] == (1, 2, True) and by[3] == (4, 2, False) and by[4] == (4, 2, True) and by[2] == (2, 1, True)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_repeated_and_null_ids_keep_one_row(spark):
    rows = exact_dedup.exact_groups(docs(spark, ["a", "a", "a", "b", "b"], [7, 7, None, None, None])).collect()
    assert sorted((r.keep_id is None, r.group_size) for r in rows) == [(False, 3)] * 3 + [(True, 2)] * 2
    assert sum(r.kept for r in rows if r.keep_id == 7) == 1 and sum(r.kept for r in rows if r.keep_id is None) == 1


def test_collisions_are_told_apart_by_bytes(spark):
    texts = ["apple", "avocado", "apple", "banana", "avocado", "apricot"]
    rows = exact_dedup.exact_groups(docs(spark, texts), digest=lambda t: F.substring(t, 1, 1)).collect()
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert by == {0: (2, 2, False), 1: (4, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 2, True), 5: (5, 1, True)}


def test_distinct_documents(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    kept = exact_dedup.distinct_documents(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 7, 8]


def by_id(rows):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows.collect()}


def test_runs_go_on_from_a_state_folder(spark, tmp_path):
    state, first = f"file://{tmp_path}/state", lambda t: F.substring(t, 1, 1)
    run = lambda texts, ids, name: by_id(exact_dedup.exact_groups(docs(spark, texts, ids), state_dir=state, run=name))
    one = run(["a", "b", "a"], [1, 2, 3], "one")
    assert one == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)} == run(["a", "b", "a"], [1, 2, 3], "one")
    assert run(["a", "b", "c"], [0, 5, 6], "two") == {0: (3, 3, False), 5: (5, 2, True), 6: (6, 1, True)}
    assert run(["b", "c", "a"], [4, 9, 8], "three") == {4: (5, 3, False), 9: (9, 2, True), 8: (8, 4, True)}
    assert run([], [], "none") == {}

    other = f"file://{tmp_path}/other"
    go = lambda texts, ids: by_id(exact_dedup.exact_groups(docs(spark, texts, ids), first, other))
    assert go(["apple", "avocado", "apple", "banana"], [1, 2, 3, 4]) == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}
    assert go(["apricot", "avocado", "banana"], [10, 11, 12]) == {10: (10, 1, True), 11: (11, 2, True), 12: (12, 2, True)}
    assert go(["apple", "apricot", "apple"], [5, 6, 7]) == {5: (7, 4, False), 6: (10, 2, False), 7: (7, 4, True)}


def test_exact_groups_of_clashing_columns(spark):
    table = docs(spark, ["a", "a", "b"]).withColumns({"__row": F.lit("x"), "__file": F.lit(1), "at": F.lit(2), "best": F.lit(3)})
    assert by_id(exact_dedup.exact_groups(table)) == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True)}
    kept = exact_dedup.distinct_documents(table)
    assert kept.columns == table.columns and {(r.doc_id, r["__row"], r["__file"]) for r in kept.collect()} == {(1, "x", 1), (2, "x", 1)}


def near_model(rows, words, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                c = len(sets[x] & sets[y])
                if c * share[1] >= share[0] * (len(sets[x]) + len(sets[y]) - c):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near(df, words=3, share=(85, 100)):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df, words, share).collect()}


def test_near_groups_of_odd_rows(spark):
    table = docs(spark)
    assert near(table) == near_model([(r.doc_id, r.text) for r in table.collect()], 3, (85, 100))
    assert near(docs(spark, [])) == {}
    nulls = docs(spark, ["a b c d", "a b c d", None], [None, 4, None])
    assert sorted(map(str, near_dedup.near_groups(nulls, 3, (85, 100)).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=None, kept=True)", "Row(doc_id=4, n_shingles=2, component_id=4, kept=True)", "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)"])


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = near_dedup.near_groups(docs(spark, [a, a, b, b, None, "other words stand here"], [3, 5, 5, 7, 5, 6]), 3, (85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [(3, 4, 3, True), (5, 0, 3, False), (5, 4, 3, False), (5, 4, 3, False), (6, 2, 6, True), (7, 4, 3, False)]


def test_near_groups_of_a_table(spark):
    table = small(spark)
    for words, share in ((3, (85, 100)), (5, (80, 100))):
        assert near(table, words, share) == near_model([(r.doc_id, r.text) for r in table.collect()], words, share)


def test_a_large_group_beside_its_fringe(spark):
    """Hundreds of variants of one text at all distances around the threshold: large regions, forests and the second pass."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 6, 8))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(table) == near_model(rows, 3, (85, 100))


def isolated_pairs(n, pairs, edits):
    """n variants of one text, each with its own `edits` words; row i + n / 2 has all but one of those of row i, for i < pairs."""
    rng, made, rows = random.Random(5), [], []
    for i in range(n):
        if n // 2 <= i < n // 2 + pairs:
            own = dict(made[i - n // 2])
            own[next(iter(own))] = f"x{i}"
        else:
            own = {at: f"x{i}at{at}" for at in rng.sample(range(200), edits)}
        made.append(own)
        rows.append((i, " ".join(own.get(at, f"w{at}") for at in range(200))))
    return rows


def test_isolated_pairs_in_a_run_of_many_regions(spark):
    """1,600 texts with mostly equal signatures, of which 200 pairs are links: the rows of a pair are far apart in a run."""
    rows = isolated_pairs(1600, 200, 4)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = near(table, 1, (985, 1000))
    assert {i: c for i, (_, c, _) in got.items()} == {i: i - 800 if 800 <= i < 1000 else i for i in range(1600)}


def test_one_of_each(spark):
    table = small(spark)
    model = near_model([(r.doc_id, r.text) for r in table.collect()], 5, (80, 100))
    kept = near_dedup.one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, _, k) in model.items() if k}
