import io
import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandex.llm import packing, pair_counts, seekable_ids
from strandex.llm.byte_tokens import ChunkEncoder

from .helpers import docs, small

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from(list("ab  \n\t.,!'sté 　漢😀1<|>")), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(BYTES, limit=200)


@pytest.fixture(scope="module")
def counter():
    return pair_counts.PairCounter(WORDS, limit=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_chunks_give_the_library_s_ids(encoder, texts):
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == plain


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pair_counts_are_the_library_s(counter, text):
    assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|>x", "ΣΑΣ ΟΔΟΣ", "İstanbul ß ẞ", "é ́a ﬁ", "x" * 3000, "x\x1cy\x85z"])
def test_pair_counts_of_odd_texts(counter, text):
    assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_merges_take_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("a", "a"): 3}
    assert pair_counts.merged_count(list("abc"), ranks) == 1
    assert pair_counts.merged_count(list("aaa"), {("a", "a"): 0}) == 2
    assert pair_counts.merged_count([], {}) == 0 and pair_counts.merged_count(["a"], {}) == 1


def test_token_counts(spark):
    t = Tokenizer.from_file(WORDS)
    rows = pair_counts.token_counts(docs(spark), WORDS, limit=2048).collect()
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    for r in rows:
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)
    assert pair_counts.token_counts(docs(spark, []), WORDS).count() == 0


def test_token_counts_of_null_and_repeated_ids(spark):
    rows = pair_counts.token_counts(docs(spark, ["two words", "two words", None, "x"], [None, None, 1, 1]), WORDS).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == [(1, 0, 0), (1, 1, 1), (None, 9, 2), (None, 9, 2)]


def expected_ids(texts, end):
    t = Tokenizer.from_file(BYTES)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts]


def check_ids(table, rows):
    order = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (doc_id, _), ids in zip(order, expected_ids([t for _, t in order], 2)):
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_id_files_round_trip(spark):
    table = docs(spark, ids=[5, None, 3, 9, 9, 7, 1, 2, 100])
    manifest = seekable_ids.write_ids(table, BYTES, 2, partitions=3)
    check_ids(table, seekable_ids.read_ids(manifest).collect())
    few = {r.doc_id: r.ids for r in seekable_ids.read_documents(manifest, spark.createDataFrame([(7,), (1,)], "doc_id long")).collect()}
    wanted = {r.doc_id: r.text for r in table.where("doc_id in (1, 7)").collect()}
    assert few == {k: ids.tolist() for (k, _), ids in zip(wanted.items(), expected_ids(wanted.values(), 2))}
    empty = seekable_ids.write_ids(docs(spark, []), BYTES, 2)
    assert seekable_ids.read_ids(empty).count() == 0 and seekable_ids.read_documents(empty, table).count() == 0


def test_requested_documents(spark, monkeypatch):
    table = docs(spark, ["one", "two", None, "four", "five", "six", "seven"], [1, 2, 3, 2, None, None, 90])
    manifest = seekable_ids.write_ids(table, BYTES, 2, partitions=4)
    assert manifest.agg(F.sum("n_null"), F.min("first_id"), F.max("last_id"), F.sum("n_docs")).first() == (2, 1, 90, 7) and manifest.count() > 1
    texts = {1: ["one"], 2: ["four", "two"], 3: [""], 90: ["seven"]}
    expected = lambda ids: sorted((i, x.tolist()) for i in ids for x in expected_ids(texts[i], 2))
    asked = spark.createDataFrame([(i, "x") for i in (2, 2, 3, 50, 1000, -4, None)], "doc_id long, path string")
    for few in (10_000, 1):
        monkeypatch.setattr(seekable_ids, "FEW", few)
        assert sorted((r.doc_id, r.ids) for r in seekable_ids.read_documents(manifest, asked).collect()) == expected((2, 3))
        assert sorted((r.doc_id, r.ids) for r in seekable_ids.read_documents(manifest, table).collect()) == expected((1, 2, 3, 90))
        assert seekable_ids.read_documents(manifest, asked.limit(0)).count() == 0


def test_id_files_of_a_table(spark):
    table = small(spark).select("doc_id", "text")
    check_ids(table, seekable_ids.read_ids(seekable_ids.write_ids(table, BYTES, 2)).collect())


def test_small_manifests_and_id_files_take_few_files_and_tasks(spark, tmp_path, monkeypatch):
    """Each file that Spark writes costs an executor several processes: many parts make one manifest file, and many small files are read by one task."""
    table = small(spark).select("doc_id", "text")
    manifest = seekable_ids.write_ids(table, BYTES, 2, directory=f"file://{tmp_path}/ids", partitions=9)
    assert manifest.count() == 9 and len(list(Path(tmp_path, "ids/manifest").glob("part-*.parquet"))) == 1
    read = seekable_ids.read_ids(manifest)
    assert read.rdd.getNumPartitions() == 1
    check_ids(table, read.collect())
    n_ids = manifest.agg(F.sum("n_ids")).first()[0]
    monkeypatch.setattr(seekable_ids, "TASK_IDS", n_ids // 4)
    several = seekable_ids.read_ids(manifest)
    assert several.rdd.getNumPartitions() in (4, 5)
    check_ids(table, several.collect())


def test_frames_are_independent_and_checked():
    import zstandard

    out = io.BytesIO()
    writer = seekable_ids.FrameWriter(out)
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 700)]
    for k, part in enumerate(parts):
        writer.add(k if k else None, part)
    writer.finish()
    data = out.getvalue()
    reader = seekable_ids.FrameReader(io.BytesIO(data), len(data))
    assert reader.doc_ids == [None, 1, 2] and reader.read(2).tolist() == list(range(700)) and [d for _, d in reader.scan(1)] == parts
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.startswith(b"".join(parts))
    broken = bytearray(data)
    broken[int(reader.starts[2]) + 30] ^= 1
    with pytest.raises(Exception):
        seekable_ids.FrameReader(io.BytesIO(bytes(broken)), len(data)).read(2)
    with pytest.raises(ValueError, match="seekable"):
        seekable_ids.FrameReader(io.BytesIO(b"x" * 40), 40)


def check_packing(table, rows, window=16, targets=None):
    ids = {}
    for r, x in zip(table.collect(), expected_ids([r.text for r in table.collect()], 1)):
        ids[r.doc_id] = x
    places, total = {}, 0
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.queue))
        total += r.length
    assert total == sum(map(len, ids.values()))
    sizes = {}
    for s, parts in places.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes))) and all(n == 2048 for s, n in sizes.items() if s < len(sizes) - 1)
    return places


def test_packing(spark):
    table = small(spark)
    places = check_packing(table, packing.pack(table, BYTES, window_sequences=2).collect())
    share, windows, total = {}, {}, 0
    for s, parts in places.items():
        for _, n, q in parts:
            share[q] = share.get(q, 0) + n
            windows[s // 2, q] = windows.get((s // 2, q), 0) + n
            total += n
    full = {w for w, _ in windows if (w + 1) * 4096 <= total}
    assert all(abs(windows.get((w, q), 0) - 4096 * n / total) < 2 for w in full for q, n in share.items())


def test_packing_with_targets(spark):
    table = small(spark)
    rows = packing.pack(table, BYTES, window_sequences=4, targets={"src0": 1, "src1": 1}).collect()
    places = check_packing(table, rows)
    first = [x for s in range(4) for x in places[s]]
    assert {q for _, _, q in first} == {"src0", "src1"} and sum(n for _, n, q in first if q == "src0") == 4096


def test_packing_of_odd_rows(spark):
    check_packing(docs(spark), packing.pack(docs(spark), BYTES).collect())
    assert packing.pack(docs(spark, []), BYTES).count() == 0
    table = docs(spark, ["a", None, "b"], [1, 1, None], extra=False)
    assert sorted(r.doc_tokens for r in packing.pack(table, BYTES).collect()) == [1, 2, 2]
    many = small(spark)
    check_packing(many, packing.pack(many, BYTES, queues=3).collect())


def test_packing_of_more_sources_than_a_task_adds_up(spark):
    """Every source stays a queue, in the same places, and targets hold."""
    table = small(spark)
    rows = packing.pack(table, BYTES, window_sequences=4, targets={"src0": 1, "src1": 1}, queues=3).collect()
    assert {r.queue for r in rows} == {r.source for r in table.select("source").distinct().collect()}
    first = [x for s in range(4) for x in check_packing(table, rows)[s]]
    assert {q for _, _, q in first} == {"src0", "src1"} and sum(n for _, n, q in first if q == "src0") == 4096
    place = lambda queues: sorted(map(tuple, packing.pack(table, BYTES, queues=queues).collect()))
    assert place(3) == place(4096)


def test_packing_with_a_vocabulary_of_more_than_65536_ids(spark, tmp_path):
    known = public_tokenizers.path("byte_bpe_50k.json")
    about = json.loads(Path(known).read_text())
    vocab = about["model"]["vocab"]
    shift = 70_000  # the same pieces under larger numbers
    about["model"]["vocab"] = {t: i + shift for t, i in vocab.items()} | {f"unused{i}": i for i in range(shift)}
    for t in about.get("added_tokens") or []:
        t["id"] += shift
    large = tmp_path / "large.json"
    large.write_text(json.dumps(about))
    table = docs(spark)
    wide = sorted(map(tuple, packing.pack(table, str(large), end_id=shift + 1, sequence=64).select("doc_id", "start", "length", "ids_crc32").collect()), key=str)
    library = Tokenizer.from_file(str(large))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, shift + 1] for r in table.collect()}
    assert max(map(max, ids.values())) > 65_535 and sum(r[2] for r in wide) == sum(map(len, ids.values()))
    assert all(crc == zlib.crc32(np.array(ids[i][start : start + n], "<u4").tobytes()) for i, start, n, crc in wide)
