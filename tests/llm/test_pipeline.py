from pyspark.sql import functions as F

import corpus_pipeline
from strandex.llm import contamination, exact_dedup, quality
from strandex.llm.common import stored

from .helpers import TEXTS, docs
from .test_duplicates import near_model
from .test_filters import brute_hits
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [table]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(stored(stage(spark, outs[-1], SF), f"test-{name}"))
    assert all(set(o.columns) == set(table.columns) for o in outs[:-1])
    rows = [{r.doc_id: r.text for r in o.collect()} for o in outs[:-1]]
    trees = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows[1].keys() == {r.doc_id for r in quality.scored(table, trees).collect() if r.predicted}
    largest = {}
    for i, t in rows[1].items():
        largest[t] = max(i, largest.get(t, i))
    assert rows[2].keys() == set(largest.values())
    assert rows[3].keys() == {i for i, (_, _, kept) in near_model(list(rows[2].items()), 5, (80, 100)).items() if kept}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[4].keys() == {i for i, t in rows[3].items() if not brute_hits(t, items)[1]}
    check_packing(outs[4], outs[5].collect())


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert contamination and corpus_pipeline.ORACLE_SQL is None


def test_stages_of_odd_rows(spark):
    """Nulls, repeated rows and ids, very long and empty texts, clashing columns, an empty table: each stage and all of them in a row."""
    odd = docs(spark, [*TEXTS, TEXTS[3], None, "two words"], [*range(len(TEXTS)), 3, None, 3]).withColumns({"__row": F.lit("x"), "label": F.lit(1), "set_id": F.lit(2), "items": F.lit(3), "source": F.lit(None).cast("string")})
    now = odd
    for name, stage in corpus_pipeline.STAGES:
        alone, now = stage(spark, odd, SF), stored(stage(spark, now, SF), f"odd-{name}")
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0
        if name != "packing":
            assert alone.columns == now.columns == empty.columns == odd.columns and alone.count() <= odd.count()
    check = stored(exact_dedup.distinct_documents(odd), "odd")
    assert check.count() == len({t or "" for t in [*TEXTS, "two words"]})
