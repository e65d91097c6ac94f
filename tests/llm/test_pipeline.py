"""The pipeline's stages against brute-force versions of each, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from tests_llm_helpers import brute_components, brute_copies

DATA = "/root/testdata/sf0.001"


def test_stages(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["quality"]
    assert 0.7 * len(before) < len(after) < len(before)
    before, after = seen["exact_dedup"]
    assert {r["doc_id"] for r in after} == {max(ids) for ids in brute_copies(before).values()}
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} == set(brute_components(before, 5)[0].values())
    before, after = seen["mixing"]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    tokens = sum(r["length"] for r in after)
    assert len({r["sequence_id"] for r in after}) <= 1.05 * -(-tokens // 2048) + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_on_edges(spark, edge_docs, no_docs):
    """Nulls, empty and repeated rows and clashing columns through every stage; empty tables stay empty."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, DATA)
        assert out.columns == corpus_pipeline.COLUMNS or name == "packing"
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= {r["doc_id"] for r in edge_docs.collect()} and ids
        assert stage(spark, no_docs, DATA).count() == 0
        if name == "exact_dedup":
            assert ids.count(10) == 1 and None in ids and sorted({3, 4} & set(ids)) == [4]
