"""The registered queries themselves: columns and types of their results, SQL twins, and thresholds."""

import zlib

import duckdb
import pytest

from panelforge.llm import queries

DATA = "/root/testdata/sf0.001"
SCHEMAS = {
    "op1_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint"},
    "op5_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op10_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


@pytest.mark.parametrize("name", SCHEMAS)
def test_query(spark, corpus, name):
    out = queries.QUERIES[name](spark, DATA)
    assert {k: v for k, v in out.dtypes if k in SCHEMAS[name]} == SCHEMAS[name]
    rows = out.collect()
    table, key = ("pages", "page_id") if "page_id" in out.columns else ("documents", "doc_id")
    ids = sorted(r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    assert sorted({r[key] for r in rows} if name.startswith("op5_") else [r[key] for r in rows]) == (sorted(set(ids)) if name.startswith("op5_") else ids)
    for r in rows:
        if "held_out" in out.columns:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if "over_limit" in out.columns:
            assert r["over_limit"] == (r["n_tokens"] > 2048)
        if "predicted" in out.columns:
            assert r["predicted"] == (r["score"] >= 0.7)
        if "sequence_id" in out.columns:
            assert 0 < r["length"] <= 2048 and 0 <= r["offset"] <= 2048 - r["length"]


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_twin(spark, corpus, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    twin = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in twin.description]
    key = lambda r: tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in r)
    out = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(key, out.collect())) == sorted(map(key, twin.fetchall()))
