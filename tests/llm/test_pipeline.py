import re

import corpus_pipeline
from freightlens.llm import secrets
from freightlens.llm.queries import QUERIES, SQL


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    assert sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))) == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_decisions_take_effect_on_real_rows(spark, sf):
    """Each stage against its operator's own full result on the same input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, sf)
    assert known.schema == docs.schema
    kept = {r["doc_id"] for r in known.collect()}
    clean = {k for k, r in before.items() if r["lang"] and any(c.isalpha() for c in r["text"] or "")}
    assert len(clean - kept) <= 0.01 * len(clean)
    single = stages["near_duplicates"](spark, docs, sf)
    classes = {r["doc_id"]: r["component_id"] for r in QUERIES["op6_simhash_near_duplicates"](spark, sf).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values())) and single.schema == docs.schema
    leaked = {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    safe = stages["decontamination"](spark, docs, sf)
    assert {r["doc_id"] for r in safe.collect()} == set(before) - leaked and leaked and safe.schema == docs.schema
    hidden = stages["secret_scan"](spark, docs, sf)
    assert hidden.schema == docs.schema
    rows = hidden.collect()
    assert len(rows) == len(before) and all((r["text"] is None) or len(r["text"]) == r["n_chars"] for r in rows if r["text"] != before[r["doc_id"]]["text"])
    assert secrets.scan(hidden).where("size(spans) > 0").count() == 0


def test_whole_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
