"""The pipeline's stages in turn, and the registered queries."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reelflow.llm import decontamination, minhash_dedup
from reelflow.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck
from tests.conftest import SF001, SF01


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    problems, n, _ = compare(spark, duck(SF01), name, QUERIES[name], ORACLE[name], SF01)
    assert not problems and n > 0, problems


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    kept = corpus_pipeline.quality_rules(spark, docs, SF001)
    assert kept.schema == docs.schema and 0 < kept.count() < len(before)
    whole = {r.doc_id: r for r in before}
    assert all(r == whole[r.doc_id] for r in kept.collect())
    lines = corpus_pipeline.line_dedup(spark, kept, SF001)
    assert lines.schema == docs.schema and all(r.n_chars == len(r.text) for r in lines.collect())
    near = corpus_pipeline.near_dedup(spark, lines, SF001)
    gone = {r.doc_id for r in minhash_dedup.near_duplicates(lines, width=5).collect() if not r.kept}
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in lines.collect()} - gone
    clean = corpus_pipeline.decontaminate(spark, near, SF001)
    bad = {r.doc_id for r in decontamination.contaminated(near, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - bad and clean.columns == columns
    packed = corpus_pipeline.pack(spark, clean, SF001).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in clean.collect()}
    run = corpus_pipeline.run(spark, SF001).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()


def test_empty_table_passes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.count() == 0


def test_entry_reloads():
    assert importlib.reload(entry).queries().keys() >= QUERIES.keys()
