"""The registered queries of the subpackage over a small table set, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from shelfmark import session
from shelfmark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.compare(spark, con, FOLDER, entry.queries()[name], queries.ORACLES[name]) is None


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline(spark):
    """Each stage is held against what it may do to its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = session.work_path(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs)
        assert name == "encode" or docs.columns == names
    rows = [{r["doc_id"]: r for r in df.collect()} for df in seen]
    kept = [labels[i] for i in labels if i in rows[0]]
    assert min(kept) == 1 and len(kept) == sum(labels.values())
    texts = [hashlib.md5(r["text"].encode()).digest() for r in rows[1].values()]
    assert len(set(texts)) == len(texts) and set(rows[1]) <= set(rows[0])
    windows = set()
    for i in sorted(rows[2]):
        words = rows[2][i]["text"].encode().split()
        assert set(rows[2]) <= set(rows[1])
        for p in range(len(words) - 50):  # no long passage is left twice
            w = tuple(words[p:p + 50])
            assert w not in windows
            windows.add(w)
    assert set(rows[3]) <= set(rows[2]) and seen[3].count() > 0
    assert seen[4].count() == seen[3].count()
