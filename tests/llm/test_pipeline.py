"""The pipeline against its stages worked out one by one, and the SQL of the queries."""

import os

import duckdb
import pytest

import corpus_pipeline
from stewardspark.llm import registry
from stewardspark.llm.common import table

from .test_operators import groups_of, library_ids, plain_simhash

SMALL = "/root/testdata/sf0.001"
NAMES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, SMALL)
    base = duckdb.connect()
    for t in NAMES:
        path = f"{SMALL}/{t}.parquet"
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    columns = ", ".join(got.columns)
    want = base.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages[names[0]](spark, docs, SMALL)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    one = stages[names[1]](spark, clean, SMALL)
    ids = sorted(rows)
    prints = [plain_simhash(rows[i], 3) for i in ids]
    label = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert kept == {ids[g]: rows[ids[g]] for g in set(label)}
    rest = stages[names[2]](spark, one, SMALL)
    assert {r["doc_id"] for r in rest.collect()} <= set(kept)
    mixed = stages[names[3]](spark, rest, SMALL)
    assert clean.columns == one.columns == rest.columns == mixed.columns == docs.columns
    last = stages[names[4]](spark, mixed, SMALL).collect()
    texts = [r["text"] for r in mixed.collect()]
    assert len(last) == len(texts)
    assert sum(r["n_tokens"] for r in last) == sum(len(library_ids(t)) + 1 for t in texts)
