"""The pipeline on small tables of its own: each stage against brute force, and empty tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stewardspark.llm import mixing, toxicity

from .test_operators import groups_of, library_ids, plain_leaks, plain_simhash, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}


def write(spark, folder, **rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def tables():
    """Toxic texts, copies, near copies, benchmark passages, nulls."""
    rng = random.Random(31)
    items = [(i, words(rng, 20, 3000)) for i in range(6)]
    texts = [words(rng, rng.randint(30, 90), 3000) for _ in range(80)]
    labels = []
    for i in range(0, 80, 4):
        texts[i] += " vile filth scum " * 6
        labels.append((i, 0, 1))
    labels += [(i, 1, 0) for i in range(80) if i % 4]
    for i in range(1, 30, 4):
        texts[i] = f"{words(rng, 9, 3000)} {items[i % 6][1]} {words(rng, 9, 3000)}"
    texts += [texts[2], texts[2], texts[6] + " end", None, "", None]
    docs = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t) if t else 0) for i, t in enumerate(texts)]
    return docs, labels, items


def test_each_stage_equals_brute_force(spark, folder, tables):
    documents, labels, items = tables
    write(spark, folder, documents=documents, labels=labels, benchmark=items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/after-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    rows = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in seen.items() if name != "token_files"}
    source = {r[0]: r[1] for r in documents}

    judged = toxicity.toxicity(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    )
    toxic = {r["doc_id"] for r in judged.filter("predicted = 1").collect()}
    assert rows["toxicity"] == {i: t for i, t in source.items() if i not in toxic}
    assert set(range(0, 80, 4)) <= toxic and len(toxic) <= 22

    left = rows["toxicity"]
    ids = sorted(left)
    label = groups_of([plain_simhash(left[i], 3) for i in ids], lambda a, b: (a ^ b).bit_count() <= 3)
    assert rows["simhash_near_dedup"] == {ids[g]: left[ids[g]] for g in set(label)}

    left = rows["simhash_near_dedup"]
    ids = sorted(left)
    leaks = plain_leaks([left[i] or "" for i in ids], [text for _, text in items])
    leaky = {ids[t] for t, _ in leaks}
    assert leaky and rows["decontamination"] == {i: t for i, t in left.items() if i not in leaky}

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(seen["decontamination"]).collect()}
    mixed = Counter()
    for r in seen["mixing"].collect():
        own = (rows["decontamination"][r["doc_id"]] or "").split()
        mixed[r["doc_id"]] += len(r["text"].split())
        assert " ".join(r["text"].split()) in " ".join(own) and r["n_chars"] == len(r["text"])
    assert mixed == Counter({i: n for i, n in taken.items() if n})

    tokens = sorted(len(library_ids(r["text"])) + 1 for r in seen["mixing"].collect())
    last = seen["token_files"].collect()
    assert sorted(r["n_tokens"] for r in last) == tokens
    assert all(seen[n].columns == [c.split()[0] for c in DOCUMENTS.split(", ")] for n in rows)


def test_empty_tables(spark, folder, tables):
    write(spark, folder)
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_mixing_with_many_shards(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 60)), None, rng.choice(["a", "b", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    options = {"block_words": 16, "shard_words": 400}
    got = mixing.mix(docs, **options).collect()
    target, taken = {}, Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        target[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 16 for s, t in target.items())
    mixed = Counter()
    for r in mixing.mixed_documents(docs, **options).collect():
        mixed[r["doc_id"]] += len(r["text"].split())
    assert mixed == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})
    without = docs.drop("n_chars")
    assert mixing.mixed_documents(without, **options).columns == without.columns
