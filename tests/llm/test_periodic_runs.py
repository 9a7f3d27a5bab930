"""Runs of words against brute force."""

import hashlib
import random

import pytest

from stewardspark.llm import periodic_runs, registry
from tests.conftest import SMALL


def brute_runs(words):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text, plan=None):
    words = (text or "").encode().split()
    order = plan(doc_id, len(words)) if plan else None
    words = [words[i] for i in order] if order is not None else words
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = [
        hashlib.sha256(b).hexdigest()
        for b in (
            "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode(),
            b" ".join(w for i, w in enumerate(words) if i not in gone),
        )
    ]
    if not runs:
        return (doc_id, 0, None, None, None, None, *sha)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return (doc_id, len(runs), s, n, q, 1000 * n // q, *sha)


def random_words(rnd, letters):
    out = []
    for _ in range(rnd.randint(0, 6)):
        part = [f"w{rnd.randint(0, rnd.choice([1, 3, letters]))}" for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 16, 30]))]
        out += (part * rnd.choice([1, 1, 5, 9]))[: rnd.randint(1, 220)]
    return out


def result(rows):
    return sorted((tuple(r) for r in rows.drop("collapsed").collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(13)
    rows = [(i, rnd.choice([" ", "\n", "\t \r"]).join(random_words(rnd, 60))) for i in range(300)]
    period = [f"p{i}" for i in range(700)]
    rows += [
        (300, None), (301, ""), (302, " \x0b\x0c "), (303, "a " * 5), (304, "a " * 6), (305, "a b " * 4),
        (306, "a b " * 3 + "a"), (307, "é x " * 9), (308, " ".join(period * 5)), (309, "z " * 9000),
        (None, "a " * 30), (None, "b c " * 30), (7, "a a a a a a"), (7, "a a a a a a"),
    ]
    return rows


def test_runs_equal_brute_force(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    plan = registry.periodic_words
    rows, each = periodic_runs.periodic_runs(df, plan=plan)
    short = [t for t in texts if t[0] != 309]
    got = result(rows)
    assert [r for r in got if r[0] != 309] == sorted((brute_row(i, t, plan) for i, t in short), key=repr)
    constant = next(r for r in got if r[0] == 309)
    assert constant[1:6] == (1, 0, 9000, 1, 9000000)
    assert each.count() == sum(r[1] for r in got)


def test_small_tiles_give_the_same(texts, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CORE_WORDS", 4)
    monkeypatch.setattr(periodic_runs, "CORE_STEPS", 1)
    rnd = random.Random(4)
    for _ in range(300):
        words = [int(w[1:]) for w in random_words(rnd, 40)]
        by_period = {}
        for k, first, some, marks in periodic_runs.tiles(periodic_runs.np.array(words, "int32")):
            for q, a, b in periodic_runs.solve(k, first, some.tolist(), marks.tolist()):
                by_period.setdefault(q, []).append((a, b))
        found = {}
        for q, parts in sorted(by_period.items()):
            islands = []
            for a, b in sorted(parts):
                if islands and islands[-1][1] >= a:
                    islands[-1][1] = max(islands[-1][1], b)
                else:
                    islands.append([a, b])
            for a, b in islands:
                if b - a + q >= max(6, 4 * q):
                    found.setdefault((a, b - a + q), q)
        assert sorted((s, n, q) for (s, n), q in found.items()) == brute_runs(words)


def test_without_a_plan_the_collapsed_text_is_given(spark):
    df = spark.createDataFrame([(1, "x " * 8 + "y"), (2, "x y")], "doc_id long, text string")
    rows = {r["doc_id"]: r["collapsed"] for r in periodic_runs.periodic_runs(df)[0].collect()}
    assert rows == {1: "x y", 2: None}


def test_other_columns_and_empty_tables(spark):
    names = "doc_id string, text string, row long, words string, octave int, runs int, period int"
    df = spark.createDataFrame([("k", "a " * 7, 1, "w", 2, 3, 4)], names)
    rows, each = periodic_runs.periodic_runs(df)
    assert result(rows) == [brute_row("k", "a " * 7)]
    assert each.collect() == [("k", 0, 7, 1)]
    rows, each = periodic_runs.periodic_runs(df.limit(0))
    assert rows.count() == 0 and each.count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    short = {i: t for i, t in texts if len(t or "") < 6000}
    got = [r for r in result(registry.op13_periodic_runs(spark, SMALL)) if r[0] in short]
    assert got == sorted((brute_row(i, t, registry.periodic_words) for i, t in short.items()), key=repr)
    assert sum(r[1] for r in got) > 5
