"""Base spans against the plain patterns; estimation, classifier and redaction on planted cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from stewardspark.llm import personal_data, registry
from stewardspark.llm.personal_data import KINDS
from tests.conftest import SMALL

# The base patterns as they are stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def plain(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(12)
    pieces = ["a", "é", "@", ".", "@@", "-", " ", "+", "1", "25", "255", "256", "007", "(", ")", "4845168114407329", "x.y", "%", "😀"]
    for _ in range(30_000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        assert [f"{KINDS[k]}:{a}:{b}" for a, k, b in personal_data.base_spans(text)] == brute_base(text), text


def test_very_long_runs_take_linear_time():
    for piece in ("a", "1", "@", "a@", "+1", "1.", "+ ", "a.", "1 ", "Ab ", " at ", "a:"):
        personal_data.candidates(piece * (300_000 // len(piece)))


def test_estimation_finds_the_bad_labeler():
    rnd = np.random.default_rng(2)
    truth = rnd.random(20_000) < 0.3
    right = np.array([0.9, 0.9, 0.8, 0.5])
    votes = np.where(rnd.random((20_000, 4)) < right, truth[:, None], ~truth[:, None])
    numbers = 81 + (2 * votes * 3 ** np.arange(3, -1, -1)).sum(1)  # the first labeler abstains
    counts = np.bincount(numbers, minlength=personal_data.PATTERNS).astype(float)
    is_data, says, share = personal_data.reliabilities(counts)
    assert abs(share - 0.3) < 0.02
    assert np.abs(says[1, 1:] - right).max() < 0.04 and np.abs(1 - says[0, 1:] - right).max() < 0.04
    assert ((is_data[numbers] > 0.5) == truth).mean() > 0.9
    assert np.isfinite(personal_data.reliabilities(np.zeros(personal_data.PATTERNS))[0]).all()


@pytest.fixture(scope="module")
def planted():
    """Texts, and for each the spans that must (True) or must not (False) be added."""
    rnd = random.Random(8)
    rows = []
    for i in range(240):
        number = "".join(rnd.choices("0123456789", k=9))
        base = f"mail a{i}@host{i % 7}.com or phone +1 {number[:3]} {number[3:6]} {number[6:]}"
        kind = i % 4
        if kind == 0:
            extra, good = f"phone 0{number[:3]} {number[3:6]} {number[5:]}", True
        elif kind == 1:
            extra, good = f"write to user{i} [at] host{i % 7} [dot] com", True
        elif kind == 2:
            extra, good = f"build {number[:4]} {number[3:6]} {number[5:]}x", False
        else:
            extra, good = f"dear Anna {rnd.choice(['Miller', 'Kent'])}", True
        rows.append((i, f"{base} and {extra} there", good))
    return rows


def test_spans_are_added_by_the_classifier(spark, planted):
    df = spark.createDataFrame([r[:2] for r in planted], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(df).collect()}
    right = 0
    for i, text, good in planted:
        base = [s for s in got[i] if s["base"]]
        assert plain(base) == brute_base(text)
        added = [text[s["start"] : s["end"]] for s in got[i] if not s["base"]]
        right += bool(added) == good
        assert len(added) <= 1
    assert right >= 0.95 * len(planted)


def test_redaction_keeps_columns_and_rows(spark):
    rows = [(1, "to a@b.com, ip 1.2.3.4.", "x"), (2, None, "y"), (2, "", None), (None, "nothing", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = personal_data.without_personal_data(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "to <email>, ip <ip>.", "x"), *rows[1:]], key=repr
    )
    assert personal_data.without_personal_data(df.limit(0)).count() == 0


def test_overlapping_base_spans_stay(spark):
    text = "+1 4845 1681 1440 7329 +1.2.3.4.555.66 4845-1681-1440-7329"
    df = spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string")
    for row in personal_data.personal_data(df).collect():
        assert plain(s for s in row["spans"] if s["base"]) == brute_base(text)


def test_query_equals_the_patterns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = registry.op12_pii(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for row in rows:
        base = brute_base(docs[row["doc_id"]])
        kinds = [b.split(":")[0] for b in base]
        assert [row[f"n_{k}"] for k in PATTERNS] == [kinds.count(k) for k in PATTERNS]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | {""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.personal_data(df).count() == 0
