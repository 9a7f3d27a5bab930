"""Toxic passages by maximum-scoring segments of word log-odds."""

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardspark.llm.common import stored

BUCKETS = 1 << 18
PRIOR_SHARE = 0.3
SURE = 1.0
DRIFT = 0.5
BINS = 400
TAUGHT_ROWS = 50_000
LEAST, MOST = -20.0, 60.0

_WORDS = re.compile(r"\w+")
_REMEMBERED = 300_000


def bucket(word: str) -> int:
    """Words are hashed, so that the model's size does not grow with the vocabulary."""
    return zlib.crc32(word.encode()) % BUCKETS


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def word_counts(rows: DataFrame) -> np.ndarray:
    """How many texts of ``rows`` (label, text) have a word of each bucket, by label.

    A word counts once for a text, so that a long text that repeats one does not
    count for many, and equal texts count once, as 1 if any of them is labelled so. Summed in each task first; at most
    two numbers for each bucket reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        known: dict[str, int] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) > _REMEMBERED:
                    known.clear()
                words = set(words_of(text))
                for word in words.difference(known):
                    known[word] = bucket(word)
                totals[label][list({known[w] for w in words})] += 1
        labels, buckets = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(buckets, pa.int32()), pa.array(totals[labels, buckets])],
            names=["label", "bucket", "n"],
        )

    once = rows.groupBy("text").agg(F.max("label").alias("label")).select("label", "text")
    counted = once.mapInArrow(count, "label int, bucket int, n long")
    summed = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((2, BUCKETS), np.int64)
    totals[summed["label"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return totals


def log_odds(counts: np.ndarray, prior_share: float = PRIOR_SHARE, sure: float = SURE) -> np.ndarray:
    """Log-odds of each bucket under label 1 against 0, with an informative Dirichlet prior.

    The prior is the words' share in both labels together, as heavy as
    ``prior_share`` times the counts of label 1. What remains after ``sure`` standard
    deviations towards zero counts: a rare word says nothing.
    """
    clean, toxic = counts.astype(np.float64)
    together = clean + toxic
    if not toxic.sum() or not clean.sum():
        return np.zeros(BUCKETS)
    prior = together / together.sum() * prior_share * toxic.sum() + 1e-3
    heavy = prior.sum()

    def odds(n: np.ndarray) -> np.ndarray:
        return np.log((n + prior) / (n.sum() + heavy - n - prior))

    delta = odds(toxic) - odds(clean)
    spread = sure * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(delta) * np.maximum(np.abs(delta) - spread, 0.0)


def extreme_values(scores: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law of the best segment in clean text.

    lambda solves sum p exp(lambda s) = 1 over clean words; K is the usual
    approximation lambda times the mean squared drift over the second moment.
    """
    p = (clean + 1e-9) / (clean + 1e-9).sum()
    mean = float(p @ scores)
    if mean >= 0 or scores.max() <= 0:
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    while p @ np.exp(np.minimum(high * scores, 500.0)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(np.minimum(middle * scores, 500.0)) < 1 else (low, middle)
    rate = (low + high) / 2
    return rate, float(np.clip(rate * mean**2 / max(p @ scores**2, 1e-12), 1e-4, 1.0))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last exclusive, score), in linear time.

    Ruzzo and Tompa's scan: candidates are kept with the running sums before and
    after them; a new one is joined to the last candidate that starts lower as long
    as that ends lower too.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, i + 1, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def passages(text: str | None, score_of, rate: float, k: float) -> tuple[float, list[tuple]]:
    """The evidence of a text and its significant passages.

    A segment with score S in a text of m words has the evidence
    lambda S - ln(K m): clean texts have exp(-evidence) better ones by chance. A
    passage is significant if less than one is expected. The text's evidence is
    the sum over significant passages, else that of the best segment.
    """
    words = words_of(text)
    if not words:
        return LEAST, []
    offset = np.log(k * len(words))
    best, out = LEAST, []
    for first, last, score in segments(score_of(words)):
        evidence = rate * score - offset
        best = max(best, evidence)
        if evidence > 0:
            out.append((first, last, float(score), float(evidence)))
    total = sum(p[3] for p in out) if out else best
    return float(np.clip(total, LEAST, MOST)), out


_PASSAGES = "array<struct<first:int,last:int,score:double,evidence:double>>"
_PASSAGE_TYPES = [("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]


def evidence(docs: DataFrame, text: Column, scores: np.ndarray, rate: float, k: float) -> DataFrame:
    """``docs`` with ``judged`` (evidence, passages) of the whole of ``text``.

    Only the texts go to Python, and only what was found comes back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scores.astype(np.float32))

    @F.arrow_udf(f"evidence double, passages {_PASSAGES}")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, known = sent.value, {}

        def score_of(words: list[str]) -> np.ndarray:
            if len(known) > _REMEMBERED:
                known.clear()
            for word in set(words).difference(known):
                known[word] = float(table[bucket(word)])
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

        names = [name for name, _ in _PASSAGE_TYPES]
        for batch in batches:
            judged = [passages(text.as_py(), score_of, rate, k) for text in batch]
            listed = [[dict(zip(names, p, strict=True)) for p in found] for _, found in judged]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([e for e, _ in judged], pa.float64()),
                    pa.array(listed, pa.list_(pa.struct(_PASSAGE_TYPES))),
                ],
                names=["evidence", "passages"],
            )

    return docs.withColumn("judged", judge(text))


def calibration(spark: SparkSession, judged: DataFrame) -> tuple[float, float]:
    """Slope and intercept of P(label 1 | evidence), over ``judged`` (evidence, label).

    The rows are counted into ``BINS`` bins of evidence for each label; the fit is
    made on these counts.
    """
    width = (MOST - LEAST) / BINS
    bin_of = F.least(F.floor((F.col("evidence") - LEAST) / width), F.lit(BINS - 1)).cast("int")
    rows = judged.groupBy(bin_of.alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, BINS))
    for row in rows:
        n[row["label"], row["bin"]] += row["n"]
    if not n[0].sum() or not n[1].sum():
        return 0.0, -5.0 if n[0].sum() or not n[1].sum() else 5.0
    x = (LEAST + (np.arange(BINS) + 0.5) * width) / 10
    weights = np.array([0.0, np.log(n[1].sum() / n[0].sum())])
    features = np.stack([x, np.ones(BINS)])
    for _ in range(50):  # Newton steps, lightly held
        p = 1 / (1 + np.exp(-np.clip(weights @ features, -30, 30)))
        slope = features @ (n[1] - n.sum(0) * p) - 0.01 * weights
        curve = (features * (n.sum(0) * p * (1 - p))) @ features.T + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights = weights + np.clip(step, -2, 2)
    return float(weights[0] / 10), float(weights[1])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    folds: int = 5,
    taught_rows: int = TAUGHT_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, held_out, score, predicted, evidence, passages, kept) of each row.

    ``labels`` gives 0 or 1 for some ids. Rows whose crc32(id as text) mod
    ``folds`` is 0 are held out: their labels are never read. ``score`` is the
    probability of label 1, ``predicted`` 1 from 0.5 on, ``passages`` the
    significant toxic passages (first and last word, score, evidence), ``kept`` a
    struct of the columns ``keep``. Only the text is scored. An id labelled more than once counts as 1 if any label is 1;
    labels other than 0 and 1 are not read. A null id is held out. Null and empty
    texts have no words and the least evidence. Without labels of both kinds all
    rows score alike. Repeated rows stay, empty tables give empty results, further
    columns are not read.

    The classifier is fitted on about ``taught_rows`` labelled ids, chosen by hash;
    where there are fewer, on all. That bound is what lets the ids be broadcast, so
    no text is shuffled but those it is fitted on. Two passes over the texts: words
    are counted by label in tasks, then each text is scanned once. The model is a
    table of fixed size.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(folds))
    rows = docs.select(F.col(id_column).alias("id"), F.struct("*").alias("whole"))
    text = F.col("whole")[text_column]
    kept = F.struct(*[F.col("whole")[c].alias(c) for c in keep] or [F.lit(0).alias("none")])
    taught = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    taught = taught.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold != 0))
    taught = stored(taught.groupBy("id").agg(F.max("label").alias("label")), "taught")
    known = taught.count()
    if known > taught_rows:
        share = F.lit(int(taught_rows / known * 2**30))
        taught = taught.filter(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share)
    taught = F.broadcast(taught)
    counts = word_counts(rows.filter(fold != 0).join(taught, "id").select("label", text.alias("text")))
    scores = log_odds(counts) - DRIFT
    rate, k = extreme_values(scores, counts[0])
    judged = evidence(rows, text, scores, rate, k)
    found = stored(judged.select("id", "judged.*", kept.alias("kept")), "evidence")
    slope, intercept = calibration(spark, found.filter(fold != 0).join(taught, "id").select("evidence", "label"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") * F.lit(slope) + F.lit(intercept))))
    return found.select(
        F.col("id").alias(id_column),
        (fold == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        "evidence",
        "passages",
        "kept",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows predicted toxic, whatever their labels."""
    judged = toxicity(docs, labels, keep=docs.columns, **options)
    return judged.filter("predicted = 0").select("kept.*")
