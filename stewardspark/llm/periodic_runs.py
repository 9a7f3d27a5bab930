"""Runs of repeated words, found in tiles per octave of the period.

A run of period q at least four times as long holds, for the octave 2**k <= q <
2**(k+1), a stretch of 3 * 2**k words equal to those q later. Boundaries every 2**k
words cut that stretch, and at a boundary two Z-functions give, for all periods of
the octave at once, how far the words go on equalling those q later, to the right
and to the left. A document is unfolded into overlapping tiles of many boundaries
for each octave; tiles are dealt out and solved by themselves, their fragments meet
by document and period and are stitched where they touch.

Tiles without a run are left out beforehand: somewhere in a run the hash of the
2**(k+1) words at a boundary is found again one period later. Equal hashes only
say where to look; what is found there comes from the words.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stewardspark.llm.common import stored

#: A run is at least so many words long, and at least so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of a tile between its margins: at least so many, and so many steps of its octave.
CORE_WORDS = 2048
CORE_STEPS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _ODD) ^ b
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def marked_boundaries(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) of a document of word numbers, where a run may lie.

    Boundaries are counted in steps of the octave. In a run all boundaries that the
    hashed words follow within it are found; those among these words are marked too.
    """
    n, width, k = len(words), 1, 0
    hashes = _mixed(words.astype(np.uint64), words.astype(np.uint64))
    while LEAST_PERIODS << k <= n:
        step = 1 << k
        while width < max(4, 2 * step):
            hashes = _mixed(hashes[:-width], hashes[width:])
            width *= 2
        steps = -(-len(hashes) // step)
        rows = np.zeros(steps * step, np.uint64)
        rows[: len(hashes)] = hashes
        rows = rows.reshape(steps, step)
        hit = np.flatnonzero((rows[1:] == rows[:-1, :1]).any(1))
        if len(hit):
            marks = np.unique((hit[:, None] + np.arange(width // step + 1)[None, :]).ravel())
            yield k, marks[marks * step < n]
        k += 1


def tiles(words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(octave, first word, words, marked boundaries in words) of each tile worth solving.

    A tile has the words that its boundaries look at: one step before the first, three
    after the last.
    """
    for k, marks in marked_boundaries(words):
        step = 1 << k
        core = max(CORE_WORDS // step, CORE_STEPS)
        for own in np.split(marks, np.flatnonzero(np.diff(marks // core)) + 1):
            first = max(0, (int(own[0]) - 1) * step)
            last = (int(own[-1]) + 3) * step
            yield k, first, words[first:last], own * step


def z_function(s: list) -> list[int]:
    """For each place of ``s`` how many items from there on equal those from the start."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        length = min(z[i - left], right - i) if i < right else 0
        while i + length < n and s[length] == s[i + length]:
            length += 1
        z[i] = length
        if i + length > right:
            left, right = i, i + length
    return z


def solve(octave: int, first: int, words: list[int], marks: list[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of a tile: words start <= i < end equal those a period later.

    Each reaches at most one step to both sides of its boundary. One that reaches
    neither side's end is too short for a run of this octave and has no neighbour, so
    it is left out. Fragments of one period that touch are one.
    """
    step, n = 1 << octave, len(words)
    open_: dict[int, list[int]] = {}
    out = []
    for mark in marks:
        b = mark - first
        after = z_function(words[b : b + 3 * step])
        before = words[max(0, b - step) : b][::-1]
        # -1 is no word: matches end where the words before the boundary do.
        behind = z_function(before + [-1] + words[max(0, b - step) : min(n, b + 2 * step)][::-1])
        ends = len(before) + 1 + min(n, b + 2 * step) - b
        for q in range(step, min(2 * step, n - b + 1)):
            right = min(after[q], step) if q < len(after) else 0
            left = min(behind[ends - q], step) if ends - q < len(behind) else 0
            if right < step and left < step:
                continue
            known = open_.get(q)
            if known is not None and known[1] >= mark - left:
                known[1] = max(known[1], mark + right)
                continue
            if known is not None:
                out.append((q, known[0], known[1]))
            open_[q] = [mark - left, mark + right]
    out.extend((q, a, b) for q, (a, b) in open_.items())
    return out


def _unfold(plan, id_type: pa.DataType):
    """Arrow function: rows (row, id, text) to rows of documents and of their tiles."""

    def rows(docs: list[tuple], found: list[tuple]) -> pa.RecordBatch:
        of_docs, of_tiles = (
            [list(c) for c in zip(*rows, strict=True)] or [[]] * width
            for rows, width in ((docs, 4), (found, 5))
        )
        no_doc, no_tile = [None] * len(found), [None] * len(docs)
        ints = pa.list_(pa.int32())
        columns = [pa.array(of_docs[0] + of_tiles[0], pa.int64())]
        for values, kind in zip(of_docs[1:], (id_type, pa.string(), pa.binary()), strict=True):
            columns.append(pa.array(values + no_doc, kind))
        for values, kind in zip(of_tiles[1:], (pa.int32(), pa.int32(), ints, ints), strict=True):
            columns.append(pa.array(no_tile + values, kind))
        names = ["row", "id", "whole_sha256", "words", "octave", "at", "numbers", "marks"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            docs, found, size = [], [], 0
            for row, doc, text in zip(batch.column(0), batch.column(1), texts, strict=True):
                row, doc, words = row.as_py(), doc.as_py(), (text.as_py() or b"").split()
                order = plan(doc, len(words)) if plan else None
                if order is not None:
                    words = [words[i] for i in order.tolist()]
                numbers: dict[bytes, int] = {}
                as_numbers = np.fromiter(
                    (numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)
                )
                mine = [(row, *t) for t in tiles(as_numbers)]
                whole = b" ".join(words)
                docs.append((row, doc, hashlib.sha256(whole).hexdigest(), whole if mine else None))
                found += mine
                size += sum(len(t[3]) for t in mine)
                if size > 1 << 20:
                    yield rows(docs, found)
                    docs, found, size = [], [], 0
            yield rows(docs, found)

    return unfold


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, octave, at, numbers, marks = batch.columns
        found = []
        for i in range(batch.num_rows):
            some = solve(octave[i].as_py(), at[i].as_py(), numbers[i].as_py(), marks[i].as_py())
            found += [(row[i].as_py(), *fragment) for fragment in some]
            if len(found) > 1 << 18:
                yield _fragments(found)
                found = []
        yield _fragments(found)


def _fragments(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[1:]]],
        names=["row", "period", "first", "last"],
    )


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, start, period, length) of the runs that ``fragments`` (row, period, first, last) make.

    Fragments of a document and period that touch are one. What has several periods
    counts for the smallest. The rows of a group are those of one document and one
    period, at most one for each tile.
    """
    own = Window.partitionBy("row", "period").orderBy("first", "last")
    before = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((before < F.col("first")).cast("int"), F.lit(1))
    grouped = fragments.withColumn("begins", begins).withColumn("island", F.sum("begins").over(own))
    joined = grouped.groupBy("row", "period", "island").agg(
        F.min("first").alias("start"), (F.max("last") - F.min("first") + F.col("period")).alias("length")
    )
    long = joined.filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, whole_sha256, words, runs) to one row of results each."""
    for batch in batches:
        out = []
        whole, words, runs = (batch.column(i).to_pylist() for i in (1, 2, 3))
        for sha, text, listed in zip(whole, words, runs, strict=True):
            if not listed:
                out.append((0, None, None, None, None, hashlib.sha256(b"").hexdigest(), sha, None))
                continue
            split = text.split(b" ")
            gone = np.zeros(len(split), bool)
            spans = sorted((r["start"], r["period"], r["length"]) for r in listed)
            for start, period, length in spans:
                gone[start + period : start + length] = True
            start, period, length = min(spans, key=lambda r: (-r[2], r[0], r[1]))
            lines = "".join(f"{a},{c},{p}\n" for a, p, c in spans)
            kept = b" ".join([w for w, g in zip(split, gone.tolist(), strict=True) if not g])
            out.append(
                (len(spans), start, length, period, 1000 * length // period,
                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode())
            )
        kinds = [pa.int64()] * 5 + [pa.string()] * 3
        columns = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["id", *_RESULT],
        )


_RESULT = {
    "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
    "runs_sha256": "string", "collapsed_sha256": "string", "collapsed": "string",
}


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan=None
) -> tuple[DataFrame, DataFrame]:
    """The runs of each text of ``docs``, and what is left of it without their repetitions.

    First (id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, collapsed) of each row: figures of the longest run (ties: first
    start, then smallest period; nulls without a run), a digest of all runs as lines
    ``start,length,period``, and a digest and the text of the words that no run
    repeats, joined by a space (the text is null where nothing goes). Second
    (id, start, length, period), a row for each run. Words are what lies between
    space, tab, line feed, vertical tab, form feed and return, numbered from 0.

    ``plan(id, number of words)`` may give an array of word numbers, which the text's
    words are first replaced by. Null and empty texts have no words and no runs.
    Repeated rows and ids, null ids too, stay rows of their own; an empty table gives
    empty results; further columns are not read.

    Texts are split once, in tasks; tiles are shuffled by their place, so that those
    of a long text spread over all tasks, and only texts with tiles are carried on.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    unfolded = stored(
        rows.select("row", "id", "text").mapInArrow(
            _unfold(plan, to_arrow_type(rows.schema["id"].dataType)),
            f"row long, id {kind}, whole_sha256 string, words binary, "
            "octave int, at int, numbers array<int>, marks array<int>",
        ),
        "tiles",
    )
    tile = unfolded.filter("octave IS NOT NULL").select("row", "octave", "at", "numbers", "marks")
    # As many tasks as stated: by their bytes, which are few, adaptive execution would join them.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tile.repartition(tasks, "row", "octave", "at")
    fragments = dealt.mapInArrow(_solved, "row long, period int, first int, last int")
    runs = stored(stitched(fragments), "runs")
    texts = unfolded.filter("octave IS NULL").select("row", "id", "whole_sha256", "words")
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    joined = texts.join(listed, "row", "left").select("id", "whole_sha256", "words", "runs")
    result = f"id {kind}, " + ", ".join(f"{name} {type_}" for name, type_ in _RESULT.items())
    out = joined.mapInArrow(_digest, result).withColumnRenamed("id", id_column)
    each = texts.select("row", F.col("id").alias(id_column)).join(runs, "row")
    return out, each.select(id_column, "start", "length", "period")
