"""Repeated byte strings: suffix buckets sorted by difference-cover sample ranks."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardspark.llm.common import stored
from stewardspark.llm.decontamination import text_key

LENGTH = 400
GRAM = 100
HOT = 1000
CHUNK = 1 << 18
BLOCK_BYTES = 1 << 18
#: Texts that become Python objects at once, and about so many bytes of slices that go out at once.
ROWS = 256
OUT_BYTES = 1 << 20

#: Every difference mod 16 is one of two members.
PERIOD = 16
COVER = np.array([0, 1, 2, 5, 8])
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 2 * LENGTH), _powers(_INVERSE, CHUNK + 2 * LENGTH)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A rolling hash of the ``gram`` bytes from each position on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    h = (sums[gram:] - sums[:n]) * _DOWN[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(first start, starts, bucket) of each run of neighbouring suffixes in one bucket.

    A suffix's bucket is the least hash of the ``gram``-byte strings in its first
    ``length`` bytes, so suffixes with equal first ``length`` bytes are in one
    bucket, at the same distance from that string. Long texts go chunk by chunk.
    """
    for at in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        hashes = gram_hashes(data, gram)
        low = np.uint64((1 << 20) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least = (_sliding_least(keys, length - gram + 1) & low).astype(np.int64)
        edges = np.flatnonzero(np.diff(least)) + 1
        firsts = np.concatenate([[0], edges])
        counts = np.diff(np.concatenate([firsts, [len(least)]]))
        buckets = hashes[least[firsts]].view(np.int64)
        yield from zip((firsts + at).tolist(), counts.tolist(), buckets.tolist(), strict=True)


def _two_longs(digest: int) -> tuple[int, int]:
    both = np.array([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``batches``, of which only ``ROWS`` are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)


def _batch(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_RUNS = "bucket long, run long, k1 long, k2 long, first long, starts int"


def _find_runs(length: int, gram: int):
    names = ["bucket", "run", "k1", "k2", "first", "starts"]
    types = [pa.int64()] * 5 + [pa.int32()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for k1, k2, text in _rows(batches):
            if len(text) < length:
                continue
            view = memoryview(text)
            digests, places = [], []
            for first, starts, bucket in runs(text, length, gram):
                digests.append(xxhash.xxh3_64_digest(view[first : first + starts + length - 1]))
                places.append((first, starts, bucket))
            whole = np.frombuffer(b"".join(digests), ">i8").tolist()
            rows += [
                (bucket, run, k1, k2, first, starts)
                for (first, starts, bucket), run in zip(places, whole, strict=True)
            ]
            if len(rows) > 30_000:
                yield _batch(list(zip(*rows, strict=True)), types, names)
                rows = []
        if rows:
            yield _batch(list(zip(*rows, strict=True)), types, names)

    return find


_SLICES = "bucket long, k1 long, k2 long, first long, data binary"


def _cut_slices(length: int):
    names = ["bucket", "k1", "k2", "first", "data"]
    types = [pa.int64()] * 4 + [pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, k1, k2, wanted in _rows(batches):
            for w in wanted:
                data = text[w["first"] : w["first"] + w["starts"] + length - 1]
                rows.append((w["bucket"], k1, k2, w["first"], data))
                size += len(data)
                if size > OUT_BYTES:
                    yield _batch(list(zip(*rows, strict=True)), types, names)
                    rows, size = [], 0
        if rows:
            yield _batch(list(zip(*rows, strict=True)), types, names)

    return cut


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows: equal rows get equal ones."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        new[1:] |= np.diff(column[order].view(np.int64)) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_suffixes(data: np.ndarray, suffixes: np.ndarray, buckets: np.ndarray, length: int) -> np.ndarray:
    """Which ``suffixes`` (positions in ``data``) share their first ``length`` bytes with
    another one of the same bucket.

    Suffixes are ordered by bucket and their first and last 16 bytes. Those that
    tie are told apart by the ranks of cover samples: positions whose remainder by
    16 is in the difference cover. Any two suffixes have a distance below 16 at
    which both meet a sample, and the samples' ranks, made by doubling among the
    samples, compare all that lies between.
    """
    padded = np.concatenate([data, np.zeros(length + 4 * PERIOD, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)

    tied = _names(buckets, *(word(suffixes + d) for d in (0, 8, length - 16, length - 8)))
    several = np.bincount(tied)[tied] > 1
    out = np.zeros(len(suffixes), bool)
    if not several.any():
        return out
    depth = length - PERIOD + 1
    slots = np.cumsum(np.resize(_IN_COVER, len(padded))) - 1
    samples = np.flatnonzero(np.resize(_IN_COVER, len(data) + PERIOD))
    rank, known = _names(word(samples), word(samples + 8)), 16
    total, at_depth = None, 0
    per = len(COVER)

    def beyond(ranks: np.ndarray, by: int) -> np.ndarray:
        """Ranks of the samples ``by`` bytes on, a multiple of the period."""
        moved = np.full(len(ranks), -1, np.int64)
        jump = by // PERIOD * per
        moved[: max(0, len(ranks) - jump)] = ranks[jump:]
        return moved

    # The binary digits of the depth, in whole periods, say which ranks to put together.
    left = depth // PERIOD
    while left:
        if left & 1:
            total = rank if total is None else _names(total, beyond(rank, at_depth))
            at_depth += known
        left >>= 1
        if left:
            rank = _names(rank, beyond(rank, known))
            known *= 2
    at = np.flatnonzero(several)
    ties, ways = [], []
    for member in COVER:
        distance = (member - suffixes[at]) % PERIOD
        ways.append(np.stack([tied[at], distance, total[slots[suffixes[at] + distance]]]))
        ties.append(at)
    ways, ties = np.concatenate(ways, axis=1), np.concatenate(ties)
    same = _names(*ways)
    out[ties[np.bincount(same)[same] > 1]] = True
    return out


_FOUND = "k1 long, k2 long, first long, last long"


def _intervals(keys: list, first: np.ndarray, hit: np.ndarray, owner: np.ndarray, length: int) -> list:
    """(k1, k2, first, last) of each stretch of neighbouring hits of one slice."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
    heads = np.concatenate([[0], breaks])
    tails = np.concatenate([breaks, [len(at)]]) - 1
    return [
        (*keys[owner[at[h]]], int(first[at[h]]), int(first[at[t]]) + length)
        for h, t in zip(heads.tolist(), tails.tolist(), strict=True)
    ]


def _sort_buckets(length: int):
    """Rows of slices, whole buckets side by side: one block of buckets at a time."""
    names, types = ["k1", "k2", "first", "last"], [pa.int64()] * 4

    def solved(block: list[tuple]) -> list[tuple]:
        data = np.frombuffer(b"".join(x[4] for x in block), np.uint8)
        sizes = np.array([len(x[4]) for x in block])
        begins = np.cumsum(sizes) - sizes
        starts = sizes - length + 1
        owner = np.repeat(np.arange(len(block)), starts)
        inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        buckets = np.array([x[0] for x in block], np.int64)[owner]
        hit = repeated_suffixes(data, begins[owner] + inner, buckets, length)
        first = np.array([x[3] for x in block], np.int64)[owner] + inner
        return _intervals([(x[1], x[2]) for x in block], first, hit, owner, length)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, bucket = [], 0, None
        for row in _rows(batches):
            if size > BLOCK_BYTES and row[0] != bucket:
                if found := solved(block):
                    yield _batch(list(zip(*found, strict=True)), types, names)
                block, size = [], 0
            bucket = row[0]
            block.append(row)
            size += len(row[4])
        if block and (found := solved(block)):
            yield _batch(list(zip(*found, strict=True)), types, names)

    return sort


def _explode_hot(length: int):
    """Slices of hot buckets as single suffixes, each under a hash of its first bytes."""
    names, types = ["r1", "r2", "k1", "k2", "first"], [pa.int64()] * 5

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, k1, k2, first, data in _rows(batches):
            view = memoryview(data)
            rows += [
                (*_two_longs(xxhash.xxh3_128_intdigest(view[i : i + length])), k1, k2, first + i)
                for i in range(len(data) - length + 1)
            ]
            if len(rows) > 30_000:
                yield _batch(list(zip(*rows, strict=True)), types, names)
                rows = []
        if rows:
            yield _batch(list(zip(*rows, strict=True)), types, names)

    return explode


def repeated_spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, spans) of the texts of ``rows`` (k1, k2, data) that hold a repeated string."""
    found = stored(rows.select("k1", "k2", "data").mapInArrow(_find_runs(length, gram), _RUNS), "all-runs")
    # Most buckets have one run, which cannot repeat: the others are few and are kept.
    # Counted in each task first and written: adaptive execution splits a hot bucket in the
    # join that follows only where neither side is grouped in the same stage.
    shared = found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = stored(shared, "shared-buckets")
    found = stored(found.join(shared, "bucket", "left_semi"), "runs")
    kinds = found.groupBy("bucket", "run").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "starts")).alias("one")
    )
    per_bucket = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"))
    several = per_bucket.filter("kinds > 1")
    kinds = stored(kinds, "run-kinds")
    whole = found.join(kinds.filter("n > 1").select("bucket", "run"), ["bucket", "run"])
    whole = whole.select("k1", "k2", "first", (F.col("first") + F.col("starts") + (length - 1)).alias("last"))
    unlike = kinds.join(several, "bucket")
    unlike = unlike.select("bucket", "kinds", "one.*")
    wanted = unlike.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "first", "starts")).alias("wanted"))
    texts = rows.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    slices = texts.select("data", "k1", "k2", "wanted").mapInArrow(_cut_slices(length), _SLICES)
    slices = stored(slices, "slices")
    hot = several.filter(F.col("kinds") > HOT).select("bucket")
    hot = stored(hot, "hot-buckets")
    cold = slices.join(hot, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    sorted_out = cold.mapInArrow(_sort_buckets(length), _FOUND)
    single = slices.join(hot, "bucket", "left_semi").mapInArrow(
        _explode_hot(length), "r1 long, r2 long, k1 long, k2 long, first long"
    )
    single = stored(single, "hot-suffixes")
    twice = single.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2")
    single = single.join(twice, ["r1", "r2"], "left_semi")
    single = single.select("k1", "k2", "first", (F.col("first") + length).alias("last"))
    spans = whole.unionByName(sorted_out).unionByName(single)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<first:long,last:long>>"


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    with_text: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, removed) of each row.

    Texts are UTF-8 bytes, null ones empty. Each byte goes that lies in a string of
    ``length`` bytes that starts anywhere else too, in the same text or another one;
    strings never cross texts and are judged on the input. ``removed`` are the
    maximal spans removed, ``kept`` (null without ``with_text``) the bytes that
    remain, ``kept_sha256`` their hash. Equal rows are copies of each other.
    Shorter texts are kept, an empty table gives an empty result, further columns
    are not read.

    Suffixes fall into buckets by the least hash in their first bytes, about one
    bucket for ``(length - gram) / 2`` neighbours. Neighbours of a bucket are one
    run: a run whose bytes occur twice is repeated as a whole and its text is never
    moved. Only unlike runs of one bucket are compared, one block of buckets at a
    time, by sorting with difference-cover ranks. A bucket with more than ``HOT``
    unlike runs, such as a common line in different places, is not gathered: its
    suffixes are grouped one by one under a 128-bit hash of their first bytes.
    """
    if not 32 <= gram < length:
        raise ValueError("gram must lie between 32 and length")
    kind = docs.schema[id_column].dataType.simpleString()
    data = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    keyed = docs.select(F.col(id_column).alias("id"), *text_key(F.col(text_column)), data.alias("data"))
    spans = stored(repeated_spans(keyed.select("k1", "k2", "data"), length, gram), "spans")

    def removed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            merged = _merged(found)
            pieces, at = [], 0
            for first, last in merged:
                pieces.append(text[at:first])
                at = last
            kept = b"".join([*pieces, text[at:]])
            gone = [{"first": a, "last": b} for a, b in merged]
            digest = hashlib.sha256(kept).hexdigest()
            out.append((len(text), len(text) - len(kept), len(merged), digest, kept if with_text else None, gone))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), spans_type]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"],
        )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield removed(batch.slice(at, ROWS))

    joined = keyed.join(spans, ["k1", "k2"], "left").select("id", "data", "spans")
    return joined.mapInArrow(remove, f"{id_column} {kind}, {_RESULT}")
