"""SimHash near-duplicates: multi-index hashing and connected components."""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark.llm.common import components, stored

SEED = 42
BITS = 64
HOT = 2000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint of a text, 0 for one without words.

    A bit is 1 if it is set in over half of the XXH64 values of the text's shingles
    of ``shingle`` words, repeats included; a text of fewer words is one shingle.
    """
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(" ".join(words), SEED)
    joined = " ".join(words).encode()
    lengths = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = len(words) - shingle + 1
    firsts, ends = starts[:n].tolist(), (starts[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(firsts[at : at + (1 << 16)], ends[at : at + (1 << 16)])),
            np.uint64,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """The SimHash of whole texts as a signed long. Only the texts go to Python."""

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.array([simhash(t.as_py(), shingle) for t in batch], np.uint64)
            yield pa.array(values.view(np.int64))

    return hashed(text)


def _near(values: np.ndarray, tables: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join all members of a bucket whose values are linked, at most
    one for each member. Every pair with a table entry is compared, in blocks."""
    labels = values.copy()
    own = np.flatnonzero(tables)
    if not len(own):
        return values[:0], values[:0]
    while True:
        before = labels.copy()
        for at in range(0, len(values), 512):
            block = values[at : at + 512]
            # Unsigned: of a negative number numpy counts the bits of its absolute value.
            apart = (block[:, None] ^ values[own][None, :]).view(np.uint64)
            close = np.bitwise_count(apart) <= distance
            least = np.where(close, labels[own][None, :], np.iinfo(np.int64).max).min(1)
            labels[at : at + 512] = np.minimum(labels[at : at + 512], least)
            back = np.where(close, labels[at : at + 512][:, None], np.iinfo(np.int64).max).min(0)
            labels[own] = np.minimum(labels[own], back)
        if (labels == before).all():
            break
    changed = labels != values
    return values[changed], labels[changed]


def _link_buckets(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, value, is_table) of whole buckets, in any order."""
        parts = [[np.asarray(c) for c in (b.column(0), b.column(1), b.column(2).cast(pa.int8()))] for b in batches]
        if not parts:
            return
        bucket, value, table = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((value, bucket))
        bucket, value, table = bucket[order], value[order], table[order]
        edges = np.flatnonzero(np.diff(bucket)) + 1
        firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
        a, b = [], []
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            x, y = _near(value[first:last], table[first:last] > 0, distance)
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
        )

    return link


def _balls(values: DataFrame, keys: list[str], first_bit: int, bits: int, parts: int) -> DataFrame:
    """Each value under every table key within one bit, in ``parts`` segments.

    The segments lie in ``bits`` bits from ``first_bit`` on. A row whose key is the
    value's own stands in the table, the others are the ball that is looked up.
    """
    width = bits // parts
    mask = (1 << width) - 1
    rows = None
    for part in range(parts):
        shift = first_bit + part * width
        own = F.shiftrightunsigned("value", shift).bitwiseAND(F.lit(mask))
        flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)]])
        some = values.select(
            *keys, "value", F.lit(part).alias("segment"), own.alias("own"), F.explode(flips).alias("flip")
        )
        some = some.select(
            *keys, "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "value", (F.col("flip") == 0).alias("is_table")
        )
        rows = some if rows is None else rows.unionByName(some)
    return rows


def links(values: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) over different ``value`` (signed long) that join all within ``distance`` bits.

    ``distance`` up to 3. Two halves: of two values within 3 bits one half differs
    in 1 bit at most, so a value looked up under its half and the 32 keys one bit
    away meets every partner in a table. Pairs of a bucket are compared in full,
    and a bucket gives a link a member, not a row a pair. Buckets of more than
    ``hot`` members are first cut by the quarters of their other half, in the same
    way and without loss.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    rows = _balls(values, [], 0, 64, 2)
    sizes = rows.groupBy("segment", "key").agg(
        F.count("*").alias("n"), F.sum(F.col("is_table").cast("int")).alias("tables")
    )
    sizes = sizes.filter("tables >= 1 AND n >= 2")
    # Spark sizes both sides by the values alone, without the explode: never a broadcast.
    sizes = sizes.select("segment", "key", "n").hint("merge")
    live = stored(rows.join(sizes, ["segment", "key"]), "buckets")
    cold = live.filter(F.col("n") <= hot).select(
        F.xxhash64("segment", "key").alias("bucket"), "value", "is_table"
    )
    big = live.filter(F.col("n") > hot).select(
        F.xxhash64("segment", "key").alias("outer"), "segment", "value"
    )
    cut = None
    for segment, other in ((0, 32), (1, 0)):
        some = _balls(big.filter(F.col("segment") == segment), ["outer"], other, 32, 2)
        cut = some if cut is None else cut.unionByName(some)
    cut = cut.select(F.xxhash64("outer", "segment", "key").alias("bucket"), "value", "is_table")
    both = cold.unionByName(cut)
    found = both.repartition("bucket").mapInArrow(_link_buckets(distance), "a long, b long")
    return found.distinct()


def _classes(
    docs: DataFrame, shingle: int, distance: int, keep: Sequence[str], id_column: str, text_column: str
) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, fingerprint, kept) and classes (value, component, component_id)."""
    rows = docs.select(F.col(id_column).alias("id"), F.struct("*").alias("whole"))
    kept = F.struct(*[F.col("whole")[c].alias(c) for c in keep] or [F.lit(0).alias("none")])
    rows = rows.withColumn("fingerprint", fingerprint(F.col("whole")[text_column], shingle))
    marked = rows.select("id", "fingerprint", kept.alias("kept"), F.monotonically_increasing_id().alias("row"))
    marked = stored(marked, "fingerprints")
    values = marked.groupBy(F.col("fingerprint").alias("value")).agg(F.min("id").alias("least"))
    values = stored(values, "values")
    found = components(links(values.select("value"), distance))
    # As many rows as linked values, in files that say less of them than they take in memory.
    found = found.select(F.col("node").alias("value"), F.col("component")).hint("merge")
    joined = values.join(found, "value", "left")
    joined = joined.withColumn("component", F.coalesce("component", "value"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked, joined.join(least, "component").select("value", "component", "component_id")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, fingerprint, component_id) of each row.

    ``fingerprint`` is the SimHash of the whole text over shingles of ``shingle``
    words, 16 hex digits; those of ``distance`` or fewer differing bits are linked,
    and ``component_id`` is the smallest id reachable. Texts without words, null
    ones too, share fingerprint zero, which links like any other. Equal rows and
    ids stay. A null id is no component's name unless all its ids are null. An
    empty table gives an empty result, further columns are not read.

    Copies meet in their fingerprint before anything is linked: only different
    fingerprints are looked up, under 66 keys each.
    """
    marked, named = _classes(docs, shingle, distance, (), id_column, text_column)
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return marked.join(named, marked["fingerprint"] == named["value"]).select(
        F.col("id").alias(id_column), hexed.alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, nulls last;
    of rows with that id any one."""
    marked, named = _classes(docs, shingle, distance, docs.columns, id_column, text_column)
    rows = marked.select("row", "id", "fingerprint")
    rows = rows.join(named, rows["fingerprint"] == named["value"])
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    first = rows.groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    # A row for each component: their number has no bound that would allow a broadcast.
    first = stored(first, "kept-rows").hint("merge")
    return marked.join(first, "row", "left_semi").select("kept.*")
