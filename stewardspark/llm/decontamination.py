"""Benchmark decontamination: SimHash of item-sized windows, in SQL functions only."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark.llm.common import stored

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 16
ITEM_SHINGLES_AT_ONCE = 1 << 20

_ONES = """aggregate(sequence(0, 63), 0L, (bits, b) -> bits | CASE WHEN 2 * aggregate({hashes}, 0,
    (n, h) -> n + CAST(shiftrightunsigned(h, b) & 1L AS INT)) > size({hashes}) THEN shiftleft(1L, b) ELSE 0L END)"""


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; a null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda word: word != "")


def shingles(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, in their order."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - length),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)]),
    )
    return F.when(F.size(words) >= length, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """64 bits, each 1 if it is set in over half of the hashes, repeats included."""
    return F.expr(_ONES.format(hashes=hashes))


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text, so that copies are judged once."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), F.reverse(whole)).alias("k2")]


def _items(benchmark: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(item, words, length, hashes, bits): different items with words."""
    items = benchmark.select(F.col(id_column).alias("item"), words_of(F.col(text_column)).alias("words"))
    items = items.filter(F.size("words") > 0).select(
        "item", F.size("words").alias("words"), F.least(F.size("words"), F.lit(shingle)).alias("length"),
        F.col("words").alias("w"),
    )
    hashes = F.lit(None).cast("array<bigint>")
    for length in range(1, shingle + 1):
        hashes = F.when(F.col("length") == length, shingles(F.col("w"), length)).otherwise(hashes)
    items = items.select("item", "words", "length", hashes.alias("hashes")).distinct()
    return stored(items.withColumn("bits", simhash("hashes")), "items")


def _hits(texts: DataFrame, items: DataFrame, lengths: Sequence[int], blocks: int) -> DataFrame:
    """(k1, k2, n_words, item, words, length, at): where a shingle of an item stands in a text.

    ``items`` go to the texts in ``blocks`` parts of about ``ITEM_SHINGLES_AT_ONCE``
    shingles, each broadcast: its size has that bound.
    """
    known = items.select("item", "words", "length", F.explode(F.array_distinct("hashes")).alias("hash"))
    found = None
    for length in lengths:
        of_length = known.filter(F.col("length") == length)
        at = texts.select(
            "k1", "k2", F.size("w").alias("n_words"), F.posexplode(shingles(F.col("w"), length)).alias("at", "hash")
        )
        for block in range(blocks):
            part = of_length.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
            some = at.join(F.broadcast(part), "hash")
            found = some if found is None else found.unionByName(some)
    return found.select("k1", "k2", "n_words", "item", "words", "length", "at")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    blocks: int = BLOCKS,
    item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """(k1, k2, item, similarity, distance, first, words) of each text that holds an item.

    ``k1`` and ``k2`` are the text's ``text_key``. A window is as many words as the
    item has (the whole text if that is shorter). It holds the item if their
    fingerprints differ in at most ``2 * blocks - 1`` bits and the weighted Jaccard
    similarity of their shingles, each weighing as often as it stands there, is
    ``similarity`` or more; the most similar window is given. Words are runs of
    letters and digits in lower case; shingles have ``shingle`` words, those of a
    shorter item as many as it has. Items without words are left out, equal items
    are each found, null texts hold nothing.

    Only windows that can be similar enough are fingerprinted: those in which
    ``similarity`` of the item's shingles stand. They start at a shared shingle,
    since a window that does not is no better than the next one, or end with the
    text. Fingerprints meet in ``blocks`` blocks of bits, looked up with one bit
    changed: within the radius one block differs in one bit at most. Equal texts
    and equal windows are looked at once.
    """
    items = _items(benchmark, item_column, text_column, shingle)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    n_shingles = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    parts = max(1, -(-n_shingles // ITEM_SHINGLES_AT_ONCE))
    texts = docs.select(*text_key(F.col(text_column)), words_of(F.col(text_column)).alias("w"))
    places = _hits(texts, items, lengths or [shingle], parts).groupBy("k1", "k2", "item").agg(
        F.first("n_words").alias("n_words"),
        F.first("words").alias("words"),
        F.first("length").alias("length"),
        F.array_sort(F.collect_set("at")).alias("at"),
    )
    shared = F.ceil(F.lit(similarity) * (F.col("words") - F.col("length") + 1) - 1e-9).cast("int")
    places = places.withColumn("shared", F.greatest(shared, F.lit(1))).filter("size(at) >= shared")
    starts = F.expr(
        """transform(filter(sequence(0, size(at) - shared), i -> at[i + shared - 1] - at[i] <= words - length),
           i -> greatest(0, least(at[i], n_words - words)))"""
    )
    windows = places.select("k1", "k2", "words", "length", F.explode(starts).alias("first")).distinct()
    wanted = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("words", "length", "first")).alias("wanted"))
    wanted = stored(wanted, "windows")
    held = docs.select(*text_key(F.col(text_column)), F.col(text_column).alias("text"))
    held = held.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    held = held.select("k1", "k2", "wanted", words_of(F.col("text")).alias("w"))
    for length in lengths:
        held = held.withColumn(f"h{length}", shingles(F.col("w"), length))
    hashes = F.array().cast("array<bigint>")
    cut = "slice(h{0}, window.first + 1, window.words - window.length + 1)"
    held = held.withColumn("window", F.explode("wanted"))
    for length in lengths:
        hashes = F.when(F.col("window.length") == length, F.expr(cut.format(length))).otherwise(hashes)
    held = held.select("k1", "k2", "window.*", hashes.alias("hashes"))
    held = held.withColumns({"w1": F.xxhash64("words", "hashes"), "w2": F.xxhash64(F.lit(1), F.reverse("hashes"))})
    held = stored(held, "window-hashes")
    different = held.groupBy("words", "w1", "w2").agg(F.first("hashes").alias("hashes"))
    different = stored(different.withColumn("bits", simhash("hashes")), "window-bits")
    pairs = stored(_near(different, items, blocks), "window-pairs")
    similar = _similar(pairs, different, items, similarity)
    best = F.max(F.struct("similarity", -F.col("distance"), -F.col("first"), "words")).alias("best")
    named = held.select("k1", "k2", "words", "w1", "w2", "first").join(similar, ["words", "w1", "w2"])
    named = named.groupBy("k1", "k2", "item").agg(best)
    return named.select(
        "k1", "k2", "item", "best.similarity", (-F.col("best.col2")).alias("distance"),
        (-F.col("best.col3")).alias("first"), "best.words",
    )


def _near(windows: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """(words, w1, w2, item, distance) of windows and items of a size within the radius."""
    width = 64 // blocks
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    mask = (1 << width) - 1
    key = F.expr(f"CAST(shiftrightunsigned(bits, block * {width}) & {mask}L AS INT)")
    asked = windows.select("words", "w1", "w2", "bits", F.explode(numbers).alias("block"))
    asked = asked.select("words", "w1", "w2", "bits", "block", key.alias("key"))
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(width)])
    table = items.select("words", "item", F.col("bits"), F.explode(numbers).alias("block"))
    table = table.select("words", "item", "bits", "block", key.alias("own"), F.explode(flips).alias("flip"))
    table = table.select(
        "words", "item", F.col("bits").alias("item_bits"), "block", F.col("own").bitwiseXOR(F.col("flip")).alias("key")
    )
    met = asked.join(table, ["words", "block", "key"])
    distance = F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits")))
    met = met.withColumn("distance", distance).filter(F.col("distance") <= 2 * blocks - 1)
    return met.select("words", "w1", "w2", "item", "distance").distinct()


def _similar(pairs: DataFrame, windows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` whose weighted shingle similarity is high enough, with it."""
    mine = pairs.join(windows, ["words", "w1", "w2"]).select(
        "words", "w1", "w2", "item", "distance", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")
    )
    mine = mine.groupBy("words", "w1", "w2", "item", "distance", "n", "hash").agg(F.count("*").alias("weight"))
    theirs = items.select("item", F.size("hashes").alias("n_item"), F.explode("hashes").alias("hash"))
    theirs = theirs.groupBy("item", "n_item", "hash").agg(F.count("*").alias("item_weight"))
    both = mine.join(theirs, ["item", "hash"]).groupBy("words", "w1", "w2", "item", "distance", "n", "n_item")
    both = both.agg(F.sum(F.least("weight", "item_weight")).alias("inner"))
    alike = F.col("inner") / (F.col("n") + F.col("n_item") - F.col("inner"))
    both = both.withColumn("similarity", alike).filter(F.col("similarity") >= similarity)
    return both.select("words", "w1", "w2", "item", "distance", "similarity")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """(id, item_id, similarity, distance, first_word, n_words): the items each row holds.

    See ``leaks``. Rows without an item are not in the result; equal rows are each
    named. Empty tables give empty results, further columns are not read.
    """
    found = stored(leaks(docs, benchmark, text_column=text_column, **options), "leaks")
    rows = docs.select(F.col(id_column), *text_key(F.col(text_column)))
    return rows.join(found, ["k1", "k2"]).select(
        id_column, F.col("item").alias("item_id"), "similarity", "distance",
        F.col("first").alias("first_word"), F.col("words").alias("n_words"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    found = leaks(docs, benchmark, text_column=text_column, **options).select("k1", "k2").distinct()
    found = stored(found, "leaks").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    k1, k2 = text_key(F.col(text_column))
    marked = docs.select(*[docs[c] for c in docs.columns], k1.alias("_k1"), k2.alias("_k2"))
    return marked.join(found, ["_k1", "_k2"], "left_anti").select(*docs.columns)
