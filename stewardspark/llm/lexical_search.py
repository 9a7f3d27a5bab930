"""Ranked lexical search of many items at once, with shared partial sums.

The items' terms are mined for common parts: terms that occur in the same items are
one node of a sum, then the pair of nodes that most items share becomes a node, again
and again, until no pair is shared. What results is a graph of sums in which each
shared set of terms stands once. Documents are split into terms once; in a task the
partial score of each node is computed once for each document, and items add up the
nodes they are made of.
"""

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardspark.llm.common import new_path, stored

#: Items are taken in blocks of about so many terms, so that a graph has a bounded size.
BLOCK_TERMS = 1 << 16
#: Pairs are mined among so many of an item's most shared nodes.
MINED = 64
#: Numbers a task holds at once for the partial scores of some documents.
CELLS = 1 << 22
#: Candidates of tasks are merged in so many groups first.
SLICES = 64

#: Bytes that are part of no term (fixed by the operator's definition) become spaces,
#: A-Z become a-z; bytes of other than ASCII characters stay.
_IN_TERM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _IN_TERM else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return (text or b"").translate(_TABLE).split()


def sharing_graph(items: Sequence[Sequence[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """Sums shared by ``items``, which are sets of term numbers below ``n_terms``.

    Returns the parts of each further node, numbered on from ``n_terms``, each made of
    earlier nodes or terms, and the parts of each item. Every term of an item is in
    exactly one of its parts, and equal items have equal parts.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    distinct = {frozenset(item): None for item in items}
    for number, item in enumerate(distinct):
        for term in item:
            holders[term].append(number)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for term in sorted(holders):
        alike[tuple(holders[term])].append(term)
    nodes: list[list[int]] = []
    parts: list[set[int]] = [set() for _ in distinct]
    for shared, terms in alike.items():
        node = terms[0]
        if len(terms) > 1:
            node = n_terms + len(nodes)
            nodes.append(terms)
        for number in shared:
            parts[number].add(node)
    uses = Counter(node for own in parts for node in own)
    mined = [
        {n for n in sorted(own, key=lambda n: (-uses[n], n))[:MINED] if uses[n] > 1} for own in parts
    ]
    having: dict[tuple[int, int], set[int]] = defaultdict(set)
    for number, own in enumerate(mined):
        for pair in combinations(sorted(own), 2):
            having[pair].add(number)
    heap = [(-len(numbers), pair) for pair, numbers in having.items() if len(numbers) > 1]
    heapq.heapify(heap)
    while heap:
        count, pair = heapq.heappop(heap)
        numbers = having.get(pair, ())
        if len(numbers) != -count:
            if len(numbers) > 1:
                heapq.heappush(heap, (-len(numbers), pair))
            continue
        new = n_terms + len(nodes)
        nodes.append(list(pair))
        touched = set()
        for number in list(numbers):
            own = mined[number]
            own.difference_update(pair)
            for other in own:
                for old in pair:
                    having[(min(old, other), max(old, other))].discard(number)
                having[(other, new)].add(number)
                touched.add((other, new))
            own.add(new)
            parts[number].difference_update(pair)
            parts[number].add(new)
        del having[pair]
        for made in touched:
            if len(having[made]) > 1:
                heapq.heappush(heap, (-len(having[made]), made))
    by_set = {item: sorted(own) for item, own in zip(distinct, parts, strict=True)}
    return nodes, [by_set[frozenset(item)] for item in items]


def _counting(vocabulary):
    """Arrow function: rows (id, text) to (id, n, terms, counts) of texts with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            sizes, terms, counts, kept = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counted = Counter(words)
                known = counted.keys() & numbers.keys()
                kept.append(i)
                sizes.append(len(words))
                terms.append([numbers[w] for w in known])
                counts.append([counted[w] for w in known])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, ints),
                    pa.array(counts, ints),
                ],
                names=["id", "n", "terms", "counts"],
            )

    return count


class _Best:
    """The ``k`` best (score, id) of each item: highest scores, ties to smaller ids, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` has a row an item and a column a document."""
        good = scores >= self.least[:, None]
        for item in np.flatnonzero(good.any(1)).tolist():
            at = np.flatnonzero(good[item])
            own = self.found[item]
            own += [(-s, ids[i] is None, ids[i]) for s, i in zip(scores[item, at].tolist(), at.tolist(), strict=True)]
            if len(own) > 2 * self.k:
                self._cut(item)

    def _cut(self, item: int) -> None:
        own = sorted(self.found[item], key=lambda e: e[:2] if e[1] else e)[: self.k]
        self.found[item] = own
        if len(own) == self.k:
            self.least[item] = -own[-1][0]

    def rows(self) -> Iterator[tuple[int, int, object]]:
        for item in range(len(self.found)):
            self._cut(item)
            for score, _, id_ in self.found[item]:
                yield item, -score, id_


def _scoring(graph, k: int):
    """Arrow function: rows (id, n, terms, counts) to the task's best (item, score, id) of each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, nodes, items, n_docs, n_terms = graph.value
        first = len(weights)
        at_once = max(16, min(2048, CELLS // (first + len(nodes) + 1)))
        best, kind = _Best(len(items), k), None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                size = part.num_rows
                lengths = np.asarray(part.column(1))
                level = 50 + (50 * lengths * n_docs) // n_terms
                lists = part.column(2)
                doc = np.repeat(np.arange(size), np.asarray(lists.value_lengths()))
                terms = np.asarray(lists.flatten())
                counts = np.asarray(part.column(3).flatten()).astype(np.int64)
                sums = np.zeros((first + len(nodes), size), np.int64)
                sums[terms, doc] = weights[terms] * (
                    (1_000_000_000 * counts) // (1000 * counts + 20 * level[doc])
                )
                for number, parts in enumerate(nodes, start=first):
                    sums[parts].sum(0, out=sums[number])
                scores = np.stack([sums[parts].sum(0) for parts in items])
                best.add(scores, part.column(0).to_pylist())
        if kind is None:
            return
        columns = list(zip(*best.rows(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)],
            names=["item", "score", "id"],
        )

    return score


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))],
            names=["query", "id", "terms"],
        )


def _best_of(rows: DataFrame, k: int, *group: str) -> DataFrame:
    own = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(item id, rank, id, score) of the ``k`` best rows of ``docs`` for each row of ``items``.

    Terms are stretches of digits, letters and characters outside ASCII, A-Z lower
    cased. The score is the sum, over the item's different terms, of a whole-number
    weight by rarity times a saturated count that allows for the text's length; only
    scores above 0 are given. Equal scores go by ascending id, nulls last. Ranks are
    from 1 and unique.

    Null and empty texts, and those without terms, are found by no item and counted in
    no statistic; such items give no rows. Each row of either table stands for itself,
    also if it or its id is repeated or null. Empty tables give an empty result, further
    columns are not read.

    Whole texts are split once for each block of items, statistics cover all texts. A
    task gives its ``k`` best rows an item; these are merged in two steps. Blocks are
    dealt by hash, of about ``BLOCK_TERMS`` terms: only a block's terms, their counts
    and its graph go through the driver.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    item_type = items.schema[item_column].dataType.simpleString()
    asked = items.select(
        F.monotonically_increasing_id().alias("query"),
        F.col(item_column).alias("id"),
        F.col(item_text_column).alias("text"),
    )
    asked = stored(asked.mapInArrow(_item_terms, f"query long, id {item_type}, terms array<binary>"), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    path = new_path(spark, "best")
    result = f"query long, rank int, id {id_type}, score long"
    spark.createDataFrame([], result).write.parquet(path)
    for block in range(blocks):
        mine = asked.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == block))
        rows = mine.select("query", "terms").collect()
        if rows:
            _rank_block(texts, rows, k, id_type).select("query", "rank", "id", "score").write.mode(
                "append"
            ).parquet(path)
    best = spark.read.schema(result).parquet(path).withColumnRenamed("id", "found")
    named = best.join(asked.select("query", F.col("id").alias("item")), "query")
    return named.select(
        F.col("item").alias(item_column), "rank", F.col("found").alias(id_column), "score"
    )


def _rank_block(texts: DataFrame, rows: list, k: int, id_type: str) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = {term: i for i, term in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    sent = spark.sparkContext.broadcast(vocabulary)
    counted = texts.mapInArrow(_counting(sent), f"id {id_type}, n long, terms array<int>, counts array<int>")
    counted = stored(counted, "terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in frequent:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    nodes, parts = sharing_graph([[vocabulary[bytes(t)] for t in r["terms"]] for r in rows], len(vocabulary))
    graph = spark.sparkContext.broadcast((weights, nodes, parts, n_docs, n_terms))
    found = counted.mapInArrow(_scoring(graph, k), f"item int, score long, id {id_type}")
    sliced = found.withColumn("slice", F.spark_partition_id() % SLICES)
    best = _best_of(_best_of(sliced, k, "item", "slice").drop("rank"), k, "item")
    numbered = spark.createDataFrame(
        [(i, r["query"]) for i, r in enumerate(rows)], "item int, query long"
    )
    return best.join(numbered, "item")
