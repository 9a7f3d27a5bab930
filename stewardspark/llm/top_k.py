"""Exact top-k by integer inner product: best-first search in M-trees."""

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardspark.llm.common import stored

PAGE = 128
TREE_ROWS = 1 << 16
QUERY_BLOCK = 4096
PAGES_AT_ONCE = 16


def quantized(vector: Column, scale: int = 1024) -> Column:
    """Components as whole numbers floor(scale * x).

    Null for a vector that takes no part: a null or empty one, or one with a null
    or non-finite component.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return F.when((F.size(vector) > 0) & sound, whole)


def _apart(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - center) ** 2).sum(1))


class Tree:
    """An M-tree over whole-numbered vectors.

    A vector x is lifted to (x, sqrt(M - x.x)), M being the largest x.x, and a
    query to (q, 0): the squared distance is then q.q + M - 2 q.x, so the nearest
    is the one with the highest inner product. A page holds the pivots of its
    children with their covering radii, or points, each with its distance from
    the page's own pivot.
    """

    def __init__(self, ids: np.ndarray, own: np.ndarray, whole: np.ndarray, page: int = PAGE):
        self.ids, self.own, self.whole = ids, own, whole
        flat = whole.astype(np.float64)
        squares = (flat**2).sum(1)
        self.sphere = float(squares.max())
        points = np.column_stack([flat, np.sqrt(np.maximum(self.sphere - squares, 0.0))])
        self.exact = 2.0**52 > self.sphere
        self.pivot = points.mean(0)
        self.root = self._page(points, np.arange(len(ids)), self.pivot, page)

    def _page(self, points: np.ndarray, rows: np.ndarray, pivot: np.ndarray, page: int) -> tuple:
        if len(rows) <= page:
            return (None, _apart(points[rows], pivot), None, rows)
        fan = max(2, min(page, -(-len(rows) // (page // 2))))
        seeds = points[rows[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        nearest = ((seeds**2).sum(1) - 2 * points[rows] @ seeds.T).argmin(1)
        parts = [part for i in range(fan) if len(part := rows[nearest == i])]
        if len(parts) == 1:  # equal points: cut in order
            parts = np.array_split(rows, fan)
        pivots = np.array([points[part].mean(0) for part in parts])
        radii = np.array([_apart(points[p], c).max() for p, c in zip(parts, pivots, strict=True)])
        children = [self._page(points, p, c, page) for p, c in zip(parts, pivots, strict=True)]
        return (pivots, _apart(pivots, pivot), radii, children)

    def search(self, query_own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, -id), rows with the query's own number left out.

        Pages are taken nearest first. A page or point is passed over without
        computing its distance if the triangle inequality over the stored
        distances shows it too far, and the search ends at the first page beyond
        the k-th best. Scores are whole numbers; the bounds leave room for
        rounding, so no point as good as the k-th is passed over.
        """
        best: list[tuple[int, int]] = []
        lifted = np.append(query.astype(np.float64), 0.0)
        norm = float((lifted**2).sum())
        slack = 1e-6 * (1.0 + np.sqrt(norm + self.sphere))
        exact = self.exact and norm < 2.0**52
        wide = lifted[:-1] if exact else query
        limit = np.inf
        first = float(np.sqrt(((lifted - self.pivot) ** 2).sum()))
        pages, turn = [(0.0, 0, first, self.root)], 0
        while pages:
            bound, _, away, (pivots, apart, radii, below) = heapq.heappop(pages)
            if bound > limit:
                break
            if radii is None:
                rows = below[np.abs(away - apart) <= limit + slack]
                rows = rows[self.own[rows] != query_own]
                scores = (self.whole[rows] @ wide if exact else self.whole[rows].astype(object) @ wide.astype(object))
                if len(best) == k:
                    kept = scores >= best[0][0]
                    rows, scores = rows[kept], scores[kept]
                for key, score in zip(self.ids[rows].tolist(), scores.tolist(), strict=True):
                    entry = (int(score), -key)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    limit = np.sqrt(max(norm + self.sphere - 2.0 * best[0][0], 0.0)) + slack
                continue
            at = np.flatnonzero(np.abs(away - apart) - radii <= limit + slack)
            distances = _apart(pivots[at], lifted)
            least = np.maximum(distances - radii[at] - slack, 0.0)
            for i, d, low in zip(at.tolist(), distances.tolist(), least.tolist(), strict=True):
                if low <= limit:
                    turn += 1
                    heapq.heappush(pages, (low, turn, d, below[i]))
        return sorted(best, reverse=True)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, own numbers, matrix) of a batch (id, own, whole), one for each length of vector."""
    ids, own, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield ids[at], own[at], flat[starts[at][:, None] + np.arange(length)]


def _least_ids(ids: np.ndarray, own: np.ndarray, whole: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Of equal vectors only the rows that can be among the ``keep`` best of a query.

    A query gets no row with its own number. Numbers may repeat, but then with one id:
    of each number ``keep`` rows can be in a result, and among the first ``2 * keep`` of
    those rows ``keep`` at most bear the query's number.
    """
    _, kind = np.unique(whole, axis=0, return_inverse=True)
    order = np.lexsort((own, ids, kind.ravel()))

    def first_of(*columns: np.ndarray) -> np.ndarray:
        new = np.zeros(len(order), bool)
        new[:1] = True
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))

    kinds = kind.ravel()[order]
    order = order[np.arange(len(order)) - first_of(kinds, own[order]) < keep]
    kinds = kind.ravel()[order]
    order = order[np.arange(len(order)) - first_of(kinds) < 2 * keep]
    return ids[order], own[order], whole[order]


def _gathered(rows: int, pack, name: str):
    """Arrow function: rows (id, own, whole) to (dims, ``name``), a blob for each ``rows`` of a length."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def blob(length: int) -> pa.RecordBatch:
            ids, own, whole = (np.concatenate(c) for c in zip(*waiting.pop(length), strict=True))
            packed = pickle.dumps(pack(ids, own, whole), protocol=5)
            return pa.RecordBatch.from_arrays(
                [pa.array([length], pa.int32()), pa.array([packed], pa.binary())], names=["dims", name]
            )

        for batch in batches:
            for part in _vectors(batch):
                length = part[2].shape[1]
                waiting.setdefault(length, []).append(part)
                if sum(len(p[0]) for p in waiting[length]) >= rows:
                    yield blob(length)
        for length in list(waiting):
            yield blob(length)

    return gather


def build_index(vectors: DataFrame, k: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """M-trees of up to ``tree_rows`` rows of ``vectors`` (id, own, whole), one a row.

    Stored are the tree's pages with pivots, covering radii and distances from their
    parents, and its vectors.
    """

    def grown(ids: np.ndarray, own: np.ndarray, whole: np.ndarray) -> Tree:
        return Tree(*_least_ids(ids, own, whole, k))

    return stored(vectors.mapInArrow(_gathered(tree_rows, grown, "tree"), "dims int, tree binary"), "m-trees")


def top_k(
    embeddings: DataFrame,
    queries: DataFrame | Column,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest integer inner products of each query.

    ``queries`` is a condition: the rows of ``embeddings`` that meet it are asked, each
    against all rows but itself, also if its id or vector is there again. Or it is
    another table: each of its different rows is asked against all rows with another
    id. Both tables have an id and a vector; components count as floor(scale * x).

    Ties go to the smaller id; fewer than ``k`` rows are all returned. A vector that
    is null, empty or has a null or non-finite component takes no part, nor does a row
    with a null id; vectors of another length than the query's are no candidates. Equal
    candidates rank one after the other. Empty tables give an empty result, further
    columns are not read.

    Rows are dealt out evenly and kept in M-trees of bounded size in the shared
    folder, queries in pages of about ``query_block``. Each tree meets each page of its
    length in a task, by a join of groups of both; no query goes through the driver, and
    a tree gives at most ``k`` rows for a query.
    """
    spark = embeddings.sparkSession

    def whole(df: DataFrame, *more: Column) -> DataFrame:
        vector = quantized(F.col(vector_column), scale).alias("whole")
        rows = df.select(F.col(id_column).cast("long").alias("id"), vector, *more)
        return rows.filter("id IS NOT NULL AND whole IS NOT NULL")

    if isinstance(queries, Column):
        number = F.monotonically_increasing_id().alias("own")
        rows = stored(whole(embeddings, queries.alias("asked"), number), "numbered")
        asked = rows.filter("asked").select("id", "own", "whole", F.col("own").alias("query"))
    else:
        rows = whole(embeddings).withColumn("own", F.col("id"))
        asked = whole(queries).distinct().select(
            "id", F.col("id").alias("own"), "whole", F.monotonically_increasing_id().alias("query")
        )
    asked = stored(asked, "queries")
    blocks = max(1, -(-asked.count() // query_block))
    cores = spark.sparkContext.defaultParallelism
    # Row numbers of one input partition are neighbours; dealt by hash they spread evenly.
    trees = build_index(rows.select("id", "own", "whole").repartition(2 * cores, F.xxhash64("own", "id")), k)
    paged = asked.select("id", "query", F.concat(F.array("own"), "whole").alias("whole"))
    pages = paged.repartition(blocks, F.xxhash64("query"))
    pages = stored(
        pages.mapInArrow(_gathered(query_block, lambda *page: page, "page"), "dims int, page binary"), "pages"
    )
    met = _met(trees, pages.withColumn("dims", F.col("dims") - 1), blocks, 2 * cores)
    found = met.select("tree", "page").mapInArrow(_answer(k), "query long, query_id long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    placed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return placed.select("query_id", "rank", F.col("id").alias(id_column), "score")


def _met(trees: DataFrame, pages: DataFrame, n_pages: int, tasks: int) -> DataFrame:
    """Each tree with each page of its length.

    Both are dealt into groups, and a group of trees meets a group of pages in a task:
    a tree is sent once for each ``PAGES_AT_ONCE`` pages, a page once for each group of
    trees, of which there are as many as keep all tasks at work.
    """
    columns = -(-n_pages // PAGES_AT_ONCE)
    lines = -(-tasks // columns)
    number = F.monotonically_increasing_id()

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        mine = df.withColumn(own, F.pmod(number, F.lit(groups)))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>")))

    met = dealt(trees, "line", lines, "column", columns)
    return met.join(dealt(pages, "column", columns, "line", lines), ["dims", "line", "column"])


def _answer(k: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, page in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(tree.as_py())
                hits = []
                for query_id, query, own_and_vector in zip(*pickle.loads(page.as_py()), strict=True):
                    best = tree.search(int(own_and_vector[0]), own_and_vector[1:], k)
                    hits += [(int(query), int(query_id), -key, score) for score, key in best]
                columns = list(zip(*hits, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "id", "score"]
                )

    return answer
