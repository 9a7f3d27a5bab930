"""Token files: the ids of a corpus, coded in checksummed blocks, in the order of ids."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stewardspark.llm import id_coder
from stewardspark.llm.common import by_partition, new_path
from stewardspark.llm.tokens import encoder

GROUP_IDS = id_coder.BLOCK * id_coder.LANES


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    group_ids: int = GROUP_IDS,
) -> None:
    """Encode whole texts and write their ids below ``path``, in ascending order of id.

    Nothing special is added but ``end_id`` after each text (null text: only that).
    Null ids come first; equal ids are ordered by text, equal rows stay. An empty
    table gives files without groups; further columns are not read.

    A file is Parquet, written by Spark and so committed whole. Its rows are groups
    of up to ``group_ids`` ids: ``shard`` and ``first`` (ids before it in the shard),
    ``coded`` (see ``id_coder``) and ``parts``, the documents in it: ``ordinal`` in
    the shard, id, ``part`` (a long document goes on in the next group) and ``n``.
    Shards are ranges of ids, so their ids one after the other are the corpus.
    """
    kind = docs.schema[id_column].dataType
    parts = f"array<struct<ordinal:long,id:{kind.simpleString()},part:int,n:long>>"
    schema = f"shard int, first long, n_ids long, parts {parts}, coded binary"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        waiting, held, parts, first, ordinal = [], 0, [], 0, 0
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def group() -> pa.RecordBatch:
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            listed = pa.array(
                [parts],
                pa.list_(pa.struct([("ordinal", pa.int64()), ("id", id_type), ("part", pa.int32()), ("n", pa.int64())])),
            )
            columns = [
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                listed, pa.array([id_coder.encode(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "first", "n_ids", "parts", "coded"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                part = 0
                while True:
                    piece = ids[: group_ids - held]
                    waiting.append(piece)
                    parts.append({"ordinal": ordinal, "id": key, "part": part, "n": len(piece)})
                    held += len(piece)
                    ids, part = ids[len(piece) :], part + 1
                    if held == group_ids:
                        yield group()
                        waiting, parts, first, held = [], [], first + held, 0
                    if not len(ids):
                        break
                ordinal += 1
        if parts:
            yield group()

    rows.mapInArrow(write, schema).write.parquet(path)


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two byte strings put together, from theirs and the second's length.

    A zero byte acts on a crc as a matrix over bits; its power is applied to the first.
    """
    matrix = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        matrix = [_times(matrix, row) for row in matrix]
    while second_bytes:
        if second_bytes & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, row) for row in matrix]
        second_bytes >>= 1
    return first ^ second


@F.pandas_udf(LongType())
def _joined(parts: pd.Series) -> pd.Series:
    out = []
    for some in parts:
        crc = 0
        for part in some:
            crc = crc32_joined(crc, part["crc"], 4 * part["n"]) if crc or part["part"] else part["crc"]
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Parts of documents in token files: (shard, ordinal, id, part, start, n, crc, ids).

    ``start`` counts the ids before the part in its shard, ``crc`` is the crc32 of
    its ids as little-endian 32-bit numbers, ``ids`` null without ``with_ids``.
    Every block is decoded and checked; a damaged one raises an error.
    """
    files = spark.read.parquet(path)
    kind = files.schema["parts"].dataType.elementType["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tasks that wrote in this worker have left what they remember to one another.
        encoder.cache_clear()
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, parts = (batch.column(k)[i].as_py() for k in range(3))
                ids = id_coder.decode(batch.column(3)[i].as_py())
                ends = np.cumsum([p["n"] for p in parts])
                starts = ends - [p["n"] for p in parts]
                raw = memoryview(ids.astype("<u4").tobytes())
                bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
                id_type = batch.schema.field(2).type.value_type.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(parts), pa.int32()),
                        pa.array([p["ordinal"] for p in parts], pa.int64()),
                        pa.array([p["id"] for p in parts], id_type),
                        pa.array([p["part"] for p in parts], pa.int32()),
                        pa.array(starts + first, pa.int64()),
                        pa.array([p["n"] for p in parts], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in bounds], pa.int64()),
                        pa.array([ids[a:b].tolist() if with_ids else None for a, b in bounds], pa.list_(pa.int64())),
                    ],
                    names=["shard", "ordinal", "id", "part", "start", "n", "crc", "ids"],
                )

    schema = f"shard int, ordinal long, id {kind}, part int, start long, n long, crc long, ids array<long>"
    return files.select("shard", "first", "parts", "coded").mapInArrow(read, schema)


def token_file_index(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in token files, read from them.

    ``start`` counts the ids of all documents before it. Only the sums of the shards
    go through the driver.
    """
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    before, total = {}, 0
    for shard, n in sorted((r["shard"], r["n"]) for r in sizes):
        before[shard] = total
        total += n
    parts = read_token_files(spark, path).groupBy("shard", "ordinal").agg(
        F.first("id").alias("id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("part", "crc", "n"))).alias("parts"),
    )
    return parts.select(
        F.col("id").alias(id_column),
        (F.col("start") + by_partition(F.col("shard"), before)).alias("start"),
        "n_tokens",
        _joined("parts").alias("ids_crc32"),
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read their index back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return token_file_index(spark, path)
