"""Token counts of whole texts."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stewardspark.llm.tokens import encoder


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, in one pass without a shuffle.

    ``tokenizer`` is the path, on every worker, of a tokenizers (.json) or
    sentencepiece (.model) file. No special ids are added, special strings inside
    a text are read as the library does by default, nothing is cut off or padded.

    Texts come in Arrow batches; long ones are cut at safe boundaries, pieces are
    encoded in batches of equal bytes, and only lengths come back. A null text
    counts as empty (0, 0, false). Repeated rows and ids give repeated rows, an
    empty table gives none, further columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, lengths=True)
        for batch in batches:
            counts = encode.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.binary_length(batch.column(1)).cast(pa.int64()), 0),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )
        encode.forget()

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_column, text_column).mapInArrow(count, schema)
