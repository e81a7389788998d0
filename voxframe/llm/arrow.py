"""Small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from voxframe.llm.words import CHUNK_BYTES


def binary(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row slices of about most bytes of the column, with its values as bytes (null: empty). A longer value is whole."""
    for batch in batches:
        texts = binary(batch, column)
        sizes = texts.value_lengths().fill_null(0).to_pylist() if hasattr(texts, "value_lengths") else [len(v or b"") for v in texts.to_pylist()]
        begin = held = 0
        for k, n in enumerate(sizes):
            if k > begin and held + n > most:
                yield batch.slice(begin, k - begin), [v or b"" for v in texts.slice(begin, k - begin).to_pylist()]
                begin, held = k, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin), [v or b"" for v in texts.slice(begin).to_pylist()]
