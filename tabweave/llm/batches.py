"""Small helpers for functions that run over Arrow record batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of variable-length output after which a record batch is handed on.
FLUSH_BYTES = 16 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes; a null counts as the empty text."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The column's strings; a null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


class Rows:
    """Collects output rows and hands them on as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: Sequence, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
