"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores in front until no column of ``taken`` has that name."""
    names = {t.lower() for t in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose texts hold at most ``most`` bytes, or one row."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield batch.slice(start)
