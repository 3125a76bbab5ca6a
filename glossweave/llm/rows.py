"""Row-local work on texts in Arrow batches: whole texts, bounded pieces, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of text worked on at a time. A single longer text is one piece.
PIECE_BYTES = 2 << 20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset:]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices with at most ``limit`` bytes of text each, one row at least."""
    _, offsets = buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, keep: list[str], text: str, result: str, make: Callable[[], Callable[[pa.Array], dict]]) -> DataFrame:
    """Columns ``keep`` + the columns of the DDL string ``result``, computed row by row from the whole text.

    ``make`` is called once a task and returns a function from a piece of texts to arrays by column name. A kept column
    with the name of a result is replaced by it.
    """
    out = df.sparkSession.createDataFrame([], result).schema
    names = [f.name for f in out]
    kept = [c for c in keep if c not in names]
    at = kept.index(text) if text in kept else len(kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if text in kept else [F.col(f"`{text}`").alias("__text")]))
    schema = type(out)(source.schema.fields[:len(kept)] + out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, at):
                found = work(piece.column(at))
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(kept))] + [pa.array(found[n]) if not isinstance(found[n], pa.Array) else found[n] for n in names], names=kept + names)

    return source.mapInArrow(run, schema)


def with_plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named by number, and the number of each name: no operator's result clashes with them."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def own_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
