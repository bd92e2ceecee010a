"""Run a function over the texts of a DataFrame in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows handed to the function at once; with long texts fewer.
ROWS, CHARS = 4096, 4_000_000


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of at most ROWS texts and about CHARS characters."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if i + 1 - start >= ROWS or chars >= CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    fields: list[T.StructField],
    keep: list[str],
) -> DataFrame:
    """``keep`` columns plus ``fields``, computed from ``text_col`` alone.

    ``make`` is called once in each task and returns the function that turns a
    list of texts into one Arrow array for each of ``fields``. A kept column
    with the name of a field is replaced by it.
    """
    made = {f.name for f in fields}
    keep = [c for c in keep if c not in made]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for start, end in slices(texts):
                rest = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(c) for c in keep] + function(texts[start:end]),
                    names=[*keep, *(f.name for f in fields)],
                )

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(run, schema)
