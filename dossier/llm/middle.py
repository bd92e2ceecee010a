"""Fill-in-the-middle: texts cut in three and put in another order, cuts found by counts of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .encoders import Memory, lasting

#: Marks before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes that the rolling hash sees, and of a chunk at least, at most and, in powers of two, on average beyond the least.
WINDOW, LEAST, MOST, BITS = 16, 64, 4096, 9
#: Bytes of remembered chunks in one generation of a worker's cache.
REMEMBERED = 32_000_000

_FACTOR = 0x9E3779B97F4A7C15
_SPREAD = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of it and the WINDOW - 1 before it, or of as many as there are; doubled windows, no loop over bytes."""
    found, width, factor = _SPREAD[data], 1, _FACTOR
    while width < WINDOW:
        shifted = found[:-width] * np.uint64(factor)
        found = found.copy()
        found[width:] += shifted
        width, factor = 2 * width, factor * factor % (1 << 64)
    return found


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where chunks of ``data`` end: after a byte whose hash has BITS top bits zero, LEAST to MOST bytes after the last end.

    A passage in another text has the same ends inside it, but for a few at its start.
    """
    marks = np.flatnonzero(rolling(data) >> np.uint64(64 - BITS) == 0) + 1
    ends, at, size = [], 0, len(data)
    for mark in (*marks.tolist(), size):
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST or mark == size and mark > at:
            at = mark
            ends.append(at)
    return ends


def summary(chunk: bytes) -> bytes:
    """Of a chunk, as two 32-bit numbers: its bytes that end a character begun before it, and the characters that begin in it."""
    begins = (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80
    head = int(begins.argmax()) if begins.any() else len(chunk)
    return np.array([head, begins.sum()], np.uint32).tobytes()


class Cutter:
    """Counts characters of texts chunk by chunk and finds where the k-th begins.

    What a chunk adds is remembered by its content: a dictionary compares the
    bytes themselves after their hash, so a shared passage is counted once for
    as long as it is remembered, and a collision can't count wrong.
    """

    def __init__(self, bound: int = REMEMBERED):
        self.known = Memory(summary, bound)

    def table(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ends of chunks, and the characters begun up to each; a chunk's head must end what the ones before it began."""
        ends = chunk_ends(np.frombuffer(data, np.uint8))
        starts = [0, *ends][: len(ends)]
        found = np.frombuffer(b"".join([self.known[data[a:b]] for a, b in zip(starts, ends, strict=True)]), np.uint32).reshape(-1, 2)
        return np.array(ends, np.int64), np.cumsum(found[:, 1], dtype=np.int64)

    def offset(self, data: bytes, ends: np.ndarray, counts: np.ndarray, k: int) -> int:
        """The byte at which the character number ``k`` begins; the end for one beyond the last."""
        if not len(counts) or k >= counts[-1]:
            return len(data)
        i = int(np.searchsorted(counts, k, side="right"))
        start, before = (int(ends[i - 1]), int(counts[i - 1])) if i else (0, 0)
        begins = np.flatnonzero((np.frombuffer(data[start : int(ends[i])], np.uint8) & 0xC0) != 0x80)
        return start + int(begins[k - before])


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the SHA-256 of seed, colon and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1", keep: list[str] | None = None
) -> DataFrame:
    """``id_col``, ``keep``, n, form, prefix_chars, middle_chars and output of each row.

    Two places drawn from the id by SHA-256 cut the whole text in prefix,
    middle and suffix. Form ``psm`` puts prefix, suffix, middle in a row, each
    after its mark; ``spm`` suffix, prefix, middle; ``plain`` is the text as it
    is, for ``plain_percent`` of all rows, for empty texts and for those that
    hold a mark. ``spm_percent`` of the others are ``spm``.

    Null counts as empty, a null id as one without digits. Rows with equal ids
    and texts come out alike. Very long texts are cut in time that grows with
    their length. Nothing is shuffled; an empty table gives an empty one. A
    column in ``keep`` with the name of a new one is replaced by it.
    """
    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
    made = {id_col, *(f.name for f in fields)}
    keep = [c for c in (keep or []) if c not in made]
    schema = T.StructType([df.schema[id_col], *[df.schema[c] for c in keep], *fields])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    plain_from = 100 - plain_percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = lasting(("cutter",), Cutter)

        def one(key: str | None, text: str | None) -> tuple:
            data = (text or "").encode()
            ends, counts = cutter.table(data)
            n = int(counts[-1]) if len(counts) else 0
            h1, h2, h3, h4 = draws(seed, key or "")
            if not n or h3 % 100 >= plain_from or any(m in data for m in marks):
                return n, "plain", None, None, data
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (cutter.offset(data, ends, counts, k) for k in (first, second))
            prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
            if h4 % 100 < spm_percent:
                return n, "spm", first, second - first, suffix + prefix + middle
            return n, "psm", first, second - first, prefix + suffix + middle

        for batch in batches:
            keys, texts = batch.column("__key").to_pylist(), batch.column("__text").to_pylist()
            for start, end in slices(texts):
                found = [one(k, t) for k, t in zip(keys[start:end], texts[start:end], strict=True)]
                rest = batch.slice(start, end - start)
                columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                columns.append(pa.array([x[4] for x in found], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([rest.column(c) for c in (id_col, *keep)] + columns, names=schema.names)

    key = F.col(id_col).cast("string").alias("__key")
    return df.select(id_col, *keep, key, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from, found by its marks alone."""
    first = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(mark: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(first, mark, 1)
        rest = F.substr(first, F.length(one) + len(mark) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``fill_in_middle`` with digests of the output and of the text that it gives back."""
    again = restored(F.col("form"), F.col("output"))
    return found.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
