"""Token sequences packed by hierarchical best-fit."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .encoders import encoder, vocabulary
from .mixing import file_places, mix_sources
from .store import input_partitions, written

#: Items that one task packs at once, at most about.
LOCAL_ITEMS = 100_000
#: Tasks whose underfull bins meet in one task of the next round. Rounds of as many
#: tasks as before end once one joins less than this share of its bins.
MERGED, GAIN = 16, 0.01
#: Slots of a mixture that are packed together at first.
RANGE_SLOTS = 64

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("pieces", T.IntegerType()),
    ]
)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by index in bins: largest first, each into the fullest bin that takes it.

    Bins are kept by free space, and a bit mask tells which free spaces occur,
    so an item costs constant time.
    """
    by_space: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            chosen, space = [], capacity
            bins.append(chosen)
        chosen.append(i)
        by_space[space - size].append(chosen)
        mask |= 1 << (space - size)
    return bins


def cut_pieces(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int, keep: list[str] | None = None) -> DataFrame:
    """A row for each piece of each text's ids, the short piece first, with the columns in ``keep``.

    The pieces of a row have consecutive uids.
    """
    keep = keep or []
    schema = T.StructType(PIECES.fields + [df.schema[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_col, texts = batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist()
            for lo, hi in slices(texts):
                rows, origin = [], []
                for row, (doc, ids) in enumerate(zip(ids_col[lo:hi], encode(texts[lo:hi]), strict=True), lo):
                    raw = np.frombuffer(ids, "<u2").astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for k in range(len(edges) - 1):
                        a, b = edges[k], edges[k + 1]
                        rows.append((doc, serial, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(edges) - 1))
                        serial += 1
                    origin += [row] * (len(edges) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                    + [batch.column(c).take(pa.array(origin, pa.int64())) for c in keep],
                    names=schema.names,
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *keep)
    return rows.mapInArrow(run, schema)


def pack_items(items: DataFrame, capacity: int, nearly: int = 8, local_items: int = LOCAL_ITEMS, place: Column | None = None) -> DataFrame:
    """Items (uid, size) into bins: uid, bin (the least uid of its items, which comes first), offset.

    Rounds: tasks pack their items best-fit. A bin with at most ``nearly`` free
    places, or too full for the smallest bin anywhere, stays as it is. All
    others are the items of the next round, in which MERGED tasks' bins meet in
    one task, until one task is left. No task gets more than about
    ``local_items``: where so many bins stay underfull that tasks can't become
    fewer, they are dealt out anew, as long as that joins some.

    Items are dealt by a hash, or with ``place`` (from 0 to under 1, a function
    of uid) to tasks of neighbours, unless dealt anew.
    """
    result = T.StructType(
        [
            T.StructField("uid", T.LongType()),
            T.StructField("bin", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("fill", T.LongType()),
        ]
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")
        uids, sizes = group["uid"].tolist(), group["size"].tolist()
        out = []
        for members in best_fit(sizes, capacity):
            members.sort()
            fill, at = sum(sizes[i] for i in members), 0
            for i in members:
                out.append((uids[i], uids[members[0]], at, fill))
                at += sizes[i]
        return pd.DataFrame(out, columns=result.names)

    count = items.count()
    tasks = max(1, min(input_partitions(items), math.ceil(count / 64)), math.ceil(count / local_items))
    level, levels, anew = items.select("uid", "size"), [], False
    while True:
        dealt = F.pmod(F.xxhash64("uid", F.lit(len(levels))), F.lit(tasks))
        if place is not None and not anew:
            dealt = F.floor(place * F.lit(tasks))
        packed = written(level.select("uid", "size", dealt.alias("task")).groupBy("task").applyInPandas(pack, result), "packed")
        levels.append(packed)
        if tasks == 1:
            break
        bins = packed.where(F.col("uid") == F.col("bin")).where(F.col("fill") < capacity - nearly)
        least = bins.agg(F.min("fill")).first()[0] or capacity
        level = bins.where(F.col("fill") + least <= capacity).select("uid", F.col("fill").alias("size"))
        left = level.count()
        fewer = max(math.ceil(tasks / MERGED), math.ceil(left / local_items))
        if left < 2 or fewer >= tasks and left > (1 - GAIN) * count:
            break
        tasks, count, anew = fewer, left, fewer >= tasks
    placed = levels[0].select("uid", "bin", "offset")
    for packed in levels[1:]:
        moved = packed.select(F.col("uid").alias("bin"), F.col("bin").alias("into"), F.col("offset").alias("by"))
        placed = placed.join(moved, "bin", "left").select(
            "uid", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
        )
    return placed


def pack_sequences(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 2,
    capacity: int = 1024,
) -> DataFrame:
    """Where each piece of each text's ids lies in sequences of ``capacity`` tokens at most.

    Returns ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.
    A text is its ids and ``end_id``. One that is longer than ``capacity`` is
    cut into full pieces, which are sequences of their own, and a shorter first
    piece; short pieces are packed by ``pack_items``. Only ids and sizes of
    pieces are shuffled, never tokens.

    Null or empty text: ``end_id`` alone. Rows with the same id are packed as
    the rows they are. An empty table gives an empty one.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")
    pieces = written(cut_pieces(df, id_col, text_col, path, end_id, capacity), "pieces")
    short = pieces.where(F.col("length") < capacity).select("uid", F.col("length").alias("size"))
    placed = pack_items(short, capacity)
    return pieces.join(placed, "uid", "left").select(
        F.col("doc_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("bin", "uid").alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("long")).alias("offset"),
    )


def handed_on(placed: DataFrame, capacity: int, nearly: int = 8) -> DataFrame:
    """Rows placed in ``pack_mixture``'s ranges, their underfull sequences joined with those of neighbouring ranges."""
    one = placed.where("offset = 0").select(F.col("sequence").alias("uid"), F.col("fill").alias("size"))
    least, last = one.agg(F.min("size"), F.max(F.shiftright("uid", 32))).first()
    open_ones = one.where((F.col("size") < capacity - nearly) & (F.col("size") + F.lit(least or capacity) <= capacity))
    joined = pack_items(open_ones, capacity, nearly, place=F.shiftright("uid", 32) / F.lit((last or 0) + 1))
    moved = joined.where("uid <> bin").select(F.col("uid").alias("sequence"), F.col("bin").alias("into"), F.col("offset").alias("by"))
    return placed.join(moved, "sequence", "left").withColumns(
        {"sequence": F.coalesce("into", "sequence"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))}
    )


def _as_filed(first: DataFrame, block_rows: int = 16) -> DataFrame:
    """Slot and place of documents (_file, _row) of a mixture: files by number, rows as they lie in them."""
    files = first.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    # A row for each file.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("_before") + F.col("_row")
    found = first.join(F.broadcast(files.select("_file", before.alias("_before"))), "_file")
    return found.select("uid", "length", "pieces", F.floor(at / F.lit(block_rows)).alias("slot"), F.pmod(at, F.lit(block_rows)).alias("place"))


def pack_mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer_path: str | None = None,
    end_id: int = 2,
    capacity: int = 1024,
    range_slots: int | None = None,
) -> DataFrame:
    """``pack_sequences`` in the order of ``mix_sources``, with the same columns.

    Rows read from files that are in the order of a mixture (``mixing.in_order``)
    keep it: 16 of them, a block, are a slot. Others are mixed here.

    The mixture's slots are cut into ranges of RANGE_SLOTS. Pieces of a range's
    rows are packed best-fit first, each range being one bounded task; sequences
    follow their first row in it, and their ids rise from range to range. What
    ranges leave underfull meets what their neighbours leave, round by round, as
    in ``pack_items``, and takes the place of its first sequence. So sequences up
    to a range's end hold all rows of the mixture up to there, and of later rows
    those alone that fill what ranges left.

    With ``range_slots`` ranges are that wide and nothing is handed on: sequences
    up to a range's end hold exactly the rows up to there, and each range leaves
    about one sequence underfull.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")
    placed = file_places(df, id_col)
    keep = [source_col] if placed is None else ["_file", "_row"]
    pieces = written(cut_pieces(df if placed is None else placed, id_col, text_col, path, end_id, capacity, keep), "pieces")
    first = pieces.where("piece = 0").select("doc_id", *keep, "uid", "length", "pieces")
    mixed = mix_sources(first, id_col="doc_id", source_col=source_col, keep=["uid", "length", "pieces"]) if placed is None else _as_filed(first)
    result = "first_uid long, sequence long, offset long, after long, fill long"
    width = range_slots or RANGE_SLOTS

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "place"])
        uids, sizes, counts = group["uid"].tolist(), group["length"].tolist(), group["pieces"].tolist()
        # A bin is one sequence; the full pieces of a long text are one each.
        bins = best_fit(sizes, capacity)
        units = [(min(b), 0, 1, b) for b in bins] + [(i, 1, n - 1, [i]) for i, n in enumerate(counts) if n > 1]
        sequence, offset, after, fill = ([0] * len(uids) for _ in range(4))
        number = int(key[0]) << 32
        for _, full, n, members in sorted(units):
            at, whole = 0, sum(sizes[i] for i in members)
            for i in members:
                if full:
                    after[i] = number
                else:
                    sequence[i], offset[i], fill[i] = number, at, whole
                    at += sizes[i]
            number += n
        return pd.DataFrame({"first_uid": uids, "sequence": sequence, "offset": offset, "after": after, "fill": fill})

    ranges = mixed.select("uid", "length", "pieces", "slot", "place", F.floor(F.col("slot") / F.lit(width)).alias("range"))
    placed = ranges.groupBy("range").applyInPandas(pack, result)
    if not range_slots:
        placed = handed_on(written(placed, "ranges"), capacity)
    own = F.col("piece") == 0
    return pieces.withColumn("first_uid", F.col("uid") - F.col("piece")).join(placed, "first_uid").select(
        F.col("doc_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.when(own, F.col("sequence")).otherwise(F.col("after") + F.col("piece") - 1).alias("sequence_id"),
        F.when(own, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
