"""Shards of near equal bytes by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

#: Expected number of sampled keys; each key range gets about sample / ranges of them.
SAMPLE = 65_536


def _splitters(base: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """Quantile boundaries of a sample in which a record counts by its size.

    A record is drawn ``size * sample / total`` times, rounded up or down by a
    hash of its id, so plain quantiles of the sample are quantiles of bytes.
    The draw is fixed by the data; its expected count is ``sample`` whatever the
    size of the table.
    """
    share = F.col("size") * F.lit(sample / total)
    chance = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(share + chance).cast("int")
    drawn = base.select("key", times.alias("times")).where("times > 0")
    drawn = drawn.select("key", F.explode(F.sequence(F.lit(1), F.col("times"))))
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile_approx("key", at, 4 * ranges).alias("at")).first()["at"]
    return sorted(set(found or []))


def assign_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    ranges: int = 1024,
    sample: int = SAMPLE,
) -> DataFrame:
    """Every record's shard and slot; shards differ by less than two key ranges.

    Returns ``id_col``, size (UTF-8 bytes plus 1), text_crc32, law (`bytes`),
    shard, slot (gapless from 0 in each shard) and grown_shard (null).

    Records are ordered by a hash of the text, so equal texts are neighbours.
    Sampled splitters cut that order into ``ranges`` key ranges. A text whose
    copies outweigh a range is subdivided by a hash of the id, so no task gets
    all copies of one text. Exact sums over ranges then give each record its
    place in bytes, and the shard is that of its middle over the total, so a
    shard is off by half the text at each of its ends at most. Copies of a
    text go together, unless the text was subdivided.

    Null text: no bytes and the crc32 of no bytes, so size 1. Rows with the
    same id and text are placed next to each other, each with its own slot.
    A null id is an id like any other. An empty table gives an empty one.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = df.select(
        F.col(id_col).alias("id"),
        (F.length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    base = written(base, "shard-keys")
    total = base.agg(F.sum("size")).first()[0] or 1
    splitters = np.array(_splitters(base, total, ranges, sample), dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right"))

    # Texts over one range's bytes: fewer than ``ranges`` of them can exist.
    limit = max(1, total // ranges)
    heavy = (
        base.groupBy("key")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > limit)
        .select("key", F.ceil(F.col("bytes") / F.lit(limit)).alias("cuts"))
    )
    part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("cuts")) + 1)
    ranged = (
        base.withColumn("range", range_of("key"))
        .join(F.broadcast(heavy), "key", "left")
        .withColumn("whole", F.col("cuts").isNull())
        .withColumn("part", part)
    )
    # The splitters hold the key ranges apart, but a heavy key must also be apart from its range.
    unit = ["range", "run", "part"]
    after = F.when(F.col("whole"), F.lit(None)).otherwise(F.col("key"))
    ranged = ranged.withColumn("run", after).drop("cuts")
    order = Window.partitionBy(*unit).orderBy("key", "id")
    inside = ranged.withColumns(
        {
            "rank": F.row_number().over(order).cast("long") - 1,
            "bytes": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    units = ranged.groupBy(*unit).agg(F.sum("size").alias("u_bytes"), F.count("*").alias("u_rows"))
    # One row for each unit, at most three times ``ranges``: a bound that data can't move.
    before = Window.orderBy("range", "run", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(
        *[F.col(c).alias(f"u_{c}") for c in unit],
        F.coalesce(F.sum("u_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("u_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in unit]
    placed = inside.join(F.broadcast(units), same[0] & same[1] & same[2]).withColumns(
        {
            "at": F.col("bytes_before") + F.coalesce("bytes", F.lit(0)),
            "rank": F.col("rows_before") + F.col("rank"),
        }
    )
    together = Window.partitionBy(*unit, "key")
    # Where its middle lies: a text across a border goes to the side that holds more of it.
    middle = F.when(F.col("whole"), F.min("at").over(together) + F.sum("size").over(together) / 2).otherwise(F.col("at") + F.col("size") / 2)
    shard = F.least(F.floor(middle * F.lit(shards) / F.lit(total)), F.lit(shards - 1)).cast("int")
    placed = written(
        placed.select("id", "size", "text_crc32", "rank", shard.alias("shard")), "shard-places"
    )
    # ``shards`` rows: where each shard begins in the global order.
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, places: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the records of ``df`` under ``path`` as shard=0, shard=1, ... in slot order."""
    placed = df.join(places.select(id_col, "shard", "slot"), id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
