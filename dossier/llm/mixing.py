"""Sources mixed to target weights by Pfair scheduling, with SQL functions only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks in one scheduling cycle, at least, and for each source; weights are rounded to that part.
CYCLE, EACH = 1000, 16

#: Earliest deadline first over one cycle. Block k of a source with p of q blocks
#: is released at floor(k q / p) and due at ceil((k + 1) q / p); in each slot the
#: released block that is due first is taken, ties by source number.
_PICKS = """
aggregate(
  sequence(0, q - 1),
  named_struct('done', array_repeat(0, size(p)), 'picks', cast(array() as array<struct<i:int,k:int>>)),
  (acc, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(p) - 1), i -> get(acc.done, i) < get(p, i) and get(acc.done, i) * q div get(p, i) <= t),
      i -> named_struct('due', ((get(acc.done, i) + 1) * q + get(p, i) - 1) div get(p, i), 'i', i)
    ))),
    b -> named_struct(
      'done', transform(acc.done, (d, i) -> d + if(i = b.i, 1, 0)),
      'picks', array_append(acc.picks, named_struct('i', b.i, 'k', get(acc.done, b.i)))
    )
  )[0],
  acc -> acc.picks
)
"""


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    power: float = 0.7,
    block_rows: int = 16,
    cycle: int = CYCLE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row's place in a mixture in which every source keeps to its target weight.

    Returns ``id_col``, ``source_col``, the columns in ``keep``, block (number
    within its source), slot (the block's place in the mixture, unique among
    blocks), place (row within the block) and weight (blocks in a cycle).
    Ordered by (slot, place), any prefix of whole blocks holds of each source
    its weight's share of blocks, off by less than one, until a source runs
    out; its share then goes to the others by their weights. No row is dropped
    or repeated.

    ``weights`` names targets by source; sources not named get none of the
    cycle but one block, so their rows still appear. Without it a source of n
    rows has the target n to the ``power``. Weights are rounded to ``cycle``
    parts, or EACH for each source where those are more, one at least.

    Rows of a source come in an order fixed by a hash of the id. Ranks are
    counted in buckets of (source, hash), then buckets are summed, so a source
    with a third of all rows is spread over as many tasks as any other rows.
    Tables of one row for each source are broadcast; that of the slots of a
    cycle, for each set of sources left, only where Spark finds it small. One
    cycle is scheduled in one task, at a cost of its slots times the sources,
    so sources may be a few hundred.

    A null source is a source of its own. Rows with equal ids stay apart rows.
    An empty table gives an empty one. Columns in ``keep`` that have the name of
    an output column are replaced by it; any other names are safe.
    """
    made = {id_col, source_col, "block", "slot", "place", "weight"}
    keep = [c for c in (keep or []) if c not in made]
    kept = [F.struct(*keep).alias("_kept")] if keep else []
    buckets = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A null source gets a name that no string has once others carry a prefix.
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        name.alias("_name"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(buckets)).cast("int").alias("_bucket"),
        *kept,
    )

    counted = df.select(name.alias("_name"), F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(buckets)).cast("int").alias("_bucket"))
    counted = counted.groupBy("_name", "_bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("_name", "_bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))

    sources = counted.groupBy("_name").agg(F.sum("n").alias("n"))
    if weights:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))])
        target = F.coalesce(F.try_element_at(named, F.col("_name")), F.lit(0.0))
    else:
        target = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    everything = Window.partitionBy(F.lit(0))
    scale = F.greatest(F.lit(cycle), F.lit(EACH) * F.count("*").over(everything))
    sources = sources.withColumn("target", target).withColumn(
        "p", F.greatest(F.lit(1), F.round(scale.cast("double") * F.col("target") / F.sum("target").over(everything)).cast("int"))
    )
    # Blocks of a source fill p slots of each cycle, and so it lasts this many cycles.
    blocks = F.ceil(F.col("n") / F.lit(block_rows))
    sources = sources.withColumn("lasts", F.ceil(blocks / F.col("p")).cast("long")).select("_name", "p", "lasts")

    # A phase is a run of cycles with the same sources left; one phase for each distinct length.
    ends = sources.select(F.col("lasts").alias("until")).distinct()
    started = F.coalesce(F.lag("until").over(Window.partitionBy(F.lit(0)).orderBy("until")), F.lit(0))
    phases = (
        ends.withColumn("since", started)
        .join(F.broadcast(sources), F.col("lasts") > F.col("since"))
        .groupBy("since", "until")
        .agg(F.sort_array(F.collect_list(F.struct("_name", "p"))).alias("left"))
        .select(
            "since",
            "until",
            F.col("left._name").alias("names"),
            F.col("left.p").alias("p"),
            F.expr("cast(aggregate(left, 0, (a, x) -> a + x.p) as int)").alias("q"),
        )
    )
    run = Window.partitionBy(F.lit(0)).orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    phases = phases.withColumn(
        "first_slot", F.coalesce(F.sum((F.col("until") - F.col("since")) * F.col("q")).over(run), F.lit(0))
    )
    picks = phases.select("since", "until", "q", "first_slot", "names", F.posexplode(F.expr(_PICKS)).alias("at", "pick")).select(
        F.expr("get(names, pick.i)").alias("_name"), F.col("pick.k").alias("_k"), "since", "until", "q", "first_slot", "at"
    )

    ranked = (
        rows.withColumn("_in", F.row_number().over(Window.partitionBy("_name", "_bucket").orderBy(F.xxhash64("_id", F.lit(9)), "_id")))
        .join(ahead, ["_name", "_bucket"])
        .join(F.broadcast(sources), "_name")
        .withColumn("_rank", F.col("_ahead") + F.col("_in") - 1)
        .withColumn("block", F.floor(F.col("_rank") / F.lit(block_rows)))
        .withColumn("place", F.pmod(F.col("_rank"), F.lit(block_rows)).cast("int"))
        .withColumn("_cycle", F.floor(F.col("block") / F.col("p")))
        .withColumn("_k", F.pmod(F.col("block"), F.col("p")).cast("int"))
    )
    since = phases.select("since", "until")
    ranked = ranked.join(F.broadcast(since), (F.col("_cycle") >= F.col("since")) & (F.col("_cycle") < F.col("until"))).drop("until")
    slot = F.col("first_slot") + (F.col("_cycle") - F.col("since")) * F.col("q") + F.col("at")
    return ranked.join(picks.drop("until"), ["_name", "_k", "since"]).select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        *[F.col("_kept")[c].alias(c) for c in keep],
        F.col("block").cast("long"),
        slot.cast("long").alias("slot"),
        "place",
        F.col("p").alias("weight"),
    )


#: Said of a column whose rows are in the order of a mixture.
IN_ORDER = "in the order of the mixture"


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``mixed``, rows sorted as the mixture, with that said in the metadata of ``id_col``; Parquet files keep it."""
    return mixed.withMetadata(id_col, mixed.schema[id_col].metadata | {IN_ORDER: True})


def file_places(df: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """``df`` with _file and _row, where each row of a mixture lies in its files; None unless it is read from such files.

    A writer numbers its files by partition, and one that cuts a partition's
    file in several numbers those.
    """
    if not df.schema[id_col].metadata.get(IN_ORDER):
        return None
    name = F.col("_metadata.file_name")
    part, cut = F.regexp_extract(name, r"^part-(\d+)", 1), F.regexp_extract(name, r"-c(\d+)\.", 1)
    number = F.coalesce(part.try_cast("long"), F.lit(0)) * F.lit(1 << 20) + F.coalesce(cut.try_cast("long"), F.lit(0))
    try:
        return df.select("*", number.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # rows that have been joined or grouped since
        return None


def mixed_order(df: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``mix_sources`` sorted as the mixture, with the columns of ``df`` only."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*df.columns)
