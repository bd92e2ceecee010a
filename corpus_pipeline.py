"""Documents made ready for training: judged, deduplicated, redacted, mixed and packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.jaccard import jaccard_components
from dossier.llm.mixing import in_order, mix_sources
from dossier.llm.packing import pack_mixture
from dossier.llm.pii import redact_pii
from dossier.llm.quality import quality
from dossier.llm.store import shared_dir, written


def whole_rows(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` beside each row as one column, so that no column of the documents clashes with one of an operator."""
    return docs.select(F.struct("*").alias("row"), *names)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Bands are learned from all ``labels`` in ``sf_dir``, if it names a folder;
    without it fixed bands are widened by all documents. Null
    and empty texts go; repeated rows are judged each by themselves; a null or
    unknown language is judged by the text's script. A very long text is judged
    whole. An empty table gives an empty one. All columns stay as they are,
    whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if sf_dir else None
    rows = whole_rows(docs, "doc_id", "text", "lang")
    return quality(rows, keep=["row"], labels=labels).where("kept").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Where ids are repeated, rows are numbered in the order of their ids and
    grouped by number, so one row of each group stays. Rows without an id stay,
    and so do null and empty texts, which are near nothing. An empty table
    gives an empty one.
    """
    rows, key = whole_rows(docs, "doc_id", "text"), "doc_id"
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        key = "number"
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn(key, number)
        rows = written(rows, "numbered")
    others = jaccard_components(rows, id_col=key).where("not kept").select(key).distinct()
    return rows.join(others, key, "left_anti").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, all rows and other columns stay."""
    return redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, each source at its target weight.

    A null source is one of its own. No row goes, repeated ones included. Rows
    are in ranges of slots and sorted, so the files that they are written to are
    the mixture, from the first row of the first file to the last of the last;
    the ids say so in their metadata, and ``pack`` goes by it.
    """
    mixed = mix_sources(whole_rows(docs, "doc_id", "source"), keep=["row"])
    placed = mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
    return in_order(placed, "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens, numbered along the mixture.

    Files that ``mix`` has been written to are read in its order, row by row.
    Documents that no mixing stage has ordered, or that don't come straight from
    its files, are mixed first.
    """
    return pack_mixture(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokens, near duplicates and packing are beyond SQL; tests hold the operators and the mixture against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
