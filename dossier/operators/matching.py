"""Requests to a scoring model, its replies, and the hook that calls it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions.text import strip_fences, within_budget
from .published import entries, publish_next, remove
from .records import CHILDREN, LISTS, TEXTS

#: Columns of the stored row that a request carries; the others go as empty defaults.
SENT = (
    "name", "english_name", "birth_year", "age", "nationality", "current_status", "earliest_start", "education_level", "school",
    "major", "military_status", "desired_salary", "desired_industry", "years_of_experience", "linkedin_url", "email", "skills_text", "self_introduction",
)
SCORES = ("overall_score", "education_score", "experience_score", "skills_score")
REPLY = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in SCORES]
    + [T.StructField("analysis_text", T.StringType()), T.StructField("strengths", T.ArrayType(T.StringType())), T.StructField("gaps", T.ArrayType(T.StringType()))]
)

_KEYS = [T.StructField("candidate_id", T.LongType()), T.StructField("job_id", T.LongType())]
_SCORED = T.StructType([*_KEYS, *REPLY.fields])
_REJECTED = T.StructType([*_KEYS, *[T.StructField(c, T.StringType()) for c in ("stage", "reason", "reply")]])


def candidate_json(candidates: DataFrame) -> Column:
    """A candidate's record as JSON, without references and attachments."""
    have = set(candidates.columns)
    fields = [(F.coalesce(F.col(c), F.lit("")) if c in SENT and c in have else F.lit("")).alias("code_104" if c == "code" else c) for c in TEXTS]
    empty = F.expr("cast(array() as array<string>)")
    fields += [(F.coalesce(F.col(c), empty) if c in have else empty).alias(c) for c in LISTS]
    fields += [F.expr(f"cast(array() as {CHILDREN[c]})").alias(n) for c, n in (("work", "work_experiences"), ("education", "education"))]
    return F.to_json(F.struct(*fields))


def match_requests(candidates: DataFrame, jobs: DataFrame, wanted: DataFrame, system: str = "", context: int = 4096, response: int = 2048) -> DataFrame:
    """candidate_id, job_id and request for each wanted pair (candidate_id, job_id) that exists.

    The request is the candidate's record and the job's document in one text,
    cut to the budget. Both sides are joined by their keys, so every pair is
    made where it is wanted and no product of the two tables arises.
    """
    person = candidates.select(F.col("id").alias("candidate_id"), candidate_json(candidates).alias("_person"))
    job = jobs.select(F.col("id").alias("job_id"), F.col("source_json").alias("_job"))
    pairs = wanted.select("candidate_id", "job_id").distinct().join(job, "job_id").join(person, "candidate_id")
    text = F.concat(F.lit(f"=== {L.CANDIDATE_TITLE} ===\n"), "_person", F.lit(f"\n\n=== {L.JOB_TITLE} ===\n"), "_job")
    return pairs.select("candidate_id", "job_id", within_budget(text, context, response, len(system)).alias("request"))


def extraction_requests(df: DataFrame, id_col: str, text_col: str, system: str = "", context: int = 4096, response: int = 2048) -> DataFrame:
    """``id_col`` and request: the text cut to what the model's context leaves."""
    return df.select(id_col, within_budget(F.coalesce(F.col(text_col), F.lit("")), context, response, len(system)).alias("request"))


def score_with(requests: DataFrame, function: Callable[[pd.Series], pd.Series], tasks: int | None = None) -> DataFrame:
    """``requests`` with the reply that ``function`` gives, and what went wrong (null: nothing).

    The function gets batches of requests. Where it raises, or gives another
    number of replies, each request of that batch is asked by itself, so only
    those that fail alone are without a reply, with the exception as their
    error. A slow model is asked by ``tasks`` tasks at once.
    """
    rows = requests.repartition(tasks) if tasks else requests
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("reply", "error")], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def one(request: str | None) -> tuple[str | None, str | None]:
        try:
            (reply,) = function(pd.Series([request]))
            return reply, None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies, errors = list(function(batch["request"])), [None] * len(batch)
                if len(replies) != len(batch):
                    raise ValueError("another number of replies")
            except Exception:
                pairs = [one(r) for r in batch["request"]]
                replies, errors = [p[0] for p in pairs], [p[1] for p in pairs]
            yield batch.assign(reply=replies, error=errors)[schema.names]

    return rows.mapInPandas(run, schema)


class Scored(NamedTuple):
    """Pairs whose reply was good, with its fields, and rejects (candidate_id, job_id, stage, reason, reply)."""

    scores: DataFrame
    rejects: DataFrame


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """All published scores under ``path``: candidate_id, job_id and the reply's fields."""
    return _slices(spark, path, "scores", _SCORED)


def _slices(spark: SparkSession, path: str, name: str, schema: T.StructType, runs: set[str] | None = None) -> DataFrame:
    done = [e.batch for e in entries(spark, path) if e.rows.get(name) and (runs is None or e.batch in runs)]
    return spark.read.schema(schema).parquet(*[f"{path}/{name}/batch={b}" for b in done]) if done else spark.createDataFrame([], schema)


def score_missing(requests: DataFrame, function: Callable[[pd.Series], pd.Series], path: str, slices: int = 16, tasks: int | None = None) -> Scored:
    """Ask for what has no stored score yet, slice by slice, and store it under ``path``.

    Requests (candidate_id, job_id, request) whose pair has a score are left
    out, so a second run after a stop asks only for what is missing, failed
    requests and bad replies included. Pairs are dealt to ``slices`` by a hash;
    each slice is asked, stored and published before the next one begins, so
    at most one is asked again after a stop. A slice is dealt evenly to ``tasks``,
    or to as many as the session's shuffles have: its files are small, and few
    tasks would read them. Returns all scores of the requests
    and the rejects of this run, each with the stage that failed (``request``
    or ``reply``) and the reason.
    """
    spark, keys, run = requests.sparkSession, ["candidate_id", "job_id"], uuid.uuid4().hex
    missing = requests.join(stored_scores(spark, path).select(*keys), keys, "left_anti").withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    folder = f"{path}/asked/{run}"
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing.write.partitionBy("_slice").parquet(folder)
    asked = spark.read.schema(missing.schema).parquet(folder)
    mine = set()
    for k in range(slices):
        batch = f"{run}-{k:06d}"
        replies = score_with(asked.where(F.col("_slice") == k).drop("_slice"), function, tasks)
        replies.write.mode("overwrite").parquet(f"{path}/replies/{batch}")  # asked once: what follows reads the answers
        replies = spark.read.schema(replies.schema).parquet(f"{path}/replies/{batch}")
        good, bad = parse_match_replies(replies.where("error is null"), keys)
        failed = replies.where("error is not null").select(*keys, F.lit("request").alias("stage"), F.col("error").alias("reason"), "reply")
        wrong = bad.select(*keys, F.lit("reply").alias("stage"), F.col("fault").alias("reason"), "reply")
        sizes = {}
        for name, rows, schema in (("scores", good, _SCORED), ("rejects", failed.unionByName(wrong), _REJECTED)):
            rows.select(*schema.names).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            sizes[name] = spark.read.schema(schema).parquet(f"{path}/{name}/batch={batch}").count()
        publish_next(spark, path, batch, sizes)
        mine.add(batch)
        remove(spark, f"{path}/replies/{batch}")
    remove(spark, folder)
    found = stored_scores(spark, path).join(requests.select(*keys).distinct(), keys, "left_semi")
    return Scored(found, _slices(spark, path, "rejects", _REJECTED, mine))


def match_fault(raw: Column, parsed: Column) -> Column:
    """The first field of a reply that has another type than the model's; null for a good one.

    Scores may be numbers in a text. ``json`` is the fault of what is no JSON
    object. ``parsed`` is ``try_parse_json`` of ``raw``, as a column of its own.
    """
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    whole = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    faults = [F.when(~whole.startswith("OBJECT"), F.lit("json"))]
    for f in REPLY.fields:
        kind, text = F.schema_of_variant(F.try_variant_get(parsed, f"$.{f.name}", "variant")), F.get_json_object(raw, f"$.{f.name}")
        if f.name in SCORES:
            good = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL") | ((kind == "STRING") & text.rlike(number)) | (kind == "BOOLEAN")
        elif f.name == "analysis_text":
            good = kind == "STRING"
        else:
            good = (kind == "ARRAY<STRING>") | (text == "[]")
        faults.append(F.when(kind.isNotNull() & ~F.coalesce(good, F.lit(False)), F.lit(f.name)))
    return F.coalesce(*faults)


def match_reply(raw: Column) -> Column:
    """A good reply's fields; those that are missing are 0, "" or empty."""
    text = lambda f: F.get_json_object(raw, f"$.{f}")
    truth = lambda c: F.when(c == "true", "1").when(c == "false", "0").otherwise(F.trim(c))
    empty = F.expr("cast(array() as array<string>)")
    return F.struct(
        *[F.coalesce(truth(text(c)).try_cast("double"), F.lit(0.0)).alias(c) for c in SCORES],
        F.coalesce(text("analysis_text"), F.lit("")).alias("analysis_text"),
        *[F.coalesce(F.from_json(text(c), "array<string>"), empty).alias(c) for c in ("strengths", "gaps")],
    )


def parse_match_replies(df: DataFrame, keep: list[str], reply_col: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Good replies with their fields, and rejects (``keep``, reply, fault). One bad reply stops no other."""
    rows = df.withColumn("_text", strip_fences(F.coalesce(F.col(reply_col), F.lit("")))).withColumn("_json", F.try_parse_json("_text"))
    rows = rows.withColumn("_fault", match_fault(F.col("_text"), F.col("_json")))
    good = rows.where("_fault is null").select(*keep, match_reply(F.col("_text")).alias("_r")).select(*keep, "_r.*")
    return good, rows.where("_fault is not null").select(*keep, F.col(reply_col).alias("reply"), F.col("_fault").alias("fault"))


def weighted_overall(education: Column, experience: Column, skills: Column) -> Column:
    """What the overall score should be; stored values are taken as given, so this is a check."""
    return education * 0.2 + experience * 0.4 + skills * 0.4
