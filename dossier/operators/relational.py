"""Lists, details, filters and pages over candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.text import decode_list, first_number, pieces

#: Words in degrees or departments (fixed values); a degree may hold words of both.
MASTERS = ("碩", "研究所", "Master", "MBA", "MS", "MA")
BACHELORS = ("大學", "⼤學", "學士", "Bachelor", "BS", "BA")
#: Schools of the top list (fixed values).
TOP_SCHOOLS = ("台灣大學", "臺灣大學", "台大", "清華大學", "清大", "交通大學", "交大", "陽明交通大學", "成功大學", "成大", "政治大學", "政大")


def ordered_children(children: DataFrame, columns: list[str], name: str, key: str = "candidate_id") -> DataFrame:
    """One row for each key with its children as an array of structs, by seq, then id."""
    item = F.struct("seq", "id", *[c for c in columns if c not in ("seq", "id")])
    return children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))


def candidate_summary(candidates: DataFrame, matches: DataFrame, education: DataFrame, job_id: int | None = None) -> DataFrame:
    """Candidates with each of their match results, or nulls, and their ordered education list, newest first.

    With ``job_id`` only results of that job are joined. The children are
    summed up before the join, so the list shuffles once by candidate.
    """
    if job_id is not None:
        matches = matches.where(F.col("job_id") == job_id)
    found = matches.select(F.col("candidate_id").alias("id"), "job_id", "overall_score")
    lists = ordered_children(education, ["school", "degree_level", "department"], "education").withColumnRenamed("candidate_id", "id")
    return candidates.join(found, "id", "left").join(lists, "id", "left").withColumn(
        "education", F.coalesce("education", F.expr("array()").cast(lists.schema["education"].dataType))
    ).orderBy(F.col("id").desc(), "job_id")


def candidate_detail(candidates: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], ids: list[int] | None = None) -> DataFrame:
    """Candidates with all child lists; with ``ids`` the filter reaches every scan."""
    out = candidates.where(F.col("id").isin(ids)) if ids else candidates
    for name, (table, columns) in children.items():
        part = table.where(F.col("candidate_id").isin(ids)) if ids else table
        out = out.join(ordered_children(part, columns, name).withColumnRenamed("candidate_id", "id"), "id", "left")
    return out


def experience_within(text: Column, low: float, high: float | None) -> Column:
    """The first number of the text lies in [low, high]; without ``high``, over ``low``."""
    years = first_number(text)
    return F.coalesce((years > low) if high is None else years.between(low, high), F.lit(False))


def score_within(score: Column, label: str) -> Column:
    bounds = {"80+": score >= 80, "60-79": (score >= 60) & (score < 80), "40-59": (score >= 40) & (score < 60), "<40": score < 40, "No Score": score.isNull()}
    return bounds[label]


def filter_candidates(
    df: DataFrame,
    name: str = "",
    education_level: str | None = None,
    skills: list[str] | None = None,
    experience: tuple[float, float | None] | None = None,
    score: str | None = None,
    schools: list[str] | None = None,
) -> DataFrame:
    """Rows that meet every condition given."""
    if name:
        df = df.where(F.lower("name").contains(name.lower()))
    if education_level:
        df = df.where(F.col("education_level") == education_level)
    if skills:
        df = df.where(F.size(F.array_except(F.lit(skills), F.coalesce("skill_tags", F.array()))) == 0)
    if experience:
        df = df.where(experience_within(F.col("years_of_experience"), *experience))
    if score:
        df = df.where(score_within(F.col("overall_score"), score))
    if schools:
        df = df.where(F.exists("education", lambda e: _has(e["school"], schools)) | _has(F.col("school"), schools))
    return df


def with_all_skills(skills: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids of candidates whose rows hold every wanted skill."""
    hits = skills.where(F.col("skill_name").isin(wanted)).groupBy("candidate_id").agg(F.count_distinct("skill_name").alias("n"))
    return hits.where(F.col("n") == len(set(wanted))).select("candidate_id")


def filter_options(table: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in code point order."""
    return table.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


def page(df: DataFrame, by: str, number: int = 0, size: int = 50, descending: bool = False, tie: str = "id") -> DataFrame:
    """One page of the sorted list; planned as a top-k, not a full sort."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(order, F.col(tie)).offset(number * size).limit(size)


def match_result(matches: DataFrame, candidate_id: int, job_id: int) -> DataFrame:
    """The stored result of one candidate for one job, lists decoded; no row without one."""
    found = matches.where((F.col("candidate_id") == candidate_id) & (F.col("job_id") == job_id))
    return found.withColumns({c: decode_list(F.col(c)) for c in ("strengths", "gaps") if dict(found.dtypes).get(c) == "string"})


def job_requirement(jobs: DataFrame, job_id: int) -> DataFrame:
    """One job; no row without it."""
    return jobs.where(F.col("id") == job_id)


def option_labels(spark: SparkSession) -> DataFrame:
    """kind, place and label of the constant options: ranges of experience and of scores."""
    rows = [("experience", k, x) for k, x in enumerate(L.EXPERIENCE_RANGES)] + [("score", k, x) for k, x in enumerate(L.SCORE_RANGES)]
    return spark.createDataFrame(rows, "kind string, place int, label string")


def _has(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text holds one of the words, case as it is; false for null."""
    held = F.lit(False)
    for w in words:
        held = held | F.coalesce(F.contains(c, F.lit(w)), F.lit(False))
    return held


def _parts(c: Column) -> Column:
    return pieces(F.coalesce(c, F.lit("")), "[、,，]")


def _shown(school: Column, department: Column) -> Column:
    return F.struct(school.alias("school"), department.alias("department"))


def masters_record(education: Column, school: Column, major: Column, masters: tuple[str, ...] = MASTERS) -> Column:
    """School and department to show as master's degree; null without one.

    The first record with such a degree; else the first with such a part in its
    department; else, without any records, that of the candidate's own school
    and major.
    """
    with_degree = F.get(F.filter(education, lambda e: _has(e["degree_level"], masters)), 0)
    part = lambda c: F.get(F.filter(_parts(c), lambda p: _has(p, masters)), 0)
    with_part = F.get(F.filter(education, lambda e: part(e["department"]).isNotNull()), 0)
    own = (F.size(education) == 0) & (F.coalesce(school, F.lit("")) != "") & part(major).isNotNull()
    return (
        F.when(with_degree.isNotNull(), _shown(with_degree["school"], with_degree["department"]))
        .when(with_part.isNotNull(), _shown(with_part["school"], part(with_part["department"])))
        .when(own, _shown(school, part(major)))
    )


def university_record(education: Column, school: Column, major: Column, bachelors: tuple[str, ...] = BACHELORS, masters: tuple[str, ...] = MASTERS) -> Column:
    """School and department to show as first degree; null without one.

    The first record with such a degree, with the first part of its department
    that names no master's degree, or the whole one; else, without any records,
    the candidate's own school with such a part of the major, or with the whole
    of a major that has no parts.
    """
    record = F.get(F.filter(education, lambda e: _has(e["degree_level"], bachelors)), 0)
    part = lambda c: F.get(F.filter(_parts(c), lambda p: ~_has(p, masters)), 0)
    own = (F.size(education) == 0) & (F.coalesce(school, F.lit("")) != "")
    whole = F.coalesce(major, F.lit(""))
    return F.when(record.isNotNull(), _shown(record["school"], F.coalesce(part(record["department"]), record["department"]))).when(
        own & (part(major).isNotNull() | (F.size(_parts(major)) == 0)), _shown(school, F.coalesce(part(major), whole))
    )


def shown_experience(years: Column) -> Column:
    """Years of experience, or the phrase for none."""
    return F.coalesce(F.nullif(years, F.lit("")), F.lit(L.NO_EXPERIENCE))


def shown_attachment(name: Column, kind: Column, word: str = "附件") -> Column:
    """An attachment's label: its name, else its type, else a word."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(kind, F.lit("")), F.lit(word))


def shown_management(text: Column, none: str = "無") -> Column:
    """The tag of management responsibility; null where it is empty or the word for none."""
    return F.when((F.coalesce(text, F.lit("")) != "") & (text != none), text)


def candidate_count(summary: DataFrame) -> DataFrame:
    """How many rows the list has, those of several jobs included."""
    return summary.agg(F.count("*").alias("n"))
