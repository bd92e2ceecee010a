"""Registered queries over the test tables and their DuckDB twins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import labels, schemas
from ..functions import text
from ..functions.text import score_band, score_label
from ..operators import changes, chunks, matching, records, relational, shared, storage, stored
from ..sources import files as readers
from ..streaming import ingest
from . import rendering, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"WITH {tables.CTES} {sql}"
        return function

    return register


def _joined(items: Column, field: str) -> Column:
    return F.coalesce(F.array_join(F.transform(items, lambda x: x[field]), ","), F.lit(""))


@_query(
    """SELECT c.id, c.name, c.nationality, m.job_id, m.overall_score, coalesce(e.schools, '') AS schools FROM candidates c
    LEFT JOIN matches m ON m.candidate_id = c.id
    LEFT JOIN (SELECT candidate_id, string_agg(school, ',' ORDER BY seq, id, school, degree_level, department) AS schools FROM education GROUP BY 1) e ON e.candidate_id = c.id"""
)
def summary_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with match results and their ordered schools."""
    found = relational.candidate_summary(tables.candidates(spark, d), tables.matches(spark, d), tables.education(spark, d))
    return found.select("id", "name", "nationality", "job_id", "overall_score", _joined(F.col("education"), "school").alias("schools"))


@_query(
    """SELECT c.id, c.name, coalesce(w.x, '') AS companies, coalesce(e.x, '') AS departments FROM candidates c
    LEFT JOIN (SELECT candidate_id, string_agg(company_name, ',' ORDER BY seq, id) AS x FROM work GROUP BY 1) w ON w.candidate_id = c.id
    LEFT JOIN (SELECT candidate_id, string_agg(department, ',' ORDER BY seq, id, department) AS x FROM education GROUP BY 1) e ON e.candidate_id = c.id"""
)
def detail_in_bulk(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with their child lists."""
    children = {"work": (tables.work(spark, d), ["company_name"]), "education": (tables.education(spark, d), ["department"])}
    found = relational.candidate_detail(tables.candidates(spark, d), children)
    return found.select("id", "name", _joined(F.col("work"), "company_name").alias("companies"), _joined(F.col("education"), "department").alias("departments"))


@_query("SELECT DISTINCT skill_name FROM skills WHERE coalesce(skill_name, '') <> ''")
def option_skills(spark: SparkSession, d: str) -> DataFrame:
    return relational.filter_options(tables.skills(spark, d), "skill_name")


@_query("SELECT DISTINCT education_level FROM candidates WHERE coalesce(education_level, '') <> ''")
def option_levels(spark: SparkSession, d: str) -> DataFrame:
    return relational.filter_options(tables.candidates(spark, d), "education_level")


@_query(
    """SELECT c.id, c.name, m.job_id, m.overall_score FROM candidates c LEFT JOIN matches m ON m.candidate_id = c.id
    WHERE contains(lower(c.name), '1') AND c.education_level = 'BUILDING' AND c.id % 15 BETWEEN 3 AND 5
    AND m.overall_score >= 40 AND m.overall_score < 60"""
)
def filtered_list(spark: SparkSession, d: str) -> DataFrame:
    """Name, level, experience and score conditions together."""
    listed = tables.candidates(spark, d).join(tables.matches(spark, d).select(F.col("candidate_id").alias("id"), "job_id", "overall_score"), "id", "left")
    found = relational.filter_candidates(listed, name="1", education_level="BUILDING", experience=(3, 5), score="40-59")
    return found.select("id", "name", "job_id", "overall_score")


@_query("SELECT candidate_id FROM skills WHERE skill_name IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1 HAVING count(DISTINCT skill_name) = 3")
def all_of_skills(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_all_skills(tables.skills(spark, d), ["Brand#11", "Brand#12", "Brand#13"])


@_query("SELECT id, name, code FROM candidates ORDER BY name, id LIMIT 50 OFFSET 50")
def sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50, by name; the page size is the feature."""
    return relational.page(tables.candidates(spark, d), "name", 1).select("id", "name", "code")


@_query(
    """SELECT id, CASE WHEN overall_score >= 80 THEN '80+' WHEN overall_score >= 60 THEN '60-79' WHEN overall_score >= 40 THEN '40-59' ELSE '<40' END AS band,
    CAST(CAST(floor(overall_score + 0.5) AS BIGINT) AS VARCHAR) AS label FROM matches"""
)
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("overall_score")
    return tables.matches(spark, d).select("id", score_band(score).alias("band"), score_label(score).alias("label"))


@_query(
    """, old AS (SELECT candidate_id, job_id, min(id) AS id, max_by(overall_score, id) AS overall_score FROM matches WHERE year(created_at) < 1996 GROUP BY 1, 2),
    new AS (SELECT candidate_id, job_id, max(id) AS id, max_by(overall_score, id) AS overall_score FROM matches WHERE year(created_at) >= 1996 GROUP BY 1, 2)
    SELECT coalesce(old.candidate_id, new.candidate_id) AS candidate_id, coalesce(old.job_id, new.job_id) AS job_id,
    coalesce(old.id, new.id) AS id, coalesce(new.overall_score, old.overall_score) AS overall_score
    FROM old FULL JOIN new ON old.candidate_id = new.candidate_id AND old.job_id = new.job_id"""
)
def upserted_matches(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores with later ones put in their place; row ids stay."""
    found = tables.matches(spark, d).select("candidate_id", "job_id", "id", "overall_score", "created_at")
    early = found.where(F.year("created_at") < 1996)
    stored = early.groupBy("candidate_id", "job_id").agg(F.min("id").alias("id"), F.max_by("overall_score", "id").alias("overall_score"))
    later = found.where(F.year("created_at") >= 1996).drop("created_at")
    return changes.upsert(stored, later, ["candidate_id", "job_id"], "id", keep=["id"])


@_query("SELECT id, candidate_id, company_name FROM work WHERE candidate_id NOT IN (SELECT id FROM candidates WHERE education_level = 'BUILDING')")
def children_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = tables.candidates(spark, d).where("education_level = 'BUILDING'").select(F.col("id").alias("candidate_id"))
    return changes.delete_children(tables.work(spark, d), gone).select("id", "candidate_id", "company_name")


@_query(
    """SELECT c.id AS candidate_id, c.name, c.code, c.nationality, coalesce(w.n, 0) AS n_work, coalesce(w.companies, '') AS companies,
    coalesce(w.dates, '') AS dates, coalesce(s.tags, '') AS tags FROM candidates c
    LEFT JOIN (SELECT candidate_id, count(*) AS n, string_agg(company_name, ',' ORDER BY seq) AS companies, string_agg(date_start, ',' ORDER BY seq) AS dates
      FROM work GROUP BY 1) w ON w.candidate_id = c.id
    LEFT JOIN (SELECT candidate_id, string_agg(replace(skill_name, '#', ' '), ',' ORDER BY skill_name) AS tags FROM skills GROUP BY 1) s ON s.candidate_id = c.id"""
)
def parsed_records(spark: SparkSession, d: str) -> DataFrame:
    """Markdown rendered from the tables and read back as nested records."""
    return _parsed(spark, d).select(
        "candidate_id",
        "name",
        "code",
        "nationality",
        F.size("work").cast("long").alias("n_work"),
        _joined(F.col("work"), "company_name").alias("companies"),
        _joined(F.col("work"), "date_start").alias("dates"),
        F.array_join("skill_tags", ",").alias("tags"),
    )


@lru_cache(maxsize=2)
def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the whole record, made once: its many expressions take seconds to build."""
    return records.parse_records(rendering.rendered(spark, d), keep=["candidate_id"])


@_query(
    """SELECT id AS candidate_id, name, code, nationality, education_level, CAST(1950 + id % 50 AS VARCHAR) AS birth_year, CAST(id % 60 AS VARCHAR) AS age,
    years_of_experience, 'photo_' || CAST(id AS VARCHAR) || '.png' AS photo_path, 'Intro of ' || nationality AS self_introduction FROM candidates"""
)
def parse_basic(spark: SparkSession, d: str) -> DataFrame:
    """The basic section in three layouts: table, bold running text, cells with line breaks."""
    columns = ["name", "code", "nationality", "education_level", "birth_year", "age", "years_of_experience", "photo_path", "self_introduction"]
    return _parsed(spark, d).select("candidate_id", *columns)


@_query(
    """SELECT id AS candidate_id, 'user' || code || '@example.org' AS email, '09' || code AS mobile1, nationality || ' Road ' || code AS mailing_address,
    CASE WHEN id % 2 = 0 THEN nationality ELSE '' END AS work_type FROM candidates"""
)
def parse_contact(spark: SparkSession, d: str) -> DataFrame:
    """Contacts from tables and running text; preferences where there is a table of them."""
    return _parsed(spark, d).select("candidate_id", "email", "mobile1", "mailing_address", "work_type")


@_query(
    """SELECT candidate_id, CAST(seq AS INTEGER) AS seq, company_name, date_start, '2000/01/01' AS date_end, '3 years' AS duration, job_category,
    CAST(id AS VARCHAR) AS company_size FROM work"""
)
def parse_work(spark: SparkSession, d: str) -> DataFrame:
    """A row for each work entry, from tables and from lines."""
    columns = ["seq", "company_name", "date_start", "date_end", "duration", "job_category", "company_size"]
    return _parsed(spark, d).select("candidate_id", F.inline("work")).select("candidate_id", *columns)


@_query("SELECT candidate_id, seq, school, department, degree_level, '1990/01/01' AS date_start, '1994/01/01' AS date_end FROM education")
def parse_education(spark: SparkSession, d: str) -> DataFrame:
    columns = ["seq", "school", "department", "degree_level", "date_start", "date_end"]
    return _parsed(spark, d).select("candidate_id", F.inline("education")).select("candidate_id", *columns)


@_query("SELECT candidate_id, replace(skill_name, '#', ' ') AS skill_name FROM skills")
def parse_skills(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("candidate_id", F.explode("skill_tags").alias("skill_name"))


@_query(
    """SELECT id AS candidate_id, CAST(1 AS INTEGER) AS seq, 'File ' || code AS name, 'http://f.example/' || code AS url FROM candidates
    UNION ALL SELECT id, CAST(2 AS INTEGER), 'Second', '' FROM candidates"""
)
def parse_attachments(spark: SparkSession, d: str) -> DataFrame:
    columns = ["seq", "name", "url"]
    return _parsed(spark, d).select("candidate_id", F.inline("attachments")).select("candidate_id", *columns)


@_query("SELECT id AS candidate_id, name, code FROM candidates")
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files of several people each, parsed as a stream of one batch and stored, people split."""
    folder = tables.scratch(spark)
    rendering.rendered(spark, d).select("markdown").write.text(f"{folder}/in")
    ingest.ingest_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", split=True).awaitTermination()
    return storage.stored_table(spark, f"{folder}/out", "candidates").select(F.col("code").cast("long").alias("candidate_id"), "name", "code")


def _stored_sums(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each stored table, and the sums of the ids in them."""
    sums = []
    for name in ("candidates", *storage.CHILD_TABLES, "skills", "rejects"):
        stored = storage.stored_table(spark, path, name)
        of = F.col("id") if name == "candidates" else F.lit(0) if name == "rejects" else F.col("candidate_id")
        sums.append(stored.agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.coalesce(F.sum(of), F.lit(0)).cast("decimal(38,0)").alias("ids")))
    return reduce(DataFrame.unionByName, sums)


_SUMS = """SELECT 'candidates' AS t, count(*) AS n, CAST(sum(id) AS HUGEINT) AS ids FROM kept
    UNION ALL SELECT 'work_experiences', count(*), CAST(sum(k.id) AS HUGEINT) FROM kept k JOIN work w ON w.candidate_id = k.of
    UNION ALL SELECT 'education', count(*), CAST(sum(k.id) AS HUGEINT) FROM kept k JOIN education e ON e.candidate_id = k.of
    UNION ALL SELECT 'skills', count(*), CAST(sum(k.id) AS HUGEINT) FROM kept k JOIN skills s ON s.candidate_id = k.of
    UNION ALL SELECT 'attachments', 2 * count(*), CAST(2 * sum(id) AS HUGEINT) FROM kept
    UNION ALL SELECT 'references_', 0, CAST(0 AS HUGEINT)"""


@_query(
    f""", kept AS (SELECT id AS of, row_number() OVER (ORDER BY id % 2, id) AS id FROM candidates WHERE id % 7 <> 3)
    {_SUMS} UNION ALL SELECT 'rejects', count(*), CAST(0 AS HUGEINT) FROM candidates WHERE id % 7 = 3"""
)
def published_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of documents, some blank, stored one after the other, the second handed over twice: what all tables then hold."""
    folder = tables.scratch(spark)
    blank = F.when(F.pmod("candidate_id", F.lit(7)) == 3, " \n").otherwise(F.col("markdown"))
    files = rendering.rendered(spark, d).select(F.lpad(F.col("candidate_id").cast("string"), 9, "0").alias("path"), blank.alias("text"))
    # Both batches are read from the same files; made of the tables, all documents would be made for each.
    inbox = tables.scratch(spark)
    files.write.option("compression", "zstd").parquet(inbox)
    files = spark.read.schema(files.schema).parquet(inbox)
    odd = F.pmod(F.col("path").cast("long"), F.lit(2))
    for batch, part in (("a", odd == 0), ("b", odd == 1), ("b", F.lit(True))):
        storage.batch_import(files.where(part), folder, split=False, batch=batch)
    return _stored_sums(spark, folder)


def _of_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """The parents' ids of child rows, of those whose parent is stored.

    Ids compress so well that Spark would take all of them for small and gather
    them in the driver, for each table anew.
    """
    return rows.select(F.col("candidate_id").alias("id")).join(people.hint("merge"), "id")


@_query(
    """SELECT 'candidates' AS t, count(*) AS n, count(*) AS parents FROM candidates UNION ALL SELECT 'work_experiences', count(*), count(DISTINCT candidate_id) FROM work
    UNION ALL SELECT 'education', count(*), count(DISTINCT candidate_id) FROM education UNION ALL SELECT 'skills', count(*), count(DISTINCT candidate_id) FROM skills
    UNION ALL SELECT 'attachments', 2 * count(*), count(*) FROM candidates"""
)
def stored_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files taken two at a time by a stream into the stored tables, then by the same stream again: rows of each, and how many parents they have."""
    folder = tables.scratch(spark)
    rendering.rendered(spark, d).select("markdown").repartition(4).write.text(f"{folder}/in")
    for _ in range(2):
        ingest.ingest_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", split=True, files_at_once=2).awaitTermination()
    people = storage.stored_table(spark, f"{folder}/out", "candidates").select("id")
    sums = [people.agg(F.lit("candidates").alias("t"), F.count("*").alias("n"), F.countDistinct("id").alias("parents"))]
    for name in ("work_experiences", "education", "skills", "attachments"):
        rows = _of_people(storage.stored_table(spark, f"{folder}/out", name), people)
        sums.append(rows.agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.countDistinct("id").alias("parents")))
    return reduce(DataFrame.unionByName, sums)


@_query("SELECT id AS candidate_id, '# 基本資料' AS heading, strpos(name, 'C') AS at FROM candidates")
def split_people(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several people, ten customers each, cut into one part for each."""
    people = rendering.rendered(spark, d).select("candidate_id", "markdown", F.floor(F.col("candidate_id") / 10).alias("source"))
    whole = people.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "markdown"))), lambda x: x["markdown"]), "\n").alias("text"))
    parts = records.split_people(whole, keep=["source"])
    code, name = F.regexp_extract("markdown", r"104代碼[：:*| ]+(\d+)", 1), F.regexp_extract("markdown", r"(Customer#\d+)", 1)
    return parts.select(code.cast("long").alias("candidate_id"), F.split("markdown", "\n")[0].alias("heading"), F.locate("C", name).cast("long").alias("at"))


@_query("SELECT o_orderkey AS id, 'h' || o_orderstatus AS name, o_orderpriority AS body FROM orders")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a text with a repeated heading: the last body counts."""
    md = F.concat(F.lit("x\n# h"), "o_orderstatus", F.lit("\nfirst\n## other\ny\n# h"), "o_orderstatus", F.lit("\n"), "o_orderpriority")
    rows = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), md.alias("md"), F.concat(F.lit("h"), "o_orderstatus").alias("name"))
    rows = rows.select("id", "name", text.headings(F.col("md")).alias("n"), text.bodies(F.col("md")).alias("b"))
    parts = text.sections(F.col("n"), F.col("b"))
    return rows.select("id", "name", F.get(F.filter(parts, lambda s: s["name"] == F.col("name")), 0)["body"].alias("body"))


@_query("SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag || '|' || l_linestatus || '|a b' AS cells, l_linestatus AS value FROM lineitem")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a table's rows and the value beside a key, the last of two."""
    body = F.concat(F.lit("|---|---|\n| "), "l_returnflag", F.lit(" | "), "l_linestatus", F.lit(" | a<br>b |\n| k**: | no | k： | "), "l_linestatus", F.lit(" |"))
    rows = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), body.alias("body"))
    rows = rows.select("id", "line", text.table_rows(F.col("body")).alias("rows"))
    return rows.select("id", "line", F.array_join(F.get("rows", 0), "|").alias("cells"), text.value(text.key_values(F.col("rows")), "k").alias("value"))


@_query("SELECT id, company_name AS company, job_category AS category FROM work")
def running_text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Values between known keys in running text; the first of a repeated key counts."""
    line = F.concat(F.lit("![x](y)\n# skipped\n學校**:** "), "company_name", F.lit(" \n科系： "), "job_category", F.lit(" 學校: later"))
    rows = tables.work(spark, d).select("id", text.keys_in_text(text.running_text(line), labels.BASIC_KEYS).alias("kv"))
    return rows.select("id", text.first_value(F.col("kv"), "學校").alias("company"), text.first_value(F.col("kv"), "科系").alias("category"))


@_query(
    """SELECT candidate_id, job_id, id, overall_score FROM matches WHERE candidate_id = 7 AND job_id = 3
    UNION ALL SELECT 0, CAST(k AS BIGINT), k, NULL FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderkey = 3)"""
)
def point_match(spark: SparkSession, d: str) -> DataFrame:
    """One candidate's results for one job, and one row by its id."""
    found = relational.match_result(tables.matches(spark, d), 7, 3).select("candidate_id", "job_id", "id", "overall_score")
    job = relational.job_requirement(tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 3)
    return found.unionByName(job.select(F.lit(0).cast("long").alias("candidate_id"), F.col("id").alias("job_id"), "id", F.lit(None).cast("double").alias("overall_score")))


@_query(
    """SELECT id, y BETWEEN 0 AND 2 AS a, y BETWEEN 3 AND 5 AS b, y BETWEEN 5 AND 10 AS c, y > 10 AS d FROM
    (SELECT id, CAST(regexp_extract(years_of_experience, '([0-9]+)', 1) AS INTEGER) AS y FROM candidates)"""
)
def experience_ranges(spark: SparkSession, d: str) -> DataFrame:
    years = F.col("years_of_experience")
    ranges = zip("abcd", labels.EXPERIENCE_RANGES.values(), strict=True)
    return tables.candidates(spark, d).select("id", *[relational.experience_within(years, *r).alias(n) for n, r in ranges])


@_query(
    """SELECT c.id, m.id AS match_id, coalesce(m.overall_score >= 80, false) AS a, coalesce(m.overall_score >= 60 AND m.overall_score < 80, false) AS b,
    coalesce(m.overall_score >= 40 AND m.overall_score < 60, false) AS c, coalesce(m.overall_score < 40, false) AS d, m.overall_score IS NULL AS e
    FROM candidates c LEFT JOIN matches m ON m.candidate_id = c.id AND m.job_id = 1"""
)
def score_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = tables.matches(spark, d).where("job_id = 1").select(F.col("candidate_id").alias("id"), F.col("id").alias("match_id"), "overall_score")
    rows = tables.candidates(spark, d).select("id").join(found, "id", "left")
    ranges = zip("abcde", labels.SCORE_RANGES, strict=True)
    return rows.select("id", "match_id", *[F.coalesce(relational.score_within(F.col("overall_score"), r), F.lit(False)).alias(n) for n, r in ranges])


@_query(
    """SELECT c.id, c.name FROM candidates c LEFT JOIN (SELECT candidate_id, bool_or(contains(school, '#000000003') OR contains(school, '#000000007')) AS t
    FROM education GROUP BY 1) e ON e.candidate_id = c.id WHERE coalesce(e.t, false) OR contains(c.nationality, 'CHINA')"""
)
def contains_any(spark: SparkSession, d: str) -> DataFrame:
    """Candidates one of whose schools, or whose own, holds one of some names."""
    lists = relational.ordered_children(tables.education(spark, d), ["school"], "education").withColumnRenamed("candidate_id", "id")
    rows = tables.candidates(spark, d).withColumn("school", F.col("nationality")).join(lists, "id", "left")
    rows = rows.withColumn("education", F.coalesce("education", F.expr("array()").cast(lists.schema["education"].dataType)))
    return relational.filter_candidates(rows, schools=["#000000003", "#000000007", "CHINA"]).select("id", "name")


_DEGREES = """degrees AS (SELECT candidate_id, id, seq, school, department || ', ' || degree_level AS department, degree_level AS dl FROM education)"""


@_query(
    f""", {_DEGREES}, first AS (SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY seq, id) AS k, school, department FROM degrees WHERE contains(dl, 'STEEL'))
    SELECT c.id, f.school, f.department FROM candidates c LEFT JOIN first f ON f.candidate_id = c.id AND f.k = 1"""
)
def masters_record(spark: SparkSession, d: str) -> DataFrame:
    """The first record whose degree holds a word, as the master's degree is shown."""
    return _degree_rows(spark, d).select("id", relational.masters_record(F.col("education"), F.lit(None).cast("string"), F.lit(None).cast("string"), ("STEEL",)).alias("r")).select("id", "r.school", "r.department")


@_query(
    f""", {_DEGREES}, first AS (SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY seq, id) AS k, school,
      CASE WHEN contains(split_part(department, ', ', 1), '#1') THEN CASE WHEN contains(dl, '#1') THEN department ELSE dl END ELSE split_part(department, ', ', 1) END AS department
      FROM degrees WHERE contains(dl, 'BRASS'))
    SELECT c.id, f.school, f.department FROM candidates c LEFT JOIN first f ON f.candidate_id = c.id AND f.k = 1"""
)
def university_record(spark: SparkSession, d: str) -> DataFrame:
    """The first record of a degree with the first part of its department that lacks a word."""
    none = F.lit(None).cast("string")
    return _degree_rows(spark, d).select("id", relational.university_record(F.col("education"), none, none, ("BRASS",), ("#1",)).alias("r")).select("id", "r.school", "r.department")


def _degree_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.education(spark, d).withColumn("department", F.concat("department", F.lit(", "), "degree_level"))
    lists = relational.ordered_children(rows, ["school", "department", "degree_level"], "education").withColumnRenamed("candidate_id", "id")
    people = tables.candidates(spark, d).select("id").join(lists, "id", "left")
    return people.withColumn("education", F.coalesce("education", F.expr("array()").cast(lists.schema["education"].dataType)))


@_query(
    """SELECT candidate_id AS id, array_to_string(list_slice(list(skill_name ORDER BY skill_name), 1, 5), ',') AS shown, greatest(count(*) - 5, 0) AS more
    FROM skills GROUP BY 1"""
)
def list_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first five skills, a length that is the feature, and how many are left."""
    lists = tables.skills(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_list("skill_name")).alias("s"))
    shown, more = text.preview(F.col("s"), 5)
    return lists.select(F.col("candidate_id").alias("id"), F.array_join(shown, ",").alias("shown"), more.cast("long").alias("more"))


@_query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN '無工作經驗' ELSE years_of_experience END AS years, CASE WHEN id % 2 = 0 THEN name ELSE nationality END AS label,
    CASE WHEN id % 4 = 0 THEN NULL ELSE education_level END AS tag FROM candidates"""
)
def display_defaults(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda n, c: F.when(F.pmod("id", F.lit(n)) == 0, "").otherwise(F.col(c))
    label = relational.shown_attachment(F.when(F.pmod("id", F.lit(2)) == 0, F.col("name")), F.col("nationality"))
    tag = F.when(F.pmod("id", F.lit(4)) == 0, "無").otherwise(F.col("education_level"))
    return tables.candidates(spark, d).select("id", relational.shown_experience(blank(3, "years_of_experience")).alias("years"), label.alias("label"), relational.shown_management(tag).alias("tag"))


@_query("SELECT count(*) AS n FROM candidates c LEFT JOIN matches m ON m.candidate_id = c.id")
def candidate_count(spark: SparkSession, d: str) -> DataFrame:
    return relational.candidate_count(relational.candidate_summary(tables.candidates(spark, d), tables.matches(spark, d), tables.education(spark, d)))


@_query(
    """, titles AS (SELECT o_orderpriority AS title, min(o_orderkey) AS k FROM orders GROUP BY 1), old AS (SELECT dense_rank() OVER (ORDER BY title) AS id, title FROM titles WHERE title < '3'),
    fresh AS (SELECT t.title FROM titles t UNION SELECT DISTINCT o_orderstatus FROM orders)
    SELECT CAST(id AS BIGINT) AS id, title FROM old UNION ALL
    SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY title) AS BIGINT), title FROM fresh WHERE title NOT IN (SELECT title FROM old)"""
)
def ensured_titles(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by title: known ones stay, new ones follow in order."""
    orders = tables.load(spark, d, "orders")
    titles = orders.select(F.col("o_orderpriority").alias("title")).distinct()
    old = titles.where("title < '3'").select(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("title")).cast("long").alias("id"), "title", F.col("title").alias("source_json"))
    new = titles.unionByName(orders.select(F.col("o_orderstatus").alias("title"))).select("title", F.lit("{}").alias("source_json"))
    return changes.ensure_new(old, new, "title").select("id", "title")


@_query(
    """SELECT c.id, CASE WHEN c.id % 3 = 0 THEN 'new ' || c.name ELSE c.name END AS name, c.nationality, coalesce(w.n, 0) AS n_work, coalesce(w.x, '') AS first_company FROM candidates c LEFT JOIN
    (SELECT candidate_id, count(*) AS n, min(company_name) AS x FROM (SELECT candidate_id, company_name FROM work WHERE candidate_id % 3 <> 0
      UNION ALL SELECT id, 'New ' || code FROM candidates WHERE id % 3 = 0) GROUP BY 1) w ON w.candidate_id = c.id"""
)
def replaced_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A third of the candidates read anew: some columns and all their work rows replaced."""
    people = tables.candidates(spark, d)
    again = people.where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    work = tables.work(spark, d).select("candidate_id", "company_name")
    fresh = again.select(F.col("id").alias("candidate_id"), F.concat(F.lit("New "), "code").alias("company_name"))
    parent, children = changes.replace_candidates(people, {"work": work}, again, {"work": fresh}, ["name"])
    counts = children["work"].groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("company_name").alias("x")).withColumnRenamed("candidate_id", "id")
    return parent.join(counts, "id", "left").select("id", "name", "nationality", F.coalesce("n", F.lit(0)).alias("n_work"), F.coalesce("x", F.lit("")).alias("first_company"))


@_query(
    """, gone AS (SELECT id FROM candidates WHERE id % 4 = 1)
    SELECT 'candidates' AS t, count(*) AS n, sum(id) AS s FROM candidates WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'work', count(*), sum(id) FROM work WHERE candidate_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'matches', count(*), sum(id) FROM matches WHERE candidate_id NOT IN (SELECT id FROM gone)"""
)
def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Candidates deleted with their rows in other tables."""
    people = tables.candidates(spark, d)
    parent, rest = changes.cascade_delete(people.where("id % 4 = 1"), people, {"work": tables.work(spark, d), "matches": tables.matches(spark, d)})
    sums = [t.agg(F.lit(n).alias("t"), F.count("*").alias("n"), F.sum("id").cast("decimal(38,0)").alias("s")) for n, t in {"candidates": parent, **rest}.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


_DAMAGED = """damaged AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN name || '|' WHEN id % 5 = 2 THEN name || ' 英文名字' ELSE name END AS name,
    CASE WHEN id % 3 = 0 THEN '' ELSE code END AS code, name AS right_name, code AS right_code FROM candidates)"""


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with damaged names and codes beside their texts."""
    five, three = F.pmod("candidate_id", F.lit(5)), F.pmod("candidate_id", F.lit(3))
    name = F.when(five == 0, "").when(five == 1, F.concat("name", F.lit("|"))).when(five == 2, F.concat("name", F.lit(" 英文名字"))).otherwise(F.col("name"))
    people = tables.candidates(spark, d).select(F.col("id").alias("candidate_id"), "name", "code").join(rendering.rendered(spark, d), "candidate_id")
    return people.select(F.col("candidate_id").alias("id"), name.alias("name"), F.when(three == 0, "").otherwise(F.col("code")).alias("code"), F.col("markdown").alias("raw_markdown"))


@_query(f", {_DAMAGED} SELECT id FROM damaged WHERE name = '' OR contains(name, '英文名字') OR contains(name, '|') OR code = ''")
def broken_candidates(spark: SparkSession, d: str) -> DataFrame:
    return changes.find_broken(_damaged(spark, d), list(labels.ENGLISH_NAME)).select("id")


@_query(
    f""", {_DAMAGED} SELECT id, 'repaired' AS status, CASE WHEN name <> right_name THEN right_name END AS new_name, CASE WHEN code = '' THEN right_code END AS new_code
    FROM damaged WHERE name <> right_name OR code = ''"""
)
def repaired_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Broken rows read again from their texts, and what changes."""
    report, _ = changes.repair(_damaged(spark, d), list(labels.ENGLISH_NAME))
    return report.select("id", "status", "new_name", "new_code")


@_query(f", {_DAMAGED} SELECT 'repaired' AS status, count(*) FILTER (name <> right_name OR code = '') AS n FROM damaged UNION ALL SELECT 'skip', 0 UNION ALL SELECT 'error', 0 UNION ALL SELECT 'still_empty_name', count(*) FILTER (name = '') FROM damaged")
def repair_counts(spark: SparkSession, d: str) -> DataFrame:
    people = _damaged(spark, d)
    report, _ = changes.repair(people, list(labels.ENGLISH_NAME))
    return changes.repair_summary(report, people)


@_query(
    """SELECT c.id AS candidate_id, CAST(r.r_regionkey AS BIGINT) AS job_id, c.name, r.r_name AS job, c.nationality FROM candidates c JOIN nation n ON n.n_name = c.nationality
    JOIN region r ON r.r_regionkey = n.n_regionkey"""
)
def match_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each candidate and the job of their region, read back."""
    jobs = tables.load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit('{"t":"'), "r_name", F.lit('"}')).alias("source_json"))
    nation = tables.load(spark, d, "nation").select(F.col("n_name").alias("nationality"), F.col("n_regionkey").cast("long").alias("job_id"))
    people = tables.candidates(spark, d)
    wanted = people.join(nation, "nationality").select(F.col("id").alias("candidate_id"), "job_id")
    found = matching.match_requests(people, jobs, wanted)
    part = lambda key: F.regexp_extract("request", rf'"{key}":"([^"]*)"', 1)
    return found.select("candidate_id", "job_id", part("name").alias("name"), part("t").alias("job"), part("nationality").alias("nationality"))


@_query(
    r"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 3996 THEN left(text, 3996) || chr(10) || chr(10) || '[... truncated ...]' ELSE coalesce(text, '') END AS request FROM documents"""
)
def truncated_requests(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut to a model's budget, which is the feature."""
    return matching.extraction_requests(tables.load(spark, d, "documents"), "doc_id", "text")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies made from orders: fenced, plain, broken, and one with a field of another type."""
    body = F.concat(F.lit('{"overall_score": '), (F.col("o_orderkey") % 100).cast("string"), F.lit(', "analysis_text": "'), "o_orderpriority", F.lit('", "gaps": ["a", "'), "o_orderstatus", F.lit('"], "more": 1}'))
    four = F.pmod("o_orderkey", F.lit(4))
    reply = F.when(four == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(four == 1, body).when(four == 2, F.substring(body, 1, 30)).otherwise(F.replace(body, F.lit('["a"'), F.lit("[7")))
    return tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reply.alias("reply"))


@_query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS overall_score, CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority END AS analysis_text,
    CASE WHEN o_orderkey % 4 < 2 THEN 'a,' || o_orderstatus END AS gaps, CASE o_orderkey % 4 WHEN 2 THEN 'json' WHEN 3 THEN 'gaps' END AS fault FROM orders"""
)
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies read as scores; bad ones are rejects with what is wrong."""
    good, bad = matching.parse_match_replies(_replies(spark, d), ["id"])
    good = good.select("id", "overall_score", "analysis_text", F.array_join("gaps", ",").alias("gaps"), F.lit(None).cast("string").alias("fault"))
    none = lambda kind: F.lit(None).cast(kind)
    return good.unionByName(bad.select("id", none("double").alias("overall_score"), none("string").alias("analysis_text"), none("string").alias("gaps"), "fault"))


@_query("SELECT o_orderkey AS id, abs(o_totalprice / 5000 - 50) < 20 AS near FROM orders")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """The overall score that three equal scores should give, against fifty."""
    score = F.col("o_totalprice") / 5000
    return tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.abs(F.round(matching.weighted_overall(score, score, score), 9) - 50) < 20).alias("near"))


@_query(
    """SELECT id, CASE WHEN id % 5 IN (0, 1) THEN name END AS name, CASE WHEN id % 5 IN (0, 1) THEN 'a,' || nationality END AS tags,
    CASE id % 5 WHEN 2 THEN 'name' WHEN 3 THEN 'record' WHEN 4 THEN 'work_experiences' END AS fault FROM candidates"""
)
def imported_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON records, bare and wrapped, with wrong types among them: valid ones and rejects."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    body = F.concat(F.lit('{"name": '), quoted("name"), F.lit(', "skill_tags": ["a", '), quoted("nationality"), F.lit('], "work_experiences": [{"seq": 1, "company_name": "x"}], "unknown": 1}'))
    five = F.pmod("id", F.lit(5))
    raw = (
        F.when(five == 0, body)
        .when(five == 1, F.concat(F.lit('{"extract": '), body, F.lit("}")))
        .when(five == 2, F.concat(F.lit('{"name": '), F.col("id").cast("string"), F.lit("}")))
        .when(five == 3, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.lit('{"work_experiences": [{"seq": "one"}]}'))
    )
    rows = tables.candidates(spark, d).select("id", raw.alias("raw"))
    good, bad = storage.import_records(rows, keep=["id"])
    none = F.lit(None).cast("string")
    return good.select("id", "name", F.array_join("skill_tags", ",").alias("tags"), none.alias("fault")).unionByName(bad.select("id", none.alias("name"), none.alias("tags"), "fault"))


_LINES = """lines AS (SELECT l_orderkey AS doc_id, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS n FROM lineitem)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = shared.spread_by(tables.load(spark, d, "lineitem"), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("doc_id"), "l_returnflag", "l_linestatus", F.row_number().over(order).alias("n"))


@_query(
    f""", {_LINES} SELECT doc_id, CASE WHEN n % 2 = 1 THEN 'page' || CAST(doc_id % 3 AS VARCHAR) || '-' || CAST((n + 1) // 2 AS VARCHAR) ELSE 's' || CAST(n AS VARCHAR) END AS name,
    l_returnflag || ' text' AS content FROM lines UNION ALL SELECT DISTINCT doc_id, 'header', 'Head' FROM lines"""
)
def ordered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with marks of pages and places, cut into named chunks."""
    odd = F.pmod("n", F.lit(2)) == 1
    mark = F.when(odd, F.concat(F.lit("page"), F.pmod("doc_id", F.lit(3)).cast("string"))).otherwise(F.concat(F.lit("s"), F.col("n").cast("string")))
    line = F.concat(F.lit('<span id="'), mark, F.lit('"></span>'), "l_returnflag", F.lit(" text\n"))
    texts = _lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))).alias("x"))
    whole = texts.select("doc_id", F.concat(F.lit("Head\n"), F.array_join(F.transform("x", lambda x: x["x"]), "")).alias("text"))
    return chunks.ordered_chunks(whole).select("doc_id", "name", "content")


@_query(f""", {_LINES} SELECT doc_id, CAST(n AS INTEGER) AS chunk, 'h2_' || l_returnflag AS name, '## ' || l_returnflag || chr(10) || chr(10) || l_linestatus AS content FROM lines""")
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs under headings, one chunk for each heading."""
    items = F.array(F.struct(F.lit("Heading 2").alias("style"), F.col("l_returnflag").alias("text")), F.struct(F.lit("Normal").alias("style"), F.col("l_linestatus").alias("text")))
    rows = _lines(spark, d).select("doc_id", "n", F.posexplode(items).alias("k", "p"))
    paragraphs = rows.select("doc_id", (F.col("n") * 2 + F.col("k")).alias("pos"), "p.style", "p.text", F.lit(None).cast("string").alias("image"))
    return chunks.heading_chunks(paragraphs).select("doc_id", "chunk", "name", "content")


@_query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/out/a/' WHEN 1 THEN '/out/' WHEN 2 THEN '/output/else/' ELSE '/output/' END || 'p' || CAST(page_id AS VARCHAR) || '.png' AS photo_url FROM pages"""
)
def resolved_photos(spark: SparkSession, d: str) -> DataFrame:
    """Photos found in the text's folder, its parent, anywhere, or not at all."""
    pages = tables.load(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("photo_path"), F.lit("out/a/t.md").alias("source_md_path"))
    four = F.pmod("page_id", F.lit(4))
    folder = F.when(four == 0, "out/a/").when(four == 1, "out/").when(four == 2, "output/else/")
    listing = pages.select(F.concat(folder, "photo_path").alias("path")).where("path is not null")
    return storage.resolve_photo(pages, listing).select("page_id", "photo_url")


@_query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'data/f' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.docx' ELSE '.pdf' END ELSE '' END AS source FROM pages"""
)
def guessed_sources(spark: SparkSession, d: str) -> DataFrame:
    """The source file beside each text, the first by name."""
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"))
    pages = tables.load(spark, d, "pages").select("page_id", F.concat(F.lit("out/"), name, F.lit("_original.md")).alias("path"))
    endings = F.when(F.pmod("page_id", F.lit(3)) == 0, F.array(F.lit(".pdf"), F.lit(".docx"))).otherwise(F.array(F.lit(".pdf")))
    files = tables.load(spark, d, "pages").where("page_id % 2 = 0").select(F.explode(endings).alias("e"), name.alias("n")).select(F.concat(F.lit("data/"), "n", "e").alias("path"))
    return storage.guess_source(pages, files).select("page_id", F.col("source_pdf_path").alias("source"))


@_query("SELECT 'ok' AS status, count(*) AS n, CAST(count(*) * (count(*) + 1) // 2 AS HUGEINT) AS ids, (SELECT count(*) FROM work) AS n_work FROM candidates")
def batch_imported(spark: SparkSession, d: str) -> DataFrame:
    """Documents of ten people each, split, parsed and stored; what the stored tables then hold."""
    folder = tables.scratch(spark)
    people = rendering.rendered(spark, d).select("candidate_id", "markdown", F.floor(F.col("candidate_id") / 10).cast("string").alias("path"))
    files = people.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "markdown"))), lambda x: x["markdown"]), "\n").alias("text"))
    counts = storage.batch_import(files, folder)
    stored, work = storage.stored_table(spark, folder, "candidates"), storage.stored_table(spark, folder, "work_experiences")
    ids = stored.agg(F.sum("id").cast("decimal(38,0)").alias("ids"))
    return counts.join(F.broadcast(ids)).join(F.broadcast(work.agg(F.count("*").alias("n_work"))))


@_query(
    """, old AS (SELECT candidate_id, job_id, min(id) AS id, max_by(overall_score, id) AS overall_score FROM matches WHERE year(created_at) < 1996 GROUP BY 1, 2),
    new AS (SELECT candidate_id, job_id, max(id) AS id, max_by(overall_score, id) AS overall_score FROM matches WHERE year(created_at) >= 1996 GROUP BY 1, 2)
    SELECT coalesce(old.candidate_id, new.candidate_id) AS candidate_id, coalesce(old.job_id, new.job_id) AS job_id,
    coalesce(old.id, new.id) AS id, coalesce(new.overall_score, old.overall_score) AS overall_score
    FROM old FULL JOIN new ON old.candidate_id = new.candidate_id AND old.job_id = new.job_id"""
)
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Scores stored in slices by candidate and job, then later ones put in their place where they lie."""
    folder, found = tables.scratch(spark), tables.matches(spark, d).select("candidate_id", "job_id", "id", "overall_score", "created_at")
    early = found.where(F.year("created_at") < 1996).groupBy("candidate_id", "job_id").agg(F.min("id").alias("id"), F.max_by("overall_score", "id").alias("overall_score"))
    table = stored.Table(f"matches_{uuid.uuid4().hex}", f"{folder}/matches", ("candidate_id", "job_id"), 16)
    stored.create(early, table)
    stored.stored_upsert(table, found.where(F.year("created_at") >= 1996).drop("created_at"), "id", f"{folder}/log", "later", ["id"])
    return stored.read(spark, table)


def _sliced(spark: SparkSession, d: str, slices: int = 16) -> tuple[str, dict[str, stored.Table]]:
    """Candidates, work and skills stored in slices by candidate."""
    folder, mark = tables.scratch(spark), uuid.uuid4().hex
    rows = {"candidates": tables.candidates(spark, d), "work": tables.work(spark, d), "skills": tables.skills(spark, d)}
    made = {n: stored.Table(f"{n}_{mark}", f"{folder}/{n}", ("id" if n == "candidates" else "candidate_id",), slices) for n in rows}
    for n, table in made.items():
        stored.create(rows[n], table)
    return folder, made


@_query(
    """SELECT c.id, CASE WHEN c.id % 3 = 0 THEN 'new ' || c.name ELSE c.name END AS name, coalesce(w.n, 0) AS n_work, coalesce(w.x, '') AS first_company, coalesce(s.n, 0) AS n_skills FROM candidates c LEFT JOIN
    (SELECT candidate_id, count(*) AS n, min(company_name) AS x FROM (SELECT candidate_id, company_name FROM work WHERE candidate_id % 3 <> 0
      UNION ALL SELECT id, 'New ' || code FROM candidates WHERE id % 3 = 0) GROUP BY 1) w ON w.candidate_id = c.id
    LEFT JOIN (SELECT candidate_id, count(*) AS n FROM skills WHERE candidate_id % 3 <> 0 GROUP BY 1) s ON s.candidate_id = c.id"""
)
def stored_replace(spark: SparkSession, d: str) -> DataFrame:
    """A third of the stored candidates read anew: names and work replaced, skills gone; then all tables joined by id."""
    folder, made = _sliced(spark, d)
    again = tables.candidates(spark, d).where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    work = tables.work(spark, d)
    row = {"candidate_id": F.col("id"), "company_name": F.concat(F.lit("New "), "code")}
    fresh = again.select(*[(row.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in work.schema])
    stored.stored_replace(made, again, {"work": fresh}, ["name"], f"{folder}/log", "third")
    n = lambda name, *more: stored.read(spark, made[name]).groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias(f"n_{name}"), *more)
    found = stored.read(spark, made["candidates"]).join(n("work", F.min("company_name").alias("x")), "id", "left").join(n("skills"), "id", "left")
    return found.select("id", "name", F.coalesce("n_work", F.lit(0)).alias("n_work"), F.coalesce("x", F.lit("")).alias("first_company"), F.coalesce("n_skills", F.lit(0)).alias("n_skills"))


@_query(
    """SELECT c.id, c.name, coalesce(w.x, '') AS companies, coalesce(s.n, 0) AS n_skills FROM candidates c
    LEFT JOIN (SELECT candidate_id, string_agg(company_name, ',' ORDER BY seq, id) AS x FROM work GROUP BY 1) w ON w.candidate_id = c.id
    LEFT JOIN (SELECT candidate_id, count(*) AS n FROM skills GROUP BY 1) s ON s.candidate_id = c.id WHERE c.id IN (1, 38, 75, 112, 100000000)"""
)
def point_detail(spark: SparkSession, d: str) -> DataFrame:
    """Details of five ids from tables stored in slices, which is the feature: other slices and row groups are left out."""
    _, made = _sliced(spark, d)
    ids = [1, 38, 75, 112, 100_000_000]
    found = stored.stored_detail(spark, made, ids, {"work": ["company_name"]})
    skills = reduce(DataFrame.unionByName, [stored.lookup(spark, made["skills"], i) for i in ids]).groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("n_skills"))
    return found.join(skills, "id", "left").select("id", "name", _joined(F.col("work"), "company_name").alias("companies"), F.coalesce("n_skills", F.lit(0)).alias("n_skills"))


@_query(
    """, parts AS (SELECT id, name, id // 50 AS file, row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS index FROM candidates)
    SELECT CAST(file AS VARCHAR) AS file, CAST(index AS INTEGER) AS index, name, CAST(NULL AS VARCHAR) AS reason FROM parts WHERE file % 4 < 2 OR (file % 4 = 2 AND index = 0)
    UNION ALL SELECT DISTINCT CAST(file AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CASE WHEN file % 8 = 3 THEN 'no JSON' ELSE 'neither an object nor an array' END FROM parts WHERE file % 4 = 3"""
)
def mixed_json_roots(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files whose root is an array, an object with candidates, one object, a text, or broken: every record and every reject."""
    folder = tables.scratch(spark)
    one = F.concat(F.lit('{"name": "'), "name", F.lit('", "more": [1, {"a": null}]}'))
    people = tables.candidates(spark, d).select("id", F.floor(F.col("id") / 50).alias("file"), one.alias("one"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", "one"))), lambda x: x["one"])
    files = people.groupBy("file").agg(items.alias("items"))
    kind, listed = F.pmod("file", F.lit(4)), F.concat(F.lit("["), F.array_join("items", ",\n"), F.lit("]"))
    text = F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit('{"candidates": '), listed, F.lit("}"))).when(kind == 2, F.get("items", 0))
    text = text.otherwise(F.when(F.pmod("file", F.lit(8)) == 3, F.concat(F.lit("["), F.array_join("items", ","))).otherwise(F.lit('"text"')))
    files.select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(f"{folder}/in")
    found = readers.read_records_json(spark, f"{folder}/in", "PERMISSIVE", "*.txt")
    file = F.regexp_extract("path", "file=([0-9]+)/", 1).alias("file")
    good = found.records.select(file, F.col("index").cast("int").alias("index"), F.get_json_object("raw", "$.name").alias("name"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(found.rejects.select(file, F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("name"), "reason"))


@_query(
    """, numbered AS (SELECT o_orderkey AS id, o_orderkey % 8 AS file, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS line FROM orders)
    SELECT CAST(file AS VARCHAR) AS file, line, CASE WHEN id % 5 = 3 THEN NULL ELSE id END AS id, CASE WHEN id % 5 = 3 THEN '{"id": ' || CAST(id AS VARCHAR) END AS bad FROM numbered WHERE id % 5 <> 4"""
)
def bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines in eight files with bad and blank ones among them: records and rejects with their numbers in the file."""
    folder, five = tables.scratch(spark), F.pmod("o_orderkey", F.lit(5))
    line = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"))
    line = F.when(five == 3, line).when(five == 4, " ").otherwise(F.concat(line, F.lit("}")))
    rows = tables.load(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(8)).alias("file"), line.alias("value"))
    rows.repartition(8, "file").sortWithinPartitions("file", "o_orderkey").select("file", "value").write.partitionBy("file").text(f"{folder}/in")
    found = readers.read_records_jsonl(spark, f"{folder}/in", "PERMISSIVE")
    file = F.regexp_extract("path", "file=([0-9]+)/", 1).alias("file")
    good = found.records.select(file, "line", F.get_json_object("raw", "$.id").cast("long").alias("id"), F.lit(None).cast("string").alias("bad"))
    return good.unionByName(found.rejects.select(file, "line", F.lit(None).cast("long").alias("id"), F.col("text").alias("bad")))


def _model(asked):
    """Scores by the customer's number; some requests are refused, to some there is no proper answer."""
    numbers = [int(re.search(r"Customer#(\d+)", request)[1]) for request in asked]
    if any(n % 11 == 0 for n in numbers):
        raise ValueError("refused")
    return ["no answer" if n % 13 == 0 else '{"overall_score": %d}' % (n % 100) for n in numbers]


@_query(
    """SELECT id AS candidate_id, CASE WHEN id % 11 > 0 AND id % 13 > 0 THEN CAST(id % 100 AS DOUBLE) END AS overall_score,
    CASE WHEN id % 11 = 0 THEN 'request: ValueError: refused' WHEN id % 13 = 0 THEN 'reply: json' END AS failed FROM candidates"""
)
def resumed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of half the requests stored, then of all: the second run asks for the others and for what failed."""
    folder, people = tables.scratch(spark), tables.candidates(spark, d)
    jobs = spark.range(1).select("id", F.lit("{}").alias("source_json"))
    requests = matching.match_requests(people, jobs, people.select(F.col("id").alias("candidate_id"), F.lit(0).cast("long").alias("job_id")))
    matching.score_missing(requests.where("candidate_id % 2 = 0"), _model, folder, slices=2)
    scores, rejects = matching.score_missing(requests, _model, folder, slices=2)
    good = scores.select("candidate_id", "overall_score", F.lit(None).cast("string").alias("failed"))
    return good.unionByName(rejects.select("candidate_id", F.lit(None).cast("double").alias("overall_score"), F.concat("stage", F.lit(": "), "reason").alias("failed")))


@_query(
    """, good AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM candidates WHERE id % 5 <> 2)
    SELECT id, k AS stored_id, CASE WHEN id % 5 IN (0, 1) THEN CAST(id % 90 AS DOUBLE) END AS overall_score, CASE WHEN id % 5 = 3 THEN 'match.gaps' END AS fault FROM good
    UNION ALL SELECT id, NULL, NULL, 'name' FROM candidates WHERE id % 5 = 2"""
)
def imported_scores(spark: SparkSession, d: str) -> DataFrame:
    """Records with good, bad and no scores imported into the stored tables; ids, scores and rejects from there."""
    folder, five = tables.scratch(spark), F.pmod("id", F.lit(5))
    number = F.col("id").cast("string")
    score = F.concat(F.lit(', "match": {"overall_score": '), F.pmod("id", F.lit(90)).cast("string"), F.when(five == 3, ', "gaps": 7}').otherwise(', "gaps": ["g"]}'))
    name = F.when(five == 2, number).otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
    raw = F.concat(F.lit('{"code_104": "'), number, F.lit('", "name": '), name, F.when(five < 4, score).otherwise(""), F.lit("}"))
    rows = tables.candidates(spark, d).select(F.lpad(number, 9, "0").alias("path"), F.lit(0).alias("index"), raw.alias("raw"))
    storage.import_with_scores(rows, folder)
    read = lambda name: storage.stored_table(spark, folder, name)
    scores = read("match_results").join(read("job_requirements").where("title = 'Imported Job Requirement'").select(F.col("id").alias("job_id")), "job_id").select("candidate_id", "overall_score")
    faults = read("rejects").select(F.col("source").cast("long").alias("id"), F.col("reason").alias("fault"))
    people = read("candidates").select(F.col("code").cast("long").alias("id"), F.col("id").alias("candidate_id")).join(scores, "candidate_id", "left").withColumnRenamed("candidate_id", "stored_id")
    return people.join(faults, "id", "full").select("id", "stored_id", "overall_score", "fault")


@_query(
    """, gone AS (SELECT id FROM candidates WHERE id % 4 = 1), people AS (SELECT id FROM candidates WHERE id % 4 <> 1)
    SELECT 'candidates' AS t, count(*) AS n FROM people UNION ALL SELECT 'work_experiences', count(*) FROM work WHERE candidate_id % 4 <> 1
    UNION ALL SELECT 'education', count(*) FROM education WHERE candidate_id % 4 <> 1 UNION ALL SELECT 'skills', count(*) FROM skills WHERE candidate_id % 4 <> 1
    UNION ALL SELECT 'references_', count(*) FROM people UNION ALL SELECT 'attachments', 2 * count(*) FROM people
    UNION ALL SELECT 'match_results', count(*) FROM matches WHERE candidate_id % 4 <> 1"""
)
def all_tables_cascaded(spark: SparkSession, d: str) -> DataFrame:
    """Candidates deleted with their rows in all six tables that refer to them."""
    people, one = tables.candidates(spark, d), lambda n: F.explode(F.array_repeat(F.lit("x"), n))
    children = {
        "work_experiences": tables.work(spark, d), "education": tables.education(spark, d), "skills": tables.skills(spark, d), "match_results": tables.matches(spark, d),
        "references_": people.select(F.col("id").alias("candidate_id"), one(1).alias("ref_name")), "attachments": people.select(F.col("id").alias("candidate_id"), one(2).alias("name")),
    }
    parent, rest = changes.cascade_delete(people.where("id % 4 = 1"), people, children)
    return reduce(DataFrame.unionByName, [t.agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n, t in {"candidates": parent, **rest}.items()])


@_query(
    """SELECT CAST(id // 10 AS VARCHAR) AS source, CASE WHEN id % 3 = 1 THEN 'candidate_' || CAST(k AS VARCHAR) ELSE name || CASE WHEN id % 3 = 0 THEN ' ♂' ELSE '' END END AS log_name,
    'candidate_' || CAST(k AS VARCHAR) || '_' || CASE WHEN id % 3 = 1 THEN 'candidate_' || CAST(k AS VARCHAR) ELSE replace(name, '#', '') END AS folder, code
    FROM (SELECT *, row_number() OVER (PARTITION BY id // 10 ORDER BY id) AS k FROM candidates)"""
)
def stored_parts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of ten people each, split, each part stored by its source under a safe name, and read back."""
    folder = tables.scratch(spark)
    people = rendering.rendered(spark, d).select("candidate_id", F.regexp_replace("markdown", "姓名： ", "姓名: ").alias("m"), F.floor(F.col("candidate_id") / 10).cast("string").alias("source"))
    odd = F.when(F.pmod("candidate_id", F.lit(3)) == 2, F.concat(F.lit("# 基本資料\n| 姓/名: | Customer#"), F.lpad(F.col("candidate_id").cast("string"), 9, "0"), F.lit(" |\n"), F.regexp_replace("m", "# 基本資料", "x")))
    odd = odd.when(F.pmod("candidate_id", F.lit(3)) == 0, F.regexp_replace("m", r"\| 姓名: \|", "| 姓/名: |")).otherwise(F.col("m"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", odd.alias("x")))), lambda x: x["x"]), "\n")
    storage.write_split_documents(records.split_people(people.groupBy("source").agg(text.alias("text")), keep=["source"]), f"{folder}/parts")
    code = F.regexp_extract("markdown", r"104代碼[：:*| ]+(\d+)", 1)
    return spark.read.parquet(f"{folder}/parts").select(F.col("source").cast("string").alias("source"), "log_name", "folder", code.alias("code"))


@_query(
    """SELECT 'ok' AS status, count(*) AS n FROM candidates WHERE id % 7 NOT IN (3, 4) UNION ALL SELECT 'failed', count(*) FROM candidates WHERE id % 7 = 3
    UNION ALL SELECT 'empty', count(*) FROM candidates WHERE id % 7 = 4"""
)
def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed and counted by status, nothing written."""
    seven = F.pmod("candidate_id", F.lit(7))
    files = rendering.rendered(spark, d).select(F.col("candidate_id").cast("string").alias("path"), F.when(seven == 3, "\n").when(seven == 4, "nothing here").otherwise(F.col("markdown")).alias("text"))
    return storage.batch_import(files, None, split=False, dry_run=True)


@_query(
    """SELECT id, CASE WHEN id % 5 IN (0, 1) THEN name ELSE 'old' END AS name, CASE WHEN id % 5 IN (0, 1) THEN nationality ELSE 'old' END AS nationality, CASE id % 5 WHEN 2 THEN 'no text' END AS reason FROM candidates
    UNION ALL SELECT -1, NULL, NULL, 'missing'"""
)
def reparsed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows read again from their texts and put in their place; ids without a row or a text are rejects."""
    five = F.pmod("id", F.lit(5))
    stale = rendering.rendered(spark, d).select(F.col("candidate_id").alias("id"), F.lit("old").alias("name"), F.lit("old").alias("nationality"), F.col("markdown").alias("raw_markdown"))
    stale = stale.withColumn("raw_markdown", F.when(five == 2, "").otherwise(F.col("raw_markdown")))
    asked = stale.where(five < 3).select("id").unionByName(spark.range(1).select((F.col("id") - 1).alias("id")))
    again, rejects = changes.reparse(stale, asked)
    parent, _ = changes.replace_candidates(stale, {}, again, {}, ["name", "nationality"])
    return parent.join(rejects, "id", "full").select("id", "name", "nationality", "reason")


@_query("SELECT id, name, CAST(NULL AS VARCHAR) AS nationality FROM candidates WHERE id % 2 = 0 UNION ALL SELECT id, name, nationality FROM candidates WHERE id % 2 = 1")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """Files written before a column was declared and after it, in another order of columns, read as one table."""
    folder, people = tables.scratch(spark), tables.candidates(spark, d)
    people.where("id % 2 = 0").select("name", "id").write.parquet(f"{folder}/old")
    people.where("id % 2 = 1").select("nationality", "id", "code", "name").write.parquet(f"{folder}/new")
    declared = people.select("id", "name", "nationality").schema
    return schemas.checked(spark, [f"{folder}/old", f"{folder}/new"], declared)


@_query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'AA,B b' ELSE '' END AS categories, nationality || CASE WHEN id % 3 = 0 THEN ',Second' ELSE '' END AS locations, 'Dev,Lead of ' || code AS positions,
    'https://www.linkedin.com/in/x_' || code AS link FROM candidates"""
)
def parse_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists and links of the basic section: categories beside their key, places, positions, a profile link with marks of escape."""
    c = F.col
    second = F.when(F.pmod("id", F.lit(3)) == 0, "、Second").otherwise("")
    wanted = F.when(F.pmod("id", F.lit(2)) == 0, F.lit("| 希望職務類別： | AA、B b、C | x |\n")).otherwise("")
    md = F.concat(
        F.lit("# 基本資料\n| 姓名： | "), "name", F.lit(" |\n"), wanted, F.lit("| 希望⼯作地點： | "), "nationality", second, F.lit(" |\n| 理想職務： | Dev  Lead of "), "code",
        F.lit(" |\nLinkedIn: [https://www.linkedin.com/in/x\\_"), "code", F.lit("](y)\n"),
    )
    people = tables.candidates(spark, d).select("id", md.alias("markdown"))
    found = records.parse_records(people, keep=["id"])
    return found.select("id", *[F.array_join(n, ",").alias(a) for n, a in (("desired_job_categories", "categories"), ("desired_locations", "locations"), ("ideal_positions", "positions"))], c("linkedin_url").alias("link"))


@_query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a"b,' || o_orderstatus END AS items FROM orders"""
)
def filled_records(spark: SparkSession, d: str) -> DataFrame:
    """Lists stored as JSON text and nulls, read back as records: lists decoded, nulls empty."""
    lists = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.when(F.pmod("o_orderkey", F.lit(8)) == 0, "")).otherwise(text.encode_list(F.array(F.lit('a"b'), "o_orderstatus")))
    rows = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.col("o_orderpriority")).alias("note"), lists.alias("items"))
    found = records.imported(rows, ["items"])
    return found.select("id", "note", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


@_query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN name END AS m_school, CASE WHEN id % 4 = 0 THEN 'MBA ' || code WHEN id % 4 = 2 THEN '研究所' END AS m_department,
    CASE WHEN id % 3 > 0 THEN name END AS b_school, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 4 = 0 THEN 'Law' WHEN id % 4 = 2 THEN 'Art' WHEN id % 4 = 1 THEN 'Design' ELSE '' END AS b_department FROM
    (SELECT id, code, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS b, name FROM candidates)"""
)
def own_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees from departments and from candidates' own majors, where no record has one."""
    c, four, three = F.col, F.pmod("id", F.lit(4)), F.pmod("id", F.lit(3))
    major = F.when(four == 0, F.concat(F.lit("Law、MBA "), "code")).when(four == 2, "Art，研究所").when(four == 1, "Design").otherwise("")
    record = F.struct(F.lit("s").alias("school"), F.lit("x, MBA").alias("department"), F.lit("").alias("degree_level"))
    people = tables.candidates(spark, d).withColumn("major", major)
    people = people.withColumn("education", F.when(F.lit(False), F.array(record)).otherwise(F.filter(F.array(record), lambda x: F.lit(False))))
    school = F.when(three != 0, c("name"))
    found = people.select("id", relational.masters_record(c("education"), c("name"), c("major")).alias("m"), relational.university_record(c("education"), school, c("major")).alias("b"))
    return found.select("id", c("m.school").alias("m_school"), c("m.department").alias("m_department"), c("b.school").alias("b_school"), c("b.department").alias("b_department"))
