"""Candidate tables made from the test tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import shared_folder as scratch  # noqa: F401


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return load(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("nationality"),
        F.col("c_mktsegment").alias("education_level"),
        F.col("c_custkey").cast("string").alias("code"),
        F.concat(F.pmod("c_custkey", F.lit(15)).cast("string"), F.lit(" years")).alias("years_of_experience"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("candidate_id"),
        F.pmod("o_orderkey", F.lit(5)).alias("job_id"),
        F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("overall_score"),
        F.col("o_orderdate").alias("created_at"),
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("candidate_id"),
        seq.alias("seq"),
        F.concat(F.lit("Company "), F.col("o_orderkey").cast("string")).alias("company_name"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("date_start"),
        F.col("o_orderpriority").alias("job_category"),
    )


def education(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("known").drop("known")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as rows of ``education``, those of an unknown school included: their department is a skill all the same."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("candidate_id"))
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("school"), F.lit(True).alias("known"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("degree_level"), F.col("p_brand").alias("department"))
    found = load(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(supplier, "l_suppkey", "left").join(part, "l_partkey")
    return found.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "candidate_id", F.col("l_linenumber").alias("seq"), "school", "degree_level", "department", "known"
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("candidate_id"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("skill_name"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(part, "l_partkey")
    return lines.select("candidate_id", "skill_name").distinct()


CTES = """
candidates AS (SELECT c_custkey AS id, c_name AS name, n_name AS nationality, c_mktsegment AS education_level,
  CAST(c_custkey AS VARCHAR) AS code, CAST(c_custkey % 15 AS VARCHAR) || ' years' AS years_of_experience
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
matches AS (SELECT o_orderkey AS id, o_custkey AS candidate_id, o_orderkey % 5 AS job_id,
  least(100.0::DOUBLE, o_totalprice / 5000) AS overall_score, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'P'),
work AS (SELECT o_orderkey AS id, o_custkey AS candidate_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  'Company ' || CAST(o_orderkey AS VARCHAR) AS company_name, strftime(o_orderdate, '%Y/%m/%d') AS date_start,
  o_orderpriority AS job_category FROM orders),
education AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS candidate_id, l_linenumber AS seq, s_name AS school,
  p_type AS degree_level, p_brand AS department FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
skills AS (SELECT DISTINCT o_custkey AS candidate_id, p_brand AS skill_name FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""
