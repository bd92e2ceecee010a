"""Work that is done once, and grows with its input alone."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import changes, chunks, matching, published, records, storage
from dossier.sources import files


def test_running_text_is_cut_once_for_all_its_keys(spark):
    def seconds(n):
        df = spark.createDataFrame([("國籍: Peru 年齡: 7 " * n,)], "t string")
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            found = df.select(text.keys_in_text(F.col("t"), ("國籍", "年齡")).alias("kv")).first()["kv"]
            best = min(best, time.perf_counter() - start)
        assert len(found) == 2 * n and found[-1] == ("年齡", "7")
        return best

    small, large = seconds(500), seconds(8000)
    assert large < 40 * small  # 16 times the keys; the square would be 256 times


def test_lines_with_and_without_other_ends(spark):
    texts = ["", "a", "a\nb\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\nj"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(text.lines(F.col("t")).alias("new"), F.split("t", text.LINE_ENDS).alias("old")).collect()
    assert all(r["new"] == r["old"] for r in rows)


def test_people_of_a_file_read_in_splits(spark, tmp_path):
    h = "# 基本資料"
    texts = {
        "a": f"{h}\nx\n\n## {h[2:]}\ny\n" * 30, "b": f"  pre \r\n{h}\r\n{h}\nz ", "c": f"\n \n{h} \n{h}\n", "d": "no heading\nat all\n",
        "e": " \n\n", "f": "\n", "g": f"####### {h[2:]}\n###### {h[2:]}\n　q　\n", "h": f"\n\n{h}", "i": " ",
    }
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    read = lambda **how: spark.read.text(str(tmp_path), **how)
    path = F.col("_metadata.file_path").alias("path")
    whole = records.split_people(read(wholetext=True).select(path, F.col("value").alias("text")), keep=["path"])
    expected = {(r["path"], r["part"], r["markdown"]) for r in whole.collect()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in ("7", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            lines = read(lineSep="\n").select(path, F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
            found = [tuple(r) for r in files.people_in_lines(lines, h[2:]).select("path", "part", "markdown").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert len(found) == len(expected) and set(found) == expected


def test_a_record_is_parsed_once_for_all_its_fields(spark):
    df = spark.createDataFrame([(1, '{"name": "a", "skill_tags": ["x"], "age": 3}'), (2, '{"name": "b"}')], "id int, raw string")
    good, bad = storage.import_records(df, keep=["id"])
    assert [r["id"] for r in good.collect()] == [2] and [tuple(r)[::2] for r in bad.collect()] == [(1, "age")]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") < 20  # before: for each of 37 fields, in the filter again


def test_rows_are_made_once_before_they_are_placed(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(100).select(F.col("id").alias("k"), counted(F.col("id").cast("int")).alias("x"))
    placed = published.ranged(rows, str(tmp_path / "staged"), ["k"])
    assert [r["x"] for r in published.numbered_from(placed, 0).orderBy("id").collect()] == list(range(100))
    assert made.value == 100


def test_files_of_parts_do_not_grow_with_their_sources(spark, tmp_path):
    parts = spark.createDataFrame([(f"s{k}", j, f"# 基本資料\n| 姓/名:| n{k}{j} |") for k in range(40) for j in range(2)], "source string, part int, markdown string")
    storage.write_split_documents(parts, str(tmp_path / "parts"))
    storage.write_split_documents(parts.limit(1), str(tmp_path / "parts"))
    assert len(list(Path(tmp_path / "parts").rglob("*.parquet"))) <= 8
    found = spark.read.parquet(str(tmp_path / "parts"))
    assert found.count() == 81 and found.where("source = 's7' and part = 1").first()["log_name"] == "n71"
    assert found.select("source", F.input_file_name()).distinct().groupBy("source").count().where("count > 2").isEmpty()


def test_children_are_read_of_nameless_texts_alone(spark):
    work = "## 工作經驗\n| A , 2000/01/01 ~ 2001/01/01 (1 year) |\n| 職務類別： | x |\n"
    texts = ["# 基本資料\n| 姓名： | Ann |\n" + work, "# 基本資料\n" + work, "nothing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, markdown string")
    found = records.childless(df, keep=["id", "markdown"]).orderBy("id").collect()
    assert [(r["name"], r["code"], r["_bare"]) for r in found] == [("Ann", "", False), ("", "", False), ("", "", True), ("", "", True), ("", "", True)]
    assert [r["markdown"] for r in found] == texts
    old = df.select("id", F.lit("").alias("name"), F.lit("1").alias("code"), F.coalesce("markdown", F.lit("")).alias("raw_markdown"))
    report, changed = changes.repair(old, [])
    assert {r["id"]: r["status"] for r in report.collect()} == {0: "repaired", 1: "skip", 2: "error"}
    assert [(r["id"], r["name"], len(r["work"])) for r in changed.collect()] == [(0, "Ann", 1)]


def test_chunks_are_dealt_to_as_many_tasks_as_shuffles_have(spark):
    shared = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.range(40).selectExpr("id doc_id", "concat('h <span id=\"page1\"></span> x', id) text")
    rows = spark.range(40).selectExpr("id % 9 doc_id", "id pos", "'Heading 1' style", "concat('t', id) text", "string(null) image")
    for found, n in ((chunks.ordered_chunks(texts), 80), (chunks.heading_chunks(rows), 40)):
        assert found.rdd.getNumPartitions() == shared and found.count() == n  # before: one task, as the rows are few


def test_requests_are_asked_by_many_tasks(spark, tmp_path):
    asked = spark.range(400).select(F.col("id").alias("candidate_id"), F.lit(0).cast("long").alias("job_id"), F.lit("r").alias("request")).coalesce(1)

    def model(requests):
        return ['{"overall_score": %d}' % TaskContext.get().partitionId()] * len(requests)

    scores, _ = matching.score_missing(asked, model, str(tmp_path / "scores"), slices=1)
    assert {r["overall_score"] for r in scores.collect()} == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # before: one task
