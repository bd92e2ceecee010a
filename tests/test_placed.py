"""Texts are placed before they are parsed, lines are joined where they are read: what is moved, staged and sent to the driver."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from dossier.operators import published, records, storage
from dossier.plans import catalog, rendering
from dossier.sources import files

H = "# 基本資料"


def person(k):
    return f"{H}\n| 姓名： | P{k} | 104代碼： | {k} |\n## 工作經驗\n| Acme , 2001/02/03 ~ now (3 years) |\n| 職務類別： | x |\n教育背景\n| 1. | S{k} | D | M | 1990/01/01 ~ 1994/01/01 | R | done |\n"


def test_what_is_dear_is_made_once_of_placed_rows(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def dear(x):
        made.add(1)
        return 10 * x

    rows = spark.range(100).select(F.col("id").alias("k"))
    staged = str(tmp_path / "staged")
    placed = published.ranged(rows, staged, ["k"], F.col("k") % 3 == 1, lambda at: at.select("*", dear("k").alias("x")))
    found = {r["k"]: r for r in published.numbered_from(placed, 7).collect()}
    good = [k for k in range(100) if k % 3 != 1]
    assert {k: r["id"] for k, r in found.items() if k in good} == {k: 8 + i for i, k in enumerate(good)}
    assert all(r["x"] == 10 * k and (k in good or r["id"] is None) for k, r in found.items()) and len(found) == 100
    assert made.value == 100 and [p.name for p in Path(staged).iterdir()] == ["ranged"]  # before: all columns were written, moved and written again


def test_a_text_is_staged_once_and_small(spark, tmp_path, monkeypatch):
    path, kept = str(tmp_path / "s"), []
    monkeypatch.setattr(published, "remove", lambda session, where: kept.append(where))
    people = spark.createDataFrame([(f"f{k:03}", person(k)) for k in range(60)] + [("f030x", " \n")], "path string, text string")
    storage.batch_import(people, path, split=False, batch="one")
    staged = spark.read.parquet(f"{kept[-1]}/ranged")
    assert {"markdown", "path"} <= set(staged.columns) and not {"raw_markdown", "source_md_path"} & set(staged.columns)  # before: each text twice
    written = list((tmp_path / "s").rglob("*.parquet"))
    assert written and all(".zstd." in p.name for p in written if p.is_file())
    stored = storage.stored_table(spark, path, "candidates").orderBy("id").collect()
    assert [(r["id"], r["name"], r["raw_markdown"], r["source_md_path"]) for r in stored] == [(k + 1, f"P{k}", person(k), f"f{k:03}") for k in range(60)]
    assert [r["reason"] for r in storage.stored_table(spark, path, "rejects").collect()] == ["blank text"]


def test_lines_are_joined_where_they_are_read(spark, tmp_path):
    texts = {"a": "".join(person(k) for k in range(20)), "b": "pre\n\n" + person(7), "c": "\n\n", "d": f"x\n{H}x\n", "e": f"{H}\n{H}\n", "f": f"\n{H}\ny\n {H}"}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    path = F.col("_metadata.file_path").alias("path")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(path, F.col("value").alias("text"))
    expected = sorted(map(tuple, records.split_people(whole, keep=["path"]).collect()))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    for size, batch in (("90", "3"), (before[0], "2"), ("250", "1"), (before[0], before[1])):
        for n, v in zip(names, (size, batch), strict=True):
            spark.conf.set(n, v)
        try:
            lines = spark.read.text(str(tmp_path), lineSep="\n").select(path, F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
            people = files.people_in_lines(lines, H[2:])
            assert sorted((r["path"], r["part"], r["markdown"]) for r in people.collect()) == expected
        finally:
            for n, v in zip(names, before, strict=True):
                spark.conf.set(n, v)
    plan = people._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(path#\d+, block#\d+L?, at#", plan)  # before: each split's lines were moved to one task and sorted


def test_documents_are_rendered_from_one_pass_over_lines(spark):
    plan = rendering.rendered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey#") and len(re.findall(r"Relation \[l_orderkey", plan)) == 1  # before: once for schools, once for skills


def test_ids_are_not_gathered_in_the_driver(spark):
    rows, people = spark.createDataFrame([(1,), (1,), (9,)], "candidate_id long"), spark.createDataFrame([(1,), (2,)], "id long")
    found = catalog._of_people(rows, people)
    assert [r["id"] for r in found.collect()] == [1, 1]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_schools_are_the_last_rows_of_work(spark):
    texts = [
        person(1), person(1).replace("教育背景\n", "| 教育背景 | 學校 |\n"), person(1).replace("教育背景", "other"), person(1).replace("\n", "\r\n"),
        "## 工作經驗\n教育背景", "## 工作經驗\n| 1. | before |\n教育背景\n|---|\n| 2. | after |\n|\n| x |\n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, markdown string")
    found = {r["id"]: [(x["seq"], x["school"]) for x in r["education"]] for r in records.parse_records(df, keep=["id"]).collect()}
    assert found == {0: [(1, "S1")], 1: [(1, "S1")], 2: [(1, "S1")], 3: [(1, "S1")], 4: [], 5: [(2, "after")]}


def test_batches_are_read_from_documents_rendered_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(storage, "batch_import", lambda rows, *a, **b: seen.append(rows))
    catalog.QUERIES["published_batches"](spark, "/root/testdata/sf0.001")
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for rows in seen]
    assert len(plans) == 3 and not any("l_orderkey" in p for p in plans)  # before: all tables were joined for each batch
