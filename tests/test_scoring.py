import pytest
from pyspark.sql import functions as F

from dossier.operators import changes, matching, published


def requests(spark, n):
    return spark.range(n).select(F.col("id").alias("candidate_id"), (F.col("id") % 3).alias("job_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("request"))


def test_one_bad_request_fails_alone(spark):
    def model(asked):
        if any(r in ("r3", "r7") for r in asked):
            raise RuntimeError("refused")
        return asked.str.upper()

    rows = {r["candidate_id"]: (r["reply"], r["error"]) for r in matching.score_with(requests(spark, 10).coalesce(1), model).collect()}
    assert rows == {k: (None, "RuntimeError: refused") if k in (3, 7) else (f"R{k}", None) for k in range(10)}
    short = matching.score_with(requests(spark, 4).coalesce(1), lambda asked: asked[:2] if len(asked) > 1 else asked).collect()
    assert all(r["reply"] == r["request"] and r["error"] is None for r in short)


def test_a_second_run_asks_only_for_what_is_missing(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "scores"), tmp_path / "log"
    log.mkdir()

    def model(bad):
        def ask(asked):
            out = []
            for r in asked:
                if r in bad:
                    raise ValueError(r)
                (log / f"{r}-{len(list(log.glob(r + '-*')))}").touch()
                out.append("no json" if r == "r5" and bad else '{"overall_score": %s, "gaps": ["g"]}' % r[1:])
            return asked.__class__(out)

        return ask

    many = requests(spark, 40)
    # Stopped after three of eight slices.
    count, plain = [0], published.publish

    def stopping(*a):
        count[0] += 1
        if count[0] == 4:
            raise KeyboardInterrupt
        return plain(*a)

    with monkeypatch.context() as m:
        m.setattr(published, "publish", stopping)
        with pytest.raises(KeyboardInterrupt):
            matching.score_missing(many, model({"r4"}), path, slices=8)
    kept = {r["candidate_id"] for r in matching.stored_scores(spark, path).collect()}
    assert 0 < len(kept) < 40
    before = {f.name for f in log.iterdir()}
    scores, rejects = matching.score_missing(many, model({"r4"}), path, slices=8)
    assert {r["candidate_id"] for r in scores.collect()} == set(range(40)) - {4, 5}
    assert {(r["candidate_id"], r["stage"], r["reason"]) for r in rejects.collect()} <= {(4, "request", "ValueError: r4"), (5, "reply", "json")}
    again = {f.name.split("-")[0] for f in log.iterdir()} - {f.split("-")[0] for f in before}
    assert not {f"r{k}" for k in kept} & again
    asked = len(list(log.iterdir()))
    scores, rejects = matching.score_missing(many, model(set()), path, slices=8)
    assert rejects.count() == 0 and len(list(log.iterdir())) == asked + 2
    assert sorted((r["candidate_id"], r["overall_score"], r["gaps"]) for r in scores.collect()) == [(k, float(k), ["g"]) for k in range(40)]


def test_texts_without_anything_are_errors(spark):
    text = "# 基本資料\n| 姓名： | Ann | 104代碼： | 1 |"
    rows = [(1, "", "", text), (2, "A|", "7", "plain"), (3, None, "9", "## 才能專長\n#a"), (4, "Ann", "1", text), (5, "", "", " "), (6, "Bo|", "5", "# 基本資料\n| 104代碼： | 5 |")]
    people = spark.createDataFrame(rows, "id long, name string, code string, raw_markdown string")
    report, records = changes.repair(people, ["leak"])
    assert {r["id"]: r["status"] for r in report.collect()} == {1: "repaired", 2: "error", 3: "error", 5: "error", 6: "skip"}
    assert [r["id"] for r in records.collect()] == [1]
    assert {r["status"]: r["n"] for r in changes.repair_summary(report, people).collect()} == {"repaired": 1, "skip": 1, "error": 3, "still_empty_name": 3}
