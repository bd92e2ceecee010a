import json
import re

from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import changes, records, storage
from dossier.sources import files
from dossier.streaming.ingest import ingest_stream

PERSON = """before
# 基本資料
| 姓名： | Ann Lee ♀ | 104代碼： | 12345 x |
|---|---|
| 年齡： | 2002(24) | 國籍： | Peru |
## 聯絡方式
| email： | a@b.example |
## 工作經驗
| stray： | x |
| Acme , 2001/02/03 ~ 2004/05/06 (3 years) |
| 職務類別： | Build |
| no brackets , 2005/01/01 ~ now |
| Bolt , 2005/01/01 ~ now(2 years) |
## 才能專長
#one two #three
#three
"""


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_parse(spark):
    df = spark.createDataFrame([(1, PERSON), (2, None), (3, "")], "id int, markdown string")
    got = {r["id"]: r for r in records.parse_records(df, keep=["id"]).collect()}
    r = got[1]
    assert (r["name"], r["code"], r["birth_year"], r["age"], r["nationality"], r["email"]) == ("Ann Lee", "12345", "2002", "24", "Peru", "a@b.example")
    assert [(w["seq"], w["company_name"], w["date_end"], w["duration"], w["job_category"]) for w in r["work"]] == [
        (1, "Acme", "2004/05/06", "3 years", "Build"), (2, "Bolt", "now", "2 years", ""),
    ]
    assert r["skill_tags"] == ["one two", "three"]
    for k in (2, 3):  # nothing to read: empty, never null
        assert [got[k][c] for c in records.TEXTS] == [""] * 29 and [got[k][c] for c in (*records.LISTS, *records.CHILDREN)] == [[]] * 8


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, markdown string")
    return [r for _, r in sorted((r["id"], r) for r in records.parse_records(df, keep=["id"]).collect())]


def test_names_of_other_layouts(spark):
    names = {
        "# 基本資料\n**姓**/**名**:** 王小明 ♂ 英⽂名字**:** Ming 104代碼: 77 年齡: 30": "王小明",
        "# 基本資料\n| 姓/名: 王二<br>104代碼: 88<br>年齡: 2000(20)<br>理想職務: A  B、C |": "王二<br>",
        "# 基本資料\n| 謝岳 ♂ | 英⽂名字: | Yue |": "謝岳",
        "# 基本資料\n| Ann B||\n| x | y |": "Ann B",
        "# 基本資料\n| a: b||": "",
        "# 基本資料\n| 姓名: | Bo 英文名字 x | 國籍: | Peru |": "Bo",
        "no heading\n| 姓名: | Cy ♀ |": "Cy",
        "# 基本資料\n| 姓/名: | | 姓名: | Di |": "",  # the chain stops at the empty value
    }
    got = parsed(spark, *names)
    assert [r["name"] for r in got] == list(names.values())
    assert (got[0]["english_name"], got[0]["code"], got[0]["age"]) == ("Ming", "77", "30")
    assert (got[1]["code"], got[1]["birth_year"], got[1]["age"], got[1]["ideal_positions"]) == ("88", "2000", "20", ["A", "B", "C |"])


def test_basic_lists_links_and_summary(spark):
    r, s = parsed(
        spark,
        "# 基本資料\n| 姓名: | A | 104代碼: | x1 |\n| 希望職務類別: | IT, 工 | 程師、B | 年資: | 5 years |\n| 希望工作地點: | X，Y |\n"
        "![photo](p/a_1.png) Linkedin: [https://www.linkedin.com/in/a\\_b)](x)\n個⼈簡介**：** Hello\nthere 個⼈格⾔: z",
        "# 基本資料\n104**代碼**：** 99 end\n# ⾃我介紹\nI am. ## gone\n# 才能專⻑\n#a b #C# #d",
    )
    assert (r["desired_job_categories"], r["desired_locations"], r["years_of_experience"]) == (["IT", "程師", "5 years"], ["X", "Y"], "5 years")
    assert (r["photo_path"], r["linkedin_url"], r["self_introduction"], r["code"]) == ("p/a_1.png", "https://www.linkedin.com/in/a_b", "Hello\nthere", "")
    assert (s["code"], s["self_introduction"], s["skill_tags"], s["skills_text"]) == ("99", "I am.", ["a b", "d"], "# 才能專⻑\n#a b #C# #d")


def test_contact_layouts(spark):
    table, glued, inside, flat = parsed(
        spark,
        "# 聯絡⽅式\n| email: | a@b.c | ⼿機1: | 09 |\n| 地區: | T |",
        "# 聯絡方式 email: a@b.c 手機1: 08\n公司: 02 通訊地址: Road 1\nFloor 2",
        "# 基本資料\n| 姓名: | A |\n| email: | in@b.c | 住家: | 03 |",
        "# 聯絡方式\n**email**: f@b.c **手機2**: 07\n| 地區: | kept |",
    )
    assert (table["email"], table["mobile1"], table["district"]) == ("a@b.c", "09", "T")
    assert (glued["email"], glued["mobile1"], glued["phone_work"], glued["mailing_address"]) == ("a@b.c", "08", "02", "Road 1\nFloor 2")
    assert (inside["email"], inside["phone_home"]) == ("in@b.c", "03")
    assert (flat["email"], flat["mobile2"].split()[0], flat["district"]) == ("f@b.c", "07", "kept")


def test_work_as_text_and_recovered(spark):
    text, cut = parsed(
        spark,
        "# 工作經驗\n產業類別: Early 工作內容: Start\n**Acme , 2001/02/03 ~ 2002/01/01 (1 year)**\n職務名稱: Dev ⼯作技能: SQL\nBolt, 2003/01/01 ~ now (2 years)\n工作內容:\n管理責任: none at all",
        "# 工作經驗\nshort\n# 5 people\n| Acme , 2001/02/03 ~ 2002/01/01 (1 year) |\n| 公司規模: | 10 |\n教育背景\n| 教育背景 |\n| 1. | S | D | M | 2000/01/01 ~ 2001/01/01 | R | done |\n|\n| x. | no |\n| 2.a | T | E | B | 2000/01/01 ~ |\n## 才能專長\n#x",
    )
    one, two = text["work"]
    assert (one["company_name"], one["industry"], one["job_description"], one["job_title"], one["job_skills"]) == ("Acme", "Early", "Start", "Dev", "SQL")
    assert (two["seq"], two["company_name"], two["management_responsibility"], two["job_description"]) == (2, "Bolt", "none at all", "")
    assert [(w["company_name"], w["company_size"]) for w in cut["work"]] == [("Acme", "10")]
    assert [tuple(e) for e in cut["education"]] == [(1, "S", "D", "M", "2000/01/01", "2001/01/01", "R", "done"), (0, "T", "E", "B", "", "", "", "")]


def test_preferences_and_attachments(spark):
    (r,) = parsed(
        spark,
        "# a\n附件 in text\n# p\n| 求職條件 |\n| 希望工作性質: | full | 希望上班時段: | day |\n| 遠端⼯作: | yes |\n# z\n| 推薦人 | 名稱 |\n| 1. | Ref file | http://a |\n"
        "| 附件 | 1. | Doc | http://b | more |\n| 專案成就 |\n| 1. | Project |\n| 其他作品 | 2. | Work |",
    )
    assert (r["work_type"], r["shift_preference"], r["remote_work_preference"]) == ("full", "day", "yes")
    assert [(a["seq"], a["name"], a["url"], a["attachment_type"]) for a in r["attachments"]] == [(1, "Ref file", "http://a", "附件"), (2, "Doc", "http://b", "附件")]
    assert r["references"] == []


def test_split_people(spark):
    df = spark.createDataFrame([(PERSON + PERSON[7:],)], "text string")
    assert [r["part"] for r in records.split_people(df).collect()] == [0, 1, 2]


def test_texts(spark):
    assert one(spark, lambda c: text.safe_name(c, "candidate"), "a b/c-1_é") == "abc-1_é"
    assert one(spark, lambda c: text.safe_name(c, "candidate"), "//") == "candidate"
    assert one(spark, text.strip_fences, '```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, text.decode_list, "") == [] and one(spark, text.decode_list, '["a"]') == ["a"]
    assert one(spark, lambda c: text.within_budget(c, 100, 50), "x" * 600) == "x" * 500 + "\n\n[... truncated ...]"
    assert one(spark, lambda c: text.score_label(c.try_cast("double")), "59.5") == "60"
    assert one(spark, lambda c: text.score_band(c.try_cast("double")), None) == "No Score"
    assert one(spark, text.strip, "　 a 　") == "a"
    assert one(spark, text.hashtag_lines, "#a #b_c\n# d\n#e f\n#g") == [["a", "b_c"], ["g"]]
    assert one(spark, lambda c: text.log_name(c, c.isNull().cast("int"), "姓/名"), "| 姓/名: | Ann Lee |") == "Ann Lee"
    assert one(spark, lambda c: F.struct(*text.path_parts(c)), "a/b/c_original.md") == ("a/b", "c_original", ".md")


def test_split_at_headings(spark):
    cut = lambda x: one(spark, lambda c: text.split_documents(c, "基本資料"), x)
    assert cut("a\n##### 基本資料\nb\n# 基本資料 x\n# 基本資料") == ["a", "##### 基本資料\nb\n# 基本資料 x", "# 基本資料"]
    assert cut(" \n") == [" \n"]
    named = records.named_parts(spark.createDataFrame([(0, "| 姓/名: | A/b c |"), (1, "none")], "part int, markdown string")).collect()
    assert [r["folder"] for r in named] == ["candidate_1_Abc", "candidate_2_candidate_2"]


def test_sections_at_odd_line_ends(spark):
    md = "# a\rb\nx\n#\nc\ny\n# a\rb\nz\n##### no\n"
    df = spark.createDataFrame([(md,)], "x string").select(text.headings(F.col("x")).alias("n"), text.bodies(F.col("x")).alias("b"))
    parts = df.select(text.sections(F.col("n"), F.col("b")).alias("p")).first()["p"]
    assert [tuple(p) for p in parts] == [("_preamble", ""), ("a\rb", "z\n##### no"), ("c", "y")]


def test_scores_by_both_schemes(spark):
    values = [40.0, 50.0, 60.0, 75.0, 80.0, 74.95, 74.94, 49.95, 0.25, 0.35, 12.25, 99.95, None]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    s = F.col("s")
    got = df.select(text.round_to_tenth(s).alias("r"), text.score_band(s).alias("a"), text.score_band(s, (75, 50), ("high", "middle", "low"), "none", rounded=True).alias("b")).collect()
    assert [r["r"] for r in got[:-1]] == [round(v, 1) for v in values[:-1]]
    assert [r["a"] for r in got] == ["40-59", "40-59", "60-79", "60-79", "80+", "60-79", "60-79", "40-59", "<40", "<40", "<40", "80+", "No Score"]
    assert [r["b"] for r in got] == ["low", "middle", "middle", "high", "high", *["high" if round(v, 1) >= 75 else "middle" if round(v, 1) >= 50 else "low" for v in values[5:-1]], "none"]


def test_changes(spark):
    table = spark.createDataFrame([(1, "a", "x")], "id long, title string, source_json string")
    new = spark.createDataFrame([(None, "a", "y"), (None, "b", "z")], "id long, title string, source_json string")
    assert sorted(map(tuple, changes.ensure_new(table, new, "title").collect())) == [(1, "a", "x"), (2, "b", "z")]
    people = spark.createDataFrame([(1, "Ann", "1", "t"), (2, "A|", "1", "t"), (3, None, "1", "t"), (4, "", "", "")], "id int, name string, code string, raw_markdown string")
    assert sorted(r["id"] for r in changes.find_broken(people, ["leak"]).collect()) == [2, 3]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text(PERSON)
    (tmp_path / "r.json").write_text(json.dumps({"candidates": [{"name": "A"}, {"name": "B"}]}))
    (tmp_path / "j.json").write_text('{"basic_conditions": {}}')
    assert files.read_markdown(spark, str(tmp_path / "md")).count() == 1
    assert [r["raw"] for r in files.read_records_json(spark, str(tmp_path / "r.json")).records.orderBy("index").collect()] == ['{"name":"A"}', '{"name":"B"}']
    assert files.read_job_requirement(spark, str(tmp_path / "j.json")).first()["title"] == "Default Job"
    for _ in range(2):  # a restart adds nothing
        ingest_stream(spark, str(tmp_path / "md"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert storage.stored_table(spark, str(tmp_path / "out"), "candidates").count() == 1


def test_strip_knows_all_white_space(spark):
    spaces = [chr(k) for k in range(0x3001) if chr(k).isspace()]
    assert one(spark, text.strip, "".join(spaces) + "a b" + "".join(spaces)) == "a b"
    assert one(spark, text.strip, "​a​") == "​a​"


def test_names_alone_need_the_basic_section_alone(spark):
    df = spark.createDataFrame([(1, PERSON)], "id int, markdown string")
    plan = lambda c: records.parse_records(df, keep=["id"]).select("id", c)._jdf.queryExecution().optimizedPlan().toString()
    steps = {c: set(re.findall(r" AS (_[a-z_]+)#", plan(c))) for c in ("name", "work", "skill_tags")}
    always = {"_kept", "_md"}
    assert steps["skill_tags"] == always | {"_skills"}
    assert steps["name"] == always | {"_names", "_bodies", "_parts", "_basic", "_basic_rows", "_kv", "_more", "_pairs"}
    assert "_work_rows" in steps["work"] and not steps["work"] & {"_contact", "_skills", "_pairs", "_tables", "_basic", "_basic_rows"}
    clash = df.select("id", "markdown", *[F.lit(k).alias(c) for k, c in enumerate(("_md", "_basic", "name", "_kept"))])
    r = records.parse_records(clash, keep=["id", "_md", "_basic", "_kept"]).first()
    assert (r["_md"], r["_basic"], r["_kept"], r["name"]) == (0, 1, 3, "Ann Lee")


def test_time_grows_with_the_pairs_alone(spark):
    import time

    def seconds(n):
        rows = "".join(f"| key{k}： | value {k} | 國籍： | Peru{k} |\n| 1. | x |\n" for k in range(n))
        body = f"# 基本資料\n| 姓名： | Ann |\n{rows}## 聯絡方式\n{rows}## 求職條件\n| 求職條件 |\n{rows}" + "".join(f"## s{k}\n" for k in range(n))
        df = spark.createDataFrame([(1, body)], "id int, markdown string")
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            r = records.parse_records(df).first()
            best = min(best, time.perf_counter() - start)
        assert (r["name"], r["nationality"]) == ("Ann", f"Peru{n - 1}")
        return best

    small, large = seconds(500), seconds(4000)
    assert large < 16 * small  # 8 times the pairs; the square would be 64 times
