"""Documents in the parser's layouts, rendered from the test tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels as L
from . import tables


def _text(*parts: str | Column) -> Column:
    """Parts joined: strings as they are, columns by their text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lists(rows: DataFrame, line: Column, name: str, *more: Column) -> DataFrame:
    """The lines of each candidate, by seq and id, as one text; and what ``more`` gathers."""
    item = F.struct("seq", "id", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"])
    return rows.groupBy("candidate_id").agg(F.array_join(lines, "").alias(name), *more)


def basic_section() -> Column:
    """By id: a table, running text with bold keys, or lines broken inside a cell."""
    c = F.col
    years, age = c("years_of_experience"), _text(1950 + F.pmod("candidate_id", F.lit(50)), "(", F.pmod("candidate_id", F.lit(60)), ")")
    photo, intro = _text("![](photo_", c("candidate_id"), ".png)"), _text(L.SUMMARY, "**：** Intro of ", c("nationality"))
    table = _text(
        "| 姓名： | ", c("name"), " ♂ | 104代碼： | ", c("code"), " |\n|---|---|\n| 國籍： | ", c("nationality"), " | 年齡： | ", age, " |\n| 學歷： | ", c("education_level"), " | 年資： | ", years, " |\n",
        photo, "\n", intro, "\n",
    )
    flat = _text(
        photo, "\n**姓**/**名**:** ", c("name"), " ♀ **104代碼**： ", c("code"), "\n國籍: ", c("nationality"), " 年齡： ", age, " 學歷: ", c("education_level"), " 年資**:** ", years, "\n", intro, "\n",
    )
    broken = _text(
        photo, "<br>姓/名: ", c("name"), "<br>104代碼: ", c("code"), "<br/>國籍: ", c("nationality"), "<br>年齡: ", age, "<br>學歷: ", c("education_level"), "<br>年資: ", years, "<br>", intro, "\n",
    )
    layout = F.pmod("candidate_id", F.lit(3))
    return _text(f"# {L.BASIC}\n", F.when(layout == 0, table).when(layout == 1, flat).otherwise(broken))


@lru_cache(maxsize=2)
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id and markdown of every candidate: all sections, in layouts chosen by the id."""
    c, even = F.col, F.pmod("candidate_id", F.lit(2)) == 0
    opening = _text(c("company_name"), " , ", c("date_start"), " ~ 2000/01/01 (3 years)")
    as_rows = _text("| ", opening, " |\n| 職務類別： | ", c("job_category"), " | 公司規模： | ", c("id"), " |\n")
    as_lines = _text("**", opening, "**\n職務類別: ", c("job_category"), " 公司規模： ", c("id"), "\n")
    work = _lists(tables.work(spark, sf_dir), F.when(even, as_rows).otherwise(as_lines), "w")
    school = _text("| ", c("seq"), ". | ", c("school"), " | ", c("department"), " | ", c("degree_level"), " | 1990/01/01 ~ 1994/01/01 | R | done |\n")
    tag = lambda x: F.concat(F.lit("#"), F.replace(x, F.lit("#"), F.lit(" ")))
    tags = F.array_join(F.array_sort(F.transform(F.collect_set("department"), tag)), " ")
    # A line's department is a skill as well: lines are joined and moved once for both.
    schools = _lists(tables.lines(spark, sf_dir), school, "e", tags.alias("t"))
    email, mobile, address = _text("user", c("code"), "@example.org"), _text("09", c("code")), _text(c("nationality"), " Road ", c("code"))
    contact = F.when(
        even, _text(f"## {L.CONTACT[0]}\n| email: | ", email, " | ⼿機1: | ", mobile, " |\n| 通訊地址： | ", address, " |\n")
    ).otherwise(_text(f"## {L.CONTACT[1]}\n**email**: ", email, " 手機1: ", mobile, "\n通訊地址: ", address, "\n"))
    wishes = F.when(even, _text("## Wishes\n| 求職條件 | |\n| 希望⼯作性質: | ", c("nationality"), " |\n")).otherwise("")
    attached = _text("## More\n| 推薦人 | 名稱 |\n| 1. | File ", c("code"), " | http://f.example/", c("code"), " |\n| 附件 | 2. | Second |\n| 專案成就 |\n| 1. | no |\n")
    people = tables.candidates(spark, sf_dir).withColumnRenamed("id", "candidate_id")
    joined = people.join(work, "candidate_id", "left").join(schools, "candidate_id", "left")
    none = lambda name: F.coalesce(c(name), F.lit(""))
    markdown = _text(
        basic_section(), contact, f"## {L.WORK[1]}\n", none("w"), f"教育背景\n| {L.EDUCATION} | 科系 |\n", none("e"), wishes, f"## {L.SKILLS[1]}\n", none("t"), f"\n## {L.INTRODUCTION[1]}\n", attached,
    )
    return joined.select("candidate_id", markdown.alias("markdown"))
